"""Mutations, history, outbox, retention, state machines and event windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import history, mutate
from ..operators.mutate import Action, Writer
from ..streaming import events as windows
from .catalog_core import compiler
from .model import Model, sample_model
from .policy import Context
from .registry import query

NOW = dt.datetime(2024, 6, 1, 12, 0, 0)


def writer(spark, sf_dir, name, context=None, rules=None):
    table = sample_model(spark, sf_dir).table(name)
    table.metadata.update(rules or {})
    return Writer(spark, table, context or Context(), NOW), spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("mutation_insert", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 900001, 'New', 3, 1.5")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    return w.insert(before, {"s_suppkey": 900001, "s_name": "New", "s_nationkey": 3, "s_acctbal": 1.5}).rows


@query("mutation_update", "SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'Renamed' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    return w.update(before, {"s_suppkey": 3, "s_name": "Renamed"}).rows


@query("mutation_update_missing_key", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    return w.update(before, {"s_suppkey": 99999999, "s_name": "Nobody"}).rows


@query("mutation_delete", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey <> 4")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    return w.delete(before, {"s_suppkey": 4}).rows


@query("mutation_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey = 5 THEN 'Five' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 900002, 'Two', NULL, NULL")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    return w.batch(before, [Action("upsert", {"s_suppkey": 5, "s_name": "Five"}), Action("upsert", {"s_suppkey": 900002, "s_name": "Two"})]).rows


@query("mutation_batch_last_wins", "SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN 'B' ELSE s_name END AS s_name, CASE WHEN s_suppkey = 1 THEN 9 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier WHERE s_suppkey <> 2")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    steps = [Action("update", {"s_suppkey": 1, "s_name": "A", "s_nationkey": 9}), Action("update", {"s_suppkey": 2, "s_name": "X"}), Action("update", {"s_suppkey": 1, "s_name": "B"}), Action("delete", {"s_suppkey": 2})]
    return w.batch(before, steps).rows


@query("mutation_bulk", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "orders")
    actions = before.filter("o_orderstatus <> 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    actions = actions.withColumns({"__op": F.lit("update"), "__set": F.array(F.lit("o_totalprice"))})
    return w.apply(before, actions).rows


@query("mutation_changes", "SELECT 'update' AS op, s_suppkey, s_name AS old, 'Renamed' AS new FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT 'delete', s_suppkey, s_name, NULL FROM supplier WHERE s_suppkey = 4 UNION ALL SELECT 'insert', 900001, NULL, 'New'")
def _(spark, sf_dir):
    rows = _changes(spark, sf_dir)
    return rows.select("op", "s_suppkey", F.col("before.s_name").alias("old"), F.col("after.s_name").alias("new"))


def _changes(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    same = before.filter("s_suppkey = 6").first()
    steps = [Action("update", {"s_suppkey": 3, "s_name": "Renamed"}), Action("delete", {"s_suppkey": 4}), Action("insert", {"s_suppkey": 900001, "s_name": "New"}), Action("update", {"s_suppkey": 6, "s_name": same.s_name})]
    return w.batch(before, steps).changes


@query("mutation_soft_delete", "SELECT s_suppkey, CASE WHEN s_suppkey = 4 THEN TIMESTAMP '2024-06-01 12:00:00' END AS deleted_at FROM supplier")
def _(spark, sf_dir):
    model = Model()
    before = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    table = model.add("supplier", before, ("s_suppkey",))
    table.metadata["soft-delete"] = "deleted_at"
    return Writer(spark, table, now=NOW).delete(before, {"s_suppkey": 4}).rows


@query("mutation_tenant_guard", "SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3) THEN 'Mine' ELSE c_name END AS c_name FROM customer")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "customer", Context({"tenant_id": 3}), {"tenant-filter": "c_nationkey"})
    mine = before.filter("c_nationkey = 3").agg(F.min("c_custkey")).first()[0]
    other = before.filter("c_nationkey <> 3").agg(F.min("c_custkey")).first()[0]
    return w.batch(before, [Action("update", {"c_custkey": mine, "c_name": "Mine"}), Action("update", {"c_custkey": other, "c_name": "Theirs"})]).rows.select("c_custkey", "c_name")


@query("mutation_batch_delete_wins", "SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'Again' ELSE s_name END AS s_name, CASE WHEN s_suppkey = 3 THEN NULL ELSE s_nationkey END AS s_nationkey, CASE WHEN s_suppkey = 3 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey NOT IN (1, 2)")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    steps = [Action("delete", {"s_suppkey": 1}), Action("update", {"s_suppkey": 1, "s_name": "X"}), Action("update", {"s_suppkey": 2, "s_name": "X"}), Action("delete", {"s_suppkey": 2})]
    return w.batch(before, steps + [Action("delete", {"s_suppkey": 3}), Action("insert", {"s_suppkey": 3, "s_name": "Again"})]).rows


@query("mutation_row_scope", "SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3) THEN 'Mine' ELSE c_name END AS c_name, c_nationkey FROM customer")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "customer", Context({"nation": 3}), {"policy-row-scope": "c_nationkey = {nation}"})
    mine = before.filter("c_nationkey = 3").agg(F.min("c_custkey")).first()[0]
    other = before.filter("c_nationkey <> 3").agg(F.min("c_custkey")).first()[0]
    last = before.filter("c_nationkey = 3").agg(F.max("c_custkey")).first()[0]
    steps = [Action("update", {"c_custkey": mine, "c_name": "Mine"}), Action("update", {"c_custkey": other, "c_name": "Theirs"}), Action("update", {"c_custkey": last, "c_nationkey": 4}), Action("insert", {"c_custkey": 99999999, "c_nationkey": 5})]
    return w.batch(before, steps).rows.select("c_custkey", "c_name", "c_nationkey")


@query("history_trail", "SELECT 'supplier' AS entity, '{\"s_suppkey\":3}' AS entity_id, 'update' AS op, 's_name' AS changed UNION ALL SELECT 'supplier', '{\"s_suppkey\":4}', 'delete', 's_suppkey,s_name,s_nationkey,s_acctbal' UNION ALL SELECT 'supplier', '{\"s_suppkey\":900001}', 'insert', 's_suppkey,s_name'")
def _(spark, sf_dir):
    rows = history.trail(_changes(spark, sf_dir), "supplier", ["s_suppkey"], "me", NOW)
    return rows.select("entity", "entity_id", "op", F.array_join("changed_columns", ",").alias("changed"))


@query("outbox_events", "SELECT 'supplier' AS aggregate, '{\"s_suppkey\":3}' AS key, 'update' AS op, '{\"s_suppkey\":3,\"s_name\":\"Renamed\"}' AS payload UNION ALL SELECT 'supplier', '{\"s_suppkey\":4}', 'delete', '{\"s_suppkey\":4}' UNION ALL SELECT 'supplier', '{\"s_suppkey\":900001}', 'insert', '{\"s_suppkey\":900001,\"s_name\":\"New\"}'")
def _(spark, sf_dir):
    return history.outbox(_changes(spark, sf_dir), "supplier", ["s_suppkey"], NOW, "changed").select("aggregate", "key", "op", "payload")


@query("outbox_due", "SELECT key, event_id FROM (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 ORDER BY ts, event_id LIMIT 100")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("e").alias("aggregate"), F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("dispatched_at"), F.lit(0).alias("attempts"), F.lit(False).alias("dead"))
    return history.due(rows, NOW).select("key", F.col("id").alias("event_id"))


@query("retention_purge", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' OR o_orderdate IS NULL")
def _(spark, sf_dir):
    rule = history.parse_retention("ttl: 30d after o_orderdate", None)
    return history.swept(spark.read.parquet(f"{sf_dir}/orders.parquet"), rule, dt.datetime(1996, 1, 31)).select("o_orderkey")


@query("retention_candidates", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _(spark, sf_dir):
    rule = history.parse_retention("ttl: 30d after o_orderdate", None)
    return history.purge_batch(spark.read.parquet(f"{sf_dir}/orders.parquet"), rule, dt.datetime(1996, 1, 31), ["o_orderkey"])


@query("tree_sync", "SELECT 'update' AS op, n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 1 UNION ALL SELECT 'delete', n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0 UNION ALL SELECT 'insert', 1000")
def _(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    wanted = nation.filter("n_regionkey = 1 AND n_nationkey % 2 = 1").withColumn("n_name", F.concat("n_name", F.lit("!")))
    wanted = wanted.unionByName(spark.createDataFrame([(1000, "Atlantis", 1)], "n_nationkey int, n_name string, n_regionkey int"))
    return mutate.sync(nation, wanted, ["n_nationkey"], F.col("n_regionkey") == 1).select("op", "n_nationkey")


@query("undo_restores", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    done = w.batch(before, [Action("update", {"s_suppkey": 3, "s_name": "Renamed"}), Action("delete", {"s_suppkey": 4}), Action("insert", {"s_suppkey": 900001})])
    return mutate.undo(done.rows, done.changes, ["s_suppkey"], NOW, NOW, dt.timedelta(hours=1))


@query("state_machine_violations", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "orders")
    machine = mutate.parse_transitions("O -> P; P -> F[clerk]@finish; F -> F")
    actions = before.withColumns({"o_orderstatus": F.lit("P"), "__op": F.lit("update"), "__set": F.array(F.lit("o_orderstatus"))})
    changes = w.apply(before, actions).changes
    return mutate.illegal_changes(changes, "o_orderstatus", machine, "O", frozenset()).select("o_orderkey")


@query("validation_faults", "SELECT p_partkey, CASE WHEN p_size > 40 AND length(p_name) < 5 THEN 2 WHEN p_size > 40 OR length(p_name) < 5 THEN 1 ELSE 0 END AS n FROM part")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    table = c.model.table("part")
    table.columns["p_size"].metadata["max"] = "40"
    table.columns["p_name"].metadata["minlength"] = "5"
    return mutate.faults(c.scan(table), table).select("p_partkey", F.size("faults").alias("n"))


# Event windows: not part of the source system, but of this one


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    rows = windows.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")
    return rows.select("start", "event_type", "n", F.round("v", 4).alias("v"))


@query("events_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 30 MINUTE GROUP BY 1")
def _(spark, sf_dir):
    rows = windows.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "30 minutes")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("mutation_delete_where", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "customer")
    return w.delete_where(before, {"c_mktsegment": "BUILDING"}).rows.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("mutation_token", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'Renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey = 1 THEN 1 + (SELECT c_nationkey FROM customer WHERE c_custkey = 1) ELSE c_nationkey END AS c_nationkey FROM customer")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "customer", rules={"concurrency-token": "c_nationkey"})
    actions = before.filter("c_custkey = 1").withColumns({"c_name": F.lit("Renamed"), "__op": F.lit("update"), "__set": F.array(F.lit("c_name"), F.lit("c_nationkey"))})
    return w.apply(before, actions, few=True).rows.select("c_custkey", "c_name", "c_nationkey")


@query("mutation_state_machine", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "orders", rules={"state-column": "o_orderstatus", "state-initial": "o", "state-transitions": "o->f; f->p"})
    actions = before.filter("o_orderstatus = 'O'").withColumns({"o_orderstatus": F.lit("F"), "__op": F.lit("update"), "__set": F.array(F.lit("o_orderstatus"))})
    return w.apply(before, actions).rows.select("o_orderkey", "o_orderstatus")


@query("mutation_approved", "SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'Renamed' ELSE s_name END AS s_name FROM supplier")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    changes = w.batch(before, [Action("update", {"s_suppkey": 3, "s_name": "Renamed"}), Action("delete", {"s_suppkey": 4})]).changes
    queue = mutate.pending(changes, "supplier", "author", NOW)
    queue = mutate.decided(queue, queue.select("id", (F.col("op") == "update").alias("approve"), F.lit("chief").alias("decider"), F.lit(NOW).alias("decided_at")))
    return mutate.replay(before, mutate.approved(queue, before, ["s_suppkey"]), ["s_suppkey"]).select("s_suppkey", "s_name")
