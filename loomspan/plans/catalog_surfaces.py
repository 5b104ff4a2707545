"""Nulls in filters, sources and sinks, introspection, keyset cursors, memberships, write tools and change feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..frontends import intent, ldap, listing, odata
from ..functions import local, text
from ..operators import aggregate, filters, history, search
from ..operators.mutate import Action
from ..sources import tables
from .catalog_core import compiler, select
from .catalog_writes import NOW, _changes, writer
from .model import Model
from .nodes import Cmp, Query
from .policy import Context, Profile
from .registry import query

# Nulls: customers whose segment or nation is missing

NULLS = "(SELECT c_custkey, c_name || '_50%' AS c_name, NULLIF(c_nationkey, 3) AS c_nationkey, c_acctbal, NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"


def with_nulls(spark, sf_dir):
    c = compiler(spark, sf_dir)
    rows = c.model.frame(c.model.table("customer"))
    c.model.replace("customer", rows.withColumns({"c_name": F.concat("c_name", F.lit("_50%")), "c_nationkey": F.nullif("c_nationkey", F.lit(3)), "c_mktsegment": F.nullif("c_mktsegment", F.lit("BUILDING"))}))
    return c


#: name: (filter document, SQL condition)
NULL_FILTERS = {
    "eq_null": ({"c_mktsegment": {"_eq": None}}, "c_mktsegment IS NULL"),
    "neq_null": ({"c_mktsegment": {"_neq": None}}, "c_mktsegment IS NOT NULL"),
    "null": ({"c_mktsegment": {"_null": True}}, "c_mktsegment IS NULL"),
    "neq": ({"c_mktsegment": {"_neq": "MACHINERY"}}, "c_mktsegment <> 'MACHINERY'"),
    "nin": ({"c_nationkey": {"_nin": [1, 2]}}, "c_nationkey NOT IN (1, 2)"),
    "nbetween": ({"c_nationkey": {"_nbetween": [5, 9]}}, "c_nationkey NOT BETWEEN 5 AND 9"),
    "ncontains": ({"c_mktsegment": {"_ncontains": "MACH"}}, "NOT contains(c_mktsegment, 'MACH')"),
    "or": ({"or": [{"c_mktsegment": {"_neq": "MACHINERY"}}, {"c_nationkey": {"_null": True}}]}, "c_mktsegment <> 'MACHINERY' OR c_nationkey IS NULL"),
    "contains_escaped": ({"c_name": {"_contains": "_50%"}}, "contains(c_name, '_50%')"),
    "like_wildcards": ({"c_name": {"_like": "%1_50%"}}, "c_name LIKE '%1_50%'"),
}


def _null_filter(name, document, condition):
    @query(f"nulls_{name}", f"SELECT c_custkey, c_mktsegment, c_nationkey FROM {NULLS} WHERE {condition}")
    def _(spark, sf_dir):
        return select(with_nulls(spark, sf_dir), "customer", ["c_custkey", "c_mktsegment", "c_nationkey"], document)


for _name, _case in NULL_FILTERS.items():
    _null_filter(_name, *_case)


@query("nulls_sort_first", f"SELECT c_custkey, c_mktsegment FROM {NULLS} ORDER BY c_mktsegment NULLS FIRST, c_custkey LIMIT 40")
def _(spark, sf_dir):
    return select(with_nulls(spark, sf_dir), "customer", ["c_custkey", "c_mktsegment"], sort=["c_mktsegment_asc"], limit=40)


@query("nulls_grouped", f"SELECT c_mktsegment, count(*) AS _count, max(c_acctbal) AS _max_c_acctbal FROM {NULLS} GROUP BY 1")
def _(spark, sf_dir):
    return aggregate.grouped(with_nulls(spark, sf_dir), aggregate.Grouped("customer", ["c_mktsegment"], [("max", "c_acctbal")], True))


@query("nulls_link", f"SELECT c_custkey, n_name FROM {NULLS} LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    rows = with_nulls(spark, sf_dir).nested(Query("customer", ["c_custkey"], links={"nation": Query("nation", ["n_name"])}, limit=-1))
    return rows.select("c_custkey", "nation.n_name")


@query("search_ranked_rows", "SELECT 'nation' AS \"table\", CAST(n_nationkey AS VARCHAR) AS row_key, 1 AS score FROM (SELECT n_nationkey FROM nation WHERE contains(n_name, 'NATION_1') ORDER BY 1 LIMIT 50) ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 5")
def _(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return search.ranked({"nation": (nation, ["n_nationkey"])}, "NATION_1")[0].select("table", "row_key", "score")


# Sources and sinks


@query("files_csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(spark, sf_dir):
    return _through_files(spark, sf_dir, "csv")


@query("files_orc_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(spark, sf_dir):
    return _through_files(spark, sf_dir, "orc")


@query("files_json_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(spark, sf_dir):
    return _through_files(spark, sf_dir, "json")


def _through_files(spark, sf_dir, kind):
    rows = select(compiler(spark, sf_dir), "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    path = tables.scratch(spark, f"orders-{kind}")
    tables.write_files(rows, path, kind)
    return tables.read_files(spark, path, kind, rows.schema)


@query("files_partitioned", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    path = tables.scratch(spark, "orders-by-status")
    tables.write_files(select(compiler(spark, sf_dir), "orders", ["o_orderkey", "o_orderstatus"]), path, partition=["o_orderstatus"])
    return tables.read_files(spark, path).filter("o_orderstatus = 'F'")


@query("file_columns", "SELECT CAST(s_suppkey AS VARCHAR) AS name, octet_length(encode(s_name)) AS bytes, s_name AS content FROM supplier")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_name").cast("binary").alias("photo"))
    path = tables.scratch(spark, "photos")
    stored = tables.scratch(spark, "photo-places")
    tables.write_files(tables.write_blobs(rows, path, "name", "photo"), stored)
    found = tables.blobs(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("digest"), "content")
    return tables.read_files(spark, stored).join(found, "digest").select("name", "bytes", F.col("content").cast("string").alias("content"))


@query("stored_procedure", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'O'")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    calls = tables.Procedures()
    calls.register("dear_orders", lambda least, status: select(c, "orders", ["o_orderkey", "o_totalprice"], {"o_totalprice": {"_gte": least}, "o_orderstatus": {"_eq": status}}), ("least", "status"))
    return calls.call("dear_orders", least=150000, status="O")


@query("saved_query", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _(spark, sf_dir):
    saved = tables.SavedObjects(spark, tables.scratch(spark, "saved"))
    saved.save("me", "rich", {"table": "customer", "columns": ["c_custkey"], "filter": {"c_acctbal": {"_gt": 5000}}})
    found = saved.load("me", "rich")
    return select(compiler(spark, sf_dir), found["table"], found["columns"], found["filter"])


# Introspection and what a caller sees of it

SCALARS = "CASE data_type WHEN 'BIGINT' THEN 'BigInt' WHEN 'INTEGER' THEN 'Int' WHEN 'DOUBLE' THEN 'Float' WHEN 'TIMESTAMP' THEN 'DateTime' ELSE 'String' END"
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
STARS = str(NAMES)
DESCRIBED = "(" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type AS data_type FROM (DESCRIBE {t})" for t in NAMES) + ")"


def _columns(spark, overview):
    rows = [(t["table"], c["name"], c["scalar"]) for t in overview for c in t["columns"] if t["table"] in NAMES]
    return local.frame(spark, rows, "table string, column string, scalar string")


@query("introspection_all", f'SELECT table_name AS "table", column_name AS "column", {SCALARS} AS scalar FROM {DESCRIBED}')
def _(spark, sf_dir):
    found = tables.introspection(spark, compiler(spark, sf_dir).model)
    return found.filter(F.expr(f"table IN {STARS}")).select("table", "column", "scalar")


@query("introspection_visible", f"SELECT table_name AS \"table\", column_name AS \"column\", {SCALARS} AS scalar FROM {DESCRIBED} WHERE table_name <> 'supplier' AND column_name <> 'c_acctbal'")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, rules={"supplier": {"visibility": "hidden"}, "customer": {"policy-read-deny": "c_acctbal"}})
    return _columns(spark, c.policy.visible(c.model.overview(), c.context))


@query("odata_metadata", f"SELECT table_name AS entity, column_name AS property, CASE data_type WHEN 'BIGINT' THEN 'Edm.Int64' WHEN 'INTEGER' THEN 'Edm.Int32' WHEN 'DOUBLE' THEN 'Edm.Double' WHEN 'TIMESTAMP' THEN 'Edm.DateTimeOffset' ELSE 'Edm.String' END AS type FROM {DESCRIBED}")
def _(spark, sf_dir):
    document = local.frame(spark, [(odata.metadata(compiler(spark, sf_dir)),)], "xml string")
    entity = F.expr("explode(regexp_extract_all(xml, '(?s)<EntityType .*?</EntityType>', 0))")
    found = document.select(entity.alias("e")).select(F.regexp_extract("e", 'Name="(\\w+)"', 1).alias("entity"), F.explode(F.regexp_extract_all("e", F.lit("<Property [^>]*>"), F.lit(0))).alias("p"))
    found = found.select("entity", F.regexp_extract("p", 'Name="(\\w+)"', 1).alias("property"), F.regexp_extract("p", 'Type="([\\w.]+)"', 1).alias("type"))
    return found.filter(F.expr(f"entity IN {STARS}"))


@query("observed_phases", "SELECT 'parsed' AS phase, 'orders' AS \"table\", CAST(NULL AS BIGINT) AS n UNION ALL SELECT 'transformed', 'orders', NULL UNION ALL SELECT 'executed', 'orders', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf_dir):
    c, seen = compiler(spark, sf_dir), []
    c.policy.observers.append(lambda phase, table, facts: seen.append((phase, table, facts.get("rows"))))
    asked = Query("orders", ["o_orderkey"], filter=Cmp("o_orderstatus", "_eq", "F"), limit=-1)
    rows, watch = c.watched(asked)
    rows.write.format("noop").mode("overwrite").save()
    c.executed(asked, watch, 0.0)
    return local.frame(spark, seen, "phase string, table string, n long")


@query("profile_shows_deleted", "SELECT c_custkey FROM customer")
def _(spark, sf_dir):
    context = Profile("all", frozenset({"soft-delete"})).context(Context())
    c = compiler(spark, sf_dir, context, {"customer": {"soft-delete": "c_mktsegment"}})
    return select(c, "customer", ["c_custkey"])


# Cursors, lists, memberships


def _sought(spark, sf_dir, pages, **ask):
    c, cursor = with_nulls(spark, sf_dir), ""
    for _ in range(pages):
        rows, cursor = listing.seek_rows(c, "customer", ["c_custkey", "c_mktsegment"], b"s", cursor, **ask)
    return rows


@query("cursor_seek", f"SELECT c_custkey, c_mktsegment FROM {NULLS} WHERE c_acctbal > 0 ORDER BY c_mktsegment NULLS FIRST, c_custkey DESC LIMIT 20 OFFSET 40")
def _(spark, sf_dir):
    return _sought(spark, sf_dir, 3, size=20, document={"c_acctbal": {"_gt": 0}}, sort=["c_mktsegment_asc", "c_custkey_desc"])


@query("cursor_seek_descending", f"SELECT c_custkey, c_mktsegment FROM {NULLS} ORDER BY c_nationkey DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 50")
def _(spark, sf_dir):
    return _sought(spark, sf_dir, 2, size=50, sort=["c_nationkey_desc"])


@query("list_get", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def _(spark, sf_dir):
    return listing.get_row(compiler(spark, sf_dir), "orders", [7], ["o_orderkey", "o_totalprice"])


@query("list_stream", "SELECT p_partkey, p_size FROM part WHERE p_size > 5 OR p_type = 'ECONOMY'")
def _(spark, sf_dir):
    wanted = {"or": [{"field": "p_size", "op": "gt", "value": 5}, {"field": "p_type", "op": "eq", "value": "ECONOMY"}]}
    return listing.stream_rows(compiler(spark, sf_dir), {"table": "part", "fields": ["p_partkey", "p_size"], "filter": wanted})


@query("ldap_members", "SELECT DISTINCT 'cn=' || o_orderkey || ',ou=orders' AS dn, 'uid=' || p_partkey || ',ou=parts' AS member FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'P'")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    orders = ldap.Entries("orders", "cn", "o_orderkey", "ou=orders", Cmp("o_orderstatus", "_eq", "P"))
    return ldap.members(c, orders, "part", ldap.Entries("part", "uid", "p_partkey", "ou=parts"))


@query("ldap_member_of", "SELECT DISTINCT 'uid=' || p_partkey || ',ou=parts' AS dn, 'cn=' || o_orderkey || ',ou=orders' AS \"memberOf\" FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 3")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    parts = ldap.Entries("part", "uid", "p_partkey", "ou=parts", Cmp("p_size", "_lt", 3))
    return ldap.member_of(c, parts, ldap.Entries("orders", "cn", "o_orderkey", "ou=orders"), "part")


@query("ldap_members_direct", "SELECT 'cn=' || n_name || ',ou=nations' AS dn, 'uid=' || c_name || ',ou=people' AS member FROM nation JOIN customer ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    nation = ldap.Entries("nation", "cn", "n_name", "ou=nations")
    return ldap.members(compiler(spark, sf_dir), nation, "customer", ldap.Entries("customer", "uid", "c_name", "ou=people"))


@query("metrics_text", "SELECT '# TYPE orders gauge' AS line UNION ALL SELECT 'orders{o_orderstatus=\"' || o_orderstatus || '\"} ' || count(*) FROM orders GROUP BY o_orderstatus")
def _(spark, sf_dir):
    series = aggregate.metric_series(compiler(spark, sf_dir), "orders", ["o_orderstatus"], None, 100)
    lines = listing.exposition("orders", series, ["o_orderstatus"], "_count").splitlines()
    return local.frame(spark, [(x,) for x in lines], "line string")


@query("feed_guids", "SELECT event_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || format('{:02x}', CAST('0x' || substr(d, 17, 2) AS INTEGER) % 64 + 128) || substr(d, 19, 2) || '-' || substr(d, 21, 12) AS guid FROM (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(event_id || '/' || event_type)) AS d FROM events)")
def _(spark, sf_dir):
    name = F.concat_ws("/", F.col("event_id").cast("string"), "event_type")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.uuid5(name).alias("guid"))


@query("displayed_values", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS done, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS moment FROM orders")
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", text.display(F.col("o_orderstatus") == "F", "boolean").alias("done"), text.display(F.col("o_orderdate"), "date").alias("day"), text.display(F.col("o_orderdate"), "timestamp").alias("moment"))


# Writes: stamps, enums, write tools; what reads changes


@query("mutation_stamps", "SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN TIMESTAMP '2024-06-01 12:00:00' END AS changed_at, CASE WHEN s_suppkey = 3 THEN 'me' END AS changed_by, CASE WHEN s_suppkey = 4 THEN TIMESTAMP '2024-06-01 12:00:00' END AS gone_at, CASE WHEN s_suppkey = 4 THEN 'me' END AS gone_by FROM supplier")
def _(spark, sf_dir):
    kinds = {"changed_at": ("timestamp_ntz", "updated-on"), "changed_by": ("string", "updated-by"), "gone_at": ("timestamp_ntz", ""), "gone_by": ("string", "")}
    before = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", *[F.lit(None).cast(k).alias(n) for n, (k, _) in kinds.items()])
    w = _writer_of(spark, "supplier", before, "s_suppkey")
    w.table.metadata.update({"soft-delete": "gone_at", "soft-delete-by": "gone_by"})
    for name, (_, role) in kinds.items():
        w.table.columns[name].metadata["populate"] = role
    return w.batch(before, [Action("update", {"s_suppkey": 3, "s_name": "Renamed"}), Action("delete", {"s_suppkey": 4})]).rows.drop("s_name")


def _writer_of(spark, name, before, key):
    from ..operators.mutate import Writer

    table = Model().add(name, before, (key,))
    return Writer(spark, table, Context({"user_id": "me"}), NOW)


@query("mutation_enum", "SELECT o_orderkey, CASE WHEN o_orderkey = 1 THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "orders")
    w.table.columns["o_orderstatus"].metadata["enum"] = "F=final,O=open,P=pending"
    return w.update(before, {"o_orderkey": 1, "o_orderstatus": "pending"}).rows.select("o_orderkey", "o_orderstatus")


@query("write_tools", "SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'Renamed' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey <> 4 UNION ALL SELECT 900001, 'New'")
def _(spark, sf_dir):
    w, before = writer(spark, sf_dir, "supplier")
    calls = intent.write_tools({"supplier": w})
    rows = calls["insert"](before, "supplier", values={"s_suppkey": 900001, "s_name": "New"}).rows
    rows = calls["update"](rows, "supplier", id="3", set={"s_name": "Renamed"}).rows
    return calls["delete"](rows, "supplier", id=[4]).rows.select("s_suppkey", "s_name")


@query("history_of_entity", "SELECT 'update' AS op, s_name AS was, 'Renamed' AS became FROM supplier WHERE s_suppkey = 3")
def _(spark, sf_dir):
    rows = history.of_entity(history.trail(_changes(spark, sf_dir), "supplier", ["s_suppkey"], "me", NOW), "supplier", {"s_suppkey": 3})
    return rows.select("op", F.get_json_object("before", "$.s_name").alias("was"), F.get_json_object("after", "$.s_name").alias("became"))


@query("cloud_events", "SELECT 'supplier.update' AS type, '{\"s_suppkey\":3}' AS subject, '2024-06-01T12:00:00Z' AS time, '{\"s_suppkey\":3,\"s_name\":\"Renamed\"}' AS data UNION ALL SELECT 'supplier.delete', '{\"s_suppkey\":4}', '2024-06-01T12:00:00Z', '{\"s_suppkey\":4}' UNION ALL SELECT 'supplier.insert', '{\"s_suppkey\":900001}', '2024-06-01T12:00:00Z', '{\"s_suppkey\":900001,\"s_name\":\"New\"}'")
def _(spark, sf_dir):
    events = history.outbox(_changes(spark, sf_dir), "supplier", ["s_suppkey"], NOW, "changed")
    return history.cloud_events(events, "/suppliers").select(*[F.get_json_object("envelope", f"$.{n}").alias(n) for n in ("type", "subject", "time", "data")])


@query("outbox_subscription", "SELECT '{\"s_suppkey\":3}' AS key, CAST(NULL AS VARCHAR) AS s_name UNION ALL SELECT '{\"s_suppkey\":900001}', NULL")
def _(spark, sf_dir):
    events = history.outbox(_changes(spark, sf_dir).filter("op <> 'delete'"), "supplier", ["s_suppkey"], NOW, "changed")
    chosen = history.Subscription(frozenset({"supplier"}), redact=("s_name",)).select(events)
    return chosen.select("key", F.get_json_object("payload", "$.s_name").alias("s_name"))


@query("outbox_delivered", "SELECT event_id, event_id % 3 <> 0 AS sent, CASE WHEN event_id % 3 = 0 THEN 5 ELSE 4 END AS attempts, event_id % 3 = 0 AS dead FROM events")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = rows.select(F.col("event_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("dispatched_at"), F.lit(4).alias("attempts"), F.lit(False).alias("dead"))
    done = history.delivered(events, rows.select(F.col("event_id").alias("id"), (F.col("event_id") % 3 != 0).alias("ok")), NOW)
    return done.select(F.col("id").alias("event_id"), F.col("dispatched_at").isNotNull().alias("sent"), "attempts", "dead")


@query("workflow_run", "SELECT 'orders' AS step, CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS VARCHAR) AS result UNION ALL SELECT 'customers', CAST((SELECT count(*) FROM customer) AS VARCHAR) UNION ALL SELECT 'audit', 'counted ' || (SELECT count(*) FROM customer)")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)

    def count(settings, state):
        part = filters.parse(settings["filter"], c.model, c.model.table(settings["table"])) if settings.get("filter") else None
        return c.total(Query(settings["table"], [], filter=part)).first().total

    groups = [[("count", {"name": "orders", "table": "orders", "filter": {"o_orderstatus": {"_eq": "{{input.status}}"}}})], [("count", {"name": "customers", "table": "customer"})]]
    flow = history.Workflow([("parallel", {"groups": groups}), ("audit", {"message": "counted {{customers}}"})], {"count": count})
    state = flow.run({"status": "F"})
    return local.frame(spark, [("orders", str(state["orders"])), ("customers", str(state["customers"])), ("audit", state["log"][0])], "step string, result string")


@query("retention_after_soft_delete", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
def _(spark, sf_dir):
    rule = history.parse_retention("retain: 30d", "o_orderdate")
    return history.expired(spark.read.parquet(f"{sf_dir}/orders.parquet"), rule, dt.datetime(1996, 1, 31)).select("o_orderkey")
