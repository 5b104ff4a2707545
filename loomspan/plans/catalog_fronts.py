"""Front ends, scalar helpers and composite surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frontends import graphql, intent, kv, ldap, listing, odata, rawsql, sqlsubset, visual
from ..functions import crypto, enums, provider, text
from ..operators import eav
from ..operators.aggregate import Grouped
from . import metadata
from .catalog_core import compiler, select
from .compile import Compiler
from .model import Model, sample_model
from .nodes import UNLIMITED, Cmp, Query
from .policy import Context, Policy
from .registry import query

# GraphQL


@query("graphql_filter_sort_page", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf_dir):
    document = """query Page($least: Float = 100000) {
      orders(filter: {o_orderstatus: {_eq: "F"}, o_totalprice: {_gt: $least}}, sort: [o_totalprice_desc], limit: 10) {
        total data { id: o_orderkey ...price } } }
      fragment price on orders { o_totalprice }"""
    return graphql.execute(compiler(spark, sf_dir), document)["orders"]


@query("graphql_links", "SELECT n_name, r_name, c_custkey FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) ON c_nationkey = n_nationkey WHERE rn <= 2")
def _(spark, sf_dir):
    document = "{ nation(limit: -1) { data { n_name region { r_name } customer(sort: [c_acctbal_desc], limit: 2) { data { c_custkey } } } } }"
    rows = graphql.execute(compiler(spark, sf_dir), document)["nation"]
    return rows.select("n_name", "region.r_name", F.explode("customer.data.c_custkey").alias("c_custkey"))


@query("graphql_relationship_filter", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (1, 2)")
def _(spark, sf_dir):
    document = "query($keys: [Int]) { orders(filter: {customer: {nation: {n_nationkey: {_in: $keys}}}}, limit: -1) { data { o_orderkey } } }"
    return graphql.execute(compiler(spark, sf_dir), document, {"keys": [1, 2]})["orders"]


@query("graphql_aggregate", "SELECT o_orderstatus, count(*) AS _count, max(o_totalprice) AS _max_o_totalprice FROM orders GROUP BY 1")
def _(spark, sf_dir):
    document = "{ ordersAggregate(groupBy: [o_orderstatus]) { o_orderstatus _count _max { o_totalprice } } }"
    return graphql.execute(compiler(spark, sf_dir), document)["ordersAggregate"]


@query("graphql_pivot", "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS \"F\", count(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS \"O\", count(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS \"P\" FROM orders GROUP BY 1")
def _(spark, sf_dir):
    document = '{ ordersPivot(rowKeys: ["o_orderpriority"], pivotColumn: "o_orderstatus", valueColumn: "o_orderkey", aggregate: count) { rows } }'
    return graphql.execute(compiler(spark, sf_dir), document)["ordersPivot"]


@query("graphql_linked_aggregate", "SELECT c_custkey, CAST(n AS DOUBLE) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, sf_dir):
    document = "{ customer(limit: -1) { c_custkey n: _agg(operation: count, value: {orders: {column: o_orderkey}}) } }"
    return graphql.execute(compiler(spark, sf_dir), document)["customer"]


@query("graphql_join", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey > n_nationkey")
def _(spark, sf_dir):
    document = "{ region(limit: -1) { r_regionkey less: _join_nation(on: {r_regionkey: {_gt: n_nationkey}}) { n_nationkey } } }"
    rows = graphql.execute(compiler(spark, sf_dir), document)["region"]
    return rows.select("r_regionkey", F.explode("less.n_nationkey").alias("n_nationkey"))


# SQL subset, raw SQL, OData, LDAP


@query("sqlsubset_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority LIKE '%H%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def _(spark, sf_dir):
    sql = "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = $1 OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority LIKE '%H%' ORDER BY o_totalprice DESC LIMIT 25 OFFSET 5"
    return sqlsubset.execute(compiler(spark, sf_dir), sql, ["F"])


@query("sqlsubset_join", "SELECT o_orderkey, c_name AS \"customer.c_name\" FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000")
def _(spark, sf_dir):
    sql = "SELECT o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE o_totalprice > 150000"
    return sqlsubset.execute(compiler(spark, sf_dir), sql)


RAW = "SELECT c_mktsegment, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC, c_mktsegment) AS INTEGER) AS r FROM customer WHERE c_acctbal > {least} GROUP BY c_mktsegment"


@query("raw_sql", RAW.format(least=0))
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, Context(roles=frozenset({"raw-sql"})))
    return rawsql.execute(c, RAW.replace("AS INTEGER", "AS INT").format(least=":least"), {"least": 0})


@query("raw_sql_set_operations", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, Context(roles=frozenset({"raw-sql"})))
    return rawsql.execute(c, "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")


@query("odata_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus <> 'F' OR o_totalprice >= 50000) AND contains(o_orderpriority, 'H') ORDER BY o_totalprice, o_orderkey LIMIT 40 OFFSET 3")
def _(spark, sf_dir):
    options = {"$filter": "not (o_orderstatus eq 'F' and o_totalprice lt 50000) and contains(o_orderpriority, 'H')", "$select": "o_orderkey,o_totalprice", "$orderby": "o_totalprice", "$top": "40", "$skip": "3"}
    return odata.execute(compiler(spark, sf_dir), "orders", options)


@query("odata_in_null", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IS NOT NULL ORDER BY o_orderkey LIMIT 100")
def _(spark, sf_dir):
    return odata.execute(compiler(spark, sf_dir), "orders", {"$filter": "o_orderpriority in ('1-URGENT','5-LOW') and o_orderstatus ne null", "$select": "o_orderkey"})


@query("odata_expand", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    rows = odata.execute(compiler(spark, sf_dir), "nation", {"$select": "n_nationkey", "$expand": "region"})
    return rows.select("n_nationkey", "region.r_name")


@query("ldap_filter", "SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_name LIKE 'Cust%1') AND NOT (c_acctbal <= 0) AND c_nationkey IS NOT NULL")
def _(spark, sf_dir):
    return ldap.search(compiler(spark, sf_dir), "customer", "(&(|(c_mktsegment=BUILDING)(c_name=Cust*1))(!(c_acctbal<=0))(c_nationkey=*))", ["c_custkey", "c_name"])


@query("ldap_unknown_attribute", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf_dir):
    return ldap.search(compiler(spark, sf_dir), "customer", "(|(nothing=1)(!(nothing=1))(c_mktsegment~= building ))", ["c_custkey"])


# Visual queries, intents, tools


@query("visual_join_filter", "SELECT o.o_orderkey, c.c_name AS customer FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY') AND (o.o_totalprice > 100000 OR o.o_orderpriority = '1-URGENT') ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 100")
def _(spark, sf_dir):
    return visual.execute(
        compiler(spark, sf_dir),
        {
            "tables": [{"table": "orders", "alias": "o"}, {"table": "customer", "alias": "c"}],
            "joins": [{"left": "o", "right": "c", "on": [["o_custkey", "c_custkey"]]}],
            "columns": [
                {"table": "o", "column": "o_orderkey", "sort": "asc", "sortOrder": 2},
                {"table": "c", "column": "c_name", "alias": "customer"},
                {"table": "o", "column": "o_totalprice", "show": False, "sort": "desc", "sortOrder": 1},
            ],
            "filter": {"and": [
                {"table": "c", "column": "c_mktsegment", "op": "_in", "value": ["BUILDING", "MACHINERY"]},
                {"or": [{"table": "o", "column": "o_totalprice", "op": "_gt", "value": 100000}, {"table": "o", "column": "o_orderpriority", "op": "_eq", "value": "1-URGENT"}]},
            ]},
            "limit": 100,
        },
    )


@query("visual_left_join", "SELECT n.n_nationkey, s.s_suppkey FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey ORDER BY 1, 2 NULLS FIRST LIMIT 1000")
def _(spark, sf_dir):
    return visual.execute(
        compiler(spark, sf_dir),
        {
            "tables": [{"table": "nation", "alias": "n"}, {"table": "supplier", "alias": "s"}],
            "joins": [{"left": "n", "right": "s", "on": [["n_nationkey", "s_nationkey"]], "kind": "left"}],
            "columns": [{"table": "n", "column": "n_nationkey", "sort": "asc"}, {"table": "s", "column": "s_suppkey", "sort": "asc"}],
        },
    )


@query("visual_self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey ORDER BY a.n_nationkey, b.n_nationkey LIMIT 1000")
def _(spark, sf_dir):
    hidden = [{"table": t, "column": "n_nationkey", "show": False, "sort": "asc", "sortOrder": k} for k, t in enumerate("ab")]
    return visual.execute(
        compiler(spark, sf_dir),
        {
            "tables": [{"table": "nation", "alias": "a"}, {"table": "nation", "alias": "b"}],
            "joins": [{"left": "a", "right": "b", "on": [["n_regionkey", "n_regionkey"]]}],
            "columns": [{"table": t, "column": "n_name", "alias": t} for t in "ab"] + hidden,
        },
    )


@query("intent_flattened", 'SELECT o_orderkey, c_name AS "customer.c_name" FROM orders LEFT JOIN customer ON o_custkey = c_custkey')
def _(spark, sf_dir):
    q = Query("orders", ["o_orderkey"], links={"customer": Query("customer", ["c_name"])}, limit=UNLIMITED)
    return intent.execute(compiler(spark, sf_dir), q, with_total=True).rows


@query("intent_grouped", "SELECT c_mktsegment, count(*) AS _count FROM customer GROUP BY 1")
def _(spark, sf_dir):
    return intent.execute(compiler(spark, sf_dir), Grouped("customer", ["c_mktsegment"], [], True)).rows


@query("declared_tool", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 120000 ORDER BY o_orderkey LIMIT 20")
def _(spark, sf_dir):
    document = {"name": "large", "table": "orders", "columns": ["o_orderkey"], "filter": {"o_orderpriority": {"_eq": "{{level}}"}, "o_totalprice": {"_gt": "{{least}}"}}, "limit": 20}
    return intent.tools([document], compiler(spark, sf_dir))["large"](level="2-HIGH", least=120000)


@query("row_context", "SELECT c_custkey, n_name, CAST((SELECT count(*) FROM orders WHERE o_custkey = 1) AS INTEGER) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def _(spark, sf_dir):
    rows = listing.row_context(compiler(spark, sf_dir), "customer", [1])
    return rows.select("c_custkey", "nation.n_name", F.col("orders_rows.total").alias("orders"))


# Lists, feeds, metrics, key-value


@query("list_page", "SELECT p_partkey, p_size FROM part WHERE p_size > 5 AND (starts_with(p_type, 'S') OR p_size IN (10, 20)) ORDER BY p_size, p_partkey LIMIT 15 OFFSET 15")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    condition = {"and": [{"field": "p_size", "op": "gt", "value": 5}, {"or": [{"field": "p_type", "op": "starts_with", "value": "S"}, {"field": "p_size", "op": "in", "value": [10, 20]}]}]}
    request = {"table": "part", "fields": ["p_partkey", "p_size"], "filter": condition, "sort": ["p_size_asc"], "page_size": 15}
    _, following = listing.list_rows(c, request, b"secret")
    return listing.list_rows(c, request, b"secret", following)[0]


@query("feed_since", "SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 20")
def _(spark, sf_dir):
    return listing.feed(compiler(spark, sf_dir), "events", "ts", ["event_id", "ts", "event_type"], "2024-01-10 00:00:00")


@query("feed_items", "SELECT 'Event ' || event_type AS title, 'https://x/e/' || event_id AS link FROM events ORDER BY ts DESC, event_id LIMIT 20")
def _(spark, sf_dir):
    rows = listing.feed(compiler(spark, sf_dir), "events", "ts", ["event_id", "ts", "event_type"])
    return listing.feed_items(rows, "Event {event_type}", "https://x/e/{event_id}", ["event_id"], "ts").select("title", "link")


@query("object_listing", "SELECT name, is_prefix, n FROM (SELECT substr(c_name, 1, instr(c_name, '#')) AS name, TRUE AS is_prefix, count(*) AS n FROM customer WHERE contains(c_name, '#') GROUP BY 1 UNION ALL SELECT c_name, FALSE, count(*) FROM customer WHERE NOT contains(c_name, '#') GROUP BY 1) ORDER BY name LIMIT 1001")
def _(spark, sf_dir):
    return listing.object_listing(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_name", delimiter="#")


@query("object_listing_flat", "SELECT c_name AS name, FALSE AS is_prefix, count(*) AS n FROM customer WHERE starts_with(c_name, 'Customer') AND c_name > 'Customer#000000020' GROUP BY 1 ORDER BY 1 LIMIT 51")
def _(spark, sf_dir):
    return listing.object_listing(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_name", "Customer", "", "Customer#000000020", 50)


@query("kv_exists", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (1, 2, 99999999)")
def _(spark, sf_dir):
    return kv.KeyValue(compiler(spark, sf_dir), spark).exists(["customer:1", "customer:2", "customer:99999999"])


@query("kv_hgetall", "SELECT * FROM (SELECT 'c_custkey' AS field, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'c_name', c_name FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer WHERE c_custkey = 5)")
def _(spark, sf_dir):
    return kv.KeyValue(compiler(spark, sf_dir), spark).hgetall("customer:5")


@query("kv_scan", "SELECT 'orders:' || o_orderkey AS key FROM orders WHERE o_orderkey > 10 ORDER BY o_orderkey LIMIT 11")
def _(spark, sf_dir):
    return kv.KeyValue(compiler(spark, sf_dir), spark).scan("orders", 10, [10])


# Introspection and metadata


@query("introspection", "SELECT 'orders' AS \"table\", 'o_orderkey' AS name, 'BigInt' AS scalar, TRUE AS is_key UNION ALL VALUES ('orders', 'o_custkey', 'BigInt', FALSE), ('orders', 'o_orderstatus', 'String', FALSE), ('orders', 'o_totalprice', 'Float', FALSE), ('orders', 'o_orderdate', 'DateTime', FALSE), ('orders', 'o_orderpriority', 'String', FALSE)")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    rows = [(t["table"], x["name"], x["scalar"], x["is_key"]) for t in c.policy.visible(c.model.overview(), c.context) for x in t["columns"] if t["table"] == "orders"]
    return spark.createDataFrame(rows, "table string, name string, scalar string, is_key boolean")


@query("metadata_rules", "SELECT o_orderkey FROM orders WHERE o_custkey = 11")
def _(spark, sf_dir):
    model = sample_model(spark, sf_dir)
    model.apply(metadata.parse(":root { title: shop } orders | has(o_cust*) { tenant-filter: o_custkey; note: `a; b` } *.orders.o_total* { visibility: hidden }"))
    c = Compiler(model, context=Context({"tenant_id": 11}))
    return select(c, "orders", ["o_orderkey"])


@query("inferred_links", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    model = Model()
    model.add("region", spark.read.parquet(f"{sf_dir}/region.parquet").withColumnRenamed("r_regionkey", "id"), ("id",))
    model.add("nation", spark.read.parquet(f"{sf_dir}/nation.parquet").withColumnRenamed("n_regionkey", "region_id"), ("n_nationkey",))
    model.infer_links()
    rows = Compiler(model).nested(Query("nation", ["n_name"], links={"region": Query("region", ["r_name"])}, limit=UNLIMITED))
    return rows.select("n_name", "region.r_name")


# Enums, attributes, encryption, ids


STATUS = {"F": "final", "O": "open"}


@query("enum_read", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status FROM orders")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", enums.named(F.col("o_orderstatus"), STATUS).alias("status"))


@query("enum_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    part = enums.stored(Cmp("o_orderstatus", "_eq", "final"), "o_orderstatus", STATUS)
    return compiler(spark, sf_dir).flat(Query("orders", ["o_orderkey"], filter=part, limit=UNLIMITED))


@query("available_transitions", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS n FROM orders")
def _(spark, sf_dir):
    states = enums.transitions(F.col("o_orderstatus"), {"o": ["P", "F"], "p": ["F"], "f": []})
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.size(states).alias("n"))


@query("eav_map", "SELECT n_nationkey, coalesce(m, '{}') AS _meta FROM nation LEFT JOIN (SELECT c_nationkey, '{' || string_agg('\"' || c_mktsegment || '\":\"' || k || '\"', ',' ORDER BY c_mktsegment) || '}' AS m FROM (SELECT c_nationkey, c_mktsegment, max(c_custkey) AS k FROM customer GROUP BY ALL) GROUP BY 1) ON n_nationkey = c_nationkey")
def _(spark, sf_dir):
    meta = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = eav.attribute_map(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey", meta, "c_nationkey", "c_mktsegment", "c_custkey", "c_custkey")
    return rows.select("n_nationkey", "_meta")


KEYS = {1: b"0123456789abcdef0123456789abcdef"}


@query("encrypt_round_trip", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf_dir):
    where = crypto.place("", "customer", "c_name")
    sealed = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", crypto.encrypt(F.col("c_name"), KEYS[1], 1, where).alias("sealed"))
    return sealed.select("c_custkey", crypto.decrypt(F.col("sealed"), KEYS, where).alias("c_name"))


@query("blind_index_equality", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", crypto.blind_index(F.col("c_mktsegment"), KEYS[1]).alias("token"))
    return rows.filter(F.col("token") == crypto.blind_token("BUILDING", KEYS[1])).select("c_custkey")


@query("uuid5_stable", None)
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name", text.uuid5(F.col("r_name")).alias("guid"))


@query("php_deserialize", "SELECT n_nationkey, '{\"name\": \"' || n_name || '\"}' AS v FROM nation")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    stored = F.concat(F.lit('a:1:{s:4:"name";s:'), F.octet_length("n_name").cast("string"), F.lit(':"'), F.col("n_name"), F.lit('";}'))
    return rows.select("n_nationkey", text.php_to_json(stored).alias("v"))


@query("template_expansion", "SELECT p_partkey, p_name || ' at ' || CAST(p_size AS VARCHAR) AS v FROM part")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.template("{p_name} at {p_size}").alias("v"))


@query("encrypted_column_policy", "SELECT c_custkey, c_name FROM customer WHERE c_name IN ('Customer#000000003', 'Customer#000000005') OR c_custkey = -1")
def _(spark, sf_dir):
    """Stored encrypted; filtered through the blind index; opened for a role that may see it."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sealed = rows.select("c_custkey", crypto.encrypt(F.col("c_name"), KEYS[1], 1, crypto.place("", "customer", "c_name")).alias("c_name"), crypto.blind_index(F.col("c_name"), KEYS[1]).alias("token"))
    model = Model()
    model.add("customer", sealed, ("c_custkey",)).columns["c_name"].metadata.update({"encrypt": "k", "blind-index": "token", "mask": "redact", "unmask-role": "auditor"})
    c = Compiler(model, Policy(keys=KEYS), Context(roles=frozenset({"auditor"})))
    return select(c, "customer", ["c_custkey", "c_name"], {"c_name": {"_in": ["Customer#000000003", "Customer#000000005"]}})


@query("reencrypt", "SELECT c_custkey, c_name, TRUE AS moved FROM customer")
def _(spark, sf_dir):
    where, keys = crypto.place("", "customer", "c_name"), KEYS | {2: b"f" * 32}
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", crypto.encrypt(F.col("c_name"), KEYS[1], 1, where).alias("e"))
    new = old.select("c_custkey", crypto.reencrypt(F.col("e"), keys, 2, where).alias("e"))
    return new.select("c_custkey", crypto.decrypt(F.col("e"), keys, where).alias("c_name"), crypto.decrypt(F.col("e"), KEYS, where).isNull().alias("moved"))


@query("provider_column", "SELECT p_partkey, p_size * p_retailprice AS v FROM part")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", provider.provided(lambda a, b: a * b, [F.col("p_size"), F.col("p_retailprice")], "double").alias("v"))


@query("kv_hset", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'X' ELSE r_name END AS r_name FROM region UNION ALL SELECT 77, 'Y'")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    store = kv.KeyValue(c, spark)
    c.model.replace("region", store.hset("region:1", r_name="X").rows)
    return store.set("region:77", '{"r_name": "Y"}').rows


@query("kv_delete", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2")
def _(spark, sf_dir):
    return kv.KeyValue(compiler(spark, sf_dir), spark).delete("region:2").rows


@query("candidate_joins", "SELECT 'l_orderkey' AS a, 'o_orderkey' AS b")
def _(spark, sf_dir):
    pairs = compiler(spark, sf_dir).model.candidate_joins("lineitem", "orders")
    return spark.createDataFrame([p for on in pairs for p in on], "a string, b string")


@query("cursor_page", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 0 ORDER BY n_name, n_nationkey LIMIT 5 OFFSET 5")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    ask = {"document": {"n_regionkey": {"_gt": 0}}, "sort": ["n_name_asc"], "size": 5}
    _, following = listing.cursor_rows(c, "nation", ["n_nationkey", "n_name"], b"s", **ask)
    return listing.cursor_rows(c, "nation", ["n_nationkey", "n_name"], b"s", following, **ask)[0]
