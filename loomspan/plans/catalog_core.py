"""Scans, filters, order, links, joins, aggregates, pivots, expressions and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import aggregate, filters, keys, search
from .compile import Compiler
from .model import Model, sample_model
from .nodes import UNLIMITED, Aggregate, Cmp, Join, Query, Ref, both
from .policy import Context
from .registry import query

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def compiler(spark: SparkSession, sf_dir: str, context: Context | None = None, rules: dict[str, dict[str, str]] | None = None) -> Compiler:
    model = sample_model(spark, sf_dir)
    for table, values in (rules or {}).items():
        target = model.table(table.split(".")[0])
        (target.column(table.split(".")[1]).metadata if "." in table else target.metadata).update(values)
    return Compiler(model, context=context or Context())


def select(c: Compiler, table: str, columns: list[str] | None = None, document: dict | None = None, **more) -> DataFrame:
    """A flat query; without a limit, all rows."""
    part = filters.parse(document, c.model, c.model.table(table)) if document is not None else None
    return c.flat(Query(table, columns or [], filter=part, **({"limit": UNLIMITED} | more)))


# Scans and filters


@query("scan_select", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "orders", ["o_orderkey", "o_totalprice"])


@query("scan_alias", 'SELECT o_orderkey AS id, o_totalprice AS price FROM orders')
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "orders", ["o_orderkey", "o_totalprice"], aliases={"o_orderkey": "id", "o_totalprice": "price"})


@query("slice0_filter_sort_page", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"], {"o_orderstatus": {"_eq": "F"}, "o_totalprice": {"_gt": 100000}}, sort=["o_totalprice_desc"], limit=10)


#: name: (table, columns, filter document, SQL condition)
FILTERS = {
    "eq": ("orders", ["o_orderkey", "o_orderstatus"], {"o_orderstatus": {"_eq": "F"}}, "o_orderstatus = 'F'"),
    "neq": ("orders", ["o_orderkey", "o_orderstatus"], {"o_orderstatus": {"_neq": "F"}}, "o_orderstatus <> 'F'"),
    "lt": ("orders", ["o_orderkey", "o_totalprice"], {"o_totalprice": {"_lt": 50000}}, "o_totalprice < 50000"),
    "lte": ("part", ["p_partkey", "p_size"], {"p_size": {"_lte": 10}}, "p_size <= 10"),
    "gt": ("customer", ["c_custkey", "c_acctbal"], {"c_acctbal": {"_gt": 5000.5}}, "c_acctbal > 5000.5"),
    "gte": ("orders", ["o_orderkey", "o_orderdate"], {"o_orderdate": {"_gte": "1996-01-01 00:00:00"}}, "o_orderdate >= TIMESTAMP '1996-01-01'"),
    "in": ("orders", ["o_orderkey", "o_orderpriority"], {"o_orderpriority": {"_in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "in_empty": ("orders", ["o_orderkey"], {"o_orderpriority": {"_in": []}}, "FALSE"),
    "nin": ("orders", ["o_orderkey", "o_orderpriority"], {"o_orderpriority": {"_nin": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "nin_empty": ("orders", ["o_orderkey"], {"o_orderpriority": {"_nin": []}}, "TRUE"),
    "between": ("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], {"l_quantity": {"_between": [10, 20]}}, "l_quantity BETWEEN 10 AND 20"),
    "nbetween": ("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], {"l_quantity": {"_nbetween": [5, 45]}}, "l_quantity NOT BETWEEN 5 AND 45"),
    "contains": ("customer", ["c_custkey", "c_name"], {"c_name": {"_contains": "01"}}, "contains(c_name, '01')"),
    "ncontains": ("customer", ["c_custkey", "c_name"], {"c_name": {"_ncontains": "01"}}, "NOT contains(c_name, '01')"),
    "contains_escaped": ("documents", ["doc_id"], {"text": {"_contains": "%_"}}, "contains(text, '%_')"),
    "starts_with": ("part", ["p_partkey", "p_type"], {"p_type": {"_starts_with": "S"}}, "starts_with(p_type, 'S')"),
    "nstarts_with": ("part", ["p_partkey", "p_type"], {"p_type": {"_nstarts_with": "S"}}, "NOT starts_with(p_type, 'S')"),
    "ends_with": ("orders", ["o_orderkey", "o_orderpriority"], {"o_orderpriority": {"_ends_with": "H"}}, "ends_with(o_orderpriority, 'H')"),
    "nends_with": ("orders", ["o_orderkey", "o_orderpriority"], {"o_orderpriority": {"_nends_with": "H"}}, "NOT ends_with(o_orderpriority, 'H')"),
    "like": ("customer", ["c_custkey", "c_name"], {"c_name": {"_like": "%0_1%"}}, "c_name LIKE '%0_1%'"),
    "nlike": ("customer", ["c_custkey", "c_name"], {"c_name": {"_nlike": "%0_1%"}}, "c_name NOT LIKE '%0_1%'"),
    "null": ("events", ["event_id"], {"props": {"_null": True}}, "props IS NULL"),
    "null_false": ("events", ["event_id"], {"props": {"_null": False}}, "props IS NOT NULL"),
    "eq_null": ("orders", ["o_orderkey"], {"o_orderstatus": {"_eq": None}}, "o_orderstatus IS NULL"),
    "neq_null": ("orders", ["o_orderkey"], {"o_orderstatus": {"_neq": None}}, "o_orderstatus IS NOT NULL"),
    "and_or_tree": (
        "orders",
        ["o_orderkey", "o_orderstatus", "o_totalprice"],
        {"or": [{"and": [{"o_orderstatus": {"_eq": "F"}}, {"o_totalprice": {"_gt": 200000}}]}, {"o_orderpriority": {"_eq": "5-LOW"}, "o_totalprice": {"_lt": 20000}}]},
        "(o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderpriority = '5-LOW' AND o_totalprice < 20000)",
    ),
}


def _filter_query(table, columns, document):
    return lambda spark, sf_dir: select(compiler(spark, sf_dir), table, columns, document)


for _name, (_table, _columns, _document, _sql) in FILTERS.items():
    query(f"filter_{_name}", f"SELECT {', '.join(_columns)} FROM {_table} WHERE {_sql}")(_filter_query(_table, _columns, _document))


@query("filter_column_to_column", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")
def _(spark, sf_dir):
    return compiler(spark, sf_dir).flat(Query("lineitem", ["l_orderkey", "l_linenumber"], filter=Cmp("l_partkey", "_lt", Ref("l_suppkey")), limit=UNLIMITED))


@query("filter_builder", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT') AND (o_orderstatus = 'F' OR o_orderstatus = 'O')")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    t = c.model.table("orders")
    b = filters.FilterBuilder
    part = b(t).gt("o_totalprice", 100000).in_("o_orderpriority", ["1-URGENT"]).any(b(t).eq("o_orderstatus", "F"), b(t).eq("o_orderstatus", "O")).build()
    return c.flat(Query("orders", ["o_orderkey"], filter=part, limit=UNLIMITED))


@query("filter_primary_key", f"SELECT {ORDERS} FROM orders WHERE o_orderkey = 7")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    return c.flat(Query("orders", filter=filters.primary_key(c.model.table("orders"), [7])))


@query("filter_relationship", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "orders", ["o_orderkey"], {"customer": {"c_mktsegment": {"_eq": "BUILDING"}}})


@query("filter_relationship_two_hop", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "orders", ["o_orderkey"], {"customer": {"nation": {"region": {"r_name": {"_eq": "ASIA"}}}}})


@query("filter_relationship_multi_pred", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "orders", ["o_orderkey", "o_totalprice"], {"o_totalprice": {"_gt": 50000}, "customer": {"c_mktsegment": {"_eq": "BUILDING"}, "c_acctbal": {"_gt": 0}}})


@query("fts_terms", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])', 'i') AND regexp_matches(text, '(^|[^\p{L}\p{N}_])of($|[^\p{L}\p{N}_])', 'i')")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "documents", ["doc_id"], {"_search": "THE of"})


@query("fts_phrase", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{N}_])of[^\p{L}\p{N}_]+the($|[^\p{L}\p{N}_])', 'i')")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "documents", ["doc_id"], {"_search": '"of the'})


# Order and pages


@query("sort_paged", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "customer", ["c_custkey", "c_name", "c_acctbal"], sort=["c_acctbal_desc"], limit=20, offset=10)


@query("sort_tiebreak", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority NULLS FIRST, o_orderkey LIMIT 50")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "orders", ["o_orderkey", "o_orderpriority"], sort=["o_orderpriority_asc"], limit=50)


@query("sort_tiebreak_keyless", "SELECT * FROM lineitem ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 40")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "lineitem", sort=["l_quantity_desc"], limit=40)


@query("page_default_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "orders", ["o_orderkey"], limit=None)


@query("page_no_limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 5")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir), "customer", ["c_custkey"], offset=5)


@query("page_total", "SELECT CAST(count(*) AS INTEGER) AS total FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    return c.total(Query("orders", filter=Cmp("o_orderstatus", "_eq", "F")))


@query("keyset_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 26")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    return keys.keyset_page(c, c.model.table("orders"), 25, [100], ["o_orderkey", "o_custkey"])


@query("keyset_scan_composite", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 50 OR (l_orderkey = 50 AND l_linenumber > 2) ORDER BY l_orderkey, l_linenumber LIMIT 21")
def _(spark, sf_dir):
    model = Model()
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    table = model.add("lines", pairs, ("l_orderkey", "l_linenumber"))
    return keys.keyset_page(Compiler(model), table, 20, [50, 2])


@query("multi_get", "SELECT k.ordinal, c_name, c_acctbal FROM (VALUES (0, 3), (1, 999999999), (2, 1), (3, 3)) AS k(ordinal, id) LEFT JOIN customer ON c_custkey = k.id")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    return keys.multi_get(c, spark, c.model.table("customer"), [(3,), (999999999,), (1,), (3,)], ["c_name", "c_acctbal"])


@query("generic_table", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_name LIKE '%a%' ORDER BY p_partkey LIMIT 30 OFFSET 2")
def _(spark, sf_dir):
    return generic_table(compiler(spark, sf_dir), "part", {"p_size": {"_gte": 10}, "p_name": {"_like": "%a%"}}, 30, 2)


def generic_table(c: Compiler, name: str, document: dict, limit: int, offset: int, most: int = 1000) -> DataFrame:
    """Any table by name with a flat AND of simple comparisons; limits are clamped, not refused."""
    allowed = {"_eq", "_neq", "_gt", "_gte", "_lt", "_lte", "_like"}
    for column, ops in document.items():
        if column in ("and", "or") or not set(ops) <= allowed:
            raise filters.FilterError(f"{column}: only {', '.join(sorted(allowed))}")
    limit = most if limit <= 0 or limit > most else limit
    return select(c, name, document=document or None, limit=limit, offset=max(0, offset))


# Links


@query("link_single", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    rows = c.nested(Query("orders", ["o_orderkey"], links={"customer": Query("customer", ["c_name", "c_mktsegment"])}, limit=UNLIMITED))
    return rows.select("o_orderkey", "customer.c_name", "customer.c_mktsegment")


@query("link_single_filtered_parent", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    inner = Query("customer", ["c_name"], filter=Cmp("c_mktsegment", "_eq", "BUILDING"))
    return c.nested(Query("orders", ["o_orderkey"], links={"customer": inner}, limit=UNLIMITED)).select("o_orderkey", "customer.c_name")


CHILD_PAGE = """
SELECT o_custkey AS parent_c_custkey, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS rn, CAST(total AS INTEGER) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS total
  FROM orders) WHERE rn > {offset} AND rn <= {end}"""


@query("link_multi_paged_total", CHILD_PAGE.format(offset=0, end=3))
def _(spark, sf_dir):
    return compiler(spark, sf_dir).flat_children(Query("customer", limit=UNLIMITED), "orders", Query("orders", ["o_orderkey", "o_totalprice"], sort=["o_totalprice_desc"], limit=3))


@query("link_multi_offset", CHILD_PAGE.format(offset=2, end=4))
def _(spark, sf_dir):
    return compiler(spark, sf_dir).flat_children(Query("customer", limit=UNLIMITED), "orders", Query("orders", ["o_orderkey", "o_totalprice"], sort=["o_totalprice_desc"], limit=2, offset=2))


@query("link_multi", "SELECT c_custkey, o_orderkey, CAST(count(*) OVER (PARTITION BY c_custkey) AS INTEGER) AS total FROM customer JOIN orders ON c_custkey = o_custkey")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    rows = c.nested(Query("customer", ["c_custkey"], links={"orders": Query("orders", ["o_orderkey"], limit=UNLIMITED)}, limit=UNLIMITED))
    return rows.select("c_custkey", F.explode("orders.data.o_orderkey").alias("o_orderkey"), "orders.total")


@query("link_multi_of_page", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) JOIN orders ON c_custkey = o_custkey")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    rows = c.nested(Query("customer", ["c_custkey"], sort=["c_acctbal_desc"], limit=10, links={"orders": Query("orders", ["o_orderkey"], limit=UNLIMITED)}))
    return rows.select("c_custkey", F.explode("orders.data.o_orderkey").alias("o_orderkey"))


@query("link_multi_no_rows_total_0", "SELECT c_custkey, CAST(0 AS INTEGER) AS total, CAST(0 AS INTEGER) AS n FROM customer")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    rows = c.nested(Query("customer", ["c_custkey"], links={"orders": Query("orders", ["o_orderkey"], offset=100000)}, limit=UNLIMITED))
    return rows.select("c_custkey", "orders.total", F.size("orders.data").alias("n"))


@query(
    "link_nested_three_level",
    "SELECT r_name, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) ON c_nationkey = n_nationkey WHERE rn <= 5",
)
def _(spark, sf_dir):
    customers = Query("customer", ["c_custkey"], sort=["c_acctbal_desc"], limit=5)
    nations = Query("nation", ["n_name"], links={"customer": customers}, limit=UNLIMITED)
    rows = compiler(spark, sf_dir).nested(Query("region", ["r_name"], links={"nation": nations}, limit=UNLIMITED))
    rows = rows.select("r_name", F.explode("nation.data").alias("n")).select("r_name", "n.n_name", F.explode("n.customer.data").alias("c"))
    return rows.select("r_name", "n_name", "c.c_custkey")


@query("link_m2m", "SELECT l_orderkey AS parent_o_orderkey, p_partkey, CAST(rn AS INTEGER) AS rn, CAST(total AS INTEGER) AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) WHERE rn <= 3")
def _(spark, sf_dir):
    inner = Query("part", ["p_partkey"], sort=["p_retailprice_desc"], limit=3)
    return compiler(spark, sf_dir).flat_children(Query("orders", limit=UNLIMITED), "part", inner)


@query("link_composite", "SELECT s.l_orderkey, s.l_linenumber, s.n AS n FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) s JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40) h ON s.l_orderkey = h.l_orderkey AND s.l_linenumber = h.l_linenumber")
def _(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    model = Model()
    model.add("sums", lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")), ("l_orderkey", "l_linenumber"))
    model.add("heavy", lines.filter("l_quantity > 40").select(F.col("l_orderkey").alias("h_order"), F.col("l_linenumber").alias("h_line")).distinct(), ("h_order", "h_line"))
    model.link("heavy", ("h_order", "h_line"), "sums", ("l_orderkey", "l_linenumber"))
    rows = Compiler(model).nested(Query("heavy", ["h_order"], links={"sums": Query("sums", ["l_orderkey", "l_linenumber", "n"])}, limit=UNLIMITED))
    return rows.select("sums.*")


@query("link_polymorphic", "SELECT c_custkey AS owner, 'customer' AS kind, count(*) AS notes FROM customer JOIN events ON user_id = c_custkey AND event_type = 'click' GROUP BY c_custkey")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    c.model.polymorphic("events", "event_type", "user_id", {"click": "customer"})
    rows = c.nested(Query("customer", ["c_custkey"], links={"events": Query("events", ["event_id"], limit=UNLIMITED)}, limit=UNLIMITED))
    rows = rows.filter("events.total > 0")
    return rows.select(F.col("c_custkey").alias("owner"), F.lit("customer").alias("kind"), F.col("events.total").cast("long").alias("notes"))


# Explicit joins


@query("join_dynamic_eq", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def _(spark, sf_dir):
    join = Join("suppliers", Query("supplier", ["s_suppkey"]), "c_nationkey", "s_nationkey")
    return compiler(spark, sf_dir).flat_join(Query("customer", ["c_custkey"], joins=[join], limit=UNLIMITED))


@query("join_dynamic_lt", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_regionkey")
def _(spark, sf_dir):
    join = Join("nations", Query("nation", ["n_nationkey"]), "r_regionkey", "n_regionkey", "_lt")
    rows = compiler(spark, sf_dir).nested(Query("region", ["r_regionkey"], joins=[join], limit=UNLIMITED))
    return rows.select("r_regionkey", F.explode("nations.n_nationkey").alias("n_nationkey"))


@query("join_single", "SELECT n_nationkey, first_customer FROM nation LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS first_customer FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    join = Join("one", Query("customer", ["c_custkey"], sort=["c_custkey_asc"]), "n_nationkey", "c_nationkey", single=True)
    rows = compiler(spark, sf_dir).nested(Query("nation", ["n_nationkey"], joins=[join], limit=UNLIMITED))
    return rows.select("n_nationkey", F.col("one.c_custkey").alias("first_customer"))


@query("join_flat_limit_is_global", "SELECT __left AS nation, c_custkey FROM (SELECT n_nationkey AS __left FROM nation) JOIN customer ON __left = c_nationkey ORDER BY __left, c_custkey LIMIT 15")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    table = c.model.table("nation")
    pairs = c.theta(c.page_rows(Query("nation", limit=UNLIMITED)), table, Join("x", Query("customer", ["c_custkey"], limit=15), "n_nationkey", "c_nationkey"))
    return pairs.select(F.col("__left").alias("nation"), "c_custkey")


CROSS = "SELECT o_orderkey, c_name FROM orders {how} JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR) AND c_acctbal > 5000"


@query("join_cross_db_inner", CROSS.format(how=""))
def _(spark, sf_dir):
    return _cross(spark, sf_dir, "inner")


@query("join_cross_db_left", CROSS.format(how="LEFT"))
def _(spark, sf_dir):
    return _cross(spark, sf_dir, "left")


def _cross(spark, sf_dir, how):
    left = spark.read.parquet(f"{sf_dir}/orders.parquet")
    right = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal > 5000")
    return keys.cross_source_join(left, right, "o_custkey", "c_custkey", how).select("o_orderkey", "c_name")


@query("expand_capped", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey = 1")
    return keys.expanded(nations, spark.read.parquet(f"{sf_dir}/customer.parquet"), "n_nationkey", "c_nationkey", 1_000_000).select("c_custkey", "c_nationkey")


@query("group_members", "SELECT n_regionkey AS \"group\", len(list(DISTINCT n_nationkey)) AS n, min(n_nationkey) AS first FROM nation GROUP BY 1")
def _(spark, sf_dir):
    members = keys.group_members(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey", "n_regionkey")
    return members.select("group", F.size("members").cast("long").alias("n"), F.col("members")[0].alias("first"))


# Aggregates


@query("agg_grouped", "SELECT o_orderstatus, o_orderpriority, count(*) AS _count, round(sum(o_totalprice), 2) AS _sum_o_totalprice, round(avg(o_totalprice), 4) AS _avg_o_totalprice, min(o_totalprice) AS _min_o_totalprice, max(o_totalprice) AS _max_o_totalprice FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    q = aggregate.Grouped("orders", ["o_orderstatus", "o_orderpriority"], [(op, "o_totalprice") for op in ("sum", "avg", "min", "max")], True)
    rows = aggregate.grouped(compiler(spark, sf_dir), q)
    return rows.withColumns({"_sum_o_totalprice": F.round("_sum_o_totalprice", 2), "_avg_o_totalprice": F.round("_avg_o_totalprice", 4)})


@query("agg_global", "SELECT count(*) AS _count, CAST(sum(l_linenumber) AS DOUBLE) AS _sum_l_linenumber, max(l_quantity) AS _max_l_quantity FROM lineitem")
def _(spark, sf_dir):
    return aggregate.grouped(compiler(spark, sf_dir), aggregate.Grouped("lineitem", [], [("sum", "l_linenumber"), ("max", "l_quantity")], True))


@query("agg_keys_only", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, sf_dir):
    return aggregate.grouped(compiler(spark, sf_dir), aggregate.Grouped("lineitem", ["l_returnflag", "l_linestatus"]))


@query("agg_filtered", "SELECT l_returnflag, count(*) AS _count FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def _(spark, sf_dir):
    return aggregate.grouped(compiler(spark, sf_dir), aggregate.Grouped("lineitem", ["l_returnflag"], [], True, Cmp("l_quantity", "_gt", 25)))


@query("agg_null_group", "SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS _count FROM orders GROUP BY 1")
def _(spark, sf_dir):
    model = Model()
    model.add("t", spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s")))
    return aggregate.grouped(Compiler(model), aggregate.Grouped("t", ["s"], [], True))


@query("agg_pages_of_groups", "SELECT o_custkey, count(*) AS _count FROM orders GROUP BY 1 ORDER BY o_custkey LIMIT 100")
def _(spark, sf_dir):
    groups = aggregate.grouped(compiler(spark, sf_dir), aggregate.Grouped("orders", ["o_custkey"], [], True))
    return aggregate.page_of_groups(groups, [F.col("o_custkey")])[0]


@query("metric_series", "SELECT o_orderstatus, count(*) AS _count, round(sum(o_totalprice), 2) AS _sum_o_totalprice FROM orders GROUP BY 1")
def _(spark, sf_dir):
    rows = aggregate.metric_series(compiler(spark, sf_dir), "orders", ["o_orderstatus"], "o_totalprice", 50)
    return rows.withColumn("_sum_o_totalprice", F.round("_sum_o_totalprice", 2))


def _linked(operation):
    def run(spark, sf_dir):
        total = Aggregate("v", operation, ("orders",), "o_totalprice")
        rows = compiler(spark, sf_dir).flat(Query("customer", ["c_custkey"], aggregates=[total], limit=UNLIMITED))
        return rows.withColumn("v", F.round("v", 6))

    return run


for _op in ("sum", "avg", "min", "max", "count"):
    query(f"agg_link_{_op}", f"SELECT c_custkey, round(CAST(v AS DOUBLE), 6) AS v FROM customer LEFT JOIN (SELECT o_custkey, {_op}(o_totalprice) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey")(_linked(_op))


@query("agg_link_two_hops", "SELECT n_nationkey, CAST(v AS DOUBLE) AS v FROM nation LEFT JOIN (SELECT c_nationkey, count(o_totalprice) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    q = Query("nation", ["n_nationkey"], aggregates=[Aggregate("v", "count", ("customer", "orders"), "o_totalprice")], limit=UNLIMITED)
    return compiler(spark, sf_dir).flat(q)


@query("agg_link_last_filter", "SELECT c_custkey, CAST(v AS DOUBLE) AS v FROM customer LEFT JOIN (SELECT o_custkey, count(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, sf_dir):
    q = Query("customer", ["c_custkey"], aggregates=[Aggregate("v", "count", ("orders",), "o_totalprice", Cmp("o_orderstatus", "_eq", "F"))], limit=UNLIMITED)
    return compiler(spark, sf_dir).flat(q)


@query("agg_link_many_to_one_quirk", "SELECT o_orderkey, v FROM orders LEFT JOIN (SELECT a.o_custkey AS k, round(sum(c_acctbal), 2) AS v FROM orders a JOIN customer ON a.o_custkey = c_custkey GROUP BY 1) ON k = o_custkey")
def _(spark, sf_dir):
    q = Query("orders", ["o_orderkey"], aggregates=[Aggregate("v", "sum", ("customer",), "c_acctbal")], limit=UNLIMITED)
    return compiler(spark, sf_dir).flat(q).withColumn("v", F.round("v", 2))


PIVOT_LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _pivot(op):
    def run(spark, sf_dir):
        table = aggregate.pivot(compiler(spark, sf_dir), aggregate.Pivot("orders", ["o_orderstatus"], "o_orderpriority", "o_totalprice", op))
        return table if op == "count" else table.select("o_orderstatus", *[F.round(f"`{c}`", 2).alias(c) for c in table.columns[1:]])

    return run


for _op in ("count", "sum", "avg", "min", "max"):
    _cells = ", ".join(("{op}(CASE WHEN o_orderpriority = '{v}' THEN o_totalprice END)" if _op == "count" else "round({op}(CASE WHEN o_orderpriority = '{v}' THEN o_totalprice END), 2)").format(op=_op, v=v) + f' AS "{v}"' for v in PIVOT_LABELS)
    query(f"pivot_{_op}", f"SELECT o_orderstatus, {_cells} FROM orders GROUP BY 1")(_pivot(_op))


@query("pivot_null_label", "SELECT o_orderpriority, count(CASE WHEN s IS NULL THEN o_orderkey END) AS _null_, count(CASE WHEN s = 'O' THEN o_orderkey END) AS \"O\", count(CASE WHEN s = 'P' THEN o_orderkey END) AS \"P\" FROM (SELECT *, nullif(o_orderstatus, 'F') AS s FROM orders) GROUP BY 1")
def _(spark, sf_dir):
    model = Model()
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("F")))
    model.add("t", rows.select("o_orderkey", "o_orderpriority", "s"), ("o_orderkey",))
    return aggregate.pivot(Compiler(model), aggregate.Pivot("t", ["o_orderpriority"], "s", "o_orderkey", "count"))


@query("pivot_cells", "SELECT l_returnflag, CAST(count(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS BIGINT) AS f, CAST(count(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS BIGINT) AS o FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    q = aggregate.Pivot("lineitem", ["l_returnflag"], "l_linestatus", "l_quantity", "count")
    labels = aggregate.pivot_labels(c, q)
    cells = aggregate.pivot_cells(aggregate.pivot(c, q, labels), ["l_returnflag"], [x for _, x in labels])
    return cells.select("l_returnflag", F.col("cells")["F"].alias("f"), F.col("cells")["O"].alias("o"))


# Expressions


#: name: (table, key, expression, SQL)
EXPRESSIONS = {
    "upper": ("customer", "c_custkey", E.parse("UPPER(c_name)"), "upper(c_name)"),
    "lower": ("customer", "c_custkey", E.parse("lower(c_mktsegment)"), "lower(c_mktsegment)"),
    "len": ("customer", "c_custkey", E.parse("LEN(c_name)"), "CAST(length(c_name) AS INTEGER)"),
    "coalesce": ("customer", "c_custkey", E.parse("COALESCE(c_name, 'none')"), "coalesce(c_name, 'none')"),
    "abs": ("customer", "c_custkey", E.parse("ABS(c_acctbal)"), "abs(c_acctbal)"),
    "round": ("part", "p_partkey", E.parse("ROUND(p_retailprice, 0)"), "round(p_retailprice, 0)"),
    "concat": ("customer", "c_custkey", E.parse("c_name || ' (' || c_mktsegment || ')'"), "c_name || ' (' || c_mktsegment || ')'"),
    "cast_text": ("orders", "o_orderkey", E.Cast(E.Col("o_custkey"), "Text"), "CAST(o_custkey AS VARCHAR)"),
    "cast_int": ("part", "p_partkey", E.Cast(E.Cast(E.Col("p_size"), "Text"), "Int"), "CAST(p_size AS INTEGER)"),
    "case": (
        "orders",
        "o_orderkey",
        E.Case(E.Col("o_orderstatus"), ((E.Lit("F"), E.Lit("final")), (E.Lit("O"), E.Lit("open"))), E.Lit("other")),
        "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END",
    ),
    "date_add": ("orders", "o_orderkey", E.DateAdd(E.Col("o_orderdate"), "month", E.Lit(1)), "o_orderdate + INTERVAL 1 MONTH"),
    "date_diff": ("events", "event_id", E.DateDiff("hour", E.Lit("2024-01-01 00:00:00"), E.Col("ts")), "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000) AS BIGINT)"),
    "date_part": ("orders", "o_orderkey", E.DatePart("year", E.Col("o_orderdate")), "CAST(year(o_orderdate) AS INTEGER)"),
    "json_get": ("events", "event_id", E.JsonGet(E.Col("props"), ("k",)), "props ->> '$.k'"),
}


def _expression(table, key, expr):
    return lambda spark, sf_dir: compiler(spark, sf_dir).flat(Query(table, [key], computed={"v": expr}, limit=UNLIMITED))


for _name, (_table, _key, _expr, _sql) in EXPRESSIONS.items():
    query(f"expr_{_name}", f"SELECT {_key}, {_sql} AS v FROM {_table}")(_expression(_table, _key, _expr))


@query("expr_raw_sql", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    table = c.model.table("part")
    return c.scan(table).select("p_partkey", F.expr(E.raw_sql("{p_size} * 2 + 1", table.column)).alias("v"))


# Policies


@query("tenant_scope", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, Context({"tenant_id": 7}), {"orders": {"tenant-filter": "o_custkey"}})
    return select(c, "orders", ["o_orderkey"])


@query("tenant_scope_on_link", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey = 3) ON o_custkey = c_custkey")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, Context({"tenant_id": 3}), {"customer": {"tenant-filter": "c_nationkey"}})
    rows = c.nested(Query("orders", ["o_orderkey"], links={"customer": Query("customer", ["c_name"])}, limit=UNLIMITED))
    return rows.select("o_orderkey", "customer.c_name")


@query("tenant_scope_in_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0)")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, Context({"tenant_id": 3}), {"customer": {"tenant-filter": "c_nationkey"}})
    return select(c, "orders", ["o_orderkey"], {"customer": {"c_acctbal": {"_gt": 0}}})


@query("auto_filter_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment = 'BUILDING'")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, Context({"nations": [1, 2, 3], "segment": "BUILDING"}), {"customer": {"auto-filter": "c_nationkey:nations, c_mktsegment:segment"}})
    return select(c, "customer", ["c_custkey"])


@query("row_scope", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, Context({"level": "1-URGENT"}), {"orders": {"policy-actions": "read, update", "policy-row-scope": "o_orderpriority = {level}"}})
    return select(c, "orders", ["o_orderkey"])


def _soft(mode):
    def run(spark, sf_dir):
        model = Model()
        deleted = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at")
        model.add("orders", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", deleted), ("o_orderkey",)).metadata["soft-delete"] = "deleted_at"
        return Compiler(model).flat(Query("orders", ["o_orderkey"], limit=UNLIMITED, deleted=mode))

    return run


for _mode, _sql in (("hide", "o_orderstatus <> 'F'"), ("only", "o_orderstatus = 'F'"), ("include", "TRUE")):
    query(f"soft_delete_{_mode}", f"SELECT o_orderkey FROM orders WHERE {_sql}")(_soft(_mode))


@query("mask_last4", "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '••••••' ELSE '••••' || right(c_name, 4) END AS c_name FROM customer")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir, rules={"customer.c_name": {"mask": "last4"}}), "customer", ["c_custkey", "c_name"])


@query("mask_redact", "SELECT c_custkey, '••••••' AS c_name FROM customer")
def _(spark, sf_dir):
    return select(compiler(spark, sf_dir, rules={"customer.c_name": {"mask": "redact"}}), "customer", ["c_custkey", "c_name"])


@query("mask_email", "SELECT c_custkey, 'C••••@x' || c_custkey AS email FROM customer")
def _(spark, sf_dir):
    model = Model()
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat("c_name", F.lit("@x"), "c_custkey").alias("email"))
    model.add("t", rows, ("c_custkey",)).columns["email"].metadata["mask"] = "email"
    return Compiler(model).flat(Query("t", limit=UNLIMITED))


@query("unmasked_by_role", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, Context(roles=frozenset({"auditor"})), {"customer.c_name": {"mask": "redact", "unmask-role": "auditor"}})
    return select(c, "customer", ["c_custkey", "c_name"])


@query("scan_text_cast", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir, rules={"orders.o_orderdate": {"read-as": "text"}, "orders.o_custkey": {"read-as": "text"}})
    return select(c, "orders", ["o_orderkey", "o_orderdate", "o_custkey"])


# Search


@query("search_ranked", "SELECT 'nation' AS \"table\", CAST(n_nationkey AS VARCHAR) AS row_key, 1 AS score FROM (SELECT n_nationkey FROM nation WHERE contains(n_name, 'IN') ORDER BY 1 LIMIT 50) ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 5")
def _(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows, _ = search.ranked({"nation": (nation, ["n_nationkey"])}, "IN")
    return rows.select("table", "row_key", "score")


@query("search_totals", "SELECT 'customer' AS \"table\", count(*) AS total FROM customer WHERE contains(c_name, '00') OR contains(c_mktsegment, '00') UNION ALL SELECT 'nation', count(*) FROM nation WHERE contains(n_name, '00')")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    frames = {n: (c.scan(c.model.table(n)), list(c.model.table(n).keys)) for n in ("customer", "nation")}
    return search.ranked(frames, "00")[1]


@query("multi_link_filter_combined", "SELECT o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf_dir):
    c = compiler(spark, sf_dir)
    part = both(Cmp("o_totalprice", "_gt", 100000))
    q = Query("orders", ["o_orderkey"], filter=part, sort=["o_totalprice_desc"], limit=25, links={"customer": Query("customer", ["c_name"])})
    return c.nested(q).select("o_orderkey", "customer.c_name")
