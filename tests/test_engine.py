"""What queries refuse, and behaviour that one SQL statement does not show."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from loomspan.frontends import graphql, intent, kv, ldap, listing, odata, rawsql, sqlsubset, visual
from loomspan.functions import crypto, enums, expr, masks, text
from loomspan.operators import aggregate, eav, filters, history, keys, mutate, search
from loomspan.plans import catalog, compile as compiling, metadata, model as models
from loomspan.plans.compile import Compiler
from loomspan.plans.model import Model, ModelError, sample_model
from loomspan.plans.nodes import UNLIMITED, Cmp, Join, Query, Search, Through
from loomspan.plans.policy import AccessDenied, Context, Policy, Profile
from loomspan.sources import tables
from loomspan.streaming import drain, events

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def star(spark):
    return sample_model(spark, SF)


@pytest.fixture
def blog(spark):
    """Posts with tags, attributes, and a tenant."""
    m = Model()
    m.add("blogs", spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id int, name string"), ("id",))
    m.add("posts", spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 1, None), (4, 2, "x"), (5, None, "z")], "id int, blog_id int, title string"), ("id",))
    m.add("tags", spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "id int, name string"), ("id",))
    m.add("post_tags", spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)], "post_id int, tag_id int"), ("post_id", "tag_id"))
    m.infer_links()
    return m


# Filters


@pytest.mark.parametrize(
    "document",
    [{}, {"and": []}, {"o_orderkey": {}}, {"o_orderkey": {"_what": 1}}, {"o_orderkey": {"_between": [1]}}, {"o_orderkey": {"_contains": "1"}}, {"nothing": {"_eq": 1}}, {"or": [{"customer": {"c_custkey": {"_eq": 1}}}]}, {"customer": {"or": [{"c_custkey": {"_eq": 1}}]}}, {"lineitem": {"l_tax": {"_eq": 1}}}],
)
def test_bad_filters(star, document):
    with pytest.raises((filters.FilterError, ModelError)):
        filters.parse(document, star, star.table("orders"))


def test_null_semantics(spark):
    m = Model()
    m.add("t", spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, v string"), ("id",))
    run = lambda d: sorted(r.id for r in Compiler(m).flat(Query("t", ["id"], filter=filters.parse({"v": d}, m, m.table("t")))).collect())
    assert run({"_neq": "a"}) == [3] and run({"_eq": None}) == [2] and run({"_neq": None}) == [1, 3]
    assert run({"_nin": ["a"]}) == [3] and run({"_nin": ["a", None]}) == [] and run({"_in": []}) == [] and run({"_nin": []}) == [1, 2, 3]
    assert run({"_null": "yes"}) == [2] and run({"_ncontains": "a"}) == [3] and run({"_lt": None}) == []


def test_like_takes_backslashes_literally(spark):
    m = Model()
    m.add("t", spark.createDataFrame([(1, r"a\b"), (2, "a%b"), (3, "ab")], "id int, v string"), ("id",))
    run = lambda d: sorted(r.id for r in Compiler(m).flat(Query("t", ["id"], filter=filters.parse({"v": d}, m, m.table("t")))).collect())
    assert run({"_like": r"a\b"}) == [1] and run({"_contains": "%"}) == [2] and run({"_like": "a_b"}) == [1, 2]


def test_filters_reach_the_scan(star):
    plan = Compiler(star).flat(Query("orders", ["o_orderkey"], filter=Cmp("o_totalprice", "_gt", 100000), limit=UNLIMITED))._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan.split("== Physical Plan ==")[1]


def test_search_terms():
    assert search.terms('one "two three" four "open end') == ["one", "two three", "four", "open end"]
    assert search.terms("  ") == []


def test_search_matches_words(spark):
    rows = spark.createDataFrame([(1, "Quick Brown Fox", ""), (2, "", "the fox is quick"), (3, "foxes quickly", ""), (4, "éfox quick", "")], "id int, a string, b string")
    run = lambda t: [r.id for r in rows.filter(search.matches([F.col("a"), F.col("b")], t)).collect()]
    assert run("FOX quick") == [1, 2] and run('"brown fox"') == [1] and run("") == [1, 2, 3, 4]


# Pages and links


def test_pages(blog):
    c = Compiler(blog)
    rows = c.nested(Query("blogs", ["id"], links={"posts": Query("posts", ["id"], sort=["id_desc"], limit=2)}, limit=UNLIMITED)).collect()
    assert [(r.id, r.posts.total, [p.id for p in r.posts.data]) for r in sorted(rows)] == [(1, 3, [3, 2]), (2, 1, [4]), (3, 0, [])]
    late = c.nested(Query("blogs", ["id"], links={"posts": Query("posts", ["id"], offset=2)}, limit=UNLIMITED)).collect()
    assert [(r.id, r.posts.total, r.posts.offset, r.posts.limit) for r in sorted(late)] == [(1, 3, 2, 100), (2, 0, 2, 100), (3, 0, 2, 100)]
    page = c.page(Query("posts", ["id"], limit=2, offset=1))
    assert [r.id for r in page.rows.collect()] == [2, 3] and page.total.first()[0] == 5
    for bad in (Query("posts", limit=-2), Query("posts", offset=-1), Query("posts", sort=["id"]), Query("posts", links={"nope": Query("blogs")})):
        with pytest.raises((ValueError, ModelError)):
            c.nested(bad).collect()


def test_pages_of_many_parents_take_tasks_by_their_rows(spark, monkeypatch):
    hot = [(1, k) for k in range(200)] + [(p, k % 7) for p in range(2, 40) for k in range(p % 6)] + [(2, 3), (2, 3), (99, 1), (None, 1)]
    m = Model()
    m.add("parents", spark.createDataFrame([(p,) for p in range(45)], "id int"), ("id",))
    m.add("things", spark.createDataFrame([(k, k % 10) for k in range(200)], "k int, price int"), ("k",))
    m.add("uses", spark.createDataFrame([(n, *x) for n, x in enumerate(hot)], "n int, p int, k int"), ("n",))
    m.link("uses", "p", "parents")
    m.link("uses", "k", "things")
    m.many_to_many("parents", "uses", "things")
    c = Compiler(m)

    def pages():
        for page in ({"limit": 3}, {"limit": 2, "offset": 1}, {"limit": UNLIMITED, "offset": 2}):
            for parents in (Query("parents", limit=UNLIMITED), Query("parents", limit=3)):
                yield c.flat_children(parents, "things", Query("things", ["k"], sort=["price_desc"], **page))
                yield c.flat_children(parents, "uses", Query("uses", ["n", "k"], sort=["k_desc"], **page))

    want = [sorted(map(tuple, df.collect())) for df in pages()]
    assert all(want) and (1, 9, 1, 200) in want[0]
    for name, value in (("MANY", 100), ("MANY_PARENTS", 0), ("TASK", 20)):
        monkeypatch.setattr(compiling, name, value)
    assert [sorted(map(tuple, df.collect())) for df in pages()] == want
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in pages()]
    assert all(f", {-(-len(hot) // 20)}" in line for plan in plans for line in plan.splitlines() if "RepartitionByExpression" in line) and all("RepartitionByExpression" in plan for plan in plans)


def test_inferred_many_to_many(blog):
    rows = Compiler(blog).nested(Query("posts", ["id"], links={"tags": Query("tags", ["name"], sort=["name_asc"])}, limit=UNLIMITED)).collect()
    assert {r.id: [t.name for t in r.tags.data] for r in rows} == {1: ["t1", "t2", "t3"], 2: ["t1", "t2"], 3: [], 4: [], 5: []}
    assert not blog.table("posts").many_links["tags"].has_payload


def test_link_with_null_key_is_null(blog):
    rows = Compiler(blog).nested(Query("posts", ["id"], links={"blogs": Query("blogs", ["name"])}, limit=UNLIMITED)).collect()
    assert {r.id: r.blogs and r.blogs.name for r in rows} == {1: "A", 2: "A", 3: "A", 4: "B", 5: None}


def test_two_links_to_one_table_have_roles(spark):
    m = Model()
    m.add("users", spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), ("id",))
    m.add("tasks", spark.createDataFrame([(1, 1, 2)], "id int, owner_id int, reviewer_id int"), ("id",))
    m.link("tasks", "owner_id", "users")
    m.link("tasks", "reviewer_id", "users")
    row = Compiler(m).nested(Query("tasks", ["id"], links={"users": Query("users", ["name"]), "reviewer": Query("users", ["name"])})).first()
    assert (row.users.name, row.reviewer.name) == ("a", "b")


def test_composite_keys_do_not_mix_tenants(spark):
    m = Model()
    m.add("places", spark.createDataFrame([(1, 10, "N"), (2, 10, "M")], "tenant int, place int, name string"), ("tenant", "place"))
    m.add("stock", spark.createDataFrame([(1, 1, 10, 5), (2, 2, 10, 7)], "id int, tenant int, place int, n int"), ("id",))
    m.link("stock", ("tenant", "place"), "places")
    rows = Compiler(m).nested(Query("stock", ["id"], links={"places": Query("places", ["name"])})).collect()
    assert {r.id: r.places.name for r in rows} == {1: "N", 2: "M"}
    with pytest.raises(ModelError):
        m.link("stock", "tenant", "places")


def test_ambiguous_names(spark):
    m = Model()
    schema = tables.T.StructType.fromDDL("id int")
    m.add("t", schema, ("id",), schema="a")
    m.add("t", schema, ("id",), schema="b")
    assert m.table("a.t").schema == "a"
    with pytest.raises(ModelError):
        m.table("t")


# Explicit joins as rows


def test_rows_of_a_join_are_no_array_and_no_single_task(spark):
    df = catalog.queries()["join_dynamic_eq"](spark, "/root/testdata/sf0.01")
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < sum(tasks) / 2


@pytest.mark.parametrize("cell", [compiling.CELL, (3, 2), (1, 1)])
@pytest.mark.parametrize("op", ["_eq", "_lt"])
def test_rows_of_a_join_equal_all_matches(spark, monkeypatch, cell, op):
    monkeypatch.setattr(compiling, "CELL", cell)
    left = [(k, [7, 7, 7, k, None][k % 5], "x") for k in range(40)]
    right = [(k, [7, 7, k, None][k % 4]) for k in range(30)]
    m = Model()
    m.add("a", spark.createDataFrame([*left, left[0]], "k int, v int, w string"))  # no key, and a row twice
    m.add("b", spark.createDataFrame(right, "j int, v int"), ("j",))
    join = Join("b", Query("b", ["j"]), "v", "v", op)
    found = Compiler(m).flat_join(Query("a", ["k"], joins=[join], limit=UNLIMITED))
    meet = {"_eq": lambda x, y: x == y, "_lt": lambda x, y: x < y}[op]
    want = [(x[0], y[0]) for x in [*left, left[0]] for y in right if x[1] is not None and y[1] is not None and meet(x[1], y[1])]
    assert found.columns == ["k", "j"] and sorted(map(tuple, found.collect())) == sorted(want)
    for bad in (Join("b", Query("b", ["j"], limit=3), "v", "v"), Join("b", Query("b", ["j"]), "v", "v", single=True), Join("b", Query("b", ["v"]), "v", "v")):
        with pytest.raises(ModelError):
            Compiler(m).flat_join(Query("a", ["v"], joins=[bad], limit=UNLIMITED))


# Aggregates


def test_pivot_refusals(spark, star):
    c = Compiler(star)
    for bad in (
        aggregate.Pivot("orders", ["o_orderstatus"], "o_orderkey", "o_totalprice", "sum"),
        aggregate.Pivot("orders", ["o_orderstatus"], "o_orderstatus", "o_totalprice", "sum"),
        aggregate.Pivot("orders", ["o_orderstatus"], "o_orderpriority", "o_totalprice", "sum", Through("customer", Cmp("c_custkey", "_eq", 1))),
    ):
        with pytest.raises(ModelError):
            aggregate.pivot(c, bad)
    m = Model()
    m.add("t", spark.createDataFrame([(1, "g", None), (2, "g", "_null_")], "id int, g string, v string"), ("id",))
    with pytest.raises(ModelError):
        aggregate.pivot(Compiler(m), aggregate.Pivot("t", ["g"], "v", "id", "count"))
    with pytest.raises(ModelError):
        aggregate.grouped(c, aggregate.Grouped("orders"))
    with pytest.raises(ModelError):
        aggregate.grouped(c, aggregate.Grouped("orders", [], [("sum", "o_orderstatus")]))
    with pytest.raises(ModelError):
        aggregate.metric_series(c, "orders", ["o_custkey"], None, 5)


def test_aggregates_follow_keys_not_positions(spark):
    m = Model()
    m.add("companies", spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), ("id",))
    m.add("people", spark.createDataFrame([(10, 1, None), (20, 1, None), (30, 2, 500)], "id int, company_id int, pay int"), ("id",))
    m.infer_links()
    from loomspan.plans.nodes import Aggregate

    rows = Compiler(m).flat(Query("companies", ["id"], aggregates=[Aggregate("s", "sum", ("people",), "pay"), Aggregate("n", "count", ("people",), "id")])).collect()
    assert sorted(map(tuple, rows)) == [(1, None, 2.0), (2, 500.0, 1.0)]


# Policies


def test_policies_deny(star, spark):
    def c(rules, context=Context()):
        m = sample_model(spark, SF)
        for name, values in rules.items():
            target = m.table(name.split(".")[0])
            (target.columns[name.split(".")[1]] if "." in name else target).metadata.update(values)
        return Compiler(m, Policy(), context)

    for rules, query in (
        ({"orders": {"tenant-filter": "o_custkey"}}, Query("orders")),
        ({"customer": {"tenant-filter": "c_nationkey"}}, Query("orders", links={"customer": Query("customer")})),
        ({"customer": {"tenant-filter": "c_nationkey"}}, Query("orders", filter=Through("customer", Cmp("c_acctbal", "_gt", 0)))),
        ({"orders": {"auto-filter": "o_custkey:ids"}}, Query("orders")),
        ({"orders": {"policy-actions": "update"}}, Query("orders")),
        ({"orders": {"policy-read-deny": "o_totalprice"}}, Query("orders", ["o_totalprice"])),
        ({"orders": {"policy-read-deny": "o_totalprice"}}, Query("orders", ["o_orderkey"], sort=["o_totalprice_asc"])),
        ({"orders": {"policy-read-deny": "o_totalprice"}}, Query("orders", ["o_orderkey"], filter=Cmp("o_totalprice", "_gt", 1))),
        ({"orders.o_totalprice": {"encrypt": "k"}}, Query("orders", ["o_orderkey"], filter=Cmp("o_totalprice", "_gt", 1))),
    ):
        with pytest.raises(AccessDenied):
            c(rules).nested(query)
    assert c({"orders": {"policy-actions": "update"}}, Context(roles=frozenset({"admin"}))).flat(Query("orders")).count() == 100
    seen = []
    watched = c({})
    watched.policy.observers.append(lambda phase, table, facts: seen.append((phase, table)))
    watched.flat(Query("region"))
    assert seen == [("parsed", "region"), ("transformed", "region")]
    hidden = c({"orders": {"visibility": "hidden"}, "customer": {"policy-read-deny": "c_acctbal"}})
    shown = {t["table"]: [x["name"] for x in t["columns"]] for t in hidden.policy.visible(hidden.model.overview(), Context())}
    assert "orders" not in shown and "c_acctbal" not in shown["customer"]
    off = c({"orders": {"tenant-filter": "o_custkey"}}, Context(off=frozenset({"tenant"})))
    assert off.flat(Query("orders", limit=3)).count() == 3


def test_profiles_and_observers(star):
    context = Profile("audit", frozenset({"soft-delete"})).context(Context())
    assert context.off == {"soft-delete"}
    with pytest.raises(AccessDenied):
        Profile("open", frozenset({"tenant"})).context(Context())
    c, seen = Compiler(star), []
    c.policy.observers.append(lambda phase, table, facts: seen.append((phase, facts.get("rows"))))
    rows, observation = c.watched(Query("region"))
    assert rows.count() == 5
    c.executed(Query("region"), observation, 0.1)
    assert seen[-1] == ("executed", 5)


# Model and metadata


def test_metadata_grammar():
    rules = metadata.parse("a.b, c | has(x*) { k: v:w; q: `1;2` } :root{z:1}")
    assert rules == [("a.b", {"k": "v:w", "q": "1;2"}, None), ("c", {"k": "v:w", "q": "1;2"}, "x*"), (":root", {"z": "1"}, None)]
    for bad in ("a {", "a { novalue }", "{k:v}", "a | hasnt(x) {k:v}"):
        with pytest.raises(ModelError):
            metadata.parse(bad)


def test_detectors(spark):
    m = Model()
    kind = lambda *names: tables.T.StructType([tables.T.StructField(n, tables.T.StringType()) for n in names])
    t = m.add("order_status", kind("id", "name"), ("id",))
    assert models.is_lookup(t) and not models.is_lookup(m.add("orders", kind("id", "name"), ("id",)))
    roles = models.proposed_roles(m.add("x", kind("id", "tenant_id", "deleted_at", "created_on", "ship_city", "ship_street")))
    assert roles == {"tenant-filter": "tenant_id", "soft-delete": "deleted_at", "created-on": "created_on"}
    assert models.prefix_groups(m.table("x"))["ship"] == ["ship_city", "ship_street"]
    for name in ("wp_posts", "wp_postmeta", "wp_users", "wp_usermeta", "wp_options"):
        m.add(name, kind("id"))
    assert models.known_schema(m) == "wordpress"
    m.apply(metadata.parse("x.* { note: y } *.x.ship_* { unit: z }"))
    assert m.table("x").columns["ship_city"].metadata == {"unit": "z"}


def test_scalars(spark):
    names = {"int": "Int", "bigint": "BigInt", "smallint": "Short", "decimal(10,2)": "Decimal", "double": "Float", "boolean": "Boolean", "timestamp_ntz": "DateTime", "timestamp": "DateTimeOffset", "string": "String", "binary": "String", "map<string,int>": "JSON"}
    schema = tables.T.StructType.fromDDL(", ".join(f"c{k} {kind}" for k, kind in enumerate(names)))
    assert [models.scalar_name(f.dataType) for f in schema] == list(names.values())


# Front ends


def test_graphql_faults(star):
    c = Compiler(star)
    for bad in ("{", "{ orders", "mutation { x }", "{ ...f } fragment f on orders { ...f }", "{ orders(filter: {o_orderkey: {_eq: $x}}) { o_orderkey } }", "{ nothing { a } }", "{ orders { nothing } }", "{ a: orders { o_orderkey } } { b: orders { o_orderkey } }", "{ orders " * 25):
        with pytest.raises((graphql.SyntaxFault, ModelError)):
            graphql.execute(c, bad)
    rows = graphql.execute(c, 'query ($k: Int = 3) { orders(_primaryKey: [$k]) { data { o_orderkey s: o_orderstatus } } r: region(limit: 1) { r_name } }', {"k": 5})
    assert rows["orders"].first().o_orderkey == 5 and rows["orders"].columns == ["o_orderkey", "s"] and rows["r"].count() == 1
    assert "type orders {" in graphql.schema_text(star)


@pytest.mark.parametrize(
    "sql",
    ["SELECT DISTINCT o_orderkey FROM orders", "SELECT count(o_orderkey) FROM orders", "SELECT * FROM orders WHERE NOT o_orderkey = 1", "SELECT * FROM orders GROUP BY o_orderkey", "SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "SELECT * FROM orders JOIN part ON orders.o_orderkey = part.p_partkey", "SELECT * FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_name = 'x'", "SELECT * FROM orders; DROP TABLE orders", "SELECT * FROM orders WHERE o_orderkey = (SELECT 1)", "DELETE FROM orders", "SELECT * FROM orders WHERE o_orderkey = $2"],
)
def test_sql_subset_refuses(star, sql):
    with pytest.raises((sqlsubset.Refused, ModelError)):
        sqlsubset.execute(Compiler(star), sql, [1])


def test_raw_sql_guard(star):
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM t WHERE a = 'x", "/* SELECT", "SELECT 'a\\'; DROP TABLE t; --'", "SELECT java_method('x')", ""):
        with pytest.raises(rawsql.RawSqlError):
            rawsql.validate(bad)
    for good in ("SELECT ';' AS a", "SELECT 1 -- ; drop\n", "WITH a AS (SELECT 1) SELECT * FROM a;", "SELECT `drop` FROM t"):
        rawsql.validate(good)
    with pytest.raises(AccessDenied):
        rawsql.execute(Compiler(star), "SELECT * FROM orders")


def test_raw_sql_sees_what_the_caller_sees(spark):
    m = sample_model(spark, SF)
    m.table("orders").metadata["tenant-filter"] = "o_custkey"
    c = Compiler(m, context=Context({"tenant_id": 7}, frozenset({"raw-sql"})))
    assert {r[0] for r in rawsql.execute(c, "SELECT DISTINCT o.o_custkey FROM orders o WHERE 'orders' = 'orders'").collect()} == {7}


def test_raw_sql_reads_nothing_else(spark):
    m = sample_model(spark, SF)
    m.table("orders").metadata["tenant-filter"] = "o_custkey"
    c = Compiler(m, context=Context({"tenant_id": 7}, frozenset({"raw-sql"})))
    rawsql.execute(c, "SELECT * FROM orders").count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("__raw")]
    spark.range(3).createOrReplaceTempView("left_over")
    hidden = f"parquet.`{SF}/orders.parquet`"
    for sql in (
        "SELECT id FROM left_over, orders", f"SELECT * FROM {hidden} WHERE 'orders' = 'orders' AND o_orderkey IN (SELECT o_orderkey FROM orders)",
        f"SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM {hidden})", f"SELECT (SELECT max(o_custkey) FROM {hidden}) AS m FROM orders",
        f"WITH x AS (SELECT * FROM {hidden}) SELECT x.o_custkey FROM x JOIN orders ON true", "SELECT o_custkey FROM orders UNION ALL SELECT id FROM left_over",
    ):
        with pytest.raises(AccessDenied):
            rawsql.execute(c, sql)
    good = "WITH x AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT 1 AS one) SELECT n FROM x, y WHERE o_custkey IN (SELECT o_custkey FROM orders) AND n > (SELECT 0)"
    assert rawsql.execute(c, good).count() == 1
    spark.catalog.dropTempView("left_over")


def test_search_needs_its_columns(spark):
    m = sample_model(spark, SF)
    m.table("customer").metadata |= {"search": "c_name", "policy-read-deny": "c_name"}
    q = Query("customer", ["c_custkey"], filter=Search("Customer"))
    with pytest.raises(AccessDenied):
        Compiler(m).flat(q)
    assert Compiler(m, context=Context(roles=frozenset({"admin"}))).flat(q).columns == ["c_custkey"]
    m.table("customer").metadata.pop("policy-read-deny")
    m.table("customer").column("c_nationkey").metadata["encrypt"] = "yes"
    with pytest.raises(AccessDenied):
        Compiler(m).nested(Query("customer", ["c_custkey"], joins=[Join("s", Query("supplier", ["s_suppkey"]), "c_nationkey", "s_nationkey")]))


def test_odata_expands_no_more_than_its_cap(star, monkeypatch):
    c = Compiler(star)
    assert odata.execute(c, "region", {"$expand": "nation"}).count() == 5
    monkeypatch.setattr(odata, "MOST_PAGE", 20)
    with pytest.raises(ModelError):
        odata.execute(c, "region", {"$expand": "nation"})


def test_odata_faults(star):
    c = Compiler(star)
    for options in ({"$apply": "x"}, {"$filter": "o_orderkey eq"}, {"$filter": "o_orderkey foo 1"}, {"$filter": "(o_orderkey eq 1"}, {"$top": "-1"}, {"$expand": "nothing"}):
        with pytest.raises((odata.ODataError, ModelError)):
            odata.execute(c, "orders", options)
    assert odata.tree({"$top": "99999"}, c, "orders").limit == odata.MOST_PAGE


def test_ldap_logic(spark):
    m = Model()
    m.add("t", spark.createDataFrame([(1, "a*b"), (2, None), (3, "axb")], "id int, v string"), ("id",))
    run = lambda f: [r.id for r in ldap.search(Compiler(m), "t", f, ["id"]).collect()]
    assert run(r"(v=a\2ab)") == [1] and run("(v=a*b)") == [1, 3] and run("(!(v=axb))") == [1] and run("(!(v=*))") == [2]
    assert run("(&)") == [1, 2, 3] and run("(|)") == [] and run("(!(unknown=1))") == [] and run("(id>=2)") == [2, 3]
    for bad in ("v=1", "(v=1", "(v?1)", "(&(v=1)"):
        with pytest.raises(ldap.LdapError):
            run(bad)


def test_visual_faults(star):
    c = Compiler(star)
    both = [{"table": "orders", "alias": "o"}, {"table": "customer", "alias": "c"}]
    column = [{"table": "o", "column": "o_orderkey"}]
    on = [{"left": "o", "right": "c", "on": [["o_custkey", "c_custkey"]]}]
    for spec in (
        {"tables": []}, {"tables": both, "columns": column}, {"tables": both, "joins": on, "columns": []},
        {"tables": both, "joins": on, "columns": column, "filter": {"table": "o", "column": "o_orderkey", "op": "_in", "value": []}},
        {"tables": both, "joins": on, "columns": column, "filter": {"table": "o", "column": "o_orderkey", "op": "_between", "value": [1, 2, 3]}},
        {"tables": both, "joins": [{"left": "o", "right": "c", "on": [], "kind": "inner"}], "columns": column},
    ):
        with pytest.raises(visual.VisualError):
            visual.execute(c, spec)
    assert visual.execute(c, {"tables": both, "joins": on, "columns": column, "limit": 99999}).count() == 1000


def test_key_value(star, spark):
    store = kv.KeyValue(Compiler(star), spark)
    rows = {r.key: r.value for r in store.mget(["region:1", "region:77"]).collect()}
    assert json.loads(rows["region:1"])["r_regionkey"] == 1 and rows["region:77"] is None
    assert store.type("region:1").first()[0] == "hash" and store.type("region:77").first()[0] == "none"
    assert store.hget("region:1", "r_regionkey").first().value == "1"
    with pytest.raises(ModelError):
        store.get("region:1:2")


def test_list_tokens(star):
    c = Compiler(star)
    request = {"table": "region", "page_size": 2}
    _, token = listing.list_rows(c, request, b"s")
    assert [r.r_regionkey for r in listing.list_rows(c, request, b"s", token)[0].collect()] == [2, 3]
    with pytest.raises(ModelError):
        listing.list_rows(c, request | {"page_size": 3}, b"s", token)
    with pytest.raises(ModelError):
        listing.list_filter({"field": "r_name", "op": "in", "value": list(range(201))}, star.table("region"))


def test_feeds_and_metrics(star, spark):
    c = Compiler(star)
    items = listing.feed_items(listing.feed(c, "events", "ts", ["event_id", "ts", "event_type"], limit=3), "<{event_type}>", "http://x/{event_type}", ["event_id"], "ts")
    assert listing.rss("a & b", items).count("<item>") == 3 and "a &amp; b" in listing.rss("a & b", items) and listing.atom("t", items).count("<entry>") == 3
    series = aggregate.metric_series(c, "orders", ["o_orderstatus"], None, 10)
    assert 'orders{o_orderstatus="F"}' in listing.exposition("orders", series, ["o_orderstatus"], "_count")


def test_intents_and_tools(star):
    c = Compiler(star)
    result = intent.execute(c, Query("nation", ["n_name"], links={"region": Query("region", ["r_name"])}, limit=3), with_total=True)
    assert result.rows.columns == ["n_name", "region.r_name"] and result.total.first()[0] == 25
    call = intent.tools([{"name": "t", "table": "region", "filter": {"r_regionkey": {"_eq": "{{k}}"}}}], c)["t"]
    assert call(k=2).count() == 1
    with pytest.raises(ModelError):
        call()


# Functions


def test_expression_grammar(spark):
    rows = spark.createDataFrame([("it's", 2.345, None)], "a string, b double, c string")
    run = lambda t: rows.select(expr.lower(expr.parse(t), F.col).alias("v")).first().v
    assert run("upper(a) || '-' || (LEN(a) || 'x')") == "IT'S-4x" and run("'it''s'") == "it's" and run("ROUND(b, 2)") == 2.35
    assert run("COALESCE(c, a)") == "it's" and run("a || c") is None
    for bad in ("a ||", "nothing(a)", "(a", "COALESCE(a)", "ROUND(b, a)", "a b", "'open", "(" * 40 + "a"):
        with pytest.raises(expr.ExprError):
            run(bad)
    for bad in ("{a}; drop", "{a} -- x", "/* {a}"):
        with pytest.raises(expr.ExprError):
            expr.raw_sql(bad, F.col)
    when = spark.sql("SELECT timestamp_ntz'2024-01-31 23:00:00' AS s, timestamp_ntz'2024-02-01 01:00:00' AS e")
    one = lambda e: when.select(expr.lower(e, F.col).alias("v")).first().v
    assert one(expr.DateAdd(expr.Col("s"), "month", expr.Lit(1))) == dt.datetime(2024, 2, 29, 23)
    assert one(expr.DateDiff("day", expr.Col("s"), expr.Col("e"))) == 0 and one(expr.DateDiff("day", expr.Col("e"), expr.Col("s"))) == -1
    with pytest.raises(expr.ExprError):
        one(expr.DateDiff("month", expr.Col("s"), expr.Col("e")))
    with pytest.raises(expr.ExprError):
        expr.lower(expr.JsonGet(expr.Col("a"), ("x'y",)), F.col)


def test_masks(spark):
    rows = spark.createDataFrame([("1234567",), ("123",), (None,), ("ann@x.org",), ("@x",)], "v string")
    run = lambda kind: [r.v for r in rows.select(masks.mask(F.col("v"), kind).alias("v")).collect()]
    assert run("last4")[:3] == ["••••4567", "••••••", None] and run("email")[3:] == ["a••••@x.org", "••••••"] and run("redact")[2] is None


def test_encryption(spark):
    key, where = b"k" * 32, crypto.place("s", "t", "c")
    rows = spark.createDataFrame([("secret",), (None,), ("é",)], "v string").withColumn("e", crypto.encrypt(F.col("v"), key, 2, where))
    rows = rows.select("v", "e", crypto.decrypt(F.col("e"), {1: b"o" * 32, 2: key}, where).alias("d"), crypto.decrypt(F.col("e"), {2: key}, "elsewhere").alias("moved"), crypto.blind_index(F.col("v"), key).alias("b")).collect()
    assert [r.d for r in rows] == ["secret", None, "é"] and all(r.moved is None for r in rows)
    assert rows[0].b == crypto.blind_token("secret", key) and rows[0].e != rows[2].e


def test_uuid5_and_templates(spark):
    rows = spark.createDataFrame([("orders/1",), ("é",)], "v string")
    got = [r.v for r in rows.select(text.uuid5(F.col("v")).alias("v")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, v)) for v in ("orders/1", "é")]
    assert rows.select(text.template("a {v} b", url=True).alias("v")).first().v == "a orders%2F1 b"


@pytest.mark.parametrize(
    "raw, want",
    [("N;", None), ("b:1;", True), ("i:-5;", -5), ("d:1.5;", 1.5), ('s:2:"é";', "é"), ('a:2:{i:0;s:1:"a";i:1;s:1:"b";}', ["a", "b"]), ('a:1:{s:1:"k";a:1:{s:1:"x";i:1;}}', {"k": {"x": 1}}), ('O:3:"Foo":1:{s:1:"p";N;}', {"p": None})],
)
def test_php(raw, want):
    assert json.loads(text.php_reader()(raw)) == want


def test_php_gives_other_text_back():
    for raw in ("", "plain", "s:5:\"ab\";", "a:2:{i:0;", None):
        assert text.php_reader()(raw) == raw


def test_enums(spark):
    rows = spark.createDataFrame([("a",), ("z",), (None,)], "v string")
    assert [r.v for r in rows.select(enums.named(F.col("v"), {"a": "Alpha"}).alias("v")).collect()] == ["Alpha", None, None]
    assert enums.load(spark.createDataFrame([(1, "x")], "k int, n string"), "k", "n") == {1: "x"}
    assert enums.stored(Cmp("v", "_in", ["Alpha", "Nope"]), "v", {"a": "Alpha"}) == Cmp("v", "_in", ["a"])


def test_attribute_map(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    meta = spark.createDataFrame([(1, 1, "color", "red"), (2, 1, "size", "L"), (3, 1, "color", "blue"), (4, 1, "", "x"), (5, 1, None, "y"), (6, 1, "none", None)], "mid int, post int, k string, v string")
    rows = {r.id: json.loads(r["_meta"]) for r in eav.attribute_map(parents, "id", meta, "post", "k", "v", "mid").collect()}
    assert rows == {1: {"color": "blue", "size": "L", "none": None}, 2: {}}


def test_keys(star, spark):
    c = Compiler(star)
    with pytest.raises(ModelError):
        keys.keyset_page(c, star.table("lineitem"), 5)
    with pytest.raises(ModelError):
        keys.expanded(c.scan(star.table("nation")), c.scan(star.table("customer")), "n_nationkey", "c_nationkey", 10)
    with pytest.raises(ModelError):
        keys.cross_source_join(c.scan(star.table("nation")), c.scan(star.table("region")), "n_regionkey", "r_regionkey", "full")


# Mutations


@pytest.fixture
def widgets(spark):
    m = Model()
    rows = spark.createDataFrame([(1, "a", 1, "draft", None), (2, "b", 1, "live", None)], "id int, name string, version int, state string, deleted_at timestamp_ntz")
    return m.add("widgets", rows, ("id",)), rows


def test_batches(spark, widgets):
    table, rows = widgets
    w = mutate.Writer(spark, table, now=NOW)
    out = w.batch(rows, [mutate.Action("insert", {"id": 1, "name": "taken"}), mutate.Action("delete", {"id": 9}), mutate.Action("update", {"id": 2, "name": "b"})])
    assert out.changes.count() == 0 and out.rows.count() == 2
    for bad in ([mutate.Action("update", {"name": "x"})], [mutate.Action("upsert", {"id": 1})] * 2, [mutate.Action("fly", {"id": 1})], [mutate.Action("delete", {"id": k}) for k in range(101)]):
        with pytest.raises(ModelError):
            w.batch(rows, bad)
    w.duplicates = "reject"
    with pytest.raises(ModelError):
        w.batch(rows, [mutate.Action("update", {"id": 1, "name": "x"}), mutate.Action("delete", {"id": 1})])


def test_batches_on_one_key(spark, widgets):
    table, rows = widgets
    w, act = mutate.Writer(spark, table, now=NOW), mutate.Action
    names = lambda *steps: {r.id: r.name for r in w.batch(rows, list(steps)).rows.collect()}
    update, delete = lambda x: act("update", {"id": 1, "name": x}), act("delete", {"id": 1})
    assert names(delete, update("z")) == names(update("z"), delete) == {2: "b"}
    assert names(update("y"), update("z")) == names(update("z"), act("insert", {"id": 1, "name": "no"})) == {1: "z", 2: "b"}
    assert names(act("insert", {"id": 5, "name": "n"}), act("update", {"id": 5, "name": "m"})) == {1: "a", 2: "b", 5: "m"}
    replaced = w.batch(rows, [delete, act("insert", {"id": 1, "name": "new"})]).rows.filter("id = 1").first()
    assert (replaced.name, replaced.version) == ("new", None)
    for other in (update("z"), delete, act("insert", {"id": 1}), act("upsert", {"id": 1})):
        for steps in ([act("upsert", {"id": 1}), other], [other, act("upsert", {"id": 1})]):
            with pytest.raises(ModelError):
                w.batch(rows, steps)


def test_small_batches_do_not_shuffle_the_table(spark):
    m = sample_model(spark, SF)
    w = mutate.Writer(spark, m.table("orders"), now=NOW)
    before = spark.read.parquet(f"{SF}/orders.parquet")
    out = w.batch(before, [mutate.Action("update", {"o_orderkey": 1, "o_orderpriority": "x"}), mutate.Action("insert", {"o_orderkey": -1})])
    for df in (out.rows, out.changes):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert out.rows.count() == before.count() + 1 and out.changes.count() == 2
    whole = w.apply(before, spark.createDataFrame([("update", ["o_orderpriority"], 1, "x")], "__op string, __set array<string>, o_orderkey long, o_orderpriority string").select("__op", "__set", *[F.col(c) if c in ("o_orderkey", "o_orderpriority") else F.lit(None).cast(k).alias(c) for c, k in before.dtypes]))
    assert whole.rows.filter("o_orderpriority = 'x'").count() == 1


def test_writes_stay_in_scope(spark, widgets):
    table, rows = widgets
    table.metadata["policy-row-scope"] = "state = {state}"
    w = mutate.Writer(spark, table, Context({"state": "live"}), NOW)
    steps = [mutate.Action("update", {"id": k, "name": "z"}) for k in (1, 2)] + [mutate.Action("insert", {"id": 3, "state": "draft"}), mutate.Action("insert", {"id": 4, "state": "live"})]
    assert {r.id for r in w.batch(rows, steps).changes.collect()} == {2, 4}
    assert w.update(rows, {"id": 2, "state": "draft"}).changes.count() == 0
    with pytest.raises(AccessDenied):
        mutate.Writer(spark, table, now=NOW).update(rows, {"id": 1, "name": "z"})
    table.metadata = {"auto-filter": "version:versions"}
    w = mutate.Writer(spark, table, Context({"versions": [5, 6]}), NOW)
    assert w.delete(rows, {"id": 1}).changes.count() == 0


def test_concurrency(spark, widgets):
    table, rows = widgets
    w = mutate.Writer(spark, table, now=NOW)
    done = w.update_checked(rows, {"id": 1, "name": "n", "version": 1}, "version").rows
    assert {r.id: (r.name, r.version) for r in done.collect()} == {1: ("n", 2), 2: ("b", 1)}
    with pytest.raises(mutate.Conflict):
        w.update_checked(done, {"id": 1, "name": "m", "version": 1}, "version")
    with pytest.raises(ModelError):
        w.update_checked(rows, {"id": 1}, "version")


def test_audit_enum_rules_and_policy(spark, widgets):
    table, rows = widgets
    table.columns["state"].metadata["enum"] = "draft=Draft,live=Live"
    table.columns["name"].metadata.update({"maxlength": "3", "pattern": "[a-z]+", "required": "true"})
    table.columns["deleted_at"].metadata["populate"] = "created-on"
    w = mutate.Writer(spark, table, Context({"user_id": 5}), NOW)
    new = w.insert(rows, {"id": 3, "name": "abc", "state": "Live"}).rows.filter("id = 3").first()
    assert (new.state, new.deleted_at) == ("live", NOW)
    for bad in ({"id": 4, "name": "abcd"}, {"id": 4, "name": "A"}, {"id": 4}, {"id": 4, "name": "x", "state": "Nope"}):
        with pytest.raises(mutate.Invalid):
            w.insert(rows, bad)
    table.metadata.update({"policy-actions": "read, update", "policy-write-deny": "version"})
    with pytest.raises(AccessDenied):
        w.delete(rows, {"id": 1})
    with pytest.raises(AccessDenied):
        w.update(rows, {"id": 1, "version": 9})
    table.metadata["tenant-filter"] = "version"
    with pytest.raises(AccessDenied):
        w.update(rows, {"id": 1, "name": "x"})


def test_soft_deleted_rows_stay_deleted(spark, widgets):
    table, rows = widgets
    table.metadata["soft-delete"] = "deleted_at"
    w = mutate.Writer(spark, table, now=NOW)
    gone = w.delete(rows, {"id": 1})
    assert gone.rows.filter("deleted_at IS NOT NULL").count() == 1 and gone.changes.first().op == "delete"
    assert w.update(gone.rows, {"id": 1, "name": "back"}).changes.count() == 0


def test_state_machines():
    machine = mutate.parse_transitions("Draft->Live[editor, chief]@publish; live -> archived | archived->draft")
    assert machine[0] == mutate.Transition("draft", "live", frozenset({"editor", "chief"}), "publish")
    mutate.check_transition(machine, "draft", None, "DRAFT", frozenset())
    mutate.check_transition(machine, "draft", "Draft", "live", frozenset({"chief"}))
    mutate.check_transition(machine, "draft", "live", "LIVE", frozenset())
    for old, new, kind in ((None, "live", mutate.Invalid), ("draft", "archived", mutate.Invalid), ("draft", "live", AccessDenied)):
        with pytest.raises(kind):
            mutate.check_transition(machine, "draft", old, new, frozenset())
    with pytest.raises(ModelError):
        mutate.parse_transitions("a=>b")


def test_tree_sync(spark):
    orders = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    lines = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (3, 2, 9.0)], "id int, order_id int, qty double")
    tree = spark.createDataFrame([(1, "x2", [(1, 1, 1), (4, 1, 5)])], "id int, name string, lines array<struct<id:int,order_id:int,qty:int>>")
    out = mutate.sync_tree({"orders": orders, "lines": lines}, tree, [("orders", ["id"], "", None), ("lines", ["id"], "lines", "order_id")])
    assert [(r.op, r.id) for r in out["orders"].collect()] == [("update", 1)]
    assert sorted((r.op, r.id) for r in out["lines"].collect()) == [("delete", 2), ("insert", 4)]


def test_tree_sync_of_a_parent_without_children(spark):
    orders = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    lines = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (3, 2, 9.0)], "id int, order_id int, qty double")
    parts = spark.createDataFrame([(7, 3)], "id int, line_id int")
    kind = "id int, name string, lines array<struct<id:int,order_id:int,qty:int,parts:array<struct<id:int,line_id:int>>>>"
    tree = spark.createDataFrame([(1, "x", []), (2, "y", [(3, 2, 9, [])])], kind)
    levels = [("orders", ["id"], "", None), ("lines", ["id"], "lines", "order_id"), ("parts", ["id"], "lines.parts", "line_id")]
    out = mutate.sync_tree({"orders": orders, "lines": lines, "parts": parts}, tree, levels)
    assert out["orders"].count() == 0
    assert sorted((r.op, r.id) for r in out["lines"].collect()) == [("delete", 1), ("delete", 2)]
    assert [(r.op, r.id) for r in out["parts"].collect()] == [("delete", 7)]


def test_undo_and_approval(spark, widgets):
    table, rows = widgets
    done = mutate.Writer(spark, table, now=NOW).batch(rows, [mutate.Action("update", {"id": 1, "name": "z"}), mutate.Action("insert", {"id": 7})])
    back = mutate.undo(done.rows, done.changes, ["id"], NOW, NOW, dt.timedelta(1))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(mutate.Conflict):
        mutate.undo(done.rows, done.changes, ["id"], NOW, NOW + dt.timedelta(2), dt.timedelta(1))
    assert mutate.pending(done.changes, "widgets", "me", NOW).filter("state = 'pending'").count() == 2


# History, outbox, retention, workflows


def test_history(spark, widgets):
    table, rows = widgets
    changes = mutate.Writer(spark, table, now=NOW).batch(rows, [mutate.Action("update", {"id": 1, "name": "z"}), mutate.Action("delete", {"id": 2})]).changes
    trail = history.trail(changes, "widgets", ["id"], "me", NOW)
    assert {(r.op, tuple(r.changed_columns)) for r in trail.filter("op = 'update'").collect()} == {("update", ("name",))}
    assert history.of_entity(trail, "widgets", {"id": 1}).count() == 1
    assert history.of_entity(trail, "widgets", {"id": 1}, ("version", 1)).count() == 1 and history.of_entity(trail, "widgets", {"id": 1}, ("version", 2)).count() == 0
    erased = history.erase(trail, "widgets", {"id": 1}, NOW).filter("entity_id = '{\"id\":1}'").collect()
    assert {(r.op, r.before) for r in erased} == {("update", None), ("erase", None)}


def test_history_of_any_key(spark):
    rows = spark.createDataFrame([("é", 'a"b', 1), ("\u2028\U0001f600", "x", 2)], "a string, b string, n int")
    m = Model()
    table = m.add("t", rows, ("a", "b"))
    changes = mutate.Writer(spark, table, now=NOW).batch(rows, [mutate.Action("update", {"a": r.a, "b": r.b, "n": None}) for r in rows.collect()]).changes
    trail = history.trail(changes, "t", ["a", "b"], "me", NOW)
    for r in rows.collect():
        key = {"a": r.a, "b": r.b}
        [found] = history.of_entity(trail, "t", key).collect()
        assert '"n":null' in found.after
        erased = history.erase(trail, "t", key, NOW)
        assert history.of_entity(erased, "t", key).filter("before IS NULL").count() == 2 and erased.filter("before IS NOT NULL").count() == 1


def test_outbox_payloads(spark):
    rows = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "k int, name string, tenant int")
    m = Model()
    table = m.add("t", rows, ("k",))
    changes = mutate.Writer(spark, table, now=NOW).batch(rows, [mutate.Action("update", {"k": 1, "name": None}), mutate.Action("delete", {"k": 2})]).changes
    seen = {mode: {r.op: (r.payload, r.tenant) for r in history.outbox(changes, "t", ["k"], NOW, mode, "tenant").collect()} for mode in ("changed", "full", "keys")}
    assert seen["changed"] == {"update": ('{"k":1,"name":null}', "7"), "delete": ('{"k":2}', "8")}
    assert seen["full"] == {"update": ('{"k":1,"name":null,"tenant":7}', "7"), "delete": ('{"k":2,"name":"b","tenant":8}', "8")}
    assert seen["keys"] == {"update": ('{"k":1}', "7"), "delete": ('{"k":2}', "8")}
    with pytest.raises(ModelError):
        history.outbox(changes, "t", [], NOW)


def test_outbox_rounds(spark, widgets):
    table, rows = widgets
    changes = mutate.Writer(spark, table, now=NOW).batch(rows, [mutate.Action("update", {"id": k, "name": "z"}) for k in (1, 2)]).changes
    box = history.outbox(changes, "widgets", ["id"], NOW)
    later = box.withColumn("created_at", F.lit(NOW + dt.timedelta(1))).withColumn("id", F.col("id") + 1)
    box = box.unionByName(later)
    first = history.due(box, NOW).collect()
    assert len(first) == 2 and {r.created_at for r in first} == {NOW}
    results = spark.createDataFrame([(first[0].id, True), (first[1].id, False)], "id long, ok boolean")
    box = history.delivered(box, results, NOW)
    following = history.due(box, NOW).collect()
    assert len(following) == 1 and following[0].key == first[0].key
    again = history.due(box, NOW + dt.timedelta(minutes=10)).collect()
    assert len(again) == 2
    for _ in range(history.MOST_ATTEMPTS):
        box = history.delivered(box, spark.createDataFrame([(first[1].id, False)], "id long, ok boolean"), NOW)
    assert box.filter("dead").count() == 1
    assert history.backoff(1, lambda: 1.0) == dt.timedelta(seconds=1) and history.backoff(30, lambda: 1.0) == dt.timedelta(minutes=5)
    chosen = history.Subscription(frozenset({"widgets"}), None, ("name",)).select(box)
    assert "name" not in json.loads(chosen.first().payload)
    envelope = json.loads(history.cloud_events(box, "/shop").first().envelope)
    assert envelope["specversion"] == "1.0" and envelope["type"] == "widgets.update"


def test_retention(spark):
    rule = history.parse_retention("retain: 90d", "deleted_at")
    rows = spark.createDataFrame([(1, NOW - dt.timedelta(days=91)), (2, NOW - dt.timedelta(days=90)), (3, None)], "id int, deleted_at timestamp_ntz")
    assert [r.id for r in history.expired(rows, rule, NOW).collect()] == [1]
    assert sorted(r.id for r in history.swept(rows, rule, NOW).collect()) == [2, 3]
    assert history.parse_retention("ttl: 12h after ts", None) == history.Retention("ttl", dt.timedelta(hours=12), "ts")
    for bad in ("retain: 90d", "ttl: 3d", "retain: 3w", "ttl: 0d after x"):
        with pytest.raises(ModelError):
            history.parse_retention(bad, None)


def test_workflows():
    flow = history.Workflow(
        [("query", {"name": "found", "table": "{{input.table}}"}), ("branch", {"cases": [{"equals": ["{{found}}", "orders"], "steps": [("audit", {"message": "saw {{found}}"})]}, {"steps": [("audit", {"message": "else"})]}]}), ("policy-check", {"role": "boss"})],
        {"query": lambda settings, state: settings["table"]},
    )
    assert flow.run({"table": "orders"}, frozenset({"boss"}))["log"] == ["saw orders"]
    with pytest.raises(AccessDenied):
        flow.run({"table": "x"})
    assert history.scheduled(dt.timedelta(hours=1), None, NOW) and not history.scheduled(dt.timedelta(hours=1), NOW, NOW)


# Sources and streams


def test_sources(spark, star, tmp_path):
    region = star.frame(star.table("region"))
    for kind in ("parquet", "orc", "json", "csv"):
        tables.write_files(region, str(tmp_path / kind), kind)
        back = tables.read_files(spark, str(tmp_path / kind), kind, region.schema if kind in ("json", "csv") else None)
        assert sorted(back.collect()) == sorted(region.collect())
    with pytest.raises(ModelError):
        tables.read_files(spark, "x", "csv")
    tables.write_files(star.frame(star.table("nation")), str(tmp_path / "nation.parquet"), partition=["n_regionkey"])
    assert tables.model_of_folder(spark, str(tmp_path), {"nation": ("n_nationkey",)}).table("nation").keys == ("n_nationkey",)
    assert tables.introspection(spark, star).filter("table = 'orders' AND is_key").count() == 1
    assert json.loads(tables.export_schema(star))
    options = tables.jdbc_options("postgresql", "h/db", "t", ("id", 0, 10, 4))
    assert options["url"] == "jdbc:postgresql://h/db" and options["numPartitions"] == "4"
    (tmp_path / "blob").mkdir()
    (tmp_path / "blob" / "a.bin").write_bytes(b"\0\1")
    assert tables.blobs(spark, str(tmp_path / "blob")).first().bytes == 2
    calls = tables.Procedures()
    calls.register("first", lambda n: region.limit(n), ("n",))
    assert calls.call("first", n=2).count() == 2
    with pytest.raises(ModelError):
        calls.call("first")
    saved = tables.SavedObjects(spark, str(tmp_path / "saved"))
    saved.save("me", "q1", {"a": [1]})
    assert saved.load("me", "q1") == {"a": [1]}
    with pytest.raises(ModelError):
        saved.load("me", "../q1")


def test_event_stream(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    source = str(tmp_path / "in")
    rows.repartition(2).write.parquet(source)
    stream = events.tumbling(spark.readStream.schema(rows.schema).parquet(source), "1 hour")
    run = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("hours").collect()}
    assert got == {(r.start, r.event_type): r.n for r in events.tumbling(rows, "1 hour").collect()}
    assert events.deduplicated(rows.union(rows)).count() == rows.count()
    assert events.sliding(rows, "2 hours", "1 hour").agg(F.sum("n")).first()[0] == 2 * rows.count()


def test_outbox_stream(spark, widgets, tmp_path):
    table, rows = widgets
    changes = mutate.Writer(spark, table, now=NOW).batch(rows, [mutate.Action("update", {"id": k, "name": "z"}) for k in (1, 2)]).changes
    box = history.outbox(changes, "widgets", ["id"], NOW)
    box.write.parquet(str(tmp_path / "box"))
    sink = drain.FileSink(str(tmp_path / "out"))
    for _ in range(2):  # the second run finds nothing new
        drain.drain(spark, str(tmp_path / "box"), box.schema, str(tmp_path / "state"), sink, "/shop", once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_dispatcher_retries_in_key_order(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a") for k in (1, 2, 3)], "k int, name string")
    table = Model().add("t", rows, ("k",))
    changes = mutate.Writer(spark, table, now=NOW).batch(rows, [mutate.Action("update", {"k": k, "name": "z"}) for k in (1, 2, 3)]).changes
    box = history.outbox(changes, "t", ["k"], NOW)
    box = box.unionByName(box.withColumns({"created_at": F.lit(NOW + dt.timedelta(1)), "id": F.col("id") + 1}))
    folder, work, seen, now = str(tmp_path / "box"), str(tmp_path / "work"), [], [NOW]

    def deliver(envelopes, number):
        """The second key's receiver is down."""
        key = F.get_json_object("envelope", "$.subject")
        seen.append(sorted(r[0] for r in envelopes.select(key).collect()))
        return envelopes.select("id", (key != '{"k":2}').alias("ok"))

    for step in range(7):
        (box if not step else box.limit(1).withColumns({"id": F.lit(-1 - step).cast("long"), "key": F.lit('{"k":9}')})).write.mode("append").parquet(folder)
        drain.dispatch(spark, folder, box.schema, work, deliver, "/shop", clock=lambda: now[0], once=True).awaitTermination(120)
        now[0] += dt.timedelta(minutes=10)
    one, two, three, nine = ('{"k":%d}' % k for k in (1, 2, 3, 9))
    assert seen[0] == [one, two, three] and seen[1] == [one, two, three, nine] and seen[2:] == [[two, nine]] * 5
    closed = spark.read.parquet(f"{work}/closed")
    assert closed.filter("dead").count() == 1 and closed.filter("dispatched_at IS NOT NULL").count() == 4 + 6
    assert [r.attempts for r in spark.read.parquet(f"{work}/open/6").collect()] == [2]


def test_writer_holds_tokens_and_states(spark, widgets):
    table, rows = widgets
    act = mutate.Action
    table.metadata.update({"concurrency-token": "version", "state-column": "state", "state-initial": "draft", "state-transitions": "draft->live[chief]; live->draft"})
    w = mutate.Writer(spark, table, Context(roles=frozenset({"chief"})), NOW)
    done = {r.id: (r.state, r.version) for r in w.batch(rows, [act("update", {"id": 1, "version": 1, "state": "Live"}), act("insert", {"id": 3, "state": "Draft"})]).rows.collect()}
    assert done == {1: ("Live", 2), 2: ("live", 1), 3: ("Draft", None)}
    with pytest.raises(ModelError):
        w.update(rows, {"id": 1, "name": "x"})
    full = rows.withColumn("version", F.lit((1 << 31) - 1))
    plain = mutate.Writer(spark, table, now=NOW)
    for bad, frame, who in (
        ({"id": 1, "version": 2, "name": "x"}, rows, w),
        ({"id": 9, "version": 1, "name": "x"}, rows, w),
        ({"id": 1, "version": (1 << 31) - 1, "name": "x"}, full, w),
        ({"id": 1, "version": 1, "state": "gone"}, rows, w),
        ({"id": 1, "version": 1, "state": "live"}, rows, plain),
    ):
        with pytest.raises(Exception, match="conflict|at its end|state of"):
            who.update(frame, bad).rows.collect()
    with pytest.raises(Exception, match="state of"):
        w.insert(rows, {"id": 4, "state": "live"}).changes.collect()


def test_writer_seals_columns(spark):
    rows = spark.createDataFrame([(1, None, None)], "id int, mail string, mail_token string")
    table = Model().add("people", rows, ("id",))
    table.columns["mail"].metadata.update({"encrypt": "true", "blind-index": "mail_token"})
    keys = {1: b"k" * 32}
    w = mutate.Writer(spark, table, now=NOW, keys=keys)
    after = w.batch(rows, [mutate.Action("update", {"id": 1, "mail": "a@b"}), mutate.Action("insert", {"id": 2, "mail": "c@d"})]).rows
    got = after.select("id", "mail", "mail_token", crypto.decrypt(F.col("mail"), keys, crypto.place(table.schema, "people", "mail")).alias("plain")).collect()
    assert {r.id: (r.plain, r.mail_token) for r in got} == {1: ("a@b", crypto.blind_token("a@b", keys[1])), 2: ("c@d", crypto.blind_token("c@d", keys[1]))}
    assert all(r.mail not in ("a@b", "c@d") for r in got)
    with pytest.raises(ModelError):
        mutate.Writer(spark, table).update(rows, {"id": 1, "mail": "x"})
    with pytest.raises(AccessDenied):
        w.update(rows, {"id": 1, "mail_token": "x"})


def test_deletes_by_predicate_and_hard(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, "a", None, None), (3, None, None, None)], "id int, name string, gone timestamp_ntz, gone_by int")
    table = Model().add("t", rows, ("id",))
    w = mutate.Writer(spark, table, Context({"user_id": 7}), NOW)
    assert [r.id for r in w.delete_where(rows, {"name": "a"}).rows.collect()] == [3]
    assert [r.id for r in w.delete_where(rows, {"name": None}).changes.collect()] == [3]
    plan = w.delete_where(rows, {"name": "a"}).rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    table.metadata.update({"soft-delete": "gone", "soft-delete-by": "gone_by", "soft-delete-hard-role": "janitor"})
    marked = w.delete_where(rows, {"name": "a"}).rows.collect()
    assert {r.id: (r.gone, r.gone_by) for r in marked} == {1: (NOW, 7), 2: (NOW, 7), 3: (None, None)}
    with pytest.raises(AccessDenied):
        w.delete(rows, {"id": 1}, hard=True)
    with pytest.raises(ModelError):
        w.delete_where(rows, {})
    w = mutate.Writer(spark, table, Context({"user_id": 7}, roles=frozenset({"janitor"})), NOW)
    out = w.delete(rows, {"id": 1}, hard=True)
    assert sorted(r.id for r in out.rows.collect()) == [2, 3] and out.changes.first().after is None


def test_rules_of_types(spark):
    rows = spark.createDataFrame([(1, dt.date(2020, 1, 1), 3)], "id int, day date, n int").withColumns({"price": F.lit(1).cast("decimal(5,2)"), "raw": F.lit(b"abc")})
    table = Model().add("t", rows, ("id",))
    table.columns["day"].metadata["min"] = "2020-06-01"
    table.columns["n"].metadata["step"] = "2"
    table.columns["raw"].metadata["maxbytes"] = "2"
    assert mutate.faults(rows, table).first().faults == ["day:min", "n:step", "raw:maxbytes"]
    found = lambda name, value: [r for _, r in mutate.rule_faults(table.columns[name], value)]
    assert found("day", dt.date(2020, 1, 1)) == ["min"] and found("raw", b"abc") == ["maxbytes"] and found("n", 1 << 31) == ["range"]
    assert found("price", 1.234) == ["scale"] and found("price", 1000) == ["precision"] and found("price", 999.99) == [] and found("price", 100) == []


def test_approvals(spark, widgets):
    table, rows = widgets
    done = mutate.Writer(spark, table, now=NOW).batch(rows, [mutate.Action("update", {"id": 1, "name": "z"}), mutate.Action("delete", {"id": 2}), mutate.Action("insert", {"id": 7})])
    queue = mutate.pending(done.changes, "widgets", "me", NOW)
    ids = {r.op: r.id for r in queue.collect()}
    said = spark.createDataFrame([(ids["update"], True, "you", NOW), (ids["delete"], False, "you", NOW)], "id long, approve boolean, decider string, decided_at timestamp_ntz")
    queue = mutate.decided(queue, said)
    assert {r.op: (r.state, r.decider) for r in queue.collect()} == {"update": ("approved", "you"), "delete": ("rejected", "you"), "insert": ("pending", None)}
    again = mutate.decided(queue, said.withColumns({"approve": ~F.col("approve"), "decider": F.lit("other")}))
    assert {r.op: (r.state, r.decider) for r in again.collect()}["delete"] == ("rejected", "you")
    after = mutate.replay(rows, mutate.approved(queue, rows, ["id"]), ["id"])
    assert {r.id: r.name for r in after.collect()} == {1: "z", 2: "b"}
    assert mutate.approved(queue, rows.withColumn("name", F.lit("moved")), ["id"]).count() == 0


# Lists, memberships, tools and sinks


def test_seek_reads_all_rows_once(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4, float(i % 2) if i % 5 else None) for i in range(23)], "id int, a int, b double")
    m = Model()
    m.add("t", rows, ("id",))
    for sort in (["a_asc"], ["a_desc"], ["b_desc", "a_asc"], ["a_asc", "b_desc", "id_desc"]):
        c, seen, cursor = Compiler(m), [], ""
        while True:
            page, cursor = listing.seek_rows(c, "t", ["id"], b"s", cursor, size=4, sort=sort)
            seen += [r.id for r in page.collect()]
            if not cursor:
                break
        assert seen == [r.id for r in c.flat(Query("t", ["id"], sort=sort, limit=UNLIMITED)).collect()]
    _, cursor = listing.seek_rows(c, "t", ["id"], b"s", size=4)
    for other in ({"size": 4, "sort": ["a_asc"]}, {"document": {"a": {"_eq": 1}}}):
        with pytest.raises(ModelError):
            listing.seek_rows(c, "t", ["id"], b"s", cursor, **other)
    for bad in ("x", "a" * 5000, cursor[:-6]):
        with pytest.raises(ModelError):
            listing.seek_rows(c, "t", ["id"], b"s", bad, size=4)
    assert listing.seek_rows(c, "t", ["id"], b"s", document={"a": {"_eq": 9}})[1] == ""


def test_get_and_stream(star):
    c = Compiler(star)
    assert listing.get_row(c, "region", [3]).first().r_regionkey == 3
    assert listing.get_row(c, "region", [99]).count() == 0
    with pytest.raises(ModelError):
        listing.list_rows(c, {"table": "orders", "sort": ["o_orderkey_asc"] * 33}, b"s")
    assert listing.stream_rows(c, {"table": "orders", "page_size": 2}).count() == star.frame(star.table("orders")).count()


def test_memberships(spark, blog):
    c = Compiler(blog)
    blog.replace("tags", spark.createDataFrame([(1, "a,b"), (2, "#c"), (3, 'd"\\ ')], "id int, name string"))
    posts, tags = ldap.Entries("posts", "cn", "id", "ou=posts"), ldap.Entries("tags", "uid", "name", "ou=tags")
    found = {tuple(r) for r in ldap.members(c, posts, "tags", tags).collect()}
    assert ("cn=1,ou=posts", "uid=a\\,b,ou=tags") in found and ("cn=2,ou=posts", "uid=\\#c,ou=tags") in found and len(found) == 5
    assert ("cn=1,ou=posts", 'uid=d\\"\\\\\\ ,ou=tags') in found
    assert {(b, a) for a, b in found} == {tuple(r) for r in ldap.member_of(c, tags, posts, "tags").collect()}
    mine = ldap.Entries("posts", "cn", "id", "ou=posts", Cmp("id", "_eq", 1))
    assert ldap.members(c, mine, "tags", tags).count() == 3 == ldap.member_of(c, tags, mine, "tags").count()
    assert ldap.members(c, ldap.Entries("blogs", "cn", "id", "ou=b"), "posts", posts).count() == 4
    for wrong in ("blogs", "nothing"):
        with pytest.raises(ModelError):
            ldap.members(c, posts, wrong, tags)
    with pytest.raises(ModelError):
        ldap.member_of(c, posts, ldap.Entries("blogs", "cn", "id", "ou=b"), "posts")
    blog.table("tags").metadata["policy-read-deny"] = "name"
    with pytest.raises(AccessDenied):
        ldap.members(c, posts, "tags", tags)


def test_odata_metadata(spark):
    import xml.etree.ElementTree as ET

    star = sample_model(spark, SF)
    star.table("supplier").metadata["visibility"] = "hidden"
    text = odata.metadata(Compiler(star))
    assert ET.fromstring(text.split("?>", 1)[1]) is not None
    assert 'Name="supplier"' not in text and "Main.supplier" not in text
    assert '<NavigationProperty Name="customer" Type="Main.customer"/>' in text and 'Type="Collection(Main.orders)"' in text
    assert '<EntitySet Name="orders"' in text and '<EntitySet Name="lineitem"' not in text


def test_write_tools(spark):
    table = Model().add("t", spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, l string, v string"), ("k", "l"))
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, l string, v string")
    calls = intent.write_tools({"t": mutate.Writer(spark, table)})
    assert calls["update"](rows, "t", id="1|a", set={"v": "z"}).changes.count() == 1
    assert calls["update"](rows, "t", id=[1, "b"], set={"v": "z"}).changes.count() == 0
    assert [tuple(r) for r in calls["delete"](rows, "t", id=[2, "b"]).rows.collect()] == [(1, "a", "x")]
    assert calls["insert"](rows, "t", values={"k": 3, "l": "c"}).rows.count() == 3
    for bad in (lambda: calls["update"](rows, "t", id="1", set={"v": "z"}), lambda: calls["update"](rows, "t", id="q|a", set={"v": "z"}), lambda: calls["update"](rows, "t", id="1|a", set={"l": "z"}), lambda: calls["delete"](rows, "u", id=1)):
        with pytest.raises(ModelError):
            bad()


def test_database_round_trip(spark, star, tmp_path):
    rows = star.frame(star.table("customer"))
    address = f"{tmp_path}/db;create=true"
    tables.write_jdbc(rows.repartition(2), "derby", address, "customer")
    back = tables.read_jdbc(spark, "derby", address, "customer", partition=("c_custkey", 0, 150, 3))
    assert back.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in back.select(*[F.col(c) for c in rows.columns]).collect()) == sorted(tuple(r) for r in rows.collect())
    few = back.filter("c_custkey < 10")
    assert few.count() == rows.filter("c_custkey < 10").count()
    assert "PushedFilters: [*IsNotNull(c_custkey), *LessThan(c_custkey,10)]" in few._jdf.queryExecution().toString()


def test_blob_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"\0\1"), ("b", b"\0\1"), ("c", None), ("d", b"")], "name string, content binary")
    stored = {r.name: r for r in tables.write_blobs(rows, str(tmp_path / "blobs"), "name", "content").collect()}
    assert stored["a"].digest == stored["b"].digest and stored["c"].digest is None and stored["c"].bytes is None and stored["d"].bytes == 0
    assert sorted(p.name for p in (tmp_path / "blobs").iterdir()) == sorted({stored["a"].digest, stored["d"].digest})


def test_parallel_steps_fail_together():
    def step(settings, state):
        if settings["name"] == "bad":
            raise ModelError("bad")
        return settings["name"]

    groups = [[("step", {"name": "x"}), ("step", {"name": "y"})], [("step", {"name": "z"})]]
    state = history.Workflow([("parallel", {"groups": groups})], {"step": step}).run({})
    assert [state[n] for n in "xyz"] == list("xyz")
    with pytest.raises(ModelError):
        history.Workflow([("parallel", {"groups": [*groups, [("step", {"name": "bad"})]]})], {"step": step}).run({})
