"""Random filter trees, as filter documents here and as SQL there."""

import random

import duckdb
import pytest

from loomspan.operators import filters
from loomspan.plans.compile import Compiler
from loomspan.plans.model import sample_model
from loomspan.plans.nodes import UNLIMITED, Query

SF = "/root/testdata/sf0.001"
NUMBERS = {"o_totalprice": (1000.0, 300000.0), "o_custkey": (0, 150)}
TEXTS = {"o_orderstatus": ["F", "O", "P", "x"], "o_orderpriority": ["1-URGENT", "2-HIGH", "-", "LOW"]}
SQL_OPS = {"_eq": "=", "_neq": "<>", "_lt": "<", "_lte": "<=", "_gt": ">", "_gte": ">="}
TEXT_FUNCTIONS = {"contains": "contains", "starts_with": "starts_with", "ends_with": "ends_with"}


def quoted(v):
    return f"'{v}'" if isinstance(v, str) else str(v)


def leaf(rng):
    if rng.random() < 0.5:
        name = rng.choice(list(NUMBERS))
        low, high = NUMBERS[name]
        value = lambda: rng.randint(low, high) if isinstance(low, int) else round(rng.uniform(low, high), 2)
    else:
        name = rng.choice(list(TEXTS))
        value = lambda: rng.choice(TEXTS[name])
    kind = rng.choice(["compare", "in", "between", "null", "text"])
    if kind == "text" and name in TEXTS:
        op, v = rng.choice(list(TEXT_FUNCTIONS)), value()
        no = rng.choice(["", "n"])
        return {name: {f"_{no}{op}": v}}, f"{'NOT ' if no else ''}{TEXT_FUNCTIONS[op]}({name}, {quoted(v)})"
    if kind == "in":
        values, no = [value() for _ in range(rng.randint(0, 4))], rng.choice(["", "n"])
        sql = f"{name} {'NOT ' if no else ''}IN ({', '.join(map(quoted, values))})" if values else ("TRUE" if no else "FALSE")
        return {name: {f"_{no}in": values}}, sql
    if kind == "between":
        a, b = sorted([value(), value()])
        no = rng.choice(["", "n"])
        return {name: {f"_{no}between": [a, b]}}, f"{name} {'NOT ' if no else ''}BETWEEN {quoted(a)} AND {quoted(b)}"
    if kind == "null":
        yes = rng.random() < 0.5
        return {name: {"_null": yes}}, f"{name} IS {'' if yes else 'NOT '}NULL"
    op, v = rng.choice(list(SQL_OPS)), value()
    return {name: {op: v}}, f"{name} {SQL_OPS[op]} {quoted(v)}"


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return leaf(rng)
    key = rng.choice(["and", "or"])
    parts = [tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    return {key: [d for d, _ in parts]}, "(" + f" {key.upper()} ".join(s for _, s in parts) + ")"


@pytest.mark.parametrize("seed", range(25))
def test_random_filters(spark, seed):
    document, sql = tree(random.Random(seed), 3)
    model = sample_model(spark, SF)
    part = filters.parse(document, model, model.table("orders"))
    rows = Compiler(model).flat(Query("orders", ["o_orderkey"], filter=part, limit=UNLIMITED))
    want = duckdb.sql(f"SELECT o_orderkey FROM '{SF}/orders.parquet' WHERE {sql}").fetchall()
    assert sorted(r[0] for r in rows.collect()) == sorted(r[0] for r in want)
