"""Key-value reads over tables: a key is ``table:k1:k2``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keys
from ..operators.mutate import Outcome, Writer
from ..plans.compile import Compiler
from ..plans.model import ModelError, Table


class KeyValue:
    """GET, MGET, EXISTS, TYPE, HGETALL, HGET, SCAN, SET, HSET and DEL; writes give the rows after them."""

    def __init__(self, compiler: Compiler, spark: SparkSession):
        self.compiler, self.spark = compiler, spark

    def _split(self, names: list[str]) -> tuple[Table, list[tuple]]:
        tables = {n.split(":")[0] for n in names}
        if len(tables) != 1:
            raise ModelError("keys of one table at a time")
        table = self.compiler.model.table(tables.pop())
        casts = [table.columns[k].type for k in table.keys]
        out = []
        for n in names:
            parts = n.split(":")[1:]
            if len(parts) != len(table.keys):
                raise ModelError(f"{n}: {table.name} has {len(table.keys)} key columns")
            out.append(tuple(int(p) if k.typeName() in ("integer", "long", "short") else p for p, k in zip(parts, casts)))
        return table, out

    def mget(self, names: list[str]) -> DataFrame:
        """(ordinal, key, value) with the row as JSON, null where there is none."""
        table, wanted = self._split(names)
        rows = keys.multi_get(self.compiler, self.spark, table, wanted, list(table.columns))
        value = F.when(F.col(table.keys[0]).isNotNull(), F.to_json(F.struct(*table.columns)))
        named = F.element_at(F.array(*map(F.lit, names)), F.col("ordinal") + 1)
        return rows.select("ordinal", named.alias("key"), value.alias("value"))

    def get(self, name: str) -> DataFrame:
        return self.mget([name])

    def hgetall(self, name: str) -> DataFrame:
        """(field, value) of one row, nulls left out."""
        table, wanted = self._split([name])
        rows = keys.multi_get(self.compiler, self.spark, table, wanted, list(table.columns))
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in table.columns])
        return rows.select(F.explode(cells).alias("c")).select("c.*").filter("value IS NOT NULL")

    def hget(self, name: str, field: str) -> DataFrame:
        return self.hgetall(name).filter(F.col("field") == field)

    def exists(self, names: list[str]) -> DataFrame:
        """How many of the keys there are."""
        return self.mget(names).agg(F.count("value").alias("n"))

    def type(self, name: str) -> DataFrame:
        return self.mget([name]).select(F.when(F.col("value").isNotNull(), "hash").otherwise("none").alias("type"))

    def scan(self, table: str, count: int, cursor: list | None = None) -> DataFrame:
        """Keys behind the cursor, one more than ``count`` if there are more."""
        target = self.compiler.model.table(table)
        rows = keys.keyset_page(self.compiler, target, count, cursor)
        return rows.select(F.concat_ws(":", F.lit(target.name), *[F.col(k).cast("string") for k in target.keys]).alias("key"))

    def _writer(self, name: str) -> tuple[Writer, DataFrame, dict]:
        table, [key] = self._split([name])
        writer = Writer(self.spark, table, self.compiler.context)
        return writer, self.compiler.model.frame(table), dict(zip(table.keys, key))

    def hset(self, name: str, **fields) -> Outcome:
        """One row's fields; a key that is not there is inserted."""
        writer, rows, key = self._writer(name)
        return writer.upsert(rows, key | fields)

    def set(self, name: str, value: str) -> Outcome:
        """A whole row as JSON."""
        return self.hset(name, **json.loads(value))

    def delete(self, name: str) -> Outcome:
        writer, rows, key = self._writer(name)
        return writer.delete(rows, key)
