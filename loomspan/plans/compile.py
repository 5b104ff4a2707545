"""Query trees to DataFrames: flat rows, nested pages, explicit joins, aggregates over links."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import expr as expressions
from ..operators import filters
from .model import Model, ModelError, Table
from .nodes import UNLIMITED, And, Cmp, Filter, Join, Query, Ref, Through, both
from .policy import ANYONE, Context, Policy

#: Left and right rows of one value that meet in one cell of an explicit join's rows.
CELL = (2048, 65536)

#: Stored rows behind a collection link from which on its tasks are numbered by them, and rows a task then.
MANY, TASK = 1_000_000, 250_000
#: Estimated bytes of parents from which on they count as many.
MANY_PARENTS = 1 << 20
#: Pieces in which the rows of a parent are ranked first.
PIECES = 16


@dataclass
class Page:
    """Rows of one page; ``total`` counts all that match, as a one-row DataFrame."""

    rows: DataFrame
    total: DataFrame
    offset: int
    limit: int


class Compiler:
    """Compiles query trees over a model for one caller."""

    def __init__(self, model: Model, policy: Policy | None = None, context: Context = ANYONE):
        self.model, self.policy, self.context = model, policy or Policy(), context

    # Scans

    def scan(self, table: Table, part: Filter | None = None, deleted: str = "hide") -> DataFrame:
        """Rows of a table that the caller may see and that satisfy ``part``."""
        part = self.policy.blinded(table, part)
        self._guard_filter(table, part)
        full = both(self.policy.row_filter(table, self.context, deleted), part)
        return filters.where(self.model.frame(table), full, self.model, table, lambda t, f: self.scan(t, f))

    def _guard_filter(self, table: Table, part: Filter | None) -> None:
        names = filters.columns_of(part, table)
        self.policy.guard_read(table, names, self.context)
        self.policy.guard_use(table, names)
        for p in part.parts if isinstance(part, And) else [part]:
            if isinstance(p, Through) and p.link not in table.single_links:
                raise ModelError(f"{table.name} has no link {p.link}")

    def rows(self, query: Query) -> DataFrame:
        """All stored columns of the rows that a query selects, before its page."""
        table = self.model.table(query.table)
        self.policy.observe("parsed", table.name)
        rows = self.scan(table, query.filter, query.deleted)
        self.policy.observe("transformed", table.name, plan=rows)
        return rows

    # Order and pages

    def order(self, table: Table, tokens: list[str]) -> list[Column]:
        """``column_asc`` or ``column_desc``; ties end at the key, or at all columns of a table without one."""
        out, seen = [], set()
        for token in tokens:
            name, _, direction = token.rpartition("_")
            if direction not in ("asc", "desc"):
                raise ModelError(f"sort {token!r}")
            column = table.column(name)
            self.policy.guard_read(table, {column.name}, self.context)
            self.policy.guard_use(table, {column.name})
            seen.add(column.name)
            out.append(F.col(column.name).asc_nulls_first() if direction == "asc" else F.col(column.name).desc_nulls_last())
        rest = table.keys or tuple(table.columns)
        return out + [F.col(c).asc_nulls_first() for c in rest if c not in seen]

    def page_rows(self, query: Query) -> DataFrame:
        """The root page with all stored columns; ``orderBy`` and ``limit`` become one top-k."""
        table = self.model.table(query.table)
        offset, limit = query.page()
        rows = self.rows(query)
        if limit == UNLIMITED and not offset:
            return rows.orderBy(*self.order(table, query.sort)) if query.sort else rows
        rows = rows.orderBy(*self.order(table, query.sort))
        rows = rows.offset(offset) if offset else rows
        return rows if limit == UNLIMITED else rows.limit(limit)

    # Projection

    def project(self, table: Table, query: Query) -> list[Column]:
        names = query.columns or ([] if query.links or query.aggregates or query.computed else list(table.columns))
        self.policy.guard_read(table, set(names), self.context)
        out = [self.policy.shown(table, n, F.col(table.column(n).name), self.context).alias(query.aliases.get(n, n)) for n in names]
        for alias, expr in query.computed.items():
            used: set[str] = set()
            out.append(expressions.lower(expr, lambda n: used.add(n) or F.col(table.column(n).name)).alias(alias))
            self.policy.guard_read(table, used, self.context)
            self.policy.guard_use(table, used)
        return out

    def flat(self, query: Query) -> DataFrame:
        """Rows of the page without links: columns, computed columns and aggregates over links."""
        table = self.model.table(query.table)
        rows = self.page_rows(query)
        rows, extra = self._with_aggregates(rows, table, query)
        return rows.select(*self.project(table, query), *extra)

    def watched(self, query: Query) -> tuple[DataFrame, Observation]:
        """Nested rows, and an observation that has their number once they have been read."""
        seen = Observation()
        rows = self.nested(query).observe(seen, F.count(F.lit(1)).alias("rows"))
        return rows, seen

    def executed(self, query: Query, seen: Observation, seconds: float) -> None:
        """Tell the observers what a watched query came to."""
        self.policy.observe("executed", query.table, rows=seen.get["rows"], seconds=seconds)

    def total(self, query: Query) -> DataFrame:
        """One row: how many rows the query selects regardless of its page."""
        return self.rows(query).agg(F.count("*").cast("int").alias("total"))

    def page(self, query: Query) -> Page:
        offset, limit = query.page()
        return Page(self.nested(query), self.total(query), offset, limit)

    # Links

    def nested(self, query: Query) -> DataFrame:
        """Rows of the page with a struct for each link to one row and a page struct for each to many."""
        table = self.model.table(query.table)
        rows = self.page_rows(query)
        return self._expand(rows, table, query, "__")

    def _single(self, rows: DataFrame, table: Table, name: str, inner: Query, mark: str) -> tuple[DataFrame, Column]:
        """A left join with the parent; one that the caller may not see is null."""
        link = table.single_links[name]
        target = self.model.table(link.parent)
        parents = self.scan(target, inner.filter, inner.deleted)
        keys = [F.col(c).alias(f"{mark}_{i}") for i, c in enumerate(link.parent_columns)]
        inside = self._inside(parents, target, inner, keys, mark)
        on = [F.col(c) == F.col(f"{mark}_{i}") for i, c in enumerate(link.child_columns)]
        return rows.join(inside, functools.reduce(operator.and_, on), "left"), F.col(mark)

    def _inside(self, df: DataFrame, table: Table, inner: Query, keys: list[Column], mark: str) -> DataFrame:
        """(keys, struct ``mark``) of linked rows, with their own links expanded."""
        names = [f"{mark}_{i}" for i in range(len(keys))]
        df = df.select("*", *keys)
        bare = Query(table.name, inner.columns, inner.aliases, links=inner.links, link_names=inner.link_names, joins=inner.joins, aggregates=inner.aggregates, computed=inner.computed)
        kept = df.select("*", F.struct(*[F.col(n) for n in names]).alias(f"{mark}_k"))
        expanded = self._expand(kept, table, bare, f"{mark}_k", [F.col(f"{mark}_k")])
        own = [c for c in expanded.columns if c != f"{mark}_k"]
        return expanded.select(*[F.col(f"{mark}_k.{n}").alias(n) for n in names], F.struct(*own).alias(mark))

    def _expand(self, df: DataFrame, table: Table, query: Query, mark: str, carried: list[Column] = ()) -> DataFrame:
        """Columns, aggregates, links and joins of the rows ``df``, after the columns ``carried``."""
        rows, extra = self._with_aggregates(df, table, query)
        shown = [*carried, *self.project(table, query), *extra]
        for k, (alias, inner) in enumerate(query.links.items()):
            name = query.link_names.get(alias, alias)
            if name not in table.single_links and name not in table.multi_links and name not in table.many_links:
                raise ModelError(f"{table.name} has no link {name}")
            step = self._single if name in table.single_links else self._collection
            rows, column = step(rows, table, name, inner, f"{mark}{k}")
            shown.append(column.alias(alias))
        for k, join in enumerate(query.joins):
            rows, column = self._explicit(rows, table, join, f"{mark}j{k}")
            shown.append(column.alias(join.alias))
        return rows.select(*shown)

    def children(self, table: Table, name: str, inner: Query) -> tuple[DataFrame, list[str], list[str], Table]:
        """(rows, columns that hold the parent's key, that key on the parent, table) behind a collection link."""
        if name in table.multi_links:
            link = table.multi_links[name]
            target = self.model.table(link.child)
            part = Cmp(link.predicate[0], "_eq", link.predicate[1]) if link.predicate else None
            rows = self.scan(target, both(part, inner.filter), inner.deleted)
            keys = [f"__key{i}" for i in range(len(link.child_columns))]
            rows = rows.select("*", *[F.col(c).alias(k) for c, k in zip(link.child_columns, keys)])
            return rows, keys, list(link.parent_columns), target
        bridge = table.many_links[name]
        target = self.model.table(bridge.target)
        rows = self.scan(target, inner.filter, inner.deleted)
        junction = self.scan(self.model.table(bridge.junction))
        pairs = junction.select(F.col(bridge.junction_source).alias("__key0"), F.col(bridge.junction_target).alias("__to"))
        if not bridge.has_payload:
            pairs = pairs.distinct()
        return rows.join(pairs, F.col(bridge.target_column) == F.col("__to")).drop("__to"), ["__key0"], [bridge.source_column], target

    def per_parent(self, rows: DataFrame, table: Table, name: str, inner: Query) -> tuple[DataFrame, list[str], list[str], Table]:
        """Children of the parents in ``rows``, each parent's page of them, with ``rn`` and ``total``.

        The count is an aggregate of its own, which combines before its shuffle; so the
        window has only ``row_number`` and Spark limits each group before its shuffle too.
        """
        found, keys, parent_columns, target = self.children(table, name, inner)
        offset, limit = inner.page()
        parents = rows.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(parent_columns)])
        on = [F.col(k) == F.col(f"__p{i}") for i, k in enumerate(keys)]
        if tasks := self._tasks(table, name, parents):
            return self._dealt(found, parents, keys, target, inner, tasks), keys, parent_columns, target
        found = found.join(parents, functools.reduce(operator.and_, on), "left_semi")
        totals = found.groupBy(*keys).agg(F.count("*").cast("int").alias("total"))
        ranked = found.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*self.order(target, inner.sort))))
        if limit != UNLIMITED:
            ranked = ranked.filter(F.col("rn") <= offset + limit)
        if offset:
            ranked = ranked.filter(F.col("rn") > offset)
        return ranked.join(totals, keys), keys, parent_columns, target

    def _tasks(self, table: Table, name: str, parents: DataFrame) -> int:
        """How many tasks the rows behind a link need; 0 if they are few or of few parents, where the session's number does."""
        if int(str(parents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < MANY_PARENTS:
            return 0
        stored = table.multi_links[name].child if name in table.multi_links else table.many_links[name].junction
        count = self.model.frame(self.model.table(stored)).count()
        return 0 if count <= MANY else max(parents.sparkSession.sparkContext.defaultParallelism, -(-count // TASK))

    def _dealt(self, found: DataFrame, parents: DataFrame, keys: list[str], target: Table, inner: Query, tasks: int) -> DataFrame:
        """``rn`` and ``total`` of many parents, by ``tasks`` that each hold about as many rows at any size of the input.

        Rows are ranked and counted in pieces of each parent first, so that one with very many
        sends only the page's rows and the counts of its pieces to its own task.  Parents meet
        their rows after that, for a semi join would be moved below it and sort all rows in the session's tasks.
        """
        offset, limit = inner.page()
        order = self.order(target, inner.sort)
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        if limit != UNLIMITED:
            pieces = [*keys, "__piece"]
            found = found.withColumn("__piece", F.pmod(F.xxhash64(*[F.col(c) for c in target.keys or target.columns]), F.lit(PIECES)))
            found = found.repartition(tasks, *pieces).withColumn("__rn", rank(*pieces)).withColumn("__total", F.count("*").over(Window.partitionBy(*pieces)))
            found = found.filter(F.col("__rn") <= offset + limit).withColumn("__total", F.when(F.col("__rn") == 1, F.col("__total")).otherwise(0)).drop("__piece")
        else:
            found = found.withColumn("__total", F.lit(1))
        asked = parents.repartition(tasks, *parents.columns).distinct()
        on = functools.reduce(operator.and_, [F.col(k) == F.col(p) for k, p in zip(keys, parents.columns)])
        found = found.repartition(tasks, *keys).join(asked, on).drop(*parents.columns)
        found = found.withColumn("__rn", rank(*keys)).withColumn("__total", F.sum("__total").over(Window.partitionBy(*keys)).cast("int"))
        if limit != UNLIMITED:
            found = found.filter((F.col("__rn") <= offset + limit) & (F.col("__rn") > offset))
        elif offset:
            found = found.filter(F.col("__rn") > offset)
        return found.withColumnsRenamed({"__rn": "rn", "__total": "total"})

    def _collection(self, rows: DataFrame, table: Table, name: str, inner: Query, mark: str) -> tuple[DataFrame, Column]:
        """A page struct for each parent; a parent without rows on the page gets total 0."""
        ranked, keys, parent_columns, target = self.per_parent(rows, table, name, inner)
        offset, limit = inner.page()
        carried = [F.col(k).alias(f"{mark}_{i}") for i, k in enumerate(keys)]
        carried += [F.col("rn").alias(f"{mark}_{len(keys)}"), F.col("total").alias(f"{mark}_{len(keys) + 1}")]
        inside = self._inside(ranked, target, inner, carried, mark)
        names = [f"{mark}_{i}" for i in range(len(keys))]
        rank, total = f"{mark}_{len(keys)}", f"{mark}_{len(keys) + 1}"
        grouped = inside.groupBy(*names).agg(
            F.first(total).alias(f"{mark}_total"),
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(mark)))), lambda x: x[mark]).alias(f"{mark}_data"),
        )
        on = [F.col(c) == F.col(n) for c, n in zip(parent_columns, names)]
        joined = rows.join(grouped, functools.reduce(operator.and_, on), "left")
        column = F.struct(
            F.coalesce(F.col(f"{mark}_total"), F.lit(0)).alias("total"),
            F.lit(offset).alias("offset"),
            F.lit(limit).alias("limit"),
            F.coalesce(F.col(f"{mark}_data"), F.array().cast(grouped.schema[f"{mark}_data"].dataType)).alias("data"),
        )
        return joined, column

    def flat_children(self, query: Query, name: str, inner: Query) -> DataFrame:
        """The same pages as rows: parent key, child columns, ``rn`` and ``total``."""
        table = self.model.table(query.table)
        rows = self.page_rows(query)
        ranked, keys, parent_columns, target = self.per_parent(rows, table, name, inner)
        own = self.project(target, inner)
        return ranked.select(*[F.col(k).alias(f"parent_{c}") for k, c in zip(keys, parent_columns)], *own, "rn", "total")

    # Explicit joins

    def _explicit(self, rows: DataFrame, table: Table, join: Join, mark: str) -> tuple[DataFrame, Column]:
        """Matches of each distinct left value as an array, or the first of them."""
        pairs = self.theta(rows, table, join)
        target = self.model.table(join.query.table)
        order = F.row_number().over(Window.partitionBy("__left").orderBy(*self.order(target, join.query.sort)))
        own = self.project(target, join.query)
        inside = pairs.select("__left", order.alias("__rn"), F.struct(*own).alias("__row"))
        if join.single:
            grouped = inside.filter("__rn = 1").select(F.col("__left").alias(f"{mark}_l"), F.col("__row").alias(mark))
        else:
            rows_of = F.transform(F.array_sort(F.collect_list(F.struct("__rn", "__row"))), lambda x: x["__row"])
            grouped = inside.groupBy(F.col("__left").alias(f"{mark}_l")).agg(rows_of.alias(mark))
        joined = rows.join(grouped, F.col(table.column(join.left).name) == F.col(f"{mark}_l"), "left")
        empty = F.col(mark) if join.single else F.coalesce(F.col(mark), F.array().cast(grouped.schema[mark].dataType))
        return joined, empty

    def theta(self, rows: DataFrame, table: Table, join: Join) -> DataFrame:
        """Rows of the joined table with ``__left``, the distinct left value each of them matches.

        Equality is a hash or merge join.  A range or pattern condition has no key to
        partition by; it compares with the distinct left values only.
        """
        left_column, target, right = self._sides(table, join)
        left = rows.select(F.col(left_column.name).alias("__left")).filter("__left IS NOT NULL").distinct()
        test = filters.predicate(F.col("__left"), join.op or "_eq", F.col(target.column(join.right).name), left_column.type)
        pairs = left.join(right, test, "inner")
        if join.query.limit not in (None, UNLIMITED):  # of all parents together
            pairs = pairs.orderBy("__left", *self.order(target, join.query.sort)).limit(join.query.limit)
        return pairs

    def _sides(self, table: Table, join: Join) -> tuple[Column, Table, DataFrame]:
        """(left column, joined table, its rows) of a join that the caller may make."""
        left_column = table.column(join.left)
        target = self.model.table(join.query.table)
        self.policy.guard_read(table, {left_column.name}, self.context)
        right = self.scan(target, join.query.filter, join.query.deleted)
        self.policy.guard_read(target, {target.column(join.right).name}, self.context)
        self.policy.guard_use(table, {left_column.name})
        self.policy.guard_use(target, {join.right})
        return left_column, target, right

    def flat_join(self, query: Query) -> DataFrame:
        """The query's one explicit join as rows: a row a match, its columns after the page's.

        A value's matches are the product of its rows on either side, so they are neither one
        array nor one task.  Each value has a grid: a left row goes to one line of it and a right
        row to one column, by the hash of its key, and they meet in one cell of about ``CELL`` rows.
        """
        table = self.model.table(query.table)
        if len(query.joins) != 1 or query.links:
            raise ModelError("rows of matches need one join and no links")
        join = query.joins[0]
        if join.single or join.query.limit not in (None, UNLIMITED) or join.query.offset or join.query.links or join.query.joins:
            raise ModelError("rows of matches have no pages")
        left_column, target, right = self._sides(table, join)
        rows, extra = self._with_aggregates(self.page_rows(query), table, query)
        right, more = self._with_aggregates(right, target, join.query)
        place = lambda t: F.xxhash64(*[F.col(c) for c in t.keys or t.columns]).alias("__h")
        rows = rows.select(F.col(left_column.name).alias("__l"), place(table), *self.project(table, query), *extra)
        right = right.select(F.col(target.column(join.right).name).alias("__r"), place(target), *self.project(target, join.query), *more)
        own, others = rows.columns[2:], right.columns[2:]
        if twice := set(own) & set(others):
            raise ModelError(f"two columns named {', '.join(sorted(twice))}")
        parts = [df.groupBy(F.col(c).alias(f"__g{c[2:]}")).agg(F.ceil(F.count("*") / n).alias(f"__n{c[2:]}")) for df, c, n in ((rows, "__l", CELL[0]), (right, "__r", CELL[1]))]
        grid = parts[0].join(parts[1], filters.predicate(F.col("__gl"), join.op or "_eq", F.col("__gr"), left_column.type))
        line = lambda n: F.pmod(F.col("__h"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        cell = lambda side, i, j: [F.col("__gl").alias(f"__{side}0"), F.col("__gr").alias(f"__{side}1"), i.alias(f"__{side}2"), j.alias(f"__{side}3")]
        rows = rows.join(grid, F.col("__l") == F.col("__gl")).select(*cell("l", line("__nl"), every("__nr")), *own)
        right = right.join(grid, F.col("__r") == F.col("__gr")).select(*cell("r", every("__nl"), line("__nr")), *others)
        session = rows.sparkSession
        tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
        rows, right = [df.repartition(tasks, *[f"__{side}{k}" for k in range(4)]) for df, side in ((rows, "l"), (right, "r"))]
        met = functools.reduce(operator.and_, [F.col(f"__l{k}") == F.col(f"__r{k}") for k in range(4)])
        return rows.join(right.hint("merge"), met).select(*own, *others)

    # Aggregates over links

    def _with_aggregates(self, rows: DataFrame, table: Table, query: Query) -> tuple[DataFrame, list[Column]]:
        extra = []
        for k, aggregate in enumerate(query.aggregates):
            grouped, source = self.correlated(self.rows(query) if query.filter is not None else self.scan(table, None, query.deleted), table, aggregate)
            grouped = grouped.select(F.col("__source").alias(f"__a{k}"), F.col("value").alias(f"__v{k}"))
            rows = rows.join(grouped, F.col(source) == F.col(f"__a{k}"), "left")
            extra.append(F.col(f"__v{k}").alias(aggregate.alias))
        return rows, extra

    def correlated(self, base: DataFrame, table: Table, aggregate) -> tuple[DataFrame, str]:
        """(source value, aggregate as double) over a chain of links, and the source column.

        The source rows are not made distinct: behind a first link to one row, siblings
        that share the parent each count, as in the source system.
        """
        if not aggregate.path:
            raise ModelError("an aggregate needs a link")
        operations = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
        if aggregate.operation.lower() not in operations:
            raise ModelError(f"no aggregate {aggregate.operation}")
        current, rows, source = table, None, ""
        for k, name in enumerate(aggregate.path):
            if name in current.single_links:
                link = current.single_links[name]
                own, other, target = link.child_columns, link.parent_columns, self.model.table(link.parent)
            elif name in current.multi_links:
                link = current.multi_links[name]
                own, other, target = link.parent_columns, link.child_columns, self.model.table(link.child)
            else:
                raise ModelError(f"{current.name} has no link {name}")
            if len(own) != 1:
                raise ModelError("aggregates follow links of one column")
            if rows is None:
                source = own[0]
                rows = base.select(F.col(source).alias("__source"), F.col(source).alias("__join"))
            else:
                rows = rows.select("__source", F.col(own[0]).alias("__join"))
            part = aggregate.last_filter if k == len(aggregate.path) - 1 else None
            if link.predicate and name in current.multi_links:
                part = both(Cmp(link.predicate[0], "_eq", link.predicate[1]), part)
            rows = rows.join(self.scan(target, part), F.col("__join") == F.col(other[0]))
            current = target
        column = current.column(aggregate.column).name
        self.policy.guard_read(current, {column}, self.context)
        self.policy.guard_use(current, {column})
        value = operations[aggregate.operation.lower()](F.col(column)).cast("double")
        return rows.groupBy("__source").agg(value.alias("value")), source


__all__ = ["Compiler", "Page", "Ref"]
