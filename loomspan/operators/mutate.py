"""Mutations as functions from a table's rows to its next rows.

Files cannot be changed in place, so a mutation is a plan: the rows before, joined once
with the changes, give the rows after, and the same join gives what changed.  All actions
of a batch run as one set; nothing loops over rows.
"""

from __future__ import annotations

import datetime as dt
import decimal
import functools
import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crypto, enums, local
from ..plans.model import ModelError, Table
from ..plans.nodes import And
from ..plans.policy import AccessDenied, Context, write_scope
from . import filters

MOST_ACTIONS = 100
MOST_BROADCAST_ACTIONS = 1_000
KINDS = ("insert", "update", "upsert", "delete", "hard-delete")
DELETES = ("delete", "hard-delete")


class Conflict(RuntimeError):
    """A row was changed by someone else, or is not there."""


class Invalid(ValueError):
    """Values that the rules of a column refuse: (column, rule) pairs."""

    def __init__(self, faults):
        super().__init__("; ".join(f"{c}: {r}" for c, r in faults))
        self.faults = faults


@dataclass
class Action:
    kind: str  # one of KINDS; a hard delete drops a row that a delete would only mark
    values: dict


@dataclass
class Outcome:
    """``rows`` after the mutation; ``changes`` has op, key columns, before and after structs."""

    rows: DataFrame
    changes: DataFrame


@dataclass
class Writer:
    """Applies actions to one table for one caller.

    Policies of the table's metadata hold for every write, in the plan itself: row scope and
    tenant, ``state-column`` with ``state-initial`` and ``state-transitions``, the
    ``concurrency-token`` and encrypted columns under the latest of ``keys``.  What breaks a state
    machine or finds another token fails the job that computes the rows.
    """

    spark: SparkSession
    table: Table
    context: Context = field(default_factory=Context)
    now: dt.datetime | None = None
    most: int = MOST_ACTIONS
    duplicates: str = "last-wins"
    keys: dict[int, bytes] | None = None

    def _keys(self) -> list[str]:
        if not self.table.keys:
            raise ModelError(f"{self.table.name} has no key")
        return list(self.table.keys)

    # What is checked and filled in before a change is a plan

    def prepared(self, action: Action) -> Action:
        """With audit columns, tenant and enum values; refused if a rule or policy says so."""
        t, now = self.table, self.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        values = {t.column(k).name: v for k, v in action.values.items()}
        actions = t.metadata.get("policy-actions")
        if actions is not None and action.kind.removeprefix("hard-") not in {a.strip() for a in actions.split(",")} and not self.context.is_admin:
            raise AccessDenied(f"{t.name}: {action.kind}")
        denied = {c.strip() for c in t.metadata.get("policy-write-deny", "").split(",") if c.strip()}
        if denied & set(values) and not self.context.is_admin:
            raise AccessDenied(f"{t.name}: {', '.join(sorted(denied & set(values)))}")
        hidden = {c.metadata["blind-index"] for c in t.columns.values() if c.metadata.get("blind-index")}
        if hidden & set(values):
            raise AccessDenied(f"{t.name}: {', '.join(sorted(hidden & set(values)))}")
        role = t.metadata.get("soft-delete-hard-role")
        if action.kind == "hard-delete" and not self.context.is_admin and role not in self.context.roles:
            raise AccessDenied(f"{t.name}: {action.kind}")
        token = t.metadata.get("concurrency-token")
        if token and action.kind == "update" and values.get(token) is None:
            raise ModelError(f"an update of {t.name} needs {token}")
        tenant = t.metadata.get("tenant-filter")
        if tenant:
            own = self.context.claims.get(t.metadata.get("tenant-context-key", "tenant_id"))
            if own is None:
                raise AccessDenied(f"{t.name}: no tenant")
            if action.kind not in DELETES:
                values[tenant] = own
        if action.kind not in DELETES:
            for name, column in t.columns.items():
                names = column.metadata.get("enum")
                if names and isinstance(values.get(name), str):
                    stored = {n: v for v, n in (p.split("=") for p in names.split(","))}
                    if values[name] not in stored:
                        raise Invalid([(name, "enum")])
                    values[name] = stored[values[name]]
                role = column.metadata.get("populate")
                who = self.context.claims.get("user_id")
                fresh = {"created-on": now, "created-by": who} if action.kind == "insert" else {}
                fresh |= {"updated-on": now, "updated-by": who}
                if role in fresh:
                    values[name] = fresh[role]
            faults = [f for name, v in values.items() for f in rule_faults(t.columns[name], v)]
            if action.kind == "insert":
                faults += [(n, "required") for n, c in t.columns.items() if c.metadata.get("required") == "true" and values.get(n) is None]
            if faults:
                raise Invalid(faults)
        return Action(action.kind, values)

    def batch(self, before: DataFrame, actions: Iterable[Action]) -> Outcome:
        """Mixed actions as one set, with those on one key merged.

        A delete on either side of an update wins, updates merge column by column, and an upsert
        with another action on its key is refused, as what it does depends on the row.  An insert after
        a delete replaces the row, a change after an insert belongs to it, and an insert after anything else
        finds its key taken.
        """
        actions = [self.prepared(a) for a in actions]
        if len(actions) > self.most:
            raise ModelError(f"more than {self.most} actions")
        keys = self._keys()
        merged: dict[tuple, Action] = {}
        for a in actions:
            if a.kind not in KINDS:
                raise ModelError(f"no action {a.kind}")
            if any(a.values.get(k) is None for k in keys):
                raise ModelError(f"{a.kind} needs {', '.join(keys)}")
            key = tuple(a.values[k] for k in keys)
            if key in merged:
                first = merged[key]
                if self.duplicates == "reject" or "upsert" in (first.kind, a.kind):
                    raise ModelError(f"two actions on {key}")
                if first.kind in DELETES and a.kind == "insert":
                    a = Action("upsert", dict.fromkeys(self.table.columns) | a.values)
                elif first.kind in DELETES:
                    a = a if a.kind == "hard-delete" else first
                elif a.kind == "insert":
                    a = first
                elif a.kind == "update":
                    a = Action(first.kind, first.values | a.values)
            merged[key] = a
        rows = [(a.kind, [n for n in self.table.columns if n in a.values], *[a.values.get(n) for n in self.table.columns]) for a in merged.values()]
        kinds = [T.StructField("__op", T.StringType()), T.StructField("__set", T.ArrayType(T.StringType()))]
        schema = T.StructType(kinds + [T.StructField(n, c.type) for n, c in self.table.columns.items()])
        return self.apply(before, local.frame(self.spark, rows, schema), few=len(rows) <= MOST_BROADCAST_ACTIONS)

    def apply(self, before: DataFrame, actions: DataFrame, few: bool = False) -> Outcome:
        """``actions`` has __op, __set (columns that are given) and the table's columns, a row a key.

        One full outer join on the key; ``few`` actions join by broadcast instead, so that the
        table is scanned but not shuffled.  Keys that are new to an update or delete, and keys
        that an insert finds taken, change nothing.  A table with ``soft-delete`` marks
        deleted rows instead of dropping them.
        """
        t, keys = self.table, self._keys()
        if any(c.metadata.get("encrypt") for c in t.columns.values()):
            if not self.keys:
                raise ModelError(f"{t.name} has encrypted columns, and the writer no keys")
            actions = crypto.sealed(actions, t, self.keys, max(self.keys))
        old = before.select(F.struct(*t.columns).alias("__old"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
        new = actions.select("__op", "__set", F.struct(*t.columns).alias("__new"), *[F.col(k).alias(f"__n{i}") for i, k in enumerate(keys)])
        on = functools.reduce(operator.and_, [F.col(f"__k{i}") == F.col(f"__n{i}") for i in range(len(keys))])
        if few:
            found = old.join(F.broadcast(new.select(*[F.col(f"__n{i}") for i in range(len(keys))])), on, "left_semi").drop("__old").withColumn("__found", F.lit(True))  # a row an action at most
            lone = new.join(F.broadcast(found), on, "left").filter("__found IS NULL")
            both = old.join(F.broadcast(new), on, "left").unionByName(lone, allowMissingColumns=True)
        else:
            both = old.join(new, on, "full_outer")
        return self._outcome(both)

    def delete_where(self, before: DataFrame, values: dict, hard: bool = False) -> Outcome:
        """Deletes all rows whose columns have ``values`` (null finds null): one scan and no join."""
        values = self.prepared(Action("hard-delete" if hard else "delete", values)).values
        if not values:
            raise ModelError("a delete needs a column")
        sealed = sorted(n for n in values if self.table.columns[n].metadata.get("encrypt"))
        if sealed:
            raise AccessDenied(f"{self.table.name}: {', '.join(sealed)}")
        hit = functools.reduce(operator.and_, [F.col(n).eqNullSafe(F.lit(v).cast(self.table.columns[n].type)) for n, v in values.items()])
        old = F.struct(*self.table.columns)
        ids = {f"__{side}{i}": F.col(k) for i, k in enumerate(self._keys()) for side in "kn"}
        both = before.select(old.alias("__old"), F.when(hit, F.lit("hard-delete" if hard else "delete")).alias("__op"), F.array().cast("array<string>").alias("__set"), F.when(F.lit(False), old).alias("__new"), *[c.alias(n) for n, c in ids.items()])
        return self._outcome(both)

    def _outcome(self, both: DataFrame) -> Outcome:
        """From rows beside their actions to the rows after, and the changes."""
        t, keys = self.table, self._keys()
        moment = self.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        now, who = F.lit(moment), self.context.claims.get("user_id")
        soft = t.metadata.get("soft-delete")
        if "__found" not in both.columns:
            both = both.withColumn("__found", F.lit(None).cast("boolean"))
        there = F.col("__old").isNotNull() & self._writable()
        op = F.col("__op")
        kind = (
            F.when(F.col("__old").isNull() & op.isin("insert", "upsert") & self._in_scope(lambda n: F.col(f"__new.{n}")), "insert")
            .when(there & op.isin("update", "upsert") & self._in_scope(lambda n: F.when(F.array_contains("__set", n), F.col(f"__new.{n}")).otherwise(F.col(f"__old.{n}"))), "update")
            .when(there & op.isin(*DELETES), "delete")
        )
        stamps = {n: {"deleted-on": now, "deleted-by": F.lit(who)}.get(c.metadata.get("populate")) for n, c in t.columns.items()}
        stamps |= {soft: now, t.metadata.get("soft-delete-by"): F.lit(who)}
        columns = []
        for n in t.columns:
            given = F.array_contains("__set", n)
            value = F.when(F.col("kind") == "insert", F.col(f"__new.{n}"))
            if n not in keys:
                value = value.when((F.col("kind") == "update") & given, F.col(f"__new.{n}"))
            if soft and n not in keys and stamps[n] is not None:
                value = value.when(F.col("kind") == "delete", stamps[n].cast(t.columns[n].type))
            value = value.otherwise(F.col(f"__old.{n}"))
            if n == t.metadata.get("concurrency-token"):
                value = F.when(F.col("kind") == "update", self._following(n)).otherwise(value)
            columns.append(value.alias(n))
        both = both.withColumn("kind", kind)
        both = both.withColumn("kind", self._checked(F.col("kind"))).withColumn("after", F.struct(*columns))
        gone = (F.col("kind") == "delete") & ((op == "hard-delete") if soft else F.lit(True))
        rows = both.filter((F.col("__old").isNotNull() | (F.col("kind") == "insert")) & ~F.coalesce(gone, F.lit(False))).select("after.*")
        changed = both.filter(F.col("kind").isNotNull() & ((F.col("kind") != "update") | ~F.col("__old").eqNullSafe(F.col("after"))))
        image = F.when(~F.coalesce(gone, F.lit(False)), F.col("after"))
        changes = changed.select(
            F.col("kind").alias("op"),
            *[F.coalesce(F.col(f"__k{i}"), F.col(f"__n{i}")).alias(k) for i, k in enumerate(keys)],
            F.col("__old").alias("before"),
            image.alias("after"),
        )
        return Outcome(rows, changes)

    def _following(self, token: str) -> Column:
        """The token after an update: the next number, or now."""
        kind, old = self.table.columns[token].type, F.col(f"__old.{token}")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.lit(self.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast(kind)
        if not isinstance(kind, (T.IntegralType, T.DecimalType)):
            raise ModelError(f"{token} is neither a number nor a time")
        wide = (old.cast("decimal(38,0)") + 1) if isinstance(kind, T.IntegralType) else old + 1
        narrow = wide.try_cast(kind)
        return F.when(narrow.isNull() & old.isNotNull(), F.raise_error(F.lit(f"{token} is at its end")).cast(kind)).otherwise(narrow)

    def _checked(self, kind: Column) -> Column:
        """``kind``, or an error where the change breaks the state machine or finds another token."""
        m, set_ = self.table.metadata, F.col("__set")
        error = F.lit(None).cast("string")
        token = m.get("concurrency-token")
        if token:
            missed = kind.isNull() | ~F.col(f"__old.{token}").eqNullSafe(F.col(f"__new.{token}"))
            error = F.when((F.col("__op") == "update") & missed, F.lit(f"conflict: {token} of {self.table.name} has changed"))
        state = m.get("state-column")
        if state:
            machine, old, new = parse_transitions(m["state-transitions"]), F.lower(f"__old.{state}"), F.lower(f"__new.{state}")
            legal = F.when(kind == "insert", new == m["state-initial"].lower()).otherwise(functools.reduce(operator.or_, [old == new, *steps(machine, old, new, self.context.roles)]))
            moved = (kind == "insert") | ((kind == "update") & F.array_contains(set_, state))
            error = F.coalesce(error, F.when(moved & ~F.coalesce(legal, F.lit(False)), F.concat(F.lit(f"state of {self.table.name}: "), F.coalesce(old, F.lit("")), F.lit("->"), F.coalesce(new, F.lit("")))))
        # A test of the joined side keeps this above the join: below it, actions that find their row would fail as missing.
        return F.when(F.col("__found").isNull() & error.isNotNull(), F.raise_error(error).cast("string")).otherwise(kind) if token or state else kind

    def _writable(self) -> Column:
        """Rows that the caller may change."""
        test = self._in_scope(lambda n: F.col(f"__old.{n}"))
        if self.table.metadata.get("soft-delete"):
            test = test & F.col(f"__old.{self.table.metadata['soft-delete']}").isNull()
        return test

    def _in_scope(self, value: Callable[[str], Column]) -> Column:
        """Whether a row, whose columns ``value`` gives, is one the caller may write."""

        def test(part) -> Column:
            if isinstance(part, And):
                return functools.reduce(operator.and_, map(test, part.parts))
            column = self.table.column(part.column)
            return filters.predicate(value(column.name), part.op, part.value, column.type)

        scope = write_scope(self.table, self.context)
        return F.lit(True) if scope is None else F.coalesce(test(scope), F.lit(False))

    def insert(self, before: DataFrame, values: dict) -> Outcome:
        return self.batch(before, [Action("insert", values)])

    def update(self, before: DataFrame, values: dict) -> Outcome:
        return self.batch(before, [Action("update", values)])

    def upsert(self, before: DataFrame, values: dict) -> Outcome:
        return self.batch(before, [Action("upsert", values)])

    def delete(self, before: DataFrame, values: dict, hard: bool = False) -> Outcome:
        return self.batch(before, [Action("hard-delete" if hard else "delete", values)])

    def update_checked(self, before: DataFrame, values: dict, token_column: str) -> Outcome:
        """Only where the token still has the value given; then it moves on.  Otherwise a conflict."""
        token = values.get(token_column)
        if token is None:
            raise ModelError(f"{token_column} is required")
        kind = self.table.column(token_column).type
        found = before.filter(functools.reduce(operator.and_, [F.col(k) == F.lit(values[k]) for k in self._keys()]) & (F.col(token_column) == F.lit(token)))
        if found.isEmpty():
            raise Conflict(f"{self.table.name}: {token_column} has changed")
        if isinstance(kind, T.NumericType):
            following = token + 1
            most = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(kind))
            if most and following >= 1 << (most - 1):
                raise Conflict(f"{token_column} is at its end")
        else:
            following = self.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return self.update(before, values | {token_column: following})


# Rules of values


INTEGER_BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def bound(text: str, kind: T.DataType):
    """A least or greatest value from metadata: a day, a time or a number."""
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime.fromisoformat(text)
    return decimal.Decimal(text) if isinstance(kind, T.DecimalType) else float(text)


def rule_faults(column, value) -> list[tuple[str, str]]:
    """Which of the column's rules one value breaks."""
    m, out = column.metadata, []
    if value is None:
        return [(column.name, "required")] if m.get("required") == "true" else []
    if "min" in m and value < bound(m["min"], column.type):
        out.append("min")
    if "max" in m and value > bound(m["max"], column.type):
        out.append("max")
    if type(column.type) in INTEGER_BITS and not -(1 << INTEGER_BITS[type(column.type)]) <= value < 1 << INTEGER_BITS[type(column.type)]:
        out.append("range")
    if isinstance(column.type, T.DecimalType):
        _, digits, exponent = decimal.Decimal(str(value)).normalize().as_tuple()
        if -exponent > column.type.scale:
            out.append("scale")
        if len(digits) + exponent > column.type.precision - column.type.scale:
            out.append("precision")
    if "maxbytes" in m and len(value.encode() if isinstance(value, str) else value) > int(m["maxbytes"]):
        out.append("maxbytes")
    if "step" in m and abs(value / float(m["step"]) - round(value / float(m["step"]))) > 1e-9:
        out.append("step")
    if "minlength" in m and len(value) < int(m["minlength"]):
        out.append("minlength")
    if "maxlength" in m and len(value) > int(m["maxlength"]):
        out.append("maxlength")
    if "pattern" in m:
        import re

        if not re.fullmatch(m["pattern"], value):
            out.append("pattern")
    return [(column.name, rule) for rule in out]


def faults(df: DataFrame, table: Table) -> DataFrame:
    """Rows with ``faults``: the column:rule pairs that they break, by built-in expressions."""
    tests = []
    for name, column in table.columns.items():
        m, c, kind = column.metadata, F.col(name), column.type
        rules = {
            "required": lambda v: c.isNull() if v == "true" else F.lit(False),
            "min": lambda v: c < F.lit(bound(v, kind)),
            "max": lambda v: c > F.lit(bound(v, kind)),
            "step": lambda v: F.abs(c / float(v) - F.round(c / float(v))) > 1e-9,
            "maxbytes": lambda v: F.octet_length(c) > int(v),
            "minlength": lambda v: F.length(c) < int(v),
            "maxlength": lambda v: F.length(c) > int(v),
            "pattern": lambda v: ~c.rlike(f"^(?:{v})$"),
        }
        tests += [F.when(rules[r](m[r]), F.lit(f"{name}:{r}")) for r in rules if r in m]
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return df.withColumn("faults", found)


# State machines


@dataclass(frozen=True)
class Transition:
    start: str
    end: str
    roles: frozenset[str] = frozenset()
    event: str = ""


def parse_transitions(text: str) -> list[Transition]:
    """``from->to[role1,role2]@event``, separated by ``;`` or ``|``."""
    import re

    out = []
    for item in re.split(r"[;|]", text):
        if item.strip():
            found = re.fullmatch(r"\s*([\w -]+?)\s*->\s*([\w -]+?)\s*(?:\[([^\]]*)\])?\s*(?:@(\w+))?\s*", item)
            if not found:
                raise ModelError(f"bad transition {item.strip()!r}")
            roles = frozenset(r.strip() for r in (found[3] or "").split(",") if r.strip())
            out.append(Transition(found[1].lower(), found[2].lower(), roles, found[4] or ""))
    return out


def check_transition(machine: list[Transition], initial: str, old: str | None, new: str, roles: frozenset[str]) -> None:
    """An insert starts at the initial state; a change follows a transition that a role may take."""
    if old is None:
        if new.lower() != initial.lower():
            raise Invalid([("state", "initial")])
        return
    if old.lower() == new.lower():
        return
    steps = [t for t in machine if (t.start, t.end) == (old.lower(), new.lower())]
    if not steps:
        raise Invalid([("state", f"{old}->{new}")])
    if not any(not t.roles or t.roles & roles for t in steps):
        raise AccessDenied(f"{old}->{new}")


def steps(machine: list[Transition], old: Column, new: Column, roles: frozenset[str]) -> list[Column]:
    """A test for each transition that the caller may take."""
    return [(old == t.start) & (new == t.end) for t in machine if not t.roles or t.roles & roles]


def illegal_changes(changes: DataFrame, column: str, machine: list[Transition], initial: str, roles: frozenset[str]) -> DataFrame:
    """Changes whose state does not follow the machine, as a set."""
    old, new = F.lower(f"before.{column}"), F.lower(f"after.{column}")
    legal = functools.reduce(operator.or_, [old == new, F.col("before").isNull() & (new == initial.lower()), *steps(machine, old, new, roles)])
    return changes.filter(F.col("after").isNotNull() & ~F.coalesce(legal, F.lit(False)))


def transition_column(column: str, machine: list[Transition], roles: frozenset[str]) -> Column:
    """States that each row may go to next for the caller."""
    allowed: dict[str, list[str]] = {}
    for t in machine:
        if not t.roles or t.roles & roles:
            allowed.setdefault(t.start, []).append(t.end)
    return enums.transitions(F.col(column), allowed)


# Trees


def sync(before: DataFrame, wanted: DataFrame, keys: list[str], scope: Column | None = None) -> DataFrame:
    """(op, keys, before, after) that bring ``before`` to ``wanted``: inserts, real updates, deletes of orphans.

    ``scope`` says which rows ``wanted`` speaks for.  Numbers compare as decimals, all else
    as text, so that 1 and 1.0 are no change.
    """
    columns = wanted.columns
    kinds = dict(before.dtypes)
    numeric = {f.name for f in before.schema if isinstance(f.dataType, T.NumericType)}
    mine = before.filter(scope) if scope is not None else before
    old = mine.select(F.struct(*columns).alias("before"), *[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)])
    new = wanted.select(F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]).alias("after"), *[F.col(k).alias(f"__n{i}") for i, k in enumerate(keys)])
    on = functools.reduce(operator.and_, [F.col(f"__o{i}") == F.col(f"__n{i}") for i in range(len(keys))])
    both = old.join(new, on, "full_outer")

    def same(c):
        a, b = F.col(f"before.{c}"), F.col(f"after.{c}")
        kind = "decimal(38,10)" if c in numeric else "string"
        return a.cast(kind).eqNullSafe(b.cast(kind))

    equal = functools.reduce(operator.and_, [same(c) for c in columns])
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~equal, "update")
    return both.select(op.alias("op"), *[F.coalesce(F.col(f"__o{i}"), F.col(f"__n{i}")).alias(k) for i, k in enumerate(keys)], "before", "after").filter("op IS NOT NULL")


def sync_tree(frames: dict[str, DataFrame], tree: DataFrame, levels: list[tuple[str, list[str], str, str | None]], depth: int = 3) -> dict[str, DataFrame]:
    """Changes of every level of a nested document.

    ``levels`` lists (table, keys, path of its array in ``tree`` or "" for the root, foreign
    key or None); children are deleted only under parents that the tree holds.
    """
    if len(levels) > depth:
        raise ModelError(f"deeper than {depth}")
    out, held_keys = {}, []
    for table, keys, path, foreign in levels:
        before = frames[table]
        rows = tree
        for part in filter(None, path.split(".")):
            rows = rows.select(F.explode(part).alias("__row")).select("__row.*")
        columns = [c for c in before.columns if c in rows.columns]
        wanted = rows.select(*columns)
        if foreign:
            # All parents that the tree holds at the level above, whether or not they have children there.
            above = next(k for p, k in held_keys if p == path.rpartition(".")[0])
            parents = above.select(F.col(above.columns[0]).alias("__p")).distinct()
            mine = before.join(parents, F.col(foreign) == F.col("__p"), "left_semi")
        else:
            held = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys])
            mine = before.join(held, functools.reduce(operator.and_, [F.col(k) == F.col(f"__{k}") for k in keys]), "left_semi")
        held_keys.append((path, rows.select(*keys)))
        out[table] = sync(mine.select(*columns), wanted, keys)
    return out


# Approval and undo


def pending(changes: DataFrame, entity: str, author: str, when: dt.datetime) -> DataFrame:
    """Changes set aside until someone approves them."""
    return changes.select(
        F.lit(entity).alias("entity"),
        "op",
        F.to_json("before", {"ignoreNullFields": "false"}).alias("before"),
        F.to_json("after", {"ignoreNullFields": "false"}).alias("after"),
        F.lit(author).alias("author"),
        F.lit(when).alias("asked_at"),
        F.lit("pending").alias("state"),
    ).withColumn("id", F.xxhash64("entity", "op", "before", "after", "author", "asked_at"))


def decided(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue after ``decisions`` (id, approve, decider, decided_at); what was decided before stays so."""
    said = decisions.select(F.col("id").alias("__id"), F.col("approve").alias("__approve"), F.col("decider").alias("__decider"), F.col("decided_at").alias("__decided_at"))
    joined = queue.join(said, (F.col("id") == F.col("__id")) & (F.col("state") == "pending"), "left")
    state = F.when(F.col("__approve"), "approved").when(~F.col("__approve"), "rejected").otherwise(F.col("state"))
    following = {"state": state} | {c: F.coalesce(f"__{c}", c) if c in queue.columns else F.col(f"__{c}") for c in ("decider", "decided_at")}
    return joined.withColumns(following).drop("__id", "__approve", "__decider", "__decided_at")


def approved(queue: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of ``before`` that were approved and still find the row as it was when they were asked for.

    ``replay`` puts them in place.
    """
    kind = before.schema
    asked = queue.filter("state = 'approved'").select("op", F.from_json("before", kind).alias("before"), F.from_json("after", kind).alias("after"))
    asked = asked.select("op", *[F.coalesce(F.col(f"before.{k}"), F.col(f"after.{k}")).alias(k) for k in keys], "before", "after")
    now = before.select(F.struct(*before.columns).alias("__now"), *[F.col(k).alias(f"__{k}") for k in keys])
    found = asked.join(now, functools.reduce(operator.and_, [F.col(k) == F.col(f"__{k}") for k in keys]), "left")
    return found.filter(F.col("before").eqNullSafe(F.col("__now"))).select(*asked.columns)


def inverse(changes: DataFrame) -> DataFrame:
    """Changes that undo ``changes``: inserts and deletes swap, as do the images."""
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise("update")
    return changes.select(op.alias("op"), *[c for c in changes.columns if c not in ("op", "before", "after")], F.col("after").alias("before"), F.col("before").alias("after"))


def replay(before: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``before`` with the images after of ``changes`` in place, by one anti join and a union."""
    touched = changes.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = functools.reduce(operator.and_, [F.col(k) == F.col(f"__{k}") for k in keys])
    kept = before.join(touched, on, "left_anti")
    return kept.unionByName(changes.filter("after IS NOT NULL").select("after.*").select(*before.columns))


def undo(before: DataFrame, changes: DataFrame, keys: list[str], made_at: dt.datetime, now: dt.datetime, window: dt.timedelta) -> DataFrame:
    if now - made_at > window:
        raise Conflict("the time to undo has passed")
    return replay(before, inverse(changes), keys)


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("__n = 1").drop("__n")
