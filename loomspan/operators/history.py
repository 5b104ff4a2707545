"""Change history, outbox, retention and workflows over change tables."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import ModelError
from ..plans.policy import AccessDenied

# History

NULLS = {"ignoreNullFields": "false"}


def mark(key: dict) -> Column:
    """A row's key as history has it, by the same function that writes it there."""
    return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in key.items()]))


def trail(changes: DataFrame, entity: str, keys: list[str], actor: str, when: dt.datetime) -> DataFrame:
    """One history row a change: key, images and changed columns; changes of nothing are none."""
    columns = [f.name for f in changes.schema["before"].dataType]
    changed = F.array_compact(F.array(*[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in columns]))
    rows = changes.select(
        F.lit(entity).alias("entity"),
        F.to_json(F.struct(*keys)).alias("entity_id"),
        "op",
        F.lit(actor).alias("actor"),
        F.lit(when).alias("changed_at"),
        F.to_json("before", NULLS).alias("before"),
        F.to_json("after", NULLS).alias("after"),
        changed.alias("changed_columns"),
    )
    return rows.filter((F.col("op") != "update") | (F.size("changed_columns") > 0))


def of_entity(history: DataFrame, entity: str, key: dict, tenant: tuple[str, object] | None = None) -> DataFrame:
    """The trail of one row, oldest first; with a tenant, only rows whose images carry it."""
    rows = history.filter((F.col("entity") == entity) & (F.col("entity_id") == mark(key)))
    if tenant:
        path = f"$.{tenant[0]}"
        rows = rows.filter(F.coalesce(F.get_json_object("after", path), F.get_json_object("before", path)) == str(tenant[1]))
    return rows.orderBy("changed_at")


def erase(history: DataFrame, entity: str, key: dict, when: dt.datetime) -> DataFrame:
    """Images of one row removed, and a tombstone in their place."""
    hit = (F.col("entity") == entity) & (F.col("entity_id") == mark(key))
    none = F.lit(None).cast("string")
    blank = history.withColumns({c: F.when(hit, none).otherwise(F.col(c)) for c in ("before", "after")})
    tomb = history.sparkSession.range(1).select(F.lit(entity).alias("entity"), mark(key).alias("entity_id"), F.lit("erase").alias("op"), none.alias("actor"), F.lit(when).alias("changed_at"), none.alias("before"), none.alias("after"), F.array().cast("array<string>").alias("changed_columns"))
    return blank.unionByName(tomb)


# Outbox

BATCH, MOST_ATTEMPTS = 100, 5
FIRST_WAIT, LONGEST_WAIT = dt.timedelta(seconds=1), dt.timedelta(minutes=5)


def outbox(changes: DataFrame, aggregate: str, keys: list[str], when: dt.datetime, mode: str = "full", tenant: str | None = None) -> DataFrame:
    """Events of changes: the whole image, the key and the changed columns, or the key; of a delete in the second, the key.

    Columns that became null are there as nulls, and a deleted row's event has its tenant.
    """
    if not keys:
        raise ModelError(f"events of {aggregate} need a key")
    image = F.coalesce("after", "before")
    columns = [f.name for f in changes.schema["before"].dataType]
    if mode == "full":
        payload = F.to_json(image, NULLS)
    elif mode == "keys":
        payload = F.to_json(F.struct(*keys))
    elif mode == "changed":
        own = []
        for c in columns:
            shown = F.lit(True) if c in keys else F.col("after").isNotNull() & ~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}"))
            field = F.to_json(F.struct(image[c].alias(c)), NULLS)
            own.append(F.when(shown, F.substring(field, F.lit(2), F.char_length(field) - 2)))
        payload = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*own)), ","), F.lit("}"))
    else:
        raise ModelError(f"no payload mode {mode}")
    rows = changes.select(
        F.lit(aggregate).alias("aggregate"),
        F.to_json(F.struct(*keys)).alias("key"),
        "op",
        payload.alias("payload"),
        (image[tenant].cast("string") if tenant else F.lit(None).cast("string")).alias("tenant"),
        F.lit(when).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("dispatched_at"),
        F.lit(0).alias("attempts"),
        F.lit(False).alias("dead"),
    )
    return rows.withColumn("id", F.xxhash64("aggregate", "key", "op", "payload", "created_at"))


def due(events: DataFrame, now: dt.datetime, batch: int = BATCH) -> DataFrame:
    """Next events to deliver: the first of each key that is neither delivered nor waiting.

    A key whose first event waits or is dead holds back nothing but itself; a dead event
    lets the key go on.
    """
    open_ = events.filter("dispatched_at IS NULL AND NOT dead")
    first = open_.withColumn("__n", F.row_number().over(Window.partitionBy("aggregate", "key").orderBy("created_at", "id"))).filter("__n = 1").drop("__n")
    if "next_at" in events.columns:
        first = first.filter(F.col("next_at").isNull() | (F.col("next_at") <= F.lit(now)))
    return first.orderBy("created_at", "id").limit(batch)


def backoff(attempt: int, draw: Callable[[], float] = random.random) -> dt.timedelta:
    """Twice as long each time, up to a limit, with jitter."""
    return min(FIRST_WAIT * 2 ** (attempt - 1), LONGEST_WAIT) * (0.5 + draw() / 2)


def delivered(events: DataFrame, results: DataFrame, now: dt.datetime) -> DataFrame:
    """Events after a round: ``results`` has (id, ok); too many failures make an event dead."""
    joined = events.join(results.select(F.col("id").alias("__id"), "ok"), F.col("id") == F.col("__id"), "left").drop("__id")
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    wait = F.least(F.lit(LONGEST_WAIT.total_seconds()), F.pow(F.lit(2.0), F.col("attempts")) * FIRST_WAIT.total_seconds())
    jitter = 0.5 + F.pmod(F.xxhash64("id", "attempts"), F.lit(1000)) / 2000
    following = F.timestamp_add("MILLISECOND", F.ceil(wait * jitter * 1000).cast("int"), F.lit(now).cast("timestamp_ntz"))
    return joined.select(
        *[c for c in events.columns if c not in ("dispatched_at", "attempts", "dead", "next_at")],
        F.when(F.col("ok"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("dispatched_at")).alias("dispatched_at"),
        (F.col("attempts") + failed.cast("int")).alias("attempts"),
        (F.col("dead") | (failed & (F.col("attempts") + 1 >= MOST_ATTEMPTS))).alias("dead"),
        F.when(failed, following).otherwise(F.col("next_at") if "next_at" in events.columns else F.lit(None).cast("timestamp_ntz")).alias("next_at"),
    )


@dataclass
class Subscription:
    tables: frozenset[str] = frozenset()
    tenant: str | None = None
    redact: tuple[str, ...] = ()

    def select(self, events: DataFrame) -> DataFrame:
        """Events of the subscription, without redacted columns."""
        rows = events.filter(F.col("aggregate").isin(*self.tables)) if self.tables else events
        rows = rows.filter(F.col("tenant") == self.tenant) if self.tenant is not None else rows
        payload = F.from_json("payload", "map<string,string>")
        if self.redact:
            rows = rows.withColumn("payload", F.to_json(F.map_filter(payload, lambda k, _: ~k.isin(*self.redact))))
        return rows


def cloud_events(events: DataFrame, source: str) -> DataFrame:
    """(id, envelope) by CloudEvents 1.0."""
    envelope = F.struct(
        F.lit("1.0").alias("specversion"),
        F.col("id").cast("string").alias("id"),
        F.lit(source).alias("source"),
        F.concat_ws(".", "aggregate", "op").alias("type"),
        F.col("key").alias("subject"),
        F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        F.lit("application/json").alias("datacontenttype"),
        F.col("payload").alias("data"),
    )
    return events.select("id", F.to_json(envelope).alias("envelope"))


# Retention


@dataclass(frozen=True)
class Retention:
    kind: str  # retain or ttl
    window: dt.timedelta
    column: str


def parse_retention(text: str, soft_delete: str | None) -> Retention:
    """``retain: 90d`` counts from the soft delete; ``ttl: 30d after column`` from that column."""
    found = re.fullmatch(r"\s*(retain|ttl)\s*:\s*(\d+)([dh])(?:\s+after\s+(\w+))?\s*", text)
    if not found or (found[1] == "ttl") != bool(found[4]):
        raise ModelError(f"bad retention {text!r}")
    if found[1] == "retain" and not soft_delete:
        raise ModelError("retain needs a soft-delete column")
    window = dt.timedelta(days=int(found[2])) if found[3] == "d" else dt.timedelta(hours=int(found[2]))
    if not window:
        raise ModelError("an empty window")
    return Retention(found[1], window, found[4] or soft_delete)


def expired(rows: DataFrame, rule: Retention, now: dt.datetime) -> DataFrame:
    """Rows that a sweep would purge: strictly older than the window."""
    return rows.filter(F.col(rule.column) < F.lit(now - rule.window))


def swept(rows: DataFrame, rule: Retention, now: dt.datetime) -> DataFrame:
    """Rows that stay; a null anchor never expires."""
    return rows.filter(F.col(rule.column).isNull() | (F.col(rule.column) >= F.lit(now - rule.window)))


def purge_batch(rows: DataFrame, rule: Retention, now: dt.datetime, keys: list[str], batch: int = 100) -> DataFrame:
    """Keys of the next purge, oldest first."""
    return expired(rows, rule, now).orderBy(rule.column, *keys).limit(batch).select(*keys)


# Workflows


@dataclass
class Workflow:
    """Steps run in order on the driver; each is (kind, settings) and may read earlier results."""

    steps: list[tuple[str, dict]]
    handlers: dict[str, Callable[[dict, dict], object]] = field(default_factory=dict)

    def run(self, given: dict, roles: frozenset[str] = frozenset()) -> dict:
        """Results by step name; a branch takes the steps of the first condition that holds."""
        state, log = {"input": given}, []
        self._run(self.steps, state, roles, log)
        return state | {"log": log}

    def _run(self, steps, state, roles, log):
        for kind, settings in steps:
            settings = _filled(settings, state)
            if kind == "branch":
                taken = next((c["steps"] for c in settings["cases"] if "equals" not in c or c["equals"][0] == c["equals"][1]), [])
                self._run(taken, state, roles, log)
            elif kind == "parallel":
                with ThreadPoolExecutor(max(1, len(settings["groups"]))) as pool:  # Spark takes jobs of several threads
                    for done in [pool.submit(self._run, group, state, roles, log) for group in settings["groups"]]:
                        done.result()
            elif kind == "policy-check":
                if settings["role"] not in roles:
                    raise AccessDenied(settings["role"])
            elif kind == "audit":
                log.append(settings["message"])
            elif kind in self.handlers:
                state[settings.get("name", kind)] = self.handlers[kind](settings, state)
            else:
                raise ModelError(f"no step {kind}")


def _filled(value, state):
    if isinstance(value, str):
        whole = re.fullmatch(r"\{\{([\w.]+)\}\}", value)
        if whole:
            return _at(state, whole[1])
        return re.sub(r"\{\{([\w.]+)\}\}", lambda m: str(_at(state, m[1])), value)
    if isinstance(value, dict):
        return {k: _filled(v, state) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(_filled(v, state) for v in value)
    return value


def _at(state, path):
    for name in path.split("."):
        state = state[name]
    return state


def scheduled(every: dt.timedelta, last: dt.datetime | None, now: dt.datetime) -> bool:
    return last is None or now - last >= every


def newest(column: str) -> Column:
    return F.col(column).desc_nulls_last()
