"""The relational model: tables, keys and the links between them.

A model is declared, or inferred from column names where files carry no constraints, and
then overlaid with metadata rules.  It holds no rows: ``Model.frame`` gives a table's
DataFrame when a query needs it.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class ModelError(ValueError):
    """A model or a request that does not fit it."""


@dataclass
class Column:
    name: str
    type: T.DataType
    nullable: bool = True
    api_name: str = ""
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.api_name = self.api_name or self.name

    @property
    def scalar(self) -> str:
        """Name of the scalar that clients see; metadata may override it."""
        return self.metadata.get("type") or scalar_name(self.type)


def scalar_name(kind: T.DataType) -> str:
    names = [
        (T.ByteType, "Short"), (T.ShortType, "Short"), (T.IntegerType, "Int"), (T.LongType, "BigInt"),
        (T.DecimalType, "Decimal"), (T.FloatType, "Float"), (T.DoubleType, "Float"), (T.BooleanType, "Boolean"),
        (T.TimestampNTZType, "DateTime"), (T.TimestampType, "DateTimeOffset"), (T.DateType, "DateTime"),
        (T.StructType, "JSON"), (T.MapType, "JSON"), (T.VariantType, "JSON"),
    ]
    return next((name for k, name in names if isinstance(kind, k)), "String")


@dataclass(frozen=True)
class Link:
    """One foreign-key edge; ``predicate`` is a constant (child column, value) of polymorphic links."""

    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    single: str  # name on the child: its one parent
    multi: str  # name on the parent: its children
    predicate: tuple[str, object] | None = None


@dataclass(frozen=True)
class ManyToMany:
    """source -> junction -> target over single columns."""

    name: str
    source: str
    junction: str
    target: str
    source_column: str
    junction_source: str
    junction_target: str
    target_column: str
    has_payload: bool = False


@dataclass
class Table:
    name: str
    columns: dict[str, Column]
    keys: tuple[str, ...] = ()
    schema: str = ""
    api_name: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    single_links: dict[str, Link] = field(default_factory=dict)
    multi_links: dict[str, Link] = field(default_factory=dict)
    many_links: dict[str, ManyToMany] = field(default_factory=dict)

    def __post_init__(self):
        self.api_name = self.api_name or self.name

    def column(self, name: str) -> Column:
        """By stored or client-side name."""
        found = self.columns.get(name) or next((c for c in self.columns.values() if c.api_name == name), None)
        if found is None:
            raise ModelError(f"{self.name} has no column {name}")
        return found

    def has_column(self, name: str) -> bool:
        return name in self.columns or any(c.api_name == name for c in self.columns.values())


class Model:
    def __init__(self, load: Callable[[str], DataFrame] | None = None):
        self.tables: dict[str, Table] = {}
        self.metadata: dict[str, str] = {}
        self._load = load
        self._frames: dict[str, DataFrame] = {}

    def add(self, name: str, frame: DataFrame | T.StructType, keys: tuple[str, ...] = (), schema: str = "", **names: str) -> Table:
        """Register a table by its DataFrame, or by its schema if rows come from the loader."""
        kind = frame if isinstance(frame, T.StructType) else frame.schema
        columns = {f.name: Column(f.name, f.dataType, f.nullable, names.get(f.name, "")) for f in kind}
        for key in keys:
            if key not in columns:
                raise ModelError(f"{name} has no column {key}")
        label = f"{schema}.{name}" if schema else name
        self.tables[label] = Table(name, columns, tuple(keys), schema)
        if not isinstance(frame, T.StructType):
            self._frames[label] = frame
        return self.tables[label]

    def table(self, name: str) -> Table:
        """By qualified, bare or client-side name; a bare name of several schemas is an error."""
        if name in self.tables:
            return self.tables[name]
        found = [t for t in self.tables.values() if name.lower() in (t.name.lower(), t.api_name.lower())]
        if len(found) > 1:
            raise ModelError(f"{name} is ambiguous: {', '.join(sorted(f'{t.schema}.{t.name}' for t in found))}")
        if not found:
            raise ModelError(f"no table {name}")
        return found[0]

    def frame(self, table: Table) -> DataFrame:
        label = f"{table.schema}.{table.name}" if table.schema else table.name
        if label not in self._frames:
            if self._load is None:
                raise ModelError(f"no rows for {label}")
            self._frames[label] = self._load(label)
        return self._frames[label]

    def replace(self, name: str, frame: DataFrame) -> None:
        """Let later queries of a table read ``frame``, as after a mutation."""
        table = self.table(name)
        self._frames[f"{table.schema}.{table.name}" if table.schema else table.name] = frame

    # Links

    def link(self, child: str, child_columns, parent: str, parent_columns=None, single: str = "", multi: str = "", predicate=None) -> Link:
        c, p = self.table(child), self.table(parent)
        own = (child_columns,) if isinstance(child_columns, str) else tuple(child_columns)
        to = p.keys if parent_columns is None else (parent_columns,) if isinstance(parent_columns, str) else tuple(parent_columns)
        if len(own) != len(to) or not own:
            raise ModelError(f"link from {child} to {parent} needs as many columns on either side")
        for t, names in ((c, own), (p, to)):
            for n in names:
                t.column(n)
        again = sum(x.parent == p.name for x in c.single_links.values())
        role = re.sub(r"(_id|_key|id)$", "", own[0], flags=re.I).strip("_") if again else ""
        found = Link(c.name, own, p.name, to, single or role or p.name, multi or (f"{c.name}_{role}" if role else c.name), predicate)
        if predicate is None:
            if found.single in c.single_links or c.has_column(found.single):
                found = Link(*[*found.__dict__.values()][:4], f"{found.single}_link", found.multi, None)
            c.single_links[found.single] = found
        p.multi_links[found.multi] = found
        return found

    def many_to_many(self, source: str, junction: str, target: str, name: str = "") -> ManyToMany:
        """Through two single-column links of the junction; declared both ways."""
        j = self.table(junction)
        a = next((x for x in j.single_links.values() if x.parent == source and len(x.child_columns) == 1), None)
        b = next((x for x in j.single_links.values() if x.parent == target and len(x.child_columns) == 1 and x is not a), None)
        if a is None or b is None:
            raise ModelError(f"{junction} does not link {source} and {target} by single columns")
        payload = bool(set(j.columns) - {a.child_columns[0], b.child_columns[0], *j.keys})
        there = ManyToMany(name or target, source, junction, target, a.parent_columns[0], a.child_columns[0], b.child_columns[0], b.parent_columns[0], payload)
        back = ManyToMany(source, target, junction, source, b.parent_columns[0], b.child_columns[0], a.child_columns[0], a.parent_columns[0], payload)
        self.table(source).many_links[there.name] = there
        self.table(target).many_links.setdefault(back.name, back)
        return there

    def polymorphic(self, child: str, type_column: str, id_column: str, targets: dict[str, str]) -> None:
        """A child collection on each target, restricted to its type value."""
        for value, target in targets.items():
            self.link(child, id_column, target, multi=child, predicate=(type_column, value))

    def infer_links(self) -> None:
        """By name: a column named like a single-key table links to it; then bare junctions."""
        by_name = {_normal(t.name): t for t in self.tables.values() if len(t.keys) == 1}
        for table in self.tables.values():
            linked = {x.child_columns for x in table.single_links.values()}
            for column in list(table.columns):
                target = by_name.get(_normal(re.sub(r"(_id|_key|id)$", "", column, flags=re.I)))
                if target is not None and target is not table and (column,) not in linked and (column,) != table.keys:
                    self.link(table.name, column, target.name)
        self.detect_many_to_many()

    def detect_many_to_many(self) -> None:
        """Tables of two links to two tables and nothing else, named after both or keyed by both."""
        for j in list(self.tables.values()):
            links = list(j.single_links.values())
            if len(links) != 2 or links[0].parent == links[1].parent or any(len(x.child_columns) != 1 for x in links):
                continue
            own = {x.child_columns[0] for x in links}
            parents = [x.parent for x in links]
            named = all(_normal(p) in _normal(j.name) for p in parents)
            if set(j.columns) <= own | set(j.keys) and (named or set(j.keys) == own):
                if parents[1] not in _words(self.table(parents[0]).metadata.get("many-to-many-exclude", "")):
                    self.many_to_many(parents[0], j.name, parents[1])

    def candidate_joins(self, a: str, b: str) -> list[tuple[tuple[str, str], ...]]:
        """Column pairs (of ``a``, of ``b``) that links between two tables suggest, in either direction."""
        one, two = self.table(a), self.table(b)
        out = [tuple(zip(x.child_columns, x.parent_columns)) for x in one.single_links.values() if x.parent == two.name]
        return out + [tuple(zip(x.parent_columns, x.child_columns)) for x in two.single_links.values() if x.parent == one.name]

    # Metadata

    def apply(self, rules: list[tuple[str, dict[str, str], str | None]]) -> None:
        """Overlay parsed metadata rules: (selector, values, column glob that the table must have)."""
        for selector, values, needs in rules:
            if selector == ":root":
                self.metadata.update(values)
                continue
            parts = selector.lower().split(".")
            for table in self.tables.values():
                if needs and not any(fnmatch.fnmatch(c.lower(), needs.lower()) for c in table.columns):
                    continue
                path = [table.schema.lower(), table.name.lower()]
                if len(parts) == 1 and fnmatch.fnmatch(path[1], parts[0]) or len(parts) == 2 and all(map(fnmatch.fnmatch, path, parts)):
                    table.metadata.update(values)
                if len(parts) == 3 and all(map(fnmatch.fnmatch, path, parts)):
                    for column in table.columns.values():
                        if fnmatch.fnmatch(column.name.lower(), parts[2]):
                            column.metadata.update(values)
        for table in self.tables.values():
            for spec in _words(table.metadata.get("many-to-many", ""), ","):
                target, junction = spec.split(":")
                if target.strip() not in table.many_links:
                    self.many_to_many(table.name, junction.strip(), target.strip())
            if "polymorphic-map" in table.metadata:
                pairs = dict(p.split("=") for p in _words(table.metadata["polymorphic-map"], ","))
                self.polymorphic(table.name, table.metadata["polymorphic-type-column"], table.metadata["polymorphic-id-column"], {k.strip(): v.strip() for k, v in pairs.items()})

    def overview(self) -> list[dict]:
        """The schema as plain values: what introspection shows."""
        return [
            {
                "table": t.name, "schema": t.schema, "keys": list(t.keys), "metadata": dict(t.metadata),
                "columns": [{"name": c.name, "api_name": c.api_name, "scalar": c.scalar, "nullable": c.nullable, "is_key": c.name in t.keys} for c in t.columns.values()],
                "single_links": sorted(t.single_links), "multi_links": sorted(t.multi_links), "many_links": sorted(t.many_links),
            }
            for t in sorted(self.tables.values(), key=lambda t: (t.schema, t.name))
        ]


def _normal(name: str) -> str:
    name = re.sub(r"[^a-z0-9]", "", name.lower())
    if name.endswith("ies") and len(name) > 4:
        return f"{name[:-3]}y"
    return name[:-1] if name.endswith("s") and len(name) > 3 else name


def _words(text: str, by: str | None = None) -> list[str]:
    return [w.strip() for w in text.split(by) if w.strip()]


#: Column-name patterns that suggest a role, by role.
ROLE_PATTERNS = {
    "soft-delete": ["deleted_at", "deleted_on", "deletedat", "deletedon", "is_deleted"],
    "tenant-filter": ["tenant_id", "tenantid", "organization_id", "org_id"],
    "created-on": ["created_at", "created_on", "createdat"],
    "updated-on": ["updated_at", "updated_on", "modified_at"],
    "created-by": ["created_by", "createdby"],
    "updated-by": ["updated_by", "updatedby", "modified_by"],
}


def proposed_roles(table: Table) -> dict[str, str]:
    """Role to column, for roles whose patterns a column of the table matches."""
    lower = {c.lower(): c for c in table.columns}
    return {role: lower[p] for role, patterns in ROLE_PATTERNS.items() for p in reversed(patterns) if p in lower}


def is_lookup(table: Table) -> bool:
    """Two to six plain columns, one key, nothing it links to, and a name like a list of values."""
    named = re.search(r"(status|type|category|kind|level|priority|country|currency)", table.name, re.I)
    simple = not any(isinstance(c.type, (T.StructType, T.ArrayType, T.MapType, T.BinaryType)) for c in table.columns.values())
    return bool(named) and simple and 2 <= len(table.columns) <= 6 and len(table.keys) == 1 and not table.single_links


def prefix_groups(table: Table, least: int = 2) -> dict[str, list[str]]:
    """Columns that share a prefix before an underscore, where several do."""
    groups: dict[str, list[str]] = {}
    for name in table.columns:
        if "_" in name:
            groups.setdefault(name.split("_")[0], []).append(name)
    return {k: v for k, v in groups.items() if least <= len(v) < len(table.columns)}


#: Tables that tell an application's schema, by application.
KNOWN_SCHEMAS = {
    "wordpress": ["posts", "postmeta", "users", "usermeta", "options"],
    "drupal": ["node", "users", "taxonomy_term_data", "variable"],
}


def known_schema(model: Model) -> str | None:
    """The application whose tables the model has, whatever their prefix."""
    names = [t.name.lower() for t in model.tables.values()]
    return next((app for app, marks in KNOWN_SCHEMAS.items() if all(any(n.endswith(m) for n in names) for m in marks)), None)


_opened: WeakKeyDictionary = WeakKeyDictionary()  # session -> path -> DataFrame


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A file's DataFrame, whose schema is read once a session."""
    found = _opened.setdefault(spark, {})
    if path not in found:
        found[path] = spark.read.parquet(path)
    return found[path]


def sample_model(spark: SparkSession, sf_dir: str) -> Model:
    """The star-schema tables with their links; ``lineitem`` has no unique key."""
    model = Model()
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id", "labels": None, "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id"}
    for name, key in keys.items():
        model.add(name, opened(spark, f"{sf_dir}/{name}.parquet"), (key,) if key else ())
    model.link("nation", "n_regionkey", "region")
    model.link("customer", "c_nationkey", "nation")
    model.link("supplier", "s_nationkey", "nation")
    model.link("orders", "o_custkey", "customer")
    model.link("lineitem", "l_orderkey", "orders")
    model.link("lineitem", "l_partkey", "part")
    model.link("lineitem", "l_suppkey", "supplier")
    model.link("labels", "doc_id", "documents")
    model.many_to_many("orders", "lineitem", "part")
    model.table("documents").metadata["search"] = "text"
    model.table("benchmark").metadata["search"] = "text"
    return model
