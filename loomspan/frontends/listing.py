"""Paged reads with signed tokens, feeds, metrics text, object listings, and assistant tools."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import local, text
from ..operators import filters, keys
from ..plans.compile import Compiler
from ..plans.model import ModelError
from ..plans.nodes import UNLIMITED, And, Cmp, Filter, Or, Query, both

#: Caps of list requests.
MOST_DEPTH, MOST_PREDICATES, MOST_IN, MOST_SORTS = 32, 500, 200, 32
MOST_TOKEN = 4096
LIST_OPS = {"eq": "_eq", "neq": "_neq", "lt": "_lt", "lte": "_lte", "gt": "_gt", "gte": "_gte", "in": "_in", "contains": "_contains", "starts_with": "_starts_with", "null": "_null"}
#: Rows of a cursor's page: by default, and at most.
CURSOR_ROWS, MOST_CURSOR_ROWS = 25, 200
#: Feed items: by default, and at most.
FEED_ITEMS, MOST_FEED_ITEMS = 20, 50


def list_filter(node: dict, table, depth: int = 0, count: list | None = None) -> Filter:
    """``{and|or: [...]}`` or ``{field, op, value}``, within the caps."""
    count = [0] if count is None else count
    if depth > MOST_DEPTH:
        raise ModelError("the filter is too deep")
    for key, kind in (("and", And), ("or", Or)):
        if key in node:
            return kind(tuple(list_filter(n, table, depth + 1, count) for n in node[key]))
    count[0] += 1
    if count[0] > MOST_PREDICATES or node["op"] == "in" and len(node["value"]) > MOST_IN:
        raise ModelError("the filter is too large")
    if node["op"] not in LIST_OPS:
        raise ModelError(f"no operator {node['op']}")
    column = table.column(node["field"])
    return filters.comparison(column.name, LIST_OPS[node["op"]], node.get("value"), column.type)


def token(place: int | list, request: dict, secret: bytes) -> str:
    """Where the next page begins, by offset or by the last row's values, bound to its request."""
    body = json.dumps({"place": place, "request": request}, sort_keys=True, default=str).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + json.dumps(place).encode()).decode()


def place_of(page_token: str, request: dict, secret: bytes) -> int | list:
    if len(page_token) > MOST_TOKEN:
        raise ModelError("the page token is too long")
    try:
        place = json.loads(base64.urlsafe_b64decode(page_token.encode())[32:])
    except ValueError as e:
        raise ModelError("bad page token") from e
    if not hmac.compare_digest(token(place, request, secret), page_token):
        raise ModelError("the page token is of another request")
    return place


def list_rows(compiler: Compiler, request: dict, secret: bytes, page_token: str = "") -> tuple[DataFrame, str]:
    """A page, and the token of the page behind it."""
    offset = place_of(page_token, request, secret) if page_token else 0
    size = request.get("page_size", 100)
    return _listed(compiler, request, size, offset), token(offset + size, request, secret)


def stream_rows(compiler: Compiler, request: dict) -> DataFrame:
    """All rows of a list request, whatever its page."""
    return _listed(compiler, request, UNLIMITED, 0)


def get_row(compiler: Compiler, table: str, key: list, fields: list[str] | None = None) -> DataFrame:
    """The row of a key, or none."""
    target = compiler.model.table(table)
    return compiler.flat(Query(table, fields or [], filter=filters.primary_key(target, key)))


def _listed(compiler: Compiler, request: dict, size: int, offset: int) -> DataFrame:
    table = compiler.model.table(request["table"])
    if len(request.get("sort", [])) > MOST_SORTS:
        raise ModelError("too many sort keys")
    part = list_filter(request["filter"], table) if request.get("filter") else None
    return compiler.flat(Query(table.name, request.get("fields", []), filter=part, sort=request.get("sort", []), limit=size, offset=offset))


def cursor_rows(compiler: Compiler, table: str, columns: list[str], secret: bytes, cursor: str = "", size: int = CURSOR_ROWS, document: dict | None = None, sort: list[str] | None = None) -> tuple[DataFrame, str]:
    """A page by filter document, and the cursor of the page behind it."""
    target = compiler.model.table(table)
    request = {"table": table, "columns": columns, "filter": document, "sort": sort}
    offset = place_of(cursor, request, secret) if cursor else 0
    size = max(1, min(size, MOST_CURSOR_ROWS))
    part = filters.parse(document, compiler.model, target) if document else None
    rows = compiler.flat(Query(table, columns, filter=part, sort=sort or [], limit=size, offset=offset))
    return rows, token(offset + size, request, secret)


def seek_rows(compiler: Compiler, table: str, columns: list[str], secret: bytes, cursor: str = "", size: int = CURSOR_ROWS, document: dict | None = None, sort: list[str] | None = None) -> tuple[DataFrame, str]:
    """A page by filter document, and the cursor of the page behind it, empty at the end.

    A cursor is the last row's place in the order, so that no page sorts or skips what is
    before it.  A page has at most ``MOST_CURSOR_ROWS`` rows and is read at once, as its cursor
    is in it.
    """
    target = compiler.model.table(table)
    if not target.keys:
        raise ModelError(f"{target.name} has no key")
    request = {"table": table, "columns": columns, "filter": document, "sort": sort, "seek": True}
    size = max(1, min(size, MOST_CURSOR_ROWS))
    query = Query(table, columns, filter=filters.parse(document, compiler.model, target) if document else None)
    order = [(target.column(t.rpartition("_")[0]).name, t.endswith("_desc")) for t in sort or []]
    order += [(k, False) for k in target.keys if k not in dict(order)]
    rows = compiler.rows(query)
    if cursor:
        values = [None if v is None else F.lit(v).cast(target.columns[n].type) for (n, _), v in zip(order, place_of(cursor, request, secret))]
        rows = rows.filter(keys.beyond([(F.col(n), down) for n, down in order], values))
    rows = rows.orderBy(*compiler.order(target, sort or [])).limit(size + 1)
    shown = compiler.project(target, query)
    rows = rows.select(*shown, F.array(*[F.col(n).cast("string") for n, _ in order]).alias("__place"))
    found = rows.collect()
    page = local.frame(rows.sparkSession, [tuple(r)[: len(shown)] for r in found[:size]], T.StructType(rows.schema.fields[: len(shown)]))
    return page, token(found[size - 1]["__place"], request, secret) if len(found) > size else ""


def feed(compiler: Compiler, table: str, when: str, columns: list[str], since=None, limit: int = FEED_ITEMS, part: Filter | None = None) -> DataFrame:
    """Newest rows first, ties by key."""
    target = compiler.model.table(table)
    since_part = Cmp(target.column(when).name, "_gte", since) if since is not None else None
    query = Query(target.name, columns, filter=both(part, since_part), sort=[f"{when}_desc"], limit=max(1, min(limit, MOST_FEED_ITEMS)))
    return compiler.flat(query)


def feed_items(rows: DataFrame, title: str, link: str, guid: list[str], when: str) -> DataFrame:
    """(title, link, guid, published) by templates with ``{column}`` places."""
    return rows.select(
        text.template(title).alias("title"),
        text.template(link, url=True).alias("link"),
        text.uuid5(F.concat_ws("/", *[F.col(c).cast("string") for c in [*guid, when]])).alias("guid"),
        F.date_format(F.col(when).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
    )


def rss(title: str, items: DataFrame) -> str:
    """The items, of which there are at most ``MOST_FEED_ITEMS``, as a document."""
    rows = items.limit(MOST_FEED_ITEMS).collect()
    body = "".join(f"<item><title>{escape(r.title or '')}</title><link>{escape(r.link or '')}</link><guid>{r.guid}</guid><pubDate>{r.published}</pubDate></item>" for r in rows)
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>{escape(title)}</title>{body}</channel></rss>'


def atom(title: str, items: DataFrame) -> str:
    rows = items.limit(MOST_FEED_ITEMS).collect()
    body = "".join(f'<entry><title>{escape(r.title or "")}</title><link href="{escape(r.link or "")}"/><id>urn:uuid:{r.guid}</id><updated>{r.published}</updated></entry>' for r in rows)
    return f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{escape(title)}</title>{body}</feed>'


def exposition(name: str, series: DataFrame, labels: list[str], value: str) -> str:
    """Metrics text of a bounded series table."""
    lines = [f"# TYPE {name} gauge"]
    for r in series.orderBy(*labels).collect():
        own = ",".join('{}="{}"'.format(k, str(r[k]).replace("\\", "\\\\").replace('"', '\\"')) for k in labels)
        lines.append(f"{name}{{{own}}} {r[value]}")
    return "\n".join(lines) + "\n"


def object_listing(objects: DataFrame, key: str, prefix: str = "", delimiter: str = "", after: str = "", most: int = 1000) -> DataFrame:
    """(name, is_prefix, n) in byte order: objects, and common prefixes up to the delimiter as one entry.

    ``n`` objects stand behind an entry.  One row more than ``most`` tells that there are more.
    """
    rows = objects.select(F.col(key).alias("name")).filter(F.col("name").startswith(prefix))
    rest = F.substring(F.col("name"), len(prefix) + 1, 1 << 30)
    if delimiter:
        cut = F.instr(rest, delimiter)
        rows = rows.select(
            F.when(cut > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), cut + len(delimiter) - 1))).otherwise(F.col("name")).alias("name"),
            (cut > 0).alias("is_prefix"),
        )
    else:
        rows = rows.withColumn("is_prefix", F.lit(False))
    if after:
        rows = rows.filter(F.col("name") > after)
    return rows.groupBy("name", "is_prefix").agg(F.count("*").alias("n")).orderBy("name").limit(most + 1)


def row_context(compiler: Compiler, table: str, key: list, samples: int = 5) -> DataFrame:
    """One row with its parents and the first children of every collection."""
    target = compiler.model.table(table)
    query = Query(table, list(target.columns), filter=filters.primary_key(target, key))
    for name, link in target.single_links.items():
        query.links[name] = Query(link.parent, list(compiler.model.table(link.parent).columns))
    for name, link in target.multi_links.items():
        query.links[f"{name}_rows"] = Query(link.child, list(compiler.model.table(link.child).columns), limit=samples)
        query.link_names[f"{name}_rows"] = name
    return compiler.nested(query)
