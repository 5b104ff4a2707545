"""Templates, stable ids, display text, serialized PHP values."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The namespace of URLs in RFC 4122.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def template(text: str, url: bool = False) -> Column:
    """``{column}`` places filled in, percent-encoded in links; a null is empty."""
    parts = []
    for literal, name in re.findall(r"([^{]+)|\{(\w+)\}", text):
        value = F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit(literal)
        parts.append(F.url_encode(value) if name and url else value)
    return F.concat(*parts) if parts else F.lit("")


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID: the hash of namespace and name with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 64) + 128))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def display(column: Column, kind: str) -> Column:
    """Values as clients print them: yes and no, dates, plain numbers."""
    match kind:
        case "boolean":
            return F.when(column, "Yes").when(~column, "No")
        case "date":
            return F.date_format(column, "yyyy-MM-dd")
        case "timestamp":
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        case "binary":
            return F.base64(column)
        case _:
            return column.cast("string")


def php_reader():
    """The function from serialized PHP to JSON text.

    Built within a function, it travels to the workers by value: they need not have this
    package.
    """

    class Reader:
        def __init__(self, data: bytes):
            self.data, self.at = data, 0

        def take(self, mark: bytes) -> bytes:
            end = self.data.index(mark, self.at)
            out, self.at = self.data[self.at : end], end + len(mark)
            return out

        def value(self):
            kind = self.take(b";") if self.data[self.at : self.at + 2] == b"N;" else self.take(b":")
            if kind == b"N":
                return None
            if kind == b"b":
                return self.take(b";") == b"1"
            if kind == b"i":
                return int(self.take(b";"))
            if kind == b"d":
                return float(self.take(b";"))
            if kind == b"s":
                n = int(self.take(b":"))
                out = self.data[self.at + 1 : self.at + 1 + n]
                self.at += n + 2
                if self.data[self.at : self.at + 1] != b";":
                    raise ValueError("length")
                self.at += 1
                return out.decode()
            if kind in (b"a", b"O"):
                if kind == b"O":
                    self.take(b":")
                    self.take(b":")
                n = int(self.take(b":"))
                self.at += 1
                pairs = [(self.value(), self.value()) for _ in range(n)]
                self.at += 1
                if kind == b"a" and [k for k, _ in pairs] == list(range(n)):
                    return [v for _, v in pairs]
                return {str(k): v for k, v in pairs}
            raise ValueError(kind)

    def convert(text: str | None) -> str | None:
        """Serialized PHP as JSON; anything else comes back as it is."""
        if text is None:
            return None
        try:
            reader = Reader(text.encode())
            value = reader.value()
            if reader.at != len(reader.data):
                raise ValueError("rest")
            return json.dumps(value, ensure_ascii=False)
        except (ValueError, IndexError):
            return text

    return convert


def php_to_json(column: Column) -> Column:
    """Serialized PHP as JSON, in batches."""
    convert = php_reader()

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(convert)

    return run(column)
