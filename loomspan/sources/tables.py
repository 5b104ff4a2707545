"""Sources and sinks: files, JDBC databases, blobs, registered procedures, schema export."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import Model, ModelError

#: Driver class and URL prefix of each database.
DATABASES = {
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://"),
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://"),
    "sqlite": ("org.sqlite.JDBC", "jdbc:sqlite:"),
    "derby": ("org.apache.derby.iapi.jdbc.AutoloadedDriver", "jdbc:derby:"),  # comes with Spark
}
FORMATS = ("parquet", "orc", "json", "csv")


def read_files(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A folder or file; formats without a schema of their own need one given."""
    if kind not in FORMATS:
        raise ModelError(f"no format {kind}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("json", "csv") and schema is None:
        raise ModelError(f"{kind} needs a schema")
    return reader.option("header", "true").format(kind).load(path)


def jdbc_options(database: str, address: str, table: str, partition: tuple[str, int, int, int] | None = None, **more: str) -> dict[str, str]:
    """Reader options; ``partition`` (column, low, high, n) splits the read over the executors."""
    if database not in DATABASES:
        raise ModelError(f"no database {database}")
    driver, prefix = DATABASES[database]
    options = {"driver": driver, "url": prefix + address, "dbtable": table, "fetchsize": "10000", "pushDownAggregate": "true", "pushDownLimit": "true", **more}
    if partition:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition)))
    return options


def read_jdbc(spark: SparkSession, database: str, address: str, table: str, **more) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(database, address, table, **more)).load()


def write_jdbc(df: DataFrame, database: str, address: str, table: str, mode: str = "error", **more: str) -> None:
    """Rows into a table of a database, one connection a partition."""
    options = jdbc_options(database, address, table, **more)
    df.write.format("jdbc").mode(mode).options(**options).save()


def model_of_folder(spark: SparkSession, folder: str, tables: dict[str, tuple[str, ...]], kind: str = "parquet") -> Model:
    """A model of files named after their tables, with the keys given and links by name."""
    model = Model()
    for name, keys in tables.items():
        model.add(name, read_files(spark, f"{folder}/{name}.{kind}", kind), keys)
    model.infer_links()
    return model


def model_of_catalog(spark: SparkSession, database: str, keys: dict[str, tuple[str, ...]]) -> Model:
    """A model of the session's catalog."""
    model = Model()
    for found in spark.catalog.listTables(database):
        model.add(found.name, spark.table(f"{database}.{found.name}"), keys.get(found.name, ()))
    model.infer_links()
    return model


def introspection(spark: SparkSession, model: Model) -> DataFrame:
    """One row a column."""
    rows = [(t["schema"], t["table"], c["name"], c["scalar"], c["nullable"], c["is_key"]) for t in model.overview() for c in t["columns"]]
    return spark.createDataFrame(rows, "schema string, table string, column string, scalar string, nullable boolean, is_key boolean")


def export_schema(model: Model) -> str:
    """The model as JSON text."""
    return json.dumps(model.overview(), indent=2, sort_keys=True)


def blobs(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modified, bytes, content) of files of any kind."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def write_blobs(rows: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """(name, digest, bytes): each content as a file of its SHA-256, in any file system that Arrow can reach.

    Files are written when the result is computed.  Equal contents are one file, and a repeated
    task leaves the same; a null content has none.  Folders of several hosts must be shared ones.
    """
    uri = re.sub("^file:/+", "/", folder.rstrip("/"))
    kind = T.StructType([rows.schema[name], T.StructField("digest", T.StringType()), T.StructField("bytes", T.LongType())])

    def run(batches):
        system, root = fs.FileSystem.from_uri(uri)
        system.create_dir(root, recursive=True)
        for batch in batches:
            digests = []
            for value in batch.column(1):
                blob = value.as_buffer()
                digests.append(None if blob is None else hashlib.sha256(blob).hexdigest())
                if blob is not None:
                    part = f"{root}/_{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write(blob)
                    system.move(part, f"{root}/{digests[-1]}")
            sizes = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), sizes], names=[name, "digest", "bytes"])

    return rows.select(name, content).mapInArrow(run, kind)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_loomspan_files"
    return f"{base.rstrip('/')}/loomspan/{name}-{uuid.uuid4().hex[:12]}"


class Procedures:
    """Named table functions with checked parameters."""

    def __init__(self):
        self._found: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {}

    def register(self, name: str, function: Callable[..., DataFrame], parameters: tuple[str, ...] = ()) -> None:
        self._found[name] = (function, parameters)

    def call(self, name: str, **given) -> DataFrame:
        if name not in self._found:
            raise ModelError(f"no procedure {name}")
        function, parameters = self._found[name]
        if set(given) != set(parameters):
            raise ModelError(f"{name} takes {', '.join(parameters) or 'nothing'}")
        return function(**given)


def write_files(df: DataFrame, path: str, kind: str = "parquet", partition: list[str] | None = None, mode: str = "error") -> None:
    """Files by partition columns; an existing path is an error unless the mode says otherwise."""
    if kind not in FORMATS:
        raise ModelError(f"no format {kind}")
    writer = df.write.mode(mode).option("header", "true")
    (writer.partitionBy(*partition) if partition else writer).format(kind).save(path)


class SavedObjects:
    """Named documents of an owner, as one small JSON folder through Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, owner: str, name: str) -> str:
        for part in (owner, name):
            if not part.replace("-", "").replace("_", "").isalnum():
                raise ModelError(f"bad name {part!r}")
        return f"{self.folder}/{owner}/{name}"

    def save(self, owner: str, name: str, document: dict) -> None:
        self.spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(self._path(owner, name))

    def load(self, owner: str, name: str) -> dict:
        return json.loads(self.spark.read.text(self._path(owner, name), wholetext=True).first()[0])
