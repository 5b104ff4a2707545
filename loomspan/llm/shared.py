"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset, as in
local tests, a folder below the SQL warehouse is used.  A written table cuts lineage:
a later stage that loses an executor reads the table again instead of recomputing
everything before it.
"""

from __future__ import annotations

import atexit
import importlib.util
import os
import pickle
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .textscan import give_back

#: For one write: shuffle files go when it ends, and what a Python worker gets at once is bounded.
ACTION = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loomspan_checkpoints"
    return found.rstrip("/") + "/loomspan"


@contextmanager
def setting(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of one action, then as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, through Spark's own file server where need be."""
    package = __name__.split(".")[0]
    home = os.path.dirname(os.path.dirname(importlib.util.find_spec(package).origin))
    app = spark.sparkContext.applicationId
    if app in _shipped or home in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp()  # on the driver; Spark serves it while the application lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{package}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(f"{home}/{package}"):
            for name in names:
                if name.endswith(".py"):
                    out.write(f"{top}/{name}", os.path.relpath(f"{top}/{name}", home))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


class Workspace:
    """Tables of one operator run, below one folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back; its shuffle files go when the write has ended."""
        path = f"{self.root}/{name}"
        with setting(self.spark, ACTION):
            df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt out to all of them.

    So few parts hold little: one file of one row group, as small tables are.  Larger
    tables stay as they are scanned.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than one row beyond that."""
    return df.limit(most_rows + 1).agg(F.count(F.lit(1))).first()[0] <= most_rows


def least_hashes(texts: DataFrame, counts: dict, most: int, of: str, most_bytes: int | None = None) -> DataFrame:
    """The ``most`` rows of least hash ``h`` for each value of column ``of``, which ``counts`` rows have; hashes are distinct.

    With ``most_bytes``, only as many of these as have that many bytes by column ``size``.
    Hashes are spread evenly, so that few beyond ``most`` need be sorted.
    """
    below = {k: int(-(1 << 63) + share * (1 << 64)) for k, n in counts.items() for share in [(most + 8 * most**0.5 + 32) / max(n, 1)] if share < 1}
    if below:
        bounds = texts.sparkSession.createDataFrame(list(below.items()), texts.select(F.col(of).alias("__of"), F.lit(0).cast("long").alias("__below")).schema)
        texts = texts.join(F.broadcast(bounds), F.col(of) == F.col("__of"), "left").filter("__below IS NULL OR h < __below").drop("__of", "__below")
    by_hash = Window.partitionBy(of).orderBy("h")
    texts = texts.withColumn("__first", F.row_number().over(by_hash)).filter(F.col("__first") <= most).drop("__first")
    if most_bytes is None:
        return texts
    return texts.withColumn("__bytes", F.sum("size").over(by_hash)).filter(F.col("__bytes") <= most_bytes).drop("__bytes")


def fitted(sample: DataFrame, train: Callable[[pa.Table], object]) -> object:
    """What ``train`` makes of a bounded ``sample``, in one task of an executor; the driver gets no more than the model."""
    nothing = to_arrow_schema(sample.schema).empty_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        model = pickle.dumps(train(pa.Table.from_batches(rows) if rows else nothing))
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    with setting(sample.sparkSession, ACTION):
        found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else train(nothing)
