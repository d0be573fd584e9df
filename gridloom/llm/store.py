"""Working tables in the folder that all machines share, and code that reaches the executors."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_by_value() -> None:
    """Executors need not have this package installed: its functions travel with the task."""
    cloudpickle.register_pickle_by_value(sys.modules["gridloom"])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytes of a batch that goes to Python, at most: it is held several times on both sides.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Parquet tables of one run. Writing one cuts lineage, and any executor can read it again.

    Results read the tables that are left, so these stay until ``clear``, or until who made the result asks ``sweep`` to
    delete them, once it is written elsewhere.
    """

    #: Folders that were not cleared, in the order of their making.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.made.append(self)

    def table(self, df: DataFrame, name: str, wide: bool = False) -> DataFrame:
        """Write and reread. Unless ``wide`` (about as large as the input), in a file or two per core, not one per partition."""
        if not wide:
            df = df.coalesce(2 * self.spark.sparkContext.defaultParallelism)
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()  # Spark deletes the shuffle files of plans that are gone


    def clear(self) -> None:
        self.drop("")
        Scratch.made = [x for x in Scratch.made if x is not self]


def sweep(before: list[Scratch]) -> None:
    """Delete all working tables but those that were there ``before``."""
    for x in list(Scratch.made):
        if x not in before:
            x.clear()


class Shared:
    """A broadcast of any object, pickled with its code, so that executors can read it without this package."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def get(self):
        if self.held is None:
            import pickle

            self.held = pickle.loads(self.sent.value)
        return self.held

    def __getstate__(self):
        return {"sent": self.sent, "held": None}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
