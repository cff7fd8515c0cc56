"""Written tables in the cluster's shared scratch folder, which cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch while a scratch table is written: a task holds it once in the JVM and about twice in its Python worker.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of ids, or of a few numbers, up to which a counted table is sent to every executor: some 100 MB there at most.
SMALL = 4_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; without one a temporary folder in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewire-"))
    return sc._jsc.sc().getCheckpointDir().get()


class small_batches:  # noqa: N801
    """While it is open, Arrow batches are of ``BATCH_BYTES`` at most; the session's own setting comes back afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.said = self.spark.conf.get(BATCH_SETTING)
        now = 0 if self.said.startswith("-") else self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(self.said)
        if now <= 0 or now > BATCH_BYTES:
            self.spark.conf.set(BATCH_SETTING, BATCH_BYTES)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(BATCH_SETTING, self.said)


class Scratch:
    """Parquet tables in the shared scratch folder.

    ``drop`` removes a table as soon as nothing reads it any more; what a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_dir(spark).rstrip('/')}/tidewire-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def save(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.base}/{self.n}"
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def sized(saved: DataFrame, rows: int = SMALL) -> DataFrame:
    """A written table of a few numbers a row: marked to be broadcast if it has ``rows`` rows at most, else left to a shuffle join."""
    return F.broadcast(saved) if saved.count() <= rows else saved
