"""What the operators of this subpackage share: table access, durable cuts of lineage, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.spread import spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table; with a key its rows are spread over all cores where its files alone don't do that."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, key) if key else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Only a local-mode session without that
    setting gets a temporary folder of its own; a cluster without it is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir().rsplit("/", 1)[0]


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: smaller than a checkpoint, columns prune."""
    path = f"{shared_dir(df.sparkSession)}/docloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def partitions_for(df: DataFrame, column: str, per: int) -> int:
    """How many partitions hold about per bytes each of what df is made from; the session's shuffle partitions at least.

    The size is that of the tables that are read, as the optimizer knows it; where it doesn't, the column is measured.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
    return max(least, -(-size // per))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Text that is all ASCII takes the cheaper built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bound(f: Callable[[Column], Column], **values: Column) -> Column:
    """f of a struct of the values, each evaluated once even where f uses it inside a lambda."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), f), F.lit(0))
