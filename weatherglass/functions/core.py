"""Small Columns that many operators use."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import CHANNELS

MINUTE = 60_000_000
ROOT = str(Path(__file__).resolve().parents[2])


def importable(df: DataFrame) -> DataFrame:
    """df, after telling its Python workers where this package lies: pandas functions then work from any folder."""
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is set on a single machine."""
    sc = spark.sparkContext
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def file_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, size and time of each file of the tables at paths, in any file system that Spark reads; missing ones have none."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            files = fs.listFiles(path, True)
            while files.hasNext():
                f = files.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as Parquet: what reads it has its columns pruned, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def minutes(a: Column, b: Column) -> Column:
    """Minutes from a to b, both in microseconds."""
    return (b - a) / float(MINUTE)


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def computed_once(df: DataFrame) -> DataFrame:
    """df, for filters on columns of large expressions: Spark would repeat these in the filter, but moves none past a generator."""
    return df.select(F.inline_outer(F.array(F.struct("*"))))


def clamp(x: Column, most) -> Column:
    return F.greatest(-F.lit(most), F.least(F.lit(most), x)) if not isinstance(most, Column) else F.greatest(-most, F.least(most, x))


def long_form(df: DataFrame, *keep: str) -> DataFrame:
    """One row per channel: keep, channel, value."""
    return df.unpivot(list(keep), list(CHANNELS), "channel", "value")


def wilson(a: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share, in percent."""
    p, z2 = a / n, z * z
    middle, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return 100 * (middle - half) / (1 + z2 / n), 100 * (middle + half) / (1 + z2 / n)
