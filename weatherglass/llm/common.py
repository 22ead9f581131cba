"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows in an Arrow batch; with it a Python worker's memory is bounded by the longest texts, not by the partition.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and bound the Arrow batches."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one is made only where none is configured (single-machine runs)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: later steps survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column's values."""
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], limit: int = 8 << 20):
    """Index ranges of texts that hold about limit bytes each (one text at least)."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or b"") > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t or b"")
    if begin < len(texts):
        yield begin, len(texts)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given, none of which df has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scalar(df: DataFrame, expr) -> object:
    return df.agg(F.expr(expr) if isinstance(expr, str) else expr).first()[0]


def passing(documents: DataFrame, verdicts) -> DataFrame:
    """The rows of documents, all columns as they are, for whose texts (a batch, as UTF-8 bytes or None) verdicts(texts) is
    true."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(verdicts(utf8(batch.column(at))), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
