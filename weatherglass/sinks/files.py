"""Files of any store that Spark reads, and names for them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    store, own = _at(spark, path)
    return store.exists(own)


def remove(spark: SparkSession, path: str) -> None:
    store, own = _at(spark, path)
    store.delete(own, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths of the data files in a folder; none if there is no such folder."""
    store, own = _at(spark, path)
    return sorted(str(f.getPath()) for f in store.listStatus(own) if f.isFile() and f.getPath().getName()[0] not in "._") if store.exists(own) else []


def moved(spark: SparkSession, path: str, folder: str) -> None:
    """Move a file into a folder, under its own name."""
    store, own = _at(spark, path)
    _, to = _at(spark, folder)
    store.mkdirs(to)
    if not store.rename(own, to):
        raise OSError(f"could not move {path} to {folder}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that is there as a whole or not at all."""
    store, own = _at(spark, path)
    _, first = _at(spark, f"{path}.part")
    out = store.create(first, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not store.rename(first, own):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def safe_name(name: Column) -> Column:
    """The base name with all but letters, digits, dot, underscore and dash replaced; it ends in .csv."""
    base = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    plain = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"), r"^\.+", "")
    plain = F.when(plain == "", F.lit("upload")).otherwise(plain)
    return F.when(F.lower(plain).endswith(".csv"), plain).otherwise(F.concat(plain, F.lit(".csv")))
