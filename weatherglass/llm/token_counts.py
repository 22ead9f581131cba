"""Token counts from flat token files without an index, by separator scans.

A token file is a sequence of fixed-size little-endian ids in which each document ends with the end-of-document id. Files are
read in blocks of BLOCK_BYTES, each by itself: a vectorised search gives the positions of the separators. What a block
cannot know, the last separator before it and the number of those before it, comes from a prefix scan (running maximum and
sum) over one row a block. A document's tokens are then the distance between neighbouring separators.

write_files makes such files from texts by a byte-level BPE, one a task, in a folder that all executors share, and tells
which document is which in each file. A retried task writes the same file again, under its own name until it is whole.

Null and empty texts are documents of no tokens. Tokens after a file's last separator are a last document with ended false.
Empty files have no documents. Rows are kept, also repeated ones; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, prepare, utf8

BLOCK_BYTES = 4 << 20
END = 50256
#: How the byte-level BPE cuts texts into words (a fixed value of that tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's address."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


_encoders: dict[int, object] = {}


def encoder(ranks: bytes):
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def write_files(documents: DataFrame, folder: str, ranks_path: str, *, end: int = END, kind: str = "<u2") -> DataFrame:
    """Write documents (doc_id, text) as token files below folder. Returns, once written, (doc_id, file, ordinal)."""
    spark = prepare(documents.sparkSession)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        fs, path = store(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.bin"
        own, ordinal = f"{path}/.{name}-{task.taskAttemptId()}", 0
        encode = encoder(ranks.value).encode_ordinary
        with fs.open_output_stream(own) as out:
            for batch in batches:
                for text in utf8(batch.column(1)):
                    out.write(np.array((encode(text.decode()) if text else []) + [end], kind).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n))], names=["doc_id", "file", "ordinal"])
                ordinal += n
        fs.move(own, f"{path}/{name}")

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "doc_id long, file string, ordinal long"))


def scan_files(spark, folder: str, *, end: int = END, kind: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of each document in the token files below folder."""
    prepare(spark)
    fs, path = store(folder)
    width = np.dtype(kind).itemsize
    block = max(1, block_bytes // width)  # in ids
    found = [(x.base_name, x.size // width) for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith(".")]
    files = spark.createDataFrame(found, "file string, ids long")
    blocks = files.filter("ids > 0").select("file", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block))).alias("block"))
    tasks = max(1, min(10_000, sum(-(-n // block) for _, n in found)))

    def run(batches):
        fs, path = store(folder)
        for batch in batches:
            for file, ids, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin, last = number * block, min(ids, (number + 1) * block)
                with fs.open_input_file(f"{path}/{file}") as f:
                    f.seek(begin * width)
                    at = np.flatnonzero(np.frombuffer(f.read((last - begin) * width), kind) == end) + begin
                # The first document's end, and the tokens of those that lie in the block.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([number], pa.int64()), pa.array([ids], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([int(at[0]) if len(at) else None], pa.int64()),
                     pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))],
                    names=["file", "block", "ids", "n", "first", "last", "inner"])

    summary = blocks.repartition(tasks, "file", "block").select("file", "ids", "block").mapInArrow(run, "file string, block long, ids long, n long, first long, last long, inner array<long>")
    summary = cut(summary)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy(F.desc("block"))
    stitched = summary.select("file", "block", "ids", "n", "first", "last").withColumns({
        "base": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "ended_at": F.coalesce(F.max("last").over(before), F.lit(-1)),
        "final": F.row_number().over(after) == 1})
    ends = stitched.join(summary.select("file", "block", "inner"), ["file", "block"])
    whole = ends.filter("n > 0").select("file", "base", F.posexplode(F.concat(F.array(F.col("first") - F.col("ended_at") - 1), "inner")).alias("k", "n_tokens"))
    whole = whole.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    left = stitched.filter("final").select("file", (F.col("base") + F.col("n")).alias("ordinal"), (F.col("ids") - 1 - F.greatest("ended_at", F.coalesce("last", F.lit(-1)))).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(left.filter("n_tokens > 0"))


def remove(folder: str) -> None:
    fs, path = store(folder)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def count(documents: DataFrame, ranks_path: str, *, end: int = END) -> DataFrame:
    """doc_id and n_tokens for each row of documents, through token files that are removed afterwards."""
    spark = documents.sparkSession
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    try:
        names = write_files(documents, folder, ranks_path, end=end)
        return cut(names.join(scan_files(spark, folder, end=end), ["file", "ordinal"]).select("doc_id", "n_tokens"))
    finally:
        remove(folder)


def query(spark, sf_dir: str) -> DataFrame:
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
