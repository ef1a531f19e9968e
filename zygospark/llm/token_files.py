"""Flat token files: written by a public tokenizer, and scanned block by block for document ends."""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospark.llm.rows import long_id, written
from zygospark.session import _shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pattern for splitting text before its merges; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256  # the id that the vocabulary leaves free
KIND = np.dtype("<u2")
BLOCK_TOKENS = 1 << 20
SUPER = 1024  # blocks whose ends are added up before the scan goes over a whole file

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    if vocabulary not in _encoders:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file that all executors share."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _write(folder: str, vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file per task: every text's tokens, then the end.  The file gets its name when it is whole, so a repeated task replaces it."""
    store, base = _store(folder)
    code = encoder(vocabulary)
    task = TaskContext.get()
    name = f"tokens-{task.partitionId():06d}.bin"
    temporary = f"{base}/.{name}.{task.taskAttemptId()}"
    number = 0
    store.create_dir(base, recursive=True)
    with store.open_output_stream(temporary) as out:
        for batch in batches:
            texts = batch["text"].fill_null("")
            for text in texts:
                tokens = np.array([*code.encode_ordinary(text.as_py()), END], KIND)
                out.write(tokens.tobytes())
            numbers = pa.array(np.arange(number, number + len(texts)))
            number += len(texts)
            yield pa.record_batch([pa.array([name] * len(texts), pa.string()), numbers, batch["doc_id"]], names=["file", "number", "doc_id"])
    store.move(temporary, f"{base}/{name}")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write docs as flat files of 16-bit ids; (file, number, doc_id) says which document is which in its file.

    Null texts are empty; null doc_ids stay null.
    """
    return written(long_id(docs).mapInArrow(partial(_write, folder, vocabulary), "file string, number long, doc_id long"))


def _ends(end: int, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the ends in each block, in tokens from the file's start."""
    size = np.dtype(kind).itemsize
    for batch in batches:
        found = []
        for path, first, tokens in zip(*(batch[c].to_pylist() for c in ("path", "first", "tokens")), strict=True):
            store, at = _store(path)
            with store.open_input_file(at) as file:
                file.seek(first * size)
                block = np.frombuffer(file.read(tokens * size), kind)
            found.append(np.flatnonzero(block == end) + first)
        bounds = np.concatenate(([0], np.cumsum([len(f) for f in found])))
        ends = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64()))
        yield pa.record_batch([batch["path"], batch["block"], batch["tokens"], ends], names=["path", "block", "tokens", "ends"])


def scan_tokens(spark: SparkSession, folder: str, end: int = END, kind: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, number, start, n_tokens, ended) of every document in the flat token files of a folder.

    The files have no index: a document is what lies between two ends, or
    between the last end and the file's end (ended is then false).  Files are
    read in blocks, by any number of tasks; each block is searched for ends at
    once.  Two scans carry the last end and the number of ends from block to
    block: inside runs of 1024 blocks, then over the runs of a file, so one
    very long file is no single task's work.  start and n_tokens count tokens,
    the end itself not included.  Bytes after the last whole token are left
    out; empty files and folders give no rows.
    """
    size = np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", F.floor(F.col("length") / size).alias("all"))
    blocks = files.filter("all > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / block_tokens))))
    first = F.col("block") * block_tokens
    blocks = blocks.select("path", "block", first.alias("first"), F.least(F.lit(block_tokens), F.col("all") - first).alias("tokens"))
    tasks = max(1, spark.sparkContext.defaultParallelism)
    blocks = blocks.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "block")
    found = written(blocks.mapInArrow(partial(_ends, end, kind), "path string, block long, tokens long, ends array<long>"))

    run = F.floor(F.col("block") / SUPER).alias("run")
    brief = found.select("path", "block", run, F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    inside = before("path", "run", "block")
    brief = brief.select("path", "block", "run", F.sum("n").over(inside).alias("n0"), F.max("last").over(inside).alias("last0"))
    runs = found.groupBy("path", run).agg(F.sum(F.size("ends")).alias("n"), F.max(F.try_element_at("ends", F.lit(-1))).alias("last"))
    over = before("path", "run")
    runs = runs.select("path", "run", F.sum("n").over(over).alias("n1"), F.max("last").over(over).alias("last1"))
    carried = brief.join(runs, ["path", "run"]).select(
        "path",
        "block",
        (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("number0"),
        (F.coalesce("last0", "last1", F.lit(-1)) + 1).alias("begin"),
    )
    whole = found.join(carried, ["path", "block"])
    ends = whole.select("path", "number0", "begin", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("begin")).otherwise(F.element_at("ends", F.col("i")) + 1)
    done = ends.select("path", (F.col("number0") + F.col("i")).alias("number"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    every = found.groupBy("path").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.size("ends")).cast("long").alias("number"), F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))), F.lit(-1)).alias("last")
    )
    rest = every.filter("last + 1 < tokens").select("path", "number", (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return done.union(rest).select(F.element_at(F.split("path", "/"), -1).alias("file"), "number", "start", "n_tokens", "ended")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs, by way of flat token files in the shared folder.

    Null and empty texts have no tokens.  Repeated rows are counted each.
    """
    spark = docs.sparkSession
    folder = os.path.join(_shared_folder(spark), f"tokens-{uuid.uuid4().hex}")
    names = write_tokens(docs, folder, vocabulary)
    if names.isEmpty():
        return names.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    counts = scan_tokens(spark, folder)
    return names.join(counts, ["file", "number"]).select("doc_id", "n_tokens")
