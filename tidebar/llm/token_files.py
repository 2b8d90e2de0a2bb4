"""Token counts of flat, unindexed token files by a separator scan.

A token file is a run of little-endian ids with an end-of-document id after each document
and nothing else. Files are cut into blocks of a fixed number of ids; a task reads its
block and finds all separators in one vectorised comparison. Documents cross block borders,
so a prefix scan over the blocks' summaries (separators so far, place of the last one)
gives each separator its document's number and start.

Edge cases: an empty document is a separator alone and counts 0; ids after the last
separator of a file are a document that isn't ended; an empty file gives no rows. Null
texts are written as empty; repeated rows are each written; an empty table writes no file.
Texts are encoded whole; runs of blanks or of one letter may be millions of characters long.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidebar.llm.common import fresh_folder, saved
from tidebar.llm.warc import open_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed values of that vocabulary: how it splits text, and the id that it leaves free
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
# runs of white space, as the pattern's \s means it, from this length on
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")
DTYPE = "<u2"
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 24
_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer, read once in each worker."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[vocabulary] = tiktoken.Encoding("flat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def encode(enc, text: str) -> list[int]:
    """All of a text's ids. Very long runs of blanks are cut out by hand, as the split pattern's search doesn't survive them.

    The pattern takes a run up to its last blank as one piece (all of it at the end of the text), so
    such a piece goes to the merges alone, and texts before and after it are split as ever.
    """
    out, at = [], 0
    for run in LONG_BLANK.finditer(text):
        to = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : to])
        at = to
    return out + enc.encode_ordinary(text[at:])


def _writer(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get(), encoder(vocabulary)
        fs, root = open_folder(folder)
        sink, path, size, number, ordinal = None, "", 0, 0, 0
        end = np.array([END], DTYPE).tobytes()
        for batch in batches:
            ids, first = batch.column(0), 0
            texts = batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                if sink is None:
                    path, size, ordinal = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.bin", 0, 0
                    sink, number = fs.open_output_stream(path, compression=None), number + 1
                tokens = np.array(encode(enc, text or ""), DTYPE)
                sink.write(tokens.tobytes() + end)
                size, ordinal = size + len(tokens) + 1, ordinal + 1
                if size >= FILE_IDS or i == len(texts) - 1:
                    part = ids.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ordinal - len(part)], pa.int64()), pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["path", "first", "upto", "ids"])
                    first = i + 1
                if size >= FILE_IDS:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()

    return run


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Write texts as token files; (path, first, upto, ids) tells which documents stand where, the files don't.

    A row names the ids of a batch's documents in a file, the number of the first one, and the file's length so far.
    """
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    kind = docs.schema[id_col].dataType.simpleString()
    return saved(docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(_writer(folder, vocabulary), f"path string, first long, upto long, ids array<{kind}>"))


def _scanner(folder: str, end: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for path, block, start, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(count * width, start * width), dtype)
                found = np.flatnonzero(ids == end) + start
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([start + len(ids)], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["path", "block", "upto", "ends"])

    return run


def scan_token_files(files: DataFrame, folder: str, end: int = END, dtype: str = DTYPE, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(path, ordinal, start, n_tokens, ended) of each document of the files (path, ids)."""
    blocks = files.where("ids > 0").select("path", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block_ids))).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * block_ids).alias("start"), F.least(F.col("ids") - F.col("block") * block_ids, F.lit(block_ids).cast("long")).alias("count"))
    found = saved(blocks.repartition("path", "block").mapInArrow(_scanner(folder, end, dtype), "path string, block long, upto long, ends array<long>"))
    line = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one narrow row a block: separators before it, and where the document begins that reaches into it
    before = found.select(
        "path",
        "block",
        F.coalesce(F.sum(F.size("ends")).over(line), F.lit(0)).alias("ordinal0"),
        F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).over(line) + 1, F.lit(0).cast("long")).alias("start0"),
    )
    placed = found.join(before, ["path", "block"])
    docs = placed.select("path", "ordinal0", "start0", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("start0")).otherwise(F.get("ends", F.col("k") - 1) + 1)
    ended = docs.select("path", (F.col("ordinal0") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    last = found.groupBy("path").agg(F.max("upto").alias("upto"), F.sum(F.size("ends")).cast("long").alias("ordinal"), F.coalesce(F.max(F.array_max("ends")) + 1, F.lit(0).cast("long")).alias("start"))
    tail = last.where("start < upto").select("path", "ordinal", "start", (F.col("upto") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(tail)


def count_tokens(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the texts as token files, scan the files and name the counts: (id, path, ordinal, start, n_tokens)."""
    folder = folder or fresh_folder(docs.sparkSession, "tokens")
    written = write_token_files(docs, folder, id_col, text_col, vocabulary)
    files = written.groupBy("path").agg(F.max("upto").alias("ids"))
    counted = scan_token_files(files, folder)
    named = written.select("path", "first", F.posexplode("ids").alias("k", "id")).select("path", (F.col("first") + F.col("k")).alias("ordinal"), "id")
    return named.join(counted, ["path", "ordinal"]).select(F.col("id").alias(id_col), F.regexp_extract("path", "[^/]+$", 0).alias("file"), "ordinal", "start", "n_tokens")
