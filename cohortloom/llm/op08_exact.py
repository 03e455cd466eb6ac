"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes. Each chunk has its polynomial value modulo two primes,
and a document's fingerprint is combined from those of its chunks: F(ab) = F(a) * x^len(b) + F(b). Rows of equal
fingerprint and length are only candidates: they are compared chunk by chunk with their group's first row, and
rows that differ from it are compared among themselves in another round. A group of more than HOT rows is compared in
shares of that size, each of which gets the first row's chunks.

Defined cases: a null text is never a copy; empty texts are copies of each other; the kept row is the one of the
least id (null before all) and then least text hash; repeated rows are copies of each other; an empty table gives
no rows; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

CHUNK = 4096
COMPARE = 1 << 16  # bytes compared at once
HOT = 10_000
PRIMES = (2147483647, 2147483629)
BASE = (1103515245, 1664525)


def _powers(x: int, p: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * x % p
    return out


_LOW = [_powers(x, p, CHUNK + 1) for x, p in zip(BASE, PRIMES)]
_high: list[np.ndarray] = [_powers(pow(x, CHUNK, p), p, 64) for x, p in zip(BASE, PRIMES)]


def combine(a: tuple[int, int], b: tuple[int, int], b_len: int) -> tuple[int, int]:
    """The fingerprint of a text from those of its two halves; b_len: bytes of the second."""
    return tuple((h * pow(x, b_len, p) + k) % p for h, k, x, p in zip(a, b, BASE, PRIMES))


def fingerprints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, bytes) of every text of an Arrow string or binary array."""
    off, data = tokens.buffers(arr)
    size = np.diff(off)
    n_chunks = -(-size // CHUNK)
    doc = np.repeat(np.arange(len(size)), n_chunks)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    start = off[:-1][doc] + k * CHUNK
    end = np.minimum(start + CHUNK, off[1:][doc])
    out = np.zeros(len(size), np.uint64)
    after = (n_chunks[doc] - 1 - k).astype(np.int64)  # chunks that follow
    last = size - (n_chunks - 1) * CHUNK
    for i, (x, p) in enumerate(zip(BASE, PRIMES)):
        if len(after) and after.max() > len(_high[i]):
            _high[i] = _powers(pow(x, CHUNK, p), p, int(after.max()) * 2)
        h = np.zeros(len(doc), np.uint64)
        at = 0
        while at < len(doc):  # in slices, so that temporaries stay small
            to = max(at + 1, int(np.searchsorted(end, start[at] + tokens.SLICE, "right")))
            b = data[start[at] : end[to - 1]].astype(np.uint64) + np.uint64(1)
            back = np.repeat(end[at:to], end[at:to] - start[at:to]) - 1 - np.arange(start[at], end[to - 1])
            h[at:to] = np.add.reduceat(b * _LOW[i][back], start[at:to] - start[at]) % np.uint64(p)
            at = to
        # bytes after a chunk: full chunks, then the document's last
        shift = np.where(after > 0, _LOW[i][last[doc]] * _high[i][np.maximum(after - 1, 0)] % np.uint64(p), np.uint64(1))
        total = np.zeros(len(size), np.uint64)
        np.add.at(total, doc, h * shift % np.uint64(p))
        out = (out << np.uint64(31)) | (total % np.uint64(p))
    return out.view(np.int64), size


def _fingerprint_batches(batches):
    for b in batches:
        if b.num_rows:
            fp, size = fingerprints(b.column(b.num_columns - 1))
            keep = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(fp), pa.array(size)], names=[*b.schema.names, "fp", "n_bytes"])


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(__id, __th, fp, n_bytes[, __text]) of every row whose text isn't null."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(*common.row_key(id_col, text_col), F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType()), T.StructField("n_bytes", T.LongType())])
    out = rows.mapInArrow(_fingerprint_batches, schema)
    return out if with_text else out.drop("__text")


def _chunks(text: Column) -> Column:
    """Array of a text's pieces of COMPARE bytes; an empty text has one empty piece."""
    raw = F.encode(text, "UTF-8")
    last = F.floor((F.greatest(F.length(raw), F.lit(1)) - 1) / COMPARE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * COMPARE + 1, F.lit(COMPARE)))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 62, hot: int = HOT) -> DataFrame:
    """(__id, __th, first_id, first_th, n) for all rows of groups of equal texts of two rows or more; n: rows of this key.

    bits: how many of the fingerprint are looked at; fewer mean more candidates to compare, never another result.
    """
    spark = docs.sparkSession
    part = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1)).alias("fp")
    key = ["fp", "n_bytes"]
    sized = fingerprinted(docs, id_col, text_col).select(part, "n_bytes").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups, groups_path = common.materialize(sized.select(*key, F.ceil(F.col("n") / hot).cast("int").alias("shares")), "equal-fingerprints")
    found = fingerprinted(docs, id_col, text_col, with_text=True).withColumn("fp", part).join(groups, key)
    share = F.pmod(F.xxhash64("__id", "__th", F.spark_partition_id()), F.col("shares")).cast("int")
    pieces = found.select(*key, "shares", share.alias("share"), "__id", "__th", F.posexplode(_chunks(F.col("__text"))).alias("k", "piece"))
    pieces, pieces_path = common.materialize(pieces, "candidate-pieces")
    to_all = lambda df: df.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    todo, done, paths = pieces, [], [groups_path, pieces_path]
    while True:
        first = todo.groupBy(*key).agg(F.min(F.struct("__id", "__th")).alias("first"), F.max("shares").alias("shares"))
        marked = todo.join(to_all(first), [*key, "share"])
        is_first = F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__th") == F.col("first.__th"))
        heads = marked.filter(is_first).groupBy(*key, "k").agg(F.first("piece").alias("head"), F.max("shares").alias("shares"))
        seen = marked.join(to_all(heads), [*key, "share", "k"], "left").groupBy(*key, "__id", "__th").agg(
            F.first("first.__id").alias("first_id"), F.first("first.__th").alias("first_th"),
            F.bool_and(F.coalesce(F.col("piece") == F.col("head"), F.lit(False))).alias("same"),
            F.count(F.when(F.col("k") == 0, 1)).alias("n"))
        seen, path = common.materialize(seen, "compared")
        paths.append(path)
        done.append(seen.filter("same"))
        other = seen.filter("not same").select(*key, "__id", "__th")
        if other.isEmpty():
            break
        o = other.withColumnsRenamed({"__id": "o_id", "__th": "o_th", "fp": "o_fp", "n_bytes": "o_n"})
        todo = todo.join(o, (F.col("fp") == F.col("o_fp")) & (F.col("n_bytes") == F.col("o_n")) & F.col("__id").eqNullSafe(F.col("o_id")) & (F.col("__th") == F.col("o_th")), "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    sizes = out.groupBy("fp", "n_bytes", "first_id", "first_th").agg(F.sum("n").alias("rows")).filter("rows > 1")
    s = sizes.select(F.col("fp").alias("s_fp"), F.col("n_bytes").alias("s_n"), F.col("first_id").alias("s_id"), F.col("first_th").alias("s_th"))
    out = out.join(s, (F.col("fp") == F.col("s_fp")) & (F.col("n_bytes") == F.col("s_n")) & F.col("first_id").eqNullSafe(F.col("s_id")) & (F.col("first_th") == F.col("s_th")), "left_semi")
    out, _ = common.materialize(out.select("__id", "__th", "first_id", "first_th", "n"), "copies")
    common.release(spark, *paths)
    return out


def _is_first() -> Column:
    return F.col("__id").eqNullSafe(F.col("first_id")) & (F.col("__th") == F.col("first_th"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dup_of): a row for every row of docs whose text an earlier row has; dup_of is the kept row's id."""
    extra = F.col("n") - F.when(_is_first(), 1).otherwise(0)
    return verdicts(docs, id_col, text_col).filter(extra > 0).select(
        F.col("__id").alias("doc_id"), F.col("first_id").alias("dup_of"), F.explode(F.sequence(F.lit(1), extra)).alias("i")).drop("i")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; its columns are untouched, rows with null text stay."""
    decided = verdicts(docs, id_col, text_col).select("__id", "__th", _is_first().alias("__keep"))
    return common.apply_decisions(docs, decided, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, dup_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_of,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i
  FROM documents WHERE text IS NOT NULL) t
WHERE i > 1
"""
