"""Stupid-backoff scores of all documents.

Documents are laid out in chunks by a hash of their row and each chunk's n-grams of orders 1 to 3 are exploded,
as 64-bit hashes with their counts, packed and sorted, to the hash range of their bucket. A bucket sums the counts of
all chunks, which is its partition of the count tables, and joins them to the n-grams that came: each chunk gets the
corpus counts of its own n-grams. There every word's score is looked up and summed by document.

A document is scored by the counts of all other documents (its own are taken off), so that its own words don't
vouch for themselves: S(w | u v) = c(u v w) / c(u v) if c(u v w) > 0, else ALPHA * S(w | v), and so on down to
c(w) / N, where an unseen word counts once.

Defined cases: null and empty texts have no words, a score of 0 and no mean; a repeated row is a document of its
own, so its copy vouches for it; an empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

ORDER = 3
ALPHA = 0.4
CHUNK_BYTES = 3 << 20  # of a chunk, as stored


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, counts)."""
    x = np.sort(x)
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.r_[at, len(x)])


def _keys(words: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return _distinct(np.concatenate([tokens.ngrams(words, starts, n)[0] for n in range(1, order + 1)]))


def _ask(n_buckets: int, order: int):
    bounds = tokens.bucket_bounds(n_buckets)

    def ask(t: pa.Table) -> pa.Table:
        keys, count = _keys(*tokens.word_hashes(pa.concat_tables(common.unpacked(t)).column("text")), order)
        at = np.r_[np.searchsorted(keys, bounds), len(keys)]
        used = np.flatnonzero(np.diff(at))
        return pa.table({
            "bucket": pa.array(used, pa.int64()), "chunk": pa.array(np.full(len(used), t.column("chunk")[0].as_py()), pa.int64()),
            "grams": pa.array([tokens.pack_sorted(keys[at[b] : at[b + 1]]) for b in used], pa.binary()),
            "counts": pa.array([tokens.pack(count[at[b] : at[b + 1]].astype(np.int64)) for b in used], pa.binary())})

    return ask


def _answer(t: pa.Table) -> pa.Table:
    keys = [tokens.unpack_sorted(c.as_py()) for c in t.column("grams")]
    counts = [tokens.unpack(c.as_py(), np.int64) for c in t.column("counts")]
    ends = np.cumsum([len(k) for k in keys])
    key, count = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    o = np.argsort(key)
    key = key[o]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sums = np.add.reduceat(count[o], at)
    total = np.empty(len(key), np.int64)
    total[o] = np.repeat(sums, np.diff(np.r_[at, len(key)]))
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "totals": pa.array([tokens.pack(x) for x in np.split(total, ends[:-1])], pa.binary())})


def other_counts(grams: np.ndarray, pos: np.ndarray, doc: np.ndarray, keys: np.ndarray, totals: np.ndarray, shift: int, n_words: int) -> np.ndarray:
    """For each word the count, in other documents, of the n-gram that ends there; 0 where there is none."""
    out = np.zeros(n_words, np.int64)
    if not len(grams):
        return out
    o = np.argsort(grams, kind="stable")
    g, d = grams[o], doc[pos[o]]
    new = np.r_[True, g[1:] != g[:-1]]
    run = np.flatnonzero(new | np.r_[True, d[1:] != d[:-1]])
    size = np.diff(np.r_[run, len(g)])
    out[pos[o] + shift] = np.repeat(totals[np.searchsorted(keys, g[run])] - size, size)
    return out


def score_words(words: np.ndarray, starts: np.ndarray, keys: np.ndarray, totals: np.ndarray, order: int = ORDER, alpha: float = ALPHA):
    """(log score without the log N of unigrams, order used) of every word."""
    doc, n = tokens.doc_of(starts), len(words)
    counts = [other_counts(*tokens.ngrams(words, starts, k), doc, keys, totals, k - 1, n) for k in range(1, order + 1)]
    place = np.arange(n) - starts[:-1][doc] if n else np.zeros(0, np.int64)
    score, used = np.log(np.maximum(counts[0], 1)), np.ones(n, np.int64)
    for k in range(2, order + 1):
        seen = counts[k - 1] > 0
        i = np.flatnonzero(seen)
        score[i] = np.log(counts[k - 1][i]) - np.log(counts[k - 2][i - 1])
        used[i] = k
    score += math.log(alpha) * (np.minimum(place + 1, order) - used)
    return score, used


def _score(order: int, alpha: float):
    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        docs = pa.concat_tables(common.unpacked(packed))
        words, starts = tokens.word_hashes(docs.column("text"))
        keys, _ = _keys(words, starts, order)
        by = np.argsort(answers.column("bucket").to_numpy()) if answers.num_rows else []
        cells = answers.column("totals")
        totals = np.concatenate([np.zeros(0, np.int64), *(tokens.unpack(cells[int(i)].as_py(), np.int64) for i in by)])
        points, used = score_words(words, starts, keys, totals, order, alpha)
        total = np.r_[0, np.cumsum(points)]
        sums = total[starts[1:]] - total[starts[:-1]]
        of = {"doc_id": docs.column("doc_id"), "n_words": pa.array(np.diff(starts)), "partial": pa.array(sums)}
        for k in range(1, order + 1):
            c = np.r_[0, np.cumsum(used == k)]
            of[f"n_order{k}"] = pa.array(c[starts[1:]] - c[starts[:-1]])
        return pa.table(of)

    return score


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_order1.., log_score, mean_log_score) of every row; n_orderK: words scored by a K-gram."""
    n_chunks = common.parts(docs, chunk_bytes)
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_chunks)).alias("chunk"), F.col(id_col).alias("doc_id"), F.coalesce(common.normalized(F.col(text_col)), F.lit("")).alias("text"))
    laid = common.laid_out(rows, common.partitions(docs))
    asked = laid.groupBy("chunk").applyInArrow(_ask(n_chunks, order), "bucket long, chunk long, grams binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, totals binary")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("partial", T.DoubleType()), *(T.StructField(f"n_order{k}", T.LongType()) for k in range(1, order + 1))])
    scored, _ = common.materialize(laid.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_score(order, alpha), schema), "backoff")
    whole = scored.agg(F.sum("n_words").alias("all_words"))
    others = F.greatest(F.col("all_words") - F.col("n_words"), F.lit(1))
    log_score = F.col("partial") - F.col("n_order1") * F.log(others)
    out = scored.crossJoin(whole).select("doc_id", "n_words", *[f"n_order{k}" for k in range(1, order + 1)], log_score.alias("exact"))
    return out.withColumns({"log_score": F.round("exact", 4), "mean_log_score": F.round(F.when(F.col("n_words") > 0, F.col("exact") / F.col("n_words")), 6)}).drop("exact")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(common.table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({common.NORMALIZED_SQL.format("text")}, '') AS t FROM documents),
w AS (SELECT r, w, i, lag(w, 1) OVER o AS v, lag(w, 2) OVER o AS u FROM (
  SELECT r, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM d WHERE t <> '') x WINDOW o AS (PARTITION BY r ORDER BY i)),
t1 AS (SELECT r, w, count(*) AS tf FROM w GROUP BY ALL), c1 AS (SELECT w, sum(tf) AS c FROM t1 GROUP BY ALL),
t2 AS (SELECT r, v, w, count(*) AS tf FROM w WHERE v IS NOT NULL GROUP BY ALL), c2 AS (SELECT v, w, sum(tf) AS c FROM t2 GROUP BY ALL),
t3 AS (SELECT r, u, v, w, count(*) AS tf FROM w WHERE u IS NOT NULL GROUP BY ALL), c3 AS (SELECT u, v, w, sum(tf) AS c FROM t3 GROUP BY ALL),
o1 AS (SELECT r, w, c - tf AS c FROM t1 JOIN c1 USING (w)), o2 AS (SELECT r, v, w, c - tf AS c FROM t2 JOIN c2 USING (v, w)),
o3 AS (SELECT r, u, v, w, c - tf AS c FROM t3 JOIN c3 USING (u, v, w)),
j AS (SELECT w.r, w.i, a.c AS c1, b.c AS c2, e.c AS c3, p.c AS p1, q.c AS p2 FROM w
  JOIN o1 a ON a.r = w.r AND a.w = w.w LEFT JOIN o1 p ON p.r = w.r AND p.w = w.v
  LEFT JOIN o2 b ON b.r = w.r AND b.v = w.v AND b.w = w.w LEFT JOIN o2 q ON q.r = w.r AND q.v = w.u AND q.w = w.v
  LEFT JOIN o3 e ON e.r = w.r AND e.u = w.u AND e.v = w.v AND e.w = w.w),
n AS (SELECT r, count(*) AS n_words FROM w GROUP BY r), tot AS (SELECT sum(n_words) AS total FROM n),
s AS (SELECT j.r, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 ELSE 1 END AS k,
  CASE WHEN c3 > 0 THEN ln(c3) - ln(p2) WHEN c2 > 0 THEN ln(c2) - ln(p1) ELSE ln(greatest(c1, 1)) - ln(greatest(total - n_words, 1)) END
  + ln({ALPHA}) * (least(i, 3) - CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 ELSE 1 END) AS x FROM j JOIN n USING (r), tot),
a AS (SELECT r, count(*) AS n_words, count(*) FILTER (k = 1) AS n_order1, count(*) FILTER (k = 2) AS n_order2, count(*) FILTER (k = 3) AS n_order3, sum(x) AS x FROM s GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_order1, 0) AS n_order1, coalesce(n_order2, 0) AS n_order2, coalesce(n_order3, 0) AS n_order3,
  round(coalesce(x, 0), 4) AS log_score, round(x / n_words, 6) AS mean_log_score FROM d LEFT JOIN a USING (r)
"""
