"""Exact substring duplicates by fixed-block anchors.

Every text's words are cut into non-overlapping blocks of BLOCK words, which are indexed by hash; the hashes of all
rolling windows of BLOCK words probe that index. A repeat of 2 * BLOCK - 1 words or more holds a whole block of each
of its places, so none is missed. Where a block occurs at two places or more, its hits are extended to all windows
of MIN_WORDS words around them; equal windows are paired with their first place in the corpus, and runs of such
pairs that go on word by word are the maximal exact repeats of that place.

Probes and index meet by hash range: a chunk of documents sends its window hashes packed and sorted, with a mark
for blocks, and gets one bit for each. Then it sends each different window around the hits once, with its first place in
the chunk, and gets the first place in the corpus of those that occur twice. So a passage costs an entry a chunk, however
many places it has, and no pairs of places are listed.

Each place has only the first place as its partner. A repeat is thus cut where the first place of its windows changes:
a passage of B and C of which a part of MIN_WORDS words or more stands earlier in A is reported in pieces, those of B and
of A. All words are covered, and pairs of later places follow from their common first one.

Defined cases: null texts and texts of fewer than MIN_WORDS words have no rows; a null id comes before all; the
first place (least id, then position) of a passage has no row, all others do, also those within the same
document and those in repeated rows; an empty table gives no rows; other columns are never looked at. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

BLOCK = 25
MIN_WORDS = 50
CHUNK_BYTES = 4 << 20
_NULL_ID = -(2**63)


def _windows(t: pa.Table, block: int):
    words, starts = tokens.word_hashes(t.column("text"))
    g, pos = tokens.ngrams(words, starts, block)
    return words, starts, g, pos


def _distinct_at(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _ask(n_buckets: int, block: int):
    bounds = tokens.bucket_bounds(n_buckets)

    def ask(t: pa.Table) -> pa.Table:
        _, starts, g, pos = _windows(t, block)
        anchors = np.sort(g[(pos - starts[:-1][tokens.doc_of(starts)[pos]]) % block == 0]) if len(g) else g
        g = np.sort(g)
        at = _distinct_at(g)
        keys, count = g[at], np.diff(np.r_[at, len(g)])
        info = (count > 1).astype(np.uint8) << 1
        info[np.searchsorted(keys, anchors)] |= 1
        cut = np.r_[np.searchsorted(keys, bounds), len(keys)]
        used = np.flatnonzero(np.diff(cut))
        return pa.table({
            "bucket": pa.array(used, pa.int64()), "chunk": pa.array(np.full(len(used), t.column("chunk")[0].as_py()), pa.int64()),
            "windows": pa.array([tokens.pack_sorted(keys[cut[b] : cut[b + 1]]) for b in used], pa.binary()),
            "info": pa.array([tokens.pack(info[cut[b] : cut[b + 1]]) for b in used], pa.binary())})

    return ask


def _answer(t: pa.Table) -> pa.Table:
    keys = [tokens.unpack_sorted(c.as_py()) for c in t.column("windows")]
    ends = np.cumsum([len(k) for k in keys])
    info = np.concatenate([tokens.unpack(c.as_py(), np.uint8) for c in t.column("info")])
    key = np.concatenate(keys)
    del keys
    o = np.argsort(key)
    key, info = key[o], info[o]
    at = _distinct_at(key)
    size = np.diff(np.r_[at, len(key)])
    all_info = np.bitwise_or.reduceat(info, at)
    hit = np.empty(len(key), bool)
    hit[o] = np.repeat((all_info & 1 > 0) & ((size > 1) | (all_info & 2 > 0)), size)
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "hits": pa.array([tokens.pack(np.packbits(x)) for x in np.split(hit, ends[:-1])], pa.binary())})


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value of x is in the sorted array among."""
    out = np.zeros(len(x), bool)
    if len(among):
        bitmap = np.zeros(1 << 22, bool)
        bitmap[(among >> np.uint64(42)).astype(np.int64)] = True
        may = np.flatnonzero(bitmap[(x >> np.uint64(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(among, x[may]), len(among) - 1)
        out[may] = among[k] == x[may]
    return out


def _extend(n_buckets: int, block: int, min_words: int):
    bounds = tokens.bucket_bounds(n_buckets)

    def extend(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, starts, g, pos = _windows(docs, block)
        keys = np.sort(g)
        keys = keys[_distinct_at(keys)]
        cut = np.r_[np.searchsorted(keys, bounds), len(keys)]
        hit = np.zeros(len(keys), bool)
        for b, cell in zip(answers.column("bucket").to_pylist(), answers.column("hits")):
            n = cut[b + 1] - cut[b]
            hit[cut[b] : cut[b + 1]] = np.unpackbits(tokens.unpack(cell.as_py(), np.uint8), count=n).astype(bool)
        at = pos[_member(g, keys[hit])]
        # a window of min_words words from any of these places on holds the hit
        near = np.zeros(len(words) + 1, np.int64)
        np.add.at(near, np.maximum(at - (min_words - block), 0), 1)
        np.add.at(near, at + 1, -1)
        near = np.cumsum(near[:-1]) > 0
        g, pos = tokens.ngrams(words, starts, min_words)
        pick = near[pos]
        g, pos = g[pick], pos[pick]
        ids, place = _places(docs, starts, pos)
        o = np.lexsort((place, ids, g))
        g, ids, place = g[o], ids[o], place[o]
        at = _distinct_at(g)
        many = np.diff(np.r_[at, len(g)]) > 1
        g, ids, place = g[at], ids[at], place[at].astype(np.uint32)
        cut = np.r_[np.searchsorted(g, bounds), len(g)]
        used = np.flatnonzero(np.diff(cut))
        part = lambda x, f: pa.array([f(x[cut[b] : cut[b + 1]]) for b in used], pa.binary())
        return pa.table({
            "bucket": pa.array(used, pa.int64()), "chunk": pa.array(np.full(len(used), docs.column("chunk")[0].as_py() if docs.num_rows else 0), pa.int64()),
            "windows": part(g, tokens.pack_sorted), "many": part(many, _bits), "ids": part(ids, tokens.pack), "places": part(place, tokens.pack)})

    return extend


def _bits(x: np.ndarray) -> bytes:
    return tokens.pack(np.packbits(x))


def _places(docs: pa.Table, starts: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, first word within its text) of windows."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = tokens.doc_of(starts)[pos]
    return docs.column("doc_id").to_numpy()[doc], pos - starts[:-1][doc]


def _pair(t: pa.Table) -> pa.Table:
    """For each chunk its windows that occur twice or more, their first places, and whether that one is the chunk's own."""
    keys = [tokens.unpack_sorted(x.as_py()) for x in t.column("windows")]
    size = [len(k) for k in keys]
    of, key = np.repeat(np.arange(len(keys), dtype=np.int32), size), np.concatenate(keys)
    del keys
    many = np.concatenate([np.unpackbits(tokens.unpack(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(t.column("many"), size)])
    o = np.argsort(key, kind="stable")
    at = _distinct_at(key[o])
    group = np.diff(np.r_[at, len(o)])
    o = o[np.repeat((group > 1) | np.bitwise_or.reduceat(many[o], at), group)]
    key, of = key[o], of[o]
    load = lambda c, kind: np.concatenate([tokens.unpack(x.as_py(), kind) for x in t.column(c)])[o]
    ids, place = load("ids", np.int64), load("places", np.uint32)
    del o
    o = np.lexsort((of, place, ids, key))
    key, of, ids, place = key[o], of[o], ids[o], place[o]
    at = _distinct_at(key)
    first = np.repeat(at, np.diff(np.r_[at, len(key)]))
    own = first == np.arange(len(key))
    back = np.argsort(of, kind="stable")  # by chunk, keys still in order
    cut = np.searchsorted(of[back], np.arange(t.num_rows + 1))
    used = np.flatnonzero(np.diff(cut))
    part = lambda x, f: pa.array([f(x[back[cut[i] : cut[i + 1]]]) for i in used], pa.binary())
    return pa.table({"chunk": t.column("chunk").take(pa.array(used)), "windows": part(key, tokens.pack_sorted), "own": part(own, _bits), "ref_ids": part(ids[first], tokens.pack), "ref_places": part(place[first], tokens.pack)})


RESULT = ("doc_id", "start_word", "n_words", "ref_doc_id", "ref_start_word")


def _runs(min_words: int):
    def runs(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not (docs.num_rows and answers.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in RESULT})
        keys = [tokens.unpack_sorted(x.as_py()) for x in answers.column("windows")]
        own = np.concatenate([np.unpackbits(tokens.unpack(x.as_py(), np.uint8), count=len(k)).astype(bool) for x, k in zip(answers.column("own"), keys)])
        load = lambda c, kind: np.concatenate([tokens.unpack(x.as_py(), kind) for x in answers.column(c)])
        key, ref_ids, ref_places = np.concatenate(keys), load("ref_ids", np.int64), load("ref_places", np.uint32).astype(np.int64)
        o = np.argsort(key)
        key, own, ref_ids, ref_places = key[o], own[o], ref_ids[o], ref_places[o]
        _, starts, g, pos = _windows(docs, min_words)
        pick = _member(g, key)
        g, pos = g[pick], pos[pick]
        ids, place = _places(docs, starts, pos)
        k = np.searchsorted(key, g)
        # the corpus's first place of each window has no row: it is one of this chunk's, if the chunk owns it
        first = np.flatnonzero(own[k] & (ids == ref_ids[k]) & (place == ref_places[k]))
        keep = np.ones(len(k), bool)
        keep[first[np.unique(k[first], return_index=True)[1]]] = False
        k, ids, place = k[keep], ids[keep], place[keep]
        ref, shift = ref_ids[k], ref_places[k] - place
        o = np.lexsort((place, shift, ref, ids))
        ids, place, ref, shift = ids[o], place[o], ref[o], shift[o]
        # the windows of repeated rows are equal in all; a run's k-th copy goes with the others' k-th
        same = np.r_[False, (ids[1:] == ids[:-1]) & (ref[1:] == ref[:-1]) & (shift[1:] == shift[:-1]) & (place[1:] == place[:-1])]
        if same.any():
            at = np.flatnonzero(~same)
            copy = np.arange(len(ids)) - np.repeat(at, np.diff(np.r_[at, len(ids)]))
            o = np.lexsort((place, copy, shift, ref, ids))
            ids, place, ref, shift = ids[o], place[o], ref[o], shift[o]
        go = np.r_[False, (ids[1:] == ids[:-1]) & (ref[1:] == ref[:-1]) & (shift[1:] == shift[:-1]) & (place[1:] == place[:-1] + 1)][: len(ids)]
        at = np.flatnonzero(~go)
        size = np.diff(np.r_[at, len(ids)])
        return pa.table(dict(zip(RESULT, (ids[at], place[at], size + min_words - 1, ref[at], place[at] + shift[at]))))

    return runs


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, min_words: int = MIN_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, start_word, n_words, ref_doc_id, ref_start_word): maximal runs of words equal to those at their first place."""
    if min_words < 2 * block - 1:
        raise ValueError("a repeat must hold a whole block: min_words >= 2 * block - 1")
    n_chunks = common.parts(docs, chunk_bytes)
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_chunks)).alias("chunk"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), common.normalized(F.col(text_col)).alias("text")).filter("text <> ''")
    laid = rows.repartition(common.partitions(docs), "chunk")
    asked = laid.groupBy("chunk").applyInArrow(_ask(n_chunks, block), "bucket long, chunk long, windows binary, info binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, hits binary")
    wide = laid.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_extend(n_chunks, block, min_words), "bucket long, chunk long, windows binary, many binary, ids binary, places binary")
    paired = wide.groupBy("bucket").applyInArrow(_pair, "chunk long, windows binary, own binary, ref_ids binary, ref_places binary")
    out = laid.groupBy("chunk").cogroup(paired.groupBy("chunk")).applyInArrow(_runs(min_words), ", ".join(f"{c} long" for c in RESULT))
    kind = docs.schema[id_col].dataType
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).cast(kind).alias(c)
    return out.select(real("doc_id"), "start_word", "n_words", real("ref_doc_id"), "ref_start_word")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(common.table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, string_split({common.NORMALIZED_SQL.format("text")}, ' ') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + {MIN_WORDS}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - {MIN_WORDS} + 1)) AS p FROM d WHERE len(w) >= {MIN_WORDS}) x),
ref AS (SELECT doc_id, p, first_value(doc_id) OVER o AS ref_doc_id, first_value(p) OVER o AS ref_p, row_number() OVER o AS i FROM win WINDOW o AS (PARTITION BY h ORDER BY doc_id, p)),
isle AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, ref_doc_id, ref_p - p ORDER BY p) AS k FROM ref WHERE i > 1)
SELECT doc_id, min(p) AS start_word, count(*) + {MIN_WORDS - 1} AS n_words, ref_doc_id, min(ref_p) AS ref_start_word
FROM isle GROUP BY doc_id, ref_doc_id, ref_p - p, k
"""
