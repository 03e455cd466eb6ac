"""Near-duplicates by min-max hashing.

A text's word SHINGLE-grams are permuted by PERMS multiply-shift functions; of every permutation both the least and
the greatest value are kept, so PERMS evaluations give 2 * PERMS signature values, each equal in two texts with
the Jaccard similarity as its probability. Of each value 16 bits are kept. Texts of equal signature are one entry. Entries whose signatures
give an estimated similarity of THRESHOLD or more are near; groups are the connected components of that relation. The estimate's
standard error at a similarity of 0.5 is 0.044, and THRESHOLD is about one below 0.5.

Bands of ROWS values find what is to be compared, and leave out no pair that is near: THRESHOLD asks for 58 equal ones of 128 values,
so of 57 groups of two or three values at least one has two that are equal, and all 85 choices of two from a group are bands.

Within a band's bucket all pairs count, but pairs that the bucket's earlier pairs have joined already aren't
looked at again: leaders are compared with all others, and only between the components that are left are all
pairs compared. So buckets of thousands of copies cost one comparison a member, and no candidate is dropped.

A bucket of more than ``hot`` entries is never brought together. It is cut into blocks of that size; each block, with a few of the
bucket's entries that all its blocks get, is compared in itself, which mostly leaves one component where the bucket is one of
copies. Where more than one is left, every block meets every other, and all pairs of different components are compared. So a
bucket's links are those of all its pairs, at a cost that grows with the square of such a bucket's size.

Defined cases: null texts and texts without a word are never near anything; texts shorter than a shingle have
all their words as their one shingle; the kept row of a group has the least id (null before all), then the least
text hash; repeated rows are in one group; an empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

SHINGLE = 3
PERMS = 64
ROWS = 2
THRESHOLD = 0.45
#: Entries of a bucket that are compared at once.
HOT = 8192
_rng = np.random.default_rng(9)
_A = _rng.integers(1, 2**31, 512, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, 512, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all shingles, in the order of the texts."""
    size = np.diff(starts)
    h, pos = tokens.ngrams(words, starts, n)
    doc = tokens.doc_of(starts)[pos] if len(pos) else np.zeros(0, np.int32)
    for k in range(1, n):  # the few texts that are shorter than n
        short = np.flatnonzero(size == k)
        if len(short):
            at = starts[short]
            g = np.zeros(len(short), np.uint64)
            for j in range(k):
                g = tokens.mix(g * np.uint64(31) + words[at + j])
            h, doc = np.concatenate([h, g]), np.concatenate([doc, short.astype(np.int32)])
    if (size < n).any():
        o = np.argsort(doc, kind="stable")
        h, doc = h[o], doc[o]
    return h, doc


def signatures(words: np.ndarray, starts: np.ndarray, perms: int = PERMS, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, their signatures as rows of 2 * perms uint32)."""
    h, doc = shingle_hashes(words, starts, n)
    if not len(h):
        return np.zeros(0, np.int32), np.zeros((0, 2 * perms), np.uint32)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.empty((len(first), 2 * perms), np.uint32)
    low, high = (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)
    step = 1 << 16
    bounds = [0]
    while bounds[-1] < len(first):  # texts whole, about step shingles at once, so that they stay in cache
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(first, first[bounds[-1]] + step))))
    for a, b in zip(bounds, bounds[1:]):
        s, e = first[a], first[b] if b < len(first) else len(h)
        at, x, y = first[a:b] - s, low[s:e], high[s:e]
        for p in range(perms):
            v = x * _A[p] + y * _A[p + 256] + _B[p]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[a:b, 2 * p] = np.minimum.reduceat(v, at)
            out[a:b, 2 * p + 1] = np.maximum.reduceat(v, at)
    return doc[first], out


def _sign(perms: int, n: int):
    def sign(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                words, starts = tokens.word_hashes(part.column(2))
                doc, sig = signatures(words, starts, perms, n)
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * perms), len(doc), [None, pa.py_buffer(sig.astype(np.uint16).tobytes())]).cast(pa.binary())
                keep = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), cells], names=["__id", "__th", "sig"])

    return sign


def signed(docs: DataFrame, id_col: str, text_col: str, perms: int = PERMS, n: int = SHINGLE) -> DataFrame:
    """(__id, __th, sig) of all rows whose text has a word."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(*common.row_key(id_col, text_col), common.normalized(F.col(text_col)).alias("__text"))
    schema = T.StructType([rows.schema["__id"], rows.schema["__th"], T.StructField("sig", T.BinaryType())])
    return rows.mapInArrow(_sign(perms, n), schema)


def bands(values: int, rows: int, threshold: float) -> np.ndarray:
    """Bands as rows of places, so that two signatures of so many values and of threshold or more agree in all places of one."""
    need = int(np.argmax(_estimate(np.arange(values + 1), values, 16) >= threshold))
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0, and 1 at most")
    rows = min(rows, need)
    groups = (need - 1) // (rows - 1) if rows > 1 else values  # one has rows equal values, as all with fewer would make less than need
    return np.array([c for g in np.array_split(np.arange(values), groups) for c in combinations(g, rows)])


def _band(perms: int, rows: int, threshold: float):
    places = bands(2 * perms, rows, threshold)

    def band(batches):
        for b in batches:
            _, data = tokens.buffers(b.column(1))
            values = data.view(np.uint16).reshape(-1, 2 * perms)
            key = np.zeros((len(values), len(places)), np.uint64) + np.arange(len(places), dtype=np.uint64)
            for at in places.T:
                key = tokens.mix(key * np.uint64(31) + values[:, at])
            sid = np.repeat(b.column(0).to_numpy(), len(places))
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(key.ravel().view(np.int64))], names=["sid", "key"])

    return band


class _Sets:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return nxt
            self.up = nxt


def _estimate(same: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Estimated Jaccard similarity from so many equal ones of n values, corrected for those that are equal by chance."""
    return (same / n - 0.5**bits) / (1 - 0.5**bits)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signatures."""
    same = a == b
    n = same.shape[-1]
    if n % 8 == 0 and n < 255:  # eight counts side by side in a word; modulo 255 it is the sum of its bytes
        same = np.ascontiguousarray(same).view(np.uint64).sum(axis=-1, dtype=np.uint64) % np.uint64(255)
    else:
        same = same.sum(axis=-1)
    return _estimate(same, n, 8 * a.dtype.itemsize)


def near_edges(sig: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that connect exactly what all pairs of threshold or more connect."""
    n = len(sig)
    sets, edges, left = _Sets(n), [], np.arange(n)
    leaders = 0
    while len(left) > 1 and leaders < 64:  # leaders take most of a bucket of copies; what they leave is compared in full below
        head, rest = left[0], left[1:]
        near = similarity(sig[head], sig[rest]) >= threshold
        for x in rest[near]:
            if sets.join(int(head), int(x)):
                edges.append((int(head), int(x)))
        left, leaders = rest[~near], leaders + 1
    roots = sets.roots()
    if (roots == roots[0]).all():
        return edges
    for i in range(n):  # pairs between components
        other = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1
        for at in range(0, len(other), 8192):
            o = other[at : at + 8192]
            for x in o[similarity(sig[i], sig[o]) >= threshold]:
                if sets.join(i, int(x)):
                    edges.append((i, int(x)))
    return edges


def _verify(threshold: float):
    """Edges (a, b) of a table's buckets."""

    def verify(t: pa.Table) -> pa.Table:
        key, sid = t.column("key").to_numpy(), t.column("sid").to_numpy()
        _, data = tokens.buffers(t.column("bytes"))
        sig = data.view(np.uint16).reshape(len(key), -1)
        o = np.lexsort((sid, key))
        key, sid, sig = key[o], sid[o], sig[o]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[at, len(key)])
        a, b = [], []
        two = at[size == 2]
        for s in range(0, len(two), 65536):
            i = two[s : s + 65536]
            i = i[similarity(sig[i], sig[i + 1]) >= threshold]
            a.append(sid[i])
            b.append(sid[i + 1])
        for i, n in zip(at[size > 2], size[size > 2]):
            e = np.array(near_edges(sig[i : i + n], threshold), np.int64).reshape(-1, 2)
            a.append(sid[i + e[:, 0]])
            b.append(sid[i + e[:, 1]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([*a, none]), "b": np.concatenate([*b, none])})

    return verify


def _cross(threshold: float):
    """Edges (a, b) between two blocks of a bucket, which connect what all pairs of theirs do beyond the components c."""

    def cross(t: pa.Table) -> pa.Table:
        sid, late = t.column("sid").to_numpy(), t.column("late").to_numpy(zero_copy_only=False)
        _, data = tokens.buffers(t.column("bytes"))
        sig = data.view(np.uint16).reshape(len(sid), -1)
        names, c = np.unique(t.column("c").to_numpy(), return_inverse=True)
        sets, edges = _Sets(len(names)), []
        one, two = np.flatnonzero(~late), np.flatnonzero(late)
        roots = sets.roots()
        for i in one:
            other = two[roots[c[two]] != roots[c[i]]]
            near = other[similarity(sig[i], sig[other]) >= threshold]
            new = [x for x in near if sets.join(int(c[i]), int(c[x]))]
            edges += [(sid[i], sid[x]) for x in new]
            if new:
                roots = sets.roots()
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    return cross


def _sized(rows: DataFrame) -> DataFrame:
    """rows with n, the rows of their key; rows alone in theirs are left out. Counts combine before the shuffle, and the join can split a large key."""
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")


def _edges(rated: DataFrame, threshold: float, hot: int, n_buckets: int) -> tuple[DataFrame, list[str]]:
    """(a, b) that connect exactly what is near within the keys of rated (key, sid, bytes, n); and the tables made."""
    bucket = F.pmod(F.col("key"), F.lit(n_buckets)).alias("bucket")
    compare = lambda rows: rows.select("key", "sid", "bytes", bucket).groupBy("bucket").applyInArrow(common.trimming(_verify(threshold)), "a long, b long")
    edges = compare(rated.filter(F.col("n") <= hot))
    large, large_path = common.materialize(rated.filter(F.col("n") > hot), "hot")
    if large.isEmpty():
        return edges, [large_path]
    n_blocks = F.ceil(F.col("n") / hot).cast("long")
    all_blocks, block = F.sequence(F.lit(0).cast("long"), n_blocks - 1), F.pmod(F.xxhash64("sid", "key"), n_blocks)
    everywhere = F.pmod(F.xxhash64("key", "sid"), F.col("n")) < hot // 128
    blocks = large.withColumn("block", F.explode(F.when(everywhere, all_blocks).otherwise(F.array(block))))
    within, within_path = common.materialize(compare(blocks.select(F.xxhash64("key", "block").alias("key"), "sid", "bytes")).distinct(), "hot-blocks")
    groups, groups_path = common.connected_components(within)
    named = large.join(groups.withColumnsRenamed({"node": "sid", "component": "c"}), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    mixed = named.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("key")
    met = named.join(mixed, "key", "left_semi").withColumn("block", block).withColumn("other", F.explode(all_blocks)).filter("other <> block")
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sid", "bytes", "c", (F.col("block") > F.col("other")).alias("late"))
    between = met.groupBy("key", "i", "j").applyInArrow(common.trimming(_cross(threshold)), "a long, b long")
    return edges.unionByName(within).unionByName(between), [large_path, within_path, groups_path]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", perms: int = PERMS, rows: int = ROWS, threshold: float = THRESHOLD, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(__id, __th, n, first_id, first_th) of all rows in groups of two rows or more; n: rows of this key."""
    spark = docs.sparkSession
    signs, signs_path = common.materialize(signed(docs, id_col, text_col, perms, shingle).withColumn("sid", F.xxhash64("sig")), "signatures")
    entries = signs.groupBy("sid").agg(F.first("sig").alias("sig"))
    keyed = entries.mapInArrow(_band(perms, rows, threshold), "sid long, key long")
    members, members_path = common.materialize(_sized(keyed), "bands")
    wanted = members.select("sid").distinct()
    brief = signs.join(wanted, "sid", "left_semi").select("sid", F.col("sig").alias("bytes")).dropDuplicates(["sid"])
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.parts(members, 1 << 20))
    edges, hot_paths = _edges(members.join(brief, "sid").select("key", "sid", "bytes", "n"), threshold, hot, n_buckets)
    edges, edges_path = common.materialize(edges.distinct(), "near-edges")  # components read it twice
    groups, groups_path = common.connected_components(edges)
    placed = signs.select("__id", "__th", "sid").join(groups.withColumnsRenamed({"node": "sid", "component": "g"}), "sid", "left").withColumn("g", F.coalesce("g", "sid"))
    by_key = placed.groupBy("g", "__id", "__th").agg(F.count(F.lit(1)).alias("n"))
    first = by_key.groupBy("g").agg(F.min(F.struct("__id", "__th")).alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    out = by_key.join(first, "g").select("__id", "__th", "n", F.col("first.__id").alias("first_id"), F.col("first.__th").alias("first_th"))
    out, _ = common.materialize(out, "near-groups")
    common.release(spark, signs_path, members_path, edges_path, groups_path, *hot_paths)
    return out


def _is_first():
    return F.col("__id").eqNullSafe(F.col("first_id")) & (F.col("__th") == F.col("first_th"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, near_of): a row for every row of a group but its kept one; near_of is the kept row's id."""
    extra = F.col("n") - F.when(_is_first(), 1).otherwise(0)
    return near_groups(docs, id_col, text_col, **how).filter(extra > 0).select(
        F.col("__id").alias("doc_id"), F.col("first_id").alias("near_of"), F.explode(F.sequence(F.lit(1), extra)).alias("i")).drop("i")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group; columns untouched, rows without a word stay."""
    decided = near_groups(docs, id_col, text_col, **how).select("__id", "__th", _is_first().alias("__keep"))
    return common.apply_decisions(docs, decided, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
