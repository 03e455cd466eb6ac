"""Benchmark decontamination by a prefix-filtered set join.

An item is the set of its word n-grams (N = 3; an item of fewer words has one n-gram of all its words). They are
ordered by rarity in the corpus, and a text window can only hold THRESHOLD of them if it holds one of the
|S| - ceil(THRESHOLD * |S|) + 1 rarest, the prefix. Prefix n-grams are joined to those of the documents; texts
with fewer n-grams than needed are out (length bound), and a match at position q only allows windows of the
item's size that begin within the item's size before q (positional bound). These windows are verified exactly.

The item side goes to every worker only while it has at most ``local_grams`` n-grams of LOCAL_CHARS characters on average;
beyond that the same join is a shuffle by n-gram, with equal results.

Defined cases: null and empty texts and items match nothing; a text shorter than an item is one window; repeated
rows match each; repeated items with one id count as one; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import common, tokens

N = 3
THRESHOLD = 0.8
#: n-grams of the item side that every task may hold, and characters of each on average: about 100 MB a worker.
LOCAL_GRAMS, LOCAL_CHARS = 200_000, 64


def item_grams(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, size, grams): grams are distinct n-gram strings in order of first position."""
    t = benchmark.filter(F.col(item_col).isNotNull()).groupBy(F.col(item_col).alias("item"), common.normalized(F.col(text_col)).alias("t")).agg(F.lit(1)).filter("t <> ''")
    w = t.select("item", F.split("t", " ").alias("w")).withColumn("n", F.least(F.size("w"), F.lit(N)))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    return w.select("item", "n", F.size("w").alias("size"), F.array_distinct(grams).alias("grams"))


class Items:
    """The item side in a task: all n-grams by hash, in sorted arrays behind a bitmap."""

    def __init__(self, rows: list[tuple], threshold: float, df: dict[str, int] | None = None):
        self.size = [r[2] for r in rows]
        self.ids = [r[0] for r in rows]
        self.n = [r[1] for r in rows]
        self.total = [len(r[3]) for r in rows]
        self.need = [max(1, -(-int(round(threshold * 1e6)) * t // 1_000_000)) for t in self.total]
        self.by_n: dict[int, tuple] = {}
        every: dict[tuple[int, str], list] = defaultdict(list)
        for i, (_, n, _, grams) in enumerate(rows):
            for g in grams:
                every[n, g].append(i)
        rank = sorted({g for _, g in every}, key=lambda g: ((df or {}).get(g, 0), g))
        order = {g: k for k, g in enumerate(rank)}
        prefix: dict[tuple[int, str], set] = defaultdict(set)
        for i, (_, n, _, grams) in enumerate(rows):
            for g in sorted(grams, key=order.get)[: self.total[i] - self.need[i] + 1]:
                prefix[n, g].add(i)
        for n in {n for n, _ in every}:
            own = sorted((g for m, g in every if m == n))
            h, s = tokens.word_hashes(pa.array(own))
            key, _ = tokens.ngrams(h, s, n)
            o = np.argsort(key)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(key >> np.uint64(44)).astype(np.int64)] = True
            self.by_n[n] = (key[o], [own[k] for k in o], [every[n, own[k]] for k in o], [prefix[n, own[k]] for k in o], bitmap)

    def occurrences(self, words, starts):
        """For every n: (index of the n-gram, position, text) of all occurrences of item n-grams."""
        doc = tokens.doc_of(starts)
        for n, (key, *_rest, bitmap) in self.by_n.items():
            g, pos = tokens.ngrams(words, starts, n)
            may = np.flatnonzero(bitmap[(g >> np.uint64(44)).astype(np.int64)])
            g, pos = g[may], pos[may]
            k = np.minimum(np.searchsorted(key, g), len(key) - 1)
            hit = key[k] == g
            yield n, k[hit], pos[hit], doc[pos[hit]]


def best_window(hits: list[tuple[int, int]], size: int, n: int, length: int, near: list[int]) -> tuple[int, int]:
    """(most distinct n-grams in a window, its first word); hits: (position, n-gram) in order; near: positions of prefix n-grams in order.

    Windows begin at hits; both of a window's ends and the next prefix n-gram only move on, so time is linear.
    """
    best, at, last, span = 0, 0, max(0, length - size), size - n
    inside: dict[int, int] = defaultdict(int)
    low = high = q = 0
    previous = -1
    for h, _ in hits:
        p = min(h, last)
        if p == previous:
            continue
        previous = p
        while high < len(hits) and hits[high][0] <= p + span:
            inside[hits[high][1]] += 1
            high += 1
        while low < high and hits[low][0] < p:
            inside[hits[low][1]] -= 1
            if not inside[hits[low][1]]:
                del inside[hits[low][1]]
            low += 1
        while q < len(near) and near[q] < p:
            q += 1
        if len(inside) > best and q < len(near) and near[q] <= p + span:
            best, at = len(inside), p
    return best, at


def verify(items: Items, words, starts) -> list[tuple[int, int, int, int]]:
    """(text, item, n-grams, first word) of all items that a text holds, the prefix join first."""
    out, length = [], np.diff(starts)
    for n, k, pos, doc in items.occurrences(words, starts):
        _, _, every, prefix, _ = items.by_n[n]
        if not len(k):
            continue
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(doc)]):
            d = int(doc[a])
            near: dict[int, list[int]] = defaultdict(list)
            for j in range(a, b):
                for i in prefix[k[j]]:
                    near[i].append(int(pos[j] - starts[d]))
            if not near:
                continue
            hits: dict[int, list] = defaultdict(list)
            for j in range(a, b):
                for i in every[k[j]]:
                    if i in near:
                        hits[i].append((int(pos[j] - starts[d]), int(k[j])))
            for i, h in hits.items():
                if length[d] - n + 1 < items.need[i] or len({g for _, g in h}) < items.need[i]:
                    continue
                got, at = best_window(h, items.size[i], n, int(length[d]), near[i])
                if got >= items.need[i]:
                    out.append((d, i, got, at))
    return out


_built: dict[tuple, Items] = {}


def _items(shared, threshold: float) -> Items:
    """The item side of a broadcast (rows, document counts), built once a worker."""
    key = (shared.value[0], threshold)
    if key not in _built:
        _built.clear()
        _built[key] = Items(shared.value[1], threshold, shared.value[2])
    return _built[key]


def _count(shared):
    def count(batches):
        items = _items(shared, 1.0)
        total: dict[str, int] = defaultdict(int)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                words, starts = tokens.word_hashes(b.column(b.num_columns - 1).slice(at, 2000))
                for n, k, _, doc in items.occurrences(words, starts):
                    own = items.by_n[n][1]
                    pair = np.unique(k.astype(np.int64) << 32 | doc)
                    for g, c in zip(*np.unique(pair >> 32, return_counts=True)):
                        total[own[g]] += int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "df"])

    return count


def _match(shared, threshold: float, item_type: pa.DataType):
    def match(batches):
        items = _items(shared, threshold)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                words, starts = tokens.word_hashes(part.column(part.num_columns - 1))
                found = verify(items, words, starts)
                keep = pa.array([f[0] for f in found], pa.int64())
                more = [pa.array([items.ids[f[1]] for f in found], item_type), pa.array([f[2] for f in found], pa.int64()), pa.array([items.total[f[1]] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(keep) for i in range(part.num_columns - 1)), *more], names=[*part.schema.names[:-1], "item_id", "n_shared", "n_grams", "first_word"])

    return match


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, local_grams: int = LOCAL_GRAMS) -> DataFrame:
    """(__id, __th, item_id, n_shared, n_grams, first_word): for every row and item, the first of the best windows if it reaches threshold."""
    grams = item_grams(benchmark, item_col, item_text)
    rows = docs.filter(F.col(text_col).isNotNull()).select(*common.row_key(id_col, text_col), common.normalized(F.col(text_col)).alias("__text")).filter("__text <> ''")
    item = T.StructField("item_id", benchmark.schema[item_col].dataType)
    schema = T.StructType([rows.schema["__id"], rows.schema["__th"], item, *(T.StructField(x, T.LongType()) for x in ("n_shared", "n_grams", "first_word"))])
    size, letters = grams.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0)), F.coalesce(F.sum(F.length(F.array_join("grams", ""))), F.lit(0))).first()
    if size <= local_grams and letters <= local_grams * LOCAL_CHARS:
        from pyspark.sql.pandas.types import to_arrow_type

        small, send = [(r["item"], r["n"], r["size"], list(r["grams"])) for r in grams.collect()], docs.sparkSession.sparkContext.broadcast
        shared = send((uuid.uuid4().hex, small, None))
        df = {r["gram"]: r["df"] for r in rows.mapInArrow(_count(shared), "gram string, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()}
        return rows.mapInArrow(_match(send((uuid.uuid4().hex, small, df)), threshold, to_arrow_type(item.dataType)), schema)
    return _contaminated_by_shuffle(rows, grams, threshold).select(schema.names)


def _best_windows(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            best = []
            for cell in part.column(part.num_columns - 1):
                x = cell.as_py()
                code: dict[str, int] = {}
                best.append(best_window([(h["pos"], code.setdefault(h["gram"], len(code))) for h in x["hits"]], x["size"], x["n"], x["length"], x["near"]))
            more = [pa.array([x[i] for x in best], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*part.schema.names[:-1], "k", "at"])


def _contaminated_by_shuffle(rows: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """contaminated() for an item side of any size, all by joins on n-grams."""
    w = rows.select("__id", "__th", F.split("__text", " ").alias("w")).withColumn("length", F.size("w"))
    kind = "array<struct<n:int,pos:bigint,gram:string>>"
    gram = lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(F.lit(n).alias("n"), i.cast("long").alias("pos"), F.array_join(F.slice("w", i + 1, n), " ").alias("gram")))
    used = [r["n"] for r in grams.select("n").distinct().collect()]  # of 1 to N
    every = F.concat(F.array().cast(kind), *[F.when(F.size("w") >= n, gram(n)).otherwise(F.array().cast(kind)) for n in sorted(used)])
    occ = w.select("__id", "__th", "length", F.explode(every).alias("o")).select("__id", "__th", "length", "o.*")
    numbered, _ = common.materialize(grams.withColumn("iid", F.monotonically_increasing_id()), "items")
    parts = numbered.select("iid", "item", "n", "size", F.size("grams").alias("total"), F.explode("grams").alias("gram"))
    df = occ.join(parts.select("n", "gram").distinct(), ["n", "gram"]).select("n", "gram", "__id", "__th").distinct().groupBy("n", "gram").agg(F.count(F.lit(1)).alias("df"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(int(round(threshold * 1e6))) * F.col("total") / 1_000_000))
    ranked = parts.join(df, ["n", "gram"], "left").withColumn("need", need).withColumn("rank", F.row_number().over(Window.partitionBy("iid").orderBy(F.coalesce("df", F.lit(0)), "gram")))
    prefix = ranked.filter(F.col("rank") <= F.col("total") - F.col("need") + 1)
    near = occ.join(prefix.select("iid", "n", "gram"), ["n", "gram"]).groupBy("iid", "__id", "__th").agg(F.collect_set("pos").alias("near"))
    meta = ranked.select("iid", "n", "gram", "item", "size", "total", "need")
    hits = occ.join(meta, ["n", "gram"]).filter(F.col("length") - F.col("n") + 1 >= F.col("need"))
    hits = hits.join(near.withColumnsRenamed({"__id": "n_id", "__th": "n_th", "iid": "n_iid"}), (F.col("iid") == F.col("n_iid")) & F.col("__id").eqNullSafe(F.col("n_id")) & (F.col("__th") == F.col("n_th")))
    got = hits.groupBy("iid", "__id", "__th").agg(*[F.first(c).alias(c) for c in ("item", "n", "size", "total", "need", "length", "near")], F.collect_set(F.struct("pos", "gram")).alias("hits"))
    got = got.select("iid", "__id", "__th", "item", F.col("total").cast("long").alias("total"), F.col("need").cast("long").alias("need"), F.struct("n", "size", "length", F.array_sort("near").alias("near"), F.array_sort("hits").alias("hits")).alias("found"))
    schema = T.StructType([*got.schema.fields[:-1], T.StructField("k", T.LongType()), T.StructField("at", T.LongType())])
    best = got.mapInArrow(_best_windows, schema).filter(F.col("k") >= F.col("need"))
    # identical rows were one so far
    copies = rows.groupBy("__id", "__th").agg(F.count(F.lit(1)).alias("copies")).withColumnsRenamed({"__id": "c_id", "__th": "c_th"})
    best = best.join(copies, F.col("__id").eqNullSafe(F.col("c_id")) & (F.col("__th") == F.col("c_th")))
    return best.select("__id", "__th", F.col("item").alias("item_id"), F.col("k").alias("n_shared"), F.col("total").alias("n_grams"), F.col("at").alias("first_word"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")).drop("i")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no benchmark item; columns untouched."""
    hit = contaminated(docs, benchmark, id_col, text_col, **how).select("__id", "__th").distinct().withColumn("__keep", F.lit(False))
    hit, _ = common.materialize(hit, "contaminated")
    return common.apply_decisions(docs, hit, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("__id").alias("doc_id"), "item_id", "n_shared", "n_grams", "first_word")


def _sql() -> str:
    norm = common.NORMALIZED_SQL
    return f"""
WITH item AS (SELECT item_id, string_split(t, ' ') AS w FROM (SELECT DISTINCT item_id, {norm.format("text")} AS t FROM benchmark) WHERE t <> '' AND item_id IS NOT NULL),
sized AS (SELECT row_number() OVER () AS iid, item_id, w, len(w) AS size, least(len(w), {N}) AS n FROM item),
igram AS (SELECT DISTINCT iid, unnest([array_to_string(w[i : i + n - 1], ' ') FOR i IN range(1, size - n + 2)]) AS gram FROM sized),
total AS (SELECT iid, count(*) AS n_grams FROM igram GROUP BY iid),
doc AS (SELECT doc_id, string_split(t, ' ') AS w FROM (SELECT doc_id, {norm.format("text")} AS t FROM documents) WHERE t <> ''),
dgram AS (SELECT doc_id, len(w) AS length, unnest(range(0, len(w) - {N} + 1)) AS pos, unnest([array_to_string(w[i : i + {N - 1}], ' ') FOR i IN range(1, len(w) - {N} + 2)]) AS gram FROM doc WHERE len(w) >= {N}),
hit AS (SELECT doc_id, iid, pos, gram, length, size, n FROM dgram JOIN igram USING (gram) JOIN sized USING (iid) WHERE n = {N}),
start AS (SELECT DISTINCT doc_id, iid, least(pos, greatest(0, length - size)) AS p, size, n FROM hit),
rated AS (SELECT s.doc_id, s.iid, s.p, count(DISTINCT gram) AS k FROM start s JOIN hit h ON h.doc_id = s.doc_id AND h.iid = s.iid AND h.pos BETWEEN s.p AND s.p + s.size - s.n GROUP BY ALL),
best AS (SELECT doc_id, iid, max(k) AS n_shared, arg_min(p, (-k, p)) AS first_word FROM rated GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_grams, first_word FROM best JOIN total USING (iid) JOIN sized USING (iid)
WHERE n_shared * 1000000 >= {int(round(THRESHOLD * 1e6))} * n_grams
"""


SQL = _sql()
