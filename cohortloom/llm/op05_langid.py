"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier a bit, logistic regression on hashed byte n-grams of 1 to 3
bytes, predicts the bits. Decoding chooses the codeword of the least loss, each bit's logistic loss weighted by
how well that bit's classifier did on rows held out of its fit. A text is ambiguous if the second codeword is
nearer than MARGIN of the total weight, or if the best one's loss is above REJECT.

The classifiers are fitted on at most ``per_class`` different labelled rows of each language, those of the least hash
of the id, then of the text; all rows are classified, whole texts.

Defined cases: null texts and texts without a letter have no language (null) and are ambiguous; equal losses go to the
first language by name, ambiguous; repeated rows are classified each, and count once in the fit; an empty table gives no
rows; other columns are never looked at. Without any labelled row that has a letter no language is known: all rows have
null and are ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import common, tokens

DIM = 4096
PER_CLASS = 600
MARGIN = 0.05
REJECT = 0.9
LETTER = r"\p{L}"
_LOWER = np.full(256, 32, np.uint8)
_LOWER[128:] = np.arange(128, 256)
for _c in range(97, 123):
    _LOWER[_c] = _LOWER[_c - 32] = _c


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each of n classes: all non-trivial splits up to 7 classes, else 15 log2 n random bits at good distance."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        split = np.arange(1, 2 ** (n - 1))
        rows = [np.ones(len(split), int), *(1 - 2 * ((split >> k) & 1) for k in range(n - 1))]
        return np.array(rows, np.int8)
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, int(15 * np.log2(n))))
        d = ((m[:, None] != m[None]).sum(-1) + np.eye(n, dtype=int) * m.shape[1]).min()
        if d > apart and (np.abs(m.sum(0)) < n).all():
            best, apart = m, d
    return best


def features(arr) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams; a row for every text."""
    off, data = tokens.buffers(arr)
    n = len(off) - 1
    b = _LOWER[data]
    out = np.zeros((n, DIM), np.float32)
    if not len(b):
        return out
    doc = np.repeat(np.arange(n), np.diff(off))
    x = b.astype(np.uint32)
    two = x[:-1] | x[1:] << np.uint32(8)
    three = two[:-1] | x[2:] << np.uint32(16)
    count = np.bincount(doc * DIM + (x * np.uint32(0x9E3779B1) >> np.uint32(20)), minlength=n * DIM).astype(np.float32)
    for g, w in ((two, 2), (three, 3)):
        inside = doc[w - 1 :] == doc[: len(g)]
        inside &= (x[: len(g)] != 32) | (x[w - 1 :] != 32)
        h = (g ^ np.uint32(w << 28)) * np.uint32(0x85EBCA6B)
        h = ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(20)
        count += np.bincount((doc[: len(g)] * DIM + h)[inside], minlength=n * DIM)
    out = count.reshape(n, DIM)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32)


@dataclass
class Model:
    """Languages, their codewords, the bits' linear classifiers and weights."""

    languages: list[str]
    code: np.ndarray
    w: np.ndarray = field(repr=False)
    b: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of every codeword for every row of features."""
        f = x @ self.w + self.b
        return np.stack([(np.logaddexp(0, -f * c) * self.weight).sum(1) for c in self.code], 1) / self.weight.sum()


def fit(x: np.ndarray, y: list[str], rounds: int = 300) -> Model:
    """Logistic regression of every bit; a fifth of the rows is held out to weight the bits, then all are used."""
    languages = sorted(set(y))
    code = codewords(len(languages))
    t = code[np.array([languages.index(v) for v in y])].astype(np.float32)
    held = np.arange(len(x)) % 5 == 4

    def solve(x, t):
        w, b = np.zeros((x.shape[1], t.shape[1]), np.float32), np.zeros(t.shape[1], np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):  # accelerated gradient; rows have length 1, so 1/4 bounds the curvature
            g = -t / (1 + np.exp(t * (x @ (w + 0.9 * vw) + b + 0.9 * vb))) / len(x)
            vw = 0.9 * vw - 3.0 * (x.T @ g + 1e-5 * w)
            vb = 0.9 * vb - 1.0 * g.sum(0)
            w, b = w + vw, b + vb
        return w, b

    weight = np.ones(code.shape[1])
    if held.any() and not held.all():
        w, b = solve(x[~held], t[~held])
        right = ((x[held] @ w + b) * t[held] > 0).mean(0)
        weight = np.maximum(right - 0.5, 0.01)
    return Model(languages, code, *solve(x, t), weight)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_class: int = PER_CLASS) -> Model:
    """A model of the languages in label_col, from at most per_class rows of each."""
    text, label = F.col(f"`{text_col}`"), F.col(f"`{label_col}`").cast("string")
    rows = docs.filter(label.isNotNull() & text.rlike(LETTER)).select(label.alias("label"), text.alias("text"), F.struct(F.xxhash64(F.col(f"`{id_col}`"), F.lit(5)).alias("h"), F.xxhash64(text).alias("th")).alias("key"))
    w = Window.partitionBy("label").orderBy("key")
    limits = rows.select("label", "key").distinct().withColumn("i", F.row_number().over(w)).filter(F.col("i") <= per_class).groupBy("label").agg(F.max("key").alias("most")).collect()
    chosen = F.lit(False)
    for r in limits:
        chosen = chosen | ((F.col("label") == r["label"]) & (F.col("key") <= F.struct(F.lit(r["most"]["h"]).alias("h"), F.lit(r["most"]["th"]).alias("th"))))

    def featurise(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                x = (features(part.column(1)) * 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([tokens.pack(v) for v in x], pa.binary())], names=["label", "h", "th", "x"])

    some = rows.filter(chosen).select("label", "text", "key.h", "key.th").mapInArrow(featurise, "label string, h long, th long, x binary")
    got = some.groupBy("label", "h", "th").agg(F.first("x").alias("x")).collect()  # equal keys once: at most per_class of a label
    if not got:
        return Model([], np.ones((0, 1), np.int8), np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    got.sort(key=lambda r: (r["h"], r["th"], r["label"]))
    x = np.stack([tokens.unpack(bytes(r["x"]), np.uint16) for r in got]).astype(np.float32) / 65535
    return fit(x, [r["label"] for r in got])


def _classify(model: Model, margin: float, reject: float):
    def classify(batches):
        for b in batches:
            off, _ = tokens.buffers(b.column(1))
            letter = b.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            at = 0
            while at < b.num_rows:
                to = min(b.num_rows, at + 128, max(at + 1, int(np.searchsorted(off, off[at] + (1 << 19), "right")) - 1))
                x = features(b.column(1).slice(at, to - at))
                none = ~letter[at:to] if model.languages else np.ones(len(x), bool)
                loss = model.losses(x) if model.languages else np.zeros((len(x), 1))
                best = loss.argmin(1)
                ordered = np.sort(loss, 1)
                gap = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.ones(len(x))
                lang = pa.array([None if no else model.languages[k] for k, no in zip(best, none)], pa.string())
                value = lambda v, none=none: pa.array(np.where(none, np.nan, v), from_pandas=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), lang, value(ordered[:, 0]), value(gap), pa.array(none | (gap < margin) | (ordered[:, 0] > reject))], names=["doc_id", "language", "loss", "margin", "ambiguous"])
                at = to

    return classify


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, reject: float = REJECT) -> DataFrame:
    """(doc_id, language, loss, margin, ambiguous) of every row; narrow, no shuffle."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{text_col}`").rlike(LETTER).alias("letter"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("language", T.StringType()), T.StructField("loss", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return rows.mapInArrow(_classify(model, margin, reject), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
