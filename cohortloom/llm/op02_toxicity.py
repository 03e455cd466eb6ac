"""Toxicity by a weighted lexicon.

Texts are folded: lower case; diacritics, homoglyphs, mathematical and circled letters and digit substitutions to plain
letters; i, l and 1 to one sign; combining marks and invisible characters removed; "!" before a letter to i; *, _, ~, ^
within a word removed; everything else than letters and digits one space; runs of single letters joined
("i d i o t"); repeated letters one. (A full stop or hyphen parts words: removing it would join sentences.)

The lexicon has whole words and stems, beginnings of words. Besides a short list of insults (``SEEDS``) it is learned
from labelled documents, in whatever language they are: of at most ``per_class`` documents of each label, words and
stems of ``STEMS`` letters count with their smoothed rate in toxic documents against that in the others; kept are
those of at least ``MIN_RATIO``, in enough toxic documents, and in a greater share of those than of the others. The
weight is twice the logarithm of the ratio, 10 at most. The sample is that of the least MD5 of the id.

An Aho-Corasick automaton finds all terms and exception phrases in one pass; of the terms that begin at one word the
heaviest counts, and none within an exception phrase. The score is the weight divided by the number of words. A text is
toxic from ``THRESHOLD`` on, if it has two terms or a seed.

Defined cases: null and empty texts have no words, no score (null) and aren't toxic; repeated rows are scored
each; an empty table gives no rows; whole texts are read, however long; other columns are untouched. Labels that are
neither 0 nor 1, without an id or without a document aren't used; without any of either label only seeds count.
"""

from __future__ import annotations

import bisect
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Weights are whole numbers, so that sums don't depend on order.
SEEDS = {
    "idiot": 5, "moron": 5, "stupid": 4, "scum": 6, "loser": 4, "pathetic": 4, "worthless": 5, "disgusting": 4, "trash": 3, "clown": 3,
    "imbecile": 5, "dumbass": 6, "bastard": 6, "asshole": 7, "bitch": 7, "vermin": 5, "subhuman": 8, "degenerate": 5, "retard": 7, "halfwit": 4,
    "idiota": 5, "estupido": 4, "imbecil": 5, "asqueroso": 4, "dummkopf": 5, "abschaum": 6, "trottel": 5, "connard": 6, "abruti": 5, "cretin": 5,
}
EXCEPTIONS = ["clown fish", "trash can", "trash bin", "trash bag", "idiot proof", "class clown", "sore loser", "stupid mistake"]
#: A text is toxic from this weight a word on, if it has MIN_TERMS terms or a seed.
THRESHOLD = 0.03
MIN_TERMS = 2
#: Labelled documents of either label that the lexicon is learned from.
PER_CLASS = 3000
STEMS = (4, 5, 6, 7)
MIN_RATIO = 8
#: Occurrences that every term is taken to have in documents that aren't toxic.
SMOOTH = 10
#: Toxic documents that have a term: this many and this share; and so many times the share of the others that have it.
MIN_DOCS, MIN_SHARE, MIN_LIFT = 3, 0.01, 2

_SAME = {
    "a": "αа4@", "b": "в8", "c": "с", "d": "ԁ", "e": "εеэ3", "g": "ɡ", "h": "һ", "i": "ιіıɩl1|", "j": "ј", "k": "κк", "n": "п", "o": "οоø0", "p": "ρр", "q": "ԛ", "r": "г", "s": "ѕ5$",
    "t": "τт7", "u": "υ", "v": "νѵ", "w": "ԝω", "x": "χх", "y": "у", "z": "2", "σ": "ς",
}
_GONE = "​‌‍⁠﻿­" + "".join(map(chr, range(0x300, 0x370)))


def _table() -> dict[str, str]:
    """What each character becomes: of those that decompose to one letter or digit and marks, what that one becomes."""
    same = {c: k for k, v in _SAME.items() for c in v}
    out = dict(same)
    for low, high in ((0xA0, 0x2500), (0x2C60, 0x2C80), (0xA720, 0xA800), (0xFF00, 0xFF5F), (0x1D400, 0x1D800), (0x1F100, 0x1F200)):
        for c in map(chr, range(low, high)):
            base = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x)).strip("()")
            if c not in out and len(base) == 1 and base != c and (base in same or base.isascii() and base.isalnum()):
                out[c] = same.get(base, base)
    return out


_MAP = _table()
FOLD_FROM = "".join(_MAP) + _GONE
FOLD_TO = "".join(_MAP.values())


class _Known(dict):
    """Characters that stay are remembered: a missing one costs an exception."""

    def __missing__(self, c: int) -> int:
        self[c] = c
        return c


_PY = _Known({ord(a): b for a, b in _MAP.items()} | {ord(c): None for c in _GONE})
_WORDLESS = r"[^\p{L}\p{N}]+"


_SPACED = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(128)
_BEFORE, _WITHIN, _SPLIT, _LETTER = regex.compile(r"!(\p{L})"), regex.compile(r"(\p{L})[*_~^]+(\p{L})"), regex.compile(_WORDLESS), regex.compile(r"\p{L}")


def _join_ascii(words: list[bytes]) -> str:
    """The end of fold(), at once for all bytes."""
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    if len(words) > 1:
        blank = b == 32
        one = blank[:-2] & blank[2:] & (b[1:-1] > 96)
        keep = np.ones(len(b), bool)
        keep[np.flatnonzero(one[:-2] & one[2:]) + 2] = False
        b = b[keep]
    return b[np.r_[True, (b[1:] != b[:-1]) | (b[1:] < 97)]][1:-1].tobytes().decode()


def fold(text: str) -> str:
    """A text as it looks after folding: words between single spaces."""
    t = text.lower().translate(_PY)
    if "!" in t:
        t = _BEFORE.sub(r"i\1", t)
    if "*" in t or "_" in t or "~" in t or "^" in t:
        t = _WITHIN.sub(r"\1\2", _WITHIN.sub(r"\1\2", t))
    if t.isascii():
        return _join_ascii(t.encode().translate(_SPACED).split())
    words = [w for w in _SPLIT.split(t) if w]
    out: list[str] = []
    single = False
    for w in words:
        one = len(w) == 1 and _LETTER.match(w) is not None
        if one and single:
            out[-1] += w
        else:
            out.append(w)
        single = one
    t = " ".join(out)
    for c in "abcdefghijklmnopqrstuvwxyz":
        while c + c in t:
            t = t.replace(c + c, c)
    return t


def _folded_sql(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = rf"regexp_replace(translate(lower({text}), {q(FOLD_FROM)}, {q(FOLD_TO)}), '!(\p{{L}})', 'i\1', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\p{{L}})[*_~^]+(\p{{L}})', '\1\2', 'g')"
    t = rf"(' ' || regexp_replace({t}, '{_WORDLESS}', '  ', 'g') || ' ')"
    t = rf"replace(regexp_replace({t}, ' (\p{{L}}) ', chr(1) || '\1' || chr(1), 'g'), chr(1) || chr(1), '')"
    t = f"trim(regexp_replace({t}, '[ \\x01]+', ' ', 'g'))"
    for c in "abcdefghijklmnopqrstuvwxyz":
        t = f"regexp_replace({t}, '{c}{c}+', '{c}', 'g')"
    return t


def seeds() -> dict[str, int]:
    """The seeds as terms: folded, between blanks."""
    return {f" {fold(w)} ": n for w, n in SEEDS.items()}


def _terms(words: Column) -> Column:
    """The terms of an array of words: each word between blanks, and each of its stems behind a blank."""
    each = F.transform(words, lambda w: F.concat(F.array(F.concat(F.lit(" "), w, F.lit(" "))), F.transform(F.filter(F.array(*[F.lit(k) for k in STEMS]), lambda k: k <= F.length(w)), lambda k: F.concat(F.lit(" "), F.left(w, k)))))
    return F.flatten(each)


def _split_words(batches):
    for b in batches:
        words = [(k, w) for k, cell in zip(b.column(0), b.column(1)) if cell.is_valid for w in [fold(cell.as_py()).split(" ")] if w[0]]
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k, _ in words], pa.int32()), pa.array([w for _, w in words], pa.list_(pa.string()))], names=["toxic", "w"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS) -> dict[str, int]:
    """The lexicon: weights of terms, the seeds among them, from at most per_class documents of each label."""
    key = F.md5(F.col(f"`{label_id}`").cast("string"))
    rows = labels.select(F.col(f"`{label_id}`").alias("l_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"), key.alias("h")).filter("l_id IS NOT NULL")
    chosen = [rows.filter(F.col("toxic") == k).orderBy("h", "l_id").limit(per_class).select("l_id", "toxic") for k in (1, 0)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class ids
    texts = docs.select(F.col(f"`{id_col}`").alias("d_id"), F.col(f"`{text_col}`").alias("text")).join(sample, F.col("d_id") == F.col("l_id"))
    words, path = common.materialize(texts.select("toxic", "text").mapInArrow(_split_words, "toxic int, w array<string>"), "labelled")
    size = {r["toxic"]: (r["n"], r["m"]) for r in words.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("w")).alias("m")).collect()}
    lexicon = seeds()
    if len(size) == 2:
        (n0, m0), (n1, m1) = size[0], size[1]
        terms = words.select("toxic", _terms(F.col("w")).alias("t"))
        of = lambda k: F.count(F.when(F.col("toxic") == k, 1))
        rate = terms.select("toxic", F.explode("t").alias("t")).groupBy("t").agg(of(1).alias("a"), of(0).alias("b"))
        have = terms.select("toxic", F.explode(F.array_distinct("t")).alias("t")).groupBy("t").agg(of(1).alias("da"), of(0).alias("db"))
        ratio = F.col("a") * F.lit(float(m0)) / (F.lit(float(m1)) * (F.col("b") + SMOOTH))
        kept = rate.withColumn("ratio", ratio).filter(F.col("ratio") >= MIN_RATIO).join(have, "t")
        kept = kept.filter((F.col("da") >= MIN_DOCS) & (F.col("da") >= F.lit(MIN_SHARE * n1)) & (F.col("da") * F.lit(n0) >= MIN_LIFT * F.col("db") * F.lit(n1)))
        for r in kept.select("t", F.least(F.lit(10), F.round(2 * F.log("ratio"))).cast("int").alias("weight")).collect():
            lexicon[r["t"]] = max(r["weight"], lexicon.get(r["t"], 0))
    common.release(docs.sparkSession, path)
    sure = seeds()  # a term isn't needed if a stem of it weighs as much
    return {t: w for t, w in lexicon.items() if t in sure or not any(lexicon.get(t[:k], 0) >= w for k in range(2, len(t)))}


_automata: dict[tuple, ahocorasick.Automaton] = {}


def _automaton(lexicon: tuple, exceptions: tuple) -> ahocorasick.Automaton:
    """Built once a worker."""
    if (lexicon, exceptions) not in _automata:
        sure, a = seeds(), ahocorasick.Automaton()
        for t, weight in lexicon:
            a.add_word(t, (len(t) - 1, weight, t in sure))
        for w in exceptions:
            a.add_word(f" {fold(w)} ", (len(fold(w)) + 1, 0, False))
        a.make_automaton()
        _automata.clear()
        _automata[lexicon, exceptions] = a
    return _automata[lexicon, exceptions]


def weigh(text: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int]:
    """(weight, terms, seeds) of a folded text."""
    spared: list[int] = []
    reach: list[int] = []
    best: dict[int, tuple[int, int, bool]] = {}
    for end, (n, w, sure) in automaton.iter(f" {text} "):
        at = end - n
        if not w:
            spared.append(at)
            reach.append(end)
        else:
            old = best.get(at)
            best[at] = (w, end, sure) if old is None else (max(old[0], w), min(old[1], end), old[2] or sure)
    if spared:
        pairs = sorted(zip(spared, reach))
        spared = [a for a, _ in pairs]
        far, reach = -1, []
        for _, b in pairs:
            far = max(far, b)
            reach.append(far)
    weight = terms = certain = 0
    for at, (w, end, sure) in best.items():
        k = bisect.bisect_right(spared, at) - 1
        if k < 0 or reach[k] < end:
            weight, terms, certain = weight + w, terms + 1, certain + sure
    return weight, terms, certain


def _scorer(lexicon: tuple, exceptions: tuple):
    def score(batches):
        automaton = _automaton(lexicon, exceptions)
        for b in batches:
            out: list[list[int]] = [[], [], [], []]
            for cell in b.column(b.num_columns - 1):
                t = fold(cell.as_py()) if cell.is_valid else ""
                weight, terms, certain = weigh(t, automaton) if t else (0, 0, 0)
                for x, v in zip(out, (t.count(" ") + 1 if t else 0, terms, certain, weight)):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.int64()) for x in out)], names=[*b.schema.names[:-1], *COUNTS])

    return score


COUNTS = ("n_words", "n_terms", "n_seeds", "weight")


def _frozen(lexicon: dict | None, exceptions: list | None) -> tuple[tuple, tuple]:
    return tuple(sorted((seeds() if lexicon is None else lexicon).items())), tuple(EXCEPTIONS if exceptions is None else exceptions)


def _toxic(words: str, terms: str, sure: str, weight: str, threshold: float) -> Column:
    return (F.col(words) > 0) & (F.col(weight) / F.col(words) >= threshold) & ((F.col(terms) >= MIN_TERMS) | (F.col(sure) > 0))


def score_toxicity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: dict | None = None, exceptions: list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_terms, n_seeds, weight, score, toxic) for every row; lexicon: as of learn()."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in COUNTS)])
    score = F.when(F.col("n_words") > 0, F.col("weight") / F.col("n_words"))
    return rows.mapInArrow(_scorer(*_frozen(lexicon, exceptions)), schema).withColumn("score", score).withColumn("toxic", _toxic(*COUNTS, threshold))


def drop_toxic(docs: DataFrame, text_col: str = "text", lexicon: dict | None = None, exceptions: list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't toxic, columns untouched; narrow, no shuffle."""
    copy, *counts = common.fresh(docs, "cl_text", *COUNTS)
    rows = docs.withColumn(copy, F.col(f"`{text_col}`"))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in counts)])
    inner = _scorer(*_frozen(lexicon, exceptions))

    def score(batches):
        for b in inner(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=schema.names)

    kept = rows.mapInArrow(score, schema).filter(~_toxic(*counts, threshold))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_toxicity(docs, lexicon=learn(docs, common.table(spark, sf_dir, "labels"))).filter("toxic")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    sure = ", ".join(f"({q(t)}, {n})" for t, n in sorted(seeds().items()))
    pairs = ", ".join(f"({q(fold(p).split()[0])}, {q(fold(p).split()[1])})" for p in EXCEPTIONS)
    pick = lambda k: f"SELECT doc_id, toxic FROM (SELECT doc_id, toxic FROM labels WHERE toxic = {k} AND doc_id IS NOT NULL ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {PER_CLASS})"
    stems = f"list_transform(list_filter({list(STEMS)}, lambda k: k <= length(w)), lambda k: ' ' || left(w, k))"
    return f"""
WITH seeds(t, weight) AS (VALUES {sure}), spared(a, b) AS (VALUES {pairs}),
folded AS (SELECT doc_id, {_folded_sql("text")} AS t FROM documents),
lists AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(t, ' ') AS ws FROM folded WHERE t <> ''),
words AS (SELECT r, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
sample AS ({pick(1)} UNION ALL {pick(0)}),
labelled AS (SELECT row_number() OVER () AS n, r, toxic, ws FROM sample JOIN lists USING (doc_id)),
size AS (SELECT count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0, sum(len(ws)) FILTER (toxic = 1) AS m1, sum(len(ws)) FILTER (toxic = 0) AS m0 FROM labelled),
lw AS (SELECT n, toxic, unnest(ws) AS w FROM labelled),
lt AS (SELECT n, toxic, t, count(*) AS c FROM (SELECT n, toxic, unnest(list_concat([' ' || w || ' '], {stems})) AS t FROM lw) GROUP BY ALL),
rate AS (SELECT t, coalesce(sum(c) FILTER (toxic = 1), 0) AS a, coalesce(sum(c) FILTER (toxic = 0), 0) AS b, count(*) FILTER (toxic = 1) AS da, count(*) FILTER (toxic = 0) AS db FROM lt GROUP BY t),
learned AS (SELECT t, least(10, round(2 * ln(ratio)))::INT AS weight FROM (SELECT *, a * m0::DOUBLE / (m1::DOUBLE * (b + {SMOOTH})) AS ratio FROM rate, size) x
  WHERE ratio >= {MIN_RATIO} AND da >= {MIN_DOCS} AND da >= {MIN_SHARE} * n1 AND da * n0 >= {MIN_LIFT} * db * n1),
lexicon AS (SELECT t, max(weight) AS weight, bool_or(sure) AS sure FROM (SELECT t, weight, true AS sure FROM seeds UNION ALL SELECT t, weight, false FROM learned) GROUP BY t),
known AS (SELECT w, max(weight) AS weight, bool_or(sure) AS sure FROM (SELECT w, unnest(list_concat([' ' || w || ' '], {stems})) AS t FROM (SELECT DISTINCT w FROM words)) JOIN lexicon USING (t) GROUP BY w),
hits AS (SELECT r, weight, sure FROM words JOIN known USING (w)
  WHERE NOT EXISTS (SELECT 1 FROM spared WHERE (a = w AND b = ws[i + 1]) OR (b = w AND i > 1 AND a = ws[i - 1]))),
sums AS (SELECT r, count(*) AS n_terms, count(*) FILTER (sure) AS n_seeds, sum(weight)::BIGINT AS weight FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, n_terms, n_seeds, weight, weight / len(ws) AS score, true AS toxic
FROM sums JOIN lists USING (r) WHERE weight / len(ws) >= {THRESHOLD} AND (n_terms >= {MIN_TERMS} OR n_seeds > 0)
"""


SQL = _sql()
