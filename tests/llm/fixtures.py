"""Small tables with all awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from math import log

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(40_000))
#: Names that the operators use inside.
CLASH = ["__id", "__th", "__keep", "__text", "chunk", "fp", "n_words", "weight", "cl_id", "cl_folded", "sid", "label", "item_id", "n"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASH)])


def docs_of(spark, rows):
    """A documents table of (doc_id, text[, lang]) with extra columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1]), *(f"{c} {r[0]}" for c in CLASH)) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


ODD = [(1, None), (None, None), (None, "a text without an id"), (2, ""), (3, ""), (4, "   \n\t "), (5, "!!! --- ???"), (6, "one"), (7, "one"), (7, "one"), (8, LONG), (9, LONG), (None, "Größe 😀 naïve Ωmega"), (10, "zero\u0000byte")]


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split() if (text or "").isascii() else _unicode_words(text)


def _unicode_words(text):
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()


def backoff(texts, alpha=0.4):
    """(words, log score) of every text by the counts of all others."""
    all_words = [words(t) for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    own = [{n: grams(w, n) for n in (1, 2, 3)} for w in all_words]
    total = {n: sum((o[n] for o in own), Counter()) for n in (1, 2, 3)}
    n_all, out = sum(map(len, all_words)), []
    for w, o in zip(all_words, own):
        c = lambda g, o=o: total[len(g)][g] - o[len(g)][g]
        s = 0.0
        for i in range(len(w)):
            top = min(i + 1, 3)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    s += (top - 1) * log(alpha) + log(max(c(g), 1)) - log(max(n_all - len(w), 1))
                elif c(g) > 0:
                    s += (top - n) * log(alpha) + log(c(g)) - log(c(g[:-1]))
                    break
        out.append((len(w), s))
    return out


def spans(rows, least=50):
    """Brute-force repeated spans: every window against the first equal one, then runs."""
    docs = sorted(((i, words(t)) for i, t in rows if t), key=lambda x: x[0])
    first, pairs = {}, []
    for i, w in docs:
        for p in range(len(w) - least + 1):
            g = tuple(w[p : p + least])
            if g in first:
                pairs.append((i, p, *first[g]))
            else:
                first[g] = (i, p)
    runs = []
    for i, p, j, q in sorted(pairs, key=lambda x: (x[0], x[2], x[3] - x[1], x[1])):
        if runs and runs[-1][0] == i and runs[-1][3] == j and runs[-1][4] - runs[-1][1] == q - p and p == runs[-1][1] + runs[-1][2] - least + 1:
            runs[-1][2] += 1
        else:
            runs.append([i, p, least, j, q])
    return sorted(map(tuple, runs))


def shingles(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def held_items(rows, items, n=3, share=0.8):
    """(doc, item, most n-grams in a window, all n-grams) by looking at every window of every text."""
    out = []
    for d, text in rows:
        w = words(text)
        for item, t in items:
            v = words(t)
            if not v or not w:
                continue
            k = min(n, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
            best = 0
            for p in range(max(1, len(w) - len(v) + 1)):
                own = w[p : p + len(v)]
                best = max(best, len(grams & {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}))
            if best >= max(1, -(-int(share * 1e6) * len(grams) // 1_000_000)):
                out.append((d, item, best, len(grams)))
    return sorted(out)


def learned(rows, labels):
    """The lexicon that labelled texts teach, counted plainly."""
    from cohortloom.llm import op02_toxicity as tox

    texts, out = dict(rows), tox.seeds()
    own = [(k, tox.fold(texts[i] or "").split()) for i, k in labels if texts.get(i)]
    n, m = Counter(k for k, w in own if w), Counter()
    rate, have = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for k, w in own:
        m[k] += len(w)
        terms = [t for x in w for t in [f" {x} ", *(f" {x[:j]}" for j in tox.STEMS if j <= len(x))]]
        rate[k].update(terms)
        have[k].update(set(terms))
    if n[0] and n[1]:
        for t, a in rate[1].items():
            ratio = a * m[0] / (m[1] * (rate[0][t] + tox.SMOOTH))
            d = have[1][t]
            if ratio >= tox.MIN_RATIO and d >= max(tox.MIN_DOCS, tox.MIN_SHARE * n[1]) and d * n[0] >= tox.MIN_LIFT * have[0][t] * n[1]:
                out[t] = max(out.get(t, 0), min(10, round(2 * log(ratio))))
    return {t: w for t, w in out.items() if t in tox.seeds() or not any(out.get(t[:k], 0) >= w for k in range(len(t)))}
