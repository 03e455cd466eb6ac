"""Exact and near deduplication, repeated spans."""

import random

import numpy as np
import pytest
import pyarrow as pa

from cohortloom.llm import op06_substring as sub
from cohortloom.llm import op08_exact as exact
from cohortloom.llm import op09_minmax as near

from .fixtures import LONG, ODD, docs_of, jaccard, shingles, spans

rng = random.Random(3)
VOCABULARY = [f"word{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_fingerprints_combine():
    for a, b in (("abc", "def"), ("x" * 5000, "y" * 9001), ("", "q"), ("ß" * 3000, "z")):
        fa, fb, fab = (exact.fingerprints(pa.array([t]))[0][0] for t in (a, b, a + b))
        halves = lambda f: (int(f) >> 31 & (1 << 31) - 1, int(f) & (1 << 31) - 1)
        assert exact.combine(halves(fa), halves(fb), len(b.encode())) == halves(fab)


def test_fingerprints_do_not_depend_on_the_batch():
    texts = [prose(n) for n in (1, 50, 3000)] + ["", LONG]
    alone = [exact.fingerprints(pa.array([t]))[0][0] for t in texts]
    assert list(exact.fingerprints(pa.array(texts))[0]) == alone


def brute_copies(rows):
    first, out = {}, []
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda x: (x[0] is not None, x[0] or 0)):
        if t in first:
            out.append((i, first[t]))
        first.setdefault(t, i)
    return sorted(out, key=repr)


def test_exact_copies_and_awkward_rows(spark):
    got = exact.exact_duplicates(docs_of(spark, ODD)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_copies(ODD)
    kept = exact.drop_exact_duplicates(docs_of(spark, ODD))
    assert kept.columns == docs_of(spark, ODD).columns
    texts = [r.text for r in kept.collect()]
    assert texts.count(None) == 2 and len([t for t in texts if t is not None]) == len({t for _, t in ODD if t is not None})


def test_equal_fingerprints_of_different_texts_are_compared(spark):
    rows = [(i, t) for i, t in enumerate(["aaa", "bbb", "aaa", "ccc", "bbb", "bbb", "ddd", "x" * 200_000, "x" * 199_999 + "y", "x" * 200_000])]
    v = exact.verdicts(docs_of(spark, rows), bits=1).collect()
    assert sorted((r.__getitem__("__id"), r.first_id) for r in v) == [(0, 0), (1, 1), (2, 0), (4, 1), (5, 1), (7, 7), (9, 7)]


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert exact.exact_duplicates(none).count() == 0 and exact.drop_exact_duplicates(none).count() == 0
    assert near.near_duplicates(none).count() == 0 and near.drop_near_duplicates(none).count() == 0
    assert sub.repeated_spans(none).count() == 0


def test_large_groups_are_compared_in_shares(spark):
    rows = [(i, "the same text") for i in range(60)] + [(100 + i % 3, "again " * 20_000) for i in range(9)] + [(200, "other"), (201, None)]
    want = sorted([(i, 0) for i in range(1, 60)] + [(100, 100)] * 2 + [(101, 100)] * 3 + [(102, 100)] * 3)
    for hot, bits in ((7, 62), (7, 0)):  # without bits all texts of a length are compared
        got = exact.verdicts(docs_of(spark, rows), bits=bits, hot=hot).collect()
        found = sorted((r["__id"], r.first_id) for r in got for _ in range(r.n - ((r["__id"], r["__th"]) == (r.first_id, r.first_th))))
        assert found == want


def test_min_and_max_share_one_evaluation():
    from cohortloom.llm import tokens

    words, starts = tokens.word_hashes(pa.array(["a b c d e f", "a b c d e f", "u v w x y z"]))
    _, sig = near.signatures(words, starts, 8)
    assert sig.shape == (3, 16) and (sig[0] == sig[1]).all() and (sig[0] != sig[2]).all()
    assert (sig[:, 0::2] <= sig[:, 1::2]).all()


def test_signatures_estimate_the_similarity():
    from cohortloom.llm import tokens

    errors = []
    for change in (2, 5, 10, 20):
        a = prose(300).split()
        b = a[:]
        for i in rng.sample(range(300), change):
            b[i] = "changed"
        words, starts = tokens.word_hashes(pa.array([" ".join(a), " ".join(b)]))
        _, sig = near.signatures(words, starts)
        errors.append((sig[0] == sig[1]).mean() - jaccard(shingles(" ".join(a)), shingles(" ".join(b))))
    assert abs(np.mean(errors)) < 0.08 and max(map(abs, errors)) < 0.2


def near_rows():
    rows, groups = [], []
    for g in range(30):
        base = prose(120).split()
        ids = []
        for k in range(2 + g % 4):
            w = base[:]
            for i in rng.sample(range(120), 2):
                w[i] = f"other{k}"
            rows.append((g * 100 + k, " ".join(w)))
            ids.append(g * 100 + k)
        groups.append(ids)
    singles = [(9000 + k, prose(120)) for k in range(60)]
    return rows + singles, groups, [i for i, _ in singles]


def test_near_copies_have_recall_and_clean_rows_stay(spark):
    rows, groups, singles = near_rows()
    got = {r.doc_id: r.near_of for r in near.near_duplicates(docs_of(spark, rows)).collect()}
    wanted = [(i, g[0]) for g in groups for i in g[1:]]
    assert sum(got.get(i) == first for i, first in wanted) >= 0.9 * len(wanted)
    assert not set(got) & set(singles)
    text = dict(rows)
    for i, first in got.items():
        assert jaccard(shingles(text[i]), shingles(text[first])) > 0.4
    kept = {r.doc_id for r in near.drop_near_duplicates(docs_of(spark, rows)).select("doc_id").collect()}
    assert kept == set(text) - set(got)


def groups_of(rows, got):
    return {i: got.get(i, i) for i, _ in rows}


def all_pairs():
    """Texts with a partner at similarities from about 0.3 to 0.9, near 0.5 most; all pairs of 0.5 or more by brute force."""
    rows = []
    for g in range(160):
        base = prose(150).split()
        w = base[:]
        for i in rng.sample(range(150), rng.choice([4, 10, 14, 16, 17, 18, 19, 20, 24, 30])):
            w[i] = f"other{g}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w))]
    cut = [(i, shingles(t)) for i, t in rows]
    return rows, {(i, j): s for n, (i, a) in enumerate(cut) for j, b in cut[:n] if (s := jaccard(a, b)) >= 0.5}


@pytest.mark.parametrize("hot", [near.HOT, 3])
def test_recall_against_all_pairs(spark, hot):
    rows, pairs = all_pairs()
    close = {p for p, s in pairs.items() if s < 0.6}
    assert len(close) > 40 and len(pairs) > len(close) + 10
    group = groups_of(rows, {r.doc_id: r.near_of for r in near.near_duplicates(docs_of(spark, rows), hot=hot).collect()})
    found = {(i, j) for i, j in pairs if group[i] == group[j]}
    assert len(found) >= 0.9 * len(pairs) and len(found & close) >= 0.85 * len(close)
    text = dict(rows)
    for i, first in group.items():
        assert jaccard(shingles(text[i]), shingles(text[first])) > 0.3


def test_large_buckets_are_compared_in_parts(spark):
    """90 near copies and 60 texts that share most bands' values by chance of nothing else, in buckets of at most 8."""
    base = prose(200).split()
    rows = [(k, " ".join([f"own{k}" if i == 2 * k else w for i, w in enumerate(base)])) for k in range(90)]
    rows += [(500 + k, prose(150)) for k in range(60)]
    whole = {r.doc_id: r.near_of for r in near.near_duplicates(docs_of(spark, rows)).collect()}
    parts = {r.doc_id: r.near_of for r in near.near_duplicates(docs_of(spark, rows), hot=8).collect()}
    assert whole == parts == {k: 0 for k in range(1, 90)}


def test_no_pair_of_the_threshold_is_left_out(spark):
    """Texts with a partner near the threshold, against all pairs of their signatures."""
    from cohortloom.llm import tokens

    own, rows = random.Random(8), []
    for g in range(700):
        base = [own.choice(VOCABULARY) for _ in range(150)]
        w = base[:]
        for i in own.sample(range(150), own.choice([18, 19, 20, 21, 22])):
            w[i] = f"other{g}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w))]
    sig = near.signatures(*tokens.word_hashes(pa.array([t for _, t in rows])))[1].astype(np.uint16)
    want = near._Sets(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(near.similarity(sig[i], sig[:i]) >= near.THRESHOLD):
            want.join(i, int(j))
    links = {i: int(g) for i, g in enumerate(want.roots()) if i != g}
    assert 250 < len(links) < 650
    got = {r.doc_id: r.near_of for r in near.near_duplicates(docs_of(spark, rows)).collect()}
    assert not set(links) - set(got)
    assert got == links


def test_bands_leave_no_pair_out():
    r = np.random.default_rng(5)
    for values, rows, threshold in ((128, 2, 0.45), (128, 3, 0.45), (128, 1, 0.3), (16, 2, 0.5), (16, 3, 0.2), (10, 4, 0.1), (128, 2, 1.0)):
        places = near.bands(values, rows, threshold)
        a = np.arange(values, dtype=np.uint16)
        need = next(k for k in range(values + 1) if near.similarity(a, np.where(np.arange(values) < k, a, a + 1)) >= threshold)
        for _ in range(300):
            equal = r.permutation(values) < need
            assert equal[places].all(axis=1).any()
    for threshold in (0, 1.1):
        with pytest.raises(ValueError):
            near.bands(128, 2, threshold)


def test_links_between_blocks_of_large_buckets_are_found(spark):
    """Chains of entries that are near their neighbours only, so that most links are between blocks and of no block's first entries."""
    r = np.random.default_rng(4)
    sig = []
    for length in (60, 30, 9, 1, 1):
        one = r.integers(0, 256, 128)
        for _ in range(length):
            sig.append(one)
            one = np.where(r.permutation(128) < 62, r.integers(0, 256, 128), one)
    sig = np.array(sig, np.uint16)[r.permutation(len(sig))]
    want = near._Sets(len(sig))
    for i in range(len(sig)):
        for j in np.flatnonzero(near.similarity(sig[i], sig[:i]) >= near.THRESHOLD):
            want.join(i, int(j))
    assert len(set(want.roots())) < 12
    rated = spark.createDataFrame([(7, i, bytearray(s.tobytes()), len(sig)) for i, s in enumerate(sig)], "key long, sid long, bytes binary, n long")
    for hot in (5, 40, 1000):
        have = near._Sets(len(sig))
        for a, b in near._edges(rated, near.THRESHOLD, hot, 8)[0].collect():
            assert near.similarity(sig[a], sig[b]) >= near.THRESHOLD
            have.join(a, b)
        assert (want.roots() == have.roots()).all(), hot


def test_near_copies_of_awkward_rows(spark):
    got = sorted(((r.doc_id, r.near_of) for r in near.near_duplicates(docs_of(spark, ODD)).collect()), key=repr)
    assert got == sorted([(7, 6), (7, 6), (9, 8)], key=repr)
    assert near.drop_near_duplicates(docs_of(spark, ODD)).count() == len(ODD) - 3


def test_near_edges_connect_what_all_pairs_connect():
    r = np.random.default_rng(1)
    for _ in range(20):
        sig = r.integers(0, 3, (40, 16)).astype(np.uint8)
        want = near._Sets(40)
        for i in range(40):
            for j in range(i):
                if near.similarity(sig[i], sig[j]) >= 0.5:
                    want.join(i, j)
        have = near._Sets(40)
        for i, j in near.near_edges(sig, 0.5):
            have.join(i, j)
        assert (want.roots() == have.roots()).all()


def test_spans_are_those_of_brute_force(spark):
    passage, other = prose(80), prose(55)
    rows = [(1, prose(30) + " " + passage), (2, passage + " " + prose(40) + " " + passage), (3, prose(200)), (4, other + " " + prose(10) + " " + other), (5, prose(7) + " " + other), (6, passage.upper().replace(" ", ", ")), (7, prose(49)), (8, " ".join(passage.split()[:49])), (9, None), (10, "")]
    rows += [(11, "again " * 130)]
    got = sorted(map(tuple, sub.repeated_spans(docs_of(spark, rows)).collect()))
    assert got == spans(rows)
    assert {r[0] for r in got} >= {2, 4, 5, 6, 11}


def test_spans_of_awkward_rows(spark):
    got = sub.repeated_spans(docs_of(spark, ODD)).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in got} >= {(9, 8)}
    whole = max(r.n_words for r in got if r.doc_id == 9)
    assert {r.doc_id for r in got} == {8, 9} and whole >= 50


def test_blocks_must_fit_the_least_repeat(spark):
    with pytest.raises(ValueError):
        sub.repeated_spans(docs_of(spark, []), block=26, min_words=50)
