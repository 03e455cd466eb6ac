"""Stupid-backoff scores, toxicity, byte-level BPE."""

import base64
import hashlib
import random
import time

import pytest

from cohortloom.llm import op01_backoff, op02_toxicity as tox, op03_bpe as bpe

from .fixtures import LONG, ODD, backoff, docs_of, learned

rng = random.Random(1)


def prose(n, size=40):
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


def test_scores_are_those_of_brute_force(spark):
    rows = [(i, prose(n)) for i, n in enumerate([1, 2, 3, 5, 40, 200, 200])] + [(20, "never seen before"), (21, None), (22, ""), (23, "Same, same!"), (23, "Same, same!")]
    got = sorted((r.doc_id, r.n_words, r.log_score) for r in op01_backoff.backoff_scores(docs_of(spark, rows), chunk_bytes=300).collect())
    want = sorted((i, n, round(s, 4)) for (i, _), (n, s) in zip(rows, backoff([t for _, t in rows])))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-4)


def test_scores_of_awkward_rows(spark):
    got = op01_backoff.backoff_scores(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].n_words, by[1].log_score, by[1].mean_log_score) == (0, 0.0, None) and by[2].n_words == by[5].n_words == 0
    assert by[8].n_words == 80_000 and by[8].n_order3 > 79_000
    assert op01_backoff.backoff_scores(docs_of(spark, [])).count() == 0


TOXIC = "you are a stupid worthless idiot and pathetic scum"


def test_folding_exceptions_and_threshold(spark):
    clean = "the clown fish swims by the trash can " * 3
    rows = [(1, TOXIC), (2, "y0u 4re a 5tup1d w0rthl3ss id10t"), (3, "ѕtupіd wоrthlеss"), (4, "stu​pid"), (5, clean), (6, "stupidity idiotic scummy"), (7, "idiot " + "fine " * 2000), (8, None), (9, ""), (10, "ÍDIÓT!"), (11, "trash, can")]
    rows += [(20, "𝐢𝐝𝐢𝐨𝐭"), (21, "ⓘⓓⓘⓞⓣ"), (22, "ıdıot"), (23, "!diot"), (24, "i d i o t"), (25, "i.d.i.o.t"), (26, "i*di*ot"), (27, "idiooot"), (28, "i\u0301diot"), (29, "well!"), (30, "in a b c order 1 2 3")]
    got = {r.doc_id: r for r in tox.score_toxicity(docs_of(spark, rows)).collect()}
    assert [i for i in sorted(got) if got[i].toxic] == [1, 2, 3, 4, 10, *range(20, 29)]
    assert got[5].weight == 0 and got[11].weight == 0 and got[6].weight == 0 and got[7].weight == 5 and got[8].score is None
    left = tox.drop_toxic(docs_of(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == [5, 6, 7, 8, 9, 11, 29, 30] and left.columns == docs_of(spark, rows).columns


def test_folding_is_that_of_sql():
    import duckdb

    signs = list("abil1 dio.t!*_-'\"|@$ 0123ABSTRaeé") + list("ÀÉîøØßŒıİſ𝐢𝟙ⓘ⒤１ＩΣσς\u0301\u0308ΩжАЙ😀\x01\n\u200b\u00a0½²Ⅳﬁ")
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))) for i in range(2000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INT, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", rows)
    got = con.execute(f"SELECT i, {tox._folded_sql('t')} FROM x").fetchall()
    assert dict(got) == {i: tox.fold(t) for i, t in rows}


def labelled(n=60):
    """Documents of an invented language, every sixth with insults of it (labelled), and others without a label."""
    rows, labels = [], []
    for i in range(n):
        w = [f"{rng.choice(['mora', 'tilu', 'gepo', 'sarn'])}{rng.choice(['e', 'as', 'ino', ''])}" for _ in range(80)]
        if i % 6 == 0:
            for k in range(0, 80, 4):
                w[k] = rng.choice(["vrogak", "vrogakim", "vrogakos"])
        rows.append((i, " ".join(w)))
        if i % 3 < 2:
            labels.append((i, int(i % 6 == 0)))
    return rows, labels


def test_lexicon_is_learned_from_labels(spark):
    rows, labels = labelled()
    odd = [(None, 1), (10_000, 1), (1, None), (2, 7)]
    docs, marks = docs_of(spark, rows + [(900, None), (901, "")]), spark.createDataFrame(labels + odd + [(900, 1), (901, 0)], "doc_id long, toxic int")
    got = tox.learn(docs, marks)
    assert got == learned(rows, labels) and {t for t in got if t not in tox.seeds()} == {" vrog"}
    flagged = tox.score_toxicity(docs, lexicon=got).filter("toxic").collect()
    assert sorted(r.doc_id for r in flagged) == [i for i, _ in rows if i % 6 == 0]  # those without a label too
    one = [(1, "vrogak " + "mora " * 30), (2, "vrogak vrogaki " + "mora " * 30)]  # a learned term alone isn't enough
    assert [r.doc_id for r in tox.score_toxicity(docs_of(spark, one), lexicon=got).filter("toxic").collect()] == [2]
    fewer = tox.learn(docs, marks, per_class=4)
    first = sorted(labels, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest())
    chosen = [x for k in (0, 1) for x in [x for x in first if x[1] == k][:4]]
    assert fewer == learned(rows, chosen)
    empty = spark.createDataFrame([], marks.schema)
    assert tox.learn(docs, empty) == tox.learn(docs_of(spark, []), marks) == tox.learn(docs, marks.filter("toxic = 1")) == tox.seeds()


def test_many_terms_and_exceptions_take_linear_time():
    a = tox._automaton(*tox._frozen(None, None))
    took = []
    for n in (20_000, 80_000):
        t = tox.fold("trash can idiot " * n)
        began = time.process_time()
        assert tox.weigh(t, a) == (5 * n, n, n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_toxicity_of_awkward_rows(spark):
    got = tox.score_toxicity(docs_of(spark, ODD))
    assert got.count() == len(ODD) and got.filter("toxic").count() == 0 and got.filter("toxic IS NULL").count() == 0
    assert tox.drop_toxic(docs_of(spark, ODD)).count() == len(ODD)
    assert tox.score_toxicity(docs_of(spark, [])).count() == tox.drop_toxic(docs_of(spark, [])).count() == 0


def test_ids_are_those_of_a_plain_encoder_and_decode_back(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t) for i, t in enumerate(t for _, t in ODD)] + [(50, "<|endoftext|> is text"), (51, "tabs\t\tand\n\n lines  "), (52, "it's we'll I'd 1234567 日本語 \U0001f600‍"), (53, "a" * 5000), (53, "a" * 5000)]
    got = bpe.encode_and_decode(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert r.text == text[r.doc_id]
        assert r.token_ids == (None if text[r.doc_id] is None else enc.encode_ordinary(text[r.doc_id]))


def test_bpe_in_many_chunks_and_of_an_empty_table(spark):
    rows = [(i, prose(30)) for i in range(200)]
    got = bpe.decode(bpe.encode(docs_of(spark, rows), chunk_bytes=500)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    assert bpe.encode_and_decode(docs_of(spark, [])).count() == 0
    assert len(LONG) > 100_000
