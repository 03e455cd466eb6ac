"""The pipeline against a brute-force version, and its stages on awkward tables."""

import base64
import random

import corpus_pipeline
from cohortloom.llm import op02_toxicity as tox
from cohortloom.llm import op03_bpe as bpe

from .fixtures import ODD, docs_of, held_items, jaccard, learned, shingles
from .test_scoring import TOXIC

rng = random.Random(12)
VOCABULARY = [f"word{i}" for i in range(600)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def tables(spark, folder):
    items = [(i, prose(25)) for i in range(5)]
    rows, i = [], 0

    def add(t):
        nonlocal i
        rows.append((i, t))
        i += 1

    for k in range(12):
        base = prose(150)
        add(base)
        add(base)
        near = base.split()
        near[k], near[k + 40] = "changed", "twice"
        add(" ".join(near))
        add(prose(60) + " " + items[k % 5][1] + " " + prose(30))
        add(prose(40) + " " + TOXIC)
        add(prose(90))
    add(None)
    add("")
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(TOXIC in (r[1] or ""))) for r in rows], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, items


def brute(rows, items):
    """ids that every stage keeps, one stage after another."""
    terms = learned(rows, [(i, int(TOXIC in (t or ""))) for i, t in rows])

    def toxic(t):
        words = tox.fold(t or "").split()
        hits = [(max(terms.get(x, 0) for x in own), own[0] in tox.seeds()) for w in words for own in [[f" {w} ", *(f" {w[:k]}" for k in range(1, len(w) + 1))]]]
        hits = [h for h in hits if h[0]]
        return bool(words) and sum(w for w, _ in hits) / len(words) >= tox.THRESHOLD and (len(hits) > 1 or any(s for _, s in hits))

    left = [r for r in rows if not toxic(r[1])]
    seen, kept = set(), []
    for i, t in left:
        if t is None or t not in seen:
            kept.append((i, t))
        seen.add(t)
    left, kept = kept, []
    for i, t in left:
        if not t or not any(u and jaccard(shingles(t), shingles(u)) > 0.5 for _, u in kept):
            kept.append((i, t))
    gone = {d for d, *_ in held_items(kept, items)}
    return {i: t for i, t in kept if i not in gone}


def test_run_is_brute_force(spark, tmp_path):
    import tiktoken

    rows, items = tables(spark, tmp_path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(rows, items)
    assert set(got) == set(want) and len(want) == 12 * 2 + 2
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    for i, t in want.items():
        assert got[i].text == t and got[i].token_ids == (None if t is None else enc.encode_ordinary(t))


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    for rows in (ODD, []):
        docs = docs_of(spark, rows)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.schema.names == docs.schema.names, name
                out.write.parquet(f"{tmp_path}/{name}-{len(rows)}")
                docs = spark.read.parquet(f"{tmp_path}/{name}-{len(rows)}")
            else:
                # 14 rows: one 7, one empty, one long and two "one" are copies; null texts stay
                assert out.count() == (len({t for _, t in rows if t is not None}) + sum(t is None for _, t in rows))


def test_run_on_empty_tables(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_leaves_no_pair_of_the_threshold(spark, tmp_path):
    """Texts with a partner near the threshold: the stage drops those that all pairs of signatures drop."""
    import numpy as np
    import pyarrow as pa

    from cohortloom.llm import op09_minmax as near
    from cohortloom.llm import tokens

    own, rows = random.Random(8), []
    for g in range(700):
        base = [own.choice(VOCABULARY[:400]) for _ in range(150)]
        w = base[:]
        for i in own.sample(range(150), own.choice([18, 19, 20, 21, 22])):
            w[i] = f"other{g}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w))]
    sig = near.signatures(*tokens.word_hashes(pa.array([t for _, t in rows])))[1].astype(np.uint16)
    gone = {i for i in range(len(rows)) if (near.similarity(sig[i], sig[:i]) >= near.THRESHOLD).any()}
    assert 250 < len(gone) < 650
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(spark, rows), str(tmp_path)).collect()}
    assert not kept & gone
    assert kept == set(range(len(rows))) - gone
