"""Hand-made cases: boundaries, nulls, ties and what SQL doesn't show."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import metrics
from cohortloom.operators import communities, context, cooccurrence, ehr, finetune, graph, prompts, providers, retrieval, triples, vectors

DAY = dt.datetime


def visits_of(spark, rows):
    """(patient, visit, time, status, has codes)."""
    lists = lambda ok: (["c"], ["p"], ["d"]) if ok else (["c"], [], ["d"])
    full = [(p, v, i, t, s, *lists(ok)) for i, (p, v, t, s, ok) in enumerate(rows)]
    return spark.createDataFrame(full, "patient_id string, visit_id string, visit_key long, visit_ts timestamp_ntz, discharge_status int, conditions array<string>, procedures array<string>, drugs array<string>")


def labels(df):
    return {r.visit_id: r.label for r in df.collect()}


def test_readmission_counts_full_days(spark):
    v = visits_of(spark, [("a", "1", DAY(2020, 1, 1, 23), None, True), ("a", "2", DAY(2020, 1, 16, 0), None, True), ("b", "3", DAY(2020, 1, 1), None, True), ("b", "4", DAY(2020, 1, 16), None, True)])
    assert labels(ehr.readmission(v)) == {"1": 1, "3": 0}


def test_mortality_label_comes_from_an_unfiltered_visit(spark):
    v = visits_of(spark, [("a", "1", DAY(2020, 1, 1), 0, True), ("a", "2", DAY(2020, 1, 2), 1, False), ("a", "3", DAY(2020, 1, 3), None, True), ("a", "4", DAY(2020, 1, 4), 2, True)])
    assert labels(ehr.next_visit_mortality(v)) == {"1": 1, "3": 0}


def test_length_of_stay_buckets(spark):
    d = spark.createDataFrame([(x,) for x in (-1, 0, 1, 7, 8, 14, 15)], "d int")
    assert [r[0] for r in d.select(ehr.los_category(F.col("d"))).collect()] == [0, 0, 1, 7, 8, 8, 9]


def test_balanced_cohort_keeps_its_limits(spark):
    rows = [(f"p{i}", f"p{i}_0", 0, i % 2, i) for i in range(40)] + [("long", "long_9", 9, 1, 99)]
    s = spark.createDataFrame(rows, "patient_id string, sample_id string, sample_idx int, label int, ord int")
    got = ehr.balanced_cohort(s, most_positive=5, most=12).collect()
    assert sum(r.label for r in got) == 5 and len(got) == 12 and "long" not in {r.patient_id for r in got}


def test_context_marks_repeats_within_a_visit(spark):
    d = spark.createDataFrame([("s", 0, ["a", "a"], ["x"], []), ("s", 1, ["B"], [], ["m"])], "sample_id string, visit_idx int, conditions array<string>, procedures array<string>, drugs array<string>")
    t = context.contexts(d).first().text
    assert "1. a\n2. a (continued from previous visit)" in t and "1. b (new)" in t and t.startswith("Visit 0:")


def test_brackets_quotes(spark):
    d = spark.createDataFrame([("[[a, b, c], [d, e, f]]",)], "t string")
    assert [tuple(x) for x in d.select(triples.parse_strict(F.col("t")).alias("x")).first().x] == [("a", "b", "c"), ("d", "e", "f")]
    q = spark.createDataFrame([("'abc'",), ("'abc",), ("abc",)], "s string")
    assert [r[0] for r in q.select(triples.strip_quotes(F.col("s"))).collect()] == ["abc", "ab", "abc"]


def test_near_duplicate_sets(spark):
    chain = [(1, list("abcdef")), (2, list("abcdgh")), (3, list("abxygh"))]
    d = spark.createDataFrame(chain, "ord long, concepts array<string>")
    assert [r.ord for r in cooccurrence.near_duplicate_filter(d).orderBy("ord").collect()] == cooccurrence.greedy_by_scan(pd.DataFrame(chain, columns=["ord", "concepts"])) == [1, 3]
    small = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d"])], "ord long, concepts array<string>")
    assert [r.ord for r in cooccurrence.near_duplicate_filter(small).collect()] == [1]
    rng = random.Random(2)
    rows = [(i, rng.sample("abcdefghijklmnop", rng.randint(1, 12))) for i in range(80)]
    for bound in (None, 4):
        want = cooccurrence.greedy_by_scan(pd.DataFrame(rows, columns=["ord", "concepts"]), 5, bound)
        got = cooccurrence.near_duplicate_filter(spark.createDataFrame(rows, "ord long, concepts array<string>"), 5, bound)
        assert sorted(r.ord for r in got.collect()) == want


def test_confidence_and_tail(spark):
    c = "\n# Confidence #\n"
    d = spark.createDataFrame([(1, "train", f"x{c}Not Confident"), (2, "train", f"x{c}Very Not Confident"), (3, "test", f"x{c}Not Confident"), (4, "val", None)], "id int, split string, reasoning string")
    assert sorted(r.id for r in prompts.confident(d).collect()) == [2, 3, 4]
    assert d.select(prompts.without_tail(F.lit("# Reasoning Chain #\nabc" + c + "tail"))).first()[0] == "abc"


def test_binary_metrics_of_a_known_case(spark):
    d = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    m = metrics.binary(d).first()
    assert m.accuracy == 0.75 and m.roc_auc == pytest.approx(0.75) and m.pr_auc == pytest.approx(0.8333333)


def test_labels_without_marker_or_of_wrong_length(spark):
    d = spark.createDataFrame([("1", "0"), ("long text", "1"), ("long text", "0")], "t string, y string")
    assert [r[0] for r in d.select(metrics.label_direct(F.col("t"), F.col("y"))).collect()] == ["1", "0", "1"]
    assert d.select(metrics.label_last(F.lit("no marker"))).first()[0] == "0"


def test_mix_takes_the_first_rows_and_rejects_negative_fractions(spark):
    d = spark.range(10).withColumn("k", F.lit("a"))
    assert sorted(r.id for r in finetune.mix([(d, 0.25)], "id", ["k"]).collect()) == [0, 1]
    with pytest.raises(ValueError):
        finetune.mix([(d, -0.1)], "id", ["k"])


def test_too_few_facts_raise(spark):
    d = spark.createDataFrame([(["a"],)], "k array<string>")
    with pytest.raises(Exception, match="fewer than 10"):
        d.select(prompts.numbered(F.col("k"))).collect()


def unit(n, dim, seed):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_top_k_and_close_pairs_are_those_of_all_pairs(spark):
    m = unit(60, 8, 1)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    s = np.round(m @ m.T, 9)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i], kind="stable")[:4]}
    for blocks in (None, (2, 3)):
        assert {(r.query, r.item) for r in vectors.top_k(d, d, 4, blocks=blocks).collect()} == want
    rows = d.select("*", F.floor(F.col("id") / 2).alias("patient"), (F.col("id") % 3).alias("label"))
    near = {(i, same, int([j for j in np.argsort(-s[i], kind="stable") if j // 2 != i // 2 and (j % 3 == i % 3) == same][0])) for i in range(60) for same in (True, False)}
    assert {(r.query, r.same, r.item) for r in vectors.top_k_by_label(rows, 1, 3).collect()} == near
    pairs = {(i, j) for i in range(60) for j in range(i + 1, 60) if 1 - m[i] @ m[j] < 0.4}
    assert {(r.u, r.v) for r in vectors.close_pairs(d, 0.4, 3).collect()} == pairs


def test_clusters_by_component_are_those_of_the_whole(spark):
    base = unit(6, 8, 2)
    m = np.concatenate([b + 0.12 * unit(7, 8, 10 + i) for i, b in enumerate(base)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    got = {r.id: r.cluster for r in vectors.clusters(d, 0.14).collect()}
    want = vectors.average_linkage(m.copy(), 0.14)
    assert [got[i] for i in range(len(m))] == want.tolist()


def test_paths_from_both_ends_are_the_paths(spark):
    rng = random.Random(4)
    e = spark.createDataFrame([(f"n{rng.randint(0, 11)}", f"r{rng.randint(0, 1)}", f"n{rng.randint(0, 11)}") for _ in range(40)], "head string, relation string, tail string")
    p = spark.createDataFrame([("n1", "n2"), ("n3", "n4"), ("n5", "n0")], "start string, end string")
    a, b = (sorted(map(tuple, f(e, p, 4, 1000).select("start", "end", F.array_join("path", ">")).collect())) for f in (graph.paths, graph.paths_from_both_ends))
    assert a == b


def test_communities_are_bounded_connected_and_cover_all(spark):
    rng = random.Random(5)
    rows = {tuple(sorted((f"n{g * 20 + rng.randint(0, 19):03}", f"n{g * 20 + rng.randint(0, 19):03}"))) for g in range(4) for _ in range(60)}
    rows = [(u, v) for u, v in rows if u != v]
    got = communities.communities(spark.createDataFrame(rows, "u string, v string"), 10).toPandas()
    leaf = got.sort_values("level").groupby("node").last()
    assert set(leaf.index) == {n for r in rows for n in r}
    assert leaf.groupby("community").size().max() <= 10


def test_greedy_retrieval_is_the_plain_loop(spark):
    rng = random.Random(6)
    members = {c: sorted({f"n{rng.randint(0, 30)}" for _ in range(5)}) for c in range(25)}
    direct = {p: sorted({f"n{rng.randint(0, 30)}" for _ in range(4)}) for p in range(6)} | {6: ["unknown"]}
    indirect = {p: sorted({f"n{rng.randint(0, 60)}" for _ in range(6)}) for p in range(7)}
    indirect[6] = ["nowhere"]
    vc, vp, vt = unit(25, 4, 1), unit(7, 4, 2), unit(3, 4, 3)
    visit = {(p, n): k for p in direct for k, n in enumerate(direct[p])}
    nodes = [(p, "direct", n) for p in direct for n in direct[p]] + [(p, "indirect", n) for p in indirect for n in indirect[p]]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = retrieval.greedy_retrieval(
        table(nodes, "sample_id long, kind string, node string"), table([(c, n) for c in members for n in members[c]], "community long, node string"), table([(p, v.tolist()) for p, v in enumerate(vp)], "sample_id long, vec array<double>"),
        table([(c, v.tolist()) for c, v in enumerate(vc)], "community long, vec array<double>"), table([(k, v.tolist()) for k, v in enumerate(vt)], "k long, vec array<double>"), table([(p, n, k) for (p, n), k in visit.items()], "sample_id long, node string, visit_idx int"))
    want = []
    for p in direct:
        taken, left = {}, list(members)
        for r in range(10):
            score = {}
            for c in left:
                d, i = set(direct[p]) & set(members[c]), set(indirect[p]) & set(members[c])
                recency = 1 + 0.1 * np.mean([visit[p, n] for n in d]) if d else 1
                score[c] = (len(d) / len(direct[p]) + 0.8 * len(i) / len(indirect[p])) * np.prod([0.5 ** taken.get(n, 0) for n in members[c]]) * (1 + 0.1 * vc[c] @ vp[p]) * recency * (1 + 0.1 * (vt @ vc[c]).max())
            best = max(score, key=score.get)
            want.append((p, r, best, pytest.approx(score[best], abs=1e-8)))
            left.remove(best)
            for n in members[best]:
                taken[n] = taken.get(n, 0) + 1
    assert sorted(map(tuple, got.collect())) == want


def test_provider_tries_again_then_falls_back():
    asked = []

    def slow(p):
        asked.append(p)
        raise TimeoutError

    assert providers.call(slow, "q", fallback=lambda p: "other " + p) == "other q" and len(asked) == 5
    with pytest.raises(TimeoutError):
        providers.call(slow, "q")


def test_numbered_rows_have_their_places(spark):
    from cohortloom.operators import tables

    d = spark.range(1000).selectExpr("id * 7919 % 1000 AS x", "'p' AS place").repartition(7)
    got = tables.numbered(d, "n", "x").collect()
    assert sorted((r.x, r.n) for r in got) == [(i, i) for i in range(1000)]
    assert tables.numbered(d.filter("x < 0"), "n", "x").count() == 0


def test_contaminated_texts_are_those_that_contain_an_item(spark):
    items = ["", "ab", "two words", "three little words", "a rather long item of words", None, "mid"]
    rows = [(1, "xTHREE  little wordsx"), (2, "three words"), (3, "a rather long item of wordsy"), (4, "rather long item of words"), (5, "cab"), (6, None), (7, ""), (8, "xtwo\nwords"), (8, "clean"), (None, "amid"), (9, "three little other words")]
    from cohortloom.operators import finetune

    b = spark.createDataFrame([(i,) for i in items], "t string")
    got = finetune.drop_contaminated(spark.createDataFrame(rows, "id long, text string"), "id", "text", b, "t").collect()
    plain = [" ".join(i.split()) for i in items if i]
    want = [r for r in rows if r[1] is None or not any(i in " ".join(r[1].lower().split()) for i in plain)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_wrong_predictions_are_criticised_five_at_a_time(spark):
    from cohortloom.operators import prompts

    rows = spark.createDataFrame([(i, f"prompt {i}", 1) for i in range(23)], "id long, prompt string, label int")
    asked = spark.sparkContext.accumulator(0)

    def critic(text):
        asked.add(1)
        return "feedback"

    got = prompts.predictor_rounds(rows, lambda p: "wrong 0", critic, rounds=1).collect()
    assert len(got) == 23 and all(r.wrong for r in got) and asked.value == 5 + 1  # batches, and one call that joins their feedback


def test_rolling_contexts_are_those_of_rolling_documents(spark):
    from cohortloom.operators import context, ehr

    rows = [("p", 0, ["a", "a"], [], ["X"]), ("p", 1, [], [], []), ("p", 2, ["a", "b"], ["c"], []), ("q", 0, [], [], []), ("q", 1, ["b"], [], [])]
    d = spark.createDataFrame([(*r, 0) for r in rows], "patient_id string, sample_idx int, conditions array<string>, procedures array<string>, drugs array<string>, label int")
    assert sorted(map(tuple, context.rolling_contexts(d).collect())) == sorted(map(tuple, context.contexts(ehr.rolling_docs(d)).collect()))


def test_silhouette_is_that_of_all_pairs_and_joins_none(spark):
    m = np.concatenate([unit(40, 8, 3), unit(3, 8, 4)[[0, 0, 1]]])  # two vectors are equal
    c = [i % 4 for i in range(40)] + [7, 7, 9]  # 9 has one member
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    of = spark.createDataFrame(list(enumerate(c)), "id long, cluster int")
    dist = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    want = []
    for i in range(len(c)):
        mean = {k: np.mean([dist[i, j] for j in range(len(c)) if j != i and c[j] == k]) for k in set(c) if any(c[j] == k for j in range(len(c)) if j != i)}
        a, b = mean.get(c[i]), min(v for k, v in mean.items() if k != c[i])
        want.append(0 if a is None else (b - a) / max(a, b))
    for shares in (None, 3):
        got = vectors.silhouette(d, of, shares=shares)
        assert got.first()[0] == pytest.approx(np.mean(want), abs=1e-12)
        assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    one = vectors.silhouette(d, of.withColumn("cluster", F.lit(1))).first()[0]
    assert one == 0


def test_similar_patients_are_those_of_a_plain_ranking(spark):
    rng, m = random.Random(9), unit(70, 8, 5)
    m[5:9] = m[4]  # ties go to the least id
    info = [(i, rng.choice([None, *range(9)]), rng.choice(["a", "b", None]), "x" * rng.choice([3, 30])) for i in range(70)]
    s = np.round(m @ m.T, 9)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    of = spark.createDataFrame(info, "id long, patient int, label string, text string")
    got = {r.id: (r.positive, r.negative) for r in retrieval.similar_patients(d, of, 30, 12, 2, 20, None).collect()}
    for i in range(70):
        near = [int(j) for j in np.argsort(-s[i], kind="stable")[:30]]
        near = [j for j in near if None not in (info[i][1], info[j][1]) and info[i][1] != info[j][1]][:12]
        near = [j for j in near if len(info[j][3]) <= 20 and None not in (info[i][2], info[j][2])]
        for k, same in enumerate((True, False)):
            want = [f"{info[j][3]}\n\nLabel:\n{info[j][2]}\n\n" for j in near if (info[i][2] == info[j][2]) == same][:2]
            assert got[i][k] == (want or [retrieval.NONE])


def test_what_a_search_shuffles_grows_as_its_input(spark, monkeypatch):
    """A share's results are final: no row of a pair is shuffled, and the number of shares doesn't follow the table."""
    monkeypatch.setattr(vectors, "SHARES", 3)
    d = spark.range(9000).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 2), F.sin(F.col("id") * 3)).alias("vec"), (F.col("id") % 3).alias("label"), F.col("id").alias("patient"))
    assert vectors.shares_of(d) == 3
    for got in (vectors.top_k(d, d, 5), vectors.top_k_by_label(d, 1), vectors.top_k_of_others(d.withColumn("fits", F.lit(True)), 20, 10, 2)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Repartition") == 1 and "Window" not in plan and "CoGroup" not in plan
    names = d.withColumn("id", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")))
    a, b = (sorted((int(str(r.query).strip("n")), r.rank, int(str(r.item).strip("n"))) for r in vectors.top_k(x.filter("patient < 40"), x, 3).collect()) for x in (d, names))
    assert a == b


def test_nodes_of_patients_are_made_once_a_profile(spark):
    rng = random.Random(3)
    concepts = [(p, f"c{rng.randint(0, 3)}") for p in range(60) for _ in range(rng.randint(1, 3))]
    graphs = [(f"c{c}", *(rng.choice([f"c{rng.randint(0, 3)}", f"n{rng.randint(0, 9)}"]) for _ in range(2))) for c in range(4) for _ in range(5)]
    c, g = spark.createDataFrame(concepts, "sample_id long, node string"), spark.createDataFrame(graphs, "concept string, head string, tail string")
    want = {(p, "direct", n) for p, n in concepts} | {(p, "indirect", n) for p, k in concepts for x, *ends in graphs for n in ends if x == k != n}
    got = context.patient_nodes(c, g, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    top = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # what comes after the last join
    assert "Aggregate" not in top and "Union" not in top


def test_scores_by_profile_are_those_by_patient(spark):
    rng = random.Random(8)
    concepts = spark.createDataFrame([(p, f"c{p % 3}") for p in range(12)], "sample_id long, node string")
    graphs = spark.createDataFrame([(f"c{c}", f"c{c}", f"n{rng.randint(0, 20)}") for c in range(3) for _ in range(6)], "concept string, head string, tail string")
    members = spark.createDataFrame(sorted({(c, rng.choice([f"n{rng.randint(0, 20)}", f"c{rng.randint(0, 2)}"])) for c in range(14) for _ in range(5)}), "community long, node string")
    vecs = lambda n, seed, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(n, 4, seed))], f"{name} long, vec array<double>")
    visits = concepts.withColumn("visit_idx", F.col("sample_id") % 4)
    of, nodes = context.profiles(concepts, graphs)
    assert nodes.select("profile").distinct().count() == 3
    more = vecs(12, 1, "sample_id"), vecs(14, 2, "community")
    rows = lambda d: sorted(map(tuple, d.collect()))
    plain = context.patient_nodes(concepts, graphs)
    assert rows(retrieval.one_shot_scores(nodes, members, *more, keep=3, of=of)) == rows(retrieval.one_shot_scores(plain, members, *more, keep=3))
    assert rows(retrieval.greedy_retrieval(nodes, members, *more, more[1], visits, of=of)) == rows(retrieval.greedy_retrieval(plain, members, *more, more[1], visits))


def test_near_duplicates_of_large_and_equal_sets(spark, monkeypatch):
    """Sets of all sizes around the number of shared elements, changed copies, equal ones; as many copies more cost no pair more."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        old = rng.choice(rows)[1] if rows and i % 3 else rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(0, 17))
        new = set(old) ^ set(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(0, 5)))
        rows.append((i, sorted(new - {None}) + [None] * (i % 20 == 0)))
    table = lambda r: spark.createDataFrame(r, "ord long, concepts array<string>")
    far = lambda a, b: len(set(a) ^ set(b))
    for t in (1, 4, 5):
        want = {(i, j) for i, a in rows for j, b in rows if i < j and far(a, b) < t}
        assert {(r.i, r.j) for r in cooccurrence.similar_pairs(table(rows), t).collect()} == want
    seen, pairs = [], cooccurrence.similar_pairs
    monkeypatch.setattr(cooccurrence, "similar_pairs", lambda s, *a: seen.append(s.count()) or pairs(s, *a))
    for bound in (None, 6):
        twice = rows + [(1000 * k + i, c[::-1]) for k in (1, 2) for i, c in rows]
        want = cooccurrence.greedy_by_scan(pd.DataFrame(twice, columns=["ord", "concepts"]), 5, bound)
        assert sorted(r.ord for r in cooccurrence.near_duplicate_filter(table(twice), 5, bound).collect()) == want
    assert seen == [len({frozenset(c) for _, c in rows}), len({frozenset(c) for _, c in rows if len(c) > 6})]


def test_communities_from_arrays_are_those_of_the_plain_loop(monkeypatch):
    rng = random.Random(21)
    near: dict = {}
    for _ in range(700):
        u, v = (f"n{rng.randint(0, 50) // rng.choice([1, 1, 5]):02}" for _ in range(2))
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    for seed, randomness in ((0, 0.0), (1, 0.4)):
        got = []
        for dense, many in ((10**9, 0), (0, 10**9), (0, 12)):
            monkeypatch.setattr(communities, "DENSE", dense)
            monkeypatch.setattr(communities, "MANY", many)
            got.append(communities.hierarchy(near, 5, seed, randomness))
        assert got[0] == got[1] == got[2] and {n for _, _, n in got[0]} == set(near)


def test_triples_of_each_run_are_made_once(spark, monkeypatch):
    rng = random.Random(22)
    e = spark.createDataFrame(sorted({(f"n{a}", f"n{b}", "r") for a, b in ((rng.randint(0, 30), rng.randint(31, 60)) for _ in range(90))}), "u string, v string, relation string")
    seen, plain = [], graph.community_triples
    monkeypatch.setattr(graph, "community_triples", lambda m, e: seen.append(m.select("run").distinct().count()) or plain(m, e))
    assert communities.repeat_until(e, 10**6, 5).count() > 0 and len(seen) > 1 and set(seen) == {1}


def test_modularity_from_ends_is_that_from_members(spark):
    rng = random.Random(23)
    rows = sorted({(f"n{a}", f"n{b}") for a, b in ((rng.randint(0, 12), rng.randint(0, 12)) for _ in range(40)) if a <= b})
    of = {f"n{k}": f"c{k % 3}" for k in range(12)}  # one node has no community
    e, m = spark.createDataFrame(rows, "u string, v string"), spark.createDataFrame(list(of.items()), "node string, community string")
    inside = {c: sum(of.get(u) == of.get(v) == c for u, v in rows) for c in of.values()}
    ends = {c: sum((of.get(u) == c) + (of.get(v) == c) for u, v in rows) for c in of.values()}
    want = sum(inside[c] / len(rows) - (ends[c] / 2 / len(rows)) ** 2 for c in ends)
    named = e.join(m.toDF("u", "cu"), "u", "left").join(m.toDF("v", "cv"), "v", "left")
    assert communities.modularity(e, m).first()[0] == pytest.approx(want) == communities.modularity(named).first()[0]


def test_queries_of_a_partition_join_no_edges(spark):
    """The only joins are those of lines with parts and orders; members and both ends took more."""
    from cohortloom.plans import knowledge_queries as kq

    for query, joins in ((kq.community_triples, 2), (kq.distinct_communities, 2), (kq.modularity, 1)):  # modularity's is with one row, after its table of counts
        assert query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Join ") == joins


def test_a_completion_sends_back_no_prompt(spark):
    d = spark.createDataFrame([(1, "a", None), (2, None, [3])], "id long, prompt string, x array<int>")
    got = providers.complete(d, "prompt", lambda p: p + "!", "told", keep_prompt=False)
    assert got.columns == ["id", "x", "told"] and sorted(map(tuple, got.collect())) == [(1, None, "a!"), (2, [3], None)]
    assert sorted(map(tuple, providers.complete(d, "prompt", lambda p: p + "!").collect())) == [(1, "a", None, "a!"), (2, None, [3], None)]
