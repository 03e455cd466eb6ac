"""Sample-construction queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ehr
from ..sources import clinical

_KEY = ["visit_id", "patient_id", "label"]
_V = clinical.SQL_VIEWS
_OK = "len(conditions) * len(procedures) * len(drugs) > 0"


def _joined(*names):
    return [F.array_join(c, "|").alias(c) for c in names]


def flagship_cohort_summary(spark, d):
    s = ehr.readmission(clinical.visit_lists(spark, d))
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("n_patients"), F.sum(F.size("drugs")).alias("n_drugs"))


def mortality_labels(spark, d):
    return ehr.next_visit_mortality(clinical.visit_lists(spark, d)).select(*_KEY, *_joined(*ehr.LISTS))


def readmission_labels(spark, d):
    return ehr.readmission(clinical.visit_lists(spark, d)).select(*_KEY, *_joined(*ehr.LISTS))


def readmission_events_1d(spark, d):
    """Sub-day times: events as visits, window of one day."""
    e = clinical.read(spark, d, "events")
    one = lambda c: F.array(F.col(c).cast("string"))
    v = e.select(F.col("user_id").cast("string").alias("patient_id"), F.col("event_id").cast("string").alias("visit_id"), F.col("event_id").alias("visit_key"), F.col("ts").alias("visit_ts"), one("event_type").alias("conditions"), one("value").alias("procedures"), one("props").alias("drugs"))
    return ehr.readmission(v, 1).select(*_KEY)


def los_buckets(spark, d):
    return ehr.length_of_stay(clinical.visit_lists(spark, d)).select(*_KEY)


def drugrec_history(spark, d):
    h = ehr.drug_history(clinical.visit_lists(spark, d))
    flat = [F.array_join(F.transform(f"hist_{c}", lambda x: F.array_join(x, "|")), ";").alias(f"hist_{c}") for c in ehr.LISTS]
    return h.select("visit_id", "patient_id", F.array_join("drugs", "|").alias("drugs"), *flat)


def drugrec_history_cut(spark, d):
    h = ehr.drug_history(clinical.visit_lists(spark, d), code_length=1, least_visits=2)
    return h.select("visit_id", "patient_id", F.array_join("drugs", "|").alias("drugs"), F.array_join(F.flatten("hist_drugs"), "|").alias("hist_drugs"))




def cohort_mortality(spark, d):
    return ehr.onset_mortality(clinical.visit_lists(spark, d), ["PROMO"]).select(*_KEY)


def cohort_onset(spark, d):
    return ehr.onset(clinical.visit_lists(spark, d), ["PROMO"]).select(*_KEY)


def cumulative_history(spark, d):
    h = ehr.cumulative(clinical.visit_lists(spark, d), ("conditions", "procedures"))
    return h.select("visit_id", "patient_id", *[F.size(F.flatten(f"hist_{c}")).alias(f"n_{c}") for c in ("conditions", "procedures")])


def _samples(spark, d):
    v = ehr.retained(clinical.visit_lists(spark, d))
    return v.withColumn("label", F.when(F.col("discharge_status") == 1, 1).otherwise(0))


def rolling_docs(spark, d):
    return ehr.rolling_docs(_samples(spark, d)).select("sample_id", "visit_idx", "label", *_joined(*ehr.LISTS))


def code_names(spark, d):
    """Drug codes of each visit as names, in order."""
    v = clinical.visit_lists(spark, d).filter(ehr.complete())
    p = clinical.read(spark, d, "part")
    names = p.select(F.col("p_size").cast("string").alias("code")).distinct().withColumn("name", F.lower(F.concat(F.lit("DRUG "), "code")))
    return ehr.map_names(v, ["visit_id"], "drugs", names).select("visit_id", F.array_join("names", "|").alias("names"))


def _ordered(spark, d):
    s = _samples(spark, d)
    return s.select("patient_id", F.concat_ws("_", "patient_id", "sample_idx").alias("sample_id"), "sample_idx", "label", F.struct("patient_key", "sample_idx").alias("ord"))


def balanced_cohort(spark, d):
    return ehr.balanced_cohort(_ordered(spark, d))


def cohort_samples(spark, d):
    s = _ordered(spark, d)
    return ehr.restrict(s, ehr.balanced_cohort(s)).select("patient_id", "sample_id", "label")


def patient_split(spark, d):
    return ehr.split(clinical.visits(spark, d), "patient_id")


def patient_split_reduced(spark, d):
    return ehr.split(clinical.visits(spark, d), "patient_id", train_ratio=0.5)


def visit_split(spark, d):
    return ehr.split(clinical.visits(spark, d), "visit_id", seed=7)


def split_samples(spark, d):
    """Samples routed to their patient's split."""
    s = _ordered(spark, d).select("patient_id", "sample_id", "label")
    return s.join(ehr.split(clinical.visits(spark, d), "patient_id"), "patient_id")


_NEXT = f"""n AS (SELECT *, lead(visit_id) OVER w AS next_id, lead(visit_ts) OVER w AS next_ts, lead(discharge_status) OVER w AS next_status FROM x WINDOW w AS (PARTITION BY patient_id ORDER BY visit_ts, visit_key))"""
_LISTS = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ehr.LISTS)
_READ = f"WITH {_V}, {_NEXT}, s AS (SELECT *, CASE WHEN floor(epoch_us(next_ts)::DOUBLE / 86400000000 - epoch_us(visit_ts)::DOUBLE / 86400000000) < 15 THEN 1 ELSE 0 END AS label FROM n WHERE next_id IS NOT NULL AND {_OK})"
_RET = f"r AS (SELECT *, (row_number() OVER (PARTITION BY patient_id ORDER BY visit_ts, visit_key) - 1)::INT AS sample_idx, CASE WHEN discharge_status = 1 THEN 1 ELSE 0 END AS label FROM x WHERE {_OK})"


def _los(expr):
    return f"CASE WHEN {expr} < 1 THEN 0 WHEN {expr} <= 7 THEN {expr} WHEN {expr} <= 14 THEN 8 ELSE 9 END"


_COH = f"""{_RET}, o AS (SELECT patient_key, patient_id, patient_id || '_' || sample_idx AS sample_id, sample_idx, label FROM r),
ok AS (SELECT *, row_number() OVER (PARTITION BY patient_id, label ORDER BY sample_idx) AS i FROM o WHERE sample_idx + 1 <= 9),
pos AS (SELECT * FROM ok WHERE label = 1 AND i = 1 ORDER BY patient_key, sample_idx LIMIT 5000),
neg AS (SELECT *, row_number() OVER (ORDER BY patient_key, sample_idx) AS k FROM ok WHERE label = 0 AND i = 1 AND patient_id NOT IN (SELECT patient_id FROM pos)),
coh AS (SELECT patient_id, sample_id, label FROM pos UNION ALL SELECT patient_id, sample_id, label FROM neg WHERE k <= 10000 - (SELECT count(*) FROM pos))"""


def _split(column, seed, train=1.0):
    return f"""d AS (SELECT DISTINCT {column} AS id FROM v), k AS (SELECT id, row_number() OVER (ORDER BY md5('{seed}:' || id), id) - 1 AS rank, count(*) OVER () AS n FROM d),
sp AS (SELECT id AS {column}, CASE WHEN rank < floor(floor(n * 0.8::DOUBLE) * {train}::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.8::DOUBLE) THEN NULL WHEN rank < floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM k)"""


QUERIES = {f.__name__: f for f in (flagship_cohort_summary, mortality_labels, readmission_labels, readmission_events_1d, los_buckets, drugrec_history, drugrec_history_cut, cohort_mortality, cohort_onset, cumulative_history, rolling_docs, code_names, balanced_cohort, cohort_samples, patient_split, patient_split_reduced, visit_split, split_samples)}
_STR = lambda c: f"array_to_string([array_to_string(y, '|') FOR y IN {c}], ';')"
_HIST = lambda c: f"list({c}) OVER (PARTITION BY patient_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING)"
_DAY = "CAST(floor((epoch_us(discharge_ts)::DOUBLE - epoch_us(visit_ts)::DOUBLE) / 86400000000) AS INT)"
ORACLE_SQL = {
    "flagship_cohort_summary": f"{_READ} SELECT label, count(*) AS n, count(DISTINCT patient_id) AS n_patients, sum(len(drugs))::BIGINT AS n_drugs FROM s GROUP BY label",
    "mortality_labels": f"WITH {_V}, {_NEXT} SELECT visit_id, patient_id, CASE WHEN next_status = 1 THEN 1 ELSE 0 END AS label, {_LISTS} FROM n WHERE next_id IS NOT NULL AND {_OK}",
    "readmission_labels": f"{_READ} SELECT visit_id, patient_id, label, {_LISTS} FROM s",
    "readmission_events_1d": "WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events) SELECT CAST(event_id AS VARCHAR) AS visit_id, CAST(user_id AS VARCHAR) AS patient_id, CASE WHEN date_sub('day', ts, nt) < 1 THEN 1 ELSE 0 END AS label FROM n WHERE nt IS NOT NULL",
    "los_buckets": f"WITH {_V} SELECT visit_id, patient_id, {_los(_DAY)} AS label FROM x WHERE {_OK}",
    "drugrec_history": f"WITH {_V}, {_RET}, h AS (SELECT visit_id, patient_id, drugs, {', '.join(_HIST(c) + ' AS h_' + c for c in ehr.LISTS)} FROM r) SELECT visit_id, patient_id, array_to_string(drugs, '|') AS drugs, {', '.join(_STR('h_' + c) + ' AS hist_' + c for c in ehr.LISTS)} FROM h",
    "drugrec_history_cut": f"WITH {_V}, {_RET}, c AS (SELECT * REPLACE ([substr(y, 1, 1) FOR y IN drugs] AS drugs), count(*) OVER (PARTITION BY patient_id) AS k FROM r), h AS (SELECT visit_id, patient_id, drugs, {_HIST('drugs')} AS hd, k FROM c) SELECT visit_id, patient_id, array_to_string(drugs, '|') AS drugs, array_to_string(flatten(hd), '|') AS hist_drugs FROM h WHERE k >= 2",
    "cohort_mortality": f"WITH {_V}, {_NEXT}, f AS (SELECT *, bool_or(list_contains(conditions, 'PROMO')) OVER (PARTITION BY patient_id) AS ever, row_number() OVER (PARTITION BY patient_id ORDER BY visit_ts, visit_key) AS i FROM n) SELECT visit_id, patient_id, CASE WHEN next_status = 1 THEN 1 ELSE 0 END AS label FROM f WHERE ever AND next_id IS NOT NULL AND {_OK} UNION ALL SELECT 'None', patient_id, 1000 FROM f WHERE NOT ever AND i = 1",
    "cohort_onset": f"WITH {_V}, i AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY visit_ts, visit_key) - 1 AS idx, count(*) OVER (PARTITION BY patient_id) AS n FROM x), o AS (SELECT *, min(idx) FILTER (list_contains(conditions, 'PROMO')) OVER (PARTITION BY patient_id) AS onset FROM i) SELECT visit_id, patient_id, CASE WHEN onset IS NULL THEN 0 ELSE 1 END AS label FROM o WHERE idx < onset OR (onset IS NULL AND idx < least(5, n - 1) AND {_OK})",
    "cumulative_history": f"WITH {_V}, {_RET} SELECT visit_id, patient_id, sum(len(conditions)) OVER w::INT AS n_conditions, sum(len(procedures)) OVER w::INT AS n_procedures FROM r WINDOW w AS (PARTITION BY patient_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING)",
    "rolling_docs": f"WITH {_V}, {_RET} SELECT a.patient_id || '_' || a.sample_idx AS sample_id, b.sample_idx AS visit_idx, a.label, {', '.join(f'array_to_string(b.{c}, chr(124)) AS {c}' for c in ehr.LISTS)} FROM r a JOIN r b ON a.patient_id = b.patient_id AND b.sample_idx <= a.sample_idx",
    "code_names": f"WITH {_V} SELECT visit_id, array_to_string(['drug ' || y FOR y IN drugs], '|') AS names FROM x WHERE {_OK}",
    "balanced_cohort": f"WITH {_V}, {_COH} SELECT * FROM coh",
    "cohort_samples": f"WITH {_V}, {_COH} SELECT patient_id, sample_id, label FROM o WHERE patient_id IN (SELECT patient_id FROM coh)",
    "patient_split": f"WITH {_V}, {_split('patient_id', 528)} SELECT * FROM sp",
    "patient_split_reduced": f"WITH {_V}, {_split('patient_id', 528, 0.5)} SELECT * FROM sp WHERE split IS NOT NULL",
    "visit_split": f"WITH {_V}, {_split('visit_id', 7)} SELECT * FROM sp",
    "split_samples": f"WITH {_V}, {_RET}, {_split('patient_id', 528)} SELECT patient_id, patient_id || '_' || sample_idx AS sample_id, label, split FROM r JOIN sp USING (patient_id)",
}
