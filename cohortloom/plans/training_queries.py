"""Queries of prompts, training data and metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import ehr, finetune, prompts, providers
from ..sources import clinical
from ..streaming import ingest



_SEP = "\n# Confidence #\n"


def _rows(spark, d):
    """Labelled documents with their text as context, an invented reasoning and a split by document."""
    x, la = clinical.read(spark, d, "documents"), clinical.read(spark, d, "labels")
    says = F.when(F.col("quality") == 1, "Confident").when(F.col("toxic") == 1, "Very Not Confident").otherwise("Not Confident")
    r = x.join(la, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("context"), F.col("toxic").alias("label"), F.concat(F.lit(prompts.REASONING + "because of "), "source", F.lit(_SEP), says).alias("reasoning"), F.array("source", "lang").alias("similar"), F.col("lang").alias("knowledge"))
    s = ehr.split(r.select(F.col("id").cast("string").alias("key")), "key")
    return r.join(s, F.col("id").cast("string") == F.col("key")).drop("key")


def _digests(df, *names):
    return df.select("id", *[F.md5(n).alias(n) for n in names])


def training_examples(spark, d):
    r = _rows(spark, d)
    return _digests(r.select("id", *prompts.example_texts("mortality", F.col("context"), F.col("reasoning"), F.col("label"), F.col("similar"), F.col("knowledge"))), "input", "output")


def plain_examples(spark, d):
    r = _rows(spark, d)
    return _digests(r.select("id", *prompts.example_texts("readmission", F.col("context"), F.col("reasoning"), F.col("label"))), "input", "output")


def direct_examples(spark, d):
    r = _rows(spark, d)
    return _digests(r.select("id", *prompts.direct_example("mortality", F.col("context"), F.col("label"))), "input", "output")


def label_first_examples(spark, d):
    return _rows(spark, d).select("id", F.md5(prompts.label_first(F.col("reasoning"), F.col("label"))).alias("output"))


def reasoning_prompts(spark, d):
    r = _rows(spark, d)
    a = prompts.reasoning_prompt("mortality", F.col("context"), F.col("label"), F.array_join("similar", "\n"), F.col("knowledge"))
    return r.select("id", F.md5(a).alias("full"), F.md5(prompts.reasoning_prompt("mortality", F.col("context"), F.col("label"))).alias("plain"), F.md5(prompts.knowledge_prompt("mortality", F.col("context"))).alias("facts"))


def shot_prompts(spark, d):
    r, c = _rows(spark, d), F.col("context")
    return r.select("id", F.md5(prompts.zero_shot("mortality", c)).alias("zero"), F.md5(prompts.zero_shot("mortality", c, F.col("knowledge"))).alias("augmented"), F.md5(prompts.few_shot("mortality", c, F.col("similar"), F.col("knowledge"))).alias("few"))


def confident_rows(spark, d):
    r = prompts.confident(_rows(spark, d))
    return r.select("id", "split", prompts.without_tail(F.col("reasoning")).alias("reasoning"))


def training_files(spark, d):
    out = None
    for name, f in prompts.files(_rows(spark, d)).items():
        f = f.select(F.lit(name).alias("file"), "id", "label")
        out = f if out is None else out.unionByName(f)
    return out


def reference_rows(spark, d):
    """Turns as reference rounds of a conversation's split."""
    t = clinical.read(spark, d, "conversations")
    s = ehr.split(t.select(F.col("conv_id").cast("string").alias("key")), "key")
    return prompts.references(t.join(s, F.col("conv_id").cast("string") == F.col("key")).select("conv_id", F.col("turn").alias("ref_id"), "split"))


def multitask_files(spark, d):
    r = _rows(spark, d)
    x = r.select("id", "split", *prompts.example_texts("mortality", F.col("knowledge"), F.col("reasoning"), F.col("label")))
    out = None
    for name, f in prompts.multitask(x, prompts.TASKS["mortality"], "Answer with the label alone.").items():
        f = f.select(F.lit(name).alias("file"), "id", "input", "output")
        out = f if out is None else out.unionByName(f)
    return out


def numbered_facts(spark, d):
    n = clinical.read(spark, d, "nation")
    facts = n.agg(F.array_sort(F.collect_list("n_name")).alias("k"))
    return clinical.read(spark, d, "region").crossJoin(facts).select("r_regionkey", prompts.numbered(F.col("k")).alias("facts"))


def predictor_rounds(spark, d):
    """Not SQL: the stub provider's answers."""
    r = _rows(spark, d).select("id", prompts.zero_shot("mortality", F.col("context")).alias("prompt"), "label")
    return prompts.predictor_rounds(r)


def consolidated_feedback(spark, d):
    """Not SQL: the stub provider's answers."""
    return prompts.consolidate(clinical.read(spark, d, "documents").select("source", F.md5("text").alias("t")), "source", "t")


_TEXTS = {
    "few_shot": "\n# Prediction #  \n", "dialogue": "\n# Prediction # \n", "last": "\n# Prediction #\n",
}


def parsed_labels(spark, d):
    """Answers with each kind of marker, and without one where a document is of low quality."""
    x = clinical.read(spark, d, "documents").join(clinical.read(spark, d, "labels"), "doc_id")
    t = lambda m: F.when(F.col("quality") == 1, F.concat("source", F.lit(m), F.col("toxic").cast("string"), F.lit(" for sure"))).otherwise(F.col("source"))
    direct = F.when(F.col("quality") == 1, F.col("toxic").cast("string")).otherwise(F.col("source"))
    return x.select("doc_id", metrics.label_few_shot(t(_TEXTS["few_shot"])).alias("few_shot"), metrics.label_dialogue(t(_TEXTS["dialogue"])).alias("dialogue"), metrics.label_last(t(_TEXTS["last"])).alias("last"), metrics.label_direct(direct, F.col("toxic").cast("string")).alias("direct"))


def sensitivity_specificity(spark, d):
    r = clinical.read(spark, d, "labels").select(F.col("toxic").alias("y"), F.col("quality").alias("p"))
    m = metrics.rates(r)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


def multiclass_metrics(spark, d):
    o = clinical.read(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("y"), (F.col("o_orderkey") % 5 + 1).cast("string").alias("p"))
    m = metrics.multiclass(o)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


def binary_metrics(spark, d):
    r = clinical.read(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.col("l_quantity") / 50).alias("s"))
    m = metrics.binary(r)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


def run_summary(spark, d):
    m = metrics.over_runs(clinical.read(spark, d, "events"), "value", "event_type")
    return m.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def best_step(spark, d):
    return metrics.best(clinical.read(spark, d, "events"), "event_id", "value")


def chat_texts(spark, d):
    """Conversations with a system turn, as text for training and for generation."""
    c = finetune.conversations(clinical.read(spark, d, "conversations"))
    m = finetune.with_system(F.col("messages"))
    return c.select("conv_id", F.md5(finetune.render(m)).alias("sft"), F.md5(finetune.render(m, True)).alias("generation"), finetune.well_formed(F.col("messages")).alias("well_formed"))


def preference_texts(spark, d):
    """The conversation's last turn against one that begins otherwise."""
    c = finetune.conversations(clinical.read(spark, d, "conversations"))
    other = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit("No. "), m["content"]).alias("content")))
    x = c.select("conv_id", *finetune.preference(F.col("messages"), other))
    return x.select("conv_id", *[F.md5(n).alias(n) for n in ("prompt", "chosen_text", "rejected_text")])


def chat_examples(spark, d):
    x = clinical.read(spark, d, "documents").select("doc_id", F.col("source").alias("input"), F.col("lang").alias("output"))
    return finetune.chat_examples(x).select("doc_id", F.to_json("messages").alias("messages"), finetune.seeded_order(F.col("doc_id")).alias("place"))


def dataset_mix(spark, d):
    x, c = clinical.read(spark, d, "documents"), clinical.read(spark, d, "conversations")
    a, b = x.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), "source"), c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("kind"), F.lit("chat").alias("source"))
    return finetune.mix([(a, 0.25), (b, 1.0)], "id", ["kind"])


def substring_decontamination(spark, d):
    return finetune.drop_contaminated(clinical.read(spark, d, "documents"), "doc_id", "text", clinical.read(spark, d, "benchmark"), "text").select("doc_id", "source")


def docstrings(spark, d):
    x = clinical.read(spark, d, "documents")
    return x.select("doc_id", finetune.docstring(F.concat(F.lit('def f():\n    """ '), "source", F.lit(' """\n'), "lang")).alias("docstring"))


def column_values(spark, d):
    c = clinical.read(spark, d, "customer")
    return finetune.column_values(c.select(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("s")), "s").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark, d):
    """An extension: hourly counts, the same plan that a stream of events has."""
    return ingest.windowed_counts(clinical.read(spark, d, "events"))


def provider_answers(spark, d):
    """Not SQL: the stub provider's answers."""
    return providers.complete(clinical.read(spark, d, "nation").select("n_name"), "n_name")


def multilabel_metrics(spark, d):
    """Labels' marks against marks guessed from the number."""
    k = F.col("doc_id")
    mark = lambda c, m: F.when(c, F.array(F.lit(m))).otherwise(F.array().cast("array<string>"))
    x = clinical.read(spark, d, "labels").select(F.concat(mark(F.col("quality") == 1, "good"), mark(F.col("toxic") == 1, "toxic")).alias("y"), F.concat(mark(k % 3 > 0, "good"), mark(k % 7 == 0, "toxic"), mark(k % 11 == 0, "odd")).alias("p"))
    m = metrics.multilabel(x)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


_fns = (multilabel_metrics, training_examples, plain_examples, direct_examples, label_first_examples, reasoning_prompts, shot_prompts, confident_rows, training_files, reference_rows, multitask_files, numbered_facts, predictor_rounds, consolidated_feedback, parsed_labels, sensitivity_specificity, multiclass_metrics, binary_metrics, run_summary, best_step, chat_texts, preference_texts, chat_examples, dataset_mix, substring_decontamination, docstrings, column_values, event_windows, provider_answers)
QUERIES = {f.__name__: f for f in _fns}


def _q(s):
    """A text as SQL."""
    return "('" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


def _section(title, body):
    return f"{_q(f'# {title} #' + chr(10))} || coalesce({body}, '') || {_q(chr(10) * 2)}"


_M, _R = prompts.TASKS["mortality"], prompts.TASKS["readmission"]
_SPLIT = "k AS (SELECT id, row_number() OVER (ORDER BY md5('528:' || id), CAST(id AS VARCHAR)) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT {0} AS id FROM {1}) q), sp AS (SELECT id, CASE WHEN rank < floor(n * 0.8::DOUBLE) THEN 'train' WHEN rank < floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM k)"
_ROWS = f"""rw0 AS (SELECT doc_id AS id, text AS context, toxic AS label, {_q(prompts.REASONING + 'because of ')} || source || {_q(_SEP)} || CASE WHEN quality = 1 THEN 'Confident' WHEN toxic = 1 THEN 'Very Not Confident' ELSE 'Not Confident' END AS reasoning, source, lang FROM documents JOIN labels USING (doc_id)),
{_SPLIT.format('id', 'rw0')}, rw AS (SELECT * FROM rw0 JOIN sp USING (id))"""
_SIM = "list_sort([source, lang])"
_PATIENT = _section("Patient", "context")
_OUT = f"{_q(prompts.REASONING)} || reasoning || {_q(prompts.PREDICTION)} || label"
_ZERO = lambda more="": f"{_q(_M + chr(10) + 'Write your reasoning, then the label under # Prediction #.' + chr(10) * 2)} || {_PATIENT}{more}"
_TAIL = f"replace(split_part(reasoning, {_q(_SEP)}, 1), {_q(prompts.REASONING)}, '')"
_MT = f"mt AS (SELECT id, split, {_q(_M + chr(10) * 2)} || {_section('Patient', 'lang')} AS input, {_OUT} AS output FROM rw)"
_LABELROW = f"replace(input, {_q(_M)}, 'Answer with the label alone.') AS input, right(output, 1) AS output"
_PARSE = lambda m: f"CASE WHEN quality = 1 THEN source || {_q(m)} || toxic || ' for sure' ELSE source END"
_FIRST = lambda m: f"CASE WHEN contains({_PARSE(m)}, {_q(m)}) THEN substr(split_part({_PARSE(m)}, {_q(m)}, 2), 1, 1) ELSE '0' END"
_CLS = """c AS (SELECT substr(o_orderpriority, 1, 1) AS t, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS p FROM orders),
cl AS (SELECT cls, count(*) FILTER (t = cls AND p = cls) AS tp, count(*) FILTER (t <> cls AND p = cls) AS fp, count(*) FILTER (t = cls AND p <> cls) AS fn, count(*) FILTER (t = cls) AS s FROM c, (SELECT t AS cls FROM c UNION SELECT p FROM c) k GROUP BY cls)"""
_MSG = "list(struct_pack(role := role, content := text) ORDER BY turn, role, text) AS m"
_TURN = "'<|' || role || '|>' || chr(10) || {0} || '</s>' || chr(10)"
_CHAT = f"ch AS (SELECT conv_id, string_agg({_TURN.format('text')}, '' ORDER BY turn, role, text) AS t, arg_min(role, (turn, role, text)) AS first, bool_and(role IS NOT NULL AND text IS NOT NULL) AS ok FROM conversations GROUP BY 1), cs AS (SELECT *, CASE WHEN first = 'system' THEN t ELSE '<|system|>' || chr(10) || '</s>' || chr(10) || t END AS s FROM ch)"
_NO = "('No. ' || text)"
_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
ORACLE_SQL = {
    "training_examples": f"WITH {_ROWS} SELECT id, md5({_q(_M + chr(10) * 2)} || {_PATIENT} || {_section('Similar Patients', f'array_to_string({_SIM}, chr(10))')} || {_section('Knowledge', 'lang')}) AS input, md5({_OUT}) AS output FROM rw",
    "plain_examples": f"WITH {_ROWS} SELECT id, md5({_q(_R + chr(10) * 2)} || {_PATIENT}) AS input, md5({_OUT}) AS output FROM rw",
    "direct_examples": f"WITH {_ROWS} SELECT id, md5({_q(_M + chr(10) * 2)} || {_PATIENT}) AS input, md5(CAST(label AS VARCHAR)) AS output FROM rw",
    "label_first_examples": f"WITH {_ROWS} SELECT id, md5(repeat(label || chr(10), 8) || reasoning) AS output FROM rw",
    "reasoning_prompts": f"WITH {_ROWS}, p AS (SELECT *, {_q('Explain step by step why the answer is right.' + chr(10) + _M + chr(10) * 2)} || {_PATIENT} AS a, {_section('Answer', 'CAST(label AS VARCHAR)')} || 'End with how confident you are under # Confidence #.' AS z FROM rw) SELECT id, md5(a || {_section('Similar Patients', 'source || chr(10) || lang')} || {_section('Knowledge', 'lang')} || z) AS \"full\", md5(a || z) AS plain, md5({_q('List ten facts that help to decide.' + chr(10) + _M + chr(10) * 2)} || {_PATIENT}) AS facts FROM p",
    "shot_prompts": f"WITH {_ROWS} SELECT id, md5({_ZERO()}) AS zero, md5({_ZERO(' || ' + _section('Support', 'lang'))}) AS augmented, md5({_section('Examples', 'source || chr(10) || lang')} || {_ZERO(' || ' + _section('Support', 'lang'))}) AS few FROM rw",
    "confident_rows": f"WITH {_ROWS} SELECT id, split, {_TAIL} AS reasoning FROM rw WHERE NOT (split IN ('train', 'val') AND contains(reasoning, {_q(_SEP + 'Not Confident')}))",
    "training_files": f"WITH {_ROWS} SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS file, id, label FROM rw UNION ALL SELECT 'val', id, label FROM rw WHERE split = 'val'",
    "reference_rows": f"WITH {_SPLIT.format('conv_id', 'conversations')} SELECT conv_id, turn AS ref_id, split FROM conversations JOIN sp ON id = conv_id WHERE split = 'train' OR turn = 0",
    "multitask_files": f"WITH {_ROWS}, {_MT} SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS file, id, {_LABELROW} FROM mt UNION ALL SELECT 'train', id, input, output FROM mt WHERE split <> 'test'",
    "numbered_facts": "SELECT r_regionkey, f AS facts FROM region, (SELECT string_agg(i || '. ' || n_name, chr(10) ORDER BY i) AS f FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) q WHERE i <= 10) z",
    "parsed_labels": f"SELECT doc_id, {_FIRST(_TEXTS['few_shot'])} AS few_shot, {_FIRST(_TEXTS['dialogue'])} AS dialogue, {_FIRST(_TEXTS['last'])} AS \"last\", CASE WHEN quality = 1 THEN CAST(toxic AS VARCHAR) ELSE CAST(1 - toxic AS VARCHAR) END AS direct FROM documents JOIN labels USING (doc_id)",
    "sensitivity_specificity": "SELECT round(count(*) FILTER (toxic = 1 AND quality = 1) / nullif(count(*) FILTER (toxic = 1), 0), 9) AS sensitivity, round(count(*) FILTER (toxic = 0 AND quality = 0) / nullif(count(*) FILTER (toxic = 0), 0), 9) AS specificity FROM labels",
    "multiclass_metrics": f"WITH {_CLS}, f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN NULL ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM cl) SELECT round(sum(tp) / sum(s), 9) AS accuracy, round(avg(coalesce(f1, 1)), 9) AS f1_macro, round(sum(coalesce(f1, 0) * s) / sum(s), 9) AS f1_weighted, round(sum(coalesce(tp / nullif(tp + fp, 0), 0) * s) / sum(s), 9) AS precision_weighted, round(sum(coalesce(tp / nullif(s, 0), 0) * s) / sum(s), 9) AS recall_weighted FROM f",
    "binary_metrics": """WITH r AS (SELECT CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS y, l_quantity / 50 AS s FROM lineitem), c AS (SELECT s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM r GROUP BY s),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM c WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
cu AS (SELECT sum(pos / pa * tp / (tp + fp)) AS pr, sum(neg / na * (tp - pos / 2) / pa) AS roc FROM k),
m AS (SELECT sum(y * h)::DOUBLE AS tp, sum((1 - y) * h)::DOUBLE AS fp, sum(y * (1 - h))::DOUBLE AS fn, sum((1 - y) * (1 - h))::DOUBLE AS tn FROM (SELECT y, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS h FROM r) q),
x AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / pow(tp + fp + fn + tn, 2) AS pe FROM m)
SELECT round(pr, 9) AS pr_auc, round(roc, 9) AS roc_auc, round(po, 9) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS f1_macro, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round((po - pe) / (1 - pe), 9) AS cohen_kappa, round(tp / (tp + fp + fn), 9) AS jaccard FROM x, cu""",
    "run_summary": "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1",
    "best_step": "SELECT arg_min(event_id, (-value, event_id)) AS best_step, max(value) AS best_value FROM events",
    "chat_texts": f"WITH {_CHAT} SELECT conv_id, md5(s) AS sft, md5(s || '<|assistant|>' || chr(10)) AS generation, ok AS well_formed FROM cs",
    "preference_texts": f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS i FROM conversations) SELECT conv_id, md5(coalesce(string_agg({_TURN.format('text')}, '' ORDER BY i DESC) FILTER (i > 1), '')) AS prompt, md5(max({_TURN.format('text')}) FILTER (i = 1)) AS chosen_text, md5(max({_TURN.format(_NO)}) FILTER (i = 1)) AS rejected_text FROM o GROUP BY 1",
    "chat_examples": "SELECT doc_id, '[{\"role\":\"user\",\"content\":\"' || source || '\"},{\"role\":\"assistant\",\"content\":\"' || lang || '\"}]' AS messages, md5('42:' || doc_id) AS place FROM documents",
    "dataset_mix": "WITH a AS (SELECT doc_id AS id, lang AS kind, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents), u AS (SELECT id, kind FROM a WHERE i <= floor(0.25::DOUBLE * n) UNION ALL SELECT conv_id * 1000 + turn, role FROM conversations) SELECT id, kind, md5('42:' || id || '|' || kind) AS shuffle_key FROM u",
    "substring_decontamination": f"WITH b AS (SELECT DISTINCT {_NORM.format('text')} AS b FROM benchmark) SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b <> '' AND contains({_NORM.format('d.text')}, b))",
    "multilabel_metrics": """WITH x AS (SELECT list_concat(CASE WHEN quality = 1 THEN ['good'] ELSE [] END, CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END) AS y,
  list_concat(list_concat(CASE WHEN doc_id % 3 > 0 THEN ['good'] ELSE [] END, CASE WHEN doc_id % 7 = 0 THEN ['toxic'] ELSE [] END), CASE WHEN doc_id % 11 = 0 THEN ['odd'] ELSE [] END) AS p FROM labels),
r AS (SELECT y, p, len(y) AS a, len(p) AS b, len(list_intersect(y, p)) AS k FROM x),
f AS (SELECT 2.0::DOUBLE * count(*) FILTER (list_contains(y, l) AND list_contains(p, l)) / (count(*) FILTER (list_contains(y, l)) + count(*) FILTER (list_contains(p, l))) AS f1 FROM x, (SELECT unnest(['good', 'toxic', 'odd']) AS l) GROUP BY l)
SELECT round(avg((k = a AND k = b)::INT), 9) AS accuracy, round(avg(CASE WHEN a + b > 0 THEN k / (a + b - k)::DOUBLE ELSE 0 END), 9) AS jaccard_samples, round(avg(CASE WHEN a + b > 0 THEN 2 * k / (a + b)::DOUBLE ELSE 0 END), 9) AS f1_samples,
  round(2 * sum(k)::DOUBLE / sum(a + b), 9) AS f1_micro, round((SELECT avg(f1) FROM f), 9) AS f1_macro FROM r""",
    "docstrings": "SELECT doc_id, source AS docstring FROM documents",
    "column_values": "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
