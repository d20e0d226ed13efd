"""Registered queries: answers, cards, traces and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cohort, rules, traces
from .queries import _CASE, _RISKY, _cases, query, t

_words = "', '".join(rules.COMPARISON_WORDS)


def _when(k: int, c: str = "conv_id") -> F.Column:
    return F.when(F.col(c) % k == 0, F.col(c).cast("string"))


# --- routing ---------------------------------------------------------------------------

_ASKED = " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in rules.COMPARISON_WORDS)


@query(f"SELECT conv_id, turn, CASE WHEN intent <> 'DASHBOARD_QA' AND conv_id % 6 = 0 AND asked THEN 'PATIENT_ANALYSIS' ELSE intent END AS intent FROM (SELECT conv_id, turn, {_RISKY} AS intent, {_ASKED} AS asked FROM (SELECT conv_id, turn, role, text || CASE WHEN turn % 2 = 0 THEN ' pred why' ELSE ' pred' END AS text FROM conversations))")
def intent_in_context(spark, d):
    rows = t(spark, d, "conversations").withColumn("text", F.concat("text", F.when(F.col("turn") % 2 == 0, " pred why").otherwise(" pred")))
    routed = rules.intent(F.col("text"), F.col("role"))
    return rows.select("conv_id", "turn", rules.intent_in_context(routed, F.col("text"), _when(2), _when(3)).alias("intent"))


@query("SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')) || CASE WHEN turn % 3 = 0 THEN ' a vs b' ELSE '' END, '对比|比较|差异|compare|difference| vs ') AS compares, contains(upper(coalesce(text, '')), upper(role)) AS completed FROM conversations")
def question_signals(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " a vs b").otherwise(""))
    return t(spark, d, "conversations").select("conv_id", "turn", rules.comparison_question(text).alias("compares"), rules.completed(F.col("text"), F.col("role")).alias("completed"))


# --- answers ---------------------------------------------------------------------------


@query("""SELECT conv_id, turn, md5(concat_ws(chr(10), nullif(text, ''), nullif(role, ''), concat_ws(chr(10), 'note', role, text), 'next', '{"turn":' || CAST(turn AS VARCHAR) || '}')) AS digest FROM conversations""")
def answer_flattened(spark, d):
    cards = F.array(F.struct(F.lit("note").alias("type"), F.col("role").alias("title"), F.col("text").alias("content")))
    flat = rules.flattened(F.col("text"), F.col("role"), cards, F.array(F.lit("next")), F.struct("turn"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.md5(flat).alias("digest"))


_META = "CASE WHEN conv_id % 2 = 0 THEN ' s' || CAST(conv_id AS VARCHAR) END AS sample, CASE WHEN conv_id % 3 = 0 THEN 'mild' WHEN conv_id % 3 = 1 THEN ' ' END AS deviation, CASE WHEN turn % 2 = 0 THEN 'top ' || role END AS top1"
_INTENT = "CASE conv_id % 3 WHEN 0 THEN 'DASHBOARD_QA' WHEN 1 THEN 'PREDICTION_ASSISTANT' ELSE 'PATIENT_ANALYSIS' END"


def _answers(spark, d):
    """Conversations as answers: intent and metadata by key, so that every rule has rows."""
    intent = F.when(F.col("conv_id") % 3 == 0, "DASHBOARD_QA").when(F.col("conv_id") % 3 == 1, "PREDICTION_ASSISTANT").otherwise("PATIENT_ANALYSIS")
    sample = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" s"), F.col("conv_id").cast("string")))
    deviation = F.when(F.col("conv_id") % 3 == 0, "mild").when(F.col("conv_id") % 3 == 1, " ")
    rows = t(spark, d, "conversations").withColumns({"intent": intent, "sample": sample, "deviation": deviation, "top1": F.when(F.col("turn") % 2 == 0, F.concat(F.lit("top "), "role"))})
    meta = {"sampleId": F.col("sample"), "healthyDeviationLabel": F.col("deviation"), "predictionTop1Label": F.col("top1"), "predictionTop1Probability": F.col("turn"), "totalPatients": F.col("conv_id"), "topDisease": F.col("role"), "topDiseases": F.array(F.lit(" a "), F.lit(" "), F.col("role")), "deviationTopTaxa": F.array("role", F.lit("x"))}
    return rows, meta


_DASH = "CAST(conv_id AS VARCHAR) || '；' || role || '；a、' || role"
_KNOWN = "CASE WHEN turn % 3 = 0 THEN role || '、two' ELSE 'no internal knowledge' END"
_SEEN = "CASE WHEN turn % 4 = 0 THEN 'page @ ' || role || '、bare' ELSE 'no external evidence' END"


@query(f"""WITH a AS (SELECT *, {_INTENT} AS intent, {_META} FROM conversations), p AS (SELECT *, nullif(trim(coalesce(sample, '')), '') AS sm, nullif(trim(coalesce(deviation, '')), '') AS dv FROM a)
SELECT conv_id, turn, CASE intent WHEN 'DASHBOARD_QA' THEN 'dashboard_observation=' || {_DASH} || chr(10) || 'internal_knowledge=' || {_KNOWN} || chr(10) || 'external_evidence=' || {_SEEN}
 WHEN 'PREDICTION_ASSISTANT' THEN 'prediction_result=' || concat_ws('；', top1, CAST(turn AS VARCHAR)) || chr(10) || 'model_boundary=' || {_KNOWN} || chr(10) || 'external_evidence=' || {_SEEN}
 ELSE 'data_observation=' || coalesce(sm, 'none') || chr(10) || 'healthy_reference=' || coalesce(dv, 'none') || chr(10) || 'model_judgement=' || coalesce(top1, 'none') || chr(10) || 'internal_knowledge=' || {_KNOWN} || chr(10) || 'external_evidence=' || {_SEEN} END AS layers FROM p""")
def answer_layers(spark, d):
    rows, meta = _answers(spark, d)
    null = F.lit(None).cast("string")
    known = F.when(F.col("turn") % 3 == 0, F.array("role", null, F.lit("two"), F.lit("three")))
    page = lambda title, domain: F.struct(title.alias("title"), domain.alias("domain"))
    seen = F.when(F.col("turn") % 4 == 0, F.array(page(F.lit("page"), F.col("role")), page(null, F.lit("z")), page(F.lit("bare"), null), page(F.lit("more"), null)))
    made = rules.layers(F.col("intent"), meta, {"topDiseases", "deviationTopTaxa"}, known, seen)
    return rows.select("conv_id", "turn", F.array_join(F.transform(made, lambda x: F.concat_ws("=", x["key"], x["summary"])), "\n").alias("layers"))


@query(f"""WITH a AS (SELECT *, {_INTENT} AS intent, {_META} FROM conversations)
SELECT conv_id, turn, CASE intent WHEN 'DASHBOARD_QA' THEN 'overview: ' || CAST(conv_id AS VARCHAR) || ' samples, mostly ' || role || ', from --' WHEN 'PREDICTION_ASSISTANT' THEN 'prediction: ' || coalesce(top1, '--') || ' (' || CAST(turn AS VARCHAR) || '%), then --'
 ELSE 'sample ' || coalesce(trim(sample), '--') || ': ' || coalesce(nullif(trim(deviation), ''), 'to be added') || ', model says ' || coalesce(top1, '--') || ' (consistency open); deviating taxa: ' || role || '、x' END AS summary FROM a""")
def answer_summary(spark, d):
    rows, meta = _answers(spark, d)
    return rows.select("conv_id", "turn", rules.polished_summary(F.col("intent"), meta, {"topDiseases", "deviationTopTaxa"}).alias("summary"))


@query("""WITH a AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'from literature' WHEN 2 THEN 'layered: knowledge base' ELSE role END AS s, turn % 2 = 0 AS k, turn % 3 = 0 AS m, conv_id % 2 = 0 AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(s) = '' THEN CASE WHEN k AND m AND w THEN 'knowledge, medical and web evidence added' WHEN k AND m THEN 'knowledge and medical evidence added' WHEN k THEN 'knowledge evidence added' WHEN m THEN 'medical evidence added' WHEN w THEN 'web evidence added' ELSE 'no evidence found' END
 ELSE s || CASE WHEN k AND NOT contains(s, 'knowledge base') THEN ' knowledge evidence added.' ELSE '' END || CASE WHEN m AND NOT contains(s, 'literature') THEN ' medical evidence added.' ELSE '' END || CASE WHEN w THEN ' web evidence added.' ELSE '' END END AS summary,
 CASE WHEN trim(s) = '' THEN 'layered answer' WHEN contains(s, 'layered') THEN s ELSE s || ' (layered answer)' END AS layered FROM a""")
def evidence_suffixes(spark, d):
    k = F.col("conv_id") % 4
    s = F.when(k == 0, " ").when(k == 1, "from literature").when(k == 2, "layered: knowledge base").otherwise(F.col("role"))
    put = rules.evidence_suffixes(s, F.col("turn") % 2 == 0, F.col("turn") % 3 == 0, F.col("conv_id") % 2 == 0)
    return t(spark, d, "conversations").select("conv_id", "turn", put.alias("summary"), rules.layered_summary(s).alias("layered"))


def _cards():
    card = lambda kind, title, content: F.struct(kind.alias("type"), title.alias("title"), content.alias("content"))
    text = F.coalesce("text", F.lit(""))
    return F.array(
        card(F.lit("Summary "), F.lit("one"), text), card(F.lit("multi_agent"), F.lit("noise"), F.lit("x")), card(F.lit("summary"), F.lit("one"), F.lit("again")), card(F.lit("prediction_link"), F.lit("p"), F.lit("Fo.c")),
        card(F.lit("web_evidence"), F.lit("w"), text), card(F.lit("patient_difference"), F.lit("d"), F.lit("dd")), card(F.lit("empty"), F.lit(None).cast("string"), F.lit("untitled")), card(F.lit("blank"), F.lit("b"), F.lit(" ")),
    )


_TIDY = "trim(replace(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 'Fo.', ''))"


@query(f"""WITH a AS (SELECT doc_id, {_TIDY} AS x FROM documents), b AS (SELECT *, CASE WHEN x = '' THEN 'summary:again' ELSE 'summary:' || CASE WHEN length(x) > 520 THEN x[1:520] || '...' ELSE x END END AS s FROM a)
SELECT doc_id, md5(concat_ws('|', CASE WHEN x <> '' THEN 'web_evidence:' || x END, s, 'prediction_link:c', 'patient_difference:dd')) AS kept, CASE WHEN x = '' THEN 'patient_difference,prediction_link,summary,empty' ELSE 'patient_difference,prediction_link,summary,web_evidence,empty' END AS page FROM b""")
def cards_shown(spark, d):
    kept = F.array_join(F.transform(rules.kept_cards(_cards()), lambda c: F.concat_ws(":", c["type"], c["content"])), "|")
    page = F.array_join(F.transform(rules.page_cards(_cards()), lambda c: c["type"]), ",")
    return t(spark, d, "documents").select("doc_id", F.md5(kept).alias("kept"), page.alias("page"))


@query("SELECT conv_id, turn, role || ',next,more' AS actions FROM conversations")
def actions_shown(spark, d):
    actions = F.array("role", F.lit(" "), F.lit("ask the Agent"), F.col("role"), F.lit(" next  "), F.lit("more"), F.lit("last"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(rules.page_actions(actions), ",").alias("actions"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'g' || CAST(label AS VARCHAR) ELSE 'L' || CAST(label AS VARCHAR) END AS top1, round(CASE WHEN vec_id % 5 = 0 THEN 0 ELSE vec_id / 4.0::DOUBLE END, 6) AS top1_probability, CASE WHEN vec_id % 2 = 0 THEN 'other' ELSE 'none' END AS top2, CASE WHEN vec_id % 2 = 0 THEN 12.5::DOUBLE ELSE 0 END AS top2_probability FROM embeddings")
def prediction_insight(spark, d):
    one = lambda label, group, p: F.struct(label.alias("label"), group.alias("group"), p.alias("probability"))
    name = F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("L"), F.col("label").cast("string"))).otherwise(" ")
    first = one(name, F.concat(F.lit("g"), F.col("label").cast("string")), F.when(F.col("vec_id") % 5 == 0, "much").otherwise((F.col("vec_id") / 4.0).cast("string")))
    second = one(F.lit("other"), F.lit(None).cast("string"), F.lit(" 12.5 "))
    s = rules.prediction_insight(F.when(F.col("vec_id") % 2 == 0, F.array(first, second)).otherwise(F.array(first)))
    return t(spark, d, "embeddings").select("vec_id", s["top1"].alias("top1"), F.round(s["top1_probability"], 6).alias("top1_probability"), s["top2"].alias("top2"), s["top2_probability"].alias("top2_probability"))


@query("SELECT conv_id, turn, trim(coalesce(text, '')) <> '' OR turn % 2 = 0 AS present, CASE WHEN trim(role) = '' THEN 1 ELSE 2 END AS n_values, CASE WHEN trim(role) = '' THEN 'b' ELSE role || ',b' END AS first_values FROM conversations")
def payload_present(spark, d):
    features = F.when(F.col("turn") % 2 == 0, F.array(F.lit(1)))
    values = cohort.insight(F.array(F.col("role"), F.lit(" "), F.lit(None).cast("string"), F.lit("b")))
    return t(spark, d, "conversations").select("conv_id", "turn", cohort.payload_present(F.col("text"), features).alias("present"), values["n"].alias("n_values"), F.array_join(values["first"], ",").alias("first_values"))


# --- traces ----------------------------------------------------------------------------

_STEPS = "[" + ", ".join(f"'{s}'" for s in rules.CORE_STEPS) + "]"
_FLAGS = ("task_packet", "execution_policy", "evidence_policy", "review", "harness_runtime_flag", "hybrid_mode", "multi_agent_mode", "evidence_channels")
_RUNS = f"""WITH s AS (SELECT conv_id, list_distinct(list(({_STEPS})[turn % 9 + 1]) FILTER (turn % 9 < 7)) AS steps, count(*) FILTER (turn % 2 = 0) AS tools, count(*) FILTER (turn % 5 = 4) AS prompts FROM conversations GROUP BY 1),
i AS (SELECT *, CASE WHEN conv_id % 8 = 0 THEN ['missing_trace'] ELSE list_concat(list_transform(list_filter({_STEPS}, lambda x: NOT list_contains(coalesce(steps, []), x)), lambda x: 'missing_step:' || x), list_filter([
 CASE WHEN conv_id % 3 = 0 THEN 'missing_review' END, CASE WHEN conv_id % 2 = 0 THEN 'missing_hybrid_mode' END, CASE WHEN conv_id % 4 > 1 THEN 'prediction_layer_not_used' END, CASE WHEN conv_id % 5 = 0 THEN 'knowledge_layer_not_used' END,
 CASE WHEN tools < 2 THEN 'missing_mcp_usage:tools' END, CASE WHEN prompts < 1 THEN 'missing_mcp_usage:prompts' END, CASE WHEN NOT list_contains(coalesce(steps, []), 'workflow') THEN 'missing_mcp_step:workflow' END, CASE WHEN conv_id % 8 <> 0 THEN 'missing_mcp_step:never' END], lambda x: x IS NOT NULL)) END AS issues FROM s)"""


def _runs(spark, d):
    """Traces from the conversations: a turn is a step; steps are distinct names, so a trace's array is bounded."""
    step = F.get(F.array(*[F.lit(x) for x in rules.CORE_STEPS]), (F.col("turn") % 9).cast("int"))
    n = F.col("turn") % 9
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(n < 7, step)).alias("steps"), F.count_if(F.col("turn") % 2 == 0).alias("tools"), F.count_if(F.col("turn") % 5 == 4).alias("prompts"))
    key, words = F.col("conv_id"), lambda *x: F.array(*[F.lit(w) for w in x])
    flags = {name: F.lit(True) for name in _FLAGS} | {"review": key % 3 != 0, "hybrid_mode": key % 2 != 0}
    routed = F.when(key % 4 > 1, "PATIENT_ANALYSIS").otherwise("DASHBOARD_QA")
    trace = F.when(key % 8 != 0, F.col("steps"))
    issues = rules.trace_issues(trace, flags, routed, F.lit(False), key % 5 != 0)
    used = F.create_map(F.lit("tools"), F.col("tools"), F.lit("prompts"), F.col("prompts"))
    expected = F.create_map(F.lit("tools"), F.lit(2), F.lit("prompts"), F.lit(1))
    more = F.concat(rules.usage_issues(expected, used), rules.step_issues(words("workflow", "never"), F.col("steps")))
    return rows.withColumn("issues", F.when(trace.isNull(), issues).otherwise(F.concat(issues, more)))


@query(_RUNS + " SELECT conv_id, array_to_string(list_sort(issues), ',') AS issues FROM i")
def trace_issues(spark, d):
    return _runs(spark, d).select("conv_id", F.array_join(F.array_sort("issues"), ",").alias("issues"))


@query(_RUNS + """ SELECT conv_id, CASE WHEN list_contains(issues, 'missing_trace') THEN 'P0' WHEN len(list_filter(issues, lambda x: x LIKE 'missing_step:%' OR x LIKE 'missing_mcp_%' OR x LIKE '%_layer_not_used')) > 0 THEN 'P1' WHEN len(issues) > 0 THEN 'P2' ELSE 'PASS' END AS severity,
 CASE WHEN list_contains(issues, 'missing_trace') OR list_contains(issues, 'missing_review') THEN 'harness-runtime' WHEN len(list_filter(issues, lambda x: x LIKE 'missing_step:%')) > 0 THEN 'workflow-orchestration' WHEN list_contains(issues, 'prediction_layer_not_used') THEN 'prediction-pipeline' WHEN list_contains(issues, 'knowledge_layer_not_used') THEN 'knowledge-rag' WHEN len(list_filter(issues, lambda x: x LIKE 'missing_mcp_%')) > 0 THEN 'mcp-connector' WHEN list_contains(issues, 'missing_hybrid_mode') THEN 'agent-orchestration' ELSE 'manual-review' END AS primary_layer FROM i""")
def trace_severity(spark, d):
    none, error = F.array().cast("array<string>"), F.lit(None).cast("string")
    layers = rules.fix_layers(error, none, none, none, F.col("issues"))
    return _runs(spark, d).select("conv_id", rules.severity(error, none, none, none, F.col("issues")).alias("severity"), F.get(layers, F.lit(0)).alias("primary_layer"))


@query("""WITH r AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS risk, turn % 2 = 0 AS k, turn % 3 = 0 AS w, conv_id % 3 = 0 AS p, turn % 5 AS res FROM conversations)
SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT k THEN 'internal_knowledge' END, CASE WHEN NOT p AND risk = 'medium' THEN 'model_judgement' END) AS missing, coalesce(risk = 'HIGH', false) AND NOT (k AND p) AS human_review,
 CASE WHEN k AND p AND w AND res > 0 THEN 'all_layers' WHEN k AND p THEN 'data_model_knowledge' WHEN k THEN 'knowledge_only' ELSE 'workflow_only' END AS hint FROM r""")
def run_review(spark, d):
    key = F.col("conv_id") % 4
    risk = F.when(key == 0, "HIGH").when(key == 1, "medium").when(key == 2, "low")
    usage = F.create_map(F.lit("resources"), F.col("turn") % 5, F.lit("prompts"), F.col("turn") * 0 + 1)
    r = rules.review(risk, F.col("turn") % 2 == 0, F.col("turn") % 3 == 0, F.col("conv_id") % 3 == 0, usage)
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(r["missing_channels"], ",").alias("missing"), r["human_review"].alias("human_review"), r["hint"].alias("hint"))


_TURNS = """WITH w AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS words FROM conversations),
c AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS tools, count(*) FILTER (role = 'user') AS resources, count(*) FILTER (role = 'system') AS prompts, sum(words) AS words,
 coalesce(max(words) FILTER (role = 'assistant'), 0) >= 100 AS k, count(*) FILTER (contains(text, chr(10))) > 0 AS web, count(*) FILTER (role = 'user') >= 2 AS p FROM w GROUP BY 1)"""


def _reviewed(spark, d):
    """Conversations as finished runs, all by what their turns hold: long answers are knowledge, lines are pages, a second question is a prediction; risk goes by words."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+"), lambda x: x != ""))
    of = lambda role: F.coalesce(F.col("role") == role, F.lit(False))
    rows = t(spark, d, "conversations").withColumn("words", words).groupBy("conv_id").agg(
        F.count_if(of("assistant")).alias("tools"), F.count_if(of("user")).alias("resources"), F.count_if(of("system")).alias("prompts"), F.sum("words").alias("words"),
        (F.coalesce(F.max(F.when(of("assistant"), F.col("words"))), F.lit(0)) >= 100).alias("knowledge"), (F.count_if(F.contains("text", F.lit("\n"))) > 0).alias("web"),
    )
    risk = F.when(F.col("words") >= 400, "high").when(F.col("words") >= 100, "Medium").otherwise("low")
    usage = F.create_map(*[x for n in ("tools", "resources", "prompts") for x in (F.lit(n), F.col(n))])
    return rows, rules.review(risk, F.col("knowledge"), F.col("web"), F.col("resources") >= 2, usage, F.col("prompts") > 0, F.col("tools") > F.col("resources"))


@query(_TURNS + """ SELECT conv_id, concat_ws(',', CASE WHEN k THEN 'knowledge' END, CASE WHEN web THEN 'web' END, CASE WHEN p THEN 'prediction' END, CASE WHEN prompts > 0 THEN 'hybrid' END, CASE WHEN tools > resources THEN 'agents' END, CASE WHEN tools > 0 THEN 'tools' END, CASE WHEN resources > 0 THEN 'resources' END, CASE WHEN prompts > 0 THEN 'prompts' END) AS used,
 concat_ws(',', CASE WHEN NOT k THEN 'internal_knowledge' END, CASE WHEN NOT p AND words BETWEEN 100 AND 399 THEN 'model_judgement' END) AS missing, words >= 400 AND NOT (k AND p) AS human_review,
 CASE WHEN k AND p AND web AND resources > 0 AND prompts > 0 THEN 'all_layers' WHEN k AND p THEN 'data_model_knowledge' WHEN k THEN 'knowledge_only' ELSE 'workflow_only' END AS hint FROM c""")
def conversation_review(spark, d):
    """Every flag of a run's review, over whole conversations."""
    rows, r = _reviewed(spark, d)
    kinds = ("knowledge", "web", "prediction", "hybrid", "agents", "tools", "resources", "prompts")
    used = F.array_join(F.array_compact(F.array(*[F.when(r[f"used_{x}"], x) for x in kinds])), ",")
    return rows.select("conv_id", used.alias("used"), F.array_join(r["missing_channels"], ",").alias("missing"), r["human_review"].alias("human_review"), r["hint"].alias("hint"))


@query(_TURNS + """, r AS (SELECT *, CASE WHEN words >= 400 THEN 'PREDICTION_ASSISTANT' WHEN words >= 100 THEN 'DASHBOARD_QA' ELSE 'PATIENT_ANALYSIS' END AS intent FROM c)
SELECT conv_id, CASE WHEN k THEN CAST(tools AS VARCHAR) || ' answers (layered answer)' ELSE 'layered answer' END AS summary,
 'hybrid_orchestration|' || CASE intent WHEN 'PREDICTION_ASSISTANT' THEN 'layered prediction analysis' WHEN 'DASHBOARD_QA' THEN 'layered dashboard analysis' ELSE 'layered patient analysis' END || '|combined: ' || concat_ws('、', 'data', CASE WHEN p THEN 'model' END, CASE WHEN k THEN 'knowledge' END, CASE WHEN web THEN 'external' END) || '; layers: ' || CASE WHEN intent = 'PATIENT_ANALYSIS' THEN '5' ELSE '3' END
  || CASE WHEN prompts > 0 THEN chr(10) || 'note|prompts|' || CAST(prompts AS VARCHAR) ELSE '' END AS cards,
 CASE WHEN web THEN 'tell_data_from_evidence,view_layers' ELSE 'view_layers,tell_data_from_evidence' END AS actions,
 CASE intent WHEN 'PREDICTION_ASSISTANT' THEN 'prediction=' || CAST(words AS VARCHAR) || chr(10) || 'limits of the model=' WHEN 'DASHBOARD_QA' THEN 'dashboard=' || CAST(words AS VARCHAR) || chr(10) || 'knowledge='
  ELSE 'data=' || CAST(words AS VARCHAR) || chr(10) || 'healthy reference=none' || chr(10) || 'model=none' || chr(10) || 'knowledge=' END || CASE WHEN k THEN 'long answer' ELSE 'no internal knowledge' END || chr(10) || 'external evidence=' || CASE WHEN web THEN 'lines' ELSE 'no external evidence' END AS layers FROM r""")
def answer_composed(spark, d):
    """Layered answers of whole conversations: titles, the card in front, the actions behind."""
    rows, r = _reviewed(spark, d)
    routed = F.when(F.col("words") >= 400, "PREDICTION_ASSISTANT").when(F.col("words") >= 100, "DASHBOARD_QA").otherwise("PATIENT_ANALYSIS")
    number, none = F.col("words").cast("string"), F.lit(None).cast("string")
    meta = {"sampleId": number, "totalPatients": number, "predictionTop1Label": F.when(F.col("words") >= 400, number)}
    page = F.array(F.struct(F.lit("lines").alias("title"), none.alias("domain")))
    layered = rules.layers(routed, meta, set(), F.when(r["used_knowledge"], F.array(F.lit("long answer"))), F.when(r["used_web"], page))
    channels = rules.evidence_channels(r["used_prediction"], r["used_knowledge"], r["used_web"])
    note = F.array(F.struct(F.lit("note").alias("type"), F.lit("prompts").alias("title"), F.col("prompts").cast("string").alias("content")))
    summary = F.when(r["used_knowledge"], F.concat(F.col("tools").cast("string"), F.lit(" answers")))
    made = rules.composed(routed, layered, channels, summary, F.when(r["used_prompts"], note), F.when(r["used_web"], F.array(F.lit("tell_data_from_evidence"))))
    line = lambda sep, *names: lambda x: F.concat_ws(sep, *[x[n] for n in names])
    return rows.select("conv_id", made["summary"].alias("summary"), F.array_join(F.transform(made["cards"], line("|", "type", "title", "content")), "\n").alias("cards"), F.array_join(made["actions"], ",").alias("actions"), F.array_join(F.transform(made["layers"], line("=", "title", "summary")), "\n").alias("layers"))


@query("SELECT conv_id, turn, 'data' || CASE WHEN turn % 2 = 0 THEN ',model' ELSE '' END || CASE WHEN turn % 3 = 0 THEN ',knowledge' ELSE '' END || CASE WHEN conv_id % 2 = 0 THEN ',external' ELSE '' END AS channels FROM conversations")
def channels_used(spark, d):
    c = rules.evidence_channels(F.col("turn") % 2 == 0, F.col("turn") % 3 == 0, F.col("conv_id") % 2 == 0)
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(c, ",").alias("channels"))


@query(_CASE + ", n AS (SELECT lang AS suite, severity, count(*) AS n FROM v GROUP BY 1, 2 UNION ALL SELECT 'all', severity, count(*) FROM v GROUP BY 2) SELECT suite, string_agg(severity || '=' || CAST(n AS VARCHAR), ',' ORDER BY severity) AS counts FROM n GROUP BY 1")
def suite_report(spark, d):
    counted = traces.counters_map(traces.suite_counters(_cases(spark, d), "lang", "severity"))
    return counted.select("suite", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 60 ELSE 30 END AS timeout FROM events WHERE lower(event_type) = 'click'")
def registry_lookup(spark, d):
    rows = t(spark, d, "events").withColumn("timeout", F.when(F.col("event_id") % 3 != 0, 30))
    return traces.registry_get(rows, "event_type", "CLICK", "timeout").select("event_id", "user_id", "timeout")


@query("SELECT conv_id, '1:a,2:b,' || CASE WHEN turn > 2 THEN CAST(turn AS VARCHAR) || ':' || role ELSE '9:z' END AS steps FROM conversations WHERE role = 'user'")
def flow_steps(spark, d):
    step = lambda n, name: F.struct(n.cast("long").alias("sequence"), name.alias("name"))
    last = F.when(F.col("turn") > 2, step(F.col("turn"), F.col("role"))).otherwise(step(F.lit(9), F.lit("z")))
    rows = t(spark, d, "conversations").select("conv_id", F.col("role").alias("intent"), F.array(last, step(F.lit(2), F.lit("b")), step(F.lit(1), F.lit("a"))).alias("steps"))
    return traces.ordered_steps(rows, "user").select("conv_id", F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["sequence"].cast("string"), s["name"])), ",").alias("steps"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE event_type END AS kind, CAST(user_id AS VARCHAR) AS session FROM events")
def settings_merged(spark, d):
    base = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("session"), F.col("user_id").cast("string"))
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("kind"), F.lit("new")))
    m = traces.merged_maps(base, over)
    return t(spark, d, "events").select("event_id", m["kind"].alias("kind"), m["session"].alias("session"))
