"""Rule classifiers as column expressions: the first rule that holds wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: Words (and pages) that route a question, in order.
INTENTS = (
    ("PREDICTION_ASSISTANT", ("预测", "pred", "risk", "概率"), "prediction"),
    ("DASHBOARD_QA", ("首页", "总览", "趋势", "dashboard", "疾病分布"), "index"),
    ("PATIENT_ANALYSIS", ("患者", "样本", "菌", "丰度", "patient", "sample"), "patient"),
)
DEFAULT_INTENT = "PATIENT_ANALYSIS"
#: Words of comparison that keep a question with its patient.
COMPARISON_WORDS = ("为什么", "为何", "差异", "区别", "偏离", "偏差", "一致", "是否一致", "和健康", "健康组", "why", "difference", "deviation", "consistent", "consistency")
#: Words that raise a question's risk.
RISK_WORDS = ("诊断", "确诊", "治疗", "用药", "处方", "干预", "手术")
#: Words that ask for outside evidence.
EVIDENCE_WORDS = ("为什么", "机制", "文献", "资料", "研究", "证据", "指南", "最新", "官网", "联网", "搜索", "latest", "evidence", "guideline", "literature", "search")
#: Steps that every trace has, and issues by severity.
CORE_STEPS = ("context_merged", "intent_resolved", "task_packet_created", "workflow", "knowledge_augmentation", "hybrid_orchestration", "multi_agent_orchestration")
P0_ISSUES = ("missing_trace", "missing_task_packet", "missing_execution_policy", "missing_evidence_policy")
P1_PREFIXES = ("missing_step:", "missing_mcp_usage:", "missing_mcp_step:")
P1_ISSUES = ("prediction_layer_not_used", "knowledge_layer_not_used")


def intent(question: Column, page: Column) -> Column:
    out: Column | None = None
    for name, words, where in INTENTS:
        holds = T.contains_any(question, words) | F.contains(F.lower(F.coalesce(page, F.lit(""))), F.lit(where))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(DEFAULT_INTENT)


def intent_in_context(routed: Column, question: Column, patient_id: Column, sample_id: Column) -> Column:
    """A comparison asked about a patient's sample stays with that patient."""
    asked = T.present(patient_id) & T.present(sample_id) & T.contains_any(question, COMPARISON_WORDS)
    return F.when((routed != "DASHBOARD_QA") & asked, DEFAULT_INTENT).otherwise(routed)


def risk_level(question: Column, routed: Column, patient_id: Column, sample_id: Column) -> Column:
    return F.when(T.contains_any(question, RISK_WORDS), "high").when((routed == "PREDICTION_ASSISTANT") | T.present(patient_id) | T.present(sample_id), "medium").otherwise("low")


def available_tools(routed: Column, patient_id: Column, sample_id: Column) -> Column:
    """Tools in order; those of patients need a patient, those of samples both."""
    names = lambda *x: F.array(*[F.lit(n) for n in x])
    common = names("search_knowledge", "search_web_evidence", "mcp_resources", "mcp_prompts")
    patient, sample = T.present(patient_id), T.present(patient_id) & T.present(sample_id)
    own = F.when(sample, names("get_patient_summary", "get_sample_top_features", "get_healthy_reference", "run_prediction")).when(patient, names("get_patient_summary")).otherwise(F.array().cast("array<string>"))
    return F.when(routed == "DASHBOARD_QA", F.concat(names("get_dashboard_summary"), common)).otherwise(F.concat(own, common))


def policies(question: Column, routed: Column, tools: Column, sample_id: Column, risk: Column) -> Column:
    """Execution and evidence flags as one struct; flags that are always set are left out."""
    return F.struct(
        T.contains_any(question, EVIDENCE_WORDS).alias("allow_external_evidence"),
        (F.array_contains(tools, "run_prediction") & (routed != "DASHBOARD_QA")).alias("allow_prediction"),
        T.present(sample_id).alias("require_single_sample"),
        routed.isin("PATIENT_ANALYSIS", "PREDICTION_ASSISTANT").alias("require_model_boundary"),
        risk.alias("risk_level"),
    )


def hits(expected: Column, text: Column) -> Column:
    return F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda w: F.contains(text, w))


def missing(expected: Column, text: Column) -> Column:
    return F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda w: ~F.contains(text, w))


def flattened(summary: Column, routed: Column, cards: Column, actions: Column, metadata: Column) -> Column:
    """A nested response as one text, in reading order."""
    card = F.flatten(F.transform(cards, lambda c: F.array(c["type"], c["title"], c["content"])))
    return F.concat_ws("\n", F.when(summary != "", summary), F.when(routed != "", routed), F.array_join(card, "\n"), F.array_join(actions, "\n"), F.to_json(metadata))


def trace_issues(steps: Column, flags: dict[str, Column], routed: Column, used_prediction: Column, used_knowledge: Column) -> Column:
    """Missing core steps, missing objects (flags: name -> whether it is there) and unused layers. A null array is a missing trace."""
    names = F.coalesce(steps, F.array().cast("array<string>"))
    core = F.array(*[F.lit(s) for s in CORE_STEPS])
    gone = F.transform(F.filter(core, lambda s: ~F.array_contains(names, s)), lambda s: F.concat(F.lit("missing_step:"), s))
    rest = [F.when(~F.coalesce(there, F.lit(False)), f"missing_{name}") for name, there in flags.items()]
    rest.append(F.when(routed.isin("PATIENT_ANALYSIS", "PREDICTION_ASSISTANT") & ~F.coalesce(used_prediction, F.lit(False)), "prediction_layer_not_used"))
    rest.append(F.when(~F.coalesce(used_knowledge, F.lit(False)), "knowledge_layer_not_used"))
    return F.when(steps.isNull(), F.array(F.lit("missing_trace"))).otherwise(F.concat(gone, F.array_compact(F.array(*rest))))


def usage_issues(expected: Column, used: Column) -> Column:
    """Channels that were used less than expected; both are maps of counts."""
    short = F.filter(F.map_entries(expected), lambda e: F.coalesce(F.try_element_at(used, e["key"]), F.lit(0)) < e["value"])
    return F.transform(short, lambda e: F.concat(F.lit("missing_mcp_usage:"), e["key"]))


def step_issues(expected: Column, steps: Column) -> Column:
    """Steps of a plan that the trace doesn't have."""
    return F.transform(F.filter(expected, lambda s: ~F.array_contains(steps, s)), lambda s: F.concat(F.lit("missing_mcp_step:"), s))


def severity(error: Column, forbidden: Column, missing_must: Column, missing_should: Column, issues: Column) -> Column:
    begins = lambda i: F.greatest(*[F.startswith(i, F.lit(p)) for p in P1_PREFIXES])
    return (
        F.when(T.present(error) | (F.size(forbidden) > 0) | F.exists(issues, lambda i: i.isin(*P0_ISSUES)), "P0")
        .when((F.size(missing_must) > 0) | F.exists(issues, begins) | F.exists(issues, lambda i: i.isin(*P1_ISSUES)), "P1")
        .when((F.size(missing_should) > 0) | (F.size(issues) > 0), "P2").otherwise("PASS")
    )


def fix_layers(error: Column, forbidden: Column, missing_must: Column, missing_should: Column, issues: Column) -> Column:
    """Layers to look at, most basic first; the first is the primary one."""
    has = lambda *names: F.exists(issues, lambda i: i.isin(*names))
    starts = lambda p: F.exists(issues, lambda i: F.startswith(i, F.lit(p)))
    rules = (
        (T.present(error) | has("request_failed"), ("runtime-ops", "connectivity")),
        (has(*P0_ISSUES, "missing_review"), ("harness-runtime",)),
        (starts("missing_step:"), ("workflow-orchestration",)),
        (has("prediction_layer_not_used"), ("prediction-pipeline", "workflow-orchestration")),
        (has("knowledge_layer_not_used"), ("knowledge-rag",)),
        (starts("missing_mcp_usage:") | starts("missing_mcp_step:"), ("mcp-connector",)),
        (has("missing_hybrid_mode", "missing_multi_agent_mode"), ("agent-orchestration",)),
        (F.size(forbidden) > 0, ("prompt-policy", "review-loop")),
        (F.size(missing_must) > 0, ("response-synthesis",)),
        ((F.size(missing_should) > 0) & (F.size(missing_must) == 0), ("prompt-tuning",)),
    )
    none = F.array().cast("array<string>")
    layers = F.array_distinct(F.concat(*[F.when(holds, F.array(*[F.lit(n) for n in names])).otherwise(none) for holds, names in rules]))
    return F.when(F.size(layers) > 0, layers).otherwise(F.array(F.lit("manual-review")))


def quality_gate(output: Column) -> Column:
    """FAIL before OPTIMIZE or WARN before PASS, wherever they stand."""
    up = F.upper(F.coalesce(output, F.lit("")))
    return F.when(F.contains(up, F.lit("FAIL")), "FAIL").when(F.contains(up, F.lit("OPTIMIZE")) | F.contains(up, F.lit("WARN")), "OPTIMIZE").otherwise("PASS")


def completed(output: Column, signal: Column) -> Column:
    """Whether the output has the completion signal, in any case."""
    return T.present(signal) & F.contains(F.upper(F.coalesce(output, F.lit(""))), F.upper(signal))


def review(risk: Column, knowledge: Column, web: Column, prediction: Column, usage: Column, hybrid: Column | None = None, agents: Column | None = None) -> Column:
    """Flags of a finished run, channels that are missing, and whether a person should look.

    `usage`: map of counts by access type. The model is missed where the risk is medium; a person is asked for where it is
    high and knowledge or model had no part. A null risk means that no task was set. Modes that aren't given, or null, weren't used.
    """
    mode = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    used = lambda kind: F.coalesce(F.try_element_at(usage, F.lit(kind)), F.lit(0)) > 0
    is_risk = lambda level: F.coalesce(F.lower(risk) == level, F.lit(False))
    missing_ = F.array_compact(F.array(F.when(~knowledge, "internal_knowledge"), F.when(~prediction & is_risk("medium"), "model_judgement")))
    hint = F.when(knowledge & prediction & web & used("resources") & used("prompts"), "all_layers").when(knowledge & prediction, "data_model_knowledge").when(knowledge, "knowledge_only").otherwise("workflow_only")
    return F.struct(
        knowledge.alias("used_knowledge"), web.alias("used_web"), prediction.alias("used_prediction"), mode(hybrid).alias("used_hybrid"), mode(agents).alias("used_agents"), used("tools").alias("used_tools"), used("resources").alias("used_resources"), used("prompts").alias("used_prompts"),
        missing_.alias("missing_channels"), (is_risk("high") & ~(knowledge & prediction)).alias("human_review"), hint.alias("hint"),
    )


def evidence_channels(prediction: Column, knowledge: Column, external: Column) -> Column:
    """Channels of an answer; business data always are one."""
    return F.array_compact(F.array(F.lit("data"), F.when(prediction, "model"), F.when(knowledge, "knowledge"), F.when(external, "external")))


#: Layers of an answer by intent (key, fields in order), and the marks that join values and fields.
LAYERS = {
    "DASHBOARD_QA": (("dashboard_observation", ("totalPatients", "topDisease", "topRegion", "topDiseases")), ("internal_knowledge", None), ("external_evidence", None)),
    "PREDICTION_ASSISTANT": (("prediction_result", ("predictionTop1Label", "predictionTop1Probability", "predictionTop2Label", "predictionTop2Probability")), ("model_boundary", None), ("external_evidence", None)),
    "PATIENT_ANALYSIS": (
        ("data_observation", ("sampleId", "currentDominanceLabel", "currentTopTaxa")), ("healthy_reference", ("healthyReferenceScope", "healthyDeviationLabel", "elevatedTaxa", "depletedTaxa")),
        ("model_judgement", ("predictionTop1Label", "predictionTop2Label", "predictionConsistency")), ("internal_knowledge", None), ("external_evidence", None),
    ),
}
BETWEEN_VALUES, BETWEEN_FIELDS = "、", "；"
#: Titles of layers by key, and of the card that says how an answer is layered, by intent.
LAYER_TITLES = {
    "dashboard_observation": "dashboard", "prediction_result": "prediction", "model_boundary": "limits of the model", "data_observation": "data", "healthy_reference": "healthy reference",
    "model_judgement": "model", "internal_knowledge": "knowledge", "external_evidence": "external evidence",
}
LAYERED_TITLES = {"DASHBOARD_QA": "layered dashboard analysis", "PREDICTION_ASSISTANT": "layered prediction analysis"}
LAYERED_ACTIONS = ("view_layers", "tell_data_from_evidence")


def field_text(meta: dict[str, Column], arrays: set[str], name: str) -> Column:
    """A field of the metadata as text: trimmed, lists joined without blanks, empty if it isn't there."""
    c = meta.get(name, F.lit(None).cast("string"))
    if name in arrays:
        return F.array_join(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), T.present), BETWEEN_VALUES)
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def layers(routed: Column, meta: dict[str, Column], arrays: set[str], knowledge: Column, external: Column) -> Column:
    """Array of (key, title, summary) of the intent's layers. `knowledge`: array of titles; `external`: array of (title, domain)."""
    first = lambda parts, none: F.coalesce(F.nullif(F.array_join(F.slice(F.filter(parts, lambda x: x.isNotNull()), 1, 2), BETWEEN_VALUES), F.lit("")), F.lit(none))
    known = first(F.coalesce(knowledge, F.array().cast("array<string>")), "no internal knowledge")
    seen = first(F.transform(F.coalesce(external, F.array().cast("array<struct<title:string,domain:string>>")), lambda e: F.when(e["domain"].isNotNull(), F.concat(e["title"], F.lit(" @ "), e["domain"])).otherwise(e["title"])), "no external evidence")
    out: Column | None = None
    for name, parts in LAYERS.items():
        made = []
        for key, fields in parts:
            joined = F.array_join(F.filter(F.array(*[field_text(meta, arrays, f) for f in fields]), T.present), BETWEEN_FIELDS) if fields else known if key != "external_evidence" else seen
            made.append(F.struct(F.lit(key).alias("key"), F.lit(LAYER_TITLES[key]).alias("title"), F.when(T.present(joined), joined).otherwise("none").alias("summary")))
        out = F.when(routed == name, F.array(*made)) if out is None else out.when(routed == name, F.array(*made))
        last = F.array(*made)
    return out.otherwise(last)


def layered_summary(summary: Column) -> Column:
    """A summary that says that the answer is layered, once."""
    return F.when(T.blank(summary), "layered answer").when(F.contains(summary, F.lit("layered")), summary).otherwise(F.concat(summary, F.lit(" (layered answer)")))


def composed(routed: Column, layered: Column, channels: Column, summary: Column, cards: Column, actions: Column) -> Column:
    """A layered answer: its summary says so, a card with channels and number of layers comes first, two actions follow those that it has, each once.

    Null cards and actions are empty; no channels are business data alone. Cards are (type, title, content).
    """
    title = F.lit("layered patient analysis")
    for name, text in LAYERED_TITLES.items():
        title = F.when(routed == name, text).otherwise(title)
    listed = F.when(F.coalesce(F.size(channels), F.lit(0)) > 0, F.array_join(channels, BETWEEN_VALUES)).otherwise("data")
    content = F.concat(F.lit("combined: "), listed, F.lit("; layers: "), F.size(layered).cast("string"))
    card = F.struct(F.lit("hybrid_orchestration").alias("type"), title.alias("title"), content.alias("content"))
    held = F.coalesce(actions, F.array().cast("array<string>"))
    missing_ = F.filter(F.array(*[F.lit(a) for a in LAYERED_ACTIONS]), lambda a: ~F.coalesce(F.array_contains(held, a), F.lit(False)))
    return F.struct(
        layered_summary(summary).alias("summary"), F.concat(F.array(card), F.coalesce(cards, F.array().cast("array<struct<type:string,title:string,content:string>>"))).alias("cards"),
        F.concat(held, missing_).alias("actions"), layered.alias("layers"), channels.alias("channels"),
    )


def polished_summary(routed: Column, meta: dict[str, Column], arrays: set[str] = frozenset()) -> Column:
    """The summary of an intent from its metadata, fields that are blank by their defaults; that of a patient says where it deviates."""
    read = lambda name, default="--": F.coalesce(F.nullif(field_text(meta, arrays, name), F.lit("")), F.lit(default))
    overview = F.concat(F.lit("overview: "), read("totalPatients"), F.lit(" samples, mostly "), read("topDisease"), F.lit(", from "), read("topRegion"))
    prediction = F.concat(F.lit("prediction: "), read("predictionTop1Label"), F.lit(" ("), read("predictionTop1Probability"), F.lit("%), then "), read("predictionTop2Label"))
    patient = F.concat(F.lit("sample "), read("sampleId"), F.lit(": "), read("healthyDeviationLabel", "to be added"), F.lit(", model says "), read("predictionTop1Label"), F.lit(" ("), read("predictionConsistency", "consistency open"), F.lit(")"))
    top, level = (field_text(meta, arrays, x) for x in ("deviationTopTaxa", "spatialDeviationLevel"))
    patient = F.concat(patient, F.when(top != "", F.concat(F.lit("; deviating taxa: "), top)).otherwise(""), F.when(level != "", F.concat(F.lit("; distance: "), level)).otherwise(""))
    return F.when(routed == "DASHBOARD_QA", overview).when(routed == "PREDICTION_ASSISTANT", prediction).otherwise(patient)


def evidence_suffixes(summary: Column, knowledge: Column, medical: Column, web: Column) -> Column:
    """A summary with what evidence was added, unless it names it; a blank one becomes a sentence of its own by what was found."""
    base = F.coalesce(summary, F.lit(""))
    alone = (
        F.when(knowledge & medical & web, "knowledge, medical and web evidence added").when(knowledge & medical, "knowledge and medical evidence added").when(knowledge, "knowledge evidence added")
        .when(medical, "medical evidence added").when(web, "web evidence added").otherwise("no evidence found")
    )
    rules = ((knowledge, ("knowledge base",), " knowledge evidence added."), (medical, ("medical evidence", "literature"), " medical evidence added."), (web, ("external evidence", "web evidence"), " web evidence added."))
    named = lambda words: F.greatest(*[F.contains(base, F.lit(w)) for w in words], F.lit(False))
    return F.when(T.blank(base), alone).otherwise(F.concat(base, *[F.when(holds & ~named(words), text).otherwise("") for holds, words, text in rules]))


#: Types of cards that are never shown, and those that come first.
NOISE_CARDS, FIRST_CARDS = ("multi_agent", "agent_insights", "hybrid_orchestration"), ("medical_evidence", "knowledge_support", "web_evidence")
#: The page's order of cards; others follow as they come.
PAGE_ORDER = ("patient_difference", "healthy_reference", "prediction_link")


def tidy_text(c: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), F.lit("Fo."), F.lit("")))


def shown_cards(cards: Column, rank: Callable[[Column], Column], cut: Callable[[Column, Column], Column], untitled: str, most: int) -> Column:
    """Cards (type, title, content) without noise and blanks, one of each type and title, by `rank`, then as they come."""
    tidy = F.transform(F.coalesce(cards, F.array().cast("array<struct<type:string,title:string,content:string>>")), lambda c: F.struct(F.lower(F.trim(F.coalesce(c["type"], F.lit("")))).alias("type"), tidy_text(F.coalesce(c["title"], F.lit(untitled))).alias("title"), tidy_text(c["content"]).alias("content")))
    good = F.filter(tidy, lambda c: ~c["type"].isin(*NOISE_CARDS) & (c["title"] != "") & (c["content"] != ""))
    key = lambda c: F.concat_ws("|", c["type"], c["title"])
    ranked = F.array_sort(F.transform(good, lambda c, i: F.struct(rank(c["type"]).alias("p"), i.alias("i"), key(c).alias("k"), c["type"].alias("type"), c["title"].alias("title"), cut(c["type"], c["content"]).alias("content"))))
    keys = F.transform(ranked, lambda c: c["k"])
    once = F.filter(ranked, lambda c, i: F.array_position(keys, c["k"]) == i + 1)
    return F.slice(F.transform(once, lambda c: F.struct(c["type"].alias("type"), c["title"].alias("title"), c["content"].alias("content"))), 1, most)


def kept_cards(cards: Column, most: int = 4, longest: int = 520) -> Column:
    """Cards of an answer: evidence first and whole, other texts cut."""
    first = lambda t: t.isin(*FIRST_CARDS)
    return shown_cards(cards, lambda t: F.when(first(t), 0).otherwise(1), lambda t, c: F.when(first(t), c).otherwise(T.cut(c, longest, longest)), "", most)


def page_cards(cards: Column, most: int = 5) -> Column:
    """Cards of the page, in its order."""
    rank = lambda t: F.coalesce(*[F.when(t == n, i) for i, n in enumerate(PAGE_ORDER)], F.lit(99))
    return shown_cards(cards, rank, lambda t, c: c, "analysis", most)


def page_actions(actions: Column, most: int = 3) -> Column:
    """Distinct actions that aren't blank and aren't about agents."""
    tidy = F.transform(F.coalesce(actions, F.array().cast("array<string>")), tidy_text)
    return F.slice(F.array_distinct(F.filter(tidy, lambda a: (a != "") & ~F.contains(F.lower(a), F.lit("agent")))), 1, most)


def staged_fold(steps: Column, first_input: Column) -> Column:
    """Feeds each step's output to the next: struct of the last input, the last answer and the gate.

    `steps`: array of (kind, output); an empty output leaves the input as it is; answers come from assistant and
    coordinator steps, the gate from the last quality step.
    """
    start = F.struct(first_input.alias("rolling"), F.lit(None).cast("string").alias("answer"), F.lit("PASS").alias("gate"))

    def step(acc: Column, s: Column) -> Column:
        out = F.when(T.present(s["output"]), s["output"]).otherwise(acc["rolling"])
        return F.struct(out.alias("rolling"), F.when(s["kind"].isin("assistant", "coordinator"), out).otherwise(acc["answer"]).alias("answer"), F.when(s["kind"] == "quality", quality_gate(out)).otherwise(acc["gate"]).alias("gate"))

    return F.aggregate(steps, start, step)


def comparison_question(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("对比|比较|差异|compare|difference| vs ")


def prediction_insight(predictions: Column) -> Column:
    """Labels (else groups, else a default) and probabilities (text is read, else 0) of the two most probable classes."""
    at = lambda i: F.get(F.coalesce(predictions, F.array().cast("array<struct<label:string,group:string,probability:string>>")), F.lit(i))
    label = lambda i, none: F.coalesce(F.nullif(F.trim(at(i)["label"]), F.lit("")), F.nullif(F.trim(at(i)["group"]), F.lit("")), F.lit(none))
    number = lambda i: F.coalesce(F.trim(at(i)["probability"]).try_cast("double"), F.lit(0.0))
    return F.struct(label(0, "unlabelled").alias("top1"), number(0).alias("top1_probability"), label(1, "none").alias("top2"), number(1).alias("top2_probability"))


def tags_added(tags: Column, when: dict[str, Column]) -> Column:
    """`tags` with those whose condition holds behind them, in the order given, each once. A null condition doesn't hold."""
    none = F.array().cast("array<string>")
    for tag, holds in when.items():
        tags = F.array_union(tags, F.when(holds, F.array(F.lit(tag))).otherwise(none))
    return tags
