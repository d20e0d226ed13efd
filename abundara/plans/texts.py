"""Registered queries: text functions, notes and papers, file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import cohort, retrieval, rules, substrings, traces
from ..sources import files, sinks, tables
from .queries import _HOST, _MATRIX, BM25, CHUNKS, KB_ALL, SUMMARY, TOP, WITH, A, P, _library, _matrix, _top, collapsed, normalised, query, rounded, t

# --- text functions --------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || ':' || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS composite FROM orders")
def composite_key(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.composite(F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))).alias("composite"))


_RAW = "'K__' || p_type || '.p__' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '|c__unclassified' WHEN 1 THEN ';g___' || p_name || '_' ELSE '' END"


def _raw():
    tail = F.when(F.col("p_partkey") % 3 == 0, "|c__unclassified").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(";g___"), "p_name", F.lit("_"))).otherwise("")
    return F.concat(F.lit("K__"), "p_type", F.lit(".p__"), "p_brand", tail)


@query(f"""WITH s AS (SELECT p_partkey, raw, list_filter(list_transform(list_reverse(list_filter(regexp_split_to_array(raw, '[|;.\\s]'), lambda x: x <> '')), lambda x: trim(regexp_replace(regexp_replace(x, '(?i)^[a-z]__+', ''), '^_+|_+$', '', 'g'))), lambda x: x <> '' AND lower(x) NOT IN ('unclassified', 'unknown')) AS names FROM (SELECT p_partkey, {_RAW} AS raw FROM part))
SELECT p_partkey, substring(coalesce(names[1], raw), 1, 20) AS name FROM s""")
def clean_taxon(spark, d):
    return t(spark, d, "part").select("p_partkey", T.clean_taxon_name(_raw()).alias("name"))


@query(WITH + TOP + " SELECT patient_id, sample_id, CAST(rank AS INTEGER) AS rank, regexp_extract(taxon, '[^.]*$') AS label FROM top")
def chart_labels(spark, d):
    return cohort.top_features(A(spark, d), 8).select("patient_id", "sample_id", "rank", T.last_segment(F.col("taxon")).alias("label"))


@query(f"SELECT doc_id, length({normalised('text')}) AS n_chars, md5({normalised('text')}) AS digest FROM documents")
def normalised_text(spark, d):
    c = T.normalise(F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select("doc_id", F.length(c).alias("n_chars"), F.md5(c).alias("digest"))


@query(f"SELECT doc_id, length({collapsed('text')}) AS n_chars, md5({collapsed('text')}) AS digest FROM documents")
def collapsed_text(spark, d):
    c = T.collapse(F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select("doc_id", F.length(c).alias("n_chars"), F.md5(c).alias("digest"))


_FLAT = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length(f) > 260 THEN f[1:260] || '...' ELSE f END AS short, md5(CASE WHEN length(f) > 320 THEN f[1:320] || '...' ELSE f END) AS long_digest FROM (SELECT doc_id, {_FLAT} AS f FROM documents)")
def snippets(spark, d):
    return t(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), 260).alias("short"), F.md5(T.snippet(F.col("text"), 320)).alias("long_digest"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '--' ELSE (CASE WHEN value - 50 >= 0 THEN '+' ELSE '' END) || printf('%.2f', value - 50) END AS signed, printf('%.1f%%', value) AS percent, CASE WHEN event_id % 5 = 0 THEN '--' ELSE CAST(user_id AS VARCHAR) || '-' || CAST(user_id + 9 AS VARCHAR) END AS span FROM (SELECT event_id, user_id, round(value * 2) / 2 + 0.01::DOUBLE AS value FROM events)")
def numbers_as_text(spark, d):
    value = F.round(F.col("value") * 2) / 2 + 0.01
    some = lambda c: F.when(F.col("event_id") % 5 != 0, c)
    return t(spark, d, "events").select("event_id", N.signed_text(some(value - 50)).alias("signed"), N.percent_text(value).alias("percent"), N.range_text(some(F.col("user_id")), F.col("user_id") + 9).alias("span"))


@query("SELECT c_custkey AS cCustkey, c_mktsegment AS cMktsegment FROM customer")
def camel_names(spark, d):
    return tables.camel_case(t(spark, d, "customer").select("c_custkey", "c_mktsegment"))


# --- notes and papers ------------------------------------------------------------------


def _notes(spark, d) -> DataFrame:
    """Markdown notes from the documents: some have a title, some none, some only headings."""
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Note "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise("")
    body = F.concat(head, F.lit("  lead `of` it\n## First part\n\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "#", ""), F.lit("\n### Second  \n# dropped | line\n- "), "lang", F.lit("\n# kept out\n"))
    return t(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.upper("lang"), F.lit("/"))), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("text"))


_BODY = collapsed("replace(coalesce(text, ''), '#', '')")


@query(f"""WITH n AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE upper(lang) || '/' END || CAST(doc_id AS VARCHAR) || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE lower(lang) END AS library,
 CASE WHEN doc_id % 2 = 0 THEN 'Note ' || CAST(doc_id AS VARCHAR) ELSE 'dropped | line' END AS title, {_BODY} AS body, lang FROM documents),
s AS (SELECT path, library, title, 'lead of it' AS content, 1 AS nth FROM n UNION ALL SELECT path, library, 'First part', body, 2 FROM n WHERE body <> '' UNION ALL SELECT path, library, 'dropped | line', lang, CASE WHEN body <> '' THEN 3 ELSE 2 END FROM n)
SELECT path || '#' || CAST(nth AS VARCHAR) AS id, library, title, length(content) AS n_chars, md5(content) AS digest FROM s""")
def kb_sections(spark, d):
    return retrieval.knowledge_sections(_notes(spark, d)).select("id", "library", "title", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Note ' || CAST(doc_id AS VARCHAR) ELSE 'dropped | line' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE lower(lang) END AS library FROM documents")
def library_and_title(spark, d):
    rows = _notes(spark, d).withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long"))
    return rows.select("doc_id", T.document_title(F.col("text"), F.col("path")).alias("title"), T.library_of(F.col("path")).alias("library"))


def _papers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Markdown papers from the documents, and their index."""
    docs = t(spark, d, "documents").withColumn("pmcid", F.col("doc_id").cast("string"))
    text = F.coalesce("text", F.lit(""))
    pmid = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("- PMID: "), (F.col("doc_id") * 7).cast("string"), F.lit("\n"))).otherwise("")
    topic = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    paper = F.concat(F.lit("# Paper "), "pmcid", F.lit("\n\n## Metadata\n"), pmid, F.lit("- Topic: old\n- topic:  "), topic, F.lit("\n- Year: 2020\nno field\n\n## Abstract\n"), text, F.lit("\n## Full Text\n### Body\n"), text, F.lit("\n### Acknowledgements\nthanks to all\n"))
    index = docs.select("pmcid", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 11 != 0).alias("ingested"), F.concat(F.lit("i"), "pmcid").alias("pmid"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("topic"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("http://x/"), "pmcid")).alias("source_url"))
    return docs.select("pmcid", paper.alias("text")), index.filter("pmcid NOT LIKE '%3'")


@query(CHUNKS + """, k AS (SELECT doc_id, max(number) AS k FROM ch GROUP BY 1),
p AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS pmcid, d.doc_id % 10 <> 3 AS listed, lang, source FROM documents d),
c AS (SELECT doc_id, 'A' AS part, number AS no, 'Abstract' AS section, chunk FROM ch UNION ALL SELECT doc_id, 'F', k + number, 'Body', chunk FROM ch JOIN k USING (doc_id))
SELECT pmcid || '-' || part || printf('%03d', CAST(no AS INTEGER)) AS chunk_id, pmcid, 'Paper ' || pmcid AS title, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id * 7 AS VARCHAR) WHEN listed THEN 'i' || pmcid ELSE '' END AS pmid,
 CASE WHEN doc_id % 3 <> 0 THEN lang WHEN listed AND doc_id % 5 <> 0 THEN source ELSE 'unknown' END AS topic, '2020' AS year, section, CASE WHEN listed AND doc_id % 2 = 0 THEN 'http://x/' || pmcid ELSE '' END AS source_url, md5(chunk) AS digest
FROM c JOIN p USING (doc_id) WHERE NOT (listed AND doc_id % 7 <> 0 AND doc_id % 11 = 0)""")
def paper_chunks(spark, d):
    rows = retrieval.paper_chunks(*_papers(spark, d))
    return rows.select("chunk_id", "pmcid", "title", "pmid", "topic", "year", "section", "source_url", F.md5("text").alias("digest"))


@query(BM25 + ", r AS (SELECT hit.*, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hit JOIN documents USING (doc_id) WHERE score > 0 AND lower(lang) = 'en') SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def bm25_search_topic(spark, d):
    return rounded(_top(spark, d, 5, only="EN"), "score")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'summary,evidence,prediction' ELSE 'summary,notes,evidence' END AS types FROM conversations")
def evidence_card_inserted(spark, d):
    card = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("role").alias("title"))
    cards = F.when(F.col("role") == "user", F.array(card("summary"), card("prediction"))).otherwise(F.array(card("summary"), card("notes")))
    put = retrieval.augmented(cards, card("evidence"), F.lit("prediction"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(put, lambda c: c["type"]), ",").alias("types"))


@query(BM25 + ", " + KB_ALL.replace("q AS (", "kq AS (").replace("FROM q CROSS", "FROM kq CROSS") + """, kt AS (SELECT item_id, title, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, library, title, id) AS p FROM s WHERE score > 0 QUALIFY p <= 3),
mt AS (SELECT item_id, 'D' || CAST(doc_id AS VARCHAR) AS title, row_number() OVER (PARTITION BY item_id ORDER BY round(hit.score, 9) DESC, doc_id) AS p FROM hit WHERE hit.score > 0 QUALIFY p <= 3),
ka AS (SELECT item_id, count(*) AS n, string_agg(CAST(p AS VARCHAR) || '. ' || title, chr(10) ORDER BY p) AS c FROM kt GROUP BY 1), ma AS (SELECT item_id, count(*) AS n, string_agg(CAST(p AS VARCHAR) || '. ' || title, chr(10) ORDER BY p) AS c FROM mt GROUP BY 1)
SELECT b.item_id, coalesce(ka.n, 0) AS n_knowledge, coalesce(ma.n, 0) AS n_medical, 'summary=' || coalesce(b.text, '') || CASE WHEN ka.n > 0 THEN '|knowledge_support=' || ka.c ELSE '' END || CASE WHEN ma.n > 0 THEN '|medical_evidence=' || ma.c ELSE '' END || '|prediction=' AS cards,
 'explain_rules' || CASE WHEN ka.n > 0 THEN ',view_knowledge' ELSE '' END || CASE WHEN ma.n > 0 THEN ',view_evidence,part_evidence_from_model' ELSE '' END AS actions FROM benchmark b LEFT JOIN ka USING (item_id) LEFT JOIN ma USING (item_id)""")
def evidence_augmented(spark, d):
    """Every item as an answer, with the evidence that both searches find for it."""
    asked = t(spark, d, "benchmark")
    card = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))
    answers = asked.select("item_id", F.array(card("summary", F.coalesce("text", F.lit(""))), card("prediction", F.lit(""))).alias("cards"), F.array(F.lit("explain_rules")).alias("actions"))
    known = substrings.keyword_top(asked.withColumn("liked", F.array(F.lit("src1"))), substrings.built(_library(spark, d)), "item_id", 3, preferred="liked")
    knowledge = known.select("item_id", F.col("rank").alias("position"), "title")
    medical = _top(spark, d, 3).select("item_id", F.col("rank").alias("position"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("title"))
    rows = retrieval.augmented_responses(answers, {"knowledge": knowledge, "medical": medical}, "item_id", "prediction")
    shown = F.array_join(F.transform("cards", lambda c: F.concat(c["type"], F.lit("="), c["content"])), "|")
    return rows.select("item_id", "n_knowledge", "n_medical", shown.alias("cards"), F.array_join("actions", ",").alias("actions"))


_TRUSTED = "(VALUES " + ", ".join(f"({i}, '{h}', '{next((n for k, e, n, _ in T.DOMAIN_RULES if (e in h if k == 'contains' else h.endswith(e))), h)}')" for i, h in enumerate(T.TRUSTED_DOMAINS, 1)) + ") v(rank, domain, label)"


@query(f"""WITH h AS (SELECT {_HOST} AS host FROM pages), m AS (SELECT host, (SELECT min(rank) FROM {_TRUSTED} WHERE host = domain OR host LIKE '%.' || domain) AS rank FROM h)
SELECT CAST(v.rank AS INTEGER) AS rank, domain, label, (SELECT count(*) FROM m WHERE coalesce(m.rank, 0) = v.rank) AS pages FROM (SELECT 0 AS rank, 'internal' AS domain, 'internal' AS label UNION ALL SELECT * FROM {_TRUSTED}) v""")
def source_catalogue(spark, d):
    """Sources with the pages that each has: the first trusted domain of a page's host, else the internal source."""
    catalogue = traces.source_catalogue(spark, "internal", T.TRUSTED_DOMAINS, T.source_label(F.col("domain")))
    host = T.host(F.col("url"))
    of = F.coalesce(*[F.when((host == h) | F.endswith(host, F.lit(f".{h}")), i) for i, h in enumerate(T.TRUSTED_DOMAINS, 1)], F.lit(0))
    n = t(spark, d, "pages").groupBy(of.alias("rank")).agg(F.count(F.lit(1)).alias("pages"))
    return catalogue.join(n, "rank", "left").fillna(0, ["pages"])


# --- sources and sinks -----------------------------------------------------------------


@query("SELECT CAST(user_id AS VARCHAR) AS pmcid, max(event_id) AS event_id FROM events GROUP BY 1")
def index_last_wins(spark, d):
    path = sinks.scratch_folder(spark, "index")
    rows = t(spark, d, "events").select(F.col("user_id").cast("string").alias("pmcid"), "event_id")
    lines = rows.select("event_id", F.to_json(F.struct("pmcid", "event_id")).alias("value"))
    extra = rows.filter("event_id % 10 = 0").select("event_id", F.explode(F.array(F.lit("{broken"), F.lit(" "), F.lit('{"pmcid": " ", "event_id": 1}'))).alias("value"))
    lines.unionByName(extra).repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return files.read_index(spark, path, "pmcid string, event_id long")


@query("SELECT item_id, text, length(text) AS n FROM benchmark")
def json_lines_round_trip(spark, d):
    path = sinks.scratch_folder(spark, "jsonl")
    sinks.write_json_lines(t(spark, d, "benchmark").select("item_id", "text", F.length("text").alias("n")), path)
    return files.read_json_lines(spark, path, "item_id long, text string, n int")


@query("SELECT count(*) AS n_docs, CAST(count(DISTINCT lang) AS BIGINT) AS langs, true AS ready FROM documents")
def artifact_round_trip(spark, d):
    path = sinks.scratch_folder(spark, "artifact")
    sinks.write_document(t(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("lang").alias("langs")), path)
    return files.read_artifact(spark, path, "n_docs long, langs long")


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS importance, row_number() OVER (ORDER BY round(avg(p_retailprice), 6) DESC, p_brand) - 1 AS place FROM part GROUP BY 1")
def sorted_csv(spark, d):
    path = sinks.scratch_folder(spark, "csv")
    sinks.write_sorted_csv(t(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("importance")), path, "importance", "p_brand")
    rows = spark.read.schema("p_brand string, importance double").option("header", True).csv(path)
    place = F.row_number().over(Window.orderBy(F.col("_metadata.file_name"), F.monotonically_increasing_id())) - 1  # one small file
    return rows.withColumn("place", place.cast("long"))


@query(_MATRIX + " SELECT c_mktsegment AS grp, count(*) AS n, sum(value)::DOUBLE AS total FROM cells JOIN customer ON c_custkey = k GROUP BY 1")
def labelled_matrix(spark, d):
    path = sinks.scratch_folder(spark, "metadata")
    t(spark, d, "customer").select(F.col("c_name").alias("sampleID"), F.col("c_mktsegment").alias("Group")).write.option("header", True).csv(path)
    rows = files.labelled_matrix(_matrix(spark, d)[0], files.read_metadata(spark, path, "sampleID string, Group string"))
    return rows.groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("SELECT doc_id, source FROM documents UNION ALL SELECT doc_id + 1000000, lang FROM documents")
def overwrite_then_append(spark, d):
    path, docs = sinks.scratch_folder(spark, "overwrite"), t(spark, d, "documents")
    sinks.overwrite(docs.select("doc_id", F.lit("stale").alias("source")), path)
    sinks.overwrite(docs.select("doc_id", "source"), path)
    sinks.append(docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.col("lang").alias("source")), path)
    return spark.read.parquet(path)


@query("SELECT count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem")
def dry_run(spark, d):
    seen = sinks.dry_run(t(spark, d, "lineitem"), quantity=F.sum("l_quantity"))
    return spark.range(1).select(F.lit(seen["rows"]).cast("long").alias("rows"), F.lit(seen["quantity"]).cast("double").alias("quantity"))


@query(WITH + SUMMARY + " SELECT patient_id, sample_id, feature_count FROM s")
def cached_summaries(spark, d):
    cache = sinks.ResultCache(600)
    make = lambda kind: cohort.sample_summaries(A(spark, d))
    first = cache.get("search", make, kind="all")
    again = cache.get("search", make, kind="all")
    assert first is again and cache.invalidate("search:") == 1
    return cache.get("search", make, kind="all").select("patient_id", "sample_id", "feature_count")


@query(WITH + "SELECT patient_id, 'stored' || CASE WHEN age > 50 THEN ',aged' ELSE '' END || CASE WHEN gender IS NULL THEN ',unknown' ELSE '' END AS tags FROM v_patients")
def tags_appended(spark, d):
    made = rules.tags_added(F.array(F.lit("stored")), {"aged": F.col("age") > 50, "unknown": F.col("gender").isNull(), "stored": F.lit(True)})
    return P(spark, d).select("patient_id", F.array_join(made, ",").alias("tags"))
