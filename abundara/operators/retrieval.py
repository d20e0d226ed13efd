"""Documents to chunks, an inverted index, BM25 and keyword search, and merging of evidence."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T

#: Chunk sizes in characters, and the share of a chunk behind which a boundary counts.
MOST, OVERLAP, LEAST, BOUNDARY_FROM = 1800, 250, 240, 0.62
#: Texts that a task cuts at once.
TEXTS = 1024
#: Headings of sections that aren't indexed.
SKIPPED_SECTIONS = ("references", "reference", "bibliography", "acknowledgment", "acknowledgement", "supplementary", "supporting information")


# --- parsing -----------------------------------------------------------------------


def paper(docs: DataFrame, text: str = "text") -> DataFrame:
    """title, metadata (map, keys in lower case, the last of a key wins), abstract and body of Markdown papers.

    The abstract reaches from its heading to that of the full text, the full text from there to the end.
    """
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    full = r"(?m)^[ \t]*## Full Text[ \t]*$"
    head = F.split(t, full, 2)[0]
    body = F.coalesce(F.get(F.split(t, full, 2), F.lit(1)), F.lit(""))
    abstract = F.regexp_extract(head, r"(?s).*(?:^|\n)[ \t]*## Abstract[ \t]*(?:\n(.*)|$)", 1)
    block = F.regexp_extract(head, r"(?s)(?:^|\n)[ \t]*## Metadata[ \t]*\n(.*?)(?:\n[ \t]*## |$)", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^- [^:]*:"))
    pair = lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^- ([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(x, "^- [^:]*:(.*)$", 1)).alias("value"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return docs.withColumns({"title": F.trim(F.regexp_extract(head, r"(?m)^# ([^\n]*)", 1)), "metadata": F.map_from_entries(last), "abstract": T.normalise(abstract), "body": T.normalise(body)})


def section_parts(text: Column, marks: str = "#{3}", untitled: str = "正文") -> Column:
    """Array of (position, heading, content) of the parts that headings begin; parts without content and reference-like ones are dropped."""
    heading = lambda p: F.trim(F.regexp_extract(p, rf"^{marks} ([^\n]*)", 1))
    content = lambda p: T.normalise(F.regexp_replace(p, rf"^{marks} [^\n]*\n?", ""))
    parts = F.transform(F.split(text, rf"(?m)(?=^{marks} )"), lambda p, i: F.struct(i.alias("position"), heading(p).alias("heading"), content(p).alias("content")))
    kept = F.filter(parts, lambda s: (s["content"] != "") & ~F.lower(s["heading"]).rlike("|".join(map(re.escape, SKIPPED_SECTIONS))))
    return F.transform(kept, lambda s: F.struct(s["position"].alias("position"), F.when(s["heading"] == "", untitled).otherwise(s["heading"]).alias("heading"), s["content"].alias("content")))


def sections(docs: DataFrame, text: str = "text", marks: str = "#{3}", untitled: str = "正文") -> DataFrame:
    """(position, heading, content) of `section_parts`, a row each. An outer generator, as Spark would work an inner one's array out twice to filter by its size."""
    return docs.select("*", F.inline_outer(section_parts(F.col(text), marks, untitled))).filter("content IS NOT NULL")


def knowledge_sections(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(id, library, title, content) of Markdown notes: headings of the second and third level begin sections, those of the first are dropped.

    A first-level heading before any content of a section becomes its title. A note without sections is one under its own title.
    """
    plain = F.array_join(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\u0085\u2028\u2029\u000b\u000c]"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    title = T.document_title(F.col(text), F.col(path))
    top = lambda p: F.regexp_extract(p, r"^(?:#{2,3} [^\n]*\n)?(?:# [^\n]*\n)*# ([^\n]*)(?:\n|$)", 1)
    own = lambda p: F.trim(F.regexp_extract(p, r"^#{2,3}\s+([^\n]*)", 1))
    rest = lambda p: T.collapse(F.regexp_replace(F.regexp_replace(p, r"^#{2,3} [^\n]*\n?", ""), r"(?m)^# [^\n]*$", ""))
    one = lambda p: F.struct(F.when(p.rlike(r"^(?:#{2,3} [^\n]*\n)?# "), F.trim(top(p))).when(p.rlike("^#{2,3} "), own(p)).otherwise(title).alias("title"), rest(p).alias("content"))
    found = F.filter(F.transform(F.split(plain, r"(?m)(?=^#{2,3} )"), one), lambda s: s["content"] != "")
    whole = F.array(F.struct(title.alias("title"), T.collapse(F.col(text)).alias("content")))
    rows = docs.filter(T.present(F.col(text))).select(path, F.posexplode(F.when(F.size(found) > 0, found).otherwise(whole)).alias("at", "s")).filter("s.content <> ''")
    return rows.select(F.concat(F.col(path), F.lit("#"), (F.col("at") + 1).cast("string")).alias("id"), T.library_of(F.col(path)).alias("library"), F.col("s.title").alias("title"), F.col("s.content").alias("content"))


#: Where a chunk may end: behind a mark that white space follows, and within a blank line that is no such white space.
MAY_END = re.compile(r"[。！？.!?;；](?=\s)|(?<![。！？.!?;；])\n(?=\n)")


def spans(ends: Sequence[int], n: int, most: int, overlap: int):
    """(start, end) of overlapping chunks of a text of n characters that may end at `ends`, which are in order.

    A chunk has at most `most` characters. It ends at the last place inside it, if that is far enough from its start, and the next one begins `overlap` before.
    """
    if overlap >= BOUNDARY_FROM * most:
        raise ValueError("an overlap this large would never advance")
    start = end = 0
    while end < n:
        limit = min(start + most, n)
        last = bisect_left(ends, limit) - 1  # the character behind the place lies inside too
        soft = ends[last] if last >= 0 else -1
        end = soft if soft >= min(n, start + int(BOUNDARY_FROM * most)) else limit
        yield start, end
        start = max(0, end - overlap)


def cut_texts(text: str, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of a normalised text, each normalised, without those below `least` characters. All places where one may end are found once."""
    whole = [(0, len(text))] if len(text) <= most else spans([m.end() for m in MAY_END.finditer(text)], len(text), most, overlap)
    return [chunk for chunk in (T.normalised(text[a:b]) for a, b in whole) if len(chunk) >= least]


def chunks(docs: DataFrame, key: str | list[str], text: str, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(*key, number, chunk): texts are cleaned and cut in Arrow batches, in one scan in which each is cleaned once."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = docs.select(*keys, F.coalesce(text, F.lit("")).alias("chunk"))

    def cut(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                row, number, chunk = [], [], []
                for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                    for n, piece in enumerate(cut_texts(T.normalised(t), most, overlap, least), 1):
                        row.append(i)
                        number.append(n)
                        chunk.append(piece)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]], pa.array(number, pa.int32()), pa.array(chunk, pa.string())], names=[*keys, "number", "chunk"])

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys), "number int", "chunk string"])
    return rows.mapInArrow(cut, schema)


def chunk_table():
    """The chunker as a table function for SQL: SELECT ... FROM docs, LATERAL text_chunks(docs.text)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="number int, chunk string")
    class TextChunks:
        def eval(self, text: str):
            yield from enumerate(cut_texts(T.normalised(text or "")), 1)

    return TextChunks


def numbered_chunks(parts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Chunk ids with one counter per document over abstract and body parts: key-A001, key-F002."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return parts.withColumn("chunk_id", F.format_string("%s-%s%03d", F.col(key).cast("string"), F.when(F.col("kind") == "abstract", "A").otherwise("F"), rank))


#: Fields of a paper's metadata that its chunks carry.
CARRIED = ("pmid", "topic", "year", "journal", "doi")


def paper_chunks(docs: DataFrame, index: DataFrame, key: str = "pmcid", text: str = "text") -> DataFrame:
    """Chunk rows of Markdown papers: parsed, joined to the index (pmcid, ingested, pmid, topic, source_url), split, cut and numbered.

    A paper that the index excludes is left out; fields come from the paper, then the index; a topic is "unknown" at last.
    """
    known = index.select(key, "ingested", *[F.col(c).alias(f"i_{c}") for c in ("pmid", "topic", "source_url")])
    rows = paper(docs.select(key, text), text).drop(text).join(known, key, "left").filter(~F.col("ingested").eqNullSafe(False))
    meta = lambda c: F.coalesce(F.try_element_at("metadata", F.lit(c)), F.lit(""))
    first = lambda *cs: F.coalesce(T.first_present(*cs), F.lit(""))
    fields = {"pmid": first(meta("pmid"), F.col("i_pmid")), "topic": F.coalesce(F.nullif(first(meta("topic"), F.col("i_topic")), F.lit("")), F.lit("unknown")), "year": meta("year"), "journal": meta("journal"), "doi": meta("doi"), "source_url": first(F.col("i_source_url"), meta("europepmc"))}
    rows = rows.withColumns(fields).drop("metadata", "ingested", "i_pmid", "i_topic", "i_source_url")
    part = lambda position, kind, section, content: F.struct(position.alias("position"), F.lit(kind).alias("kind"), section.alias("section"), content.alias("content"))
    body = F.transform(section_parts(F.col("body")), lambda x: part(x["position"], "body", x["heading"], x["content"]))
    parts = F.concat(F.array(part(F.lit(-1), "abstract", F.lit("Abstract"), F.col("abstract"))), F.coalesce(body, F.array().cast("array<struct<position:int,kind:string,section:string,content:string>>")))
    carried = [key, "title", *CARRIED, "source_url"]
    out = numbered_chunks(chunks(rows.select(*carried, F.inline_outer(parts)), [*carried, "position", "kind", "section"], "content"), key, ["position", "number"])
    return out.select("chunk_id", key, "title", *CARRIED, "section", "source_url", F.col("chunk").alias("text"))


# --- index -------------------------------------------------------------------------


def tokenized(chunks_: DataFrame, text: str = "text") -> DataFrame:
    """Adds `tokens` and `length`; rows without tokens are dropped."""
    rows = chunks_.withColumn("tokens", T.tokens(F.col(text)))
    return rows.withColumn("length", F.size("tokens")).filter("length > 0")


def postings(tokens: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """(token, key, tf, length): the inverted index, of the tokens in `wanted` only if given; others go before the shuffle."""
    rows = tokens.select(key, "length", F.explode("tokens").alias("token"))
    rows = rows if wanted is None else rows.join(wanted, "token", "left_semi")
    return rows.groupBy("token", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("length"), 6).alias("avgdl"))


# --- keyword search ----------------------------------------------------------------


def keyword_score(tokens: Column, title: Column, body: Column, preferred: Column) -> Column:
    """0.35 for a preferred library; for each token 1.8 if the title has it, else 1 if the body has it."""
    point = lambda acc, t: acc + F.when(F.contains(F.lower(title), t), 1.8).when(F.contains(F.lower(body), t), 1.0).otherwise(0.0)
    return F.when(preferred, 0.35).otherwise(0.0) + F.aggregate(tokens, F.lit(0.0), point)


def keyword_search(chunks_: DataFrame, query: str, preferred: Sequence[str], k: int) -> DataFrame:
    """Best k chunks for one query: score, library, title; with a window around the first hit. One scan, no join."""
    tokens = F.filter(T.query_tokens(F.lit(query)), lambda t: t != "")
    score = keyword_score(tokens, F.col("title"), F.col("content"), F.col("library").isin(*preferred) if preferred else F.lit(False))
    rows = chunks_.withColumn("score", F.round(score, 2)).filter("score > 0").orderBy(F.desc("score"), "library", "title", "id").limit(k)
    return rows.withColumn("snippet", T.kwic(F.col("content"), tokens))


# --- evidence ----------------------------------------------------------------------


def evidence_key(pmcid: Column, url: Column, title: Column) -> Column:
    named = lambda p, c: F.concat(F.lit(p), F.lower(c))
    return F.when(T.present(pmcid), named("pmcid:", pmcid)).when(T.present(url), named("url:", url)).otherwise(named("title:", F.coalesce(title, F.lit(""))))


def merged_evidence(sources: Sequence[DataFrame], query_key: str, limit: int) -> DataFrame:
    """Union of hit lists (query, position, pmcid, url, title), earlier lists first, one of each key, at most `limit` a query."""
    every = None
    for i, df in enumerate(sources):
        part = df.withColumn("source_rank", F.lit(i))
        every = part if every is None else every.unionByName(part)
    keyed = every.withColumn("key", evidence_key(F.col("pmcid"), F.col("url"), F.col("title")))
    first = keyed.groupBy(query_key, "key").agg(F.min(F.struct("source_rank", "position", "pmcid", "url", "title")).alias("h")).select(query_key, "key", "h.*")
    w = Window.partitionBy(query_key).orderBy("source_rank", "position", "key")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= N.clamp_limit(limit, 6, 8))


def augmented(cards: Column, card: Column, before: Column) -> Column:
    """`card` put before the first card of type `before`, or at the end."""
    at = F.array_position(F.transform(cards, lambda c: c["type"]), before)
    n = F.when(at > 0, at.cast("int") - 1).otherwise(F.size(cards))
    return F.concat(F.slice(cards, 1, n), F.array(card), F.slice(cards, n + 1, F.size(cards)))


#: Fixed values, by kind of evidence in the order of their cards: the card's type, and the actions that it brings.
EVIDENCE = {"knowledge": ("knowledge_support", ("view_knowledge", "explain_rules")), "medical": ("medical_evidence", ("view_evidence", "part_evidence_from_model")), "web": ("web_evidence", ("view_web", "part_internal_from_web"))}


def augmented_responses(responses: DataFrame, hits: dict[str, DataFrame], key: str, before: str | None, most: int = 3) -> DataFrame:
    """`responses` (key, cards of (type, content), actions) with evidence from hit lists (key, position, title) of the kinds in EVIDENCE.

    Each kind that has hits brings its number, a card of its first titles and its actions, each action once. The cards go before the first of type `before`, or to the end. A
    response without any hit stays as it is, with zeros.
    """
    out = responses
    for kind, rows in hits.items():
        first = rows.filter(F.col("position") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "title"))).alias("__t"))
        listed = F.transform("__t", lambda x: F.concat(x["position"].cast("string"), F.lit(". "), F.coalesce(x["title"], F.lit(""))))
        out = out.join(first.select(key, F.size("__t").alias(f"n_{kind}"), F.array_join(listed, "\n").alias(f"__{kind}")), key, "left").fillna(0, [f"n_{kind}"])
    kinds = [k for k in EVIDENCE if k in hits]
    new = F.filter(F.array(*[F.struct(F.lit(EVIDENCE[k][0]).alias("type"), F.col(f"__{k}").alias("content")) for k in kinds]), lambda c: c["content"].isNotNull())
    at = F.array_position(F.transform("cards", lambda c: c["type"]), F.lit(before)) if before else F.lit(0)
    n = F.when(at > 0, at.cast("int") - 1).otherwise(F.size("cards"))
    cards = F.concat(F.slice("cards", 1, n), new, F.slice("cards", n + 1, F.size("cards")))
    actions = F.col("actions")
    for k in kinds:
        actions = F.array_union(actions, F.when(F.col(f"n_{k}") > 0, F.array(*[F.lit(a) for a in EVIDENCE[k][1]])).otherwise(F.array().cast("array<string>")))
    return out.withColumns({"cards": cards, "actions": actions}).drop(*[f"__{k}" for k in hits])
