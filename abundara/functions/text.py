"""Column functions for text."""

from __future__ import annotations

import re
from functools import reduce

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ERF_A, ERF_P

#: Token pattern and stop words of the retrieval tokenizer.
TOKEN_PATTERN = r"([A-Za-z][A-Za-z0-9_-]+|[一-鿿]+)"
STOP_WORDS = (
    "a", "an", "the", "and", "or", "to", "of", "in", "for", "on", "with", "by", "is", "are", "was", "were", "be", "as", "at",
    "from", "that", "this", "it", "its", "into", "their", "than", "then", "but", "if", "we", "our", "can", "could", "may",
    "might", "not", "no", "yes", "have", "has", "had", "also", "these", "those", "which", "who", "whom", "what", "when", "where",
    "why", "how", "such", "using", "used", "use", "between", "within", "without", "about", "after", "before", "during", "over",
    "under", "all", "any", "each", "other", "more", "most", "some", "many", "much", "via", "per", "both", "new", "one", "two",
    "three",
)


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def present(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def composite(*cols: Column) -> Column:
    """Joined by ":", null if any part is."""
    parts = [cols[0].cast("string")]
    for c in cols[1:]:
        parts += [F.lit(":"), c.cast("string")]
    return F.concat(*parts)


def strip_taxon_prefix(c: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(F.trim(c), "^[a-z]__", ""), "_-", "  "))


def cut(c: Column, most: int, kept: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, kept), F.lit("..."))).otherwise(c)


def short_taxon_name(c: Column, unnamed: str = "unnamed") -> Column:
    """Last telling level of a path like k__a.p__b|c__d; at most 26 characters."""
    levels = F.transform(F.reverse(F.split(c, "[|;.]")), strip_taxon_prefix)
    telling = F.filter(levels, lambda x: (x != "") & ~F.lower(x).isin("unclassified", "unknown"))
    return F.when(blank(c), unnamed).otherwise(cut(F.coalesce(F.get(telling, F.lit(0)), strip_taxon_prefix(c)), 26, 23))


def clean_taxon_name(c: Column) -> Column:
    """The page's variant: also splits at blanks, any case of prefix, at most 20 characters. All levels are looked at only where the last one says nothing."""
    first = lambda x: F.substring(x, 1, 1)
    prefixed = lambda x: (F.substring(x, 2, 2) == "__") & (first(x).between("a", "z") | first(x).between("A", "Z"))
    tidy = lambda x: F.trim(F.btrim(F.when(prefixed(x), F.substr(x, F.lit(3))).otherwise(x), F.lit("_")))
    telling = lambda x: (x != "") & ~F.lower(x).isin("unclassified", "unknown")
    last = tidy(F.substring_index(F.translate(c, "|; \t\n\v\f\r", "." * 8), ".", -1))
    levels = F.transform(F.reverse(F.filter(F.split(c, r"[|;.\s]"), lambda x: x != "")), tidy)
    return F.substring(F.when(telling(last), last).otherwise(F.coalesce(F.get(F.filter(levels, telling), F.lit(0)), c)), 1, 20)


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


#: White space at the ends of a text, as wide as Unicode (and Python's strip) has it.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


#: Line ends become LF, special blanks blanks, three breaks or more two; BLANKS at the ends are trimmed last.
CLEANING = {"\r\n?": "\n", "[\u2009\u2002\u2003\xa0]": " ", "\n{3,}": "\n\n"}


def normalise(c: Column) -> Column:
    """A text cleaned by CLEANING and trimmed; only its ends are looked at for that."""
    return F.btrim(reduce(lambda cleaned, rule: F.regexp_replace(cleaned, *rule), CLEANING.items(), c), F.lit(BLANKS))


def normalised(text: str) -> str:
    """`normalise` for one text."""
    return reduce(lambda cleaned, rule: re.sub(*rule, cleaned), CLEANING.items(), text).strip(BLANKS)


def collapse(c: Column) -> Column:
    """Inline marks to blanks, list dashes dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.translate(c, "`|", "  "), F.lit("- "), F.lit("")), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Retrieval tokens: words of two characters and more that are no stop words, and runs of Chinese characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


#: Fixed value: what parts the tokens of a keyword query.
QUERY_SEPARATORS = "[\\s,.;:!?()\\[\\]\"'/|，。；：！？、（）]+"


def query_tokens(c: Column) -> Column:
    """Distinct parts of two characters and more between blanks and punctuation."""
    return F.array_distinct(F.filter(F.split(F.lower(c), QUERY_SEPARATORS), lambda t: F.length(t) >= 2))


def snippet(c: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def kwic(c: Column, words: Column, before: int = 28, after: int = 88, fallback: int = 120) -> Column:
    """Window around the first of `words` that the collapsed text holds, trimmed, with ellipses where it is cut; else the text's beginning."""
    flat = collapse(c)
    hits = F.filter(F.transform(words, lambda w: F.position(F.lower(w), F.lower(flat))), lambda p: p > 0)
    at = F.get(hits, F.lit(0)) - 1  # from 0
    start, end = F.greatest(F.lit(0), at - before), F.least(F.length(flat), at + after)
    window = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(flat, start + 1, end - start)), F.when(end < F.length(flat), "...").otherwise(""))
    head = F.when(F.length(flat) > fallback, F.concat(F.trim(F.substring(flat, 1, fallback)), F.lit("..."))).otherwise(flat)
    return F.when(at.isNull(), head).otherwise(window)


def host(url: Column) -> Column:
    """Lower-case host of a URL, empty if there is none."""
    return F.lower(F.coalesce(F.call_function("try_parse_url", url, F.lit("HOST")), F.lit("")))


def allowed_domain(host_: Column, domains: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host_ == d) | F.endswith(host_, F.concat(F.lit("."), d)))


#: Trusted domains, in order.
TRUSTED_DOMAINS = ("pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "nih.gov", "who.int", "cdc.gov", "mayoclinic.org", "clevelandclinic.org", "hopkinsmedicine.org")
#: Fixed values: (test, text, label, evidence type); the first that holds wins.
DOMAIN_RULES = (
    ("contains", "pubmed", "PubMed", "literature_index"),
    ("contains", "pmc", "PubMed Central", "literature_fulltext"),
    ("endswith", "nih.gov", "NIH", "government_research"),
    ("endswith", "who.int", "WHO", "global_guidance"),
    ("endswith", "cdc.gov", "CDC", "public_health_guidance"),
    ("endswith", "mayoclinic.org", "Mayo Clinic", "clinical_reference"),
    ("endswith", "clevelandclinic.org", "Cleveland Clinic", "clinical_reference"),
    ("endswith", "hopkinsmedicine.org", "Johns Hopkins Medicine", "clinical_reference"),
)


def _by_domain(host_: Column, pick: int, otherwise: Column) -> Column:
    out: Column | None = None
    for rule in DOMAIN_RULES:
        holds = getattr(F, rule[0])(host_, F.lit(rule[1]))
        out = F.when(holds, rule[pick]) if out is None else out.when(holds, rule[pick])
    return out.otherwise(otherwise)


def source_label(host_: Column) -> Column:
    return _by_domain(F.lower(host_), 2, F.coalesce(host_, F.lit("Medical Source")))


def evidence_type(host_: Column) -> Column:
    return _by_domain(F.lower(F.coalesce(host_, F.lit(""))), 3, F.lit("clinical_reference"))


def citation(**parts: Column) -> Column:
    """Parts that aren't blank, as "label: value", joined by " | "."""
    return F.concat_ws(" | ", *[F.when(present(c), F.concat(F.lit(f"{name}: "), c)) for name, c in parts.items()])


def first_id(c: Column) -> Column:
    """First run of one to six digits that isn't part of a longer one; null if none."""
    return F.nullif(F.regexp_extract(c, r"(?<!\d)\d{1,6}(?!\d)", 0), F.lit(""))


def gender_label(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(c.isNull(), "-").when(low.isin("male", "m", "男"), "male").when(low.isin("female", "f", "女"), "female").otherwise(c)


def disease_label(c: Column) -> Column:
    tidy = F.trim(c)
    return F.when(blank(c), "").when(F.lower(tidy) == "healthy", "healthy").otherwise(tidy)


def filled_template(template: Column, values: Column) -> Column:
    """{{key}} replaced by the map's value; keys that aren't there stay."""
    return F.aggregate(F.map_entries(values), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def library_of(path: Column) -> Column:
    """First part of a path, lower case; "general" where there is none."""
    return F.when(F.instr(path, "/") > 1, F.lower(F.split(path, "/")[0])).otherwise("general")


def document_title(markdown: Column, path: Column) -> Column:
    """First heading of the first level, else the file's name without .md."""
    heading = F.trim(F.regexp_extract(markdown, r"(?m)^[ \t]*# +([^\n]*)", 1))
    return F.when(markdown.rlike(r"(?m)^[ \t]*# "), heading).otherwise(F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.md$", ""))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


#: Words that widen a query, and what they add.
EXPANSIONS = (
    (("健康组", "健康对照", "基线"), " healthy control baseline"),
    (("差异", "偏离", "不同"), " differential abundance deviation dysbiosis"),
    (("文献", "证据", "研究"), " clinical evidence literature study"),
    (("样本", "患者"), " patient sample"),
    (("微生物", "菌", "菌群"), " gut microbiome microbial taxa"),
    (("预测", "模型"), " model interpretation prediction"),
    (("糖尿病", "t2d"), " type 2 diabetes t2d"),
    (("炎症性肠病", "ibd"), " inflammatory bowel disease ibd"),
    (("结直肠癌", "crc"), " colorectal cancer crc"),
    (("脂肪肝", "nafld"), " fatty liver nafld"),
    (("肝硬化", "cirrhosis"), " cirrhosis"),
    (("肥胖", "obesity"), " obesity"),
    (("阿尔茨海默", "ad"), " alzheimer disease ad"),
    (("多发性硬化", "ms"), " multiple sclerosis ms"),
    (("冠心病", "cad"), " coronary artery disease cad"),
)
NO_LATIN = " gut microbiome healthy control dysbiosis differential abundance disease evidence"


def expanded_query(c: Column) -> Column:
    adds = [F.when(contains_any(c, words), more).otherwise("") for words, more in EXPANSIONS]
    adds.append(F.when(~F.lower(F.coalesce(c, F.lit(""))).rlike("[a-z]"), NO_LATIN).otherwise(""))
    return F.trim(F.concat(F.trim(F.coalesce(c, F.lit(""))), *adds))


def distinct_words(*parts: Column) -> Column:
    """Distinct parts that aren't blank, in order, joined by blanks."""
    return F.concat_ws(" ", F.array_distinct(F.filter(F.array(*parts), present)))


def _percentile_sql() -> str:
    t = f"(1D / (1D + {ERF_P}D * abs(greatest(-8D, least(8D, z)) / sqrt(2D))))"
    poly = "0D"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}D) * {t})"
    x = "(greatest(-8D, least(8D, z)) / sqrt(2D))"
    return f"50D * (1D + signum({x}) * (1D - {poly} * exp(-{x} * {x})))"


PERCENTILE_SQL = _percentile_sql()


def register(spark) -> None:
    """Names for SQL users, as SQL functions that the optimizer inlines, and the chunker as a table function."""
    from ..operators import retrieval

    strip = r"trim(translate(regexp_replace(trim(l), '^[a-z]__', ''), '_-', '  '))"
    last = f"element_at(filter(transform(reverse(split(x, '[|;.]')), l -> {strip}), l -> l <> '' AND lower(l) NOT IN ('unclassified', 'unknown')), 1)"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    shifted = "transform(v, y -> greatest(coalesce(y, 0D), 0D) + 1e-6D)"
    functions = (
        "bm25_idf(n DOUBLE, df DOUBLE) RETURNS DOUBLE RETURN ln(1 + (n - df + 0.5D) / (df + 0.5D))",
        "log2_fold(v DOUBLE, r DOUBLE) RETURNS DOUBLE RETURN ln((v + 1e-9D) / (r + 1e-9D)) / ln(2D)",
        f"short_taxon_name(x STRING) RETURNS STRING RETURN CASE WHEN x IS NULL OR trim(x) = '' THEN 'unnamed' WHEN size(filter(split(x, '[|;.]'), l -> {strip} <> '' AND lower({strip}) NOT IN ('unclassified', 'unknown'))) = 0 THEN {strip.replace('(l)', '(x)')} WHEN length({last}) > 26 THEN substring({last}, 1, 23) || '...' ELSE {last} END",
        f"retrieval_tokens(x STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(lower(coalesce(x, '')), '{TOKEN_PATTERN}', 1), w -> length(w) > 1 AND w NOT IN ({stop}))",
        f"centered_log_ratio(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform({shifted}, y -> ln(y) - aggregate({shifted}, 0D, (a, z) -> a + ln(z)) / size(v))",
        f"percentile_of_z(z DOUBLE) RETURNS DOUBLE RETURN {PERCENTILE_SQL}",
    )
    for f in functions:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
    spark.udtf.register("text_chunks", retrieval.chunk_table())
