"""Training-data operators against brute force, round trips and held-out accuracy, with edge rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abundara.llm import common, op1_pii, op2_token_files, op3_warc, op4_quality_rules, op5_toxicity, op6_lm, op7_bpe, op8_packing, op9_exact_dedup, op10_near_dedup, token_cache

SCHEMA = "doc_id long, text string"
#: Nulls, empties, blanks, ties, repeated rows, marks of other alphabets, a long word and a long text.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (5, "a  b"), (6, "A B C D E F"), (7, "é\U0001f600 ß <|endoftext|> x"), (8, "x" * 30_000), (9, "one two three four five six. " * 3_000), (10, "0.0.0.0 a@b.c"), (None, "null id")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.documents(spark, sf_dir)


@pytest.fixture(scope="module")
def wide(spark):
    """Columns of the documents' table, some whose names clash with the operators' own, and a map; null ids and repeated rows too."""
    rows = [(i, t, "en", "s", 0 if t is None else len(t), "own", 7, "k", {"a": 1, "b": 2}, 5, "w", "r") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, digest long, kept string, extra map<string,int>, salt int, id string, rank string")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# --- exact dedup -------------------------------------------------------------------


def exact_brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((str(i), str(least[norm(t)]), len(groups[norm(t)])) for i, t in rows)


@pytest.mark.parametrize("digest", [op9_exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)], ids=["sha256", "clashing"])
def test_exact_dedup(spark, edges, digest):
    got = op9_exact_dedup.exact_membership(edges, digest=digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == exact_brute(EDGES)


def test_exact_dedup_keeps_one_row(wide):
    kept = op9_exact_dedup.deduplicate(wide)
    assert kept.columns == wide.columns
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 3, 4, 6, 7, 8, 9, 10] and len(got) == 9 and all(r.extra == {"a": 1, "b": 2} and r.salt == 5 for r in got)


def test_exact_dedup_keeps_texts_without_ids(spark):
    rows = [*EDGES, (None, "null  id"), (None, "other"), (None, "a b"), (None, None), (11, "with id"), (None, "with id")]
    got = op9_exact_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[norm(t)] += [i] if i is not None else []
    want = {t: min(v, default=None) for t, v in ids.items()}
    assert len(got) == len(want) and {norm(r.text): r.doc_id for r in got} == want


# --- near dedup --------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def mutated(rng, base, share):
    return [f"m{rng.randrange(10**6)}" if rng.random() < share else w for w in base]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 60, 150]))]
        for _ in range(rng.choice([2, 10, 40])):
            copy = mutated(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))
            rows.append((len(rows), " ".join(copy[: rng.choice([len(copy), len(copy) - 3])])))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " ", "a b", "A  B", "b a", rows[0][1], rows[0][1].upper()])]
    got = op10_near_dedup.near_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == near_brute(rows)


def test_near_dedup_of_tables(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = op10_near_dedup.near_components(docs).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == near_brute(rows)


def test_near_dedup_of_template_pages(spark):
    """Pages share a template at a similarity of 0.6; their other passages recur in pairs of pages. Few pairs are tried."""
    rng = random.Random(7)
    template, rows = " ".join(f"t{k}" for k in range(94)), []
    passage = lambda: " ".join(f"p{rng.randrange(10**6)}" for _ in range(13))
    for i in range(0, 1500, 3):
        a, b, c = passage(), passage(), passage()
        rows += [(i, f"{template} {a} {b}"), (i + 1, f"{template} {b} {c}"), (i + 2, f"{template} {c} {a} x y")]
    rows += [(1500 + k, rows[k * 3][1] + " near") for k in range(50)]
    docs = common.spill(spark.createDataFrame(rows, SCHEMA).repartition(4), "pages")
    sets = op10_near_dedup.sets_of(docs, docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))).withColumn("root", F.col("node"))
    assert op10_near_dedup.prefix_pairs(sets).count() < 5 * len(rows)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in op10_near_dedup.near_components(docs).collect())
    assert got == near_brute(rows)


def test_near_dedup_edges(edges, empty, wide):
    assert op10_near_dedup.near_components(edges).count() == len(EDGES)
    assert op10_near_dedup.near_components(empty).count() == 0
    kept = op10_near_dedup.deduplicate(wide)
    got = kept.collect()
    assert kept.columns == wide.columns and sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 10] and len(got) == 10


def test_near_dedup_keeps_rows_without_ids(spark):
    base = [[f"{c}{k}" for k in range(30)] for c in "abcde"]
    near = [" ".join([*b[:-1], "z"]) for b in base]
    full = [" ".join(b) for b in base]
    # a group with ids and without; two groups without ids; a lone text without id; one least id in two groups; no words, no id
    rows = [(None, full[0]), (2, near[0]), (None, full[1]), (None, near[1]), (None, full[2]), (None, full[2]), (None, full[3]), (1, full[4]), (3, near[4]), (1, "q " + full[4].replace("e", "f")), (None, " "), (None, "\t"), (None, None), (5, "")]
    got = op10_near_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    texts = {(r.doc_id, r.text) for r in got}
    assert len(texts) == len(got) == 10
    lone = {(2, near[0]), (None, full[2]), (None, full[3]), (1, full[4]), (1, "q " + full[4].replace("e", "f")), (None, " "), (None, "\t"), (None, None), (5, "")}
    assert texts - lone in ({(None, full[1])}, {(None, near[1])}) and lone <= texts


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.75, 0.95):
        pool = rng.integers(0, 1 << 63, 4000, np.uint64)
        n = 1000
        both = int(round(2 * n * share / (1 + share)))
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
        got = op10_near_dedup.estimated(*(op10_near_dedup.registers(x)[None] for x in (a, b)), np.array([n]), np.array([n]))[0]
        assert abs(got - share) < 0.13


def test_copies_without_id_have_many_salts(spark):
    rows = [(None, "one two three four five six seven")] * 300 + [(i, f"row {i} has words of its own and no other") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one task numbers all copies in a row
    got = op10_near_dedup.sketches(docs).filter("id is null").groupBy("salt").count().collect()
    assert len(got) == 64 and max(r["count"] for r in got) < 30
    found = op10_near_dedup.near_components(docs)
    assert found.count() == 900 and found.filter("id is null and component_id is null").count() == 300


def test_a_hub_meets_its_neighbours_by_salt(spark):
    edge = lambda a, b: (a.to_bytes(8, "big"), b.to_bytes(8, "big"))
    edges = spark.createDataFrame([edge(i, 0) for i in range(1, 3000)], "a binary, b binary")
    plan = op10_near_dedup.star_round(edges)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(u" in plan and "__salt" in plan
    assert op10_near_dedup.components(edges).select("root").distinct().count() == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {i: i for i in range(400)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(bytes(r.node), "big"): int.from_bytes(bytes(r.root), "big") for r in op10_near_dedup.components(df).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


# --- quality -----------------------------------------------------------------------


def quality_brute(text):
    w = words(text)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab #\n\t é\x1c |"), max_size=60))
def test_text_counts(text):
    assert op4_quality_rules.text_counts(text.encode())[:5] == quality_brute(text)


def test_quality_edges(edges, empty, wide):
    got = {(r.row.doc_id, r.n_words): r for r in op4_quality_rules.judged(op4_quality_rules.with_counts(edges)).collect()}
    assert all(got[i, len(words(t))].base_failed for i, t in EDGES if len(words(t)) < 50)
    assert op4_quality_rules.judged(op4_quality_rules.with_counts(empty)).count() == 0
    assert op4_quality_rules.filter_quality(wide).columns == wide.columns


def test_quality_keeps_clean_and_finds_junk(spark, docs, sf_dir):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op4_quality_rules.judged(op4_quality_rules.with_counts(docs, keep=["doc_id"])).collect()
    seen = [(truth[r.row.doc_id], r.kept) for r in got if r.row.doc_id in truth and not r.base_failed]
    clean, junk = ([k for t, k in seen if t == q] for q in (1, 0))
    assert sum(clean) / len(clean) > 0.95 and sum(junk) <= 0.2 * len(junk) and junk


def test_posteriors_find_kinds_of_junk():
    """Few documents, three kinds of junk; abstentions of two rules together aren't evidence."""
    good, rules = 3**9 - 1, op4_quality_rules.RULES
    vote = lambda rule, v: good + (v - 1) * 3 ** (len(rules) - 1 - rules.index(rule))
    both = vote("dup_lines", 0) + vote("repeats", 0) - good
    rows = [(good, 700), (both, 30), (vote("line_ends", 0), 80), *[(vote(r, -1), 8) for r in ("symbols", "shouting", "runs")]]
    got = op4_quality_rules.fit_posteriors(rows)
    assert min(got[good], got[both], got[vote("line_ends", 0)]) > 0.9 and max(got[vote(r, -1)] for r in ("symbols", "shouting", "runs")) < 0.5


def test_posteriors_without_junk():
    assert min(op4_quality_rules.fit_posteriors([(3**9 - 1, 1000)]).values()) > 0.9
    assert op4_quality_rules.fit_posteriors([]) == {}


# --- personal data -----------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def pii_rows():
    rng = random.Random(9)
    parts = ["1", "23", "456", "4539578763621486", ".", "@", "a", "b.c", "-", " ", "+", "+1", " (555) ", "555-1234", "\n", "é", "\U0001f600", "x@y.z", "192.168.0.1", "256.1.1.1", "", "_", "00300.1.2.3", "jo [at] ex.com", "4539 5787 6362 1486", 'token = "abc123def456abc123def4"']
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    return rows + [(3000, None), (3001, "1." * 5000), (3002, "1" * 20000), (3003, "a" * 20000 + "@"), (3004, "a@b.c " * 2000)]


def test_pii_spans(spark):
    rows = pii_rows()
    text = dict(rows)
    got = op1_pii.find_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        base = [(op1_pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.base]
        assert base == base_brute(text[r.doc_id])
        extra = [(s.start, s.end) for s in r.spans if not s.base]
        assert all(e <= a or b <= s for a, b in extra for _, s, e in base)
        assert all(e <= a or b <= s for k, (a, b) in enumerate(extra) for s, e in extra[:k])
    plan = op1_pii.find_spans(spark.createDataFrame(rows[:5], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_redaction(spark, wide, empty):
    rows = pii_rows()
    got = op1_pii.redact(spark.createDataFrame(rows, SCHEMA))
    text = dict(rows)
    spans = {r.doc_id: r.spans for r in op1_pii.find_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in got.collect():
        if text[r.doc_id] is None:
            assert r.text is None
            continue
        out, at = [], 0
        merged = []
        for s in sorted((s.start, s.end, s.kind) for s in spans[r.doc_id]):
            if merged and merged[-1][1] > s[0]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]), merged[-1][2])
            else:
                merged.append(s)
        for a, b, k in merged:
            out += [text[r.doc_id][at:a], f"<{op1_pii.KINDS[k].upper()}>"]
            at = b
        assert r.text == "".join(out) + text[r.doc_id][at:]
    done = op1_pii.redact(wide)
    assert done.columns == wide.columns and all(r.n_chars == len(r.text or "") for r in done.collect() if r.text is not None)
    assert op1_pii.find_spans(empty).count() == 0


def planted_pii():
    """(rows, spans of personal data that no base pattern has, look-alikes), the half of both without any cue word."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    local = lambda: f"({number(3)}) {number(3)}-{number(4)}"
    rows, good, bad = [], set(), set()
    for i in range(1200):
        kind = i % 8
        before, value, where = {
            0: ("", "+1 " + local(), None), 1: (rng.choice(["call ", "", "tel "]), local(), good), 2: (rng.choice(["order no. ", "#", "ref ", "/"]), f"{number(3)}-{number(3)}-{number(4)}", bad),
            3: ("", f'token = "{rng.getrandbits(160):040x}"', good), 4: ("", f"password: {rng.choice(['required', 'forgotten', 'aaaaaaaa'])}", bad), 5: ("", f"{word()}.{word()}@{word()}.com", None),
            6: (rng.choice(["mail ", "contact "]), f"{word()}.{word()} [at] {word()} [dot] com", good), 7: ("", " ".join(word() for _ in range(6)), None),
        }[kind]
        head = " ".join(word() for _ in range(rng.randint(1, 6))) + " " + before
        rows.append((i, f"{head}{value} {word()}"))
        if where is not None:
            where.add((i, len(head), len(head) + len(value)))
    return rows, good, bad


def test_pii_finds_planted_and_leaves_look_alikes(spark):
    rows, good, bad = planted_pii()
    found = spark.createDataFrame(rows, SCHEMA)
    added = {(r.doc_id, s.start, s.end) for r in op1_pii.find_spans(found).collect() for s in r.spans if not s.base}
    assert len(added & good) >= 0.9 * len(good) and len(added & good) >= 0.9 * len(added) and len(added & bad) <= 0.05 * len(bad)
    held = common.spill(found.select("doc_id", op1_pii.candidates(F.col("text")).alias("candidates")), "candidates")
    model, thresholds = op1_pii.fit(held, "doc_id")
    seen = held.select(F.explode("candidates").alias("c")).select("c.*").filter("not base").collect()
    below = [c for c in seen if c.kind not in thresholds or op1_pii.predict(model, np.array([[c[f] for f in op1_pii.FEATURES]]))[0] < thresholds[c.kind]]
    assert len(below) > 100 and {c.label for c in seen} == {-1, 0, 1}


def test_trees_learn_counts():
    x = np.array([[a, b] for a in range(3) for b in range(3)])
    pos = np.array([90.0 if a == 1 and b > 0 else 2.0 for a, b in x])
    model = op1_pii.fit_trees(x, pos, 100 - pos)
    p = op1_pii.predict(model, x)
    assert p[(x[:, 0] == 1) & (x[:, 1] > 0)].min() > 0.7 and p[x[:, 0] != 1].max() < 0.2


# --- tokens ------------------------------------------------------------------------

BYTE, WORD = (token_cache.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = [" ", " ", "  ", "\n", "\t", "a", "the", "The", "é", "é", "<|endoftext|>", "'s", "don't", "1", "23", ".", ",", " ", "\x1c", "\x85", "!!", "***", "\U0001f600", "I", "IX", "Σ", "\r\n", "|", "İ", "ß"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join))
def test_cached_ids(text):
    for path in (BYTE, WORD):
        want = _library(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(token_cache.library_encoder(path).ids(text), "<u4").tolist() == want
    own = op7_bpe.bpe(BYTE)
    ids = own.encode(text).tolist()
    assert ids == _library(BYTE).encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == _library(BYTE).decode(ids, skip_special_tokens=False)


_tokenizers = {}


def _library(path):
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def test_bpe_of_tables(docs, library):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in op7_bpe.round_trip(docs, BYTE).collect():
        ids = library[BYTE].encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library[BYTE].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns(edges, empty):
    got = op7_bpe.decode_column(op7_bpe.encode_column(edges, BYTE), BYTE)
    assert sorted(map(str, ((r.id, r.decoded) for r in got.collect()))) == sorted(map(str, ((i, t or "") for i, t in EDGES)))
    assert op7_bpe.encode_column(empty, BYTE).count() == 0


@pytest.mark.parametrize("length", [8, 2048])
def test_token_files(spark, edges, library, length):
    folder = common.new_folder(spark, "tokens")
    shards = op2_token_files.write_token_files(edges, folder, BYTE, 50_257, length=length, partitions=3)
    got = op2_token_files.read_token_files(spark, shards).collect()
    want = collections.Counter()
    for i, t in EDGES:
        ids = np.array([*library[BYTE].encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    with_id = [r for r in got if r.doc_id is not None]
    assert [r.doc_id for r in sorted(with_id, key=lambda r: r.start)] == sorted(r.doc_id for r in with_id)
    total = 0
    for s in shards:
        f = op2_token_files.TokenFile(s["uri"])
        rows = -(-s["tokens"] // length)
        ids, mask = f.sequence(rows - 1)
        assert len(ids) == len(mask) == length and mask.sum() == (s["tokens"] - 1) % length + 1 and not ids.flags.owndata
        total += s["tokens"]
        doc, ids = f.document(0)
        assert ids[-1] == 2
    assert total == at


def test_token_masks_are_views_of_bits(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * 5) for i in range(9)], "doc_id long, text string")
    length = 13  # not a multiple of eight
    for s in op2_token_files.write_token_files(docs, common.new_folder(spark, "tokens"), BYTE, 50_257, length=length, partitions=2):
        f = op2_token_files.TokenFile(s["uri"])
        left = s["tokens"]
        for i in range(-(-s["tokens"] // length)):
            bits, mask = f.packed_mask(i), f.sequence(i)[1]
            assert len(bits) == 2 and not bits.flags.owndata
            assert mask.tolist() == [int(k < left) for k in range(length)]
            assert [bits[k // 8] >> k % 8 & 1 for k in range(length)] == mask.tolist()
            left -= length


def test_token_files_of_nothing(spark, empty):
    shards = op2_token_files.write_token_files(empty, common.new_folder(spark, "tokens"), BYTE, 50_257)
    assert shards == [] and op2_token_files.read_token_files(spark, shards).count() == 0


# --- packing -----------------------------------------------------------------------


def check_packing(rows, length):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def best_fit_one_by_one(lengths, length):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(length - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_best_fit(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), 7, 33]) for _ in range(800)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = op8_packing.pack(df, 64).collect()
    assert sorted(r.doc_id for r in got) == list(range(800)) and all(lengths[r.doc_id] == r.length for r in got)
    assert check_packing(got, 64) == best_fit_one_by_one(lengths, 64)


def test_packing_spreads_one_size(spark):
    """One size for nearly all pieces, and rows that tie in everything: ranges stay even."""
    df = common.spill(spark.createDataFrame([(7, 2048)] * 3000 + [(i, 100 + i % 9) for i in range(300)], "doc_id long, length long").repartition(3), "pieces")
    ranges = [r.n for r in op8_packing.range_sorted(df, ["doc_id"]).groupBy(F.shiftright("__place", 33)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(ranges) == 3300 and len(ranges) == 4 and max(ranges) < 1500
    got = op8_packing.pack(df).collect()
    assert len(got) == 3300 and check_packing(got, 2048) == best_fit_one_by_one([r.length for r in got], 2048)


def test_packing_fills_a_gap_before_the_next(spark):
    lengths = [1030] * 2 + [500] * 2 + [260] * 3
    got = op8_packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), 2048).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    assert check_packing(got, 2048) == best_fit_one_by_one(lengths, 2048) == 2


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=12))
def test_packing_plan_is_best_fit(counts):
    plan, rows = op8_packing.best_fit_plan(counts, 64), []
    for size, n in counts.items():
        mine = plan[plan[:, 0] == size]
        for rank in range(n):
            _, at, first, each, offset = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
            rows.append((first + (rank - at) // each, offset + (rank - at) % each * size, size))
    places = collections.defaultdict(list)
    for sequence, offset, size in rows:
        places[sequence].append((offset, size))
    for x in places.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 64
    assert len(places) == best_fit_one_by_one([s for s, n in counts.items() for _ in range(n)], 64)


def test_packing_edges(spark, edges, empty, library):
    got = op8_packing.pack_documents(edges, WORD).collect()
    check_packing(got, 2048)
    want = collections.Counter()
    for i, t in EDGES:
        ids = np.array([*library[WORD].encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert op8_packing.pack_documents(empty, WORD).count() == 0


# --- WARC --------------------------------------------------------------------------


def test_warc(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["http://a.b/c d\n", None, "x"]), rng.choice([None, "", "é" * 5, "<p>" * 50_000, "\r\n\r\n", f"page {i}"])) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    uris = op3_warc.write_archives(pages, common.new_folder(spark, "warc"))
    got = op3_warc.assemble(op3_warc.read_archives(spark, uris, with_payload=True)).collect()
    html = {i: (h or "").encode() for i, _, h in rows}
    groups = collections.defaultdict(list)
    for i, h in html.items():
        groups[h].append(i)
    assert len(got) == len(rows)
    for r in got:
        assert r.request.type == "request" and r.metadata.type == "metadata" and r.request.concurrent_to == r.capture_id
        i = int(r.capture_id.split(":")[2])
        first = max(groups[html[i]])
        assert r.response.payload_bytes == len(html[i]) and r.response.payload_digest == base64.b32encode(hashlib.sha1(html[i]).digest()).decode()
        if i == first:
            assert r.response.type == "response" and bytes(r.response.payload) == html[i]
        else:
            assert r.response.type == "revisit" and r.response.refers_to.split(":")[2] == str(first)


def test_warc_pages_without_id_and_clashing_columns(spark):
    rows = [(None, "u", "same", 1, "x"), (None, "v", "same", 2, "x"), (4, "w", "same", 3, "x"), (None, "z", "alone", 4, "x"), (None, "z", "alone", 4, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, salt int, sha string")
    uris = op3_warc.write_archives(pages, common.new_folder(spark, "warc"))
    got = op3_warc.assemble(op3_warc.read_archives(spark, uris)).collect()
    kinds = collections.Counter((r.capture_id.split(":")[2], r.response.type, (r.response.refers_to or "::").split(":")[2]) for r in got)
    assert kinds == {("4", "response", ""): 1, ("None", "revisit", "4"): 2, ("None", "response", ""): 2}


def test_warc_repeated_pages_and_nothing(spark):
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame([(5, "u", "same"), (5, "u", "same"), (3, "v", "same"), (7, "w", "tiny")], schema)
    uris = op3_warc.write_archives(pages, common.new_folder(spark, "warc"))
    kinds = collections.Counter((r.capture_id.split(":")[2], r.response.type) for r in op3_warc.assemble(op3_warc.read_archives(spark, uris)).collect())
    assert kinds == {("5", "response"): 1, ("5", "revisit"): 1, ("3", "revisit"): 1, ("7", "response"): 1}
    none = op3_warc.write_archives(spark.createDataFrame([], schema), common.new_folder(spark, "warc"))
    assert none == [] and op3_warc.assemble(op3_warc.read_archives(spark, none)).count() == 0


# --- toxicity ----------------------------------------------------------------------


O5 = op5_toxicity
VOCABULARY = ["idiot", "zorga", "vikk", "kill", "you", "not", "said", '"', "calm", "day"]
LEARNED = {"zorg": O5.STRONG, "vik": O5.WEAK}


def labels_brute(words_):
    """The grammar's labels by their definitions, word by word, without machines."""
    kind = [{"idiot": "insult", "zorga": "stem", "vikk": "weak", "kill": "threat", "you": "target", "not": "negation", "said": "report", '"': "quote"}.get(w, "other") for w in words_]
    out, bad = [], ("insult", "stem", "weak")
    for i, k in enumerate(kind):
        before = kind[:i]
        if k == "weak":
            out.append("pair" if any(x in bad for x in before) else "weak")
        elif k in bad:
            out += [k] + (["pile"] if any(x in bad[:2] for x in before) else ["pair"] if "weak" in before else [])
        if k in bad and "target" in before[-3:]:
            out.append("aimed")
        if k in (*bad, "threat") and "negation" in before[-2:]:
            out.append("negated")
        if k in (*bad, "threat") and ("report" in before or before.count("quote") % 2):
            out.append("reported")
        near = next((x for x in reversed(before[-3:]) if x in ("threat", "target")), None)
        if k == "threat":
            out.append("threat" if near == "target" else "menace")
        if k == "target" and near == "threat":
            out.append("threat")
    return collections.Counter(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(VOCABULARY), max_size=14))
def test_grammar_equals_its_definitions(words_):
    got = O5.clause_labels(" ".join(words_), O5.Stems(LEARNED))
    assert collections.Counter(O5.LABELS[x] for x in got) == labels_brute(words_)
    features = O5.text_features(" ".join(words_), O5.Stems(LEARNED))
    assert features[:-1] == pytest.approx([math.log2(1 + labels_brute(words_)[x]) for x in O5.LABELS])


def test_grammar_weighs_context():
    stems = O5.Stems({})
    score = lambda t: O5.probability(np.array([O5.text_features(t, stems)]), O5.DEFAULT)[0]
    plain = score("some idiot here")
    assert score("you are an idiot") > plain > O5.TOXIC_FROM > score("he is not an idiot") and score("report says some idiot here") < plain > score('an "idiot" here')
    assert score("a calm day") < 0.1 and score("we shoot pictures") < 0.5 < score("you will kill them") and score("idiot idiot") > plain


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", ".", ",", "(", ")", "'", "’", "_", "1", "kill", "Burn", "matar", "you", "idiot", "zorgs", "calm", "é"]), max_size=12).map("".join))
def test_toxicity_skips_no_match(text):
    stems = O5.Stems(LEARNED)
    matches = any(O5.clause_labels(c, stems) for c in O5.CLAUSE_END.split(text.lower()))
    assert (O5.text_features(text, stems)[-1] > 0) == matches


def test_toxicity_scores_threats_beside_punctuation():
    stems = O5.Stems({})
    for text, spaced in (("you will burn.", "you will burn ."), ("(kill)", "( kill )"), ("matar, no", "matar , no")):
        assert O5.text_features(text, stems) == O5.text_features(spaced, stems) > [0.0] * 11


def test_longest_stem_decides():
    stems = O5.Stems({"ab": O5.WEAK, "abcd": O5.STRONG, "abx$": O5.STRONG})
    assert [stems.read(w) for w in ("a", "abc", "abcde", "abx", "abxy", "idiot", "idiots")] == [O5.OTHER, O5.WEAK, O5.STRONG, O5.STRONG, O5.WEAK, O5.INSULT, O5.OTHER]


def test_grammar_matters(spark):
    """Clean documents quote or negate insults, toxic ones say them: without the paths' context both look alike."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.5
        filler = lambda n: [f"wort{rng.randrange(60)}" for _ in range(n)]
        bad = rng.choice(["idiot", "moron", "loser"])
        clause = ["you", bad] if toxic else rng.choice([["not", "a", bad], ["someone", "said", bad], ['"', bad, '"']])
        rows.append((i, " ".join(filler(12) + ["."] + clause + filler(3) + ["."] + filler(9))))
        labels.append((i, int(toxic)))
    docs, labelled = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    learned, weights = O5.train(docs, labelled)
    held = [(r, t) for r, t in zip(rows, dict(labels).values()) if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    x, y = np.array([O5.text_features(t, O5.Stems(learned)) for (_, t), _ in held]), np.array([t for _, t in held])
    accuracy = lambda w: ((O5.probability(x, w) >= 0.5) == y).mean()
    context = [1 + O5.LABELS.index(n) for n in ("aimed", "negated", "reported")]
    without = weights.copy()
    without[context] = 0
    assert accuracy(weights) > 0.95 and accuracy(without) < accuracy(weights) - 0.2
    refit = [k for k in range(x.shape[1]) if k + 1 not in context]
    assert ((O5.probability(x[:, refit], O5.fitted(x[:, refit], y, O5.DEFAULT[[0, *(k + 1 for k in refit)]])) >= 0.5) == y).mean() < 0.8  # even refitted to the answers


def test_toxicity_on_tables(spark):
    """Held-out rows of the smaller tables: few labels, so known insults carry most of it."""
    sf = "/root/testdata/sf0.01"
    docs, labelled = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = op5_toxicity.op5_toxicity(spark, sf).join(labelled, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    both = sum(r.toxic and r.predicted for r in got)
    assert both >= 0.5 * sum(r.toxic for r in got) and both >= 0.9 * sum(r.predicted for r in got)
    assert docs.count() == op5_toxicity.op5_toxicity(spark, sf).count()


def test_toxicity_learns_stems(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        text = [f"wort{rng.randrange(80)}" for _ in range(40)]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(40), f"zorg{rng.choice('abcdef')}")
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, "")]
    docs, labelled = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in op5_toxicity.scores(docs, *op5_toxicity.train(docs, labelled)).collect()}
    held = [(t, got[i].predicted) for i, t in labels if got[i].held_out]
    assert sum(t == p for t, p in held) / len(held) > 0.95
    assert got[2000].score == got[2001].score < 0.5
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_toxicity_without_labels(spark, edges, empty, wide):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = op5_toxicity.scores(edges, *op5_toxicity.train(edges, none)).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert op5_toxicity.scores(wide, *op5_toxicity.train(wide, none)).count() == len(EDGES)
    assert op5_toxicity.scores(empty, *op5_toxicity.train(empty, none)).count() == 0


# --- language model ----------------------------------------------------------------


@pytest.mark.parametrize("block", [op6_lm.BLOCK_BYTES, 20_000])
def test_lm_base_and_gain(spark, docs, block):
    text = {r.doc_id: r.text for r in docs.collect()}
    n = collections.Counter()
    for i, t in text.items():
        if zlib.crc32(str(i).encode()) % 10:
            n.update((t or "").encode().lower().split())
            n[None] += 1
    total, v = sum(n.values()), len(n)
    got = op6_lm.scores(docs, block_bytes=block).collect()
    for r in got:
        w = [*(text[r.doc_id] or "").encode().lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in n for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((n.get(x, 0) + 0.1) / (total + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def lm_brute(rows, weights):
    """Counts and interpolated scores in plain Python: an end before the first word, no two-word context there."""
    grams = [collections.Counter() for _ in range(3)]
    texts = {i: ["<e>", *(t or "").lower().split(), "<e>"] for i, t in rows}
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            for k in range(1, len(w)):
                grams[0][w[k]] += 1
                grams[1][w[k - 1], w[k]] += 1
                if k > 1:
                    grams[2][w[k - 2], w[k - 1], w[k]] += 1
    total, v = sum(grams[0].values()), len(grams[0])
    bucket = lambda c, cap: min(math.ceil(math.log2(c + 1)), cap)
    out = {}
    for i, w in texts.items():
        score = 0.0
        for k in range(1, len(w)):
            one, two = grams[0][w[k - 1]], grams[1][w[k - 2], w[k - 1]] if k > 1 else 0
            p = [1 / (v + 1), grams[0][w[k]] / total, grams[1][w[k - 1], w[k]] / one if one else 0, grams[2][w[k - 2], w[k - 1], w[k]] / two if two else 0]
            b = bucket(one, op6_lm.CONTEXT_CAPS[0]) * (op6_lm.CONTEXT_CAPS[1] + 1) + bucket(two, op6_lm.CONTEXT_CAPS[1])
            score += math.log10(sum(x * y for x, y in zip(weights[b], p)))
        out[i] = (sum(grams[0][x] > 0 for x in w[1:]), total, score)
    return out


@pytest.mark.parametrize("block", [op6_lm.BLOCK_BYTES, 60])
def test_lm_counts_and_scores_equal_brute_force(spark, block):
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(["a b a b", "a b c", None, "", "b b b b b", "x"] * 3)] + [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))) for i in range(20, 80)]
    docs = common.spill(spark.createDataFrame(rows, SCHEMA).repartition(2), "lm-test")
    counts, folder = op6_lm.corpus_counts(docs, block_bytes=block)
    words, tokens = counts.filter("block is null").agg(F.sum("words"), F.sum("tokens")).first()
    weights = op6_lm.learned(counts, folder, words, tokens)
    want = lm_brute(rows, weights)
    got = {r.doc_id: r for r in op6_lm.scores(docs, block_bytes=block).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.n_known, r.train_tokens) == want[i][:2] and r.score == pytest.approx(want[i][2], rel=1e-9)


def test_lm_counts_beyond_32_bits():
    hashes, counts = np.array([3, 9, 2**63], np.uint64), [np.array([5_000_000_000, 1, 2**40], np.uint64), np.array([4_000_000_000, 0, 7], np.uint64)]
    rows = [{"block": f"b{i}", "part": 0, "kind": k, "hashes": op6_lm.squeezed(np.diff(hashes, prepend=np.uint64(0))), "counts": op6_lm.squeezed(c)} for i, c in enumerate(counts) for k in range(3)]
    import pyarrow as pa

    got = op6_lm.answers(pa.Table.from_pylist(rows)).to_pylist()
    assert all(op6_lm.unsqueezed(r["counts"]).tolist() == [9_000_000_000, 1, 2**40 + 7] for r in got if r["block"])
    assert [(r["words"], r["tokens"]) for r in got if r["block"] is None] == [(3, 9_000_000_001 + 2**40 + 7)]


def test_lm_blocks_are_the_same_when_repeated(tmp_path):
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "train": [i % 3 > 0 for i in range(30)], "data": [f"w{i} a b c w{i % 7}".encode() for i in range(30)]})
    folder = f"file://{tmp_path}/blocks"
    op6_lm.make_folder(folder)
    once = [b.to_pydict() for b in op6_lm.asked([rows], folder, 4, 5, 100)]
    files = {p.name: p.read_bytes() for p in (tmp_path / "blocks").iterdir()}
    again = [b.to_pydict() for b in op6_lm.asked([rows.slice(0, 11), rows.slice(11)], folder, 4, 5, 100)]
    assert once == again and len(files) > 1 and {p.name: p.read_bytes() for p in (tmp_path / "blocks").iterdir()} == files


def test_clashing_columns(spark, edges, wide):
    shards = [op2_token_files.write_token_files(d, common.new_folder(spark, "tokens"), BYTE, 50_257) for d in (edges, wide)]
    rows = [sorted(map(str, op2_token_files.read_token_files(spark, x).collect())) for x in shards]
    assert rows[0] == rows[1]
    for op in (op6_lm.scores, lambda d: op7_bpe.round_trip(d, BYTE), lambda d: op8_packing.pack_documents(d, WORD).drop("sequence_id", "offset")):
        assert sorted(map(str, op(edges).collect())) == sorted(map(str, op(wide).collect()))


def test_lm_edges(edges, empty):
    assert op6_lm.scores(edges).count() == len(EDGES)
    assert op6_lm.scores(empty).count() == 0


def test_mixture_weights_sum_to_one():
    w = op6_lm.mixture_weights([(40, 100.0, 1.0, 5.0, 20.0, 300.0), (40, 50.0, 1.0, 5.0, 0.0, 0.0)])
    assert np.allclose(w.sum(1), 1) and w[40, 3] > w[40, 1] and w[0, 2] == w[0, 3] == 0


# --- pipeline ----------------------------------------------------------------------


def test_pipeline(spark, docs, sf_dir):
    import corpus_pipeline

    at, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.spill(stage(spark, at, sf_dir), "stage")
        assert at.columns == columns
        seen.append({r.doc_id: r.text for r in at.collect()})
    quality, exact, near, clean = seen
    assert set(clean) == set(near) <= set(exact) <= set(quality)
    least = {}
    for i, t in quality.items():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        least[key] = min(least.get(key, i), i)
    assert set(exact) == set(least.values())
    assert set(near) == {c for _, n, c in near_brute(sorted(exact.items()))}
    assert not any(base_brute(t) for t in clean.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(clean)
    check_packing(packed, 2048)
