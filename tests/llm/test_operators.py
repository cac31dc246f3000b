"""The ten operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.llm import words as words_module
from stratalog.llm import langid, media, mixing, near_dup, pieces, quality, queries, rans, secrets, substring_dedup, token_output, urls
from stratalog.llm.automaton import SuffixAutomaton
from stratalog.llm.words import blocks

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, vocabulary=400, mark="w"):
    return [f"{mark}{r.randrange(vocabulary)}" for _ in range(n)]


def fixture():
    """Texts with copies, near copies, shared passages, ties, repeated rows, nulls, empty and long ones."""
    r = random.Random(5)
    texts = [" ".join(prose(r, r.randrange(20, 160))) for _ in range(40)]
    passage = " ".join(prose(r, 70, mark="p"))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, f"{t} {passage} {' '.join(prose(r, 9))}") for i, t in enumerate(texts[:6])]
    rows += [(200 + i, texts[i]) for i in range(5)]
    for i in range(12):
        near = texts[7].split()
        near[r.randrange(len(near))] = "changed"
        rows.append((300 + i, " ".join(near)))
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "one two"), (405, "x" * 5000), (406, "a b c d e f g h " * 400), (7, texts[7]), (None, texts[3]), (None, None)]
    rows += [(407, "caf\u00e9 \u6f22\u5b57 \u2581 <|endoftext|> don't \U0001f389 \x00 A1b2  C3\r\n"), (408, "\u0130stanbul e\u0301 1/2 \u00bd")]
    return [(k, t, "en" if (k or 0) % 3 else None, "s", len(t or "")) for k, t in rows]


ROWS = fixture()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def test_words_are_those_of_the_pattern():
    batch = pa.record_batch({"text": pa.array([t for _, t, *_ in ROWS])})
    found = [[b.word(j).decode() for j in range(b.first[i], b.first[i + 1])] for b in blocks(iter([batch]), 700) for i in range(b.rows.num_rows)]
    assert found == [WORD.findall(t or "") for _, t, *_ in ROWS]


def mirrored(n, pair):
    """The sequence that turns each step into itself and its mirror image, and the same with both letters exchanged.

    Polynomials in any odd base agree on these two modulo 2**64 from some length on.
    """
    bits = np.array([0])
    while len(bits) < n:
        bits = np.append(bits, 1 - bits)
    return [[pair[x] for x in bits[:n]], [pair[1 - x] for x in bits[:n]]]


def test_names_of_words_and_texts_that_polynomials_confuse(spark):
    words = ["".join(x) for x in mirrored(2048, "ab")]
    texts = [" ".join(x) for x in mirrored(2048, ("yes", "no"))]
    found = list(blocks(iter([pa.record_batch({"text": pa.array([*words, *texts])})])))
    assert len(found) == 1 and len(set(found[0].hashes[:2].tolist())) == 2
    named = near_dup.names(found[0])[1]
    assert len(set(named)) == 4
    for size in (5, 50, 64, 1024):
        at, hashes = found[0].windows(size)
        own = [tuple(found[0].word(i + k) for k in range(size)) for i in at]
        assert len(set(hashes.tolist())) == len(set(own)) and len(set(zip(hashes.tolist(), own))) == len(set(own))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*words, *texts, words[0], texts[1]])], "doc_id long, text string")
    rows = [tuple(r) for r in frame.collect()]
    assert dict(map(tuple, near_dup.classes(frame).select("doc_id", "class_id").collect())) == {0: 0, 1: 1, 2: 2, 3: 2 if jaccard(*map(shingle_weights, texts)) >= 0.8 else 3, 4: 0, 5: 2 if jaccard(*map(shingle_weights, texts)) >= 0.8 else 3}
    assert Counter(map(tuple, substring_dedup.remove_repeats(frame).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == removed_by_force(rows, 50)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    coded = {r["key"]: np.frombuffer(r["ids"], "<u2").tolist() for r in token_output.encode_tokens(frame, P.path("word_bpe_49k.json")).collect()}
    assert all(coded[k] == [*whole.encode(t, add_special_tokens=False).ids, 1] for k, t in rows)
    assert all(r["lossless"] for r in pieces.encode_pieces(frame, P.path("piece_bpe_32k.model")).collect())


def test_colliding_hashes_change_nothing(monkeypatch):
    """Where the first hashes are all alike, bytes tell words apart, and other hashes are taken."""
    real, salts = words_module.byte_hashes, []

    def poor(data, sizes, salt=0):
        salts.append(salt)
        return real(data, sizes, salt) & np.uint64(0 if salt == 0 else 2**64 - 1)

    monkeypatch.setattr(words_module, "byte_hashes", poor)
    monkeypatch.setattr(token_output, "byte_hashes", poor)
    data = np.frombuffer(b"abcabdabcxyz", np.uint8)
    example, each = words_module.distinct_spans(data, np.array([3, 3, 3, 3]))
    assert [bytes(data[3 * i : 3 * i + 3]) for i in example[each]] == [b"abc", b"abd", b"abc", b"xyz"] and max(salts) == 1
    coder = token_output.RunCoder(P.path("word_bpe_49k.json"))
    block = next(blocks(iter([pa.record_batch({"text": pa.array([" ".join(prose(random.Random(1), 300))])})])))
    ids, _ = coder.encode(block)
    assert coder.salt == 1 and ids.tolist() == token_output._tokenizer(coder.path).encode(" ".join(prose(random.Random(1), 300)), add_special_tokens=False).ids


def test_known_runs_are_forgotten_when_they_are_too_many(monkeypatch):
    monkeypatch.setattr(token_output, "KNOWN_RUNS", 64)
    coder = token_output.RunCoder(P.path("word_bpe_49k.json"))
    r = random.Random(3)
    for n in (40, 40, 400, 30):
        text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
        ids, _ = coder.encode(next(blocks(iter([pa.record_batch({"text": pa.array([text])})]))))
        assert ids.tolist() == token_output._tokenizer(coder.path).encode(text, add_special_tokens=False).ids


# -- op1 --------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def shingle_weights(text):
    """tf of each shingle."""
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter({tuple(w): 1} if w else {})


def jaccard(a, b):
    return len(a.keys() & b.keys()) / len(a.keys() | b.keys())


def alike(a, b, factor):
    """The greater of weighted and plain Jaccard similarity, as a class is defined; factor gives a shingle's idf."""
    wa, wb = ({s: (1 + math.log(n)) * factor(s) for s, n in x.items()} for x in (a, b))
    return max(jaccard(a, b), sum(min(wa.get(s, 0), wb.get(s, 0)) for s in wa | wb) / sum(max(wa.get(s, 0), wb.get(s, 0)) for s in wa | wb))


def test_verification_is_by_the_weighted_or_the_plain_similarity(spark):
    """Pairs around the limit, with words that are rare and frequent, and repeated: each judged as by hand."""
    r = random.Random(21)
    common = prose(r, 60, 10**6)
    texts = []
    for k in range(60):
        own = prose(r, 80, 10**6) + common[: r.choice((0, 30, 60))] * r.choice((1, 1, 3))
        other = list(own)
        at = r.randrange(len(own) - 8)
        for _ in range(r.choice((1, 2, 3))):
            other[r.randrange(at, at + 8)] = f"x{r.randrange(10**6)}"
        if r.random() < 0.3:
            other = other + other[: r.randrange(10, 60)]
        texts += [own, other]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    factor = near_dup.document_frequencies(docs)
    batch = pa.record_batch({"text": pa.array([t for _, t in rows]), "doc_id": pa.array([i for i, _ in rows])})
    block = next(blocks(iter([batch]), 1 << 30))
    named = near_dup.names(block)[1]
    at, hashes = block.windows(5)
    of = {tuple(block.word(i + k).decode() for k in range(5)): float(factor[near_dup.bin_of(hashes[j : j + 1])[0]]) for j, i in enumerate(at)}
    pairs = spark.createDataFrame([(bytearray(named[2 * k + 1]), bytearray(named[2 * k])) for k in range(60)], "a binary, b binary")
    got = {bytes(x["b"]): x["similar"] for x in near_dup.verify(pairs, near_dup.shingle_sets(docs).dropDuplicates(["name"]), factor, 0.8).collect()}
    true = [alike(shingle_weights(rows[2 * k][1]), shingle_weights(rows[2 * k + 1][1]), of.__getitem__) for k in range(60)]
    assert {x >= 0.8 for x in true} == {True, False}
    assert all(got[named[2 * k]] == (x >= 0.8) for k, x in enumerate(true) if abs(x - 0.8) > 1e-6)


def test_a_mixed_bucket_loses_no_link(spark):
    """Forty texts with a near copy each, all in one bucket: more rounds than a few, and each pair is found."""
    r = random.Random(5)
    rows = []
    for k in range(40):
        own = [f"w{k}_{r.randrange(10**6)}" for _ in range(120)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    factor = near_dup.document_frequencies(docs)
    named = near_dup.sketch(docs, factor).select("doc_id", "name").cache()
    of = {bytes(x["name"]): x["doc_id"] for x in named.collect()}
    links = near_dup.links_of(named.select("name", F.array(F.lit(1).cast("long")).alias("bands")), docs, factor, 0.8).collect()
    assert sorted(tuple(sorted((of[bytes(x["a"])], of[bytes(x["b"])]))) for x in links) == [(2 * k, 2 * k + 1) for k in range(40)]


@pytest.mark.parametrize("part", [1 << 18, 500])
def test_a_bucket_of_chains_is_one_class_each(spark, monkeypatch, part):
    """Chains of texts, each near the next only, all in one bucket: whoever leads, a text that is taken still meets the others."""
    monkeypatch.setattr(near_dup, "PART_SHINGLES", part)
    r = random.Random(7)
    rows = []
    for k in range(12):
        own = [f"w{k}_{r.randrange(10**6)}" for _ in range(220)]
        rows += [(10 * k + i, " ".join(own[12 * i : 12 * i + 130])) for i in range(1 + k % 6)]
    sets = {i: shingle_set(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(50, 51) >= 0.8 > alike(50, 52)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    factor = near_dup.document_frequencies(docs)
    named = near_dup.sketch(docs, factor).select("doc_id", "name").cache()
    of = {bytes(x["name"]): x["doc_id"] for x in named.collect()}
    links = near_dup.links_of(named.select("name", F.array(F.lit(1).cast("long")).alias("bands")), docs, factor, 0.8)
    found = defaultdict(set)
    for x in near_dup.components(links).collect():
        found[x["root"]].add(of[bytes(x["name"])])
    assert all(alike(of[bytes(x["a"])], of[bytes(x["b"])]) >= 0.79 for x in links.collect())
    assert sorted(map(sorted, found.values())) == [[10 * k + i for i in range(1 + k % 6)] for k in range(12) if k % 6]


def test_near_duplicates_match_brute_force(docs):
    sets = [shingle_set(t) for _, t, *_ in ROWS]
    parent = list(range(len(ROWS)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, *_) in enumerate(ROWS):
        if k is not None:
            least[root(i)].append(k)
    expected = Counter((k, min(least[root(i)], default=None)) for i, (k, *_) in enumerate(ROWS))
    assert Counter(map(tuple, near_dup.classes(docs).select("doc_id", "class_id").collect())) == expected


def test_weighted_jaccard_and_sampling_agree():
    r = np.random.default_rng(3)
    hashes = np.sort(r.integers(0, 2**63, 400).astype(np.uint64))
    a, b = np.sort(hashes[:300]), np.sort(hashes[40:])
    weight = {int(h): float(w) for h, w in zip(hashes, r.uniform(0.5, 2.5, 400).astype(np.float32))}
    wa, wb = (np.array([weight[int(h)] for h in x], np.float32) for x in (a, b))
    variates = near_dup._variates() * 1
    _, out = near_dup.draws(np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)]), np.concatenate([a, b]), np.concatenate([wa, wb]), variates)
    both = sum(weight[int(h)] for h in set(a.tolist()) & set(b.tolist()))
    true = both / (wa.sum() + wb.sum() - both)
    assert abs((out[0] == out[1]).mean() - true) < 3.5 * math.sqrt(true * (1 - true) / len(variates))


def test_texts_that_differ_in_repetitions_are_one_class(spark):
    """A text written ten times has a plain similarity near 1 with itself, and a weighted one of about 0.3."""
    r = random.Random(4)
    rows = []
    for k in range(20):
        own = " ".join(prose(r, 150, 10**6))
        rows += [(2 * k, own), (2 * k + 1, " ".join([own] * 10))]
    found = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id")
    assert {tuple(x) for x in found.collect()} == {(i, i - i % 2) for i in range(40)}


def test_recall_just_above_the_limit(spark):
    """Pairs of similarity 0.815: four words of two hundred differ. Hardly any is missed."""
    r = random.Random(51)
    rows = []
    for k in range(300):
        own = prose(r, 200, 10**7)
        other = list(own)
        for j in range(4):
            other[20 + 50 * j] = f"x{k}_{j}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    assert abs(len(shingle_set(rows[0][1]) & shingle_set(rows[1][1])) / len(shingle_set(rows[0][1]) | shingle_set(rows[1][1])) - 0.8148) < 1e-3
    found = dict(map(tuple, near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()))
    assert all(found[2 * k] == 2 * k for k in range(300)) and sum(found[2 * k + 1] == 2 * k for k in range(300)) >= 297


def test_least_hashes_agree_as_often_as_the_plain_similarity():
    r = np.random.default_rng(6)
    hashes = r.integers(0, 2**64, 400, dtype=np.uint64)
    a, b = np.sort(hashes[:300]), np.sort(hashes[100:])
    out = near_dup.least_hashes(np.repeat([0, 1], 300), np.concatenate([a, b]), 400)
    assert abs((out[0] == out[1]).mean() - 0.5) < 3.5 * math.sqrt(0.25 / 400)


def test_keep_first_keeps_one_of_each_class(docs):
    kept = Counter(r["doc_id"] for r in near_dup.keep_first(docs).collect())
    first = {r["class_id"] for r in near_dup.classes(docs).collect() if r["class_id"] is not None}
    assert kept == Counter(first) + Counter({None: 2})


def test_keep_first_keeps_each_class_of_a_shared_doc_id(spark):
    """Dissimilar texts under one doc_id are a class each, and none is lost."""
    r = random.Random(8)
    texts = [" ".join(prose(r, 90, 10**6)) for _ in range(6)]
    rows = [(1, t) for t in texts] + [(1, texts[0]), (2, texts[1]), (0, texts[2]), (3, " "), (3, " "), (3, None)]
    kept = near_dup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(1, t) for t in texts if t != texts[2]] + [(0, texts[2]), (3, " "), (3, " "), (3, None)])


# -- op2 --------------------------------------------------------------------------------------------------------


def test_listed_rules_and_parts(spark):
    given = [
        ("https://Blog.Example.ORG/es/1?x#y", "blog.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://notexample.org", "notexample.org", "", None, "allow"), ("x://com/fr/", "com", "/fr/", "com/fr/", "allow"),
        ("http://a.com/de/x://b.org/", "a.com", "/de/x://b.org/", "com/de/", "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://\u00c4.ORG/\n/x", "\u00c4.org", "/\n/x", "org/", "allow"),
    ]
    pages = spark.createDataFrame([(i, g[0], "h") for i, g in enumerate(given)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in urls.judge(pages, spark.createDataFrame([], LABELS)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(given):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, rule, verdict), given[i]


def test_mined_rules_match_brute_force(spark):
    r = random.Random(2)
    pages, labels = [], []
    for i in range(300):
        spam = r.random() < 0.3
        host = r.choice(["cheap.shop.net", "win.net"] if spam else ["news.net", "blog.net", "win.net"])
        pages.append((i, f"http://{host}/{r.choice('abc')}/{r.randrange(99)}" + ("?pay=1" if spam and r.random() < 0.8 else ""), ""))
        if i % 2:
            labels.append((i, 0 if spam else 1, 0))
    pages += [(0, pages[0][1], ""), (None, None, ""), (900, "http://cheap.shop.net/zz", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: r["mined"] for r in urls.judge(frame, spark.createDataFrame(labels, LABELS)).collect()}
    tokens = {u: set(spark.createDataFrame([(u,)], "url string").select(urls.tokens_of(urls.F.col("url"), urls.host_of(urls.F.col("url")), urls.path_of(urls.F.col("url")))).first()[0]) for u in {u for _, u, _ in pages if u}}
    bad = {i: q == 0 for i, q, _ in labels}
    known = [(tokens[u], bad[i]) for i, u, _ in dict.fromkeys(pages) if i in bad]
    least = max(urls.MIN_COUNT, math.ceil(len(known) * urls.MIN_SUPPORT))
    single = {t for t, n in Counter(t for ts, _ in known for t in ts).items() if n >= least}
    rules = []
    for pick in {frozenset(p) for ts, _ in known for size in range(1, 10) for p in itertools.combinations(sorted(ts & single), size)}:
        n, k = sum(pick <= ts for ts, _ in known), sum(pick <= ts and y for ts, y in known)
        if k >= least and k / n >= urls.MIN_CONFIDENCE:
            rules.append(pick)
    assert rules and found[900]
    assert found == {i: bool(u) and any(p <= tokens[u] for p in rules) for i, u, _ in pages}


def test_long_urls_are_mined_whole(spark):
    """Rules on the rarest tokens of long URLs are found, and long good URLs count against those of short ones."""
    common = "".join(f"&c{k}=1" for k in range(14))
    made = [(f"http://a.b.net/x?u=1{common}" + ("&evil=1" if i < 12 else ""), i < 12) for i in range(60)]
    made += [("http://a.b.net/x?trap=1", True) for _ in range(9)] + [(f"http://a.b.net/x?trap=1{common}", False) for _ in range(9)]
    made += [(f"http://a.b.net/x?left=1{common}{r}", bad) for r, bad, n in (("&right=1", True, 9), ("", False, 9)) for _ in range(n)] + [(f"http://a.b.net/x?right=1{common}", False) for _ in range(9)]
    pages = spark.createDataFrame([(i, u, "") for i, (u, _) in enumerate(made)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(made)], LABELS)
    tokens = urls.tokens_of(F.col("url"), urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    rows = pages.join(labels, pages.page_id == labels.doc_id).select("page_id", tokens.alias("tokens"), (F.col("quality") == 0).alias("bad")).withColumn("row", F.struct("page_id"))
    known = [(set(r["tokens"]), r["bad"]) for r in rows.collect()]
    single = {t for t, n in Counter(t for ts, _ in known for t in ts).items() if n >= urls.MIN_COUNT}
    rules = {}
    for pick in {tuple(sorted({a, b, c})) for ts, _ in known for a in ts & single for b in ts & single for c in ts & single}:
        n, k = sum(set(pick) <= ts for ts, _ in known), sum(set(pick) <= ts and y for ts, y in known)
        if k >= urls.MIN_COUNT and k / n >= urls.MIN_CONFIDENCE:
            rules[pick] = (n, k / n)
    smaller = lambda p: [q for q in rules if set(q) < set(p)]
    expected = {p: x for p, x in rules.items() if all(rules[q][1] < x[1] for q in smaller(p))}
    assert ("q:evil",) in expected and ("q:left", "q:right") in expected and ("q:trap",) not in expected
    assert {tuple(r["tokens"]): (r["n"], r["confidence"]) for r in urls.mine(rows).collect()} == expected
    found = {r["page_id"]: r["mined"] for r in urls.judge(pages, labels).collect()}
    assert found == {i: any(set(p) <= ts for p in rules) for i, ts in ((r["page_id"], set(r["tokens"])) for r in rows.collect())}


def test_rules_of_many_tokens_and_of_tokens_that_go_together(spark):
    """Only four tokens together tell bad URLs; ten tokens that always go together are one item, and any of them stands for it elsewhere."""
    made = []
    for k in range(96):
        own = [x for i, x in enumerate("abcd") if k >> i & 1]
        made.append((f"http://one.two.three.net/x/y?{'&'.join(f'{x}=1' for x in own)}", len(own) == 4))
    made += [("http://one.two.three.net/x/y?" + "&".join(f"z{j}=1" for j in range(30)), True) for _ in range(6)]
    pages = [(i, u, "") for i, (u, _) in enumerate(made)] + [(500, "http://else.org?z17=2", ""), (501, "http://else.org?a&b&c", ""), (502, "http://else.org?d&c&b&a", ""), (503, "http://else.org/" + "long/" * 3000 + "?z3", "")]
    found = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame([(i, 1 - int(b), 0) for i, (_, b) in enumerate(made)], LABELS))
    mined = {r["page_id"]: r["mined"] for r in found.collect()}
    assert {i: mined[i] for i, (_, b) in enumerate(made)} == {i: b for i, (_, b) in enumerate(made)}
    assert [mined[i] for i in (500, 501, 502, 503)] == [True, False, True, True]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_registered_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    expected = connection.execute(queries.ORACLES[name])
    names = [d[0] for d in expected.description]
    found = queries.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(names) and Counter(map(tuple, found.select(*names).collect())) == Counter(expected.fetchall())


# -- op3 --------------------------------------------------------------------------------------------------------


def secret_rows():
    r = random.Random(9)
    key = lambda n: "".join(r.choice("ABCDEFGHJKabcdefgh0123456789+/") for _ in range(n))
    out = []
    for i in range(160):
        kind = i % 4
        secret = f'api_key = "{key(24)}"' if kind == 0 else f"AKIA{''.join(r.choice('ABCDEF0123456789') for _ in range(16))}" if kind == 1 else "verylongplainwordof" + "letters" * 2 if kind == 2 else "4785380592391139"
        out.append((i, f"some words {secret} and more words {i}"))
    return out + [(500, None), (501, ""), (502, "token: password: abcdefgh"), (503, 'SECRET="x"; Passwd :: y'), (504, "\u00e9 token=" + "0" * 40), (505, "k" * 3000)]


def test_secrets(spark):
    frame = spark.createDataFrame(secret_rows(), "doc_id long, text string")
    net = secrets.fit(frame)
    assert net is not None and 0 < net.threshold <= 1
    rows = {r["doc_id"]: r for r in secrets.scan(frame, net).collect()}
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, text in secret_rows():
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        base = ",".join(f"{secrets.KINDS[n]}:{s}:{e}" for s, n, e in sorted(spans))
        assert rows[k]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [rows[k][f"n_{x}"] for x in ("assign", "access", "hex")] == [sum(n == j for _, n, _ in spans) for j in range(3)]
        assert set(filter(None, base.split(","))) <= set(rows[k]["spans"].split(","))
    hidden = [secrets.codes(t, *m.span()) for t in ["see Zk8Q+hD3gB7eAa0c9fEd1bKj there"] for m in re.finditer(r"[A-Za-z0-9+]{16,}", t)]
    plain = [secrets.codes(t, *m.span()) for t in ["a verylongplainwordofletters b"] for m in re.finditer(r"[a-z]{16,}", t)]
    assert net.probabilities(hidden)[0] > net.probabilities(plain)[0]
    clean = secrets.redact(frame.withColumn("n_chars", urls.F.lit(1)), net).collect()
    assert all("AKIA" not in (r["text"] or "") for r in clean) and {r["doc_id"]: r["text"] for r in clean}[500] is None


def test_the_network_finds_what_the_patterns_miss(spark):
    """Keys without key words, in alphabets that no pattern has, beside long words, numbers and paths."""
    r = random.Random(11)
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(r.choice(("en", "tion", "ver", "ich", "the", "ou", "re", "la", "qu")) for _ in range(7))
    text = lambda *more: " ".join(x for w in more for x in (*prose(r, 4), w))
    rows = [(i, text(f'token = "{hexed(40)}"', word(), f"{r.randrange(10**15, 10**16)}", word().capitalize())) for i in range(300)]
    kinds = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789")
    hidden = ["".join(r.choice(kinds[i % 3]) for _ in range(32)) for i in range(150)]
    planted = [(1000 + i, text(word(), k, word())) for i, k in enumerate(hidden)]
    frame = spark.createDataFrame(rows + planted, "doc_id long, text string")
    found = {x["doc_id"]: x for x in secrets.scan(frame, secrets.fit(frame.where("doc_id < 1000"))).collect()}
    where = {k: f"network:{t.index(h)}:{t.index(h) + 32}" for (k, t), h in zip(planted, hidden)}
    hits = sum(s in found[k]["spans"].split(",") for k, s in where.items())
    wrong = sum(x["n_network"] for x in found.values()) - hits
    assert hits >= 0.75 * len(hidden) and wrong <= 0.02 * len(hidden), (hits, wrong)
    assert sum(x["n_confirmed"] for x in found.values()) >= 0.95 * 300


def test_runs_without_end_are_scored_in_batches(spark):
    net = secrets.Network.fresh(2)
    r = np.random.default_rng(0)
    found = [secrets.codes("x " + "".join(map(chr, r.integers(97, 123, n))) + " y", 2, 2 + n) for n in (20, 5000, 60_000, 17)]
    whole = net.pooled(found)[0] @ net.out + net.shift
    assert np.allclose(net.logits(iter(found)), whole)


def test_candidates_are_those_that_no_base_span_touches():
    r = random.Random(17)
    for _ in range(300):
        text = "".join(r.choice(("a" * 20, " ", "0123456789abcdef" * 2, "AKIA" + "B" * 16, "token=", "-", "k" * 9)) for _ in range(r.randrange(12)))
        base = secrets.base_spans(text)
        runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text)]
        assert secrets.candidates(text, base) == [(s, e) for s, e in runs if not any(a < e and b > s for _, a, b in base)]


def test_network_gradient():
    net = secrets.Network.fresh(1)
    found = [secrets.codes(t, 2, len(t) - 1) for t in ("ab cdef1234 x", "zz yyyyyyyyyy q", "0123456789" * 20)]
    label = np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(label * np.log(p := net.probabilities(found)) + (1 - label) * np.log(1 - p))
    for name, g in zip(("embed", "role", "kernel", "bias", "out", "shift"), net.step(found, label)):
        value = getattr(net, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))
        value[at] += 1e-5


def test_findings_of_every_row_and_length_are_learned(spark):
    """More rows and findings than any sample had, and findings longer than it took."""
    r = random.Random(23)
    rows = [(i, f"number {10**15 + i} or " + ("".join(r.choice("0123456789abcdef") for _ in range(40)) if i % 6 == 0 else "none")) for i in range(24_000)]
    rows += [(-1, "k" * 700 + " " + "ab12" * 200), (-2, None)]
    expected = set()
    for _, text in rows:
        base = secrets.base_spans(text or "")
        expected |= {(*form, 1) for span in base for form in secrets.shown(text, span)}
        low = lambda start: max(0, start - secrets.CONTEXT)
        runs = [(s, e) for s, e in secrets.candidates(text or "", base) if not secrets.shaped(text[s:e])]
        expected |= {(text[low(s) : e + secrets.CONTEXT], s - low(s), e - low(s), 0) for s, e in runs}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.labelled_findings(frame).drop("aside").collect()
    assert len(found) == len(expected) > 30_000 and {tuple(x) for x in found} == expected


def test_secrets_that_are_all_long_are_learned(spark):
    r = random.Random(29)
    rows = [(i, f"{'token=' + ''.join(r.choice('0123456789abcdef') for _ in range(600))} beside {'plainword' * 4}{i % 7 * 'o'} {10**15 + i}") for i in range(80)]
    assert secrets.fit(spark.createDataFrame(rows, "doc_id long, text string")) is not None


def test_a_network_of_many_shards(spark, monkeypatch):
    """Learned in parts, it parts the labels, and a second run gives the very same."""
    monkeypatch.setattr(secrets, "SHARD", 64)
    r = random.Random(31)
    rows = [(i, f"words {''.join(r.choice('0123456789abcdef') for _ in range(40))} and {''.join(r.choice(('en', 'tion', 'ver', 'ich')) for _ in range(8))} x") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    net, again = secrets.fit(frame), secrets.fit(frame.repartition(7))
    assert np.array_equal(net.weights(), again.weights()) and (net.scale, net.offset, net.threshold) == (again.scale, again.offset, again.threshold)
    both = [net.probabilities([secrets.codes(t, *m.span()) for _, t in rows for m in re.finditer(pattern, t)]) for pattern in ("[0-9a-f]{40}", "[a-z]{16,}")]
    assert (both[0] >= net.threshold).mean() > 0.95 and (both[1] >= net.threshold).mean() < 0.02


def test_scale_and_threshold_against_a_plain_count(spark):
    r = np.random.default_rng(37)
    z = np.concatenate([r.normal(-1, 1, 300), r.normal(1, 1, 200), [0.0, -0.0, 1e300, -1e-300]])
    label = np.array([0] * 300 + [1] * 204)
    frame = spark.createDataFrame([(float(x), int(o), int(y)) for x, o, y in zip(z, secrets._ordered(z.view(np.int64)), label)], "z double, order long, label long")
    for rank in (0, 7, 250, 503):
        assert secrets._ranked(frame, rank) == np.sort(z)[rank]
    near = frame.where("abs(z) < 10")
    z, label = (np.array([x[c] for x in near.select("z", "label").collect()]) for c in ("z", "label"))
    n = int((label == 0).sum()), int(label.sum())
    a, b = secrets._platt(near, n)
    goal = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    error = secrets.sigmoid(a * z + b) - goal
    assert abs((error * z).sum() + 1e-3 * a) < 1e-5 and abs(error.sum()) < 1e-5 and a > 0


def test_too_few_findings_train_nothing(spark):
    assert secrets.fit(spark.createDataFrame([(1, "plain")], "doc_id long, text string")) is None
    assert secrets.fit(spark.createDataFrame([], "doc_id long, text string")) is None


# -- op4 --------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs, spark):
    stored = media.store(docs).cache()
    rows = {(r["doc_id"], r["n_bytes"]): r for r in media.read_back(stored).collect()}
    for k, t, *_ in ROWS:
        raw = (t or "").encode()
        want = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        r = rows[k, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    packets = media.packet_table(stored.where("key = 405"), "key", "media").orderBy("packet").collect()
    file = stored.where("key = 405").first()["media"]
    assert b"".join(bytes(file[p["offset"] : p["offset"] + p["size"]]) for p in packets).rstrip() == b"x" * 5000
    assert [p["timestamp"] for p in packets] == [40 * i for i in range(len(packets))]


@pytest.mark.parametrize("lacing", [media.XIPH_LACING, media.EBML_LACING, media.FIXED_LACING, media.NO_LACING])
def test_lacings_and_unknown_sizes(lacing):
    frames = [bytes([i]) * n for i, n in enumerate((700, 255, 3, 510))] if lacing in (1, 3) else [b"a" * 9, b"b" * 9] if lacing == 2 else [b"abc"]
    if lacing == media.XIPH_LACING:
        head = bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
        payload = head + b"".join(frames)
    else:
        kind, payload = media.lace(frames)
        assert kind == lacing
    block = media.element(media.SIMPLE_BLOCK, b"\x81", (5).to_bytes(2, "big"), bytes([lacing << 1]), payload)
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, b"\x81", (7).to_bytes(2, "big"), b"\0", b"zz"))
    cluster = media.element_id(media.CLUSTER) + b"\x01" + b"\xff" * 7 + media.uint(media.CLUSTER_TIMESTAMP, 100) + block + group
    file = media.element(media.EBML, media.element(media.DOC_TYPE, b"webm")) + media.element_id(media.SEGMENT) + b"\xff" + cluster + cluster
    parsed = media.parse(file)
    assert [file[a : a + n] for *_, a, n in parsed.packets] == [*frames, b"zz"] * 2 and parsed.packets[0][1] == 105 and parsed.doc_type == "webm"
    with pytest.raises(ValueError):
        media.parse(media.element(media.SEGMENT, block)[:-1])


def test_a_damaged_file_is_one_row(spark):
    good = media.write(media.padded(b"some samples"))
    rows = [(1, bytearray(good)), (2, bytearray(good[:-3])), (3, bytearray(b"\x00\x00")), (4, None), (None, bytearray(good)), (5, bytearray(b"")), (6, bytearray(good[:40] + b"\xff" * 9 + good[49:]))]
    found = media.packet_table(spark.createDataFrame(rows, "id long, file binary"), "id", "file").collect()
    by = {k: [x for x in found if x["key"] == k] for k in (1, 2, 3, 4, 5, None)}
    assert len(by[1]) == len(by[None]) == 1 and by[1][0]["size"] == 192 and by[1][0]["error"] is None and by[4] == by[5] == []
    assert all(len(by[k]) == 1 and by[k][0]["error"] and by[k][0]["packet"] is None for k in (2, 3))


# -- op5 --------------------------------------------------------------------------------------------------------


def removed_by_force(rows, size):
    starts = defaultdict(lambda: math.inf)
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            if k is not None:
                starts[tuple(w[i : i + size])] = min(starts[tuple(w[i : i + size])], k)
    out = []
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - size + 1) if k is not None and starts[tuple(w[i : i + size])] < k for j in range(i, i + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size", [50, 12])
def test_repeats_match_brute_force(docs, size):
    found = substring_dedup.remove_repeats(docs, size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == removed_by_force(ROWS, size)


def test_automaton_matches_brute_force():
    r = random.Random(1)
    for _ in range(300):
        seqs = [(r.randrange(6), [r.randrange(2) for _ in range(r.randrange(14))]) for _ in range(r.randrange(5))]
        words, size, owner = [r.randrange(2) for _ in range(r.randrange(14))], r.randrange(1, 6), r.randrange(7)
        expected = [i for i in range(len(words) - size + 1) if any(o < owner and s[j : j + size] == words[i : i + size] for o, s in seqs for j in range(len(s) - size + 1))]
        assert SuffixAutomaton(seqs).windows_before(words, size, owner) == expected


def test_rows_that_share_a_doc_id_keep_their_own_spans(spark):
    """Two texts under one doc_id: spans of the one are no spans of the other, and neither is earlier than the other."""
    r = random.Random(14)
    a, b, c = (prose(r, 70, 10**6) for _ in range(3))
    rows = [(1, " ".join(a)), (1, " ".join(b + a)), (2, " ".join(c[:9] + a)), (2, " ".join(a + c)), (2, " ".join(c)), (2, " ".join(c)), (0, " ".join(c[:55]))]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == removed_by_force(rows, 50)


def test_long_passages_and_shared_shards(spark, monkeypatch):
    """Passages longer than a piece, words that repeat within a text, many documents past few small shards."""
    monkeypatch.setattr(substring_dedup, "PIECE", 40)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 300)
    monkeypatch.setattr(substring_dedup, "TURN_WORDS", 500)
    r = random.Random(15)
    long, again = prose(r, 400, 10**6), prose(r, 7, 10**6) * 40
    rows = [(0, " ".join(long)), (1, " ".join(again)), (2, " ".join(again[3:200] + long))]
    rows += [(10 + i, " ".join(prose(r, 20, 10**6) + long[10 * i : 10 * i + 90] + again[: r.randrange(30, 90)] + prose(r, 5, 10**6))) for i in range(30)]
    rows += [(100 + i, " ".join(long[:200] + [f"e{i}"] + long[200:])) for i in range(30)]
    for size in (50, 12):
        found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), size).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert Counter(map(tuple, found.collect())) == removed_by_force(rows, size)


def test_reference_spans(docs, spark):
    reference = spark.createDataFrame([(ROWS[40][1],), (None,), ("",)], "text string")
    found = Counter(map(tuple, substring_dedup.remove_reference_spans(docs, reference, 12).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    known = {tuple(w[i : i + 12]) for w in [WORD.findall(ROWS[40][1])] for i in range(len(w) - 11)}
    expected = Counter()
    for k, t, *_ in ROWS:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - 11) if tuple(w[i : i + 12]) in known for j in range(i, i + 12)}
        expected[k, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    assert found == expected


# -- op6 --------------------------------------------------------------------------------------------------------


def test_language(spark):
    r = random.Random(4)
    syllables = {"aa": "ka lo mi ne tu".split(), "bb": "schu wer gen ich ung".split()}
    rows = [(i, " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 5))) for _ in range(30)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !?", "bb"), (903, "ka lo mi", None), (None, "schuwer", "bb")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out())
    model = langid.fit(frame.where("NOT held_out"))
    found = {r["doc_id"]: r for r in langid.predict(frame, model, ["doc_id", "held_out"]).collect()}
    held = [(k, lang) for k, _, lang in rows[:200] if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all(found[k]["held_out"] and found[k]["lang_pred"] == lang for k, lang in held)
    assert [found[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and all(0 <= r["score"] <= 1 for r in found.values()) and not found[None]["held_out"]
    names = ["score", "Score", "__text", "lang_pred", "LANG_PRED", "unit", "n"]
    clash = frame.select("*", *[F.lit(n).alias(f"{n}{i}" if n in ("Score", "LANG_PRED") else n) for i, n in enumerate(names)])
    clash = clash.withColumnRenamed("score", "Score")
    kept = langid.reject_undetermined(clash)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} & {900, 901, 902} == set() and kept.first()["Score"] == "score"


def plain_language(labelled, texts):
    """The method with dictionaries, one word at a time."""
    def words(t):
        return re.findall(r"[^\W\d_]+", (t or "").lower())

    def grams(w, n):
        padded = f" {w} " if n > 1 else w
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    languages = sorted({x for _, x in labelled})
    units = {0: defaultdict(Counter), **{n: defaultdict(Counter) for n in langid.ORDERS}}
    for t, lang in labelled:
        for w in words(t):
            units[0][w][lang] += 1
            for n in langid.ORDERS:
                for g in grams(w, n):
                    units[n][g][lang] += 1
    scores = {}
    for n, found in units.items():
        found = {u: c for u, c in found.items() if sum(c.values()) >= langid.LEAST_SEEN}
        total = {x: sum(c[x] + langid.SMOOTHING for c in found.values()) for x in languages}
        raw = {u: [math.log(c[x] + langid.SMOOTHING) - math.log(total[x]) for x in languages] for u, c in found.items()}
        scores[n] = {u: [v - sum(r) / len(r) for v in r] for u, r in raw.items()}
    out = []
    for t in texts:
        total, own = [0.0] * len(languages), words(t)
        for w in own:
            if w in scores[0]:
                found = scores[0][w]
            else:
                found = [0.0] * len(languages)
                for n in langid.ORDERS:
                    if known := [scores[n][g] for g in grams(w, n) if g in scores[n]]:
                        found = [sum(x) / len(known) for x in zip(*known)]
                        break
            total = [a + b for a, b in zip(total, found)]
        if not own:
            out.append(("und", 0.0))
            continue
        best = max(range(len(languages)), key=lambda i: (total[i], -i))
        scaled = [x / len(own) * min(len(own), langid.EVIDENCE) for x in total]
        share = [math.exp(x - max(scaled)) for x in scaled]
        out.append((languages[best], share[best] / sum(share)))
    return out


def test_language_matches_a_plain_version(spark, monkeypatch):
    """Words known and unseen, of one letter and of many scripts; blocks of any size give the same."""
    r = random.Random(31)
    letters = {"aa": "abcdefghij", "bb": "fghijklmno\u00e9\u00fc", "cc": "\u0430\u0431\u0432\u0433\u0434ab", "dd": "\u4e2d\u6587\u5b57\U00020000"}
    word = lambda lang: "".join(r.choice(letters[lang]) for _ in range(r.randrange(1, 9)))
    known = {lang: [word(lang) for _ in range(30)] for lang in letters}
    text = lambda lang: " ".join(r.choice(known[lang]).title() if r.random() < 0.5 else word(lang) for _ in range(r.randrange(1, 25))) + r.choice(("", "!", " 12\u0663_", "\n"))
    rows = [(i, text(lang), lang) for i in range(160) for lang in [r.choice("aa bb cc dd".split())]]
    rows += [(500, None, "aa"), (501, " 7 _ ", "bb"), (502, "z", "cc"), (503, "\u0130 \u00df", "aa"), (504, text("bb"), None), (505, "q" * 3000, "bb"), (3, rows[3][1], rows[3][2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(frame)
    expected = plain_language([(t, x) for _, t, x in rows if t is not None and x is not None], [t for _, t, _ in rows])
    for block in (1, 50, 1 << 20):
        lang, score = [], []
        for _, part in langid.blocks_of(pa.array([t for _, t, _ in rows]), block):
            a, b = model.predict(part)
            lang, score = lang + a, score + b.tolist()
        assert np.allclose(score, [x for _, x in expected], atol=2e-5)
        assert all(a == b or s < 0.5001 for a, (b, s) in zip(lang, expected))


# -- op7 --------------------------------------------------------------------------------------------------------


def test_token_blocks(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    tokens = token_output.encode_tokens(docs, path)
    token_output.write_blocks(tokens.cache(), str(tmp_path / "b"), partitions=3)
    rows = sorted(map(tuple, token_output.read_blocks(spark, str(tmp_path / "b")).collect()), key=lambda r: r[1])
    expected = Counter((k, bytes(np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))) for k, t, *_ in ROWS)
    assert Counter((k, bytes(ids)) for k, *_, ids in rows) == expected
    at = 0
    for k, start, n, crc, ids in rows:
        assert start == at and n == len(ids) // 4 and crc == zlib.crc32(bytes(ids))
        at += n
    assert [r[0] or -1 for r in rows] == sorted(r[0] or -1 for r in rows)


def test_rans_round_trip_and_checkpoints():
    r = np.random.default_rng(0)
    for n in (0, 1, rans.LANES + 1, 200_000):
        s = np.minimum(r.zipf(1.3, n), 4000).astype(np.uint32)
        t = rans.Table(rans.quantise(np.bincount(s, minlength=4001) if n else np.ones(2)))
        raw = rans.encode(s, t)
        marks = rans._HEAD.unpack_from(raw)[3]
        for k in range(marks):
            assert (rans.decode(raw, t, k) == s[k * rans.CHECKPOINT_STEPS * rans.LANES :]).all()
        with pytest.raises(ValueError):
            rans.decode(raw[:-1] + bytes([raw[-1] ^ 1]), t)


# -- op8 and op9 ------------------------------------------------------------------------------------------------


def labelled(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        kind = i % 3
        rows.append((i, " ".join(prose(r, 40, mark="abc"[kind]) + (["###"] * 30 if kind == 1 else [])), "en", "s", 0))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (None, "a1 a2", "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(1, 0, 0), (None, 1, 0), (5000, 1, 0)], LABELS)


def test_mixing_reaches_its_targets(spark):
    docs, labels = labelled(spark)
    found = mixing.with_posteriors(docs, labels, ["doc_id"])
    fit = mixing.fit_rates(found, mixing.TARGETS)
    got, now, target = fit.rows.collect(), fit.expected, fit.target
    assert fit.met
    assert len(got) == 244 and found.domains == ["clean", "junk", "toxic"] and all(r["rate"] >= 0 for r in got)
    total = sum(target.values())
    for k, d in enumerate(found.domains):
        assert abs(sum(r["rate"] * r["tokens"] * r["posterior"][k] for r in got) - target[d]) <= 2.1e-3 * target[d] and abs(now[d] - target[d]) <= 2e-3 * target[d]
    assert abs(total - sum(r["tokens"] for r in got)) < 1e-6 * total
    one = mixing.with_posteriors(docs, spark.createDataFrame([], LABELS), ["doc_id"])
    assert one.domains == ["all"] and {r["rate"] for r in mixing.fit_rates(one, {}).rows.collect()} == {1.0}


def test_mixing_agrees_with_a_plain_solver(spark):
    """Random posteriors: the targets are met wherever some nonnegative rates meet them, and what can't be met is said to be so."""
    r = np.random.default_rng(2)
    p = r.dirichlet([0.4, 0.4, 0.4], 300)
    tokens = r.integers(0, 400, 300)
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens long, posterior array<double>")
    for share in ({"a": 0.3, "b": 0.3, "c": 0.4}, {"a": 0.9, "b": 0.05, "c": 0.05}, {"a": 0.02, "b": 0.02, "c": 0.96}, {"a": 1.0, "b": 0.0, "c": 0.0}):
        fit = mixing.fit_rates(mixing.Posteriors(["a", "b", "c"], rows), share)
        target = np.array([share[d] for d in "abc"]) * tokens.sum()
        # Plain projected gradient, many small steps in single coordinates' own scale.
        rate, own = np.ones(300), tokens[:, None] * p
        for _ in range(60_000):
            rate = np.maximum(0, rate - p @ (rate @ own - target) / (own * p.sum(axis=1, keepdims=True)).sum())
        reachable = bool((np.abs(rate @ own - target) <= 1e-3 * np.maximum(target, 1e-6 * target.sum())).all())
        assert fit.met or not reachable, share
        got = fit.rows.collect()
        e = np.array([sum(x["rate"] * x["tokens"] * x["posterior"][k] for x in got) for k in range(3)])
        assert np.allclose(e, [fit.expected[d] for d in "abc"]) and all(x["rate"] >= 0 for x in got)
        # No document is of one domain alone, so the others can't be got rid of.
        assert fit.met == (share["a"] < 1) and (not fit.met or (np.abs(e - target) <= 2.1e-3 * target).all())


def test_quality_matches_its_sql(spark):
    import duckdb

    docs, labels = labelled(spark)
    connection = duckdb.connect()
    for name, frame in (("documents", docs), ("labels", labels)):
        connection.register(name, frame.toArrow())
    expected = connection.execute(quality.ORACLE)
    names = [d[0] for d in expected.description]
    # SQL joins by doc_id, so rows that share one are left to the plain count below.
    want = Counter(r for r in expected.fetchall() if r[0] not in (3, None))
    got = quality.judge(docs, labels).select(*names).collect()
    assert len(got) == 244 and Counter(tuple(r) for r in got if r[0] not in (3, None)) == want


def test_repeated_words_by_force(docs):
    rows = {(r["doc_id"], r["n_words"]): r["n_repeat_words"] for r in quality.base_features(docs, ["doc_id"]).collect()}
    for k, t, *_ in ROWS:
        w = WORD.findall(t or "")
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert rows[k, len(w)] == len({j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_exact_binomial(spark):
    F = urls.F
    for k, n in ((0, 1), (0, 50), (3, 200), (19, 1000), (0, 10000), (1900, 100000)):
        got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.02)).first()[0]
        assert math.isclose(got, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1)), rel_tol=1e-8, abs_tol=1e-300)
    n = 4_000_000_000
    sure, even = (spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.02)).first()[0] for k in (n // 50 - 60_000, n // 50 - 1))
    assert 0 < sure < 1e-8 and abs(even - 0.5) < 1e-3
    assert spark.range(1).select(quality.binomial_cdf(F.lit(40).cast("long"), F.lit(1000).cast("long"), 0.02)).first()[0] == 1.0


def test_false_rejection_is_bounded_for_the_verdict(spark):
    """Simulated holdouts: all rules together break the limit in no more of them than the error allows."""
    r = np.random.default_rng(12)
    strata, n = 300, 900
    rows = []
    bad = {}
    for k in range(strata):
        # The share that is rejected grows by a draw of its own with each setting, and passes the limit somewhere.
        rate = np.cumsum(r.exponential(0.0025, len(quality.SEQUENCE)))
        bad[f"={k}"] = rate
        u = r.random(n)
        rows.append((f"={k}", n, [int((u < x).sum()) for x in rate]))
    frame = spark.createDataFrame(rows, "stratum string, n long, k array<long>")
    level = 0.05
    p = [quality.binomial_cdf(F.col("k")[j], F.col("n"), quality.LIMIT) <= level for j in range(len(quality.SEQUENCE))]
    chosen = {x["stratum"]: next((j for j, ok in enumerate(x["p"]) if not ok), len(p)) - 1 for x in frame.select("stratum", F.array(*p).alias("p")).collect()}
    broken = sum(j >= 0 and bad[s][j] > quality.LIMIT for s, j in chosen.items())
    assert sum(j >= 0 for j in chosen.values()) > strata / 2
    assert broken <= strata * level + 3 * math.sqrt(strata * level * (1 - level))


def test_settings_reject_more_and_more_and_stop_at_the_first_that_may_not(spark):
    assert all(all((b - a) * sign <= 0 for a, b, (_, _, sign, _) in zip(x, y, quality.RULES)) and x != y for x, y in zip(quality.SEQUENCE, quality.SEQUENCE[1:]))
    rows = [("=a", 0.0, 0.0, 0.0, 5.0)] * 990 + [("=a", 0.15, 0.0, 0.0, 5.0)] * 10 + [("", 0.0, 0.0, 0.0, 5.0)] * 900 + [("=", 0.0, 0.0, 0.0, 5.0)] * 60
    frame = spark.createDataFrame(rows, "stratum string, symbol_share double, dup_line_share double, repeat_share double, mean_word double")
    got = {x["stratum"]: x for x in quality.choose_settings(frame).collect()}
    assert set(got) == {"=a", "", "="} and got["="]["cut_symbols"] is None and got[""]["cut_symbols"] == 0.05
    by_hand = [j for j, s in enumerate(quality.SEQUENCE) if sum(math.comb(1000, i) * 0.02**i * 0.98 ** (1000 - i) for i in range((10 if s[0] < 0.15 else 0) + 1)) > 0.05 / 3]
    last = by_hand[0] - 1 if by_hand else len(quality.SEQUENCE) - 1
    assert got["=a"]["cut_symbols"] == quality.SEQUENCE[last][0]


# -- op10 -------------------------------------------------------------------------------------------------------


def test_pieces_are_lossless_and_reproducible(docs):
    path = P.path("piece_bpe_32k.model")
    coded = pieces.encode_pieces(docs, path).cache()
    rows = coded.collect()
    assert all(r["lossless"] for r in rows)
    assert Counter((r["doc_id"], r["text_sha256"]) for r in rows) == Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t, *_ in ROWS)
    assert Counter(map(tuple, pieces.decode_pieces(coded, path).collect())) == Counter((k, t or "") for k, t, *_ in ROWS)
    again = pieces.encode_pieces(docs.repartition(1).orderBy("text"), path)
    assert Counter((r["doc_id"], tuple(r["pieces"])) for r in again.collect()) == Counter((r["doc_id"], tuple(r["pieces"])) for r in rows)


@pytest.mark.parametrize("word", [b" theme", b"    if", b"x      "])
def test_sampling_follows_the_lattice(word):
    """Every way to part a word is drawn as often as its weight says, pieces of several blanks included."""
    model = pieces.model_of(P.path("piece_bpe_32k.model"), 0.4)
    known = {model.bytes_of[i]: w for i, w in zip(model.piece_id, model.weight)}

    def ways(rest):
        if not rest:
            yield (), 0.0
        if rest[:1] != b" " and b" " in rest:
            # A run of blanks opens a word of its own.
            head, tail = rest[: rest.index(b" ")], rest[rest.index(b" ") :]
            yield from ((a + b, x + y) for a, x in ways(head) for b, y in ways(tail))
            return
        for n in range(1, len(rest) + 1):
            if rest[:n] in known:
                for tail, w in ways(rest[n:]):
                    yield (rest[:n], *tail), w + known[rest[:n]]

    share = {p: math.exp(w) for p, w in ways(word)}
    whole = sum(share.values())
    n = 20_000
    assert not word.count(b"  ") or any(b"  " in x for p in share for x in p)
    data, offsets = np.frombuffer(word * n, np.uint8), np.arange(n + 1) * len(word)
    ids, at = pieces.sample(data, offsets, np.arange(n).astype(np.uint64), model, 3)
    drawn = Counter(tuple(model.bytes_of[i] for i in ids[at[k] : at[k + 1]]) for k in range(n))
    assert set(drawn) <= set(share)
    for p, s in share.items():
        assert abs(drawn[p] / n - s / whole) < 5 * math.sqrt(s / whole / n) + 1e-4


# -- tables without rows ----------------------------------------------------------------------------------------


def test_empty_tables(spark, empty, tmp_path):
    labels, pages = spark.createDataFrame([], LABELS), spark.createDataFrame([], "page_id long, url string, html string")
    model = langid.fit(empty)
    token_output.write_blocks(token_output.encode_tokens(empty, P.path("word_bpe_49k.json")), str(tmp_path / "b"), partitions=2)
    for frame in (
        near_dup.classes(empty), near_dup.keep_first(empty), urls.judge(pages, labels), secrets.scan(empty, secrets.fit(empty)), media.read_back(media.store(empty)), substring_dedup.remove_repeats(empty),
        langid.predict(empty, model, ["doc_id"]), token_output.read_blocks(spark, str(tmp_path / "b")), mixing.fit_rates(mixing.with_posteriors(empty, labels, ["doc_id"]), mixing.TARGETS).rows,
        quality.judge(empty, labels), pieces.encode_pieces(empty, P.path("piece_bpe_32k.model")),
    ):
        assert frame.count() == 0
