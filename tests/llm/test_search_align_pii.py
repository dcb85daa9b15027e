"""Personal data, ranked search and alignment of tokenizers against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quire.llm import alignment, personal_data, ranked_search  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOCS).withColumns({c: F.lit(1) for c in ("rid", "term", "a", "n", "score", "rank", "kind", "id")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# personal data


def all_leftmost(pattern, text):
    return [m.span() for m in re.finditer(pattern, text)]


def base(text):
    """The contract's patterns as they stand."""
    out = [("email", a, b) for a, b in all_leftmost(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", a, b) for a, b in all_leftmost(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in text[a:b].split("."))]
    for a, b in all_leftmost(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in text[a:b] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", a, b))
    out += [("phone", a, b) for a, b in all_leftmost(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in text[a:b]) <= 15]
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def card(rng):
    d = "".join(rng.choice("0123456789") for _ in range(15))
    return d + next(c for c in "0123456789" if personal_data.luhn(d + c))


def test_base_spans_follow_the_patterns():
    rng = random.Random(3)
    pool = ["a", "b.c", "@", ".", "1", "22", "333", "-", " ", "+", "(", ")", "é", "\n", "x@y.z", "4845168114407329", "1.2.3.4", "%", "_"]
    for _ in range(6000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        got = [(personal_data.KINDS[k], a, b) for k, a, b in personal_data.base_spans(text)]
        assert got == base(text), text


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(320):
        n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        entity = [f"{word()}.{n(2)}@mail{n(1)}.{word()}.com", ".".join(str(rng.randint(1, 250)) for _ in range(4)), card(rng), f"+1 ({n(3)}) 555-{n(4)}"][i % 4]
        rows.append((i, f"{prose(15)} {entity} {prose(15)}"))
    rows += [(1000 + i, prose(30)) for i in range(40)] + [(1100 + i, f"{prose(9)} {rng.randint(1, 3000)} {prose(9)} v1.{i}.2 {prose(3)} 2021-03-{10 + i} {prose(4)}") for i in range(15)]
    one, two = card(rng), card(rng)
    rows += [
        (2000, f"{prose(5)} {one} {two} {prose(5)}"),
        (2001, f"{prose(5)} +1 (017) 555-7713 {prose(40)} (017) 555-7713 {prose(3)} 0175557713 {prose(4)}"),
        (2002, f"{prose(5)} anna.34@mail3.example.com {prose(30)} anna.34 at mail3.example.com {prose(4)}"),
        (3000, None), (3001, ""), (3002, " \n"), (None, "x@y.org"), (7, rows[7][1]), (7, rows[7][1]),
    ]
    out = personal_data.personal_data(make(spark, rows)).collect()
    return rows, out


def test_personal_data(private, spark, empty):
    rows, out = private
    want = Counter()
    for i, t in rows:
        b = base(t or "")
        want[(i, *[sum(k == x for k, _, _ in b) for x in personal_data.KINDS], hashlib.sha256(joined(b).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in out) == want
    for r in out:  # base spans stay, in order, and no two spans of a row meet if one is added
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert spans == sorted(spans, key=lambda s: (personal_data.KINDS.index(s[0]), s[1]))
    assert personal_data.personal_data(empty).count() == 0


def test_very_long_texts(spark):
    rows = [(1, "1" * 300_000), (2, "a" * 300_000), (3, "1 " * 40_000), (4, "a@" * 30_000 + "b.c"), (5, "+1 " * 50_000), (6, "x@y.org " * 3000)]
    got = {r["doc_id"]: r for r in personal_data.personal_data(make(spark, rows)).collect()}
    assert got[4]["spans"] == "email:59998:60003" and got[6]["n_email"] == 3000
    assert all(got[i]["n_email"] + got[i]["n_ip"] + got[i]["n_card"] + got[i]["n_phone"] == 0 for i in (1, 2, 3, 5))


def test_likeness_finds_more_and_clean_texts_stay(private):
    rows, out = private
    texts, spans = dict(rows), {r["doc_id"]: r["spans"] for r in out}
    found = lambda i: {(k, texts[i][int(a) : int(b)]) for k, a, b in (x.split(":") for x in spans[i].split(",") if x)}
    assert {k for k, _ in found(2000)} == {"card"}  # the base pattern loses cards side by side
    assert {("phone", "(017) 555-7713"), ("phone", "0175557713")} <= found(2001)  # like a number that is sure
    assert ("email", "anna.34 at mail3.example.com") in found(2002)
    assert all(not spans[i] for i in spans if i is not None and 1000 <= i < 2000)
    assert sum(len(spans[i].split(",")) > 1 for i in range(320)) <= 3


def test_messages_equal_enumeration():
    """On a small tree message passing is exact."""
    rng = np.random.default_rng(1)
    unary, t, s = rng.normal(size=(3, 9)), rng.normal(size=(9, 9)), rng.normal(size=(5, 5))
    s = personal_data.group_pairs(s + s.T)
    got = personal_data.beliefs(unary, np.array([[0, 1]]), np.array([[0, 2]]), t, s, rounds=60)
    p = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None] + t[:, :, None] + s[:, None, :])
    p /= p.sum()
    assert np.allclose(got, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=1e-6)


# ranked search


def ranked(items, docs, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    big_n, big_l = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(x for _, c in held for x in c)
    out = Counter()
    for item, query in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * c.total() * big_n // max(big_l, 1)
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 8 * m)) for x in terms(query) if c[x])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, d, -s] += 1
    return out


def test_ranked_search(spark, empty):
    rng = random.Random(2)
    vocabulary = ["the", "The", "of", *["".join(rng.choice("abcéß漢1") for _ in range(rng.randint(1, 4))) for _ in range(60)]]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\x00", "-"]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [(200, None), (201, ""), (202, " .,\n"), (None, text(9)), (None, text(9)), (5, docs[5][1]), (203, "the " * 60_000), (204, "É é E e İ i")]
    items = [(i, text(rng.randint(1, 9))) for i in range(20)] + [(50, None), (51, ""), (52, "unheardof"), (53, docs[3][1]), (3, "the of the"), (3, "the of the"), (None, "of"), (54, "é É the the the")]
    d, q = make(spark, docs), spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = ranked(items, docs)
    for size in ({}, {"block_docs": 16, "bundle_items": 5, "n_owners": 3}, {"n_owners": 1}):
        got = Counter(tuple(r) for r in ranked_search.search(q, d, **size).collect())
        assert got == want
    assert ranked_search.search(q, empty).count() == 0 and ranked_search.search(q.limit(0), d).count() == 0


def test_terms_met_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BROADCAST_TERMS", 0)
    docs, items = [(i, f"a{i % 7} b{i % 3} the") for i in range(60)], [(1, "a1 b2"), (2, "the a3")]
    got = Counter(tuple(r) for r in ranked_search.search(spark.createDataFrame(items, "item_id bigint, text string"), make(spark, docs)).collect())
    assert got == ranked(items, docs)


# alignment


def library(aligner, text):
    """Tokens of the whole text by both libraries, groups by their decoded bytes."""
    nothing = (0, 0, 0, 0, "", Counter())
    if not text:
        return nothing
    whole = " " + text
    a, b = aligner.a.encode(whole, add_special_tokens=False).ids, aligner.b.encode(text)
    bytes_a, bytes_b = [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b]
    if b"".join(bytes_a) != whole.encode() or b"".join(bytes_b) != whole.encode():
        return nothing
    ends = lambda v: np.cumsum([len(x) for x in v]).tolist()
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    groups, pairs, i, j = [], Counter(), 0, 0
    for c in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(c, i) + 1, ends_b.index(c, j) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    for x, y in groups:
        pairs.update((p, q) for p in x for q in y)
    text_of = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return len(a), len(b), len(groups), pairs.total(), hashlib.sha256(text_of.encode()).hexdigest(), pairs


def test_alignment(spark, empty, monkeypatch):
    rng = random.Random(4)
    pool = ["a", "b", " ", "  ", "\n", "\t", "漢字", "é", "😀", "▁", "'s", "<|endoftext|>", "<s>", "\xa0", "　", "12", "...", "\x1c", "\x85", "\x00", "क्षि", "﻿", "the", " the", "​", "\r\n", "word", " word"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", " ", "▁", "a ▁b", "word " * 30_000, "x" * 20_000, "漢字" * 4000, "ab😀" * 900, " " * 5000, "\n" * 5000, "-=" * 4000, "the end", "the end"]
    rows = [(i if i % 97 else None, t) for i, t in enumerate(texts)]
    aligner = alignment.load(public_tokenizers.path(A), public_tokenizers.path(B))
    facts = [library(aligner, t) for t in texts]
    count = Counter(p for f in facts for p in f[5])
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    want = Counter()
    for (i, _), f in zip(rows, facts):
        best = sum(n for p, n in f[5].items() if count[p] == top[p[0]])
        want[(i, *f[:4], best, sum(n * count[p] for p, n in f[5].items()), f[4])] += 1
    docs = make(spark, rows)
    paths = public_tokenizers.path(A), public_tokenizers.path(B)
    assert Counter(tuple(r) for r in alignment.alignment(docs, *paths).collect()) == want
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert Counter(tuple(r) for r in alignment.alignment(docs, *paths).collect()) == want
    assert alignment.alignment(empty, *paths).count() == 0


def test_coarse_cuts_are_not_enough():
    """Characters of several bytes are cut inside by both tokenizers; only decoded bytes show these groups."""
    aligner = alignment.load(public_tokenizers.path(A), public_tokenizers.path(B))
    text = " 漢 \U0001f9ff"
    _, _, at_a, at_b, cuts = aligner.tokens(text)
    assert sorted(set(at_a) & set(at_b)) == cuts.tolist()
    inside = [c for c in cuts.tolist() if (text.encode() + b" ")[c] & 0xC0 == 0x80]
    assert inside
