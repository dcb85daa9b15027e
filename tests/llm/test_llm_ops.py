"""Training-data operators against brute force, on small tables with nulls, ties, repeats, empty and long texts."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quire.llm import components, line_dedup, media, mixing, pieces, quality_rules, sharding, simhash, similar, suffix_dedup, token_counts, toxicity  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ASCII_WS = " \t\n\x0b\x0c\r"


def word_list(text):
    return [w.decode() for w in (text or "").encode().split()]


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = sentence(60)
    out = [(i, "\n".join(sentence(rng.randint(1, 14)) for _ in range(rng.randint(1, 12))), f"s{i % 4}") for i in range(60)]
    out += [(100 + i, sentence(20) + "\n" + passage + "\n" + sentence(10), "s0") for i in range(12)]
    for i, t, _ in out[:15]:  # near copies: a word replaced, dropped or added
        w = t.split(" ")
        k = rng.randrange(len(w))
        out.append((200 + i, " ".join(w[:k] + [["x"], [], [w[k], "y"]][i % 3] + w[k + 1 :]), "s1"))
    out += [(300, None, None), (301, "", "s2"), (302, " \n\t", None), (303, "a" * 900, "s3"), (304, "one line only of seven words here", "s3"), (305, "ABC abc Abc", "s3")]
    out += [(None, "no id at all in this row", "s2"), (None, None, "s2"), (7, out[7][1], "s3"), (7, out[7][1], "s3"), (400, out[8][1], "s0"), (401, sentence(3000), "s2"), (402, "a b c d e " * 30, "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).withColumns({c: F.lit(1) for c in ("size", "slot", "h", "kept", "key", "fp", "__n")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# quality rules


def base(text):
    t = text or ""
    w = word_list(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(ASCII_WS)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


def test_quality(docs, rows, empty):
    got = Counter((r["doc_id"], *[r[c] for c in quality_rules.BASE]) for r in quality_rules.quality(docs).collect())
    assert got == Counter((i, *base(t)) for i, t, _ in rows)
    assert quality_rules.quality(empty).count() == 0
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns and quality_rules.keep_quality(empty).count() == 0
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in quality_rules.quality(docs).where("kept").collect())


def test_bad_hosts_go(spark):
    good = " ".join(f"w{i}" for i in range(30))
    df = make(spark, [(i, "short", "bad") for i in range(40)] + [(100, good, "bad"), (101, good, None)] + [(200 + i, good + f" {i}", "good") for i in range(40)])
    kept = {r["doc_id"] for r in quality_rules.quality(df).where("kept").collect()}
    assert kept == {101} | {200 + i for i in range(40)}
    assert {r["doc_id"] for r in quality_rules.keep_quality(df).collect()} == kept


def test_hosts_decide_on_marked_texts(spark):
    """A host that stands out in one rule loses the texts that this rule marks; the same texts of other hosts stay."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    marked = lambda i: text(i) + " " + "$" * 40
    rows = [(100 * h + i, marked(100 * h + i) if i < (60 if h == 3 else 2) else text(100 * h + i), f"h{h}") for h in range(20) for i in range(80)]
    rows += [(9000, marked(9000), None), (9001, text(9001), None)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.quality(make(spark, rows)).collect()}
    assert not any(f for f, _ in got.values())
    assert {i for i, (_, k) in got.items() if not k} == {300 + i for i in range(60)}
    assert {r["doc_id"] for r in quality_rules.keep_quality(make(spark, rows)).collect()} == {i for i, (_, k) in got.items() if k}
    even = [(i, t, f"h{i % 5}") for i, t, _ in rows if i is not None and t == text(i)]
    assert all(r["kept"] for r in quality_rules.quality(make(spark, even)).collect())


# line dedup


def words_within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def dedup_brute(rows):
    """Texts after removal, by (id, text); any earlier line counts."""
    key = lambda r: (r[0] is None, r[0] or 0)
    out, earlier = {}, []
    for i, t, _ in sorted({r[:2]: r for r in rows}.values(), key=key):
        keep = []
        for line in (t or "").split("\n"):
            w = word_list(line)
            if w:
                hit = any(w == e or len(w) >= 5 and len(e) >= 5 and words_within_one(w, e) for e in earlier)
                earlier.append(w)
                if hit:
                    continue
            keep.append(line)
        out[i, t] = None if t is None else "\n".join(keep)
    return out


def test_line_dedup(docs, rows, empty):
    rows_ = [r for r in rows if r[0] is not None]
    want = dedup_brute(rows_)
    got = line_dedup.dedup_lines(docs.where("doc_id is not null"), counts=("n_lines", "n_removed"))
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    text_of = defaultdict(list)
    for r in got.collect():
        text_of[r["doc_id"]].append(r["text"])
    for (i, _), text in want.items():
        assert set(text_of[i]) == {text}, i
    assert got.count() == len(rows_)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs).where("doc_id is null").count() == 2


def test_line_dedup_edits(spark):
    a = "the quick brown fox jumps over the lazy dog near the old stone bridge every single morning at dawn"
    w = a.split()
    variants = [w[:k] + ["X"] + w[k + 1 :] for k in (0, 9, 18)] + [w[:k] + w[k + 1 :] for k in (0, 9, 18)] + [w[:k] + ["Y"] + w[k:] for k in (0, 9, 19)]
    rows = [(0, a, "s")] + [(1 + n, " ".join(v), "s") for n, v in enumerate(variants)] + [(50, " ".join(["P", "Q", *w[2:]]), "s"), (51, "a  b\tc d", "s"), (52, "a b c d", "s"), (53, "a b c e", "s")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make(spark, rows)).collect()}
    assert got == {i: t for (i, _), t in dedup_brute(rows).items()}
    assert got[0] == a and got[50] == rows[-4][1] and got[52] == "" and got[53] == "a b c e"


def test_line_dedup_random(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(3, 8))) for _ in range(3)), "s") for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make(spark, rows)).collect()}
    assert got == {i: t for (i, _), t in dedup_brute(rows).items()}


# sharding


def test_sharding(docs, rows, empty):
    got = sharding.shards(docs, 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    assert sharding.shards(empty).count() == 0


def test_sharding_keeps_groups_together(spark):
    rows = [(i, f"text {i}", "s") for i in range(400)] + [(1000 + i, f"pair {i // 2}", "s") for i in range(200)] + [(2000 + i, "hot", "s") for i in range(300)]
    got = sharding.shards(make(spark, rows), 8).collect()
    text = {i: t for i, t, _ in rows}
    where = defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for t, s in where.items() if t.startswith("pair")) <= 8
    assert len(where["hot"]) <= 6  # a quota is 112 rows; the hash spreads them by chance
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_propagation_over_a_graph_cuts_few_links(spark):
    """Four communities of documents with many pair links inside and a few between, against where a hash puts them."""
    rng = random.Random(7)
    pairs = [(g * 40 + rng.randrange(40), g * 40 + rng.randrange(40)) for g in range(4) for _ in range(160)]
    pairs += [(rng.randrange(160), rng.randrange(160)) for _ in range(12)]
    name = lambda i: xxhash.xxh64_intdigest(str(i)) >> 1
    nodes = spark.createDataFrame([(name(i), i, i) for i in range(166)], "row_hash bigint, row_hash2 bigint, doc int")
    links = spark.createDataFrame([(name(i), i, k) for k, (a, b) in enumerate(pairs) for i in {a, b}], "row_hash bigint, row_hash2 bigint, link bigint")
    placed = sharding.propagate_graph(nodes, links, 166, 4, 8)
    rows = placed.collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 166 and max(sizes.values()) - min(sizes.values()) <= 1
    shard = {r["doc"]: r["shard"] for r in rows}
    got = sharding.cut(placed, links)
    assert got == sum(shard[a] != shard[b] for a, b in pairs)
    by_hash = sharding.cut(nodes.withColumn("shard", F.col("row_hash") % 4), links)
    assert got < 0.5 * by_hash


# token counts


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    j = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(j)
    out = token_counts.token_counts(docs, j, limit=50, chunk=300, overlap=20).collect()
    assert sum(r["n_splices"] > 0 for r in out) > 10
    got = Counter(tuple(r)[:4] for r in out)
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 50) for i, x, _ in rows)
    assert got == want
    assert token_counts.token_counts(empty, j).count() == 0


def test_token_chunks():
    t = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "it's", "don't", "😀", "né", "123", "###", "a", "word", "中文", "　", "x" * 90, " " * 70, "�"]
    for n in (1, 5, 50, 400):
        for _ in range(25):
            text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(n))
            want = len(t.encode(text, add_special_tokens=False))
            assert token_counts.count_long(text, t, 120, 16)[0] == want, text
    assert token_counts.count_long("y" * 5000, t, 120, 16)[0] == len(t.encode("y" * 5000, add_special_tokens=False))


# mixing


def test_mixing(docs, rows, empty):
    got = mixing.copies(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(word_list(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    left, open_, target = 1.5 * sum(sizes.values()), {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}
    while open_:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * sizes[s]]
        if not over:
            target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    by_target = defaultdict(int)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(word_list(t))) for i, t, _ in rows)
    source = {}
    for i, t, s in rows:
        source.setdefault((i, len(word_list(t)), sizes[s]), s)
    for r in got:
        s = source[r["doc_id"], r["size"], r["source_size"]]
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        by_target[s] += r["taken"]
    for s, t in target.items():
        assert abs(by_target[s] - t) <= max(25, 0.02 * t), s
    again = Counter((r["doc_id"], r["copies"]) for r in mixing.copies(docs).collect())
    assert again == Counter((r["doc_id"], r["copies"]) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    wanted = Counter()
    for r in got:
        wanted[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +wanted
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


# toxicity


def test_toxicity_learns_and_holds_out(spark, empty):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdeghi") for _ in range(4)) for _ in range(300)]
    bad = [f"vile{k}" for k in range(15)]
    texts = {}
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            for _ in range(max(2, len(w) // 50)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts[i] = " ".join(w)
    df = make(spark, [(i, t, "s") for i, t in texts.items()] + [(1000, None, None), (1001, "", "s"), (None, "vile1 vile2", "s")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in texts] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == 603
    held = {r["doc_id"] for r in got if r["held_out"]}
    assert held == {i for i in [*texts, 1000, 1001] if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(df, labels.limit(0)).count() == 603


def kneser_ney_brute(texts):
    """log P(w | v) of both classes from (text, toxic), by dictionaries of words."""
    words = [(re.findall(r"\w+", t.lower()), y) for t, y in texts]
    pair = {c: Counter() for c in ("toxic", "plain", "shared")}
    for w, y in words:
        for v, x in zip(["<s>", *w], w):
            pair["toxic" if y else "plain"][v, x] += 1
            pair["shared"][v, x] += 1
    follows = {c: Counter(x for _, x in pair[c]) for c in ("toxic", "plain")}
    discount = lambda counts: (n1 := sum(k == 1 for k in counts.values())) / (n1 + 2 * sum(k == 2 for k in counts.values())) if 1 in counts.values() else 0.5
    top, low = {c: discount(pair[c]) for c in pair}, {c: discount(follows[c]) for c in follows}
    n, types = {c: Counter() for c in pair}, {c: Counter() for c in pair}
    for c in pair:
        for (v, _), k in pair[c].items():
            n[c][v] += k
            types[c][v] += 1
    shares = sum(len(f) for f in follows.values()) + 1

    def level(c, v, x, under):
        return under if not n[c][v] else max(pair[c][v, x] - top[c], 0) / n[c][v] + top[c] * types[c][v] / n[c][v] * under

    def p(c, v, x):
        shared = max(sum(x in f for f in follows.values()), 1) / shares
        total = sum(follows[c].values())
        base = max(follows[c][x] - low[c], 0) / total + low[c] * len(follows[c]) / total * shared
        return level(c, v, x, level("shared", v, x, base))

    return p


def test_kneser_ney_against_dictionaries(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [(" ".join(rng.choice(vocabulary[: 20 + 20 * (i % 2)]) for _ in range(rng.randint(1, 40))), int(i % 3 == 0)) for i in range(40)] + [("", 1), ("Once, ONCE!", 0)]
    rows = spark.createDataFrame(texts, "text string, toxic bigint")
    pairs = rows.mapInArrow(toxicity._pairs, "v bigint, w bigint, vw bigint, toxic bigint, plain bigint").groupBy("v", "w", "vw").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    model, brute = toxicity.counted(pairs), kneser_ney_brute(texts)
    for text in [texts[0][0], texts[7][0], "w1 w39 never w2 seen w3", "once once w1"]:
        w = re.findall(r"\w+", text.lower())
        got = model.log_probabilities(toxicity.tokens(text))
        for c in ("toxic", "plain"):
            assert got[c] == pytest.approx([np.log(brute(c, v, x)) for v, x in zip(["<s>", *w], w)], rel=1e-4)
    probabilities = [brute("toxic", "w1", x) for x in {y for t, _ in texts for y in re.findall(r"\w+", t.lower())}]
    assert sum(probabilities) == pytest.approx(1 - (probabilities and brute("toxic", "w1", "never")), rel=1e-2)


# SentencePiece


def model(kind=None):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return pieces.Pieces(f.read(), kind)


SAMPLES = ["", " ", "Hello  world\n a", "  x ", "a\tb c", "😀 ꙮ", "▁a b", "ﬁ ①", "<s>hi</s>", "a\x00b", "é", "     ", "x" * 300, "ababab" * 40, "The 中文 text, mixed — with (odd) things…", "\u0085 ", "naïve café"]


def test_pieces_equal_the_library(rows):
    p = model()
    rng = random.Random(9)
    noise = ["".join(rng.choice("ab thein é中😀\n.▁0") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text in SAMPLES + noise + [t or "" for _, t, _ in rows]:
        ids = p.encode(text)
        assert ids == p.library.encode(text), text
        assert p.decode(ids) == p.library.decode(ids), text


def test_viterbi_is_the_best_sum():
    """The same pieces read as a unigram model, against dynamic programming over all substrings."""
    p = model(pieces.UNIGRAM)
    for text in ["the theme of these", "Hello world", "international agreement", "naïve café", "ꙮ a ꙮꙮ", "x" * 40, ""]:
        full = p.normal(text)
        best = [0.0] + [float("-inf")] * len(full)
        for end in range(1, len(full) + 1):
            for start in range(end):
                score = p.score[p.id_of[full[start:end]]] if full[start:end] in p.id_of else p.unknown_score if end - start == 1 else float("-inf")
                best[end] = max(best[end], best[start] + score)
        ids = p.encode(text)
        unknown = sum(c not in p.id_of for c in full)
        assert p.decode(ids) == text
        assert sum(p.score.get(k, 0.0) for k in ids) + unknown * p.unknown_score == pytest.approx(best[-1]), text


def test_round_trip(docs, rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.round_trip(docs, path).collect()
    assert len(got) == len(rows) and all(r["same"] for r in got)
    assert pieces.round_trip(empty, path).count() == 0
    coded = pieces.encode(docs.select("doc_id", "text"), path)
    assert coded.columns == ["doc_id", "ids"] and pieces.decode(coded, path).columns == ["doc_id", "text"]


# suffix dedup


def suffix_brute(texts):
    n = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if n[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def suffix_got(df):
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", gone, F.size("spans"), F.sha2("kept", 256)).collect())


@pytest.mark.parametrize(("wide", "segment"), [(20_000, 1 << 19), (0, 700)])
def test_suffix_dedup(docs, rows, empty, monkeypatch, wide, segment):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    want = Counter((i, *x) for (i, _, _), x in zip(rows, suffix_brute([(t or "").encode() for _, t, _ in rows])))
    assert suffix_got(docs) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_edges(spark):
    rng = random.Random(4)
    p = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(0, p[:200], "s"), (1, "x" + p[:200], "s"), (2, p[:199] + "#", "s"), (3, p[100:400], "s"), (4, "y" * 20 + p[150:351] + "z" * 500, "s"), (5, p[300:499], "s"), (6, "ab" * 300, "s"), (7, p[250:650] + p[250:650], "s"), (8, "é" * 150, "s"), (9, "é" * 99 + "ab" * 101, "s")]
    want = Counter((i, *x) for (i, _, _), x in zip(rows, suffix_brute([t.encode() for _, t, _ in rows])))
    assert suffix_got(make(spark, rows)) == want


# media


def test_media(docs, rows, empty):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in media.document_media(docs).collect())
    want = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        p = b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))
        m = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()] += 1
    assert got == want
    assert media.document_media(empty).count() == 0


def test_interleaving():
    page = "<p>one &amp; two</p><figure><img src='a.png' alt='x'><figcaption>The <b>cap</b></figcaption></figure>tail<script>no</script><video src='v.mp4'></video><img alt='none'>end"
    got = [(x["position"], x["kind"], x["text"], x["ref"], x["caption"]) for x in media.parse(page)]
    assert got == [(0, "text", "one & two", None, None), (1, "media", None, "a.png", "The cap"), (2, "text", "tail", None, None), (3, "media", None, "v.mp4", None), (4, "text", "end", None, None)]
    assert media.parse(None) == [] and media.parse("<p") is not None
    for payload in (media.pad(b""), media.pad(b"x" * 64), media.pad(b"y" * 65)):
        assert media.decode(media.encode(payload)) == (payload, len(payload) // 64)


def test_resolving(spark):
    p = media.pad(b"hello")
    digest = hashlib.sha256(p).hexdigest()
    pages = spark.createDataFrame([(1, f"a<img src='media:sha256/{digest}' alt='c'>b<img src='http://h/x.png'>"), (2, None)], "page_id bigint, html string")
    found = media.features(spark.createDataFrame([(bytearray(media.encode(p)),)] * 2, "media binary"))
    got = {(r["page_id"], r["position"]): (r["caption"], r["payload_bytes"]) for r in media.resolve(media.interleave(pages), found).collect()}
    assert got == {(1, 1): ("c", 64), (1, 3): (None, None)}


# SimHash


def fingerprint_brute(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_brute(fps, tau=4):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= tau:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(docs, rows, empty):
    fp = [fingerprint_brute(t) for _, t, _ in rows]
    root = roots_brute(fp)
    least = {}
    for (i, _, _), f in zip(rows, fp):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = Counter((i, f"{f:016x}", least.get(root[f])) for (i, _, _), f in zip(rows, fp))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [fingerprint_brute(r["text"]) for r in kept.collect()]
    assert sorted(root[f] for f in got) == sorted(set(root.values()))
    assert simhash.keep_one(empty).count() == 0


def test_links_lose_nothing(spark):
    rng = random.Random(8)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 90)):  # clusters, some larger than SMALL_GROUP
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.group_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()
    root = roots_brute(fps)
    ours, theirs = defaultdict(set), defaultdict(set)
    for r in got:
        ours[r["root"]].add(r["fp"] % (1 << 64))
    for f, r in root.items():
        theirs[r].add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_allocation():
    shares = [[1e-4, 1e-3, 1e-2, 0.1, 1]] * 2 + [[0.5, 0.9, 1, 1, 1]]
    cost, t = simhash.allocate([21, 21, 22], shares, 10**6, 4)
    assert sum(x + 1 for x in t) == 5 and t[2] == -1  # the skewed partition is left out


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (-5, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, -5: -5, 300: -5}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# similar texts


def similar_brute(rows, t=0.8, k=5):
    """Ids kept of (id, text): the smallest of each component of pairs with that Jaccard similarity."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or both >= t * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and both):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {find(i) for i in sets}


def test_similar_texts(spark, docs, rows, empty):
    corpus = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    own = []
    for _ in range(25):
        line = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 14)):  # chains of copies on both sides of 0.8
            own.append(" ".join(line))
            for _ in range(rng.randint(0, len(line) // 25 + 1)):
                line[rng.randrange(len(line))] = word()
    hub = [word() for _ in range(60)]  # copies alike to the hub, most of them not to each other
    own += [" ".join(hub)] + [" ".join([*hub[:k], word(), *hub[k + 1 :]]) for k in range(4, 56)] + [None, "", " \n", "A b", "a B", "a b c"]
    rng.shuffle(own)
    table = [(i, t, "s") for i, t in enumerate(own)]
    want = similar_brute([r[:2] for r in table])
    kept = corpus.simhash(spark, make(spark, table), "")
    assert {r["doc_id"] for r in kept.collect()} == want and len(want) < len(table)
    other = similar_brute([(i, t) for i, t, _ in rows if i is not None and i != 7], 0.5, 3)
    got = similar.keep_one_similar(docs.where("doc_id <> 7"), shingle=3, similarity=0.5)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == other
    assert similar.keep_one_similar(docs).where("doc_id is null").count() == 1  # null ids give way to others
    assert similar.keep_one_similar(empty).count() == 0


def test_simhash_gives_the_first_links_of_the_pipeline(spark, monkeypatch):
    corpus = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    own = []
    for _ in range(12):  # near copies a few bits apart, and some at about 0.8, beyond them
        line = [word() for _ in range(600)]
        for n in (0, 1, 1, 11):
            own.append(" ".join(word() if i in rng.sample(range(600), n) else w for i, w in enumerate(line)) if n < 2 else " ".join(word() if i % 55 == 7 else w for i, w in enumerate(line)))
    table = [(i, t, "s") for i, t in enumerate(own)]
    want = similar_brute([r[:2] for r in table])
    asked = []
    links, none = similar.links, similar._meetings
    monkeypatch.setattr(similar, "links", lambda fps, tau: asked.append(fps.count()) or links(fps, tau))
    assert {r["doc_id"] for r in corpus.simhash(spark, make(spark, table), "").collect()} == want and asked == [len(set(own))]
    monkeypatch.setattr(similar, "_meetings", lambda sets: none(sets).limit(0))  # SimHash alone
    alone = {r["doc_id"] for r in corpus.simhash(spark, make(spark, table), "").collect()}
    assert want < alone and len(alone) < len(own) - 12
    monkeypatch.undo()
    for tau in (0, 8):
        assert {r["doc_id"] for r in similar.keep_one_similar(make(spark, table), tau=tau).collect()} == want


# pipeline


def test_encoding_and_decoding_take_one_python_worker_a_task(spark, docs):
    """Each Python node of a stage is a worker of its own in every task, with a model and batches beside the executor's heap."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    corpus = pytest.importorskip("corpus_pipeline")
    for df in (pieces.round_trip(docs, path), corpus.sentencepiece(spark, docs.withColumn("lang", F.lit("en")), "")):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    both = pieces.encode_decode(docs.select("doc_id", "source", "text"), path, out="ids", back="source")
    assert both.columns == ["doc_id", "source", "ids", "source_"]
    coded = pieces.encode(docs.select("doc_id", "text"), path)
    apart = pieces.decode(coded.withColumn("kept", F.col("ids")), path)
    key = lambda rows: Counter((i, tuple(ids), t) for i, ids, t in rows)
    assert key(both.select("doc_id", "ids", "source_").collect()) == key(apart.select("doc_id", "kept", "text").collect())


def test_pipeline(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    one = corpus.quality_rules(spark, docs, d)
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in quality_rules.quality(docs).where("kept").collect()} <= {i for i, t, _ in rows if not base(t)[-1]}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in one.collect()]
    two = corpus.line_dedup(spark, one, d)
    want = {i: t for (i, _), t in dedup_brute(rows).items() if t and t.strip(ASCII_WS)}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in two.collect()} == {i: (t, len(t)) for i, t in want.items()}
    three = corpus.simhash(spark, two, d)
    assert {r["doc_id"] for r in three.collect()} == similar_brute(list(want.items()))
    four = corpus.mixing(spark, three, d)
    assert two.columns == three.columns == four.columns == docs.columns
    five = corpus.run(spark, d).collect()
    assert all(r["same"] for r in five) and Counter(r["doc_id"] for r in five) == Counter(r["doc_id"] for r in four.collect())


# names, and texts of megabytes

NAMES = ["row", "h", "h2", "n", "__h", "__h2", "__n", "__keep", "keep", "lines", "left", "copy", "__copy", "__low", "__more", "ids", "fp", "elements", "words", "words_windows", "host", "host_key", "bad", "strict", "kept", "base_failed", "n_words", "n_lines", "n_removed", "position", "ref", "caption", "payload_sha256", "e", "digest", "found", "sha", "id", "size", "key", "link", "none", "s", "k", "root", "first"]


@pytest.mark.parametrize("name", ["mix", "keep_one", "keep_one_similar", "dedup_lines", "keep_quality", "encode", "decode", "fingerprints", "interleave", "resolve"])
def test_columns_of_any_name_keep_their_values(spark, name):
    """Every operator that passes columns through gets a table with its own internal names as columns; values are compared."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) + f"<img src='media:sha256/{i}' alt='c'>" for i in range(6)]
    df = make(spark, [(i, t, f"s{i % 2}") for i, t in enumerate(texts)])
    df = df.withColumns({c: F.concat(F.lit(f"{c}="), F.col("doc_id").cast("string")) for c in NAMES})
    media_table = media.features(spark.createDataFrame([(bytearray(media.encode(media.pad(b"x"))),)], "media binary"))
    out = {
        "mix": lambda: mixing.mix(df), "keep_one": lambda: simhash.keep_one(df), "keep_one_similar": lambda: similar.keep_one_similar(df),
        "dedup_lines": lambda: line_dedup.dedup_lines(df, counts=("n_lines", "n_removed")), "keep_quality": lambda: quality_rules.keep_quality(df),
        "encode": lambda: pieces.encode(df, path), "decode": lambda: pieces.decode(df.withColumn("numbers", F.array(F.lit(5))), path, "numbers", "ids"),
        "fingerprints": lambda: simhash.fingerprints(df), "interleave": lambda: media.interleave(df, "text"),
        "resolve": lambda: media.resolve(media.interleave(df, "text", "parts"), media_table, "parts"),
    }[name]()
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == set(range(6))
    assert all(r[c] == f"{c}={r['doc_id']}" for r in rows for c in NAMES)
    if name == "mix":
        assert out.columns == df.columns
    added = {"encode": "ids_", "decode": "ids_", "fingerprints": "fp_", "interleave": "elements_", "resolve": "caption_", "dedup_lines": "n_lines_"}.get(name)
    assert not added or all(r[added] is not None for r in rows)


def test_texts_of_megabytes(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(5000)]
    text = " ".join(rng.choice(vocabulary) for _ in range(150_000)) + " <|endoftext|> end"
    near = text.replace("end", "END")
    texts = {0: text, 1: text, 2: near, 3: "a short one of its own with ten words in it"}
    df = make(spark, [(i, t, "s") for i, t in texts.items()])
    words = text.split()
    q = {r["doc_id"]: r for r in quality_rules.quality(df).collect()}
    assert q[0]["n_words"] == len(words) and q[0]["word_chars"] == sum(map(len, words)) and q[0]["kept"]
    t = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {r["doc_id"]: r for r in token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    c = {r["doc_id"]: r for r in token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), chunk=1 << 12).collect()}
    assert {i: r["n_tokens"] for i, r in whole.items()} == {i: r["n_tokens"] for i, r in c.items()} and whole[0]["n_splices"] >= len(text) // token_counts.CHUNK_CHARS - 1
    assert c[0]["n_tokens"] == len(t.encode(text, add_special_tokens=False)) and c[0]["n_splices"] > 100 and c[3]["n_splices"] == 0
    assert all(r["same"] for r in pieces.round_trip(df, public_tokenizers.path("piece_bpe_32k.model")).collect())
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert groups == {0: 0, 1: 0, 2: 0, 3: 3} and {r["doc_id"] for r in similar.keep_one_similar(df).collect()} == {0, 3}
    lines = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert lines[0] == text and lines[1] == "" and lines[3] == texts[3]
    gone = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["spans"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert gone[0] == gone[1] == len(text) and gone[3] == 0
    m = {r["doc_id"]: r for r in media.document_media(df).collect()}
    assert m[0]["n_bytes"] == len(text) and m[0]["media_sha256"] == m[1]["media_sha256"]
    assert {r["doc_id"]: r["size"] for r in mixing.copies(df).collect()}[0] == len(words)
    assert {r["size"] for r in sharding.shards(df, 2).collect()} == {len(x) + 1 for x in texts.values()}


def test_media_forms():
    page = "<video poster='p.jpg'><source src='a.mp4'><source src='b.mp4'></video><picture><source srcset='x.webp 1x, y.webp 2x'><img src='z.png' alt='words'></picture><img srcset='s.png 1x'><audio src='c.ogg'><source src='d.ogg'></audio>"
    assert [(x["ref"], x["caption"]) for x in media.parse(page)] == [("p.jpg", None), ("a.mp4", None), ("z.png", "words"), ("s.png", None), ("c.ogg", None)]


def test_rates_solve_the_dual(spark):
    """The tilts against a bisection of each source's dual, in plain Python."""
    rng = random.Random(12)
    sizes = {s: [rng.randint(1, 400) for _ in range(60)] for s in ("a", "b", "c")}
    cells = spark.createDataFrame([("s" + s, s, n, k) for s, v in sizes.items() for n, k in Counter(v).items()], "key string, source string, size bigint, n bigint")
    got = {r["source"]: r for r in mixing.tilts(cells, mixing.targets(cells)).collect()}
    for s, v in sizes.items():
        r = got[s]
        rate = lambda lam, n: min(2.0, np.exp(lam * n))
        low, high = -1.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * rate(mid, n) for n in v) < r["target"] else (low, mid)
        assert r["at_limit"] or r["lam"] / r["scale"] == pytest.approx(low, rel=1e-3, abs=1e-7)


def test_stages_take_nulls_and_empty_tables(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"
    own = lambda i: " ".join(f"{w}{i}" for w in text.split())
    rows = [(1, own(1), "s"), (1, own(1), "s"), (None, own(2), None), (None, None, None), (3, "", "s"), (4, None, "t"), (5, own(1), "t")]
    for table in (make(spark, rows), make(spark, rows).limit(0)):
        docs = table
        for _, stage in corpus.STAGES:
            docs = stage(spark, docs, "")
            got = docs.collect()
            docs = spark.createDataFrame(got, docs.schema)
        assert all(r["same"] for r in got)
        assert {r["doc_id"] for r in got} <= {1, None} and bool(got) == (table.count() > 0)
    null = corpus.sentencepiece(spark, make(spark, [(None, None, None)]), "").first()
    assert null["same"] is True and null["n_pieces"] == 0
