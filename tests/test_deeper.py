"""Ordered runs, the order of all cards, JSON faults, logs of edits and files of chosen names."""

import json
import os
import random
import re
import sqlite3
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import cards, edits, fences, filters, generate, ordering, retry, title_index, validate
from quire.sources import books, named, sinks

SECTIONS = "book_id string, index int, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ordered runs


def test_a_run_in_order_asks_nothing_after_a_failure(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def client(prompt, text):
        (log / f"{text}-{len(os.listdir(log))}-{os.getpid()}-{random.random()}").touch()
        if text.endswith("down"):
            raise retry.CallError("no", status=400)
        return "nothing" if text.endswith("bad") else f"## {text}\n\n- a"

    rng = random.Random(4)
    data = [(f"b{b}", i, f"{b}.{i}" + rng.choice(["", "", "", "", "down", "bad"])) for b in range(12) for i in range(1, 9)] + [("e", 1, "e.1"), ("e", 2, " "), ("e", 3, "e.3")]
    rng.shuffle(data)
    plan = generate.Plan("gemini", "gemini-x", "p")
    out = generate.run(spark.createDataFrame(data, SECTIONS).repartition(7), plan, client, store=str(tmp_path / "answers"))
    calls, kept = Counter(), []
    for book in sorted({b for b, _, _ in data}):  # one after another, as a sequential run would
        for b, i, t in sorted(x for x in data if x[0] == book):
            t = t.strip()
            n = 0 if not t else 3 if t.endswith("bad") else 1
            calls[t] += n
            kept.append((b, i, n, n != 1 or t.endswith("down")))
            if kept[-1][3]:
                break
    assert Counter(f.split("-")[0] for f in os.listdir(log)) == +calls
    assert rows(out.select("book_id", "section_index", "attempts", F.col("error").isNotNull())) == sorted(kept, key=repr)
    wrong = out.where("error like 'Markdown formatting%'").first()
    assert wrong is None or wrong["error"].split("\n")[0] == "Markdown formatting remained invalid after 3 attempts."


# the order of all rows


def test_numbers_and_sums_over_ranges(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"b{rng.randint(0, 30)}", rng.randint(1, 5), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "book_id string, section_index int, card_ord int, w int").repartition(9)
    got = ordering.numbered(df, "book_id", "section_index", "card_ord", total=F.col("w"), parts=6).collect()
    want, total = {}, 0
    for n, (b, s, c, w) in enumerate(sorted(data), 1):
        total += w
        want[b, s, c] = (n, total)
    assert {(r["book_id"], r["section_index"], r["card_ord"]): (r["n"], r["total"]) for r in got} == want
    numbered = cards.number_cards(df, parts=6)
    assert max(r[0] for r in numbered.groupBy(F.spark_partition_id()).count().select("count").collect()) < 2000  # the hot book is in several ranges
    assert cards.number_cards(df.limit(0)).count() == 0
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


# JSON faults


def books_of_all_sorts():
    rng = random.Random(2)
    good = lambda: {"index": rng.choice([1, 2.5, 3]), "title": "t", "text": "x"}
    odd = [None, 0, -1, "", "s", [], {}, True, False, 1.5, 1e40, {"a": 1}, [1]]
    out = ["", "{", "nul", "null", "0", "0.0", "1", '""', '"x"', "false", "true", "[]", "[1]", "{}", '{"content": null}', '{"content": {}}', '{"content": []}', '{"content": [], "metadata": {}}', '{"content": [], "metadata": []}', '{"content": [1, null, []], "metadata": {}}']
    for _ in range(400):
        content = [good() for _ in range(rng.randint(0, 4))]
        for s in content:
            if rng.random() < 0.4:
                key = rng.choice(["index", "title", "text"])
                if rng.random() < 0.3:
                    del s[key]
                else:
                    s[key] = rng.choice(odd)
        book = {"content": rng.choice(odd) if rng.random() < 0.1 else content}
        if rng.random() < 0.9:
            book["metadata"] = rng.choice(odd)
        out.append(json.dumps(book))
    return out


@pytest.mark.parametrize("options", [{}, {"require_metadata": False}, {"require_titles": False}, {"require_metadata": False, "require_titles": False}])
def test_faults_equal_the_check_of_decoded_books(spark, options):
    texts = books_of_all_sorts()
    got = {r["t"]: r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", validate.faults(F.col("t"), **options).alias("f")).collect()}
    for t in texts:
        try:
            want = validate.check_book(json.loads(t), **options)
        except ValueError:
            want = "the text is no JSON"
        assert got[t] == want, t


# logs of edits


def brute(n, log, most):
    left, stack = list(range(1, n + 1)), []
    for _, op, index in sorted(log):
        if op == "delete" and 1 <= index <= len(left):
            stack.append((index - 1, left.pop(index - 1)))
            if most and len(stack) > most:
                stack.pop(0)
        elif op == "undo" and stack:
            at, section = stack.pop()
            left.insert(at, section)
    return left


@pytest.mark.parametrize("most", [10, 0, 1])
def test_a_log_of_edits(spark, most):
    rng = random.Random(7)
    sizes = {f"b{i}": rng.randint(1, 60) for i in range(12)} | {"big": 3000}
    log = {b: [(k, "undo" if rng.random() < 0.45 else "delete", rng.randint(-1, n + 2)) for k in range(rng.randint(0, 200) if b != "big" else 4000)] for b, n in sizes.items()}
    sections = spark.createDataFrame([(b, i, f"{b}.{i}") for b, n in sizes.items() for i in range(1, n + 1)], SECTIONS)
    edits_ = [(b, *x) for b, v in log.items() for x in v] + [("nobody", 1, "delete", 1), ("b1", None, "delete", 1), (None, 1, "delete", 1)]
    rng.shuffle(edits_)
    got = edits.replay(sections, spark.createDataFrame(edits_, "book_id string, seq bigint, op string, index int"), most).collect()
    for b, n in sizes.items():
        want = brute(n, log[b], most)
        assert [r["text"] for r in sorted((r for r in got if r["book_id"] == b), key=lambda r: r["index"])] == [f"{b}.{i}" for i in want]
        assert sorted(r["index"] for r in got if r["book_id"] == b) == list(range(1, len(want) + 1))


def test_the_registered_log(spark):
    from quire.plans import deeper

    d = "/root/testdata/sf0.001"
    shelf = {}
    for r in sorted(deeper._shelf(spark, d).collect(), key=lambda r: r["index"]):
        shelf.setdefault(r["book_id"], []).append(r["doc_id"])
    log = {}
    for r in deeper._log(spark, d).collect():
        log.setdefault(r["book_id"], []).append((r["seq"], r["op"], r["index"]))
    want = Counter((b, n, ids[p - 1]) for b, ids in shelf.items() for n, p in enumerate(brute(len(ids), log.get(b, []), 10), 1))
    assert Counter(tuple(r) for r in deeper.m2_edit_log(spark, d).collect()) == want


# files of chosen names


def test_books_and_failures_have_their_names(spark, tmp_path):
    s = spark.createDataFrame([("/in/Été.2.epub", 1, "One", 'a "q" \\   é\x01'), ("/in/Été.2.epub", 2, "Two", ""), ("plain", 1, "X", "y")], "book_id string, index int, title string, text string")
    sinks.write_books(sinks.book_json(s), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["plain.json", "Été.2.json"]
    assert (tmp_path / "out" / "plain.json").read_text() == '{\n  "content": [\n    {\n      "index": 1,\n      "title": "X",\n      "text": "y"\n    }\n  ]\n}'
    first = (tmp_path / "out" / "Été.2.json").read_text(encoding="utf-8")
    assert '"text": "a \\"q\\" \\\\   é\\u0001"' in first and json.loads(first)["content"][1]["text"] == ""
    answered = spark.createDataFrame(
        [("/in/a.pdf", 3, "h", "## one\n\n- x", 1, None), ("/in/a.pdf", 7, "h", "prose", 3, "wrong"), ("/in/a.pdf", 9, "h", "## two\n\n- y", 1, None), ("b.epub", 1, "h", " ", 1, "refused"), ("c", 1, "h", "## z\n\n- z", 1, None)],
        "book_id string, section_index int, prompt_hash string, markdown string, attempts int, error string",
    )
    sinks.write_failures(answered, str(tmp_path / "out"), "My deck")
    read = {n: (tmp_path / "out" / n).read_text() for n in os.listdir(tmp_path / "out") if n.endswith(".md")}
    assert read == {"a-partial.md": "# My deck\n\n## one\n\n- x\n", "a-failed-section-2.md": "prose", "b-partial.md": "# My deck\n", "b-failed-section-1.md": generate.NO_ANSWER}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    files = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("id").cast("string")).alias("value")).repartition(4)
    with pytest.raises(Exception, match="lost"):
        named.write_named(files, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    good = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.col("id").cast("string").alias("value"))
    named.write_named(good, str(tmp_path / "out"), overwrite=False)
    assert len(os.listdir(tmp_path / "out")) == 40
    with pytest.raises(Exception, match="already"):
        named.write_named(good.limit(1), str(tmp_path / "out"), overwrite=False)
    named.write_named(good.limit(1).withColumn("value", F.lit("new")), str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 40 and (tmp_path / "out" / "f0").read_text() == "new"
    for bad in (good.withColumn("name", F.lit("same")), good.withColumn("name", F.lit("../x")), good.withColumn("name", F.lit(""))):
        with pytest.raises(Exception, match="name"):
            named.write_named(bad, str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 40
    named.write_named(good, str(tmp_path / "dry"), dry=True)
    assert not os.path.exists(tmp_path / "dry")


def test_one_package_a_book(spark, tmp_path):
    rng = random.Random(3)
    data = [(f"/in/b{b}.epub", s, k, f"front {s}.{k}", None, f"- back {b}", False) for b in range(5) for s in range(1, 4) for k in range(1, 30)]
    rng.shuffle(data)
    table = spark.createDataFrame(data, cards.CARD_ROWS).repartition(6)
    named.write_packages(table, str(tmp_path / "out"), "Deck")
    assert sorted(os.listdir(tmp_path / "out")) == [f"b{b}.apkg" for b in range(5)]
    for b in range(5):
        with zipfile.ZipFile(tmp_path / "out" / f"b{b}.apkg") as z:
            (tmp_path / "c").write_bytes(z.read("collection.anki2"))
        db = sqlite3.connect(tmp_path / "c")
        assert [r[0] for r in db.execute("select sfld from cards join notes on nid = notes.id order by due")] == [f"front {s}.{k}" for s in range(1, 4) for k in range(1, 30)]
        db.close()
    before = (tmp_path / "out" / "b3.apkg").read_bytes()
    named.write_packages(table, str(tmp_path / "out"), "Deck")
    assert (tmp_path / "out" / "b3.apkg").read_bytes() == before


# many title rules


def test_required_letters():
    need = title_index.required
    assert need(r"^about\s+the\s+.+$") == "about" and need("^(?:foo|bar)x+abcd?") == "abc" and need("a|bcd") == "" and need("(ab(cd))+ef") == "abcd"
    assert need("x*") == "" and need("[abc]def") == "def" and need("(") == "" and need("Émile Zola") == "le zola" and need("Émile Zola", "") == "mile zola" and need("a(?=bcd)") == "a"


def test_ten_thousand_rules_equal_the_fold(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    vocabulary = [word() for _ in range(3000)]
    rules = [*filters.DEFAULT_TITLE_RULES]
    for i in range(10_000):
        a, b = rng.choice(vocabulary), rng.choice(vocabulary)
        rules.append(rng.choice([{"type": "regex", "pattern": f"^{a}\\s+{b}"}, {"type": "regex", "pattern": f"{a}.*{b}$", "flags": "i"}, {"type": "string", "value": f" {a.upper()} {b}"}, {"type": "regex", "pattern": f"({a}|{b}) {a}{b}"}]))
    rules += [{"type": "regex", "pattern": "^ab?$"}, {"type": "regex", "pattern": "("}, {"type": "string", "value": " "}, {"type": "regex", "pattern": r"^\W*\d+\W*$"}]
    titles = [f"{rng.choice(vocabulary)} {rng.choice(vocabulary)}" for _ in range(400)] + [r["value"] for r in rules if r["type"] == "string"][:60] + ["Contents", "ABOUT  the author", " Index ", "", None, "ab", "12.", "a", "Contents", "Praise of me"]
    titles += ["pra\u0131\u017fe of me", "\u0131ndex", "note\u017f"]
    titles += [r["pattern"].replace("^", "").replace("\\s+", "  ").replace(".*", " - ").replace("$", "") for r in rules if r.get("pattern", "(").find("(") < 0][30:120]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, title string")
    table = filters.rules_table(spark, rules)
    got = title_index.with_title_reason(df, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {r["id"]: r["title_reason"] for r in got.collect()}
    compiled = [(r, re.compile(r["pattern"], re.I) if r["type"] == "regex" and r["pattern"] != "(" else None) for r in rules]
    for i, t in enumerate(titles):
        if t and re.search("[\u0131\u017f]", t):  # held against the fold below
            continue
        lower = (t or "").lower().strip()
        first = next((r for r, c in compiled if t and (c.search(lower) if c else r["type"] == "string" and r["value"].strip() and r["value"].strip().lower() == lower)), None)
        assert found[i] == (f"matches filter pattern: {first.get('pattern') or first.get('value')}" if first else None), t
    odd = df.where("title rlike '[\u0131\u017f]'")
    assert rows(odd.select("id", filters.title_reason(F.col("title"), filters.DEFAULT_TITLE_RULES))) == rows(title_index.with_title_reason(odd, filters.rules_table(spark, filters.DEFAULT_TITLE_RULES)).select("id", "title_reason"))
    few = [*filters.DEFAULT_TITLE_RULES, *rules[21:60]]
    by_fold = df.select("id", filters.title_reason(F.col("title"), few).alias("r"))
    assert rows(by_fold) == rows(title_index.with_title_reason(df, filters.rules_table(spark, few)).select("id", "title_reason"))


def test_rules_meet_long_titles_by_their_bytes():
    import numpy as np

    rng = random.Random(9)
    assert title_index.required_runs(r"this[a-z]*\W+Émile zola.*") == ["this", "mile zola"] and title_index.required_runs("(") == []
    asked = [b"abc", b"bcab", b"abcabcab", b"cab"]
    keys = np.array([title_index.key_of(k) for k in asked], np.uint64)
    slots, codes = np.zeros(1 << title_index.SLOT_BITS, bool), np.zeros(title_index.CODES, bool)
    slots[title_index._slots(keys)] = True
    codes[[title_index._codes(*k[:3]) for k in asked]] = True
    texts = [b"", b"ab", b"c", "é abc ı".encode(), b"abca", *(bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 4000))) for _ in range(60))]
    ends = np.cumsum([0, *map(len, texts)])
    t, k = title_index.found_keys(np.frombuffer(b"".join(texts), np.uint8), ends, codes, slots, [3, 4, 8])
    got = {(int(i), int(x)) for i, x in zip(t, k) if x in keys}
    assert got == {(i, title_index.key_of(a)) for i, x in enumerate(texts) for a in asked if a in x} and len(t) < 4 * len(texts)


# media


def test_media_by_the_first_folder(spark, tmp_path):
    for i, names in enumerate((["a.png", "b.png"], ["b.png", "c.png"], ["c.png", "d.png", "huge.png"])):
        (tmp_path / f"f{i}").mkdir()
        for n in names:
            (tmp_path / f"f{i}" / n).write_bytes(f"{i}{n}".encode())
    folder = lambda i: spark.createDataFrame([(n, str(tmp_path / f"f{i}" / n)) for n in os.listdir(tmp_path / f"f{i}")], "name string, path string")
    in_memory = spark.createDataFrame([("b.png", bytearray(b"1b.png")), ("c.png", bytearray(b"1c.png"))], "name string, content binary")
    refs = spark.createDataFrame([("a.png",), ("b.png",), ("c.png",), ("d.png",), ("d.png",), ("none.png",), ("https://x/y.png",), (None,)], "ref string")
    (tmp_path / "f2" / "huge.png").unlink()  # nobody asks for it, so nobody misses it
    want = [("a.png", b"0a.png", None), ("b.png", b"0b.png", None), ("c.png", b"1c.png", None), ("d.png", b"2d.png", None), ("d.png", b"2d.png", None), ("https://x/y.png", None, "remote media is disabled"), ("none.png", None, "; ".join(f"not found: none.png in folder {i}" for i in (1, 2, 3)))]
    for second in (folder(1), in_memory):
        got = [(r["ref"], bytes(r["content"]) if r["content"] is not None else None, r["error"]) for r in books.resolve_media(refs, [folder(0), second, folder(2)]).collect() if r["ref"]]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert books.resolve_media(refs, []).count() == 8 and books.resolve_media(refs.limit(0), [folder(0)]).count() == 0
    plan = books.first_media(refs, [folder(0), folder(1), folder(2)])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    missing = books.fetched(spark.createDataFrame([("x", str(tmp_path / "no"))], "name string, path string")).first()
    assert missing["content"] is None and missing["fetch_error"]


# fenced lines


def fence_lines(rng, n):
    pool = ["```", "````", "~~~", "~~~~~", "   ```", "    ```", "``` x", "```a`b", "~~~ `x", "text", "", "## a", "``` ", "`````"]
    return [rng.choice(pool) for _ in range(n)]


def test_effects_compose():
    rng = random.Random(5)
    for _ in range(300):
        parts = [fence_lines(rng, rng.randint(0, 8)) for _ in range(3)]
        one, two, three = (fences.effect(p) for p in parts)
        whole = fences.effect([x for p in parts for x in p])
        for state in ("", "```", "````", "``````", "~~~", "~~~~~~~"):
            want = state
            for x in (x for p in parts for x in p):
                want = fences.after(want, x)
            assert whole.on(state) == one.then(two).then(three).on(state) == one.then(two.then(three)).on(state) == three.on(two.on(one.on(state))) == want


def test_fenced_lines_of_documents_over_many_tasks(spark):
    rng = random.Random(8)
    docs = {f"d{i}": fence_lines(rng, rng.randint(1, 40)) for i in range(30)} | {"big": [rng.choice(["x", "y"]) if rng.random() < 0.995 else rng.choice(["```", "~~~~", "````"]) for _ in range(20_000)], None: fence_lines(rng, 9)}
    data = [(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "book_id string, line_no int, line string")
    out = fences.with_in_code(df, parts=7)
    got = {(r["book_id"], r["line_no"]): r["in_code"] for r in out.collect()}
    assert got == {(d, i): c for d, lines in docs.items() for i, c in enumerate(cards.in_code(lines))}
    assert out.where("book_id = 'big'").groupBy(F.spark_partition_id()).count().count() > 3
    assert fences.with_in_code(df.limit(0)).count() == 0
    odd = spark.createDataFrame([("a", 0, "```"), ("a", 1, None), ("a", 2, "x")], "book_id string, line_no int, line string")
    assert [r["in_code"] for r in fences.with_in_code(odd).orderBy("line_no").collect()] == [True, True, True]


def test_fenced_lines_of_many_small_documents_go_as_arrow(spark):
    rng = random.Random(11)
    docs = {i: fence_lines(rng, rng.randint(1, 6)) for i in range(300)} | {None: fence_lines(rng, 30)}
    df = spark.createDataFrame([(x, i, d) for d, lines in docs.items() for i, x in enumerate(lines)], "text string, line_no int, book int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = fences.with_in_code(df, doc="book", line="text", parts=5)
        got = {(r["book"], r["line_no"]): r["in_code"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(d, i): c for d, lines in docs.items() for i, c in enumerate(cards.in_code(lines))}
    assert out.columns == ["text", "line_no", "book", "in_code"] and "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
