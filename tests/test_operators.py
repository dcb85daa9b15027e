"""Operators on small tables."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import assemble, cards, edits, filters, generate, meta, retry, selectors, summary, validate
from quire.sources import books, settings, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.mark.parametrize(("text", "message"), [
    ("", "must not be empty"), (" ", "must not be empty"), ("1-2,", "segment 2 is empty"), ("1", "segment 1 must use"), ("1-x", "segment 1 must use"),
    ("0-2", 'entry 1 has invalid "start"'), ("3-2", "start page 3 greater than end page 2"), ("3-4,1-2", "sorted by start page"), ("1-3,3-5", "entries 1 and 2 overlap on pages 3-3"), ("1-9,2-5", "overlap on pages 2-5"),
])
def test_bad_index_ranges(text, message):
    with pytest.raises(ValueError, match=message.replace("(", r"\(")):
        selectors.parse_index_ranges(text)


def test_ranges_and_exclusions(tmp_path):
    assert selectors.parse_index_ranges(" 1 - 3 , 4-18") == [{"start": 1, "end": 3}, {"start": 4, "end": 18}]
    assert selectors.parse_exclude("3,7,25-27,0") == [0, 3, 7, 25, 26, 27]
    for bad in ("", "1,,2", "a", "5-3"):
        with pytest.raises(ValueError):
            selectors.parse_exclude(bad)
    assert selectors.chapter_range(5) == (1, 5) and selectors.chapter_range(5, "2", 3) == (2, 3)
    for bad in ((0,), (5, 0), (5, 1, 6), (5, 3, 2)):
        with pytest.raises(ValueError):
            selectors.chapter_range(*bad)
    with pytest.raises(TypeError):
        selectors.section_number(True, "startChapter")
    f = tmp_path / "index.json"
    f.write_text('[{"start":1,"end":2,"title":" A "},{"start":3,"end":4,"title":" "}]')
    assert selectors.resolve_index(str(f)) == [{"start": 1, "end": 2, "title": "A"}, {"start": 3, "end": 4}]
    assert selectors.resolve_index() is None
    with pytest.raises(ValueError, match="not both"):
        selectors.resolve_index(str(f), "1-2")
    for bad in ('{}', '[1]', '[{"start":1.5,"end":2}]', '[{"start":1}]', '[{"start":1,"end":2,"title":3}]', "[]"):
        f.write_text(bad)
        with pytest.raises((ValueError, TypeError)):
            selectors.load_index(str(f))


def test_index_issues(spark):
    r = spark.createDataFrame([("a", 1, 1, 3), ("a", 2, 3, 5), ("b", 1, 1, 2), ("b", 2, 3, 4), ("c", 1, 5, 4), ("d", 1, 4, 5), ("d", 2, 1, 2)], "book_id string, ord int, start int, end int")
    got = {b: (o, m) for b, o, m in rows(selectors.index_issues(r, "Index file"))}
    assert set(got) == {"a", "c", "d"}
    assert got["a"] == (2, "Index file entries 1 and 2 overlap on pages 3-3.")
    assert "greater than" in got["c"][1] and "sorted" in got["d"][1]


def test_template(spark):
    t = selectors.format_template(selectors.index_template(spark, 2)).first()[0]
    assert json.loads(t) == [{"start": 1, "end": 2, "title": "Section 1"}, {"start": 3, "end": 4, "title": "Section 2"}]
    assert t.startswith('[\n  { "start": 1, "end": 2, "title": "Section 1" },\n')
    assert selectors.format_template(selectors.index_template(spark, 0)).first()[0] == "[]\n"


def test_default_titles(spark):
    dropped = ["Contents", "content", "Dedication", "About the Author", "Also by X", "INDEX", "Credits", "Copyright", "Notes", "Notes on Sources", "Bibliography", "Acknowledgments", "Acknowledgement", "Acknowledgments and Notes on Sources", "Frontispiece", "Welcome", "Title Page", "Table of Contents", "Newsletter", "Praise of", "Praise of X", "A Note on the Author", "Author's Note", "Author’s Note", " Illustration Credits "]
    kept = ["Chapter 1", "Index of things", "Notes on a scandal", "Welcome home", "My contents"]
    df = spark.createDataFrame([(t,) for t in dropped + kept], "t string")
    got = {r["t"] for r in df.where(filters.title_reason(F.col("t"), filters.DEFAULT_TITLE_RULES).isNotNull()).collect()}
    assert got == set(dropped)


def test_cascade(spark):
    c = spark.createDataFrame([("b", i, t, x) for i, (t, x) in enumerate([("One", "x" * 50), ("Two", "y" * 50), ("Index", "z" * 50), ("Four", "  "), ("Five", "short"), ("Six", "w" * 2000), (None, "v" * 50)], 1)], "book_id string, ord int, title string, text string")
    with pytest.warns(UserWarning, match="does not compile"):
        out = filters.with_reason(c, start=2, end=9, excluded=[2], min_chars=10, rules=[{"type": "regex", "pattern": "("}, {"type": "string", "value": " "}, *filters.DEFAULT_TITLE_RULES])
    assert [r["filter_reason"] for r in out.orderBy("ord").collect()] == ["outside range 2-9", "excluded by --exclude-sections", "matches filter pattern: ^index$", "empty content", "below minimum characters: 5 < 10", None, None]
    s = assemble.chapters_to_sections(c, rules=filters.DEFAULT_TITLE_RULES)
    assert [(r["index"], r["original_chapter_index"]) for r in s.orderBy("index").collect()] == [(1, 1), (2, 2), (3, 5), (4, 6), (5, 7)]


def test_min_chars_renumbers_only_after_a_loss(spark):
    s = spark.createDataFrame([("a", 1, "xx"), ("a", 3, "yyyy"), ("b", 2, "zzzz"), ("b", 5, "wwww")], "book_id string, index int, text string")
    assert rows(filters.min_chars(s, 3).select("book_id", "index", "dropped")) == [("a", 1, 1), ("b", 2, 0), ("b", 5, 0)]
    assert filters.min_chars(s, None).count() == 4


PAGES = [("p.pdf", 1, " one "), ("p.pdf", 2, None), ("p.pdf", 3, " "), ("p.pdf", 4, "four"), ("p.pdf", 5, "five"), ("q.pdf", 1, " ")]


def test_range_join(spark):
    pages = spark.createDataFrame(PAGES, "book_id string, page_no int, text string")
    idx = spark.createDataFrame([("p.pdf", 1, 1, 2, " A "), ("p.pdf", 2, 3, 3, "blank"), ("p.pdf", 3, 4, 5, " "), ("p.pdf", 4, 5, 9, "out"), ("p.pdf", 5, 0, 1, "zero"), ("p.pdf", 6, 3, 2, "back")], "book_id string, ord int, start int, end int, title string")
    assert rows(assemble.by_index(pages, idx)) == [("p.pdf", 1, "A", "one", "1-2", 2), ("p.pdf", 3, "Section 3", "four\n\nfive", "4-5", 2)]
    assert rows(assemble.whole_book(pages)) == [("p.pdf", 1, "p", "one\n\nfour\n\nfive", "1-5", 5, 3)]
    assert rows(assemble.index_pages(idx)) == [("p.pdf", 2 + 1 + 2 + 5 + 2 + 0)]
    raw = spark.createDataFrame([("q.pdf", "q.pdf", " raw "), ("p.pdf", "p.pdf", "no"), ("r", "r", " ")], "book_id string, file_name string, raw_text string")
    assert rows(assemble.raw_text_sections(raw, assemble.whole_book(pages))) == [("q.pdf", 1, "q", "raw")]


def test_runs(spark):
    df = spark.sql("select 'b' book_id, 1 page_no, from_json('[{\"x\":5,\"y\":1.02,\"R\":[{\"T\":\"b%20c\"}]},{\"x\":1,\"y\":1.0,\"R\":[{\"T\":\"a+\"}]},{\"x\":0,\"y\":2,\"R\":[{\"T\":\"d\"}]}]', 'array<struct<x:double,y:double,R:array<struct<T:string>>>>') runs")
    assert assemble.pages_from_runs(df).first()["text"] == "a+ b c d"


def test_plain_text(spark):
    s = spark.createDataFrame([("b", 1, "T", "x"), ("b", 2, "", "y"), ("b", 3, "U", "")], "book_id string, index int, title string, text string")
    assert assemble.plain_text(s).first()["plain"] == "1. T\nx\n\nSection 2\ny\n\n3. U"


def test_metadata(spark):
    b = spark.sql("select 'b' book_id, 'f.epub' file_name, '' title, cast(null as string) creator, 'P' publisher, cast(null as string) date, 'en' language, cast(null as string) isbn, 9 total, 2 first, 4 last, 2 extracted, 7 filtered")
    r = meta.epub_metadata(b).first()
    assert (r["title"], r["author"], r["publisher"], r["date"], r["isbn"], r["extractedPages"], r["extractedRange"]) == ("f", "Unknown Author", "P", "Unknown Date", None, 3, "Chapters 2-4")
    p = spark.sql("select 'b' book_id, 'f.pdf' file_name, map('Title', '  ', 'title', ' T ') info, 'M' meta_title, 'A' meta_author, '1' version, 9 total, 1 extracted, cast(null as int) index_size, cast(null as int) index_pages")
    r = meta.pdf_metadata(p).first()
    assert (r["title"], r["author"], r["extractedRange"], r["processingMethod"], r["hasIndex"], r["indexChapters"]) == (" T ", "A", "All Pages", "pdf-parse-single-text", False, 0)
    t = spark.createDataFrame([("a.PDF", None), ("b.bin", "application/epub+zip"), ("c.epub", "what")], "p string, g string")
    assert [r[0] for r in t.select(meta.file_type(F.col("p"), F.col("g"))).collect()] == ["pdf", "epub", "epub"]
    with pytest.raises(Exception, match="Unsupported file type"):
        spark.createDataFrame([("x.txt",)], "p string").select(meta.file_type(F.col("p"))).collect()


def test_overlaps(spark):
    s = spark.createDataFrame([("b", 1, "A", "1-10"), ("b", 2, " ", "10-12"), ("b", 3, "C", "5-6"), ("b", 4, "D", "x"), ("b", 5, "E", "100-300"), ("b", 6, "F", "150-700"), ("c", 1, "G", "1-10"), ("b", 7, "H", None)], "book_id string, index int, title string, page_range string")
    got = rows(summary.page_overlaps(s).select("book_id", "left_index", "right_index", "right_title", "overlap_start", "overlap_end", "label"))
    assert got == [("b", 1, 2, "Section 2", 10, 10, "page 10"), ("b", 1, 3, "C", 5, 6, "pages 5-6"), ("b", 5, 6, "F", 150, 300, "pages 150-300")]
    line = summary.section_line(spark.sql("select 'b' book_id, 1 index, 'T' title, 'abc' text, '1-1' page_range, 1 page_count")).first()["line"]
    assert line == "- T | pages: 1-1 (1 page) | chars: 3"


def test_validation(spark):
    good = {"metadata": {}, "content": [{"index": 1, "title": "a", "text": ""}]}
    assert validate.check_book(good) is None
    assert validate.check_book(None) == "JSON data is null or undefined"
    assert validate.check_book([]) == "JSON data must have a content array" or validate.check_book([]) == "JSON data is null or undefined"
    assert validate.check_book({"content": []}) == "JSON data must have a metadata object"
    assert validate.is_book({"content": [{"index": 1.5, "text": ""}]}, require_metadata=False, require_titles=False)
    assert "Section 1" in validate.check_book({"content": [{"index": 0, "text": ""}]}, require_metadata=False, require_titles=False)
    s = spark.createDataFrame([("a", 1, 1.0, "t", "x"), ("a", 2, 0.0, "t", "x"), ("b", 1, 1.0, "", "x"), ("c", 1, 1.0, "t", "")], "book_id string, ord int, index double, title string, text string")
    assert rows(validate.violations(s).select("book_id", "position")) == [("a", 2), ("b", 1)]
    assert rows(validate.violations(s, require_titles=False).select("book_id", "position")) == [("a", 2)]


def test_edits(spark):
    s = spark.createDataFrame([("b", i, t) for i, t in enumerate(["One", "Two", "Three"], 1)], "book_id string, index int, title string")
    gone = edits.delete_section(s, 2)
    assert rows(gone) == [("b", 1, "One"), ("b", 2, "Three")]
    assert rows(edits.undo_delete(gone, edits.deleted(s, 2, 5))) == rows(s)
    m = spark.sql("select 'b' book_id, 3 extracted_sections, 1 filtered_sections")
    assert rows(edits.recount(m, gone, 1)) == [("b", 2, 2)]
    stack = spark.sql("select array('a','b','c') s")
    got = stack.select(edits.push(F.col("s"), F.lit("d"), 3), edits.push(F.col("s"), F.lit("d"), 0), edits.pop(F.col("s")), edits.top(F.col("s")), edits.top(edits.clear(F.col("s"))), edits.can_undo(F.col("s"))).first()
    assert list(got) == [["b", "c", "d"], ["a", "b", "c", "d"], ["a", "b"], "c", None, True]


def test_card_grammar():
    (c,) = cards.read_answer("## Front\n\nAsk.\n\n***\n\n- Answer")
    assert (c["front_body"], c["back"], c["has_separator"]) == ("Ask.", "- Answer", True)
    body = "```markdown\n## Not a card\n\n***\n```\n\n- a"
    (c,) = cards.read_answer(f"## Front\n\n{body}")
    assert c["back"] == body
    for text, message in [
        ("just prose", "No flashcards detected"), ("just prose", "before the first card front"), ("## F\n\npara", 'Card "F" is missing bullet items'),
        ("## F\n\n```yaml\n- no\n```", "missing bullet"), ("## F\n\n- a\n\n## \n\n- b", "malformed-card-skipped"), ("## F\n\n- a\n-  \n- b", "lines 4"),
        ("## F\n\n- a\n\n# S\n\n## O\n\n- b", "stray-h1"), ("## A\n\n- x\n\n## A\n\n- y", 'Duplicate card front "A"'),
    ]:
        with pytest.raises(ValueError, match=message):
            cards.read_answer(text)
    region = "## A\n\nAsk.\n\n***\n\n- x\n\n## B\n\n- y"
    assert "\n\n".join(cards.render_card(c) for c in cards.read_answer(region)) == region
    assert cards.render_card(cards.read_answer("## A\n- x\n***\n- y")[0]) == "## A\n\n- x\n\n***\n\n- y"


def test_generation(spark, tmp_path):
    calls = []

    def client(prompt, text):
        if text == "bad":
            return "nothing"
        if text == "down":
            raise retry.CallError("no", status=400)
        return f"## {text}\n\n- a"

    s = spark.createDataFrame([("b", 1, " one "), ("b", 2, "two"), ("b", 3, "bad"), ("b", 4, "four"), ("c", 1, "down"), ("d", 1, " ")], "book_id string, index int, text string")
    a = generate.answers(s, generate.Plan("gemini", "m", "p"), client).cache()
    got = {(r["book_id"], r["section_index"]): r for r in a.collect()}
    assert got["b", 3]["attempts"] == 3 and "No flashcards" in got["b", 3]["error"] and got["c", 1]["error"] == "no" and got["d", 1]["attempts"] == 0
    assert rows(generate.until_failure(a).select("book_id", "section_index")) == [("b", 1), ("b", 2)]
    assert generate.failures(a).count() == 3 and not calls
    table = cards.card_table(generate.until_failure(a).select("book_id", "section_index", "markdown"))
    assert cards.deck_markdown(table, " ").first()["markdown"] == "# Deck\n\n## one\n\n- a\n\n## two\n\n- a\n"
    path = str(tmp_path / "d.apkg")
    assert sinks.write_package(table, path, media={"a.png": b"x"}) == 2
    first = zipfile.ZipFile(path)
    assert sorted(first.namelist()) == ["0", "collection.anki2", "media"]
    (tmp_path / "c").write_bytes(first.read("collection.anki2"))
    assert [r[0] for r in sqlite3.connect(tmp_path / "c").execute("select sfld from notes order by sfld")] == ["one", "two"]
    with pytest.raises(ValueError):
        generate.Plan("gemini", "m", "p", profile="x")
    with pytest.raises(ValueError):
        sinks.write_deck(table.limit(0), str(tmp_path / "deck"))
    sinks.write_failures(a, str(tmp_path / "fail"))
    a.unpersist()


def test_retry(spark):
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 4:
            raise retry.CallError(status=503)
        return "ok"

    assert retry.with_retry(flaky, sleep=waits.append, random=lambda: 0.5) == "ok" and waits == [1500, 3000, 6000]
    for error in (retry.CallError(status=401), retry.CallError(status=429, retry_after="121"), ValueError()):
        n = []
        with pytest.raises(type(error)):
            retry.with_retry(lambda e=error: n.append(1) or (_ for _ in ()).throw(e), sleep=waits.append)
        assert len(n) == 1
    df = spark.sql("select * from values (503, array('x')), (400, array('EPIPE')), (cast(null as int), array('EPIPE')), (null, array('x')), (null, cast(null as array<string>)) t(s, c)")
    assert [r[0] for r in df.select(retry.is_transient(F.col("s"), F.col("c"))).collect()] == [True, False, True, False, False]
    h = spark.sql("select * from values ('5', null), ('-1', null), ('soon', '\"retryDelay\":\"3s\"'), (null, '\"retryDelay\": \"12.5s\"'), (null, 'x'), ('Thu, 01 Jan 1970 00:00:10 GMT', null) t(h, m)")
    assert [r[0] for r in h.select(retry.retry_after_ms(F.col("h"), F.col("m"), F.lit(4000))).collect()] == [5000.0, 0.0, None, 12500.0, None, 6000.0]


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    assert settings.load(str(f)).preview_chars == 120
    f.write_text("{")
    assert settings.load(str(f)).provider == "gemini"
    f.write_text(json.dumps({"epub": {"previewChars": "twelve", "filters": {"titles": [{"type": "regex", "pattern": "("}, {"type": "string", "value": "X"}, {"type": "string", "value": "X"}]}}, "previewChars": 80, "defaultProvider": "anthropic", "output": {"path": "o", "paths": {"md": "m", "json": 3}}, "unknown": 1}))
    s = settings.load(str(f))
    assert (s.preview_chars, s.provider, s.output_path, s.output_paths) == (120, "anthropic", "o", {"md": "m"})
    assert len(s.title_rules) == len(filters.DEFAULT_TITLE_RULES) + 1
    assert sinks.output_path("anki", None, s.output_paths, s.output_path) == "o.apkg" and sinks.output_path("md", None, s.output_paths) == "m.md" and sinks.output_path("json", "a.json") == "a.json"


def test_settings_of_today_and_of_old():
    today = settings.from_dict({
        "output": {"path": "out", "paths": {"anki": "decks"}},
        "generation": {"defaultProvider": "codex", "defaultPrompt": "short", "providers": {"gemini": {}, "openai": {"defaultModel": "gpt-x"}, "codex": {"defaultModel": "gpt-z", "reasoningEffort": " HIGH ", "profile": "work"}, "deepseek": {"reasoningEffort": "most"}}},
        "epub": {"preview": True, "previewChars": 12.0, "filters": {"titles": [{"type": "regex", "pattern": "^A", "flags": "i"}, {"type": "regex", "pattern": "b", "flags": 3}]}},
    })
    assert (today.provider, today.prompt, today.preview, today.preview_chars, today.output_path, today.output_paths) == ("codex", "short", True, 12, "out", {"anki": "decks"})
    assert today.models == settings.DEFAULT_MODELS | {"openai": "gpt-x", "codex": "gpt-z"}
    assert today.efforts == {"codex": "high"} and today.profiles == {"codex": "work"}
    assert today.title_rules[-1] == {"type": "regex", "pattern": "^A", "flags": "i"} and len(today.title_rules) == len(filters.DEFAULT_TITLE_RULES) + 1
    old = settings.from_dict({"outputPath": "o", "defaultProvider": "openai", "defaultPrompt": "p", "providers": {"openai": {"defaultModel": "gpt-old"}, "codex": {"reasoningEffort": "bad", "profile": "a b"}}, "epubFilters": {"titles": [{"type": "string", "value": "Z"}]}})
    assert (old.provider, old.prompt, old.output_path, old.models["openai"], old.efforts, old.profiles) == ("openai", "p", "o", "gpt-old", {"codex": "medium"}, {})
    assert old.title_rules[-1] == {"type": "string", "value": "Z"}
    both = settings.from_dict({"generation": {"defaultProvider": "none", "providers": {"openai": {}}}, "defaultProvider": "anthropic", "providers": {"openai": {"defaultModel": "gpt-old"}}})
    assert both.provider == "anthropic" and both.models["openai"] == settings.DEFAULT_MODELS["openai"]  # an entry is taken whole
    for bad in ({}, None, [], "x", {"epub": {"previewChars": True}}, {"epub": {"previewChars": 1.5}}, {"generation": []}):
        assert settings.from_dict(bad) == settings.Settings()
    assert settings.effort(" Low ", "x") == "low" and settings.effort(None, "x") is None and settings.profile("  ", "x") is None
    for f, bad in ((settings.effort, "most"), (settings.effort, 3), (settings.profile, "a b"), (settings.profile, 0)):
        with pytest.raises(ValueError, match="settings"):
            f(bad, "settings")


def test_dates_do_not_depend_on_the_session(spark):
    h = spark.sql("select * from values ('Wed, 21 Oct 2015 07:28:05 GMT'), ('Wed, 21 Oct 2015 07:27:00 GMT'), ('Sun, 6 Nov 1994 08:49:37 GMT'), ('Wed, 21 Oct 2015 07:28:05') t(h)")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in h.select(retry.retry_after_ms(F.col("h"), F.lit(None).cast("string"), F.lit(1445412480000))).collect()] == [5000.0, 0.0, 0.0, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_runs_are_passed_over(spark):
    runs = "array(named_struct('x', 0d, 'y', 1d, 'R', array(named_struct('T', 'a'), named_struct('T', ''), named_struct('T', cast(null as string)))), named_struct('x', 5d, 'y', 1d, 'R', array(named_struct('T', 'b'))))"
    assert spark.range(1).select(assemble.page_text(F.expr(runs))).first()[0] == "a b "


def test_efforts(spark):
    d = spark.createDataFrame([(" High ",), (None,)], "e string")
    assert [r[0] for r in d.select(text.effort(F.col("e"))).collect()] == ["high", None]
    with pytest.raises(Exception, match="no reasoning effort"):
        spark.createDataFrame([("most",)], "e string").select(text.effort(F.col("e"))).collect()


def test_distinct_rules(spark):
    r = filters.rules_table(spark, [{"type": "string", "value": "a"}], [{"type": "string", "value": "a"}, {"type": "regex", "pattern": "a"}])
    assert rows(filters.distinct_rules(r).select("ord", "type")) == [(0, "string"), (2, "regex")]


def epub(path, chapters):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="c{n}.html" media-type="application/xhtml+xml"/>' for n in range(len(chapters) + 1))
        z.writestr("O/c.opf", f'<package xmlns="p" xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:creator>Me</dc:creator></metadata><manifest>{items}<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>' + "".join(f'<itemref idref="i{n}"/>' for n in range(len(chapters) + 1)) + "</spine></package>")
        z.writestr("O/t.ncx", '<ncx xmlns="n">' + "".join(f'<navPoint><navLabel><text>{t}</text></navLabel><content src="c{n}.html#x"/></navPoint>' for n, (t, _) in enumerate(chapters) if t) + "</ncx>")
        for n, (_, h) in enumerate(chapters):
            z.writestr(f"O/c{n}.html", h)


def test_epub(spark, tmp_path):
    epub(tmp_path / "a.epub", [("Contents", "<p>x</p>"), (None, "<p>a &amp; b</p>"), ("Two", "<p>c</p>")])
    raw = books.read_epub(spark, str(tmp_path / "*.epub"), end=3, excluded=[3])
    got = rows(books.chapters(raw).select("ord", "title", "text"))
    assert got == [(1, "Contents", "x"), (2, "Section 2", "a & b"), (3, "Two", ""), (4, "Section 4", "")]
    assert raw.where("error is not null").count() == 0  # a chapter out of the range is not read
    assert rows(books.read_epub(spark, str(tmp_path / "*.epub")).where("error is not null").select("ord", "html")) == [(4, None)]
    m = books.epub_metadata_table(spark, str(tmp_path / "*.epub")).first()
    assert (m["title"], m["creator"], m["total"], m["file_name"]) == ("Book", "Me", 4, "a.epub")
    (tmp_path / "bad.epub").write_bytes(b"no")
    with pytest.raises(Exception, match="Failed to parse EPUB"):
        books.read_epub(spark, str(tmp_path / "bad.epub")).collect()


def test_book_json_and_other_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"content": [{"index": 1.5, "text": " a "}, {"index": 2, "title": "T", "text": "b"}]}))
    _, s = books.read_book_json(spark, str(tmp_path / "b.json"))
    assert rows(s.select("ord", "index", "title", "text")) == [(1, 1.5, None, " a "), (2, 2.0, "T", "b")]
    assert validate.all_valid(spark, s, require_titles=False)
    j = json.loads(sinks.book_json(s.withColumn("index", F.col("index").cast("int"))).first()["json"])
    assert j == {"content": [{"index": 1, "text": " a "}, {"index": 2, "title": "T", "text": "b"}]}
    (tmp_path / "p.pdf").write_bytes(b"one\ftwo")
    assert rows(books.read_pdf(spark, str(tmp_path / "p.pdf"), lambda b: b.decode().split("\f")).select("page_no", "text")) == [(1, "one"), (2, "two")]
    (tmp_path / "d.md").write_text("# Deck\n\n## A\n\n- x\n")
    decks, found = books.read_decks(spark, str(tmp_path / "d.md"))
    assert decks.count() == 1 and found.count() == 1
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "x.MD").write_text("say")
    (tmp_path / "prompts" / "y.txt").write_text("no")
    assert rows(books.read_prompts(spark, str(tmp_path / "prompts"))) == [("x", "say")]
    refs = spark.createDataFrame([("a.png",), ("http://h/b.png",), ("c.png",)], "ref string")
    one, two = spark.createDataFrame([("a.png", bytearray(b"1"))], "name string, content binary"), spark.createDataFrame([("a.png", bytearray(b"2"))], "name string, content binary")
    got = {r["ref"]: (bytes(r["content"]) if r["content"] else None, r["error"]) for r in books.resolve_media(refs, [one, two]).collect()}
    assert got == {"a.png": (b"1", None), "http://h/b.png": (None, "remote media is disabled"), "c.png": (None, "not found: c.png in folder 1; not found: c.png in folder 2")}


def test_drop_folder(spark, tmp_path):
    from quire.streaming.drop_folder import stream_chapters, write_chapters

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "u", "<title>Index</title><p>x</p>"), (2, "v", "<p>y</p>")], "page_id bigint, url string, html string").write.parquet(src)
    for _ in range(2):
        write_chapters(stream_chapters(spark, src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("page_id", "text", "filter_reason")) == [(1, "Indexx", "matches filter pattern: ^index$"), (2, "y", None)]


def test_convert(spark, tmp_path):
    from quire.plans import convert

    epub(tmp_path / "a.epub", [("Contents", "<p>x</p>"), ("One", "<p>a &amp; b</p>"), ("Two", "<p>c</p>")])
    out = convert.epub(spark, str(tmp_path / "a.epub"), start=1, end=3, exclude="3")
    assert rows(out.sections.select("index", "title", "text", "original_chapter_index")) == [(1, "One", "a & b", 2)]
    assert out.plain.first()["plain"] == "1. One\na & b"
    m = out.metadata.first()
    assert (m["title"], m["author"], m["extractedSections"], m["filteredSections"], m["extractedRange"], m["extractedPages"]) == ("Book", "Me", 1, 3, "Chapters 1-3", 3)
    assert rows(out.audit.select("ord", "filter_reason")) == [(1, "matches filter pattern: ^contents?$"), (2, None), (3, "excluded by --exclude-sections"), (4, "outside range 1-3")]
    assert convert.epub(spark, str(tmp_path / "a.epub"), end=2, full_fidelity=True).sections.count() == 2
    with pytest.raises(Exception, match="within 1 and 4"):
        convert.epub(spark, str(tmp_path / "a.epub"), end=9).sections.collect()
    for bad in ({"start": 0}, {"start": 3, "end": 2}, {"exclude": ""}):
        with pytest.raises(ValueError):
            convert.epub(spark, str(tmp_path / "a.epub"), **bad)
    (tmp_path / "p.pdf").write_bytes(b"one\f \fthree")
    split = lambda b: b.decode().split("\f")
    out = convert.pdf(spark, str(tmp_path / "p.pdf"), split, index_ranges="1-2,3-3,4-9")
    assert rows(out.sections.select("index", "title", "text", "page_range")) == [(1, "Section 1", "one", "1-2"), (2, "Section 2", "three", "3-3")]
    m = out.metadata.first()
    assert (m["title"], m["extractedPages"], m["indexChapters"], m["extractedSections"]) == ("p", 9, 3, 2)
    out = convert.pdf(spark, str(tmp_path / "p.pdf"), split)
    assert rows(out.sections.select("text", "page_range", "processed_pages")) == [("one three", "1-3", 2)]


def test_reading_order_goes_by_gaps(spark):
    run = lambda x, y, t: {"x": x, "y": y, "R": [{"T": t}]}
    pages = [("b", 1, [run(9.0, 1.04, "right"), run(1.0, 1.06, "left"), run(0.0, 1.5, "next")]), ("b", 2, []), ("b", 3, [run(5.0, 2.0, "a"), run(5.0, 2.0, "b")])]
    df = spark.createDataFrame(pages, "book_id string, page_no int, runs array<struct<x:double,y:double,R:array<struct<T:string>>>>")
    assert rows(assemble.pages_from_runs(df).select("page_no", "text")) == [(1, "left right next"), (2, ""), (3, "a b")]


def test_overlaps_of_one_index_and_of_long_ranges(spark):
    ranges = ["1-5", "4-9", "1-9999999999", "64-64", "500-600", "600-700", "7-6", "9999999999-10000000001"]
    s = spark.createDataFrame([("b", 1 if n < 2 else n, str(n), r, n) for n, r in enumerate(ranges)], "book_id string, index int, title string, page_range string, ord int")
    got = [(int(r["left_title"]), int(r["right_title"]), r["overlap_start"], r["overlap_end"]) for r in summary.page_overlaps(s).collect()]
    spans = [tuple(map(int, r.split("-"))) for r in ranges]
    want = [(i, j, max(a, c), min(b, e)) for i, (a, b) in enumerate(spans) for j, (c, e) in enumerate(spans) if i < j and a <= b and c <= e and max(a, c) <= min(b, e)]
    assert sorted(got) == want
    assert summary.page_overlaps(s.drop("ord").where("index = 1")).count() == 1


def test_durations_go_by_the_double(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from quire.functions import fmt

    ms = [0, 5, 15, 1005, 1015, 125, 375, 2675, 10_235, 1_234_565, 99_995, 59_995, 8_000_005]
    df = spark.createDataFrame([(n,) for n in [*ms, None]], "n bigint")
    got = {r["n"]: r["d"] for r in df.select("n", fmt.duration(F.col("n")).alias("d")).collect()}
    assert got == {n: f"{Decimal(n / 1000).quantize(Decimal('0.01'), ROUND_HALF_UP)}s" for n in ms} | {None: None}
    assert got[1005] == "1.00s" and got[125] == "0.13s"


def test_missing_sections_cannot_be_deleted(spark):
    s = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "book_id string, index int, title string")
    assert edits.delete_section(s, 2, "a", strict=True).count() == 2
    with pytest.raises(Exception, match="Section with index 2 not found"):
        edits.delete_section(s, 2, strict=True).collect()
    with pytest.raises(ValueError, match="Invalid JSON data structure"):
        edits.delete_section(s.drop("index"), 1)
    stack = spark.sql("select array(struct('A' title, 5L timestamp), struct('B' title, 6L timestamp)) s union all select array()")
    got = [r[0] for r in stack.select(edits.undo_summary(F.col("s"))).collect()]
    assert [tuple(x) if x else None for x in got] == [("B", 6, 2), None]


def test_retry_lines_say_why():
    lines = []
    errors = [retry.CallError(status=503), retry.CallError("x", code="EPIPE"), TimeoutError("the call took far too long")]

    def call():
        if errors:
            raise errors.pop(0)
        return 1

    assert retry.with_retry(call, sleep=lambda ms: None, random=lambda: 0.5, log=lines.append, label="m") == 1
    assert lines == ["m: 503, retrying in 1.5s (attempt 2/5)", "m: EPIPE, retrying in 3.0s (attempt 3/5)", "m: the call took far too long, retrying in 6.0s (attempt 4/5)"]


def test_arguments():
    from quire.operators import args

    assert args.preview_args(["a", "--preview", "200", "--preview=30", "--preview", "x", "--preview"]) == ["a", "--preview", "--preview-chars", "200", "--preview", "--preview-chars", "30", "--preview", "x", "--preview"]
    assert [args.preview_mode(a) for a in (["--no-preview", "--preview"], ["--preview=false"], ["--preview=3"], [])] == ["disabled", "disabled", "enabled", "unset"]
    assert args.integer_option(None, "--x", 1) is None and args.integer_option(0, "--x", 0) == 0
    for bad, least in ((0, 1), (1.5, 0), ("1", 0), (float("nan"), 0), (True, 0)):
        with pytest.raises(ValueError, match="--x: a whole number"):
            args.integer_option(bad, "--x", least)
    assert sinks.template_path() == "./index.json" and sinks.template_path(None, "/b/My Book.pdf", "o") == "o/my-book.index.json" and sinks.template_path("d") == "d/index.json" and sinks.template_path("d/x.JSON") == "d/x.JSON"
    with pytest.raises(ValueError):
        sinks.template_path("d/x.txt")


def test_plans_of_a_run(spark, tmp_path):
    s = settings.Settings(provider="gemini", models={"gemini": "gemini-x", "codex": "gpt-y"}, efforts={"codex": "low"})
    assert generate.resolve_plan(s, "p") == generate.Plan("gemini", "gemini-x", "p")
    assert generate.resolve_plan(s, "p", "codex") == generate.Plan("codex", "gpt-y", "p", None, "low")
    with pytest.warns(UserWarning, match="does not look like"):
        assert generate.resolve_plan(s, "p", "openai").model == "gemini-x"
    with pytest.raises(ValueError, match="no model is set"):
        generate.resolve_plan(settings.Settings(models={}), "p")
    assert generate.key_of(" openai ", {"OPENAI_API_KEY": "k"}) == ("OPENAI_API_KEY", "k")
    models = spark.createDataFrame([("openai", "GPT-5"), ("openai", "claude"), ("openrouter", "a/b"), ("none", "x")], "p string, m string")
    assert [r[0] for r in models.select(generate.odd_model(F.col("p"), F.col("m"))).collect()] == [False, True, False, None]
    calls = []
    sections = spark.createDataFrame([("b", 1, "one")], "book_id string, index int, text string")
    assert generate.run(sections, generate.resolve_plan(s, "p"), lambda p, t: calls.append(t), dry=True) is None and not calls
    out = generate.run(sections, generate.resolve_plan(s, "p"), lambda p, t: f"## {t}\n\n- a", store=str(tmp_path / "answers"))
    assert out.count() == 1 and out.first()["error"] is None
    with pytest.raises(ValueError, match="No sections"):
        generate.run(sections.limit(0), generate.resolve_plan(s, "p"), None)


def test_faulty_books_and_prompts(spark, tmp_path):
    for n, text in enumerate(["{", '{"content": [{"index": 0, "text": "a"}]}', "[]", '{"content": 3}']):
        (tmp_path / f"{n}.json").write_text(text)
        with pytest.raises(Exception, match="Invalid JSON input"):
            books.read_book_json(spark, str(tmp_path / f"{n}.json"))[1].collect()
    folder = tmp_path / "prompts"
    folder.mkdir()
    for name in ("b", "A", "c"):
        (folder / f"{name}.md").write_text(f"say {name}")
    assert [r["name"] for r in books.read_prompts(spark, str(folder)).collect()] == ["A", "b", "c"]
    assert books.load_prompt(spark, str(folder), "A.md") == "say A"
    with pytest.raises(FileNotFoundError):
        books.load_prompt(spark, str(folder), "z")
    with pytest.raises(ValueError):
        books.load_prompt(spark, str(folder), "../z")


def test_facts_of_a_pdf(spark, tmp_path):
    from quire.plans import convert

    (tmp_path / "p.pdf").write_bytes(b" \f ")
    facts = lambda b: {"pages": b.decode().split("\f"), "text": " all of it ", "total": 7, "info": {"Title": " ", "Creator": "C", "PDFFormatVersion": "1.7", "n": 3}, "metadata": {"_metadata": {"title": "M", "author": "A"}}}
    out = convert.pdf(spark, str(tmp_path / "p.pdf"), facts)
    m = out.metadata.first()
    assert (m["title"], m["author"], m["creator"], m["pdfVersion"], m["totalPages"], m["extractedSections"]) == ("M", "A", "C", "1.7", 7, 1)
    assert rows(out.sections.select("index", "title", "text")) == [(1, "p", "all of it")]
