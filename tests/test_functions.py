"""Text and number functions on single values."""

import pytest
from pyspark.sql import functions as F

from quire.functions import fmt
from quire.functions import text as T


def values(spark, f, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


NBSP, BOM, NEL = " ", "﻿", "\u0085"


def test_white_space(spark):
    assert values(spark, T.js_trim, [f"{NBSP} a b{BOM}　", f"{NEL}a", None, "", "\x0b\x0c a\n"]) == ["a b", f"{NEL}a", None, "", "a"]
    assert values(spark, T.collapse, [f"a{NBSP}\t b", f"a{NEL}b"]) == ["a b", f"a{NEL}b"]


def test_clean_text(spark):
    assert values(spark, T.clean_text, ["a\rb", "a\x00b", "  a \n\n b  ", None, "a\r\nb"]) == ["ab", "ab", "a b", "", "a b"]


def test_clean_html(spark):
    cases = ["<p>a</p><p>b</p>", "<SCRIPT>x</SCRIPT>y", "<script>\nx</script>y", "&amp;lt;&nbsp;&copy;", "", None, "a<br>b &#39;c&#39;"]
    assert values(spark, T.clean_html, cases) == ["ab", "y", "xy", "< &copy;", "", "", "ab 'c'"]


def test_lengths(spark):
    assert values(spark, T.utf16_len, ["a\U0001f600", "", None, "é"]) == [3, 0, None, 1]
    assert values(spark, lambda c: T.utf16_left(c, 2), ["a\U0001f600b", "abc", "\U0001f600b"]) == ["a", "ab", "\U0001f600"]


def test_preview(spark):
    assert values(spark, lambda c: T.preview(c, 5), ["abc", "  ", "abcde f", "abcd  efg", None]) == ["abc", "[empty]", "abcde...", "abcd...", "[empty]"]
    assert values(spark, lambda c: T.preview(c, 0), ["x" * 121]) == ["x" * 120 + "..."]


def test_names(spark):
    assert values(spark, T.kebab, ["  Hello, World! ", "---", None, "A1 b"]) == ["hello-world", "deck", "deck", "a1-b"]
    assert values(spark, lambda c: T.file_stem(c, ".pdf"), ["a.pdf.b.pdf", "a.PDF", "x"]) == ["a.b.pdf", "a.PDF", "x"]
    assert values(spark, T.prompt_name, ["a.md", "b.MD", "../x", "c d", "e"]) == ["a", "b", None, None, "e"]
    assert values(spark, T.path_arg, [" a ", "  ", None]) == ["a", None, None]
    assert values(spark, T.url_extension, ["http://h/a/b.png?x=.gif", "http://h.com", "http://h/a.b/c", "http://h/.x"]) == [".png", "", "", ""]
    assert values(spark, T.uri_decode, ["a%20b+c"]) == ["a b+c"]
    assert values(spark, lambda c: T.language(c, T.LANGUAGE_ALIASES), ["py", "constructor", None]) == ["python", "constructor", None]


def test_redact(spark):
    cases = ["Authorization: bearer abc.d-e f", "key sk-abcdefghijkl end", "sk-short", "OPENAI_API_KEY=xyz next"]
    assert values(spark, T.redact, cases) == ["Authorization: bearer [redacted] f", "key [redacted-api-key] end", "sk-short", "OPENAI_API_KEY=[redacted] next"]
    assert values(spark, T.error_output, ["x" * 2001, " ", None]) == ["x" * 2000 + "...", "", ""]


def test_answers_and_logs(spark):
    cases = ['" hi "', '[{"type":"text","text":" a "},{"type":"image"},{"type":"text","text":""},{"type":"text","text":"b"}]', '"  "', "null", "[]", None]
    assert values(spark, T.answer_text, cases) == ["hi", "a\nb", None, None, None, None]
    cases = ["retrying, 2 attempts remaining with status 503", "retrying, 1 attempt remaining: connection timed out", "retrying, 4 attempts remaining", "other"]
    assert values(spark, lambda c: T.retry_log_line(F.lit("X"), c), cases) == ["X: 503, retrying (2 left)", "X: connection timed out, retrying (1 left)", "X: error, retrying (4 left)", None]


@pytest.mark.parametrize(("pattern", "flags", "text", "hit"), [("^index$", "i", "index\n", False), ("^INDEX$", "i", "index", True), ("^a$", "", "A", False), ("^a$", "m", "b\na", True), (r"^a\sb$", None, f"a{NBSP}b", True)])
def test_regex(spark, pattern, flags, text, hit):
    assert values(spark, lambda c: c.rlike(T.java_regex(pattern, flags)), [text]) == [hit]


def test_bad_regex():
    assert T.java_regex("(") is None
    assert T.java_regex("a", "q") is None


def test_numbers(spark):
    assert values(spark, fmt.file_size, [0, 1024, 524288, 1048576, 2621440, 1048575], "bigint") == ["0.0 KB", "1.0 KB", "512.0 KB", "1.00 MB", "2.50 MB", "1024.0 KB"]
    assert values(spark, fmt.number_groups, [1234567.9, -1234.5, 0.0, None], "double") == ["1 234 567", "-1 234", "0", None]
    assert values(spark, fmt.count, [1234567], "bigint") == ["1,234,567"]
    assert values(spark, fmt.duration, [1234, 5], "bigint") == ["1.23s", "0.01s"]
    assert values(spark, fmt.clock, [61_499, 59_500, 3_600_000], "bigint") == ["01:01", "01:00", "60:00"]
    assert values(spark, lambda c: fmt.chapter_label(c, F.lit(120)), [7, 120], "int") == ["  7.", "120."]
    assert values(spark, fmt.timeout_ms, [1.9, 0.0, -1.0, float("inf"), None], "double") == [1, 600000, 600000, 600000, 600000]
