"""Page ranges, chapter selections and their checks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The messages of errors in this module are those that users of such ranges and selections know.
_RANGE = re.compile(r"(\d+)\s*-\s*(\d+)")
_JS_SPACE = "\t\n\x0b\f\r \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def _page(value, field: str, label: str, n: int) -> int:
    whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if not whole or value <= 0:
        raise ValueError(f'{label} entry {n} has invalid "{field}"; expected a positive integer.')
    return int(value)


def check_ranges(entries: list[dict], label: str) -> None:
    """Raise for the first entry that is backwards, out of order or overlaps the one before."""
    if not entries:
        raise ValueError(f"{label} must contain at least one range.")
    for i, now in enumerate(entries):
        if now["start"] > now["end"]:
            raise ValueError(f"{label} entry {i + 1} has start page {now['start']} greater than end page {now['end']}.")
        if i and now["start"] < entries[i - 1]["start"]:
            raise ValueError(f"{label} entries must be sorted by start page in ascending order.")
        if i and now["start"] <= entries[i - 1]["end"]:
            raise ValueError(f"{label} entries {i} and {i + 1} overlap on pages {now['start']}-{min(entries[i - 1]['end'], now['end'])}.")


def index_entries(raw: list, label: str = "Index file") -> list[dict]:
    """Decoded index entries; titles are trimmed and blank ones left out."""
    out = []
    for n, x in enumerate(raw, 1):
        if not isinstance(x, dict):
            raise ValueError(f'{label} entry {n} must be an object with "start" and "end" fields.')
        entry = {k: _page(x.get(k), k, label, n) for k in ("start", "end")}
        title = x.get("title")
        if title is not None and not isinstance(title, str):
            raise TypeError(f'{label} entry {n} has invalid "title"; expected a string.')
        if title and title.strip(_JS_SPACE):
            entry["title"] = title.strip(_JS_SPACE)
        out.append(entry)
    check_ranges(out, label)
    return out


def parse_index_ranges(text: str) -> list[dict]:
    """`1-3,4-18`."""
    if not text.strip(_JS_SPACE):
        raise ValueError("Index ranges must not be empty.")
    out = []
    for n, part in enumerate(text.strip(_JS_SPACE).split(","), 1):
        part = part.strip(_JS_SPACE)
        if not part:
            raise ValueError(f'Index ranges segment {n} is empty. Use comma-separated "<start>-<end>" ranges.')
        m = _RANGE.fullmatch(part)
        if not m:
            raise ValueError(f'Index ranges segment {n} must use "<start>-<end>" syntax.')
        out.append({k: _page(int(v), k, "Index ranges", n) for k, v in zip(("start", "end"), m.groups())})
    check_ranges(out, "Index ranges")
    return out


def load_index(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if not isinstance(raw, list):
        raise TypeError("Index file must be a JSON array of chapters")
    return index_entries(raw)


def resolve_index(index_path: str | None = None, index_ranges: str | None = None) -> list[dict] | None:
    if index_path and index_ranges is not None:
        raise ValueError("Use either indexPath or indexRanges, not both.")
    if index_ranges is not None:
        return parse_index_ranges(index_ranges)
    return load_index(index_path) if index_path else None


def parse_exclude(text: str | None) -> list[int] | None:
    """`3,7,25-27` as sorted distinct chapter numbers."""
    if text is None:
        return None
    if not text.strip(_JS_SPACE):
        raise ValueError("excludeChapters must not be empty.")
    out: set[int] = set()
    for n, part in enumerate(text.strip(_JS_SPACE).split(","), 1):
        part = part.strip(_JS_SPACE)
        if not part:
            raise ValueError(f'Exclude chapters segment {n} is empty. Use comma-separated "<chapter>" or "<start>-<end>" values.')
        if re.fullmatch(r"[0-9]+", part):
            out.add(int(part))
            continue
        m = _RANGE.fullmatch(part)
        if not m:
            raise ValueError(f'Exclude chapters segment {n} must use "<chapter>" or "<start>-<end>" syntax.')
        a, b = map(int, m.groups())
        if a > b:
            raise ValueError(f"Exclude chapters segment {n} has start chapter {a} greater than end chapter {b}.")
        out.update(range(a, b + 1))
    return sorted(out)


def section_number(value, label: str) -> int | None:
    """An integer, or a string that begins with one; null passes."""
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise TypeError(f"{label} must be an integer.")
    if isinstance(value, str):
        m = re.match(rf"[{_JS_SPACE}]*([+-]?\d+)", value)
        if not m:
            raise TypeError(f"{label} must be an integer.")
        return int(m[1])
    if value != int(value):
        raise TypeError(f"{label} must be an integer.")
    return int(value)


def chapter_range(total: int, start=None, end=None) -> tuple[int, int]:
    """First and last chapter, from 1; the whole book by default."""
    a = section_number(start, "startChapter")
    b = section_number(end, "endChapter")
    a, b = 1 if a is None else a, total if b is None else b
    for name, value in (("startChapter", a), ("endChapter", b)):
        if not 1 <= value <= total:
            raise ValueError(f"{name} must be between 1 and {total}.")
    if a > b:
        raise ValueError("startChapter must be less than or equal to endChapter.")
    return a, b


def ranges_table(spark: SparkSession, entries: list[dict], book_id: str | None = None) -> DataFrame:
    rows = [(book_id, i, e["start"], e["end"], e.get("title")) for i, e in enumerate(entries, 1)]
    return spark.createDataFrame(rows, "book_id string, ord int, start int, end int, title string")


def index_issues(ranges: DataFrame, label: str = "Index ranges") -> DataFrame:
    """Rows book_id, ord, message: the first fault of each book's ranges; books without a fault have none.

    The relational form of check_ranges for many books at once: each range is held against the one before.
    """
    w = Window.partitionBy("book_id").orderBy("ord")
    lagged = ranges.withColumns({"ps": F.lag("start").over(w), "pe": F.lag("end").over(w), "n": F.row_number().over(w)})
    message = (
        F.when(F.col("start") > F.col("end"), F.format_string(f"{label} entry %d has start page %d greater than end page %d.", F.col("n"), F.col("start"), F.col("end")))
        .when(F.col("start") < F.col("ps"), F.lit(f"{label} entries must be sorted by start page in ascending order."))
        .when(F.col("start") <= F.col("pe"), F.format_string(f"{label} entries %d and %d overlap on pages %d-%d.", F.col("n") - 1, F.col("n"), F.col("start"), F.least("pe", "end")))
    )
    return lagged.withColumn("message", message).where("message is not null").groupBy("book_id").agg(F.min(F.struct("n", "message")).alias("m")).select("book_id", F.col("m.n").alias("ord"), "m.message")


def index_template(spark: SparkSession, count: int, pages: int = 2) -> DataFrame:
    i = F.col("id")
    return spark.range(1, count + 1).select(i.cast("int").alias("ord"), ((i - 1) * pages + 1).cast("int").alias("start"), (i * pages).cast("int").alias("end"), F.concat(F.lit("Section "), i.cast("string")).alias("title"))


def index_templates(books: DataFrame, pages: int = 2) -> DataFrame:
    """A template of index entries for each row (book_id, count): so many entries of `pages` pages each; none for a count below 1."""
    i = F.col("ord")
    each = books.where("count > 0").select("book_id", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("ord"))
    return each.select("book_id", "ord", ((i - 1) * pages + 1).alias("start"), (i * pages).alias("end"), F.concat(F.lit("Section "), i.cast("string")).alias("title"))


def _template(entries: Column) -> Column:
    return F.concat(F.lit("[\n"), F.array_join(F.transform(F.array_sort(entries), lambda x: x["line"]), ",\n"), F.lit("\n]\n"))


def _entry_line() -> Column:
    from quire.functions.text import js_trim

    title = F.when(js_trim(F.coalesce("title", F.lit(""))) != "", F.concat(F.lit(', "title": '), F.substring(F.to_json(F.array("title")), F.lit(2), F.length(F.to_json(F.array("title"))) - 2))).otherwise("")
    return F.concat(F.format_string('  { "start": %d, "end": %d', "start", "end"), title, F.lit(" }"))


def format_templates(entries: DataFrame) -> DataFrame:
    """Rows book_id, template: the entries of each book, one object a line."""
    return entries.groupBy("book_id").agg(_template(F.collect_list(F.struct("ord", _entry_line().alias("line")))).alias("template"))


def format_template(entries: DataFrame) -> DataFrame:
    """One row, template: one object a line."""
    return entries.agg(F.when(F.count(F.lit(1)) == 0, "[]\n").otherwise(_template(F.collect_list(F.struct("ord", _entry_line().alias("line"))))).alias("template"))
