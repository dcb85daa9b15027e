"""Sections from pages, chapters and runs of text; numbering; plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clean_text, file_stem, js_trim, uri_decode
from quire.operators.filters import once, with_reason

#: Runs of text whose y differ by less are on one line.
LINE_TOLERANCE = 0.1
SECTION_COLUMNS = ["book_id", "index", "title", "text", "page_range", "page_count"]


def ordered_concat(order: Column | str, text: Column, separator: str = "\n\n") -> Column:
    """Aggregate: texts in order, joined."""
    order = F.col(order) if isinstance(order, str) else order
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def with_text(pages: DataFrame) -> DataFrame:
    """Pages that are not blank, trimmed."""
    return pages.withColumn("text", js_trim("text")).where("text <> ''")


def by_index(pages: DataFrame, ranges: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """A section for each index range of a book that has text: its pages, trimmed and joined.

    Ranges outside the book (1 to total pages, from totals or else the last page) and backwards ones are left out, and
    so are ranges without text; `index` keeps the range's place, so gaps stay. Ranges become page numbers, which
    makes the range join an equal join.
    """
    if totals is None:
        totals = pages.groupBy("book_id").agg(F.max("page_no").alias("total_pages"))
    good = ranges.join(totals, "book_id").where("start >= 1 and end <= total_pages and start <= end")
    numbers = good.select("book_id", "ord", "start", "end", "title", F.explode(F.sequence("start", "end")).alias("page_no"))
    met = numbers.join(with_text(pages).select("book_id", "page_no", "text"), ["book_id", "page_no"])
    out = met.groupBy("book_id", "ord", "start", "end", "title").agg(js_trim(ordered_concat("page_no", F.col("text"))).alias("text"))
    title = F.when(js_trim(F.coalesce("title", F.lit(""))) != "", js_trim("title")).otherwise(F.concat(F.lit("Section "), F.col("ord").cast("string")))
    return out.select("book_id", F.col("ord").alias("index"), title.alias("title"), "text", F.format_string("%d-%d", "start", "end").alias("page_range"), (F.col("end") - F.col("start") + 1).alias("page_count"))


def whole_book(pages: DataFrame, file_names: DataFrame | None = None) -> DataFrame:
    """One section for each book that has text, from all its pages."""
    out = pages.groupBy("book_id").agg(
        F.max("page_no").alias("total"),
        js_trim(ordered_concat("page_no", F.when(js_trim(F.coalesce("text", F.lit(""))) != "", js_trim("text")))).alias("text"),
        F.count_if(js_trim(F.coalesce("text", F.lit(""))) != "").cast("int").alias("processed_pages"),
    ).where("text <> ''")
    name = F.col("book_id")
    if file_names is not None:
        out, name = out.join(file_names.select("book_id", "file_name"), "book_id", "left"), F.col("file_name")
    return out.select("book_id", F.lit(1).alias("index"), file_stem(name, ".pdf").alias("title"), "text", F.concat(F.lit("1-"), F.col("total").cast("string")).alias("page_range"), F.col("total").alias("page_count"), "processed_pages")


def raw_text_sections(raw: DataFrame, sections: DataFrame) -> DataFrame:
    """For books (book_id, file_name, raw_text) without a section: their raw text as one, unless blank."""
    missing = raw.join(sections.select("book_id").distinct(), "book_id", "left_anti").where(js_trim(F.coalesce("raw_text", F.lit(""))) != "")
    return missing.select("book_id", F.lit(1).alias("index"), file_stem(F.col("file_name"), ".pdf").alias("title"), js_trim("raw_text").alias("text"))


def page_text(runs: Column) -> Column:
    """Text of a page's positioned runs in reading order: by line, then from left to right, each followed by a space; empty runs are passed over.

    Down the page, a run starts a new line if its y is the tolerance or more below the run before it; runs at one place
    keep their order. So runs that are closer than the tolerance are always read from left to right.
    """
    kind = "struct<line:int,x:double,i:int,R:array<struct<T:string>>>"
    down = F.array_sort(F.transform(runs, lambda r, i: F.struct(r["y"].alias("y"), r["x"].alias("x"), i.alias("i"), r["R"].alias("R"))))
    start = F.struct(F.lit(0).alias("line"), F.lit(None).cast("double").alias("y"), F.array().cast(f"array<{kind}>").alias("out"))

    def place(a: Column, r: Column) -> Column:
        line = a["line"] + F.coalesce((r["y"] - a["y"] >= LINE_TOLERANCE).cast("int"), F.lit(0))
        one = F.struct(line.alias("line"), r["x"].alias("x"), r["i"].alias("i"), r["R"].alias("R"))
        return F.struct(line.alias("line"), r["y"].alias("y"), F.concat(a["out"], F.array(one)).alias("out"))

    placed = F.array_sort(F.aggregate(down, start, place, lambda a: a["out"]))
    parts = F.flatten(F.transform(placed, lambda r: F.transform(F.filter(r["R"], lambda t: t["T"] != ""), lambda t: F.concat(uri_decode(t["T"]), F.lit(" ")))))
    return F.array_join(parts, "")


def pages_from_runs(pages: DataFrame) -> DataFrame:
    """pages (book_id, page_no, runs) as pages of text."""
    return pages.select("book_id", "page_no", js_trim(page_text(F.col("runs"))).alias("text"))


def index_pages(ranges: DataFrame) -> DataFrame:
    """Pages that a book's ranges claim; faulty ranges count too."""
    return ranges.groupBy("book_id").agg(F.sum(F.col("end") - F.col("start") + 1).cast("bigint").alias("pages"))


def reindex(sections: DataFrame, order: str = "index") -> DataFrame:
    """index becomes 1..n in order."""
    return sections.withColumn("index", F.row_number().over(Window.partitionBy("book_id").orderBy(order)))


def chapters_to_sections(chapters: DataFrame, **options) -> DataFrame:
    """Kept chapters (book_id, ord, title, text), numbered from 1; original_chapter_index keeps their place."""
    kept = with_reason(once(chapters, "text"), **options).where("filter_reason is null")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    return kept.select("book_id", n.alias("index"), "title", "text", F.col("ord").alias("original_chapter_index"))


def clean_sections(sections: DataFrame) -> DataFrame:
    return sections.withColumn("text", clean_text(F.col("text")))


def plain_text(sections: DataFrame) -> DataFrame:
    """Rows book_id, plain: each section's heading and text, joined."""
    head = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.col("index").cast("string"), F.lit(". "), F.col("title"))).otherwise(F.concat(F.lit("Section "), F.col("index").cast("string")))
    block = F.concat_ws("\n", head, F.nullif(F.col("text"), F.lit("")))
    return sections.groupBy("book_id").agg(js_trim(ordered_concat("index", block)).alias("plain"))
