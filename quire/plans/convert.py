"""Whole conversions: files in, metadata, clean numbered sections and plain text out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import assemble, filters, meta, selectors
from quire.sources import books


@dataclass(frozen=True)
class Converted:
    """Tables of the converted books; `audit` has every chapter with the reason why it was filtered."""

    metadata: DataFrame
    sections: DataFrame
    plain: DataFrame
    audit: DataFrame | None = None


def epub(spark: SparkSession, path: str, start=None, end=None, exclude: str | None = None, min_chars: int | None = None, rules: list[dict] | None = None, full_fidelity: bool = False, parts: DataFrame | None = None) -> Converted:
    """EPUB files. Options are checked before a file is read; a range outside a book fails when that book is reached.

    Full fidelity leaves the title rules out. Each table opens an archive once; parts: rows of read_epub_parts or of
    the epub data source, where they are read or stored already.
    """
    first, last = selectors.section_number(start, "startChapter"), selectors.section_number(end, "endChapter")
    if (first is not None and first < 1) or (last is not None and last < 1):
        raise ValueError("startChapter and endChapter must be at least 1.")
    if first is not None and last is not None and first > last:
        raise ValueError("startChapter must be less than or equal to endChapter.")
    excluded = selectors.parse_exclude(exclude)
    chapters = books.chapters(books.read_epub_parts(spark, path, first, last, excluded) if parts is None else parts)
    total = F.count_if(F.col("ord") > 0).over(Window.partitionBy("book_id"))
    chapters = chapters.withColumns({"total": total, "first": F.lit(first or 1)}).withColumn("last", F.coalesce(F.lit(last), F.col("total")).cast("int"))
    fault = (F.col("first") > F.col("total")) | (F.col("last") > F.col("total"))
    message = F.concat(F.lit("The chapter range must be within 1 and "), F.col("total").cast("string"))
    chapters = chapters.where(F.when(fault, F.raise_error(message).cast("boolean")).otherwise(True))
    everything = filters.with_reason(chapters, start=F.col("first"), end=F.col("last"), excluded=excluded, min_chars=min_chars, rules=[] if full_fidelity else rules)
    marked = everything.where("ord > 0")
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    sections = marked.where("filter_reason is null").select("book_id", number.alias("index"), "title", "text", F.col("ord").alias("original_chapter_index"))
    sections = assemble.clean_sections(sections)
    chapter = F.col("ord") > 0
    counts = everything.groupBy("book_id").agg(
        F.first(F.when(~chapter, F.col("facts")), ignorenulls=True).alias("facts"), F.max("first").alias("first"), F.max("last").alias("last"),
        F.count_if(chapter & F.col("filter_reason").isNull()).alias("extracted"), F.count_if(chapter & F.col("filter_reason").isNotNull()).alias("filtered"),
    )
    metadata = meta.epub_metadata(counts.select("book_id", *books.epub_facts(F.col("facts")), "first", "last", "extracted", "filtered"))
    return Converted(metadata, sections, assemble.plain_text(sections), marked.select("book_id", "ord", "title", "filter_reason", "error"))


def pdf(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None] | dict], index_path: str | None = None, index_ranges: str | None = None, min_chars: int | None = None, store: str | None = None) -> Converted:
    """PDF files through an extractor of page texts and facts; the index is resolved and checked before a file is read.

    A file whose pages give no section gives its raw text, if the extractor has one. store: a folder to which what was
    extracted is written first, so that the extractor runs once a file for all tables.
    """
    entries = selectors.resolve_index(index_path, index_ranges)
    parts = books.read_pdf_parts(spark, path, extract)
    if store is not None:
        parts.write.mode("errorifexists").parquet(store)
        parts = spark.read.parquet(store)
    pages, files = parts.where("page_no > 0").drop("facts"), books.pdf_info(parts.where("page_no = 0"))
    totals = files.select("book_id", F.col("total").alias("total_pages"))
    names = files.select("book_id", "file_name")
    if entries:
        # the entries of one index, for every book
        one = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(e["start"]).alias("start"), F.lit(e["end"]).alias("end"), F.lit(e.get("title")).cast("string").alias("title")) for i, e in enumerate(entries, 1)])
        ranges = totals.select("book_id", F.explode(one).alias("x")).select("book_id", "x.*")
        sections = assemble.by_index(pages, ranges, totals)
        claimed = assemble.index_pages(ranges).withColumnRenamed("pages", "index_pages")
    else:
        sections, claimed = assemble.whole_book(pages, names), None
    raw = assemble.raw_text_sections(files, sections)
    sections = sections.unionByName(raw, allowMissingColumns=True)
    extracted = sections.groupBy("book_id").agg(F.count(F.lit(1)).alias("extracted"))
    sections = filters.min_chars(assemble.clean_sections(sections), min_chars)
    found = files.drop("raw_text").join(extracted, "book_id", "left").withColumns({"extracted": F.coalesce("extracted", F.lit(0)), "index_size": F.lit(len(entries) if entries else None).cast("int")})
    found = found.join(claimed, "book_id", "left") if claimed is not None else found.withColumn("index_pages", F.lit(None).cast("bigint"))
    metadata = meta.pdf_metadata(found)
    return Converted(metadata, sections.drop("dropped"), assemble.plain_text(sections))
