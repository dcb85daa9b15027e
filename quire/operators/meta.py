"""Metadata of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import file_stem, first_non_blank


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def counters(marked: DataFrame) -> DataFrame:
    """Extracted and filtered chapters of each book, from chapters with filter_reason."""
    kept = F.col("filter_reason").isNull()
    return marked.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("extracted_sections"), F.count_if(~kept).alias("filtered_sections"))


def epub_metadata(books: DataFrame) -> DataFrame:
    """books: book_id, file_name, title, creator, publisher, date, language, isbn, total, first, last, extracted, filtered."""
    c = F.col
    return books.select(
        "book_id", F.coalesce(F.nullif(c("title"), F.lit("")), file_stem(c("file_name"), ".epub")).alias("title"),
        _or(c("creator"), "Unknown Author").alias("author"), _or(c("publisher"), "Unknown Publisher").alias("publisher"),
        _or(c("date"), "Unknown Date").alias("date"), _or(c("language"), "Unknown Language").alias("language"), "isbn",
        F.lit("epub").alias("fileType"), c("total").alias("totalPages"), (c("last") - c("first") + 1).alias("extractedPages"),
        c("extracted").alias("extractedSections"), c("filtered").alias("filteredSections"),
        F.concat(F.lit("Chapters "), c("first").cast("string"), F.lit("-"), c("last").cast("string")).alias("extractedRange"),
        F.lit("epub-library").alias("processingMethod"), F.lit(True).alias("hasIndex"), c("total").alias("indexChapters"),
    )


def pdf_metadata(books: DataFrame) -> DataFrame:
    """books: book_id, file_name, info (map), meta_title, meta_author, version, total, extracted, index_size, index_pages (null without an index); has_acro_form and has_xfa, if known."""
    c = F.col
    forms = [F.coalesce(c(k), F.lit(False)).alias(n) for k, n in (("has_acro_form", "hasAcroForm"), ("has_xfa", "hasXFA")) if k in books.columns]
    info = lambda k: F.try_element_at(c("info"), F.lit(k))
    indexed = c("index_size").isNotNull()
    return books.select(
        "book_id", F.coalesce(first_non_blank(info("Title"), info("title"), c("meta_title")), file_stem(c("file_name"), ".pdf")).alias("title"),
        F.coalesce(first_non_blank(info("Author"), info("author"), c("meta_author")), F.lit("Unknown Author")).alias("author"),
        *[first_non_blank(info(k)).alias(n) for k, n in (("Creator", "creator"), ("Producer", "producer"), ("CreationDate", "creationDate"), ("ModDate", "modificationDate"))],
        F.lit("pdf").alias("fileType"), c("total").alias("totalPages"), F.when(indexed, c("index_pages")).otherwise(c("total")).alias("extractedPages"),
        c("extracted").alias("extractedSections"), F.lit(0).alias("filteredSections"),
        F.when(indexed, F.concat(F.lit("Chapters 1-"), c("index_size").cast("string"))).otherwise("All Pages").alias("extractedRange"),
        F.when(indexed, "pdf-parse-with-index").otherwise("pdf-parse-single-text").alias("processingMethod"),
        c("version").alias("pdfVersion"), *forms, indexed.alias("hasIndex"), F.coalesce(c("index_size"), F.lit(0)).alias("indexChapters"),
    )


def file_type(path: Column, given: Column | None = None) -> Column:
    """pdf or epub, from a given type or else the extension; anything else is an error."""
    out = F.lit(None).cast("string")
    if given is not None:
        g = F.lower(F.trim(given))
        out = F.when(g.isin("pdf", "application/pdf"), "pdf").when(g.isin("epub", "application/epub+zip"), "epub")
    e = F.lower(F.regexp_extract(path, r"\.[^.]*$", 0))
    by_name = F.when(e == ".pdf", "pdf").when(e == ".epub", "epub")
    return F.coalesce(out, by_name, F.raise_error(F.concat(F.lit("Unsupported file type: "), path)).cast("string"))
