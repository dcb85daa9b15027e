"""Readers: book JSON, EPUB files, PDF pages through an extractor that is passed in, Markdown decks, prompts."""

from __future__ import annotations

import functools
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.schema import BOOK, PAGES
from quire.functions.text import clean_html, js_trim
from quire.operators.cards import issue_table
from quire.operators.selectors import section_number
from quire.operators.validate import faults


def read_book_json(spark: SparkSession, path: str, require_metadata: bool = False, require_titles: bool = False) -> tuple[DataFrame, DataFrame]:
    """books (book_id, metadata) and sections from book JSON files; nothing is cleaned or filtered.

    book_id is the file's path. Metadata and titles may be absent; index is read as a number of any kind. A file that
    is no JSON, or whose shape is wrong, is an error when it is reached.
    """

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("book_id"), "value")
    fault = faults(F.col("value"), require_metadata=require_metadata, require_titles=require_titles)
    sound = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("Invalid JSON input: "), fault)).cast("string")).otherwise(F.col("value"))
    raw = files.select("book_id", F.from_json(sound, BOOK).alias("b")).select("book_id", "b.*")
    sections = raw.select("book_id", F.posexplode("content").alias("pos", "s")).select("book_id", (F.col("pos") + 1).alias("ord"), F.col("s.index").alias("index"), "s.title", "s.text", F.col("s.pageRange").alias("page_range"), F.col("s.pageCount").alias("page_count"))
    return raw.select("book_id", "metadata"), sections


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def epub_chapters(file, wanted: Callable[[int], bool] = lambda n: True) -> Iterator[tuple[int, str | None, str | None, str | None, dict[str, str] | None]]:
    """Rows (ord, title, html, error, facts) of an open archive: 0 for the book with its facts, then each spine item.

    A broken chapter has an error and no text. Chapters that are not wanted are listed, but not read; one chapter is
    held at a time.
    """
    with zipfile.ZipFile(file) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        opf = ElementTree.fromstring(z.read(opf_path))
        base = posixpath.dirname(opf_path)
        meta: dict[str, str] = {}
        for e in opf.iter():
            name = _local(e.tag)
            if name in ("title", "creator", "publisher", "date", "language") and e.text:
                meta.setdefault(name, e.text)
            if name == "identifier" and e.text and "isbn" in " ".join([*e.attrib.values(), e.text]).lower():
                meta.setdefault("isbn", e.text)
        items = {e.get("id"): e for e in opf.iter() if _local(e.tag) == "item"}
        spine = [e for e in opf.iter() if _local(e.tag) == "itemref"]
        yield 0, meta.get("title"), None, None, meta | {"total": str(len(spine))}
        titles = _toc_titles(z, base, items) if spine else {}
        for n, ref in enumerate(spine, 1):
            item = items.get(ref.get("idref"))
            href = unquote(item.get("href", "")) if item is not None else ""
            href, html, error = posixpath.normpath(href), None, None
            if wanted(n):
                try:
                    html = z.read(posixpath.normpath(posixpath.join(base, href))).decode("utf-8", "replace")
                except Exception as e:  # whatever is wrong with one chapter leaves the others readable
                    error = str(e) or type(e).__name__
            yield n, titles.get(href), html, error, None


def epub_parts(data: bytes, wanted: Callable[[int], bool] = lambda n: True) -> tuple[dict, list[tuple[int, str | None, str | None, str | None]]]:
    """Metadata and (ord, title, html, error) of each spine item of an archive's bytes."""
    (_, _, _, _, facts), *chapters = epub_chapters(io.BytesIO(data), wanted)
    return {k: v for k, v in facts.items() if k != "total"}, [c[:4] for c in chapters]


def _toc_titles(z: zipfile.ZipFile, base: str, items: dict) -> dict[str, str]:
    """Chapter titles by file, from the NCX table of contents and, for files it leaves out, the navigation document."""
    out: dict[str, str] = {}

    def parts(item, tag: str) -> list:
        try:
            tree = ElementTree.fromstring(z.read(posixpath.normpath(posixpath.join(base, item.get("href", "")))))
        except (KeyError, ElementTree.ParseError):
            return []
        return [e for e in tree.iter() if _local(e.tag) == tag]

    def add(folder: str, src: str | None, label: str | None) -> None:
        if label and label.strip() and src:
            out.setdefault(posixpath.normpath(posixpath.join(folder, unquote(src.split("#")[0]))), label)

    for item in items.values():
        if item.get("media-type") == "application/x-dtbncx+xml":
            for point in parts(item, "navPoint"):
                add("", next((e.get("src") for e in point.iter() if _local(e.tag) == "content"), None), next((e.text for e in point.iter() if _local(e.tag) == "text"), None))
    for item in items.values():
        if "nav" in item.get("properties", "").split():
            folder = posixpath.dirname(item.get("href", ""))
            for nav in parts(item, "nav"):
                for link in (e for e in nav.iter() if _local(e.tag) == "a"):
                    add(folder, link.get("href"), "".join(link.itertext()))
    return out


EPUB_PARTS = "book_id string, ord int, title string, html string, error string, facts map<string,string>"


def read_epub_parts(spark: SparkSession, path: str, start=None, end=None, excluded: list[int] | None = None) -> DataFrame:
    """Rows of EPUB files by one open of each: ord 0 is the book with its facts, then its chapters in spine order.

    Chapters outside the selection are listed, but their text is not read. This reader takes any store that Spark
    reads; the data source of quire.sources.files pushes filters down and fetches parts of an archive.
    """
    a, b, skip = section_number(start, "startChapter"), section_number(end, "endChapter"), frozenset(excluded or ())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for book, data in zip(f["path"], f["content"]):
                try:
                    rows = [(book, n, title, html, error, {"file_name": posixpath.basename(book), **facts} if facts is not None else None) for n, title, html, error, facts in epub_chapters(io.BytesIO(data), lambda n: n not in skip and (a or 1) <= n <= (b or n))]
                except Exception as e:
                    raise ValueError(f"Failed to parse EPUB: {e}") from e
                yield pd.DataFrame(rows, columns=["book_id", "ord", "title", "html", "error", "facts"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, EPUB_PARTS)


def read_epub(spark: SparkSession, path: str, start=None, end=None, excluded: list[int] | None = None) -> DataFrame:
    """raw_chapters of EPUB files in spine order; chapters outside the selection are listed, but their text is not read."""
    return read_epub_parts(spark, path, start, end, excluded).where("ord > 0").drop("facts")


def epub_facts(facts: Column) -> list[Column]:
    """The facts of a book as columns: file_name, title, creator, publisher, date, language, isbn and the number of its chapters."""
    of = lambda k: F.try_element_at(facts, F.lit(k))
    return [*[of(k).alias(k) for k in ("file_name", "title", "creator", "publisher", "date", "language", "isbn")], of("total").cast("int").alias("total")]


def epub_metadata_table(spark: SparkSession, path: str) -> DataFrame:
    """One row for each EPUB file with its facts; no chapter is read."""
    return read_epub_parts(spark, path, excluded=None, start=1 << 30).where("ord = 0").select("book_id", *epub_facts(F.col("facts")))


def chapters(raw: DataFrame) -> DataFrame:
    """raw_chapters as chapters of clean text; untitled ones are called by their number."""
    title = F.when(js_trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(F.concat(F.lit("Section "), F.col("ord").cast("string")))
    return raw.select("book_id", "ord", title.alias("title"), clean_html(F.col("html")).alias("text"), "error", *[c for c in ("facts",) if c in raw.columns])


def _extracted(found) -> dict:
    """What an extractor gave: a list of page texts, or a mapping with pages and, if known, text, info, metadata and total."""
    return found if isinstance(found, dict) else {"pages": list(found)}


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None] | dict]) -> DataFrame:
    """pages of PDF files; `extract` gives the text of each page of a file's bytes, alone or with the file's facts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for book, data in zip(f["path"], f["content"]):
                yield pd.DataFrame([(book, n, t) for n, t in enumerate(_extracted(extract(data)).get("pages") or [], 1)], columns=["book_id", "page_no", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGES)


def _flag(value) -> str | None:
    return str(value).lower() if isinstance(value, bool) else None


def pdf_facts(found) -> tuple[list[str | None], str | None, dict[str, str]]:
    """Page texts, raw text and facts of what an extractor gave; facts have strings only.

    The page count is what the extractor says, else the number of pages; the metadata's own `_metadata` is unwrapped;
    form flags stand in the information dictionary as IsAcroFormPresent and IsXFAPresent.
    """
    x = _extracted(found)
    info = {k: v for k, v in (x.get("info") or {}).items() if isinstance(v, str)}
    own = x.get("metadata") or {}
    own = own.get("_metadata") or own
    pages = list(x.get("pages") or [])
    named = {f"meta.{k}": own.get(k) for k in ("title", "author")} | {"version": info.get("PDFFormatVersion", "").strip() and info["PDFFormatVersion"]}
    flags = {"acro_form": _flag((x.get("info") or {}).get("IsAcroFormPresent")), "xfa": _flag((x.get("info") or {}).get("IsXFAPresent"))}
    facts = {f"info.{k}": v for k, v in info.items()} | {k: v for k, v in (named | flags).items() if isinstance(v, str) and v}
    return pages, x.get("text"), facts | {"total": str(x.get("total") or len(pages))}


def pdf_info(files: DataFrame) -> DataFrame:
    """book_id, file_name, raw_text, info, meta_title, meta_author, version, total, has_acro_form, has_xfa from the rows of page 0 (book_id, text, facts) of a PDF source."""
    fact = lambda k: F.try_element_at("facts", F.lit(k))
    info = F.map_from_entries(F.transform(F.filter(F.map_entries("facts"), lambda e: F.startswith(e["key"], F.lit("info."))), lambda e: F.struct(F.substring(e["key"], F.lit(6), F.length(e["key"])), e["value"])))
    return files.select(
        "book_id", fact("file_name").alias("file_name"), F.col("text").alias("raw_text"), info.alias("info"), fact("meta.title").alias("meta_title"), fact("meta.author").alias("meta_author"),
        fact("version").alias("version"), fact("total").cast("int").alias("total"), fact("acro_form").cast("boolean").alias("has_acro_form"), fact("xfa").cast("boolean").alias("has_xfa"),
    )


def read_pdf_parts(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None] | dict]) -> DataFrame:
    """Rows book_id, page_no, text, facts of PDF files: page 0 is the file, with its raw text and facts. One extraction a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for book, data in zip(f["path"], f["content"]):
                pages, text, facts = pdf_facts(extract(data))
                rows = [(book, 0, text, {"file_name": posixpath.basename(book), **facts}), *[(book, n, t, None) for n, t in enumerate(pages, 1)]]
                yield pd.DataFrame(rows, columns=["book_id", "page_no", "text", "facts"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "book_id string, page_no int, text string, facts map<string,string>")


def read_pdf_info(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None] | dict]) -> DataFrame:
    """A row for each PDF file: its information dictionary, the title and author of its metadata, version, raw text, page count and form flags."""
    return pdf_info(read_pdf_parts(spark, path, extract).where("page_no = 0"))


def read_decks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Markdown files as answers (book_id, section_index, markdown), and their issues, which are warnings here."""
    decks = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("book_id"), F.lit(1).alias("section_index"), F.col("value").alias("markdown"))
    return decks, issue_table(decks)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts in a folder by name, without .md, in the order of their names."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    found = spark.read.text(path, wholetext=True).select(name.alias("file"), F.col("value").alias("prompt")).where(F.col("file").rlike(r"(?i)\.md$"))
    return found.select(F.regexp_replace("file", r"(?i)\.md$", "").alias("name"), "prompt").orderBy(F.collate("name", "UNICODE"))


def load_prompt(spark: SparkSession, path: str, name: str) -> str:
    """One prompt of a folder; its name may have .md and must be of letters, digits, dot, dash and underscore."""
    clean = re.sub(r"(?i)\.md$", "", name.strip())
    if not re.fullmatch(r"[a-zA-Z0-9._-]+", clean):
        raise ValueError(f'Prompt name "{name}" has characters that are not allowed.')
    found = read_prompts(spark, path).where(F.col("name") == clean).take(1)
    if not found:
        raise FileNotFoundError(f'Prompt "{clean}" not found. Expected under {path}.')
    return found[0]["prompt"]


def first_media(refs: DataFrame, folders: list[DataFrame]) -> DataFrame:
    """Rows ref, folder: for each distinct reference that a folder has, the first of the folders, from 1.

    Names alone are looked at, all folders in one grouping; what no one asks for is left out before it is grouped.
    """
    empty = refs.select(F.col("ref").alias("name"), F.lit(None).cast("int").alias("folder")).where("false")
    names = functools.reduce(DataFrame.unionByName, [f.select("name", F.lit(i).alias("folder")) for i, f in enumerate(folders, 1)], empty)
    # references are rows of folder null: one exchange brings both together
    both = names.unionByName(refs.select(F.col("ref").alias("name"), F.lit(None).cast("int").alias("folder")))
    found = both.where("name is not null").groupBy("name").agg(F.min("folder").alias("folder"), F.count_if(F.col("folder").isNull()).alias("asked"))
    return found.where("asked > 0 and folder is not null").select(F.col("name").alias("ref"), "folder")


def fetched(rows: DataFrame, column: str = "path") -> DataFrame:
    """rows with the content of the file that a column names, read by the tasks; a file that cannot be read has null content and an error."""
    from quire.sources.files import opened

    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(len(f)):  # one file at a time
                one, content, error = f.iloc[i : i + 1], None, None
                try:
                    if isinstance(path := one[column].iloc[0], str):
                        with opened(path.removeprefix("file:")) as handle:
                            content = handle.read()
                except Exception as e:
                    error = str(e) or type(e).__name__
                yield one.assign(content=[content], fetch_error=[error])

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInPandas(run, f"{kinds}, content binary, fetch_error string")


def resolve_media(refs: DataFrame, files: list[DataFrame], allow_remote: bool = False) -> DataFrame:
    """refs (ref) with content from the first of the folders that has it; remote ones are refused unless allowed.

    A folder has rows (name, content) or (name, path); files given by path are opened only if they are the ones that a
    reference gets. The error of a reference that no folder has joins what each of them lacks. Equal references keep
    their rows; null ones are in no folder. A name should be once in a folder.
    """
    winners = first_media(refs, files)
    parts = []
    for i, f in enumerate(files, 1):
        won = f.join(winners.where(F.col("folder") == i), f["name"] == F.col("ref"), "left_semi")
        parts.append(won.select(F.col("name").alias("__name"), "content") if "content" in f.columns else fetched(won.select(F.col("name").alias("__name"), "path")).select("__name", "content"))
    none = refs.select(F.col("ref").alias("__name"), F.lit(None).cast("binary").alias("content")).where("false")
    out = refs.join(functools.reduce(DataFrame.unionByName, parts, none), F.col("ref") == F.col("__name"), "left")
    remote = F.col("ref").rlike(r"(?i)^https?://")
    reasons = F.concat_ws("; ", *[F.concat(F.lit("not found: "), F.col("ref"), F.lit(f" in folder {i}")) for i in range(1, len(files) + 1)])
    error = F.when(remote & F.lit(not allow_remote), "remote media is disabled").when(F.col("content").isNull() & ~remote, reasons)
    return out.select("ref", F.when(~remote, F.col("content")).alias("content"), error.alias("error"))
