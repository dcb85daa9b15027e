"""EPUB and PDF files as Spark data sources: one open of a file for its facts and its parts, filters pushed to the reader.

A file is a row of part 0, the book itself with its facts, and a row for each chapter or page from 1 on. Filters on the
part's number and on the file are the reader's own: an archive's chapters that are not asked for are not read, and
files that are not asked for are not opened.

    files.register(spark)
    spark.read.format("epub").load("/in/*.epub").where("ord between 3 and 9")

Files are opened through pyarrow's file systems, so only the wanted ranges of an archive are fetched. Stores that only
Spark can read go through quire.sources.books.
"""

from __future__ import annotations

import math
import operator
import posixpath
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not

EPUB_SCHEMA = "book_id string, ord int, title string, html string, error string, facts map<string,string>"
PDF_SCHEMA = "book_id string, page_no int, text string, facts map<string,string>"
#: Bytes of files that are one task, and the most files of a task.
TASK_BYTES, TASK_FILES = 256 << 20, 64


COMPARE: dict[str, Callable[[int, Any], bool]] = {
    "EqualTo": operator.eq, "EqualNullSafe": operator.eq, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le,
    "In": lambda n, values: n in values, "NotIn": lambda n, values: n not in values,
}


class Part(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(files)
        self.files = files


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, a folder or a pattern in the last part of a path, by name."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    folder, name = posixpath.split(inner)
    if any(c in name for c in "*?["):
        found = [x for x in store.get_file_info(fs.FileSelector(folder or ".")) if fnmatch(posixpath.basename(x.path), name)]
    else:
        one = store.get_file_info(inner)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = store.get_file_info(fs.FileSelector(inner, recursive=True)) if one.type == fs.FileType.Directory else [one]
    return sorted((scheme + x.path, x.size or 0) for x in found if x.type == fs.FileType.File)


def opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


class Wanted:
    """The parts and files that pushed filters leave; filters of other kinds are not taken."""

    def __init__(self, number: str) -> None:
        self.number, self.tests, self.files = number, [], []

    def take(self, f: Filter) -> bool:
        name = f.attribute[0] if getattr(f, "attribute", None) else None
        if name == self.number and isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, (int, float)):
            self.tests.append((type(f).__name__, f.value))
        elif name == self.number and isinstance(f, In):
            self.tests.append(("In", tuple(f.value)))
        elif isinstance(f, Not) and isinstance(f.child, (EqualTo, In)) and f.child.attribute[0] == self.number:
            self.tests.append(("NotIn", tuple(f.child.value) if isinstance(f.child, In) else (f.child.value,)))
        elif name == "book_id" and isinstance(f, (EqualTo, In)):
            self.files.append(set(f.value) if isinstance(f, In) else {f.value})
        else:
            return False
        return True

    def part(self, n: int) -> bool:
        return all(COMPARE[kind](n, value) for kind, value in self.tests)

    def file(self, path: str) -> bool:
        return all(path in names for names in self.files)


class FileReader(DataSourceReader):
    """Files in tasks of a bounded size; a subclass gives the rows of a file."""

    number = "ord"

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("a path to load is needed")
        self.path, self.wanted = options["path"], Wanted(self.number)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return iter([f for f in filters if not self.wanted.take(f)])

    def partitions(self) -> list[Part]:
        parts: list[Part] = []
        size = math.inf
        for file, n in listed(self.path):
            if not self.wanted.file(file):
                continue
            if size + n > TASK_BYTES or len(parts[-1].files) >= TASK_FILES:
                parts.append(Part([]))
                size = 0
            parts[-1].files.append(file)
            size += n
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for file in partition.files:
            yield from self.rows(file)

    def rows(self, file: str) -> Iterator[tuple]:
        raise NotImplementedError


class EpubReader(FileReader):
    def rows(self, file: str) -> Iterator[tuple]:
        from quire.sources.books import epub_chapters

        try:
            with opened(file) as handle:
                for n, title, html, error, facts in epub_chapters(handle, self.wanted.part):
                    if self.wanted.part(n):
                        yield file, n, title, html, error, {"file_name": posixpath.basename(file), **facts} if facts is not None else None
        except Exception as e:
            raise ValueError(f"Failed to parse EPUB: {e}") from e


class EpubSource(DataSource):
    """Rows book_id, ord, title, html, error, facts; facts are those of the row of ord 0, with the number of chapters as total."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return EPUB_SCHEMA

    def reader(self, schema: Any) -> EpubReader:
        return EpubReader(self.options)


def pdf_source(extract: Callable[[bytes], list[str | None] | dict], name: str = "pdf") -> type[DataSource]:
    """A data source of PDF files through an extractor, which runs once for a file; rows book_id, page_no, text, facts.

    Page 0 has the raw text, if the extractor knows it, and the facts: the information dictionary as `info.<key>`,
    title and author of the metadata, the version, the form flags and the number of pages as total.
    """

    class PdfReader(FileReader):
        number = "page_no"

        def rows(self, file: str) -> Iterator[tuple]:
            from quire.sources.books import pdf_facts

            with opened(file) as handle:
                pages, text, facts = pdf_facts(extract(handle.read()))
            parts = [(text, {"file_name": posixpath.basename(file), **facts}), *[(t, None) for t in pages]]
            yield from ((file, n, t, f) for n, (t, f) in enumerate(parts) if self.wanted.part(n))

    class PdfSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PDF_SCHEMA

        def reader(self, schema: Any) -> PdfReader:
            return PdfReader(self.options)

    return PdfSource


def register(spark: SparkSession, extract: Callable[[bytes], list[str | None] | dict] | None = None) -> None:
    """Make the formats known to a session and let Spark push filters to them; pdf needs an extractor."""
    spark.dataSource.register(EpubSource)
    if extract is not None:
        spark.dataSource.register(pdf_source(extract))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
