"""Writers of files with chosen names: Markdown, JSON and Anki packages, one file a book, written by the tasks.

A task writes under a folder of its own inside the target, `_unfinished-<id>`; the driver's part of the commit only
renames. Files of failed and repeated attempts stay in that folder and go with it, so a reader sees a file whole or not
at all. `append` refuses names that are there already, `overwrite` replaces files of the same names and leaves others.

    named.register(spark)
    files.write.format("named").mode("overwrite").save("/out")            # rows name, value (text or bytes)
    named.write_packages(cards, "/out", title="Deck")                     # one .apkg a book
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

RENAMES_AT_ONCE = 16


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class NamedWriter(DataSourceWriter):
    """Writes what files() gives under a name each and commits by rename."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        if not options.get("path"):
            raise ValueError("a folder to save to is needed")
        self.options, self.overwrite, self.run = dict(options), overwrite, uuid.uuid4().hex

    def files(self, rows: Iterator) -> Iterator[tuple[str, bytes]]:
        for row in rows:
            yield row["name"], row["value"].encode() if isinstance(row["value"], str) else bytes(row["value"] or b"")

    def write(self, iterator: Iterator) -> Written:
        store, target = _store(self.options["path"])
        own = posixpath.join(target, f"_unfinished-{self.run}", uuid.uuid4().hex)
        done: list[tuple[str, str]] = []
        for name, data in self.files(iterator):
            if not name or name in (".", "..") or "/" in name or "\\" in name or "\0" in name:
                raise ValueError(f"no name of a file: {name!r}")
            if not done:
                store.create_dir(own, recursive=True)
            at = posixpath.join(own, f"{len(done)}")
            with store.open_output_stream(at) as out:
                out.write(data)
            done.append((name, at))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, target = _store(self.options["path"])
        todo = [f for m in messages if m for f in m.files]
        try:
            names = [n for n, _ in todo]
            if len(set(names)) < len(names):
                raise ValueError(f"two files of one name: {next(n for i, n in enumerate(sorted(names)) if n in sorted(names)[:i])}")
            store.create_dir(target, recursive=True)
            if not self.overwrite:
                there = {posixpath.basename(x.path) for x in store.get_file_info(fs.FileSelector(target))}
                if taken := sorted(there & set(names)):
                    raise FileExistsError(f"{taken[0]} is in {target} already")
            with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
                list(pool.map(lambda f: store.move(f[1], posixpath.join(target, f[0])), todo))
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, target = _store(self.options["path"])
        own = posixpath.join(target, f"_unfinished-{self.run}")
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)


class PackageWriter(NamedWriter):
    """Cards that come book by book and in order become packages, each built in memory by the task that has its cards."""

    def files(self, rows: Iterator) -> Iterator[tuple[str, bytes]]:
        from quire.sources.sinks import Package

        package, book, name = None, None, ""
        for row in rows:
            if package is None or row["book_id"] != book:
                if package is not None:
                    yield name, package.data()
                package, book, name = Package(row["title"], css=self.options.get("css", "")), row["book_id"], row["name"]
            package.add(row["heading_text"], row["front_body"], row["back"], row["has_separator"])
        if package is not None:
            yield name, package.data()


def _source(kind: str, columns: str, made: type[NamedWriter]) -> type[DataSource]:
    class Target(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return columns

        def writer(self, schema: Any, overwrite: bool) -> NamedWriter:
            return made(self.options, overwrite)

    return Target


def register(spark: SparkSession) -> None:
    """Make the formats named and anki known to a session."""
    spark.dataSource.register(_source("named", "name string, value string", NamedWriter))
    spark.dataSource.register(_source("anki", "book_id string, name string, title string, section_index int, card_ord int, heading_text string, front_body string, back string, has_separator boolean", PackageWriter))


def base_name(book: Column) -> Column:
    """The name of a book's files: the last part of its path without the extension."""
    last = F.regexp_extract(book, r"([^/\\]*)[/\\]*\z", 1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*\z", "")


def write_named(files: DataFrame, path: str, overwrite: bool = True, dry: bool = False) -> None:
    """Rows name, value as files of a folder; a dry run writes nothing."""
    if not dry:
        register(files.sparkSession)
        files.select("name", "value").write.format("named").mode("overwrite" if overwrite else "append").save(path)


def write_packages(cards: DataFrame, path: str, title: str = "Deck", css: str = "", overwrite: bool = True, dry: bool = False) -> None:
    """One package a book, `<name of the book>.apkg`; cards need not be in order. A book's cards are streamed into its package by one task."""
    if dry:
        return
    register(cards.sparkSession)
    rows = cards.select("book_id", F.concat(base_name(F.col("book_id")), F.lit(".apkg")).alias("name"), F.lit(title).alias("title"), "section_index", "card_ord", "heading_text", "front_body", "back", "has_separator")
    ordered = rows.repartition("book_id").sortWithinPartitions("book_id", "section_index", "card_ord")
    ordered.write.format("anki").option("css", css).mode("overwrite" if overwrite else "append").save(path)
