"""Writers: book JSON, Markdown decks, Anki packages, failed sections."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import sqlite3
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quire.operators.cards import card_table, deck_markdown
from quire.operators.generate import failures, until_failure
from quire.sources.named import base_name, write_named

MINIMAL = ["index", "title", "text"]
#: The default template of a package: both sides' formats and the style.
QUESTION, ANSWER = "{{Front}}", "{{FrontSide}}<hr id=answer>{{Back}}"
CARD_CSS = ".card { font-family: sans-serif; text-align: left; } pre { overflow-x: auto; }"
_NAMES = {"page_range": "pageRange", "page_count": "pageCount", "processed_pages": "processedPages", "original_chapter_index": "originalChapterIndex"}


def book_json(sections: DataFrame, metadata: DataFrame | None = None, full: bool = False) -> DataFrame:
    """Rows book_id, json: each book as one line of JSON; minimal by default."""
    names = [c for c in sections.columns if c != "book_id" and (full or c in MINIMAL)]
    section = F.struct(*[F.col(c).alias(_NAMES.get(c, c)) for c in names])
    books = sections.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("index").alias("i"), section.alias("s")))), lambda x: x["s"]).alias("content"))
    parts = ["content"]
    if full and metadata is not None:
        rest = [c for c in metadata.columns if c != "book_id"]
        books = books.join(metadata.select("book_id", F.struct(*rest).alias("metadata")), "book_id", "left")
        parts = ["metadata", "content"]
    return books.select("book_id", F.to_json(F.struct(*parts), {"ignoreNullFields": "true"}).alias("json"))


def pretty(books: DataFrame) -> DataFrame:
    """Rows book_id, json, with the JSON indented by two spaces and nothing escaped that need not be."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(json=[json.dumps(json.loads(x), indent=2, ensure_ascii=False) for x in f["json"]])

    return books.select("book_id", "json").mapInPandas(run, "book_id string, json string")


def write_books(books: DataFrame, path: str, overwrite: bool = True, dry: bool = False) -> None:
    """Each row (book_id, json) as a file `<name of the book>.json`, indented; a dry run writes nothing."""
    write_named(pretty(books).select(F.concat(base_name(F.col("book_id")), F.lit(".json")).alias("name"), F.col("json").alias("value")), path, overwrite, dry)


def write_json(books: DataFrame, path: str, dry: bool = False) -> None:
    """One JSON document a line and book, distributed. A dry run writes nothing."""
    if not dry:
        books.select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_deck(cards: DataFrame, path: str, title: str = "Deck") -> int:
    """Each book's deck as one Markdown row; returns the number of cards and fails without any. Cards are counted as they are written."""
    if cards.isEmpty():
        raise ValueError("No flashcards were generated.")
    seen = Observation()
    decks = deck_markdown(cards, title).observe(seen, F.sum("cards").alias("cards"))
    decks.select("markdown", "cards").select("markdown").write.mode("overwrite").text(path, lineSep="\n\n")
    return int(seen.get["cards"])


def failure_files(answered: DataFrame, title: str = "Deck") -> DataFrame:
    """Rows name, value for each book with a failed section: `<name>-partial.md` and `<name>-failed-section-<n>.md`.

    The first is the deck of what was answered before the first failure, its title alone if that is nothing; the other
    is what the model said last, n the section's place in the book. answered should be a written table.
    """
    place = Window.partitionBy("book_id").orderBy("section_index")
    numbered = answered.select("book_id", "section_index", F.row_number().over(place).alias("place"))
    failed = failures(answered).join(numbered, ["book_id", "section_index"]).select("book_id", "place", "markdown")
    partial = deck_markdown(card_table(until_failure(answered).join(failed.select("book_id"), "book_id", "left_semi")), title).select("book_id", F.col("markdown").alias("deck"))
    both = failed.join(partial, "book_id", "left").withColumn("base", base_name(F.col("book_id")))
    empty = F.lit(f"# {title.strip() or 'Deck'}\n")
    files = F.array(
        F.struct(F.concat("base", F.lit("-partial.md")).alias("name"), F.coalesce("deck", empty).alias("value")),
        F.struct(F.concat("base", F.lit("-failed-section-"), F.col("place").cast("string"), F.lit(".md")).alias("name"), F.col("markdown").alias("value")),
    )
    return both.select(F.explode(files).alias("f")).select("f.name", "f.value")


def write_failures(answered: DataFrame, path: str, title: str = "Deck") -> None:
    """The files of failure_files() in a folder; files of the same names are replaced."""
    write_named(failure_files(answered, title), path)


def output_path(kind: str, out: str | None = None, paths: dict[str, str] | None = None, default: str | None = None, extension: str | None = None) -> str | None:
    """--out, then the kind's own path, then the general one; the extension is added if it is missing."""
    path = out or (paths or {}).get(kind) or default
    extension = extension or {"json": ".json", "md": ".md", "anki": ".apkg"}[kind]
    return path if not path or path.endswith(extension) else path + extension


def template_path(target: str | None = None, source: str | None = None, folder: str = ".") -> str:
    """Where an index template goes: the target, index.json in a target folder, or a file in `folder` named after the source."""
    if not target:
        stem = re.sub(r"[^a-z0-9]+", "-", os.path.splitext(os.path.basename(source))[0].strip().lower()).strip("-") or "deck" if source else None
        return os.path.join(folder, f"{stem}.index.json" if stem else "index.json")
    extension = os.path.splitext(target)[1]
    if not extension:
        return os.path.join(target, "index.json")
    if extension.lower() != ".json":
        raise ValueError(f"an index template is a .json file, not {extension}")
    return target


_TABLES = """
CREATE TABLE col (id integer primary key, crt integer, mod integer, scm integer, ver integer, dty integer, usn integer, ls integer, conf text, models text, decks text, dconf text, tags text);
CREATE TABLE notes (id integer primary key, guid text, mid integer, mod integer, usn integer, tags text, flds text, sfld text, csum integer, flags integer, data text);
CREATE TABLE cards (id integer primary key, nid integer, did integer, ord integer, mod integer, usn integer, type integer, queue integer, due integer, ivl integer, factor integer, reps integer, lapses integer, left integer, odue integer, odid integer, flags integer, data text);
CREATE TABLE revlog (id integer primary key, cid integer, usn integer, ease integer, ivl integer, lastIvl integer, factor integer, time integer, type integer);
CREATE TABLE graves (usn integer, oid integer, type integer);
"""


def note_id(deck: str, front: str, back: str) -> int:
    """Depends on the card alone, so that a rebuilt deck updates its notes."""
    return 1 << 40 | int.from_bytes(hashlib.sha256(f"{deck}\0{front}\0{back}".encode()).digest()[:5], "big")


class Package:
    """An Anki package in memory: cards are added in order, data() gives its bytes."""

    def __init__(self, title: str = "Deck", css: str = "") -> None:
        self.title, self.n = title, 0
        self.deck, self.model = note_id(title, "deck", "") % (1 << 31), note_id(title, "model", "") % (1 << 31)
        fields = [{"name": n, "ord": i, "sticky": False, "rtl": False, "font": "Arial", "size": 20, "media": []} for i, n in enumerate(("Front", "Back"))]
        template = {"name": "Card 1", "ord": 0, "qfmt": QUESTION, "afmt": ANSWER, "did": None, "bqfmt": "", "bafmt": ""}
        model = {"id": self.model, "name": "Quire", "type": 0, "mod": 0, "usn": 0, "sortf": 0, "did": self.deck, "css": css or CARD_CSS, "latexPre": "", "latexPost": "", "tags": [], "vers": [], "req": [[0, "all", [0]]], "flds": fields, "tmpls": [template]}
        deck = {"id": self.deck, "name": title, "mod": 0, "usn": 0, "desc": "", "dyn": 0, "collapsed": False, "conf": 1, "newToday": [0, 0], "revToday": [0, 0], "lrnToday": [0, 0], "timeToday": [0, 0], "extendNew": 0, "extendRev": 0}
        self.db = sqlite3.connect(":memory:")
        self.db.executescript(_TABLES)
        self.db.execute("INSERT INTO col VALUES (1, 0, 0, 0, 11, 0, 0, 0, '{}', ?, ?, '{}', '{}')", (json.dumps({str(self.model): model}), json.dumps({str(self.deck): deck})))

    def add(self, heading: str | None, body: str | None, back: str | None, separator: bool) -> None:
        self.n += 1
        front, back = "\n\n".join(x for x in (heading, body if separator else "") if x), back or ""
        key = note_id(self.title, front, back)
        checksum = int(hashlib.sha1(front.encode()).hexdigest()[:8], 16)
        self.db.execute("INSERT OR IGNORE INTO notes VALUES (?, ?, ?, 0, -1, '', ?, ?, ?, 0, '')", (key, f"q{key:x}", self.model, f"{front}\x1f{back}", front, checksum))
        self.db.execute("INSERT OR IGNORE INTO cards VALUES (?, ?, ?, 0, 0, -1, 0, 0, ?, 0, 0, 0, 0, 0, 0, 0, 0, '')", (key, key, self.deck, self.n))

    def data(self, media: dict[str, bytes] | None = None) -> bytes:
        self.db.commit()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            entry = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # noqa: E731  # equal decks, equal bytes
            z.writestr(entry("collection.anki2"), self.db.serialize(), zipfile.ZIP_DEFLATED)
            z.writestr(entry("media"), json.dumps({str(i): name for i, name in enumerate(media or {})}), zipfile.ZIP_DEFLATED)
            for i, data in enumerate((media or {}).values()):
                z.writestr(entry(str(i)), data, zipfile.ZIP_DEFLATED)
        self.db.close()
        return out.getvalue()


def write_package(cards: DataFrame, path: str, title: str = "Deck", media: dict[str, bytes] | None = None, css: str = "") -> int:
    """All cards as one package, built where it is written; returns the number of cards. write_packages() makes one a book on the executors."""
    package = Package(title, css)
    for r in cards.orderBy("book_id", "section_index", "card_ord").toLocalIterator():
        package.add(r["heading_text"], r["front_body"], r["back"], r["has_separator"])
    with open(path, "wb") as f:
        f.write(package.data(media))
    return package.n
