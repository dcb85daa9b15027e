"""Media columns: interleaved sequences of text and media references, and a store of payloads by digest.

A page's HTML becomes an ordered array of text and media structs. Payloads live in a table keyed by the SHA-256 of
what they hold; references name digests, and a join on digests gives each reference its payload's features while
position and caption stay with the reference. Payload bytes are written and read where they are and never shuffled.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import free_name, packed, slices, table

#: Payloads are stored as binary grey maps: rows of 64 samples of 8 bits.
ROW = 64
MEDIA_TAGS = {"img", "video", "audio", "embed", "source"}
HOLDERS = {"video", "audio", "picture"}
SILENT_TAGS = {"script", "style", "template", "noscript"}
BREAKING_TAGS = {"p", "div", "article", "section", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "figure", "blockquote", "pre"}
SCHEME = "media:sha256/"

ELEMENT = "struct<position:int,kind:string,text:string,ref:string,caption:string>"


class _Reader(HTMLParser):
    """Collects text blocks and media references in document order; a figure's caption goes to its media.

    A medium with several forms (sources of a video, audio or picture, or a srcset) counts once, by its own address or
    else by the first of its forms; a poster is a medium before its video.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.block: list[str] = []
        self.silent = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None
        self.parent: list[dict] = []  # open video, audio and picture: the medium they stand for, once there is one

    def medium(self, ref: str, caption: str | None) -> None:
        self.flush()
        self.items.append({"kind": "media", "text": None, "ref": ref, "caption": caption})

    def flush(self) -> None:
        text = "".join(self.block)
        self.block = []
        if text.strip():
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA_TAGS or tag == "picture":
            got = dict(attrs)
            forms = (got.get("srcset") or "").split(",")[0].split()
            ref = got.get("src") or got.get("data-src") or (forms[0] if forms else None)
            caption = got.get("alt") or None
            if tag in HOLDERS:
                if got.get("poster"):
                    self.medium(got["poster"], None)
                self.parent.append({"done": False})
            holder = self.parent[-1] if self.parent else None
            if ref and holder and tag == "img" and holder["done"]:  # the plain form of a picture: it has the address and the words
                self.items[holder["at"]] |= {"ref": ref, "caption": caption}
            elif ref and not (holder and holder["done"]):
                self.medium(ref, caption)
                if holder:
                    holder |= {"done": True, "at": len(self.items) - 1}
        elif tag in BREAKING_TAGS:
            self.flush()
        if tag == "figure":
            self.figures.append(len(self.items))

    def handle_endtag(self, tag) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = "".join(self.caption).strip()
            self.caption = None
            for item in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                if item["kind"] == "media" and text:
                    item["caption"] = text
        elif tag in BREAKING_TAGS:
            self.flush()
        if tag in HOLDERS and self.parent:
            self.parent.pop()
        if tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.block.append(data)


def parse(page: str | None) -> list[dict]:
    """Ordered elements of a page; null and empty pages have none. Broken markup ends where the text ends."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return [{"position": i, **x} for i, x in enumerate(reader.items)]


def interleave(pages: DataFrame, html_col: str = "html", out: str = "elements") -> DataFrame:
    """pages without the HTML and with the array of elements; one row for each row. No shuffle.

    Null and empty pages have no elements; repeated rows keep their rows, an empty table gives none. A column of the
    name `out` is kept, and the array gets the name with underscores after it.
    """
    others = [c for c in pages.columns if c != html_col]
    out = free_name(out, others)
    narrow = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html_col}`"))
    kinds = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = pa.array([parse(v.as_py()) for v in part.column(len(others))], kinds)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*others, out])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], T.StructField(out, T._parse_datatype_string(f"array<{ELEMENT}>"))]))


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of ROW."""
    return data + bytes(max(1, -(-len(data) // ROW)) * ROW - len(data))


def encode(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def decode(media: bytes) -> tuple[bytes, int]:
    """Payload and height of a stored grey map."""
    magic, shape, depth, payload = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(payload) != width * height:
        raise ValueError("not a grey map of 8-bit samples")
    return payload, height


def feature(payload: bytes, height: int) -> str:
    """Shape, sum, number of distinct samples and the change from row to row."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    rows = x.reshape(height, ROW).sum(axis=1)
    return f"{ROW}x{height};sum={x.sum()};distinct={int((np.bincount(x, minlength=256) > 0).sum())};steps={int(np.abs(np.diff(rows)).sum())}"


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The media table of the texts: media, one binary for each row; written once and read back from its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array([encode(pad((v.as_py() or "").encode())) for v in part.column(0)], pa.binary())], names=["media"])

    return table(docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "media binary"))


def features(media: DataFrame) -> DataFrame:
    """One row for each digest in a media table, from its stored bytes."""
    names = ["payload_sha256", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0):
                stored = value.as_py()
                payload, height = decode(stored)
                out.append((hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload, height)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    read = media.mapInArrow(run, "payload_sha256 string, payload_bytes bigint, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return table(read.groupBy("payload_sha256").agg(*[F.min(c).alias(c) for c in names[1:]]))  # so that Spark may split joins with it


def resolve(sequences: DataFrame, found: DataFrame, elements: str = "elements") -> DataFrame:
    """A row for each media reference: the other columns, position, ref, caption and the payload's features, null if unknown.

    References without the scheme of digests are unknown. Null and empty sequences give no rows; repeated rows keep
    theirs. A column that has the name of one of these is kept, and the new one gets underscores after its name.
    """
    others = sequences.drop(elements)
    refs = sequences.select(packed(others), F.explode(F.filter(F.col(f"`{elements}`"), lambda x: x["kind"] == "media")).alias("e"))
    digest = F.when(F.startswith(F.col("e.ref"), F.lit(SCHEME)), F.expr(f"substring(e.ref, {len(SCHEME) + 1})"))
    met = refs.withColumn("digest", digest).join(found.select(packed(found, "found"), F.col("payload_sha256").alias("sha")), F.col("digest") == F.col("sha"), "left")
    out = [F.col("row")[c].alias(c) for c in others.columns]
    for side, names in (("e", ["position", "ref", "caption"]), ("found", found.columns)):
        for c in names:
            out.append(F.col(side)[c].alias(free_name(c, [*others.columns])))
    return met.select(*out)


def as_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n_bytes, html: each text as a page with its payload as a figure. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, pages = [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    data = text.encode()
                    sizes.append(len(data))
                    digest = hashlib.sha256(pad(data)).hexdigest()
                    pages.append(f'<article><pre>{html.escape(text, quote=False)}</pre><figure><img src="{SCHEME}{digest}" alt=""><figcaption>{len(data)} bytes</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(pages)], names=["doc", "n_bytes", "html"])

    narrow = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return narrow.mapInArrow(run, f"doc {narrow.schema[0].dataType.simpleString()}, n_bytes bigint, html string")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_bytes, the features of the payload that was stored and read back, position and caption; one for each row of docs.

    Null and empty texts are 64 bytes of 0; equal texts share a digest and get equal values; repeated rows and null ids
    each keep their row; an empty table gives none; other columns are not read.
    """
    found = features(store(docs, text_col))
    out = resolve(interleave(as_pages(docs, id_col, text_col)), found)
    return out.select(F.col("doc").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
