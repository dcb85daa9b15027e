"""Token counts of whole texts; huge texts in overlapping chunks, spliced where both encodings provably agree.

The pre-tokeniser scans a text from left to right, and what it finds from a boundary on depends only on the text
after that boundary. So if a boundary between two pre-tokens of the left chunk, settled by the text that the chunk
still sees, is also a boundary in the right chunk, all boundaries of the right chunk from there on are those of the
whole text. The splice happens at such a boundary. If an overlap has none, it is widened.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices

CHUNK_CHARS, OVERLAP_CHARS = 1 << 14, 1 << 8
#: A boundary is settled only if this many characters follow it in the left chunk, more than any special string has.
MARGIN = 32


@functools.cache
def by_word(json_path: str) -> bool:
    """Whether a word's tokens do not depend on the words around it, if texts are cut by cut_words()."""
    import json

    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not any(" " in x["content"] for x in spec["added_tokens"])


def cut_words(text: str) -> list[str]:
    """A text cut before each space that follows something other than white space: a byte-level pre-tokeniser begins anew there."""
    first, *rest = text.split(" ")
    out, last = ([first], first[-1]) if first else ([], " ")
    for part in rest:
        if last.isspace() and out:
            out[-1] += " " + part
        else:
            out.append(" " + part)
        last = part[-1] if part else " "
    return out


@functools.cache
def load(json_path: str):
    """The tokenizer of a file; one whose special strings reach further than MARGIN is refused."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(json_path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    for x in added:
        if len(x["content"]) >= MARGIN or any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"the added token {x['content']!r} may depend on text far from it: texts cannot be cut")
    return Tokenizer.from_file(json_path)


class _Chunk:
    """The encoding of text[begin:end], and where its pre-tokens start."""

    def __init__(self, tokenizer, text: str, begin: int, end: int) -> None:
        code = tokenizer.encode(text[begin:end], add_special_tokens=False)
        self.begin, self.n, self.words, self.offsets = begin, len(code), code.word_ids, code.offsets

    def starts(self, low: int, high: int) -> dict[int, int]:
        """Position in the text of each pre-token that starts from low to high -> number of the chunk's tokens before it."""
        out: dict[int, int] = {}
        i = bisect_left(self.offsets, low - self.begin, key=lambda o: o[0])
        while i < self.n and (at := self.begin + self.offsets[i][0]) <= high:
            if not i or self.words[i] is None or self.words[i] != self.words[i - 1]:
                out.setdefault(at, i)
            i += 1
        return out


def count_long(text: str, tokenizer, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """Tokens of a text, from chunks of `chunk` characters that overlap by `overlap` or, where needed, more; and the number of splices."""
    total = splices = begin = first = done = 0
    end = min(chunk, len(text))
    left = _Chunk(tokenizer, text, begin, end)
    while end < len(text):
        width = overlap
        while True:
            start = max(end - width, begin)
            right_end = min(start + width + chunk, len(text))
            right = _Chunk(tokenizer, text, start, right_end)
            # the right chunk's own start is a boundary only by accident; the left chunk proves or refutes it
            low, high = max(start, first + 1), end - MARGIN
            settled = left.starts(low, high)
            common = settled.keys() & right.starts(low, high).keys()
            if common:
                break
            if start == begin:  # the left chunk has no settled boundary: grow it instead
                end = min(2 * end - begin, len(text))
                left = _Chunk(tokenizer, text, begin, end)
                done = left.starts(first, first)[first]
                if end == len(text):
                    return total + left.n - done, splices
                width = overlap
                continue
            width *= 2
        cut = max(common)
        total += settled[cut] - done
        splices += 1
        left, begin, first, end = right, start, cut, right_end
        done = left.starts(cut, cut)[cut]
    return total + left.n - done, splices


def token_counts(docs: DataFrame, json_path: str, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_bytes, n_tokens, over_limit, n_splices; one for each row of docs.

    A text longer than a chunk is encoded in chunks; n_splices is where they were joined. Of shorter ones, each distinct
    word of a slice is encoded once, where the tokenizer's words do not depend on one another. Null and empty texts have 0
    bytes and 0 tokens; repeated rows and null ids each keep their row; an empty table gives none; other columns are
    not read. Memory is bounded by a chunk's encoding beside the text itself. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, words = load(json_path), by_word(json_path)
        for batch in (s for b in batches for s in slices(b)):
            texts = [v or "" for v in batch.column(1).to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            found: list[tuple[int, int]] = [(0, 0)] * len(texts)
            # each distinct word of the slice once, if words can be told apart
            cut = [cut_words(texts[i]) if words else [texts[i]] for i in short]
            distinct = list({w for c in cut for w in c})
            counts = dict(zip(distinct, map(len, tokenizer.encode_batch_fast(distinct, add_special_tokens=False))))
            for i, c in zip(short, cut):
                found[i] = sum(map(counts.__getitem__, c)), 0
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    found[i] = count_long(t, tokenizer, chunk, overlap)
            n_bytes = [len(t.encode()) for t in texts]
            n_tokens, splices = [n for n, _ in found], [k for _, k in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(splices, pa.int64())], names=["id", "n_bytes", "n_tokens", "over_limit", "n_splices"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_splices bigint").withColumnRenamed("id", id_col)
