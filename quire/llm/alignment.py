"""Alignment of two tokenizers: a byte-level BPE (A) and a SentencePiece model (B) over the same text.

The spans that the libraries report (character offsets of A, proto spans of B) are the coarse cuts: places where a
token of both ends. Where a piece between two such cuts has characters of several bytes, tokens may end inside a
character, and the spans of such tokens overlap or are empty; there the decoded bytes of the tokens give the finer
cuts. Texts go through the libraries word by word, each distinct word of a slice once: before a space that follows a
character that is neither white space nor the space mark, both tokenizers begin a new token, whatever stands around it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, small, table

MARK = "▁"
#: Bytes of texts whose words are made distinct, and characters of words that go through the libraries at once.
SLICE, BULK_CHARS = 8 << 20, 1 << 18
#: Links of a group up to which they are listed one by one; in a larger one, equal ids are counted first.
LISTED = 4096
#: Pairs of ids that may be broadcast with their counts; more are met by shuffle.
BROADCAST_PAIRS = 2_000_000


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    def __init__(self, json_path: str, model_path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(json_path)
        self.a.encode_special_tokens = True
        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        with open(model_path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        table_ = byte_of()
        n = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [bytes(table_[c] for c in t) if (t := self.a.id_to_token(i)) and all(c in table_ for c in t) else b"" for i in range(n)]
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        # a token as text, with what follows it inside a side and at the side's end
        self.text_a, self.text_b = (np.array([[f"{i}{c}" for i in range(len(v))] for c in ends], object) for v, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        self.len_a, self.len_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        pre, norm = spec.get("pre_tokenizer") or {}, model.normalizer_spec
        # what makes a word's tokens independent of the words around it
        self.by_word = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(MARK in p.piece.lstrip(MARK) or " " in p.piece for p in model.pieces)
        )

    def tokens(self, text: str):
        """Ids and byte ends of the tokens of both sides, and the byte ends that their groups have; None if bytes do not come back.

        text begins with the space that B adds by itself.
        """
        code, proto = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        raw = text.encode()
        ids_a, ids_b = code.ids, [p.id for p in proto]
        if b"".join([self.bytes_a[i] for i in ids_a]) != raw or b"".join([self.bytes_b[i] for i in ids_b]) != raw:
            return None
        at_a, at_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        spans = np.array(code.offsets, np.int64)
        clean_a = np.append(spans[1:, 0] >= spans[:-1, 1], True)  # the next token does not begin in the same character
        view = np.frombuffer(raw, np.uint8)
        starts = np.append(np.flatnonzero((view & 0xC0) != 0x80), len(raw))
        span_b = np.array([(p.begin, p.end) for p in proto], np.int64) + 1
        span_b[0, 0] = 0  # the space that B adds
        clean_b = span_b[:, 1] > span_b[:, 0]  # bytes before the last one of a character have empty spans
        coarse = self._both(len(raw), starts[spans[clean_a, 1]], span_b[clean_b, 1])
        if len(starts) - 1 == len(raw):
            return ids_a, ids_b, at_a, at_b, np.flatnonzero(coarse)
        cell = np.cumsum(coarse) - coarse  # of each byte end, the cell that it closes or lies in
        fine = np.zeros(cell[-1] + 1, bool)
        fine[cell[np.flatnonzero(view >= 0x80) + 1]] = True  # cells with characters of several bytes
        inner = self._both(len(raw), *(at[fine[cell[at]]] for at in (at_a, at_b)))
        return ids_a, ids_b, at_a, at_b, np.flatnonzero(coarse | inner)

    @staticmethod
    def _both(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which of the places 0 to n are in both lists."""
        marks = np.zeros(n + 1, np.int8)
        marks[one] = 1
        marks[two] |= 2
        return marks == 3

    def words(self, text: str) -> list[str]:
        """A text cut before spaces where both tokenizers are known to begin anew; their joined text is the text."""
        if not self.by_word:
            return [text]
        out: list[str] = []
        last = " "
        for part in text.split(" ")[1:]:
            if last.isspace() or last == MARK:
                if out:
                    out[-1] += " " + part
                else:
                    out.append(" " + part)
            else:
                out.append(" " + part)
            last = part[-1] if part else " "
        if len(out) > 1 and out[-1] == " ":  # B adds no space of its own to an empty text
            out[-2:] = ["".join(out[-2:])]
        return out

    def bulks(self, words: list[str]) -> Iterator[tuple[list[int], tuple | None]]:
        """The places of some words, and tokens() of these words as one text; None for a word whose bytes do not come back."""
        at: list[int] = []
        size = 0
        for i, w in enumerate(words):
            if not self.by_word or w[-1].isspace() or w[-1] == MARK:
                yield [i], self.tokens(w)
                continue
            at.append(i)
            size += len(w)
            if size >= BULK_CHARS:
                yield from self._halved(words, at)
                at, size = [], 0
        if at:
            yield from self._halved(words, at)

    def _halved(self, words: list[str], at: list[int]) -> Iterator[tuple[list[int], tuple | None]]:
        found = self.tokens("".join([words[i] for i in at]))
        if found is None and len(at) > 1:
            yield from self._halved(words, at[: len(at) // 2])
            yield from self._halved(words, at[len(at) // 2 :])
        else:
            yield at, found

    def facts(self, words: list[str]):
        """For distinct words: whether bytes come back, (tokens a, tokens b, groups, links), groups as text, and linked pairs as (word, a << 32 | b, links)."""
        good, numbers, texts = np.zeros(len(words), bool), np.zeros((4, len(words)), np.int64), np.full(len(words), "", object)
        pairs: list[tuple] = [(np.empty(0, np.int64),) * 3]
        for at, found in self.bulks(words):
            if found is None:
                continue
            ids_a, ids_b, at_a, at_b, cuts = found
            ids_a, ids_b, at = np.array(ids_a, np.int64), np.array(ids_b, np.int64), np.array(at)
            to_a, to_b = np.searchsorted(at_a, cuts, "right"), np.searchsorted(at_b, cuts, "right")
            n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
            first_a, first_b = to_a - n_a, to_b - n_b
            ends = np.cumsum([len(words[i].encode()) for i in at])
            cell = np.searchsorted(cuts, ends, "right")  # cells up to the end of each word
            word = at[np.searchsorted(cell, np.arange(len(cuts)), "right")]
            good[at] = True
            for k, v in enumerate((n_a, n_b, np.ones_like(n_a), n_a * n_b)):
                total = np.append(0, np.cumsum(v))[np.append(0, cell)]
                numbers[k, at] = np.diff(total)
            # all tokens in the order of the text of groups: a's of a cell, then its b's
            start = np.append(0, np.cumsum(n_a + n_b))
            merged = np.empty(start[-1], object)
            cell_a, cell_b = np.repeat(np.arange(len(cuts)), n_a), np.repeat(np.arange(len(cuts)), n_b)
            i_a, i_b = np.arange(len(ids_a)), np.arange(len(ids_b))
            merged[start[cell_a] + i_a - first_a[cell_a]] = self.text_a[(i_a + 1 == to_a[cell_a]).astype(np.int8), ids_a]
            merged[start[cell_b] + n_a[cell_b] + i_b - first_b[cell_b]] = self.text_b[(i_b + 1 == to_b[cell_b]).astype(np.int8), ids_b]
            flat, edge = merged.tolist(), start[np.append(0, cell)].tolist()
            texts[at] = ["".join(flat[i:j]) for i, j in zip(edge, edge[1:])]
            listed = np.flatnonzero(n_a * n_b <= LISTED)
            c, k = expand(listed, (n_a * n_b)[listed])
            pairs.append((word[c], ids_a[first_a[c] + k // n_b[c]] << 32 | ids_b[first_b[c] + k % n_b[c]], np.ones(len(c), np.int64)))
            for c in np.flatnonzero(n_a * n_b > LISTED):
                (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (ids_a[first_a[c] : to_a[c]], ids_b[first_b[c] : to_b[c]]))
                pairs.append((np.full(len(x) * len(y), word[c]), (x[:, None] << 32 | y).ravel(), (n[:, None] * m).ravel()))
        return good, numbers, texts, [np.concatenate(v) for v in zip(*pairs)]

    def batch(self, texts: list[str | None]):
        """Of each text (n_a, n_b, n_groups, n_links) and groups_sha256; then the texts' distinct pairs as (text, key, links), in order."""
        index: dict[str, int] = {}
        cut = [[index.setdefault(w, len(index)) for w in self.words(" " + t)] if t else [] for t in texts]
        good, numbers, strings, (p_word, p_key, p_links) = self.facts(list(index))
        n, v = len(texts), max(len(index), 1)
        used, times = np.unique(np.repeat(np.arange(n), [len(c) for c in cut]) * v + np.array([w for c in cut for w in c], np.int64), return_counts=True)
        doc, word = used // v, used % v
        fine = np.ones(n, bool)
        fine[doc[~good[word]]] = False
        some = fine[doc]
        doc, word, times = doc[some], word[some], times[some]
        sums = np.zeros((4, n), np.int64)
        for k in range(4):
            np.add.at(sums[k], doc, numbers[k, word] * times)
        shas = [hashlib.sha256("".join(strings[c].tolist())[:-1].encode()).hexdigest() if c and fine[i] else "" for i, c in enumerate(cut)]
        order = np.argsort(p_word, kind="stable")
        p_key, p_links = p_key[order], p_links[order]
        first = np.searchsorted(p_word[order], np.arange(v + 1))
        at, k = expand(np.arange(len(doc)), first[word + 1] - first[word])
        source = first[word[at]] + k
        keys, dense = np.unique(p_key, return_inverse=True)
        both, back = np.unique(doc[at] * max(len(keys), 1) + dense[source], return_inverse=True)
        links = np.zeros(len(both), np.int64)
        np.add.at(links, back, p_links[source] * times[at])
        return sums, shas, (both // max(len(keys), 1), keys[both % max(len(keys), 1)] if len(keys) else both, links)


def expand(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each item as often as its count says, and beside it 0, 1, ... up to that count."""
    out = np.repeat(items, counts)
    return out, np.arange(len(out)) - np.repeat(np.cumsum(counts) - counts, counts)


@functools.cache
def load(json_path: str, model_path: str) -> Aligner:
    return Aligner(json_path, model_path)


def aligned(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs as a, b, links; one for each row of docs. No shuffle.

    Texts that are null or empty, or that either side does not give back byte by byte, have no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(json_path, model_path)
        for batch in (s for b in batches for s in slices(b, SLICE)):
            sums, shas, (doc, keys, links) = aligner.batch(batch.column(1).to_pylist())
            at = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, kind)) for v, kind in ((keys >> 32, pa.int32()), (keys & 0xFFFFFFFF, pa.int32()), (links, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), pa.array(shas, pa.string()), *lists], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "links"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a array<int>, b array<int>, links array<bigint>")


def pair_counts(links: DataFrame) -> DataFrame:
    """Rows a, b, count (documents that hold the pair linked), best (whether it is the highest of its a); links has a row for each document and pair."""
    counts = table(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return table(counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best")))


def alignment(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one for each row of docs.

    Repeated rows and null ids keep their rows, and each row counts as a document of its pairs; texts without tokens
    (null, empty, or not given back byte by byte) have zeros and an empty groups_sha256; an empty table gives none;
    other columns are not read. Texts are not shuffled: pairs are counted within tasks first, and one row a document
    and task comes back.
    """
    found = table(aligned(docs, json_path, model_path, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()))
    links = found.select("rid", F.explode(F.arrays_zip("a", "b", "links")).alias("l")).select("rid", "l.a", "l.b", "l.links")
    counts = pair_counts(links)
    sums = links.join(small(counts, BROADCAST_PAIRS), ["a", "b"]).groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum")
    )
    out = found.drop("a", "b", "links").join(sums, "rid", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
