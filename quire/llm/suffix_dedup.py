"""Removal of every byte that lies in a repeated string of 200 bytes, by distributed prefix doubling.

The rank of the string of length 2k at a position is the pair of the ranks of length k at the position and k further
on. Within a text the pairs are named by a 64-bit mixing hash, so the ranks of lengths 1, 2, 4 .. 128 and 200 cost a
few vector operations a byte. Spark sorts and reranks positions across texts in three rounds, and a position leaves as
soon as its rank is unique:

1. at 40 bytes, for anchors alone: every string of 200 bytes names the position in it whose rank of length 40 is
   least, so equal strings name equal anchors. A run of strings with the same anchor is one row.
2. at up to 352 bytes: a run's whole extent, the pair of the ranks of length 200 at its two ends. If it is found
   twice, every string of the run repeats.
3. at 200 bytes: the single positions of the runs that rounds 1 and 2 left open, pairs of ranks of length 128. Equal
   strings have equal anchors, so it is enough to bring the bytes of the runs of one anchor together. Anchors with very
   many extents go by the rank of each position instead, which Spark sums before and after its shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import slices, table

LENGTH, ANCHOR = 200, 40
#: Anchors with more extents than this are resolved by rows of single ranks, not in one task's memory.
WIDE = 20_000
#: Runs of one worker that are combined at a time, before the shuffle.
RUNS = 1 << 18
#: Starts of strings that are held as vectors at a time; a longer text is cut into overlapping segments.
SEGMENT = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


#: A 64-bit value for each byte, from the mixing rule itself.
BYTE = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def _pair(rank: np.ndarray, shift: int) -> np.ndarray:
    """Names of the pairs (rank at p, rank at p + shift)."""
    out = rank[: len(rank) - shift] * np.uint64(0xC2B2AE3D27D4EB4F)
    out += rank[shift:]
    return _mix(out)


def ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of length ANCHOR and LENGTH at each position that has as many bytes after it."""
    r, k, anchor = BYTE[data], 1, None
    while k < 128:
        r = _pair(r, k)
        k *= 2
        if k == 32:
            anchor = _pair(r, ANCHOR - 32)
    return anchor, _pair(r, LENGTH - 128)


def runs(data: np.ndarray, anchor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """first, last, rank of the anchor and rank of the extent, for each run of strings with one anchor."""
    n = len(whole)
    width = LENGTH - ANCHOR + 1
    low = np.uint64((1 << 20) - 1)
    least = (anchor & ~low) | np.arange(len(anchor), dtype=np.uint64)  # the leftmost of equal ranks is least
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = (least[:n] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], n) - 1
    a = at[first]
    extent = whole[first] * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(whole[last] + (last - first).astype(np.uint64)) + (a - first).astype(np.uint64)
    return first, last, anchor[a], _mix(extent)


def segments(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text's segments: start, and the bytes of up to SEGMENT strings."""
    for s in range(0, len(data) - LENGTH + 1, SEGMENT):
        yield s, data[s : s + SEGMENT + LENGTH - 1]


def _packed(texts: list[tuple[int, np.ndarray]]) -> Iterator[tuple[list[tuple[int, int, int, int]], np.ndarray]]:
    """Segments joined to vectors of about SEGMENT bytes: (text, start in text, start in vector, bytes) and the vector."""
    held, size = [], 0
    for k, data in texts:
        for s, part in segments(data):
            if held and size + len(part) > SEGMENT + LENGTH:
                yield _join(held)
                held, size = [], 0
            held.append((k, s, part))
            size += len(part)
    if held:
        yield _join(held)


def _join(held):
    places, at = [], 0
    for k, s, part in held:
        places.append((k, s, at, len(part)))
        at += len(part)
    return places, np.concatenate([p for _, _, p in held])


def _bytes(value: pa.Scalar) -> np.ndarray:
    b = value.as_buffer()
    return np.zeros(0, np.uint8) if b is None else np.frombuffer(b, np.uint8)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of the texts: h, n_bytes, first, last, gram, extent."""
    names = ["h", "n_bytes", "first", "last", "gram", "extent"]
    for batch in (s for b in batches for s in slices(b, 32 << 20)):
        keys = np.asarray(batch.column(0))
        texts = [(i, _bytes(v)) for i, v in enumerate(batch.column(1))]
        for places, data in _packed(texts):
            anchor, whole = ranks(data)
            out = []
            for k, s, at, size in places:
                n = size - LENGTH + 1
                first, last, gram, extent = runs(data[at : at + size], anchor[at : at + size - ANCHOR + 1], whole[at : at + n])
                out.append((np.full(len(first), keys[k]), np.full(len(first), len(texts[k][1]), np.int64), first + s, last + s, gram.view(np.int64), extent.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs, RUNS at a time, with those of equal gram and extent combined: one of them, and c, how many they are."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(_find_runs(batches), [None]):
        if batch is not None:
            held.append(batch)
            if sum(b.num_rows for b in held) < RUNS:
                continue
        if not held:
            return
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = []
        gram, extent = np.asarray(batch.column("gram")), np.asarray(batch.column("extent"))
        order = np.lexsort((extent, gram))
        new = np.flatnonzero(np.concatenate(([True], (gram[order][1:] != gram[order][:-1]) | (extent[order][1:] != extent[order][:-1])))) if len(order) else order
        one = batch.take(pa.array(order[new]))
        yield pa.RecordBatch.from_arrays([*one.columns, pa.array(np.diff(np.append(new, len(order))))], names=[*batch.schema.names, "c"])


def _stretches(data: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Neighbouring runs i..j with the positions of their strings and the strings' ranks; runs come in order."""
    i = 0
    while i < len(firsts):
        j = i + 1
        while j < len(firsts) and firsts[j] <= lasts[j - 1] + LENGTH and lasts[j] - firsts[i] < SEGMENT:
            j += 1
        lo = int(firsts[i])
        spots = _spots(firsts[i:j], lasts[i:j])
        yield i, j, spots, ranks(data[lo : int(lasts[j - 1]) + LENGTH])[1][spots - lo]
        i = j


def _spots(firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """All positions of the runs."""
    size = lasts - firsts + 1
    return np.repeat(firsts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _marks(value) -> tuple[np.ndarray, ...]:
    v = value.values
    order = np.argsort(np.asarray(v.field("first")), kind="stable")
    return tuple(np.asarray(v.field(f))[order] for f in ("first", "last", "gram", "weight"))


def _open_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, rank, h, n_bytes, at, weight of each position of the open runs; a weight of 2 says that the position surely repeats."""
    for batch in (s for b in batches for s in slices(b)):
        out = []
        for h, n, value, marks in zip(np.asarray(batch.column("h")), np.asarray(batch.column("n_bytes")), batch.column("text"), batch.column("open")):
            data, (firsts, lasts, gram, weight) = _bytes(value), _marks(marks)
            for i, j, spots, rank in _stretches(data, firsts, lasts):
                size = lasts[i:j] - firsts[i:j] + 1
                out.append((np.repeat(gram[i:j], size), rank.view(np.int64), np.full(len(spots), h), np.full(len(spots), n), spots, np.repeat(weight[i:j], size)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["gram", "rank", "h", "n_bytes", "at", "weight"])


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, h, n_bytes, first, weight and the bytes of each open run."""
    for batch in (s for b in batches for s in slices(b)):
        out = []
        for h, n, value, marks in zip(np.asarray(batch.column("h")).tolist(), np.asarray(batch.column("n_bytes")).tolist(), batch.column("text"), batch.column("open")):
            text, found = value.as_buffer().to_pybytes(), _marks(marks)
            out += [(g, h, n, a, w, text[a : b + LENGTH]) for a, b, g, w in zip(*(x.tolist() for x in found))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for i in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out[i : i + 20_000]], t) for k, t in enumerate(kinds)], names=["gram", "h", "n_bytes", "first", "weight", "bytes"])


def _alone_in(rows: pa.Table) -> pa.RecordBatch | None:
    """h, n_bytes, at of the strings of weight 1 in whole groups of runs."""
    if not rows.num_rows:
        return None
    first, weight = (np.asarray(rows.column(c).combine_chunks()) for c in ("first", "weight"))
    parts = [_bytes(v) for v in rows.column("bytes").combine_chunks()]
    size = np.array([len(p) for p in parts])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    spots = _spots(begin, begin + size - LENGTH)
    rank = ranks(np.concatenate(parts))[1][spots]
    owner = np.repeat(np.arange(len(parts)), size - LENGTH + 1)
    _, at, inverse = np.unique(rank, return_index=True, return_inverse=True)
    alone = at[np.bincount(inverse, weights=weight[owner]) == 1]
    own = owner[alone]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(rows.column("h").combine_chunks())[own]), pa.array(np.asarray(rows.column("n_bytes").combine_chunks())[own]), pa.array(first[own] + spots[alone] - begin[own])], names=["h", "n_bytes", "at"])


def _alone_by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same over batches in the order of gram; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        grams = np.asarray(batch.column("gram"))
        ends = np.flatnonzero(grams[1:] != grams[:-1])
        if held and np.asarray(held[-1].column("gram"))[-1] != grams[0]:
            if (out := _alone_in(pa.Table.from_batches(held))) is not None:
                yield out
            held = []
        if len(ends):
            cut = int(ends[-1]) + 1
            if (out := _alone_in(pa.Table.from_batches([*held, batch.slice(0, cut)]))) is not None:
                yield out
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held and (out := _alone_in(pa.Table.from_batches(held))) is not None:
        yield out


def removed(closed: tuple[np.ndarray, np.ndarray], opened: tuple[np.ndarray, np.ndarray], alone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed spans: strings that start in a closed run, or in an open one and not alone."""
    begin, end = [closed[0]], [closed[1] + LENGTH]
    if len(opened[0]):
        spots = np.setdiff1d(_spots(*opened), alone)
        begin.append(spots)
        end.append(spots + LENGTH)
    begin, end = np.concatenate(begin), np.concatenate(end)
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    starts = np.flatnonzero(new)
    return list(zip(begin[starts].tolist(), end[np.append(starts[1:], len(begin)) - 1].tolist()))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for batch in batches:
        n_bytes, spans, kept = [], [], []
        for value, found, alone in zip(batch.column("text"), batch.column("found"), batch.column("alone")):
            text = value.as_buffer()
            text = b"" if text is None else text.to_pybytes()
            got = []
            if found.is_valid:
                first, last, is_open = (np.asarray(found.values.field(f)) for f in ("first", "last", "open"))
                is_open = is_open.astype(bool)
                got = removed((first[~is_open], last[~is_open]), (first[is_open], last[is_open]), np.asarray(alone.values) if alone.is_valid else none)
            at, left = 0, []
            for a, b in got:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            n_bytes.append(len(text))
            spans.append([{"start": a, "end": b} for a, b in got])
            kept.append(b"".join(left))
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_bytes, spans (removed byte ranges, start and end), kept (the remaining bytes); one for each row of docs.

    Null texts count as empty; texts under 200 bytes lose nothing. A string that starts twice in one text repeats; so
    does one in a repeated row, whose copies get equal results. Null ids are kept; an empty table gives no rows; other
    columns are not read. Equality is that of two 64-bit ranks: of a run's anchor and of its extent, or of a string's
    anchor and of the string.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    n_bytes = F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint")
    rows = docs.select(F.xxhash64(i.isNull(), i.cast("string"), t.isNull(), t).alias("h"), n_bytes.alias("n_bytes"), i.alias("id"), t.alias("text"))
    key = ["h", "n_bytes"]
    texts = rows.where(n_bytes >= LENGTH).select("h", "text")
    kinds = "h bigint, n_bytes bigint, first bigint, last bigint, gram bigint, extent bigint"
    narrow = ["h", *[F.col(c).cast("int").alias(c) for c in ("n_bytes", "first", "last")], "gram", "extent"]
    counted = texts.mapInArrow(_count_runs, kinds + ", c bigint").select(*narrow, "c")
    # dealt by gram alone, for all that follows; equal runs have met before, in their batches
    same = counted.repartition("gram").groupBy("gram", "extent").agg(F.sum("c").alias("c"), *[F.first(c).alias(c) for c in ("h", "n_bytes", "first", "last")])
    gram = Window.partitionBy("gram")
    ranked = same.withColumns({"g": F.sum("c").over(gram), "extents": F.count(F.lit(1)).over(gram), "single": F.sum((F.col("c") == 1).cast("int")).over(gram)})
    # closed: the whole run repeats. A closed run still stands for its equals where its anchor has open ones.
    asks = (F.col("extents") > 1) & (F.col("single") > 0)
    ranked = table(ranked.where("g > 1").select("h", F.col("n_bytes").cast("bigint"), "first", "last", "gram", "extent", (F.col("c") == 1).alias("open"), asks.alias("asks"), (asks & (F.col("extents") > WIDE)).alias("wide")))
    verdicts = ranked.where("asks")
    # all the runs once more, for those that repeat: cheaper than keeping them
    again = texts.mapInArrow(_find_runs, kinds).select(*narrow)
    closed = again.join(ranked.where("not open").select("gram", "extent"), ["gram", "extent"], "left_semi").select("h", F.col("n_bytes").cast("bigint"), "first", "last", F.lit(False).alias("open"))

    def asking(which: str) -> DataFrame:
        asks = verdicts.where(which).groupBy(key).agg(F.collect_list(F.struct("first", "last", "gram", F.when(F.col("open"), 1).otherwise(2).alias("weight"))).alias("open"))
        # all columns of rows, so that every join with the texts reads the same shuffle
        return rows.join(asks, key).select(*rows.columns, "open")

    runs_ = asking("not wide").mapInArrow(_open_runs, "gram bigint, h bigint, n_bytes bigint, first bigint, weight bigint, bytes binary")
    alone = runs_.repartition("gram").sortWithinPartitions("gram").mapInArrow(_alone_by_gram, "h bigint, n_bytes bigint, at bigint")
    if not verdicts.where("wide").isEmpty():
        strings = asking("wide").mapInArrow(_open_strings, "gram bigint, rank bigint, h bigint, n_bytes bigint, at bigint, weight bigint")
        single = strings.groupBy("gram", "rank").agg(F.sum("weight").alias("n"), *[F.min(c).alias(c) for c in ("h", "n_bytes", "at")]).where("n = 1")
        alone = alone.unionByName(single.select("h", "n_bytes", "at"))
    alone = alone.groupBy(key).agg(F.collect_list(F.col("at").cast("int")).alias("alone"))
    per_text = closed.unionByName(verdicts.where("open").select(*closed.columns)).groupBy(key).agg(F.collect_list(F.struct("first", "last", "open")).alias("found"))
    met = rows.join(per_text, key, "left").join(alone, key, "left").select("id", "text", "found", "alone")
    kind = rows.schema["id"].dataType.simpleString()
    return met.mapInArrow(_cut_out, f"id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary").withColumnRenamed("id", id_col)
