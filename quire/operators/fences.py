"""Fenced code over lines of documents of any length: a prefix scan over ranges of lines.

Whether a line is in a fenced block depends on all lines before it, but what a range of lines does to that state is a
small table: where it leads from outside, and for each sort of fence the lengths at which the range closes it and where
it leads from there. So ranges are summed up by themselves, the driver carries the state from range to range, and each
range then marks its own lines. A document that fills many tasks is marked by many.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.cards import _FENCE
from quire.operators.ordering import ranged

#: Only such lines change the state.
LIKE_A_FENCE = re.compile(r" {0,3}(?:```|~~~)")
SUMS = pa.schema([("p", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("one", pa.bool_()), ("out", pa.string()), ("closed", pa.string())])


def after(state: str, line: str) -> str:
    """The open fence after a line, '' for none."""
    m = _FENCE.fullmatch(line)
    if not m:
        return state
    if state:
        return "" if m[1][0] == state[0] and len(m[1]) >= len(state) and not m[2].strip() else state
    return "" if m[1][0] == "`" and "`" in m[2] else m[1]


class Effect:
    """What lines do to the state: `out` from outside; for each sort of fence, (length, state) for the lengths up to which it is closed."""

    def __init__(self, out: str = "", closed: dict[str, list[list]] | None = None) -> None:
        self.out, self.closed = out, closed or {"`": [], "~": []}

    def add(self, line: str) -> None:
        m = _FENCE.fullmatch(line)
        if not m:
            return
        self.out = after(self.out, line)
        for steps in self.closed.values():
            for step in steps:
                step[1] = after(step[1], line)
        steps = self.closed[m[1][0]]
        if not m[2].strip() and (not steps or steps[-1][0] < len(m[1])):
            steps.append([len(m[1]), ""])  # the fences that were too long for what closed before

    def on(self, state: str) -> str:
        if not state:
            return self.out
        return next((to for length, to in self.closed[state[0]] if len(state) <= length), state)

    def then(self, other: Effect) -> Effect:
        """This effect and then another, as one."""
        closed = {}
        for kind, steps in self.closed.items():
            longest = steps[-1][0] if steps else 0
            closed[kind] = [[n, other.on(to)] for n, to in steps] + [[n, to] for n, to in other.closed[kind] if n > longest]
        return Effect(other.on(self.out), closed)


def effect(lines: Iterable[str]) -> Effect:
    out = Effect()
    for line in lines:
        if LIKE_A_FENCE.match(line):
            out.add(line)
    return out


def _edges(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
    """Where the document (column 1) changes inside a batch, 0 first, and the document of each such run."""
    doc = batch.column(1)
    n = batch.num_rows
    one, two = doc.slice(0, n - 1), doc.slice(1)
    same = pc.fill_null(pc.equal(one, two), False) if n > 1 else pa.array([], pa.bool_())
    none = np.asarray(doc.is_null())
    equal = np.asarray(same).astype(bool) | (none[1:] & none[:-1])
    at = np.append(0, np.flatnonzero(~equal) + 1)
    return at, doc.take(pa.array(at)).to_pylist()


def _likely(batch: pa.RecordBatch) -> tuple[list[int], list[str]]:
    """Places and texts of the lines (column 2, null unless they look like a fence) that may change the state."""
    lines = batch.column(2)
    at = np.flatnonzero(np.asarray(lines.is_valid()))
    return at.tolist(), lines.take(pa.array(at)).to_pylist()


def with_in_code(lines: DataFrame, doc: str = "book_id", order: str = "line_no", line: str = "line", out: str = "in_code", parts: int | None = None) -> DataFrame:
    """lines with whether each is part of a fenced block of its document, its fences included.

    Lines are dealt by ranges of (document, order) once; a null line is an empty one, null documents are one, and lines
    of equal order may come in any order. An empty table gives none.
    """
    fenced = F.when(F.col(f"`{line}`").rlike(LIKE_A_FENCE.pattern.join(("^(?:", ")"))), F.col(f"`{line}`"))
    rows = ranged(lines, doc, order, parts=parts)
    part = F.spark_partition_id().alias("__p")
    # all that the state depends on; most lines are null here
    narrow = rows.select(part, F.col(f"`{doc}`").alias("__doc"), fenced.alias("__fenced"))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, found, p, any_rows, one = None, None, Effect(), 0, False, True
        for batch in batches:
            if not batch.num_rows:
                continue
            edges, docs = _edges(batch)
            if not any_rows:
                first, last, any_rows, p = docs[0], docs[0], True, batch.column(0)[0].as_py()
            one = one and len(docs) == 1 and docs[0] == first
            at, texts = _likely(batch)
            if docs[-1] != last or len(docs) > 1:  # only the last document of a range goes on
                if len(docs) > 1 or docs[0] != last:
                    found = Effect()
                skip = int(np.searchsorted(at, edges[-1]))
                at, texts = at[skip:], texts[skip:]
            last = docs[-1]
            for x in texts:
                found.add(x)
        if any_rows:
            yield pa.RecordBatch.from_pylist([{"p": p, "first": None if first is None else str(first), "last": None if last is None else str(last), "one": one, "out": found.out, "closed": json.dumps(found.closed)}], schema=SUMS)

    known = {r["p"]: r for r in narrow.mapInArrow(sum_up, "p int, first string, last string, one boolean, out string, closed string").collect()}
    entry: dict[int, str] = {}
    state, before = "", object()
    for p in sorted(known):
        r = known[p]
        entry[p] = state if r["first"] == before else ""
        state = Effect(r["out"], json.loads(r["closed"])).on(entry[p] if r["one"] else "")
        before = r["last"]

    names = rows.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fence, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            edges, docs = _edges(batch)
            if fence is None:
                fence, last = entry.get(batch.column(0)[0].as_py(), ""), docs[0]
            # the state changes where a document begins and at lines like fences; between them it stays
            marks = np.zeros(batch.num_rows, bool)
            at, texts = _likely(batch)
            begin = edges.tolist()
            if docs[0] == last:
                begin = begin[1:]
            starts, i, done = iter([*begin, batch.num_rows]), 0, 0
            for stop in starts:
                while i < len(at) and at[i] < stop:
                    if fence:
                        marks[done : at[i]] = True
                    new = after(fence, texts[i])
                    marks[at[i]] = bool(fence or new)
                    fence, done = new, at[i] + 1
                    i += 1
                if fence:
                    marks[done:stop] = True
                done = stop
                if stop < batch.num_rows:
                    fence = ""
            last = docs[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(marks)], names=[*names, out])

    return rows.select(part, F.col(f"`{doc}`").alias("__doc"), fenced.alias("__fenced"), *[F.col(f"`{c}`") for c in names]).mapInArrow(mark, T.StructType([*rows.schema.fields, T.StructField(out, T.BooleanType())]))
