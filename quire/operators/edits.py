"""Deleting sections and taking deletions back. Tables are never changed in place."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.assemble import reindex

MAX_UNDO = 10


def delete_section(sections: DataFrame, index: int, book_id: str | None = None, strict: bool = False) -> DataFrame:
    """Sections without all those of that index (in one book, or in each), numbered anew.

    strict: a book that lacks the index is an error when its rows are reached; so is a table that is no section table.
    """
    if not {"book_id", "index"} <= set(sections.columns):
        raise ValueError("Invalid JSON data structure")
    asked = F.lit(True) if book_id is None else F.col("book_id") == book_id
    hit = F.coalesce(F.col("index") == index, F.lit(False)) & asked
    if strict:
        has = F.max(hit).over(Window.partitionBy("book_id"))
        fault = F.raise_error(F.lit(f"Section with index {index} not found")).cast("boolean")
        sections = sections.withColumn("__hit", hit).withColumn("__has", F.when(asked & ~has, fault).otherwise(True))
        return reindex(sections.where("__has and not __hit").drop("__hit", "__has"))
    return reindex(sections.where(~hit))


def undo_summary(stack: Column) -> Column:
    """Title and time of the last deletion and how many can be taken back; null for an empty stack. Items have title and timestamp."""
    last = top(stack)
    return F.when(can_undo(stack), F.struct(last["title"].alias("section_title"), last["timestamp"].alias("timestamp"), F.size(stack).alias("count")))


def deleted(sections: DataFrame, index: int, timestamp_ms: int, book_id: str | None = None) -> DataFrame:
    """What undo needs: the first section of that index, its place from 0 in the book, and the time."""
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("index")) - 1
    rows = sections.withColumn("original_position", place).where(F.col("index") == index)
    if book_id is not None:
        rows = rows.where(F.col("book_id") == book_id)
    first = rows.groupBy("book_id").agg(F.min("original_position").alias("original_position"))
    return rows.join(first, ["book_id", "original_position"], "left_semi").withColumn("timestamp", F.lit(timestamp_ms).cast("bigint"))


def undo_delete(sections: DataFrame, gone: DataFrame) -> DataFrame:
    """Sections with the deleted ones put back at their places, numbered anew."""
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("index")) - 1
    names = sections.columns
    kept = sections.withColumn("__o", place.cast("double"))
    back = gone.select(*names, (F.col("original_position") - 0.5).alias("__o"))
    out = kept.unionByName(back)
    return out.withColumn("index", F.row_number().over(Window.partitionBy("book_id").orderBy("__o"))).drop("__o")


def recount(metadata: DataFrame, sections: DataFrame, removed: int = 0) -> DataFrame:
    """extracted_sections counted anew; filtered_sections plus removed."""
    n = sections.groupBy("book_id").agg(F.count(F.lit(1)).alias("__n"))
    out = metadata.join(n, "book_id", "left")
    return out.withColumn("extracted_sections", F.coalesce("__n", F.lit(0))).withColumn("filtered_sections", F.coalesce("filtered_sections", F.lit(0)) + removed).drop("__n")


def push(stack: Column, item: Column, most: int = MAX_UNDO) -> Column:
    """The item on top, the oldest dropped beyond `most`; 0 keeps all."""
    grown = F.concat(stack, F.array(item))
    return grown if most == 0 else F.slice(grown, F.greatest(F.size(grown) - most + 1, F.lit(1)), F.lit(most))


def pop(stack: Column) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))


def top(stack: Column) -> Column:
    return F.when(F.size(stack) > 0, F.element_at(stack, -1))


def can_undo(stack: Column) -> Column:
    return F.coalesce(F.size(stack), F.lit(0)) > 0


def clear(stack: Column) -> Column:
    return F.slice(stack, F.lit(1), F.lit(0))


REMOVED = "book_id string, place int, seq bigint, undoable boolean"


class Alive:
    """Which of n places are left, with the k-th of them found in log n steps: a tree of counts over powers of two."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.counts = [i & -i for i in range(n + 1)]
        self.left = n

    def add(self, place: int, d: int) -> None:
        self.left += d
        while place <= self.n:
            self.counts[place] += d
            place += place & -place

    def find(self, k: int) -> int:
        """The place of the k-th one left, from 1."""
        at = 0
        for step in (1 << b for b in reversed(range(self.n.bit_length()))):
            if at + step <= self.n and self.counts[at + step] < k:
                at += step
                k -= self.counts[at]
        return at + 1


def removed_by(sections: DataFrame, log: DataFrame, most: int = MAX_UNDO) -> DataFrame:
    """Rows book_id, place, seq, undoable: the sections (by their place from 1) that a log of edits leaves deleted.

    log has book_id, seq, op and index, and is replayed by seq: `delete` takes the section that has the index by then,
    as sections are numbered anew after each edit; an index that no section has is passed over. `undo` puts the last
    deleted one back at its place; only the last `most` deletions can be taken back (0: all), and an undo without any
    is passed over. Since deletions are taken back last first, sections never change their order, so a book needs a
    bit and a count a section and its stack, whatever the length of its log. Equal seq go by op and index; books
    without sections, and ops of other names, are passed over.
    """
    sizes = sections.groupBy("book_id").agg(F.count(F.lit(1)).alias("index")).select("book_id", F.lit(None).cast("bigint").alias("seq"), F.lit("size").alias("op"), "index")
    steps = sizes.unionByName(log.select("book_id", F.col("seq").cast("bigint").alias("seq"), "op", F.col("index").cast("bigint").alias("index")).where("seq is not null and book_id is not null"))
    # a book's rows are streamed in order: its size first, then its edits
    steps = steps.repartition("book_id").sortWithinPartitions("book_id", F.asc_nulls_first("seq"), "op", "index")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, alive, stack, gone = None, None, deque(), {}

        def rest() -> pd.DataFrame:
            can = {p for p, _ in stack}
            return pd.DataFrame([(book, p, s, p in can) for p, s in gone.items()], columns=["book_id", "place", "seq", "undoable"])

        for f in frames:
            for b, seq, op, index in zip(f["book_id"], f["seq"], f["op"], f["index"]):
                if b != book:
                    if gone:
                        yield rest()
                    book, alive, stack, gone = b, None, deque(maxlen=most or None), {}
                if op == "size" and pd.isna(seq):
                    alive = Alive(int(index))
                elif alive is None:
                    continue
                elif op == "delete" and 1 <= index <= alive.left:
                    place = alive.find(int(index))
                    alive.add(place, -1)
                    gone[place] = int(seq)
                    stack.append((place, seq))
                elif op == "undo" and stack:
                    place, _ = stack.pop()
                    alive.add(place, 1)
                    del gone[place]
        if gone:
            yield rest()

    return steps.mapInPandas(run, REMOVED)


def replay(sections: DataFrame, log: DataFrame, most: int = MAX_UNDO) -> DataFrame:
    """The sections that a log of edits leaves, numbered anew; see removed_by(). Texts move once, to meet what is removed."""
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("index"))
    placed = sections.select("book_id", F.col("index").alias("__index")).withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("__index")))
    gone = removed_by(sections, log, most).join(placed, ["book_id", "place"]).select("book_id", F.col("__index").alias("index"))
    return sections.join(gone, ["book_id", "index"], "left_anti").withColumn("index", place)
