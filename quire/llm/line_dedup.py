"""Line deduplication within an edit bound of one word, in DataFrame functions only.

The deletion neighbourhood of a line is the line and every line that lacks one of its words. Two lines within one
edit (a word replaced, inserted or deleted) have a member in common. Keys carry the place of the deleted word, so
that all lines under one key are within one replacement of each other, and the earliest of a key stands for all:
no pairs are listed. Before that, lines that share neither half with another line are set aside: of two lines within
one edit, the first half or the last half of the shorter one is in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, hash2, packed, table

#: Lines of fewer words are only compared whole: one edit would be more than a fifth of them.
MIN_WORDS = 5
#: Words of a line whose hashes are summed at a time.
BLOCK = 64
#: Up to this many lines (counted first; two longs each) are broadcast; more are joined by shuffle.
BROADCAST_LINES = 500_000


def _broadcast(rows: DataFrame) -> DataFrame:
    """A table to be broadcast if it has few rows; a longer one is joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_LINES else rows


def _row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    parts = [i.isNull(), i.cast("string"), t.isNull(), t]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line that has a word: o (its place: id, row key, number), line (its words, a space between), l, l2 (hashes)."""
    one, two = _row_keys(id_col, text_col)
    i, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    rows = docs.select(i.isNull().alias("none"), i.alias("id"), one.alias("h"), two.alias("h2"), text.alias("t"))
    single = F.when(F.contains("t", F.lit("  ")), F.regexp_replace("t", " +", " ")).otherwise(F.col("t"))
    rows = rows.select("none", "id", "h", "h2", F.posexplode(F.split(single, "\n")).alias("no", "line"))
    rows = rows.select(F.struct("none", "id", "h", "h2", "no").alias("o"), F.trim("line").alias("line")).where("line <> ''")
    return rows.select("o", "line", F.xxhash64("line").alias("l"), hash2(F.col("line")).alias("l2"))


def _size(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _half(n: Column) -> Column:
    """Length of the halves that a line shares with a line one word shorter."""
    return F.floor((n - 1) / 2).cast("int")


def _part(line: Column, count: Column) -> Column:
    """The first `count` words, or the last -count."""
    return F.call_function("substring_index", line, F.lit(" "), count)


def _halves(line: Column, n: Column) -> Column:
    """Hashes of the first (side 1) and last (side 2) halves, for partners as long and one word shorter."""

    def pair(a: Column) -> list[Column]:
        return [F.struct(F.xxhash64(F.lit(side), a, _part(line, count)).alias("k"), F.lit(side).alias("side")) for side, count in ((1, a), (2, -a))]

    longer, shorter = pair(_half(n + 1)), pair(_half(n))  # the same for an odd number of words
    return F.when(n < MIN_WORDS, F.array().cast("array<struct<k:bigint,side:int>>")).when(n % 2 == 1, F.array(*longer)).otherwise(F.array(*longer, *shorter))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _before(x: Column, n: Column) -> Column:
    """For each member of an array of n hashes, the XOR of all before it: within blocks first, so that long lines stay linear."""
    zero = F.lit(0).cast("bigint")
    none = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("all"))
    run = lambda part: F.aggregate(part, none, lambda a, v: F.struct(_xor(a["sum"], v).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: run(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
    within = lambda bs: _let(run(F.transform(bs, lambda b: b["sum"]))["all"], lambda heads: F.flatten(F.transform(bs, lambda b, i: F.transform(b["all"], lambda v: _xor(v, F.get(heads, i))))))
    return _let(blocks, within)


def _variants(line: Column, first: Column, last: Column) -> Column:
    """kind and key of the line without each of the words that an edit may touch: 1 with the word's place, 2 without it; and 3, the line.

    A list of words has the XOR of the hashes of its words and their places, so that leaving one out takes no second
    look at the others.
    """
    zero = F.lit(0).cast("bigint")
    total = lambda h, f: F.aggregate(h, zero, lambda a, x: _xor(a, x[f]))

    def keys(h: Column) -> Column:
        n = F.size(h)
        half = _half(n)
        facts = F.struct(n.alias("n"), total(h, "a").alias("ta"), total(h, "b").alias("tb"), _before(F.transform(h, lambda x: _xor(x["a"], x["b"])), n).alias("p"))

        def each(g: Column) -> Column:
            rows = F.transform(h, lambda x, i: F.struct((i + 1).alias("p"), _xor(g["ta"], x["a"]).alias("r"), _xor(_xor(g["tb"], x["b"]), F.get(g["p"], i)).alias("d")))
            kept = F.filter(rows, lambda x: (first & (x["p"] > half)) | (last & (x["p"] <= n - half)))
            key = lambda kind, *of: F.struct(F.lit(kind).alias("kind"), F.xxhash64(*of).alias("k"))
            both = F.flatten(F.transform(kept, lambda x: F.array(key(1, F.lit(1), x["p"], x["r"]), key(2, F.lit(2), x["d"]))))
            return F.concat(both, F.array(key(3, F.lit(2), g["ta"])))

        return _let(facts, each)

    # a: the word at its place; b: at the place before, where it stands once an earlier one is gone
    return _let(F.transform(F.split(line, " "), lambda w, i: F.struct(F.xxhash64(w, i).alias("a"), F.xxhash64(w, i - 1).alias("b"))), keys)


def _without(w: Column, i: Column) -> Column:
    return F.concat(F.slice(w, F.lit(1), i - 1), F.slice(w, i + 1, F.size(w)))


def _within_one(a: Column, b: Column) -> Column:
    """True if the word lists are equal or differ by one replaced, inserted or deleted word."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differ, True).cast("int")
    same_size = F.size(F.filter(differ, lambda x: x)) <= 1
    return F.when(F.size(a) == F.size(b), same_size).when(F.size(a) == F.size(b) + 1, _without(a, first) == b).when(F.size(b) == F.size(a) + 1, _without(b, first) == a).otherwise(False)


def _near(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """l, l2 of the distinct lines that have an earlier distinct line within one edit."""
    halves = distinct.select("l", "l2", F.explode("halves").alias("x")).select("l", "l2", "x.k", "x.side")
    # a key's least and greatest line tell whether it has several; they are combined before the shuffle
    several = _broadcast(table(halves.groupBy("k").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo <> hi").select("k")))
    shared = halves.join(several, "k", "left_semi")
    found = table(shared.groupBy("l", "l2").agg((F.min("side") == 1).alias("first"), (F.max("side") == 2).alias("last")))
    wanted = _broadcast(found).select(F.col("l").alias("__l"), F.col("l2").alias("__l2"), "first", "last")
    seen = _lines(docs, id_col, text_col).join(wanted, (F.col("l") == F.col("__l")) & (F.col("l2") == F.col("__l2")))
    lines = table(seen.groupBy("l", "l2").agg(F.min("o").alias("o"), *[F.first(c).alias(c) for c in ("line", "first", "last")]))

    # a shared half leaves only the other part of the line for the edit
    each = table(lines.select("l", "l2", F.explode(_variants(F.col("line"), F.col("first"), F.col("last"))).alias("x")).select("l", "l2", "x.kind", "x.k"))
    seen = each.groupBy("k").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.min("kind").alias("least"), F.max("kind").alias("most"))
    several = _broadcast(table(seen.where("lo <> hi and (most = 1 or (least = 2 and most = 3))").select("k")))
    met = each.join(several, "k", "left_semi")
    met = table(met.distinct().join(lines.select("l", "l2", "o"), ["l", "l2"]).select("o", "kind", "k"))

    # replaced: all lines of a key are within one edit of each other, and the earliest stands for them
    by_place = met.where("kind = 1").groupBy("k").agg(F.min("o").alias("e"))
    replaced = met.where("kind = 1").join(by_place, "k").where("o > e").select("o", "e")
    # deleted: a whole line against the lines that lack one word of another; either may be the earlier
    longer, shorter = met.where("kind = 2").select("k", F.col("o").alias("g")), met.where("kind = 3").select("k", F.col("o").alias("s"))
    both = longer.join(shorter, "k").where("g <> s")
    later_long = both.where("s < g").select(F.col("g").alias("o"), F.col("s").alias("e"))
    later_short = both.groupBy("s").agg(F.min("g").alias("e")).where("e < s").select(F.col("s").alias("o"), "e")
    pairs = replaced.unionByName(later_long).unionByName(later_short).distinct()

    a = lines.select("o", F.split("line", " ").alias("wo"), "l", "l2")
    b = lines.select(F.col("o").alias("e"), F.split("line", " ").alias("we"))
    return pairs.join(a, "o").join(b, "e").where(_within_one(F.col("wo"), F.col("we"))).select("l", "l2").distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows h, h2 (the row's key) and keep: the numbers, from 0, of the lines with a word that stay."""
    lines = _lines(docs, id_col, text_col).withColumn("n", _size(F.col("line"))).select("o", "l", "l2", _halves(F.col("line"), F.col("n")).alias("halves"))
    distinct = table(lines.groupBy("l", "l2").agg(F.min("o").alias("o"), F.first("halves").alias("halves")))
    near = table(_near(docs, distinct, id_col, text_col))
    near = _broadcast(near)
    stay = distinct.select("l", "l2", "o").join(near, ["l", "l2"], "left_anti")
    return stay.groupBy(F.col("o.h").alias("h"), F.col("o.h2").alias("h2")).agg(F.sort_array(F.collect_list("o.no")).alias("keep"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the lines removed that repeat an earlier line, whole or within one edit; all rows stay.

    A line is compared by its words; those of fewer than MIN_WORDS words only whole. Earlier is by id (null last),
    then row hash, then line number, over the whole table; what counts is any earlier line, kept or not. Lines without
    a word stay. Null texts stay null; empty ones stay empty. Rows equal in id and text are one document and get equal
    results. counts: names of columns to add with the number of lines and of removed lines, with underscores after them
    where docs has such columns; all other columns pass through unchanged. An empty table gives no rows.
    """
    one, two = _row_keys(id_col, text_col)
    keep = kept_lines(docs, id_col, text_col)
    met = docs.select(packed(docs), one.alias("h"), two.alias("h2")).join(keep, ["h", "h2"], "left")
    # one character a line, so that a line's flag is found by its number
    marks = F.transform("keep", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("keep", i - 1), F.lit(-1)) - 1), F.lit("1")))
    flags = F.split(F.array_join(F.coalesce(marks, F.array().cast("array<string>")), ""), "")
    text = F.col("row")[text_col]
    lines = F.split(text, "\n")
    # flags become a variable, so that a filter on the text, pushed down to here, does not compute them for each line
    left = F.transform(F.array(flags), lambda f: F.filter(lines, lambda x, i: (F.get(f, i) == "1").eqNullSafe(True) | ~x.rlike(r"[^ \t\n\x0B\f\r]")))
    met = met.select("row", lines.alias("lines"), F.get(left, F.lit(0)).alias("left"))
    out = [F.array_join("left", "\n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    if counts:
        total = F.coalesce(F.size("lines"), F.lit(0))
        total = F.when(F.col("lines").isNull(), 0).otherwise(total).cast("bigint")
        gone = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("left")).cast("bigint")
        out.append(total.alias(free_name(counts[0], docs.columns)))
        out.append(gone.alias(free_name(counts[1], [*docs.columns, counts[0]])))
    return met.select(*out)
