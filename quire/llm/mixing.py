"""Mixing sources to target token weights by entropy balancing, in DataFrame functions only.

Among all document rates that meet a source's token target, the one closest to "every document once" in entropy is
an exponential tilt: rate = exp(lambda * size), here cut at the largest allowed rate. The convex dual has one lambda
for each source. Newton steps for all sources at once are one aggregation over (source, size) cells. The rates are
then rounded into whole copies so that each source's tokens stay near its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, numbered, packed, table, words

WEIGHTS, SHARE_PERCENT, MAX_RATE = (3, 1, 2), 150, 2
#: Sizes of a band that the last walk may change.
WALK_CELLS = 32
#: More passes than halvings a bracket of doubles can have.
NEWTON_STEPS, TOLERANCE = 1200, 1e-6


def _key(source: Column) -> Column:
    """A key that joins null to null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_rate: int = MAX_RATE) -> DataFrame:
    """Rows key, source, source_size, target: each source's share of the mix, at most max_rate times its size.

    Sources in code-point order, null last, weigh `weights`, repeating. Sharing an excess again by weight, until none
    is above its limit, ends where target = min(limit, level * weight); the level is found from running sums over the
    sources in the order limit / weight.
    """
    per = cells.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * max_rate)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share_percent / 100)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    share = F.try_divide(left, weight_left)
    level = F.when(share <= F.col("cap") / F.col("w"), share)
    per = per.withColumn("level", level).withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return per.select("key", "source", "source_size", target.alias("target"))


def tilts(cells: DataFrame, wanted: DataFrame, max_rate: int = MAX_RATE, steps: int = NEWTON_STEPS) -> DataFrame:
    """wanted with lam and scale: rate = min(max_rate, exp(lam * size / scale)).

    Newton steps on log tokens(lam) = log target inside a bracket that is known beforehand: at ln(max_rate) over the
    least size of a source all its rates are at their limit, and at ln(target / source_size) over it the tokens are
    below a target that is less than the source. Every pass is one aggregation of the cells that tries three points:
    Newton's, the middle of the bracket and its geometric middle. So the bracket at least halves, whatever the sizes,
    and a pass after the one that leaves no double between its ends is not needed. Sources at their limit need none.
    """
    positive = F.when(F.col("size") > 0, F.col("size"))
    scale = cells.groupBy("key").agg(
        F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")), F.sum(F.col("n") * F.col("size"))).alias("scale"), F.min(positive).alias("least")
    )
    state = wanted.join(scale.hint("merge"), "key").withColumn("at_limit", F.col("target") >= max_rate * F.col("source_size").cast("double"))
    low = F.ln(F.col("target") / F.col("source_size")) * F.col("scale") / F.col("least")
    high = F.lit(math.log(max_rate)) * F.col("scale") / F.col("least")
    done = F.col("at_limit") | (F.col("source_size") == 0) | (F.col("target") <= 0)
    zero, half = F.lit(0.0), (F.col("lo") + F.col("hi")) / 2
    state = state.withColumn("done", done).withColumns({"lo": F.when(~done, F.least(low, zero)), "hi": F.when(~done, F.greatest(high, zero))})
    state = state.withColumns({"lo": F.when(F.col("target") >= F.col("source_size"), zero).otherwise(F.col("lo")), "hi": F.when(F.col("target") < F.col("source_size"), zero).otherwise(F.col("hi"))})
    state = cut(state.withColumns({"lam": F.when(F.col("done"), zero).otherwise(half), "try0": zero, "try1": half, "try2": half / 1024}).drop("least"))
    for _ in range(steps):
        open_ = state.where(~F.col("done"))
        x, tokens = F.try_divide(F.col("size"), F.col("scale")), F.col("n") * F.col("size")
        sums = []
        for i in range(3):
            r = F.exp(F.col(f"try{i}") * x)
            sums += [F.sum(tokens * F.least(r, F.lit(float(max_rate)))).alias(f"g{i}"), F.sum(F.when(r < max_rate, tokens * x * r).otherwise(0.0)).alias(f"s{i}")]
        got = cells.join(open_.select("key", "scale", "try0", "try1", "try2").hint("merge"), "key").groupBy("key").agg(*sums)
        s = state.join(got.hint("merge"), "key", "left")
        tried = [F.struct(F.abs(F.ln("target") - F.ln(f"g{i}")).alias("error"), F.col(f"try{i}").alias("lam"), F.col(f"g{i}").alias("g"), F.col(f"s{i}").alias("slope")) for i in range(3)]
        best = F.array_min(F.filter(F.array(*tried), lambda t: t["error"].isNotNull()))
        below = [F.when(F.col(f"g{i}") < F.col("target"), F.col(f"try{i}")) for i in range(3)]
        above = [F.when(F.col(f"g{i}") >= F.col("target"), F.col(f"try{i}")) for i in range(3)]
        s = s.withColumns({"best": best, "lo": F.greatest("lo", *below), "hi": F.least("hi", *above)})
        newton = F.col("best.lam") + F.try_divide((F.ln("target") - F.ln("best.g")) * F.col("best.g"), F.when(F.col("best.slope") > 0, F.col("best.slope")))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        geometric = F.when(F.col("lo") > 0, F.sqrt(F.col("lo")) * F.sqrt(F.col("hi"))).when(F.col("hi") < 0, -F.sqrt(-F.col("lo")) * F.sqrt(-F.col("hi")))
        geometric = F.coalesce(geometric, F.when(F.col("lo") == 0, F.col("hi") / 1024).otherwise(F.col("lo") / 1024))
        narrow = (half <= F.col("lo")) | (half >= F.col("hi"))  # no double lies between
        s = s.withColumns({"keep": F.col("done") | (F.col("best.error") < TOLERANCE) | narrow, "next": F.when(inside, newton).otherwise(half)})
        lam = F.when(F.col("done"), F.col("lam")).when(F.col("keep"), F.coalesce("best.lam", half)).otherwise(F.col("next"))
        state = cut(s.select("key", "source", "source_size", "target", "at_limit", "scale", F.col("keep").alias("done"), "lo", "hi", lam.alias("lam"), F.col("next").alias("try0"), half.alias("try1"), geometric.alias("try2")))
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("key", "source", "source_size", "target", "at_limit", "scale", F.round("lam", 9).alias("lam"))


def _band(size: Column) -> Column:
    """Eight bands for each doubling of the size; a source of any size has some hundreds at most."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double")) * 8)).otherwise(F.lit(-1)).cast("int")


def copies_by_cell(cells: DataFrame, tilted: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """Rows key, size, n, copies: whole copies for each cell of equal documents.

    Down a source's sizes, copies follow the running sum of the rates (in millionths), so the rounding error of the
    tokens is at most half the largest size. The sum runs over bands of sizes first and then within each band, so no
    task holds all sizes of a source. A second walk, over the most frequent sizes of each band, largest first, then
    takes or gives back what is left over.
    """
    rate = F.when(F.col("at_limit"), F.lit(float(max_rate))).when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(max_rate)), F.exp(F.try_divide(F.col("lam") * F.col("size"), F.col("scale")))))
    c = cells.join(tilted.select("key", "target", "at_limit", "lam", "scale"), "key").withColumns({"part": F.round(F.col("n") * rate * 1_000_000).cast("bigint"), "band": _band(F.col("size"))})
    bands = c.groupBy("key", "band").agg(F.sum("part").alias("in_band"))
    down = Window.partitionBy("key").orderBy(F.col("band").desc())
    bands = bands.select("key", "band", (F.sum("in_band").over(down) - F.col("in_band")).alias("before"))
    within = Window.partitionBy("key", "band").orderBy(F.col("size").desc())
    to = F.col("before") + F.sum("part").over(within)
    whole = lambda at: F.floor((at + 500_000) / 1_000_000)
    c = c.join(bands, ["key", "band"]).withColumn("to", to)
    c = c.withColumn("k", F.greatest(F.lit(0), F.least(whole(F.col("to")) - whole(F.col("to") - F.col("part")), max_rate * F.col("n"))).cast("bigint"))
    c = table(c.select("key", "size", "n", "k", "band", "target"))
    common = Window.partitionBy("key", "band").orderBy(F.col("n").desc(), F.col("size").desc())
    some = c.where("size > 0").withColumn("place", F.row_number().over(common)).where(F.col("place") <= WALK_CELLS)
    some = some.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("size", "n", "k")), asc=False).alias("cells"))
    taken = c.groupBy("key").agg((F.first("target") - F.sum(F.col("k") * F.col("size"))).alias("rest"))
    sizes = some.join(taken, "key")
    start = F.struct(F.col("rest").cast("double").alias("rest"), F.array().cast("array<struct<size:bigint,delta:bigint>>").alias("moves"))

    def walk(a: Column, x: Column) -> Column:
        wish = F.when(a["rest"] >= 0, F.floor(a["rest"] / x["size"])).otherwise(F.ceil(a["rest"] / x["size"]))
        delta = F.greatest(-x["k"], F.least(wish, max_rate * x["n"] - x["k"])).cast("bigint")
        moved = F.struct((a["rest"] - delta * x["size"]).alias("rest"), F.concat(a["moves"], F.array(F.struct(x["size"].alias("size"), delta.alias("delta")))).alias("moves"))
        return F.when(delta == 0, a).otherwise(moved)

    moves = sizes.select("key", F.explode(F.aggregate("cells", start, walk)["moves"]).alias("m")).select("key", "m.size", "m.delta")
    return c.join(moves, ["key", "size"], "left").select("key", "size", "n", (F.col("k") + F.coalesce(F.col("delta"), F.lit(0))).alias("copies"))


def _dealt(docs: DataFrame, source_col: str, text_col: str, id_col: str, weights: tuple[int, ...], share_percent: int, max_rate: int) -> DataFrame:
    one, two = _row_keys(id_col, text_col)
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("source"), F.size(words(F.col(f"`{text_col}`"))).cast("bigint").alias("size"), one.alias("__h"), two.alias("__h2"))
    base = table(base.withColumn("key", _key(F.col("source"))))
    cells = table(base.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    tilted = tilts(cells, targets(cells, weights, share_percent, max_rate), max_rate)
    dealt = copies_by_cell(cells, tilted, max_rate).join(tilted.select("key", "source_size", "target"), "key")
    dealt = table(dealt.select(F.col("key").alias("__k"), F.col("size").alias("__s"), "n", F.col("copies").alias("__c"), "source_size", "target"))
    # tables on both sides of the join, so that Spark may split a hot cell
    rows = table(base.join(dealt, (F.col("key") == F.col("__k")) & (F.col("size") == F.col("__s"))).drop("__k", "__s"))
    rows = numbered(rows, ["key", "size"], [F.col("__h"), F.col("__h2")], F.ceil(F.sqrt("n")), "__rank")
    got = F.floor(F.col("__c") / F.col("n")) + (F.col("__rank") < F.col("__c") % F.col("n")).cast("bigint")
    return rows.withColumn("copies", got.cast("bigint"))


def _row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows of different id or text apart; nulls count as values."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    parts = [i.isNull(), i.cast("string"), t.isNull(), t]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def copies(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_rate: int = MAX_RATE) -> DataFrame:
    """Rows id, size, source_size, target, taken, copies; one for each row of docs.

    size: words of the text; null and empty texts have 0 and count as documents of rate 1. Null sources are one
    source, the last. Within a cell of equal source and size the copies are dealt in the order of a hash of the id
    and the text, so reruns agree; repeated rows are interchangeable. An empty table gives no rows; other columns
    are not read.
    """
    rows = _dealt(docs, source_col, text_col, id_col, weights, share_percent, max_rate)
    return rows.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_rate: int = MAX_RATE) -> DataFrame:
    """The mixed corpus: each row of docs as often as copies() says, with the columns of docs.

    Texts move once, to meet their copies. Rows equal in id and text are of one cell, so their copies differ by one
    at most; which of them gets the one more does not matter. Nulls, empty texts and ties are as in copies(); columns
    of any name pass through unchanged.
    """
    rows = _dealt(docs, source_col, text_col, id_col, weights, share_percent, max_rate)
    each = rows.groupBy("__h", "__h2").agg(F.min("copies").alias("__low"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("__more")).where("__low > 0 or __more > 0")
    one, two = _row_keys(id_col, text_col)
    met = docs.select(packed(docs), one.alias("__h"), two.alias("__h2")).join(each, ["__h", "__h2"])
    place = F.row_number().over(Window.partitionBy("__h", "__h2").orderBy("__h"))
    met = met.withColumn("n", F.col("__low") + (place <= F.col("__more")).cast("bigint")).where("n > 0")
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
