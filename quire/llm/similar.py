"""Near-duplicates by SimHash and the exact similarity of word-shingle sets, then connected components.

Every set of shingles gets its SimHash, and the generalised pigeonhole of simhash.py gives the pairs of fingerprints that
differ in a few bits; these candidates are verified on the whole sets and linked first. At similarity 0.8 sixty-four bits
differ in about 10, with a deviation of 3, so that no bound with selective keys holds all similar pairs. The exact way for
the rest is a prefix filter over what these links leave apart.

Similarity is Jaccard's over the distinct shingles of a text. Two sets that reach it share so many shingles that, in
any common order, the first n - need + m shingles of both have m in common, for any m. The order is first that of the
hashes: a set with fewer than m shared ones there is set aside, and chance meetings with it. For the others the order is
rarity and m is 1, so that common shingles hardly ever make sets meet; and where two sets meet first, what comes after
in both must still be enough. Every pair that meets so and that could join two groups is verified on its whole sets:
nothing is sampled, and no pair at or above the similarity is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.components import components
from quire.llm.simhash import TAU, links, majority, one_of_each

SHINGLE, SIMILARITY = 5, 0.8
#: Up to this many rows (counted first; one or two longs each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Parts of a meeting that are put in order on their own.
PARTS = 64
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SHIFT = np.uint64(33)


def shingles(text: str | None, shingle: int = SHINGLE, seen: dict[bytes, int] | None = None) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; a shorter text is one shingle, one without words has none.

    seen: hashes of words met before, to which new ones are added.
    """
    seen = {} if seen is None else seen
    tokens = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    for w in tokens:
        if w not in seen:
            seen[w] = xxhash.xxh64_intdigest(w)
    words = np.fromiter((seen[w] for w in tokens), np.uint64, len(tokens))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + len(out)]) * _FACTOR
        out ^= out >> _SHIFT
    for m in _MIX:
        out = (out ^ (out >> _SHIFT)) * m
    return np.unique(out ^ (out >> _SHIFT))


def needed(n: int, similarity: float = SIMILARITY) -> int:
    """How many of its n shingles a set shares at least with any set that is so similar."""
    return int(np.ceil(similarity * n - 1e-9))


def _more(need: int) -> int:
    """Shingles to have in common in the order of the hashes; more of them set more texts aside and take longer prefixes."""
    return 1 + need // 8


def _map(docs: DataFrame, text_col: str, shingle: int, similarity: float, out: str, whole: bool) -> DataFrame:
    """The other columns, s (a hash of the shingle set), fp (its SimHash), n, need, least (how many of its first hashes any partner shares), and those, or all of them."""
    others = [c for c in docs.columns if c != text_col]
    narrow = docs.select(*others, text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), f"s bigint, fp bigint, n int, need int, least int, `{out}` array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                seen: dict[bytes, int] = {}
                sets = [shingles(v.as_py(), shingle, seen) for v in part.column(len(others))]
                n = [len(x) for x in sets]
                need = [needed(x, similarity) for x in n]
                s = np.array([xxhash.xxh3_64_intdigest(x.astype("<u8").tobytes()) for x in sets], np.uint64)
                fp = np.array([majority(x) for x in sets], np.uint64)
                parts = sets if whole else [x[: a - b + _more(b)] for x, a, b in zip(sets, n, need)]
                least = [_more(needed(b, similarity)) for b in need]  # a partner may be smaller, and its prefix shorter
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                values = pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))
                arrays = [*part.columns[:-1], pa.array(s.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(n, pa.int32()), pa.array(need, pa.int32()), pa.array(least, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), values)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*others, "s", "fp", "n", "need", "least", out])

    return narrow.mapInArrow(run, schema)


def _small(df: DataFrame) -> DataFrame:
    """df, a table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets are similar enough."""
    one = sets.select(F.col("s").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("s").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(one, "a").join(two, "b")
    return met.where((1 + similarity) * both >= similarity * (F.size("sa") + F.size("sb")) - 1e-9).select("a", "b")


def _meetings(sets: DataFrame) -> DataFrame:
    """Rows k, s, n, need, after: sets under those of their rarest n - need + 1 shingles that another set has, too.

    after: how many shingles of the set stand at k or later in the order.
    """
    each = sets.select("s", "n", "need", F.explode("shingles").alias("k"))
    often = each.groupBy("k").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("s")
    # shingles of this set alone come first in the order and meet nothing
    met = each.join(often, "k").withColumns({"shared": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy("df", "k"))})
    return met.where("place + (n - shared) <= n - need + 1").select("k", "s", "n", "need", (F.col("shared") - F.col("place") + 1).cast("int").alias("after"))


def simhash_pairs(marks: DataFrame, tau: int = TAU) -> DataFrame:
    """Pairs a, b of sets (s, fp; s is unique) that connect those whose fingerprints are within tau bits, step by step.

    Sets of one fingerprint are paired with its smallest, which stands for them in the links between fingerprints.
    """
    fps = table(marks.groupBy("fp").agg(F.min("s").alias("lead")))
    equal = marks.join(fps, "fp").where("s <> lead").select(F.col("s").alias("a"), F.col("lead").alias("b"))
    near = links(fps.select("fp"), tau).withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(fps.select(F.col("fp").alias("x"), F.col("lead").alias("a")), "x").join(fps.select(F.col("fp").alias("y"), F.col("lead").alias("b")), "y")
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _rooted(met: DataFrame, found: DataFrame) -> DataFrame:
    """met, a table, with the component of each s by these links."""
    return table(met.join(components(found), F.col("s") == F.col("node"), "left").select("k", "s", "n", "need", "after", F.coalesce("root", "s").alias("root")))


def similar_links(sets: DataFrame, candidates: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges a, b over sets (s, n, need, shingles; s is unique) whose components are those of all similar pairs.

    The candidates (a, b) are verified first. Of the sets that meet and that these links leave apart, each is compared
    with the smallest and the next smaller of its meeting; then every pair that meets and is still apart. In each
    meeting the members of its largest group need no pairs among them.
    """
    near = table(_verified(candidates, sets, similarity))
    met = _rooted(table(_meetings(sets)), near)
    # neighbours within a part of a meeting, so that a large one is ordered by many tasks
    run = Window.partitionBy("k", "part").orderBy("n", "s")
    least = table(met.groupBy("k").agg(F.min(F.struct("n", "s", "root")).alias("first")))
    beside = met.withColumn("part", F.pmod(F.xxhash64("s"), F.lit(PARTS))).withColumn("before", F.lag(F.struct("n", "s", "root")).over(run))
    beside = beside.join(least, "k").select(F.col("s").alias("a"), "root", F.explode(F.array("first", "before")).alias("x"))
    beside = beside.where("root <> x.root").select("a", F.col("x.s").alias("b")).distinct()
    found = table(near.unionByName(_verified(beside, sets, similarity)))

    placed = _rooted(met.drop("root"), found)
    groups = placed.groupBy("k", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = groups.groupBy("k").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("g")).where("g > 1")
    mixed = placed.join(table(largest), "k")
    a = mixed.where("root <> top").select("k", F.col("s").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("need").alias("da"), F.col("after").alias("fa"))
    b = mixed.select("k", F.col("s").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("need").alias("db"), F.col("after").alias("fb"))
    # at the first shingle in common, what follows it in both bounds what they share
    enough = (1 + similarity) * F.least("fa", "fb") >= similarity * (F.col("na") + F.col("nb")) - 1e-9
    left = a.join(b, "k").where("ra <> rb and na >= db and nb >= da").where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.unionByName(_verified(left, sets, similarity))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tau: int = TAU) -> DataFrame:
    """docs with one row of each group of similar texts: the smallest id (null last), then the smallest hash of its text.

    Groups are the connected components of all pairs of texts whose shingle sets have at least that Jaccard similarity;
    pairs whose SimHashes are within tau bits are linked first, and tau does not change the groups; texts without a word are similar to each other only. Texts move once, to meet the verdicts; rows equal in id and
    text are interchangeable and one of them stays. Columns of any name pass through unchanged; an empty table gives
    no rows.
    """
    keys = [F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`")]
    one, two = F.xxhash64(*keys), F.xxhash64(F.lit("second"), *keys)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), one.alias("h"), two.alias("h2"), F.col(f"`{text_col}`").alias("text"))
    rows = table(_map(narrow, "text", shingle, similarity, "keys", False))
    first = table(rows.groupBy("s").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "h2")).alias("first"), F.first("fp").alias("fp")))

    # sets with too few shared shingles in the order of the hashes are similar to none
    each = rows.select("s", "least", F.explode("keys").alias("k"))
    shared = _small(table(each.groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("k")))
    meet = each.join(shared, "k").groupBy("s", "least").agg(F.count(F.lit(1)).alias("c")).where("c >= least").select("s")
    wanted = _small(table(first.join(meet, "s").select(F.col("first.h").alias("__h"), F.col("first.h2").alias("__h2"))))
    again = narrow.join(wanted, (F.col("h") == F.col("__h")) & (F.col("h2") == F.col("__h2")), "left_semi").select("text")
    sets = _map(again, "text", shingle, similarity, "shingles", True)
    sets = table(sets.groupBy("s").agg(F.first("n").alias("n"), F.first("need").alias("need"), F.first("shingles").alias("shingles")))

    roots = components(similar_links(sets, simhash_pairs(first.select("s", "fp"), tau), similarity))
    named = first.join(roots, F.col("s") == F.col("node"), "left").select(F.coalesce("root", "s").alias("root"), "first")
    winners = named.groupBy("root").agg(F.min("first").alias("first")).select("first.h", "first.h2")
    return one_of_each(docs, one, two, winners)
