"""Balanced label propagation over linked documents, in DataFrame functions only.

Documents that share a link key (equal texts, unless told otherwise) are linked. A link key acts as a hub between its
documents, so no pairs are listed. In each round the hubs elect a shard from where their documents are, the documents
ask to move there, and every shard accepts as many as its quota holds: its own linked documents first, then linked
newcomers, then unlinked ones. Those left over fill the shards that have room. Quotas hold exactly after each round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hash2, numbered, small, table

SHARDS, ROUNDS, ROWS_A_SORT = 16, 4, 20_000
#: Up to this many links, counted first, their elections are broadcast; more are joined by shuffle.
BROADCAST_LINKS = 200_000


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1_000_003)) / 1_000_003.0


def _choose(counts: list[int], row: Column) -> Column:
    """The shard whose interval of running counts holds the row number."""
    out, end = F.lit(None).cast("int"), sum(counts)
    for shard in reversed(range(len(counts))):
        out = F.when(row < end, F.lit(shard)).otherwise(out)
        end -= counts[shard]
    return out


def _place(wishes: DataFrame, quotas: list[int], total: int) -> DataFrame:
    """wishes has row key columns, want, rank_class; adds shard with exactly quotas[s] rows for each s."""
    parts = F.lit(max(1, total // (len(quotas) * ROWS_A_SORT)))
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("want") + 1)
    # whole groups stand together: the part of the order that leads is the class and a slice of the link hash
    lead = [F.col("rank_class"), F.pmod(F.col("link"), F.lit(64))]
    ranked = table(numbered(wishes, ["want"], [F.col("link"), F.col("row_hash"), F.col("row_hash2")], parts, "__r", lead).withColumn("__in", F.col("__r") < quota).drop("__r", "__n"))
    full = {r["want"]: r["n"] for r in ranked.where("__in").groupBy("want").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    room = [q - full.get(s, 0) for s, q in enumerate(quotas)]
    stay = ranked.where("__in").withColumn("shard", F.col("want"))
    # those left over go on in the order of their links, so that a link's rows fill one shard's room before the next
    slices = [~F.col("linked"), F.pmod(F.col("link"), F.lit(1024))]
    rest = numbered(ranked.where(~F.col("__in")).withColumn("__all", F.lit(0)), ["__all"], [F.col("link"), F.col("row_hash"), F.col("row_hash2")], F.lit(math.isqrt(total // 1024) + 1), "__r", slices)
    moved = rest.withColumn("shard", _choose(room, F.col("__r")))
    names = [c for c in wishes.columns if c not in ("want", "rank_class")]
    out = table(stay.select(*names, "shard").unionByName(moved.select(*names, "shard")))
    return out


def propagate(nodes: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes: link (bigint), linked (boolean), row_hash, row_hash2, payload columns. Adds shard, counts at most one apart.

    A link with more documents than a quota asks for as many shards as it fills, the ones where it already has most.
    """
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    cap = max(1, total // shards)
    start = nodes.withColumns({"want": F.pmod(F.col("row_hash"), F.lit(shards)).cast("int"), "rank_class": F.lit(0)})
    placed = _place(start, quotas, total)
    for _ in range(rounds):
        held = placed.where("linked").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        tally = held.groupBy("link").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), _uniform(F.col("link"), F.col("shard")).alias("u"), F.col("shard").alias("shard")))).alias("order"),
            F.ceil(F.sum("n") / F.lit(cap)).cast("int").alias("k"),
        )
        # a link may want more shards than it is in so far; the rest follow in turn
        all_shards = F.array(*[F.lit(s) for s in range(shards)])
        order = F.transform("order", lambda x: x["shard"])
        order = F.concat(order, F.array_except(all_shards, order))
        elected = tally.select(F.col("link").alias("__link"), F.slice(order, F.lit(1), F.greatest(F.lit(1), F.least(F.col("k"), F.lit(shards)))).alias("__shards"))
        asked = placed.join(small(table(elected), BROADCAST_LINKS), F.col("linked") & (F.col("link") == F.col("__link")), "left")
        spread = F.get("__shards", F.floor(_uniform(F.col("row_hash"), F.lit("spread")) * F.size("__shards")).cast("int"))
        want = F.when(F.col("__shards").isNull() | F.array_contains("__shards", F.col("shard")), F.col("shard")).otherwise(spread)
        asked = asked.withColumn("want", want.cast("int"))
        rank = F.when(~F.col("linked"), F.lit(2)).when(F.col("want") == F.col("shard"), F.lit(0)).otherwise(F.lit(1))
        asked = table(asked.withColumn("rank_class", rank).drop("__link", "__shards"))
        if asked.where("want <> shard").isEmpty():
            break
        placed = _place(asked.drop("shard"), quotas, total)
    return placed


def propagate_graph(nodes: DataFrame, links: DataFrame, total: int, shards: int = SHARDS, rounds: int = 8) -> DataFrame:
    """propagate() for documents with any number of link keys: links has a row (row_hash, row_hash2, link) for each.

    Documents under one key are neighbours. Each round counts, for every document, its neighbours by shard, through the
    keys' counts and never by pairs; half of the documents, in turn, ask for the shard where most of theirs are, if that
    is more than where they are now. nodes: row_hash, row_hash2 and payload columns; keys are not null. Repeated links
    count once; links of documents that nodes lack are left out; a document without a link stays where it is put.
    Repeated nodes are documents of their own, each with all the links of its key. It ends when nothing wants to move,
    or after `rounds` rounds: balanced then, too, but not settled. Empty nodes give no rows, empty links a placement by
    hash.
    """
    row, names = ["row_hash", "row_hash2"], [f"at{s}" for s in range(shards)]
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    links = table(links.select(*row, "link").distinct())
    first = table(links.groupBy(*row).agg(F.min("link").alias("link")))
    start = nodes.join(first, row, "left").withColumn("linked", F.col("link").isNotNull()).withColumn("link", F.coalesce("link", F.col("row_hash")))
    placed = _place(start.withColumns({"want": F.pmod(F.col("row_hash"), F.lit(shards)).cast("int"), "rank_class": F.lit(0)}), quotas, total)
    for turn in range(rounds):
        at = table(links.join(placed.select(*row, "shard"), row))
        tally = table(at.groupBy("link").agg(*[F.count_if(F.col("shard") == s).alias(n) for s, n in enumerate(names)]))
        # equal nodes of one shard have the same neighbours and vote once
        votes = at.distinct().join(tally, "link").groupBy(*row, "shard").agg(*[F.sum(F.col(n) - (F.col("shard") == s).cast("bigint")).alias(n) for s, n in enumerate(names)])
        asked = placed.join(votes, [*row, "shard"], "left")
        best = F.array_max(F.array(*[F.struct(F.col(n).alias("n"), _uniform(F.col("row_hash"), F.lit(s)).alias("u"), F.lit(s).alias("s")) for s, n in enumerate(names)]))
        now = F.get(F.array(*names), F.col("shard"))
        moves = F.col("linked") & (best["n"] > now) & (F.pmod(F.xxhash64("row_hash2", F.lit(turn // 2)), F.lit(2)) == turn % 2)
        asked = asked.withColumn("want", F.when(moves, best["s"]).otherwise(F.col("shard")).cast("int"))
        # who has more neighbours where it wants to be stands before who has fewer
        has = F.get(F.array(*names), F.col("want"))
        rank = F.when(~F.col("linked"), F.lit(9)).otherwise(F.lit(8) - F.least(F.coalesce(has, F.lit(0)), F.lit(8))).cast("int")
        asked = table(asked.withColumn("rank_class", rank).drop(*names))
        if turn % 2 and asked.where("want <> shard").isEmpty():
            break
        placed = _place(asked.drop("shard"), quotas, total)
    return placed


def cut(placed: DataFrame, links: DataFrame) -> int:
    """How many (document, link) incidences are cut: those outside the shard where their link has most of its documents.

    Repeated links count once, repeated documents each; null keys meet nothing; empty tables give 0.
    """
    at = links.select("row_hash", "row_hash2", "link").distinct().join(placed.select("row_hash", "row_hash2", "shard"), ["row_hash", "row_hash2"])
    held = at.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("link").agg((F.sum("n") - F.max("n")).alias("cut"))
    return held.agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("cut")).first()["cut"]


def shards(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, size, text_crc32, law, shard, slot, grown_shard, copies; one for each row of docs.

    The law is `rows`: counts at most one apart, equal texts together as far as the quotas allow. Null texts are one
    group, apart from empty ones, with size 1 and CRC-32 0. A group larger than a quota fills as many shards as it
    needs. Repeated rows are interchangeable; an empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col)
    keys = [F.col(id_col).isNull(), F.col(id_col).cast("string"), text.isNull(), text]
    base = table(docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("link"), hash2(text).alias("link2"),
        F.xxhash64(*keys).alias("row_hash"), F.xxhash64(F.lit("second"), *keys).alias("row_hash2"),
    ))
    total = base.count()
    groups = small(table(base.groupBy("link", "link2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("link").alias("__l"), F.col("link2").alias("__l2"), F.col("n").alias("copies"))), BROADCAST_LINKS)
    nodes = base.join(groups, (F.col("link") == F.col("__l")) & (F.col("link2") == F.col("__l2")), "left")
    nodes = nodes.withColumn("linked", F.col("copies").isNotNull()).withColumn("copies", F.coalesce("copies", F.lit(1)).cast("bigint")).drop("__l", "__l2", "link2")
    placed = propagate(nodes, total, n_shards, rounds)
    parts = F.lit(math.isqrt(total // n_shards) + 1)
    out = numbered(placed, ["shard"], [F.col("row_hash"), F.col("row_hash2")], parts, "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "copies")
