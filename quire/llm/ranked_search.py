"""Ranked lexical search by pipelined term partitioning.

Terms have owners; an owner is a stage of the pipeline, the rarest terms first. A bundle is a set of items before one
block of documents. It travels from owner to owner by cogroup and carries, for each of its items, a sparse list of
documents and integer scores, to which every owner adds what its terms contribute. The last owner keeps the best
documents of each item and block. A block has a bounded number of documents and a bundle a bounded number of items, so
a common term's postings are spread over all blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import slices, small, table

#: Documents of a block, items of a bundle, stages of the pipeline.
BLOCK_DOCS, BUNDLE_ITEMS, OWNERS = 4096, 256, 4
#: Item terms that may be broadcast; more are met by shuffle.
BROADCAST_TERMS = 500_000
#: ASCII that is no digit and no letter ends a term; capital ASCII letters become small ones. Everything else stays.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: What a bundle carries: its terms, and for each item a list of documents and their scores so far.
CARRIED = pa.schema([
    ("bundle", pa.int32()), ("block", pa.int32()), ("iid", pa.int64()),
    ("terms", pa.list_(pa.field("element", pa.struct([("owner", pa.int32()), ("term", pa.int64()), ("times", pa.int64())])))),
    ("docs", pa.list_(pa.field("element", pa.int64()))), ("scores", pa.list_(pa.field("element", pa.int64()))),
])


def counted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows id, n (terms with repeats), terms, tfs (the distinct terms and how often each occurs); null texts have none. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found = [Counter((t or "").encode().translate(TERM_BYTES).split()) for t in batch.column(1).to_pylist()]
            at = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            terms = pa.array([t.decode() for c in found for t in c], pa.string())
            tfs = pa.array([n for c in found for n in c.values()], pa.int64())
            n = pa.array([c.total() for c in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, tfs)], names=["id", "n", "terms", "tfs"])

    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema[0].dataType.simpleString()}, n bigint, terms array<string>, tfs array<bigint>")


def weight(df: Column, n_docs: int) -> Column:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))), in doubles."""
    return F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("bigint")


def owners(freqs: DataFrame, n_owners: int) -> Column:
    """The stage of a term by its column df: cuts between powers of two that share the postings out, rare terms first."""
    by_power = freqs.groupBy(F.floor(F.log2("df")).cast("int").alias("p")).agg(F.sum("df").alias("n")).orderBy("p").collect()
    total, run, owner, power = sum(r["n"] for r in by_power), 0, F.lit(0), F.floor(F.log2("df")).cast("int")
    for r in by_power:
        owner = F.when(power >= r["p"], F.lit(min(n_owners - 1, n_owners * run // max(total, 1)))).otherwise(owner)
        run += r["n"]
    return owner


def _stage(owner: int, last: bool, k: int):
    """What an owner does with one bundle and its own postings of one block."""
    empty = pa.array([], pa.int64())

    def add(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        bundle, postings = bundle.combine_chunks(), postings.combine_chunks()
        term, rid = postings.column("term").to_numpy(), postings.column("rid").to_numpy()
        gain = postings.column("gain").to_numpy()
        head = term < 0  # one row for each document of the block
        rows = np.sort(rid[head])
        n_items = bundle.num_rows
        score = np.zeros((n_items, len(rows)), np.int64)
        lists = bundle.column("docs").chunk(0) if n_items else pa.ListArray.from_arrays(pa.array([0], pa.int32()), empty)
        carried = lists.flatten().to_numpy()
        if len(carried):
            item = np.repeat(np.arange(n_items), np.diff(lists.offsets.to_numpy()))
            score[item, np.searchsorted(rows, carried)] = bundle.column("scores").chunk(0).flatten().to_numpy()
        order = np.argsort(term[~head], kind="stable")
        own, at, adds = term[~head][order], np.searchsorted(rows, rid[~head][order]), gain[~head][order]
        ids, first = np.unique(own, return_index=True)
        span = {t: slice(a, b) for t, a, b in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(own)])}
        for i, terms in enumerate(bundle.column("terms").to_pylist()):
            for t in terms:
                if t["owner"] == owner and (s := span.get(t["term"])):
                    score[i, at[s]] += t["times"] * adds[s]
        if last:
            ids = postings.column("doc").chunk(0).filter(pa.array(head)).take(pa.array(np.argsort(rid[head], kind="stable")))
            place = np.empty(len(rows), np.int64)  # documents of equal score go by id, null last
            place[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(rows))
            picked = []
            for i in range(n_items):
                hits = np.flatnonzero(score[i])
                picked.append(hits[np.lexsort((place[hits], -score[i, hits]))[:k]])
            sizes, docs = [len(p) for p in picked], np.concatenate([np.empty(0, np.int64), *picked]).astype(np.int64)
            item = np.repeat(np.arange(n_items), sizes)
            return pa.table([bundle.column("iid").take(pa.array(item)), ids.take(pa.array(docs)), pa.array(score[item, docs])], names=["iid", "doc", "score"])
        item, docs = np.nonzero(score)
        offsets = pa.array(np.searchsorted(item, np.arange(n_items + 1)), pa.int32())
        made = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (rows[docs], score[item, docs])]
        return pa.table([*[bundle.column(c) for c in ("bundle", "block", "iid", "terms")], *made], names=CARRIED.names).cast(CARRIED)

    return add


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text", n_owners: int = OWNERS, block_docs: int = BLOCK_DOCS, bundle_items: int = BUNDLE_ITEMS) -> DataFrame:
    """Rows item, rank (from 1), document id, score: the k best documents of each item, all that score above 0 if fewer.

    Every row of items is an item and every row of docs a document, repeated rows and null ids included; null and
    empty texts have no terms, so such an item finds nothing and such a document is not found. Equal scores go by
    ascending id, null last; equal rows share the ranks between them. Empty tables give no rows; other columns are not
    read. The documents' texts are read once and not shuffled; what moves is the postings of the items' terms, once,
    and the bundles, once for each owner but the first.
    """
    asked = table(counted(items, item_col, query_col).withColumn("iid", F.monotonically_increasing_id()))
    each = asked.select("iid", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("iid", F.col("t.terms").alias("word"), F.col("t.tfs").alias("times"))
    words = each.select("word").distinct()
    # a row with a null word stands for the document itself
    rows = counted(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    pairs = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).cast("bigint").alias("tf"))), F.arrays_zip(F.col("terms").alias("word"), F.col("tfs").alias("tf")))
    spread = rows.select("rid", "id", "n", F.explode(pairs).alias("p")).select("rid", "id", "n", "p.word", "p.tf")
    wanted = words.select("word", F.lit(True).alias("hit"))
    held = table(spread.join(small(wanted, BROADCAST_TERMS), "word", "left").where(F.col("hit") | F.col("word").isNull()).select("rid", F.when(F.col("word").isNull(), F.col("id")).alias("doc"), "n", "word", "tf"))
    total = held.where("word is null").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms, blocks = total["n"], max(total["l"], 1), max(1, -(-total["rows"] // block_docs))

    freqs = held.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    freqs = table(freqs.withColumn("term", F.monotonically_increasing_id()))
    known = table(freqs.select("word", "term", weight(F.col("df"), n_docs).alias("w"), owners(freqs, n_owners).alias("owner")))
    m = F.lit(100 - 75) + F.expr(f"(75 * n * {n_docs}L) div {n_terms}L")
    gain = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 8 * m)")
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    bundle = F.pmod(F.xxhash64("iid"), F.lit(max(1, -(-asked.count() // bundle_items)))).cast("int")
    posted = held.join(small(known, BROADCAST_TERMS), "word", "left").withColumn("m", m)
    posted = posted.select(block.alias("block"), "rid", "doc", F.coalesce("term", F.lit(-1)).alias("term"), F.coalesce(gain, F.lit(0)).alias("gain"), "owner")
    n_bundles = F.sequence(F.lit(0), F.lit(max(0, -(-asked.count() // bundle_items) - 1)))

    terms = each.join(small(known, BROADCAST_TERMS), "word").groupBy("iid").agg(F.collect_list(F.struct("owner", "term", "times")).alias("terms"))
    none = F.array().cast("array<bigint>")
    state = terms.select(bundle.alias("bundle"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "iid", "terms", none.alias("docs"), none.alias("scores"))
    kind = held.schema["doc"].dataType.simpleString()
    carried = "bundle int, block int, iid bigint, terms array<struct<owner:int,term:bigint,times:bigint>>, docs array<bigint>, scores array<bigint>"
    for owner in range(n_owners):
        last = owner == n_owners - 1
        own = posted.where((F.col("owner") == owner) | F.col("owner").isNull()).drop("owner").withColumn("bundle", F.explode(n_bundles))
        state = state.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block")).applyInArrow(_stage(owner, last, k), f"iid bigint, doc {kind}, score bigint" if last else carried)
    # the best of each block meet; only k rows of an item and block are left
    order = Window.partitionBy("iid").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select("iid", F.col("id").alias("item"))
    return best.join(names, "iid").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col if id_col != item_col else f"{id_col}_"), "score")
