"""SimHash near-duplicates: generalised pigeonhole over bit partitions, then connected components.

A pair of fingerprints within tau bits has some partition i in which it differs by at most t_i bits, whenever the
thresholds satisfy sum(t_i + 1) = tau + 1; a threshold of -1 leaves a partition out. Bits that go together are put
into the same partition, so that skew gathers where a low threshold can answer it; dynamic programming then gives
each partition the threshold that keeps keys and estimated candidates fewest. Fingerprints meet under the value of a
partition with t_i of its bits masked out, in every way; each meeting is verified, and only a spanning forest of the
verified links is kept, so a large group of near copies yields as many rows as it has members.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import free_name, packed, slices, table
from quire.llm.components import components

SHINGLE, SEED, TAU = 4, 42, 4
PARTS = (1, 2, 3, 4, 5)
#: What a candidate costs to verify, against what a key costs to shuffle and sort.
CANDIDATE_COST = 0.1
SMALL_GROUP = 48
#: More fingerprints under one key are compared block by block, each two blocks in a group of their own.
BLOCK = 1 << 13
#: No fingerprint is put under more keys of one partition than this.
MAX_KEYS = 5_000
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64; no words: 0."""
    tokens = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - shingle + 1)
    begin, end = starts[:n].tolist(), ends[min(shingle, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, end)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes: bit i is set if it is set in over half of them; 0 for none."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _SLICE):
        counts += np.unpackbits(hashes[i : i + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs without the text and with the fingerprint as a signed bigint. No shuffle; a slice of texts at a time.

    Null, empty and blank texts have 0; a column of the name `out` is kept, and the fingerprint gets the name with
    underscores after it; repeated rows keep their rows, an empty table gives none.
    """
    others = [c for c in docs.columns if c != text_col]
    out = free_name(out, others)
    narrow = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found = np.fromiter((fingerprint(v.as_py(), shingle) for v in batch.column(len(others))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*others, out])

    return narrow.mapInArrow(run, schema)


def bit_statistics(fps: DataFrame) -> tuple[np.ndarray, int]:
    """For each two bits, how many fingerprints have both; and the number of fingerprints. 64 x 64 sums of all data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column(0)).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            sums += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(sums.ravel(), n))], names=["i", "n"])

    rows = fps.select("fp").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()  # 4097 rows at any size
    flat = np.zeros(4097, np.int64)
    for r in rows:
        flat[r["i"]] = r["n"]
    return flat[:4096].reshape(64, 64), int(flat[4096])


def partition_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Greedy groups of correlated bits, of sizes as equal as can be."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    corr = np.abs(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        group = [max(left, key=lambda b: (round(corr[b, left].sum(), 9), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (round(corr[b, group].sum(), 9), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def within(both: np.ndarray, n: int, bits: list[int], tau: int, exact: float | None = None) -> list[float]:
    """Estimated share of pairs that differ by at most t of the bits, for t = 0..tau.

    Bits count as independent; where the share of equal pairs is known exactly, the estimate is scaled to it.
    """
    p = np.diag(both)[bits] / max(n, 1)
    differ = 2 * p * (1 - p)
    dist = np.zeros(tau + 2)
    dist[0] = 1
    for d in differ:
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    share = np.cumsum(dist)[: tau + 1]
    if exact is not None and share[0] > 0:
        share = np.minimum(1, share * max(1, exact / share[0]))
    return share.tolist()


def allocate(widths: list[int], shares: list[list[float]], n: int, tau: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with sum(t + 1) = tau + 1, by dynamic programming over the partitions."""

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        keys = math.comb(widths[i], t)
        return max(n, 1) * keys + CANDIDATE_COST * n * n / 2 * shares[i][t] if keys <= MAX_KEYS else float("inf")

    best = {0: (0.0, [])}
    for i in range(len(widths)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, tau - used + 1):
                new = (c + cost(i, t), [*ts, t])
                if used + t + 1 not in step or new < step[used + t + 1]:
                    step[used + t + 1] = new
        best = step
    return best[tau + 1]


def plan(fps: DataFrame, tau: int = TAU) -> tuple[list[list[int]], list[int]]:
    """Bit partitions and thresholds for these fingerprints; statistics cover all of them."""
    both, n = bit_statistics(fps)
    options = []
    for m in PARTS:
        groups = partition_bits(both, n, m)
        options.append((allocate([len(g) for g in groups], [within(both, n, g, tau) for g in groups], n, tau)[0], groups))
    groups = min(options)[1]
    values = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _pick(g).alias("v")) for i, g in enumerate(groups)])).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    equal = {r["i"]: r["e"] for r in values.groupBy("i").agg((F.sum(F.col("n").cast("double") * F.col("n"))).alias("e")).collect()}  # a row a partition
    shares = [within(both, n, g, tau, equal.get(i, 0) / max(1, n * n)) for i, g in enumerate(groups)]
    return groups, allocate([len(g) for g in groups], shares, n, tau)[1]


def _pick(bits: list[int]):
    """The fingerprint with all other bits cleared."""
    return F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(keys: np.ndarray, fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that connect, within each run of equal keys, all fingerprints that links connect."""
    n = len(keys)
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if n else np.array([], int)
    sizes = np.diff(np.append(starts, n))
    size_at = np.repeat(sizes, sizes)
    end_at = np.repeat(starts + sizes, sizes)
    a, b = [], []
    small = np.flatnonzero((size_at > 1) & (size_at <= SMALL_GROUP))
    for d in range(1, SMALL_GROUP):
        small = small[small + d < end_at[small]]
        if not len(small):
            break
        hit = small[np.bitwise_count(fps[small] ^ fps[small + d]) <= tau]
        a.append(fps[hit])
        b.append(fps[hit + d])
    for s, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        rest = fps[s : s + size]
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                near = np.bitwise_count(rest ^ at) <= tau
                if near.any():
                    found = rest[near]
                    a.append(np.full(len(found), at))
                    b.append(found)
                    queue.extend(found)
                    rest = rest[~near]
    if not a:
        return np.array([], np.uint64), np.array([], np.uint64)
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """Edges a, b over distinct fingerprints (column fp) whose components are those of all pairs within tau bits."""
    groups, thresholds = plan(fps, tau)
    # one constant of all masks: an expression for each would be a plan of thousands of them
    probes = [f"({i * 65536 + k},{_signed(sum(1 << b for b in bits if b not in masked))}L)" for i, (bits, t) in enumerate(zip(groups, thresholds)) if t >= 0 for k, masked in enumerate(itertools.combinations(bits, t))]
    keyed = fps.select("fp", F.explode(F.expr(f"array({','.join('struct' + p for p in probes)})")).alias("x")).select("fp", F.col("x.col1").alias("p"), F.col("fp").bitwiseAND(F.col("x.col2")).alias("v"))
    large = table(keyed.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
    keyed = keyed.join(large, ["p", "v"], "left")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks.cast("bigint")).cast("int")
    # a block meets itself and each other one
    met = keyed.withColumns({"blocks": blocks, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("fp", "p", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = met.repartition("p", "v", "i", "j").sortWithinPartitions("p", "v", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> pa.RecordBatch:
            a, b = forest(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]), tau)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(1, 5)], axis=1)
            f = np.asarray(batch.column(0)).view(np.uint64)
            if held and (held[-1][0][-1] != k[0]).any():
                yield joined()
                held.clear()
            ends = np.flatnonzero((k != k[-1]).any(axis=1))  # the last run may go on
            if len(ends):
                held.append((k[: ends[-1] + 1], f[: ends[-1] + 1]))
                yield joined()
                held.clear()
                k, f = k[ends[-1] + 1 :], f[ends[-1] + 1 :]
            held.append((k, f))
        if held:
            yield joined()

    return met.mapInArrow(run, "a bigint, b bigint")


def group_fingerprints(rows: DataFrame, tau: int = TAU) -> DataFrame:
    """Rows fp, root for the distinct fingerprints of rows: root names the component."""
    fps = table(rows.select("fp").distinct())
    parts = components(links(fps, tau))
    return fps.join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, shingle: int = SHINGLE) -> DataFrame:
    """Rows id, fingerprint (16 hex digits), component_id; one for each row of docs.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. component_id is the smallest id
    that links reach; null ids belong to components but do not name them, unless no other does. Repeated rows keep
    their rows; an empty table gives none; other columns are not read.
    """
    rows = table(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text"))
    roots = group_fingerprints(rows, tau)
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    named = table(roots.join(least, "fp"))
    names = table(named.groupBy("root").agg(F.min("least").alias("component_id")))  # a table, so that Spark may split the join
    by_fp = named.join(names, "root").select(F.col("fp").alias("__fp"), "component_id")
    out = rows.join(by_fp, F.col("fp") == F.col("__fp"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest id (null last), then the smallest hash of its text.

    Texts move once, to meet the verdicts; rows equal in id and text are interchangeable and one of them stays. Null,
    empty and blank texts are one group; columns of any name pass through unchanged; an empty table gives no rows.
    """
    keys = [F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`")]
    one, two = F.xxhash64(*keys), F.xxhash64(F.lit("second"), *keys)
    rows = table(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), one.alias("h"), two.alias("h2"), F.col(f"`{text_col}`").alias("text")), "text", shingle=shingle))
    roots = group_fingerprints(rows, tau)
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "h2")).alias("first"))
    winners = roots.join(first, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.h", "first.h2")
    return one_of_each(docs, one, two, winners)


def one_of_each(docs: DataFrame, one: Column, two: Column, winners: DataFrame) -> DataFrame:
    """One row of docs for each pair of row keys in winners (h, h2), with the columns of docs."""
    met = docs.select(packed(docs), one.alias("h"), two.alias("h2")).join(winners, ["h", "h2"], "left_semi")
    single = met.withColumn("n", F.row_number().over(Window.partitionBy("h", "h2").orderBy("h"))).where("n = 1")
    return single.select("row.*")
