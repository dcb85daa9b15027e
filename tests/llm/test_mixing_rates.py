"""The dual of the mix against bisection, on sizes of every order and targets of every share."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from quire.llm import mixing  # noqa: E402


def by_bisection(cells, target):
    """Tokens at the tilt that meets the target, by halving lambda / scale on a log axis of both signs."""
    tokens = lambda lam: sum(n * s * min(2.0, math.exp(min(lam * s, 700.0))) for s, n in cells)
    lo, hi = -1e4, 1e4
    for _ in range(400):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tokens(mid) < target else (lo, mid)
    return lo


def sources():
    rng = random.Random(8)
    out = [([(20_000, 50), (20, 500)], 1.999), ([(1_000_000, 1), (1, 10_000)], 1.5), ([(1_000_000, 1), (1, 10_000)], 1.999), ([(1_000_000, 1), (1, 10_000)], 0.001), ([(7, 3)], 0.01), ([(7, 3)], 1.0), ([(1, 1)], 1.999999)]
    for _ in range(40):
        cells = {int(10 ** rng.uniform(0, 6)): rng.randint(1, 10 ** rng.randint(0, 5)) for _ in range(rng.randint(1, 40))}
        out.append((sorted(cells.items()), rng.choice([0.01, 0.2, 0.9, 1.0, 1.1, 1.5, 1.9, 1.99, 1.999, rng.uniform(0.01, 1.999)])))
    return out


@pytest.fixture(scope="module")
def solved(spark):
    made = sources()
    cells = spark.createDataFrame([(f"s{i}", f"{i}", s, n) for i, (c, _) in enumerate(made) for s, n in c], "key string, source string, size bigint, n bigint").cache()
    wanted = spark.createDataFrame([(f"s{i}", f"{i}", sum(s * n for s, n in c), share * sum(s * n for s, n in c)) for i, (c, share) in enumerate(made)], "key string, source string, source_size bigint, target double")
    tilted = mixing.table(mixing.tilts(cells, wanted))
    return made, tilted, mixing.copies_by_cell(cells, tilted).collect()


def test_every_target_is_met(solved):
    made, tilted, _ = solved
    for r in tilted.collect():
        cells, share = made[int(r["source"])]
        lam = r["lam"] / r["scale"]
        got = sum(n * s * min(2.0, math.exp(min(lam * s, 700.0))) for s, n in cells)
        assert got == pytest.approx(r["target"], rel=1e-4), (r, share)
        want = by_bisection(cells, r["target"])
        for s, _ in cells:
            assert min(2.0, math.exp(min(lam * s, 700.0))) == pytest.approx(min(2.0, math.exp(min(want * s, 700.0))), rel=1e-3, abs=1e-6)


def test_copies_come_near(solved):
    made, _, copies = solved
    taken = defaultdict(int)
    for r in copies:
        assert 0 <= r["copies"] <= 2 * r["n"]
        taken[int(r["key"][1:])] += r["copies"] * r["size"]
    for i, (cells, share) in enumerate(made):
        assert abs(taken[i] - share * sum(s * n for s, n in cells)) <= max(s for s, _ in cells) / 2 + 1, (i, made[i], taken[i])


def test_documents_of_the_probes(spark):
    rows = [(i, "w " * n, s, n) for i, (s, n) in enumerate([("a", 20_000)] * 50 + [("a", 20)] * 500 + [("b", 100)] * 7_810)]
    docs = spark.createDataFrame([(i, s, n) for i, _, s, n in rows], "doc_id bigint, source string, n int").withColumn("text", F.expr("repeat('w ', n)"))
    got = mixing.copies(docs).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert len(got) == 2
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 10_000 and r["most"] <= 2
