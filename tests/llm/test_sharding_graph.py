"""What sharding cuts, and graphs with repeated rows and empty tables."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from quire.llm import queries, sharding  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_the_query_cuts_fewer_groups_than_a_hash(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    shard = {r["doc_id"]: r["shard"] for r in queries.op2_sharding(spark, DIR).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"]].append(r["doc_id"])
    cut = lambda at: sum(len(g) - max(Counter(at(i) for i in g).values()) for g in groups.values())
    assert cut(shard.get) == 0  # no group of this table is larger than a shard
    counts = Counter(shard.values())
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    assert cut(lambda i: hash((i, 1)) % 16) >= cut(shard.get)


def test_graphs_with_repeated_rows_and_none(spark):
    rng = random.Random(2)
    data = [(i, i * 7) for i in range(60)] + [(5, 35)] * 9 + [(6, 42)] * 3
    nodes = spark.createDataFrame(data, "row_hash bigint, row_hash2 bigint")
    links = spark.createDataFrame([(i, i * 7, i // 6) for i in range(60)] * 2 + [(i, i * 7, 100 + rng.randint(0, 5)) for i in range(60)] + [(999, 999, 1)], "row_hash bigint, row_hash2 bigint, link bigint")
    placed = sharding.propagate_graph(nodes, links, len(data), 4)
    got = placed.collect()
    assert Counter((r["row_hash"], r["row_hash2"]) for r in got) == Counter(data)
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 4 and max(counts.values()) - min(counts.values()) <= 1
    by_hash = nodes.withColumn("shard", F.pmod(F.xxhash64("row_hash"), F.lit(4)))
    assert sharding.cut(placed, links) < sharding.cut(by_hash, links)
    alone = sharding.propagate_graph(nodes, links.limit(0), len(data), 4).collect()
    assert Counter((r["row_hash"], r["row_hash2"]) for r in alone) == Counter(data)
    assert sharding.propagate_graph(nodes.limit(0), links, 0, 4).count() == 0
    assert sharding.cut(placed, links.limit(0)) == 0 and sharding.cut(placed.limit(0), links) == 0
