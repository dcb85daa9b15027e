"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney bigram model: its pairs of words less a discount, then the pairs of both
classes together less a discount, then its words by the number of different words they follow in the class, less a
discount, then a distribution that both classes share, in which a word counts by the number of classes it occurs in.
What a level discounts goes to the level below, so rare pairs and rare words get nearly all their probability from the
shared counts and say little. Discounts are estimated from the numbers of things seen once and twice.

A toxic text is an ordinary one with toxic words in it, so the toxic likelihood mixes both models word by word, MIXED
parts toxic. The length-normalised difference of the log-likelihoods of a text is its evidence; a logistic curve,
fitted on documents that the counts have not seen, turns it into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, table

#: The models learn from at most about this many labelled documents of each class, chosen by a hash of the id.
DOCS_A_CLASS = 4_000
THRESHOLD = 0.7
#: Share of toxic words that the toxic likelihood assumes.
MIXED = 0.02
WORD = re.compile(r"\w+")
START = np.uint64(1)
CLASSES = ("toxic", "plain")
BOTH = (*CLASSES, "shared")


def tokens(text: str | None) -> np.ndarray:
    """A hash for each word of the whole text, in lower case."""
    digest = xxhash.xxh64_intdigest
    seen: dict[str, int] = {}
    words = WORD.findall((text or "").lower())
    for w in words:
        if w not in seen:
            seen[w] = digest(w)
    return np.fromiter((seen[w] for w in words), np.uint64, len(words))


def before(w: np.ndarray) -> np.ndarray:
    """The word before each word; START before the first."""
    return np.concatenate(([START], w[:-1]))[: len(w)]


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit key for a pair of words."""
    x = (v ^ (v >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, w, vw (the pair's key), toxic, plain: pair counts of a batch of (text, toxic)."""
    for part in (s for b in batches for s in slices(b)):
        vs, ws, ts = [], [], []
        for text, toxic in zip(part.column(0), part.column(1)):
            w = tokens(text.as_py())
            vs.append(before(w))
            ws.append(w)
            ts.append(np.full(len(w), toxic.as_py(), np.int64))
        v, w, t = np.concatenate(vs), np.concatenate(ws), np.concatenate(ts)
        if len(v):
            key, first, at = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
            n = np.bincount(at, minlength=len(key))
            k = np.bincount(at, weights=t, minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (v[first], w[first], key)] + [pa.array(k), pa.array(n - k)], names=["v", "w", "vw", "toxic", "plain"])


class _Index:
    """Places of 64-bit keys; one place more, the last, for all others."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.values = [np.append(np.asarray(v)[order], np.float32(0)).astype(np.float32) for v in values]

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        has = at < len(self.keys)
        has[has] = self.keys[at[has]] == keys[has]
        return np.where(has, at, len(self.keys))


class Model:
    """Both classes' models. Of words: each class's lower probability and, as a context, the weights below each class and below both.

    Of pairs: what they have of their own in each class and in both together.
    """

    def __init__(self, words: _Index, pairs: _Index, unseen: dict[str, float]) -> None:
        self.words, self.pairs = words, pairs
        # a word that neither class has: what the shared counts leave for all such words
        for c, base in zip(CLASSES, words.values[:2]):
            base[-1] = unseen[c]
        for weight in words.values[2:]:
            weight[-1] = 1.0  # nothing follows an unknown context: all weight is on the level below
        self.curve = (-2.0, 1.0, 1.0)

    def log_probabilities(self, w: np.ndarray) -> dict[str, np.ndarray]:
        """log P(word | word before) of each word, by class."""
        v = before(w)
        here, prior, pair = self.words.find(w), self.words.find(v), self.pairs.find(pair_key(v, w))
        own, (below, weight) = self.pairs.values, (self.words.values[:2], self.words.values[2:])
        return {c: np.log(own[i][pair] + weight[i][prior] * (own[2][pair] + weight[2][prior] * below[i][here])) for i, c in enumerate(CLASSES)}

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The difference of the log-likelihoods for each word, and that times the root of the length; 0 for a text without words."""
        w = tokens(text)
        if not len(w):
            return 0.0, 0.0
        p = self.log_probabilities(w)
        total = float(np.log1p(MIXED * np.expm1(np.minimum(p["toxic"].astype(np.float64) - p["plain"], 50.0))).sum())
        return total / len(w), total / len(w) ** 0.5

    def score(self, text: str | None) -> float:
        a, b = self.evidence(text)
        return _logistic(self.curve[0] + self.curve[1] * a + self.curve[2] * b)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def fit_curve(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on both figures by Newton steps, classes weighted alike, with a small ridge."""
    if not len(y) or y.min() == y.max():
        return -2.0, 1.0, 1.0
    x = np.stack([np.ones(len(y)), a, b], axis=1)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, ridge = np.zeros(3), np.diag([0.0, 1e-6, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(3), x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple((w / scale).tolist())


def _columns(df: DataFrame) -> dict:
    got = df.toArrow()  # bounded by the sample
    return {c: got.column(c).to_numpy() for c in df.columns}


def _discount(once: int, twice: int) -> float:
    """The share of a count that the level below gets, from how much was seen once and twice."""
    return once / (once + 2 * twice) if once else 0.5


def _seen(c: str, n: int | None = None) -> Column:
    return F.sum((F.col(c) > 0 if n is None else F.col(c) == n).cast("bigint"))


def counted(pairs: DataFrame) -> Model:
    """The model of pair counts v, w, vw, toxic, plain (one row a pair)."""
    pairs = pairs.withColumn("shared", F.col("toxic") + F.col("plain"))
    # words as what follows: how many different words they follow in each class; as contexts: how often, and by how many
    after = pairs.groupBy("w").agg(*[_seen(c).alias(c) for c in CLASSES])
    context = pairs.groupBy("v").agg(*[F.sum(c).alias(f"n_{c}") for c in BOTH], *[_seen(c).alias(f"types_{c}") for c in BOTH])
    after, context = table(after), table(context)
    facts = pairs.agg(*[_seen(c, n).alias(f"{c}{n}") for c in BOTH for n in (1, 2)]).first().asDict()
    lower = after.agg(*[F.sum(c).alias(f"total_{c}") for c in CLASSES], *[_seen(c).alias(f"types_{c}") for c in CLASSES], *[_seen(c, n).alias(f"{c}{n}") for c in CLASSES for n in (1, 2)]).first().asDict()
    facts, lower = ({k: v or 0 for k, v in x.items()} for x in (facts, lower))
    top = {c: _discount(facts[f"{c}1"], facts[f"{c}2"]) for c in BOTH}
    low = {c: _discount(lower[f"{c}1"], lower[f"{c}2"]) for c in CLASSES}
    shares = sum(lower[f"types_{c}"] for c in CLASSES) + 1  # one share is left for all words that neither class has

    def base(c: str, k, classes):
        """The lower distribution of a class: continuation counts k, less the discount, and the shared counts."""
        total = lower[f"total_{c}"]
        if not total:
            return classes / shares
        return ((k > 0) * (k - low[c])).astype(float) / total + low[c] * lower[f"types_{c}"] / total * classes / shares

    got = _columns(after.withColumnRenamed("w", "k").join(context.withColumnRenamed("v", "k"), "k", "full").na.fill(0))
    classes = sum((got[c] > 0).astype(float) for c in CLASSES)
    classes = np.maximum(classes, 1.0)  # START, and a word that is a context only, follow nothing
    bases = [base(c, got[c], classes) for c in CLASSES]
    weights = [np.divide(top[c] * got[f"types_{c}"], got[f"n_{c}"], out=np.ones(len(classes)), where=got[f"n_{c}"] > 0) for c in BOTH]
    own = [F.coalesce(F.greatest(F.col(c) - F.lit(top[c]), F.lit(0.0)) / F.nullif(F.col(f"n_{c}"), F.lit(0)), F.lit(0.0)).cast("float").alias(c) for c in BOTH]
    pair = _columns(pairs.select("v", "vw", *BOTH).join(context.hint("merge"), "v").select("vw", *own))
    unseen = {c: float(base(c, np.zeros(1), np.ones(1))[0]) for c in CLASSES}
    return Model(_Index(got["k"], *bases, *weights), _Index(pair["vw"], *[pair[c] for c in BOTH]), unseen)


def fit(texts: DataFrame) -> Model:
    """texts: text, toxic (0 or 1), fit (boolean: for the counts; else for the curve). A bounded sample of labelled rows."""
    texts = table(texts)
    pairs = texts.where("fit").select("text", F.col("toxic").cast("bigint")).mapInArrow(_pairs, "v bigint, w bigint, vw bigint, toxic bigint, plain bigint")
    model = counted(table(pairs.groupBy("v", "w", "vw").agg(*[F.sum(c).alias(c) for c in CLASSES])))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([shared.value.evidence(v.as_py()) for v in batch.column(0)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), batch.column(1)], names=["a", "b", "y"])

    held = _columns(texts.where("not fit").select("text", F.col("toxic").cast("int").alias("y")).mapInArrow(weigh, "a double, b double, y int"))
    order = np.lexsort((held["y"], held["b"], held["a"]))
    model.curve = fit_curve(held["a"][order], held["b"][order], held["y"][order])
    shared.destroy()
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_a_class: int = DOCS_A_CLASS) -> DataFrame:
    """The labelled rows to learn from: none whose crc32(id as text) mod 3 is 1, about docs_a_class of each class.

    The label rows are sampled first, by a hash of the id; so few rows may be broadcast, and texts stay where they are.
    Null labels and ids are left out; of an id's several labels the largest counts.
    """
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic")).where(crc % 3 != 1)
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic in (0, 1)").collect()}
    share = F.lit(0.0)
    for c in (0, 1):
        share = F.when(F.col("toxic") == c, min(1.0, docs_a_class / max(1, counts.get(c, 0)))).otherwise(share)
    spread = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1_000_003)) / 1_000_003.0
    chosen = own.where(spread < share).select(F.col("id").alias("__id"), "toxic", (F.pmod(F.xxhash64(F.lit("fold"), F.col("id")), F.lit(4)) > 0).alias("fit"))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("text", "toxic", "fit")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, docs_a_class: int = DOCS_A_CLASS) -> DataFrame:
    """Rows id, held_out, score, predicted; one for each row of docs.

    Only the text enters a score. Null and empty texts have no evidence and get the curve's value at 0; without labels
    of both classes a fixed curve stands in. Repeated rows and null ids keep their rows (a null id is not held out);
    an empty table gives none; other columns are not read.
    """
    model = fit(sample(docs, labels, id_col, text_col, docs_a_class))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            scores = [shared.value.score(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = narrow.mapInArrow(run, f"id {narrow.schema[0].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
