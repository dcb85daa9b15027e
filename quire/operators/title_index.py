"""Many title rules at once: an index from letters that a rule cannot do without to the rule.

A fold of rules into one expression stops at the size of a plan. Here each regular expression gives the runs of letters
that all its matches contain; up to eight letters at either end of a run are its candidate keys, and the rarest of them
in the titles is its key. Titles are read once by their bytes: places whose three letters and whose key some rule may have
(two bit tables of fixed size) give the title's keys, and an equal join finds the few rules that it may match. Those whose
runs the title has are verified with the expression itself, and the first that matches counts. Plain rules are an equal
join of their own. Expressions without three letters in a row go through the plan in groups.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import java_regex, js_trim
from quire.operators.ordering import settled

#: Letters that a key has at least and at most.
GRAM, KEY = 3, 8
#: Slots of the table of keys, as bits of a mixed key; and codes of three ASCII characters.
SLOT_BITS, CODES = 22, 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Keys of rules up to which they are broadcast (counted); more are joined by shuffle.
BROADCAST_KEYS = 200_000
#: What an expression that ignores case takes for i and s.
FOLDED = ("\u017f\u0131", "si")
#: Expressions without a key that one pass over the titles takes.
LOOSE_AT_ONCE = 200
PREPARED = "ord int, kind string, pattern string, shown string, needs array<string>, keys array<bigint>"


def required_runs(pattern: str, odd: str = "") -> list[str]:
    """Runs of ASCII characters, in small letters and without odd ones, that every match of a pattern in small-lettered text contains."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    runs = [""]

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and arg < 128 and chr(arg).lower() not in odd:
                runs[-1] += chr(arg).lower()
            elif name == "AT":
                continue
            elif name == "SUBPATTERN":
                walk(arg[-1])
                continue
            else:
                runs.append("")
                if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                    walk(arg[2])
                    runs.append("")

    if tree.state.flags & re.VERBOSE:
        return []
    walk(tree)
    return [r for r in runs if r]


def required(pattern: str, flags: str | None = None) -> str:
    """The longest run of ASCII characters, in small letters, that every match of a pattern in small-lettered text contains; '' if none is known."""
    # to an expression that ignores case, the long s and the dotless i are such letters as well
    return max(required_runs(pattern, "is" if flags is None or "i" in flags else ""), key=len, default="")


def key_of(letters: bytes) -> int:
    """Up to eight bytes as a number, from its highest byte on."""
    return int.from_bytes(letters[:KEY].ljust(KEY, b"\0"), "big")


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys * _MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _codes(one, two, three):
    """Of each three characters a number; other than ASCII ones share theirs."""
    return (one & 127) << 14 | (two & 127) << 7 | three & 127


def found_keys(data: np.ndarray, ends: np.ndarray, codes: np.ndarray, slots: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key) of texts in one run of bytes, in order: keys of these lengths whose first three characters and slot are marked.

    ends: 0 and the end of each text.
    """
    raw = np.append(data, np.zeros(KEY, np.uint8))
    wide = raw[: len(data) + 2].astype(np.int32)
    at = np.flatnonzero(codes[_codes(wide[:-2], wide[1:-1], wide[2:])])
    text = np.searchsorted(ends, at, "right") - 1
    left = ends[text + 1] - at
    word = np.zeros(len(at), np.uint64)
    for j in range(KEY):
        word = word << np.uint64(8) | raw[at + j]
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in lengths:
        cut = np.uint64(8 * (KEY - n))
        k = word >> cut << cut
        some = (left >= n) & slots[_slots(k)]
        texts.append(text[some])
        keys.append(k[some])
    both = np.unique(np.rec.fromarrays([np.concatenate(texts), np.concatenate(keys)], names="t,k"))
    return both["t"], both["k"]


def with_keys(titles: DataFrame, ready: DataFrame) -> DataFrame:
    """titles (title, lower, folded) with the keys of rules that each may have. What the driver sees is the two tables, of fixed size."""
    asked = ready.select(F.explode("keys").alias("key")).distinct()

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column(0)).view(np.uint64)
            b = key.astype(">u8").view(np.uint8).reshape(-1, KEY).astype(np.int64)
            lengths = KEY - (b[:, ::-1] != 0).argmax(axis=1)
            all_ = np.concatenate([_slots(key), (1 << SLOT_BITS) + _codes(b[:, 0], b[:, 1], b[:, 2]), -lengths])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(all_))], names=["m"])

    found = np.array([r["m"] for r in asked.mapInArrow(marks, "m bigint").distinct().collect()], np.int64)
    lengths = sorted((-found[found < 0]).tolist())
    slots, codes = np.zeros(1 << SLOT_BITS, bool), np.zeros(CODES, bool)
    slots[found[(found >= 0) & (found < 1 << SLOT_BITS)]] = True
    codes[found[found >= 1 << SLOT_BITS] - (1 << SLOT_BITS)] = True
    packed = np.packbits(slots).tobytes(), np.packbits(codes).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, codes = (np.unpackbits(np.frombuffer(v, np.uint8)).view(bool) for v in packed)
        for batch in batches:
            rows = max(1, batch.num_rows * (4 << 20) // max(4 << 20, batch.nbytes))
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                texts = [t.encode() for t in part.column(2).to_pylist()]
                ends = np.cumsum([0, *map(len, texts)])
                text, key = found_keys(np.frombuffer(b"".join(texts), np.uint8), ends, codes, slots, lengths)
                at = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
                keys = pa.ListArray.from_arrays(at, pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=["title", "lower", "folded", "keys"])

    return titles.select("title", "lower", "folded").mapInArrow(run, "title string, lower string, folded string, keys array<bigint>")


def prepared(rules: DataFrame) -> DataFrame:
    """Rows of PREPARED: rules that can match, as they are compared; ill-formed ones and patterns that do not compile are left out with a warning."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, kind, value, pattern, flags in f[["ord", "type", "value", "pattern", "flags"]].itertuples(index=False):
                if kind == "string" and isinstance(value, str) and value.strip():
                    out.append((n, "string", value.strip().lower(), value, [], []))
                elif kind == "regex" and isinstance(pattern, str):
                    java = java_regex(pattern, flags if isinstance(flags, str) else None)
                    if java is None:
                        warnings.warn(f"a title rule does not compile and is left out: {pattern}", stacklevel=2)
                        continue
                    needs = [r for r in required_runs(pattern) if len(r) >= GRAM]
                    keys = sorted({key_of(k) for r in needs for k in (r[:KEY].encode(), r[-KEY:].encode())})
                    keys = np.array(keys, np.uint64).view(np.int64).tolist()
                    out.append((n, "regex" if keys else "loose", java, pattern, needs, keys))
            yield pd.DataFrame(out, columns=["ord", "kind", "pattern", "shown", "needs", "keys"])

    return rules.mapInPandas(run, PREPARED)


def first_rules(titles: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows title, ord, reason: for each distinct title that a rule matches, the first rule; rules as rules_table() has them.

    The same result as a fold of title_reason() over the rules. Null and empty titles match nothing; equal titles are
    looked at once, so a title that most chapters have costs as much as any other.
    """
    known = titles.select("title").where("title is not null and title <> ''").distinct().withColumn("lower", js_trim(F.lower("title")))
    ready = settled(prepared(rules))
    plain = known.join(ready.where("kind = 'string'").select(F.col("pattern").alias("lower"), "ord"), "lower").select("title", "ord")
    indexed = with_keys(known.withColumn("folded", F.translate("lower", *FOLDED)), ready.where("kind = 'regex'"))
    counts = indexed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # a rule's key is the rarest of its candidates; one that no title has leaves the rule out
    asked = ready.where("kind = 'regex'").select("ord", F.explode("keys").alias("key")).join(counts, "key", "left")
    rarest = asked.groupBy("ord").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("key")).where("key.n > 0").select("ord", F.col("key.key").alias("key"))
    keys = settled(rarest.join(ready.select("ord", "pattern", "needs"), "ord"))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    met = indexed.select("title", "lower", "folded", F.explode("keys").alias("key")).join(keys, "key")
    matched = met.where(F.forall("needs", lambda r: F.contains("folded", r)) & F.rlike("lower", F.col("pattern"))).select("title", "ord")
    loose = [(r["ord"], r["pattern"]) for r in ready.where("kind = 'loose'").orderBy("ord").collect()]
    for i in range(0, len(loose), LOOSE_AT_ONCE):
        first = F.coalesce(*[F.when(F.col("lower").rlike(p), F.lit(n)) for n, p in loose[i : i + LOOSE_AT_ONCE]], F.lit(None).cast("int"))
        matched = matched.unionByName(known.select("title", first.alias("ord")).where("ord is not null"))
    best = matched.unionByName(plain).groupBy("title").agg(F.min("ord").alias("ord"))
    return best.join(ready.select("ord", F.concat(F.lit("matches filter pattern: "), "shown").alias("reason")), "ord").select("title", "ord", "reason")


def with_title_reason(chapters: DataFrame, rules: DataFrame, out: str = "title_reason") -> DataFrame:
    """chapters with the reason of the first rule that matches their title, or null."""
    found = first_rules(chapters, rules).select(F.col("title").alias("__title"), F.col("reason").alias(out))
    return chapters.join(found, F.col("title") == F.col("__title"), "left").drop("__title")

