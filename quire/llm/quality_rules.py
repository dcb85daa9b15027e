"""Quality rules with host-level verdicts, in DataFrame functions only.

Every text is measured row by row. The failures of each rule are summed by host, each rule's rates are shrunk towards
that rule's own empirical beta prior, and the hosts' verdicts are joined back. The base rules reject a text on their
own. The softer rules below only mark it: a marked text goes if its host is one whose shrunk rate stands out from the
prior of that rule. All texts of a host go if most of them fail the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE, free_name, packed, table, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host is rejected if its shrunk rate of base failures is above this.
HOST_MAX_RATE = 0.5
#: A host is strict in a soft rule if its shrunk rate is so many deviations of the rule's prior above the prior's mean.
DEVIATIONS = 1.0
#: Rules that mark a text: few words, symbols among its characters, repeated lines and repeated words for its length.
SOFT = {
    "short": "n_words < 20",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "25 * n_dup_lines > n_words",
    "repeats": "10 * n_repeat_words > n_words",
}
#: Bounds of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
#: Up to this many hosts, counted first, their verdicts are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 100_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _covered(windows: Column) -> Column:
    """Number of words in windows that occur twice or more, from the array of the windows' hashes."""
    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(_covered_sorted(ordered))


def _covered_sorted(ordered: Column) -> Column:
    # equal hashes are neighbours; a run's members are those that equal the one before or after
    h = lambda x, i: F.get(x, i)["h"]
    starts = F.aggregate(
        F.array(ordered), F.array().cast("array<int>"),
        lambda _, s: F.array_sort(F.transform(F.filter(s, lambda x, i: (x["h"] == h(s, i - 1)).eqNullSafe(True) | (x["h"] == h(s, i + 1)).eqNullSafe(True)), lambda x: x["i"])),
    )
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(starts, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("bigint").alias("n")), lambda a: a["n"])


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns BASE: the rules that look at one text alone. No shuffle.

    Null texts have no words. docs must have no column of these names, nor those of the word, window and line arrays
    that are dropped again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    w = free_name("words", docs.columns)
    v, x = w + "_windows", w + "_lines"
    lines = F.filter(F.split(text, "\n"), lambda y: y.rlike(r"[^ \t\n\x0B\f\r]"))
    last = F.size(w) - WINDOW
    out = docs.withColumn(w, words(F.col(text_col)))
    out = out.withColumn(v, F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))))
    out = out.withColumn(x, lines).withColumns({
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": _covered(F.col(v)),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.drop(w, v, x)


def host_verdicts(base: DataFrame, host_col: str, max_rate: float = HOST_MAX_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """Rows host_key, bad (boolean) and strict (the names of soft rules), from documents with a host and BASE; null hosts have none.

    The prior Beta(mM, (1-m)M) of a rule has the mean m of all documents and the strength M that fits the variance of
    the hosts' rates (method of moments), within bounds; a host of few documents stays near m. Hosts are combined
    before the shuffle, and figures are rounded, so that reruns agree.
    """
    rules = {"base": F.col("base_failed"), **{k: F.expr(v) for k, v in SOFT.items()}}
    failures = [F.sum(c.cast("bigint")).alias(k) for k, c in rules.items()]
    hosts = base.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host_key")).agg(F.count(F.lit(1)).alias("n"), *failures)
    moments = [c for k in rules for c in ((F.sum(k) / F.sum("n")).alias(f"m_{k}"), F.var_samp(F.col(k) / F.col("n")).alias(f"v_{k}"))]
    # one row of a few numbers: the only thing that is broadcast without a count
    shrunk = hosts.join(F.broadcast(hosts.agg(*moments)))
    above = {}
    for k in rules:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        strength = F.when(v > 0, F.least(F.greatest(F.try_divide(m * (1 - m), v) - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))).otherwise(F.lit(MAX_STRENGTH))
        rate = F.round((F.col(k) + m * strength) / (F.col("n") + strength), 9)
        limit = F.lit(max_rate) if k == "base" else F.round(m + deviations * F.sqrt(m * (1 - m) / (strength + 1)), 9)
        above[k] = rate > limit
    strict = F.array_compact(F.array(*[F.when(above[k], F.lit(k)) for k in SOFT]))
    return shrunk.select("host_key", above["base"].alias("bad"), strict.alias("strict"))


def _kept(measured: DataFrame, host_col: str, max_rate: float) -> DataFrame:
    """measured (BASE and a host, a table) with kept."""
    hosts = table(host_verdicts(measured, host_col, max_rate))
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    met = measured.join(hosts, F.col(host_col) == F.col("host_key"), "left")
    marked = F.array_compact(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in SOFT.items()]))
    gone = F.coalesce(F.col("bad") | F.arrays_overlap("strict", marked), F.lit(False))
    return met.withColumn("kept", ~F.col("base_failed") & ~gone)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = HOST_MAX_RATE) -> DataFrame:
    """Rows id, BASE and kept; one for each row of docs.

    Null and empty texts have no words and so fail; a null host has no verdict of its own; repeated rows count as
    often as they occur; an empty table gives no rows; other columns are not read. Texts are never shuffled: the
    measures are written once, and only hosts and their verdicts move.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{host_col}`").alias("host"))
    measured = table(base_rules(narrow).drop("text"))
    return _kept(measured, "host", max_rate).select(F.col("id").alias(id_col), *BASE, "kept")


def keep_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = HOST_MAX_RATE) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever their names.

    Each text is measured once: documents and measures are written as one table, which the verdicts then filter. Nulls,
    repeated rows and empty tables are as in quality().
    """
    rows = docs.select(packed(docs), F.col(f"`{text_col}`").alias("text"), F.col(f"`{host_col}`").alias("host"))
    measured = table(base_rules(rows).drop("text"))
    return _kept(measured, "host", max_rate).where("kept").select("row.*")
