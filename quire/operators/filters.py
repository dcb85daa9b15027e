"""The ordered filter cascade of chapters, and title rules."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.fmt import number_groups
from quire.functions.text import java_regex, js_trim, utf16_len

# Titles of front and back matter, each a regular expression with flag i, in order.
DEFAULT_TITLE_PATTERNS = [
    r"^contents?$",
    r"^dedication$",
    r"^about\s+the\s+.+$",
    r"^also\s+by\s+.+$",
    r"^index$",
    r"^credits$",
    r"^copyright$",
    r"^notes$",
    r"^notes\s+on\s+sources$",
    r"^bibliography$",
    r"^acknowledg(e)?ments?$",
    r"^acknowledg(e)?ments?\s+and\s+notes\s+on\s+sources$",
    r"^frontispiece$",
    r"^welcome$",
    r"^title\s+page$",
    r"^table\s+of\s+contents$",
    r"^newsletters?$",
    r"^praise\s+of(?:\s+.+)?$",
    r"^a\s+note\s+on\s+the\s+author$",
    r"^author['’]s\s+note$",
    r"^illustration\s+credits$",
]
DEFAULT_TITLE_RULES = [{"type": "regex", "pattern": p, "flags": "i"} for p in DEFAULT_TITLE_PATTERNS]


def title_reason(title: Column, rules: list[dict]) -> Column:
    """Reason of the first rule that matches a title, or null. Rules are constants of the plan, so no join is needed."""
    lower = js_trim(F.lower(title))
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        if rule.get("type") == "string" and isinstance(rule.get("value"), str):
            wanted = rule["value"].strip().lower()
            if wanted:
                out = F.when(lower == wanted, F.lit(f"matches filter pattern: {rule['value']}")).otherwise(out)
        elif rule.get("type") == "regex" and isinstance(rule.get("pattern"), str):
            pattern = java_regex(rule["pattern"], rule.get("flags"))
            if pattern is None:
                warnings.warn(f"a title rule does not compile and is left out: {rule['pattern']}", stacklevel=2)
                continue
            out = F.when(lower.rlike(pattern), F.lit(f"matches filter pattern: {rule['pattern']}")).otherwise(out)
    return F.when(title.isNotNull() & (title != ""), out)


def reason(number: Column, title: Column, text: Column, start: Column | int | None = None, end: Column | int | None = None, excluded: list[int] | None = None, min_chars: int | None = None, rules: list[dict] | None = None) -> Column:
    """Why a chapter is filtered, or null: range, then exclusion, then emptiness, then length, then title rules."""
    parts = []
    if start is not None and end is not None:
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
        parts.append(F.when(~number.between(a, b), F.concat(F.lit("outside range "), a.cast("string"), F.lit("-"), b.cast("string"))))
    if excluded:
        parts.append(F.when(number.isin(*excluded), F.lit("excluded by --exclude-sections")))
    parts.append(F.when(js_trim(F.coalesce(text, F.lit(""))) == "", F.lit("empty content")))
    if isinstance(min_chars, (int, float)) and min_chars > 0:
        n = utf16_len(text)
        parts.append(F.when(n < min_chars, F.concat(F.lit("below minimum characters: "), number_groups(n), F.lit(" < "), number_groups(F.lit(min_chars)))))
    parts.append(title_reason(title, DEFAULT_TITLE_RULES if rules is None else rules))
    return F.coalesce(*parts)


def once(df: DataFrame, column: str) -> DataFrame:
    """df with the column as a generated one, so that a filter on it is not pushed below and does not compute it again for each use."""
    return df.select(*[c for c in df.columns if c != column], F.explode(F.array(column)).alias(column)).select(*df.columns)


def with_reason(chapters: DataFrame, **options) -> DataFrame:
    """chapters (ord, title, text) with filter_reason."""
    return chapters.withColumn("filter_reason", reason(F.col("ord"), F.col("title"), F.col("text"), **options))


def min_chars(sections: DataFrame, least: int | None) -> DataFrame:
    """Sections of at least so many UTF-16 units, with the column dropped: how many their book has lost.

    A book that loses none keeps its indexes, gaps included; one that loses some is numbered anew.
    """
    if least is None or least <= 0:
        return sections.withColumn("dropped", F.lit(0).cast("bigint"))
    short = utf16_len(F.coalesce("text", F.lit(""))) < least
    book = Window.partitionBy("book_id")
    order = book.orderBy("index")
    marked = sections.withColumn("__short", short).withColumn("dropped", F.sum(F.col("__short").cast("bigint")).over(book))
    kept = marked.where(~F.col("__short")).withColumn("__n", F.row_number().over(order))
    return kept.withColumn("index", F.when(F.col("dropped") > 0, F.col("__n")).otherwise(F.col("index"))).drop("__short", "__n")


def rules_table(spark: SparkSession, *groups: list[dict]) -> DataFrame:
    rows = [(i, r.get("type"), r.get("value"), r.get("pattern"), r.get("flags")) for i, r in enumerate(r for g in groups for r in (g or []))]
    return spark.createDataFrame(rows, "ord int, type string, value string, pattern string, flags string")


def distinct_rules(rules: DataFrame) -> DataFrame:
    """The first of equal rules, in order."""
    w = Window.partitionBy(*[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("type", "value", "pattern", "flags")]).orderBy("ord")
    return rules.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
