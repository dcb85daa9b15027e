"""Summaries of sections with page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fmt
from quire.functions.text import js_trim, utf16_len

#: Ranges of up to so many pages meet in blocks of as many; each level of longer ranges has blocks STEP times as long.
BLOCK, STEP = 64, 8


def parse_page_range(c: Column) -> Column:
    """start and end of `a-b`; null for anything else."""
    ok = c.rlike(r"^[0-9]+-[0-9]+\z")
    part = lambda i: F.try_element_at(F.split(c, "-"), F.lit(i)).try_cast("bigint")
    return F.when(ok, F.struct(part(1).alias("start"), part(2).alias("end")))


def section_title(title: Column, index: Column) -> Column:
    t = js_trim(F.coalesce(title, F.lit("")))
    return F.when(t != "", t).otherwise(F.concat(F.lit("Section "), index.cast("string")))


def overlap_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("page "), start.cast("string"))).otherwise(F.concat(F.lit("pages "), start.cast("string"), F.lit("-"), end.cast("string")))


def page_overlaps(sections: DataFrame) -> DataFrame:
    """Every two sections of a book whose page ranges share pages, once, in order.

    Order is by `ord` if there is such a column, else by index, then by range: sections of one index are told apart by
    their place. A range lies in the blocks of its own level, at most two, and looks into those of longer levels, as
    far as its book has any; so a range of any length makes few rows. Of two blocks that both ranges reach, the
    first reports. Backwards ranges share pages with none.
    """
    r = sections.withColumn("r", parse_page_range(F.col("page_range")))
    order = ["ord"] if "ord" in sections.columns else ["index", "r.start", "r.end", "title"]
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy(*order))).where("r is not null and r.start <= r.end")
    r = r.select("book_id", "place", "index", section_title(F.col("title"), F.col("index")).alias("title"), "page_range", F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    size = F.greatest(F.col("end") - F.col("start") + 1, F.lit(BLOCK))
    level = F.ceil(F.round(F.log(size / BLOCK) / F.log(F.lit(float(STEP))), 9)).cast("int")
    r = r.withColumn("level", level)
    most = r.groupBy("book_id").agg(F.max("level").alias("most"))
    width = lambda x: (BLOCK * F.pow(F.lit(float(STEP)), x)).cast("bigint")
    covers = F.sequence(F.floor(F.col("start") / width(F.col("at"))), F.floor(F.col("end") / width(F.col("at"))))
    every = r.join(most, "book_id").withColumn("at", F.explode(F.sequence("level", "most"))).withColumn("block", F.explode(covers)).drop("most")
    a, b = every.where("level = at").alias("a"), every.alias("b")
    start, end = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    met = a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.block") == F.col("b.block")))
    met = met.where((F.col("a.place") < F.col("b.place")) | (F.col("b.level") < F.col("a.level"))).where(F.col("a.place") != F.col("b.place"))
    met = met.where((start <= end) & (F.col("a.block") == F.floor(start / width(F.col("a.at")))))
    first = F.col("a.place") < F.col("b.place")
    side = lambda c, left: F.when(first == F.lit(left), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    return met.select(
        F.col("a.book_id").alias("book_id"), side("index", True).alias("left_index"), side("index", False).alias("right_index"),
        side("title", True).alias("left_title"), side("page_range", True).alias("left_range"), side("title", False).alias("right_title"), side("page_range", False).alias("right_range"),
        start.alias("overlap_start"), end.alias("overlap_end"), overlap_label(start, end).alias("label"),
    )


def section_line(sections: DataFrame) -> DataFrame:
    n = F.col("page_count")
    pages = F.when(F.coalesce("page_range", F.lit("")) != "", F.concat(F.lit(" | pages: "), F.col("page_range"))).otherwise("")
    counted = F.when(n.isNotNull(), F.concat(F.lit(" ("), fmt.count(n), F.when(n == 1, " page)").otherwise(" pages)"))).otherwise("")
    line = F.concat(F.lit("- "), section_title(F.col("title"), F.col("index")), pages, counted, F.lit(" | chars: "), fmt.count(utf16_len(F.coalesce("text", F.lit("")))))
    return sections.select("book_id", "index", line.alias("line"))


def selection(sections: DataFrame) -> DataFrame:
    """Sections in order with a dense place, for listings."""
    return sections.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("index")))
