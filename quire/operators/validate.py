"""Structure checks of book JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def missing(require_titles: bool = True):
    """Whether a section lacks a positive index, a text or, if required, a title."""
    bad = ~F.coalesce(F.col("index") > 0, F.lit(False)) | F.col("text").isNull()
    return bad | (F.coalesce("title", F.lit("")) == "") if require_titles else bad


def violations(sections: DataFrame, require_titles: bool = True) -> DataFrame:
    """Rows book_id, position, error: the first faulty section of each book; sections need an `ord`."""
    w = Window.partitionBy("book_id").orderBy("ord")
    names = "index, title, or text" if require_titles else "index, or text"
    # texts are judged before anything moves
    judged = sections.select("book_id", "ord", missing(require_titles).alias("bad"))
    bad = judged.withColumn("position", F.row_number().over(w)).where("bad")
    first = bad.groupBy("book_id").agg(F.min("position").alias("position"))
    return first.withColumn("error", F.format_string(f"Section %d is missing required properties ({names})", "position"))


def check_book(data, require_metadata: bool = True, require_titles: bool = True) -> str | None:
    """The first fault of one decoded JSON document, or None; the file's own shape, before it becomes tables."""
    if not isinstance(data, (dict, list)):
        return "JSON data must have a content array" if data else "JSON data is null or undefined"
    content = data.get("content") if isinstance(data, dict) else None
    metadata = data.get("metadata") if isinstance(data, dict) else None
    if not isinstance(content, list):
        return "JSON data must have a content array"
    if require_metadata and not isinstance(metadata, (dict, list)):
        return "JSON data must have a metadata object"
    if metadata and not isinstance(metadata, (dict, list)):
        return "metadata must be an object if present"
    for n, s in enumerate(content, 1):
        s = s if isinstance(s, dict) else {}
        index, title = s.get("index"), s.get("title")
        ok = isinstance(index, (int, float)) and not isinstance(index, bool) and index > 0 and isinstance(s.get("text"), str)
        if not ok or require_titles and not (isinstance(title, str) and title):
            return f"Section {n} is missing required properties (index,{' title,' if require_titles else ''} or text)"
    return None


def is_book(data, **options) -> bool:
    return check_book(data, **options) is None


def all_valid(spark: SparkSession, sections: DataFrame, **options) -> bool:
    return violations(sections, **options).isEmpty()


def faults(text: Column, require_metadata: bool = True, require_titles: bool = True) -> Column:
    """The first fault of a JSON document, or null: check_book() on the text itself, by VARIANT paths in the JVM.

    Null and texts that are no JSON have a fault of their own. The first faulty section is named by its place.
    """
    v = F.try_parse_json(text)
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    is_object = lambda k: F.startswith(k, F.lit("OBJECT"))
    holds = lambda k: is_object(k) | F.startswith(k, F.lit("ARRAY"))
    root, meta = F.schema_of_variant(v), kind(v, "$.metadata")
    sections = F.try_variant_get(v, "$.content", "array<variant>")
    # what counts as nothing at all: null, false, zero and the empty string
    empty = (root == "VOID") | ((root == "BOOLEAN") & ~F.try_variant_get(v, "$", "boolean")) | ((root == "STRING") & (F.try_variant_get(v, "$", "string") == "")) | (root.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(v, "$", "double") == 0))
    # metadata that is there and says something, but is no object
    given = meta.isNotNull() & (meta != "VOID") & ~((meta == "BOOLEAN") & ~F.try_variant_get(v, "$.metadata", "boolean")) & ~((meta == "STRING") & (F.try_variant_get(v, "$.metadata", "string") == "")) & ~(meta.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(v, "$.metadata", "double") == 0))

    def sound(s: Column) -> Column:
        index = kind(s, "$.index").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(s, "$.index", "double") > 0)
        ok = index & (kind(s, "$.text") == "STRING")
        if require_titles:
            ok = ok & (kind(s, "$.title") == "STRING") & (F.try_variant_get(s, "$.title", "string") != "")
        return F.coalesce(ok, F.lit(False))

    place = F.array_position(F.transform(sections, sound), F.lit(False))
    names = "index, title, or text" if require_titles else "index, or text"
    out = F.when(v.isNull(), F.lit("the text is no JSON")).when(empty, F.lit("JSON data is null or undefined"))
    out = out.when(~is_object(root) | sections.isNull(), F.lit("JSON data must have a content array"))
    if require_metadata:
        out = out.when(~F.coalesce(holds(meta), F.lit(False)), F.lit("JSON data must have a metadata object"))
    out = out.when(F.coalesce(given, F.lit(False)) & ~F.coalesce(holds(meta), F.lit(False)), F.lit("metadata must be an object if present"))
    return out.when(place > 0, F.format_string(f"Section %d is missing required properties ({names})", place))
