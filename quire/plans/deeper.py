"""Registered queries of whole runs: ordered generation, the order of all cards, JSON validation, logs of edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import assemble, cards, edits, fences, generate, retry, title_index, validate
from quire.plans.contract import _conversation_pages, _index, _sql, query, read
from quire.sources import books

_LINES = "SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM conversations"


@query(f"SELECT row_number() OVER (ORDER BY CAST(conv_id AS VARCHAR), turn, k) AS n, CAST(conv_id AS VARCHAR) AS book_id, turn AS section_index, CAST(k AS BIGINT) AS card_ord, line AS heading_text FROM ({_LINES})")
def a8_all_cards(spark, d):
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "heading_text")
    rows = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("section_index"), lines)
    return cards.number_cards(rows.select("book_id", "section_index", (F.col("k") + 1).cast("bigint").alias("card_ord"), "heading_text"))


def _model(prompt: str, text: str) -> str:
    """A stand-in for a model, by the text alone: some texts are refused, some get no cards, the others get one."""
    n = len(text)
    if n % 11 == 3:
        raise retry.CallError("refused", status=400)
    return "no cards" if n % 13 == 5 else f"## {n}\n\n- {text.split()[0].lstrip('#-*+`~') or 'x'}"


@query("""WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, turn, length(t) AS n FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^[\\s\\x{FEFF}\\x{A0}]+|[\\s\\x{FEFF}\\x{A0}]+$', '', 'g') AS t FROM conversations)),
f AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n % 11 = 3 THEN 'refused' WHEN n % 13 = 5 THEN 'form' END AS fault FROM s),
e AS (SELECT *, min(CASE WHEN fault IS NOT NULL THEN turn END) OVER (PARTITION BY book_id) AS stop FROM f)
SELECT book_id, turn AS section_index, CASE fault WHEN 'empty' THEN 0 WHEN 'form' THEN 3 ELSE 1 END AS attempts, coalesce(fault, 'none') AS fault FROM e WHERE stop IS NULL OR turn <= stop""")
def g5_ordered_run(spark, d):
    sections = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("index"), "text")
    out = generate.answers(sections, generate.Plan("gemini", "gemini-x", "cards"), _model, stop=True)
    fault = F.when(F.col("error").isNull(), "none").when(F.col("error") == "refused", "refused").when(F.col("attempts") == 0, "empty").otherwise("form")
    return out.select("book_id", F.col("section_index").cast("bigint").alias("section_index"), "attempts", fault.alias("fault"))


@query("""SELECT doc_id, CASE WHEN lang = 'de' AND doc_id % 3 = 0 THEN 'JSON data must have a metadata object' WHEN coalesce(text, '') = '' AND text IS NULL THEN 'Section 2 is missing required properties (index, title, or text)'
 WHEN doc_id % 5 = 0 THEN 'Section 1 is missing required properties (index, title, or text)' WHEN source IS NULL OR source = '' THEN 'Section 2 is missing required properties (index, title, or text)'
 WHEN n_chars % 7 = 0 THEN 'Section 3 is missing required properties (index, title, or text)' END AS fault FROM documents""")
def f16_json_faults(spark, d):
    part = lambda i, title, text: F.struct(i.cast("bigint").alias("index"), title.alias("title"), text.alias("text"))
    one = F.lit(1)
    content = F.array(part(F.col("doc_id") % 5, F.lit("a"), F.lit("b")), part(one, F.col("source"), F.col("text")), part(-(F.col("n_chars") % 7), F.lit("c"), F.lit("")), part(one, F.lit(""), F.lit("")))
    # the third section has an index below 1 in any document, so that the fourth is never named
    content = F.when(F.col("n_chars") % 7 == 0, content).otherwise(F.slice(content, 1, 2))
    metadata = F.when((F.col("lang") == "de") & (F.col("doc_id") % 3 == 0), F.lit(None)).otherwise(F.create_map(F.lit("title"), F.coalesce("lang", F.lit(""))))
    book = F.to_json(F.struct(metadata.alias("metadata"), content.alias("content")))
    return read(spark, d, "documents").select("doc_id", validate.faults(book).alias("fault"))


def _shelf(spark, d):
    """Documents of a source as the sections of a book, in the order of their ids."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id"))
    return read(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("book_id"), "doc_id").withColumn("index", place)


def _log(spark, d):
    """Events as edits of these books: errors take back, all others delete some place."""
    event = read(spark, d, "events")
    return event.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("book_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "undo").otherwise("delete").alias("op"), (1 + F.floor(F.col("value") * 7) % 400).alias("index"))


@query("""WITH RECURSIVE shelf AS (SELECT coalesce(source, 'none') AS b, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1),
log AS (SELECT 'src' || (user_id % 20) AS b, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k, event_type = 'error' AS undo, 1 + CAST(floor(value * 7) AS BIGINT) % 400 AS i FROM events),
r AS (
  SELECT b, CAST(0 AS BIGINT) AS k, ids, CAST([] AS STRUCT(p BIGINT, id BIGINT)[]) AS stack FROM shelf
  UNION ALL
  SELECT r.b, log.k, CASE WHEN undo AND len(stack) > 0 THEN ids[:stack[-1].p - 1] || [stack[-1].id] || ids[stack[-1].p:] WHEN NOT undo AND i <= len(ids) THEN ids[:i - 1] || ids[i + 1:] ELSE ids END,
    CASE WHEN undo THEN stack[:len(stack) - 1] WHEN i <= len(ids) THEN (stack || [{'p': i, 'id': ids[i]}])[-10:] ELSE stack END
  FROM r JOIN log ON log.b = r.b AND log.k = r.k + 1)
SELECT b AS book_id, CAST(generate_subscripts(ids, 1) AS BIGINT) AS index, unnest(ids) AS doc_id FROM (SELECT b, arg_max(ids, k) AS ids FROM r GROUP BY b)""")
def m2_edit_log(spark, d):
    return edits.replay(_shelf(spark, d), _log(spark, d)).select("book_id", F.col("index").cast("bigint").alias("index"), "doc_id")


_FIRST_LINE = "string_split(coalesce(text, ''), chr(10))[1]"
_WORDS = "regexp_extract_all(lower(text), '[a-z]{3,}')"


@query(f"""WITH w AS (SELECT item_id, text, {_WORDS} AS ws FROM benchmark),
r AS (SELECT item_id * 2 AS ord, ws[1] || '[a-z]*\\W+' || ws[2] || '.*' AS pattern FROM w WHERE len(ws) > 4
  UNION ALL SELECT item_id * 2 + 1, ws[3] || '\\w?(?: |, )(?:' || ws[4] || '|' || ws[5] || ')$' FROM w WHERE len(ws) > 4),
t AS (SELECT DISTINCT {_FIRST_LINE} AS title FROM documents)
SELECT title, min(ord) AS ord, 'matches filter pattern: ' || arg_min(pattern, ord) AS reason FROM t JOIN r ON regexp_matches(trim(lower(title)), pattern) WHERE title <> '' GROUP BY title""")
def f8_many_rules(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)
    items = read(spark, d, "benchmark").select("item_id", words.alias("w")).where("size(w) > 4")
    at = lambda i: F.col("w")[i - 1]
    two = F.array(F.concat(at(1), F.lit(r"[a-z]*\W+"), at(2), F.lit(".*")), F.concat(at(3), F.lit(r"\w?(?: |, )(?:"), at(4), F.lit("|"), at(5), F.lit(")$")))
    rules = items.select("item_id", F.posexplode(two).alias("k", "pattern"))
    none = F.lit(None).cast("string")
    rules = rules.select((F.col("item_id") * 2 + F.col("k")).cast("int").alias("ord"), F.lit("regex").alias("type"), none.alias("value"), "pattern", none.alias("flags"))
    titles = read(spark, d, "documents").select(F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"))
    return title_index.first_rules(titles, rules).withColumn("ord", F.col("ord").cast("bigint"))


@query("""WITH refs AS (SELECT turn, conv_id, 'p' || (conv_id * 7 + turn) || '.html' AS ref FROM conversations),
f AS (SELECT 'p' || page_id || '.html' AS name, CASE WHEN page_id % 3 = 0 THEN 1 WHEN page_id % 4 = 1 THEN 2 END AS one, CASE WHEN page_id % 5 < 3 THEN 3 END AS two FROM pages),
n AS (SELECT name, coalesce(least(one, two), one, two) AS folder FROM f)
SELECT ref, folder, CAST(count(*) AS BIGINT) AS n FROM refs JOIN n ON name = ref WHERE folder IS NOT NULL GROUP BY ref, folder""")
def s15_media_folders(spark, d):
    refs = read(spark, d, "conversations").select(F.concat(F.lit("p"), (F.col("conv_id") * 7 + F.col("turn")).cast("string"), F.lit(".html")).alias("ref"))
    page = F.col("page_id")
    pages = read(spark, d, "pages").select(F.concat(F.lit("p"), page.cast("string"), F.lit(".html")).alias("name"), page, F.col("html").cast("binary").alias("content"))
    folders = [pages.where(page % 3 == 0), pages.where(page % 4 == 1), pages.where(page % 5 < 3)]
    found = books.first_media(refs, folders)
    return refs.join(found, "ref").groupBy("ref", F.col("folder").alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
f AS (SELECT *, length(line) % 9 = 4 AS fence FROM l),
c AS (SELECT doc_id, k, fence, count(*) FILTER (WHERE fence) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM f)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE fence OR n % 2 = 1) AS BIGINT) AS n_code, CAST(coalesce(sum(k) FILTER (WHERE fence OR n % 2 = 1), 0) AS BIGINT) AS places FROM c GROUP BY doc_id""")
def s7_fenced_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    line = F.when(F.length("line") % 9 == 4, F.lit("```")).otherwise(F.translate("line", "`~", "  "))
    marked = fences.with_in_code(lines.select("doc_id", (F.col("k") + 1).alias("line_no"), line.alias("line")), doc="doc_id")
    code = F.col("in_code")
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(code).alias("n_code"), F.coalesce(F.sum(F.when(code, F.col("line_no").cast("bigint"))), F.lit(0)).alias("places"))


def _word_pages(spark, d):
    """Pages whose words are positioned runs, ten on a line, in an order that is not theirs."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")
    run = lambda w, i: F.struct((i % 10).cast("double").alias("x"), F.floor(i / 10).cast("double").alias("y"), F.array(F.struct(F.replace(w, F.lit("%"), F.lit("%25")).alias("T"))).alias("R"))
    pages = _conversation_pages(spark, d).select("book_id", "page_no", F.reverse(F.transform(words, run)).alias("runs"))
    return assemble.pages_from_runs(pages)


def _of_runs(name: str) -> str:
    """The SQL of a query over pages, with the words of each page, a space between, for its text."""
    words = "array_to_string(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'), ' ')"
    return _sql[name].replace("turn + 1 AS page_no, text FROM", f"turn + 1 AS page_no, {words} AS text FROM")


@query(_of_runs("j1_index_join"))
def j2_runs_by_index(spark, d):
    out = assemble.by_index(_word_pages(spark, d), _index(spark, d))
    return out.withColumns({"index": F.col("index").cast("bigint"), "page_count": F.col("page_count").cast("bigint")})


@query(_of_runs("a2_single_text"))
def a3_runs_single_text(spark, d):
    out = assemble.whole_book(_word_pages(spark, d))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("index", "page_count", "processed_pages")})
