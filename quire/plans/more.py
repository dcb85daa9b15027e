"""Further registered queries: small functions, selections, cards and edits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import fmt
from quire.functions import text as T
from quire.operators import assemble, cards, edits, filters, meta, retry, selectors, summary, validate
from quire.plans.contract import _ISSUES, _PAGES, W, _answers, _clean, _conversation_pages, _html, query, read

def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


_RUNS = "coalesce(text, '') || ' b a '"
_NONE = "coalesce(text, '')"
_LEAK = r"regexp_replace(coalesce(text, '') || ' sk-' || lpad(CAST(doc_id AS VARCHAR), 14, '0'), '\bsk-[A-Za-z0-9_-]{12,}\b', '[redacted-api-key]', 'g')"
_PADDED = "CASE doc_id % 3 WHEN 0 THEN chr(160) || '  ' || lang || ' .md' || chr(9) WHEN 1 THEN ' ' || chr(10) ELSE lang || '.MD' END"


def _padded():
    return F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("   "), "lang", F.lit(" .md\t"))).when(F.col("doc_id") % 3 == 1, F.lit(" \n")).otherwise(F.concat("lang", F.lit(".MD")))


@query(f"SELECT doc_id, nullif({_trim(_PADDED)}, '') AS path FROM documents")
def t6_path_arg(spark, d):
    return read(spark, d, "documents").select("doc_id", T.path_arg(_padded()).alias("path"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(n, '^[a-zA-Z0-9._-]+$') THEN n END AS name FROM (SELECT doc_id, regexp_replace({_trim(_PADDED)}, '(?i)\\.md$', '') AS n FROM documents)")
def t7_prompt_name(spark, d):
    return read(spark, d, "documents").select("doc_id", T.prompt_name(_padded()).alias("name"))


@query(f"SELECT doc_id, CASE WHEN length(t) > 2000 THEN left(t, 2000) || '...' ELSE t END AS output FROM (SELECT doc_id, {_trim('''regexp_replace(coalesce(text, '') || ' sk-' || lpad(CAST(doc_id AS VARCHAR), 14, '0'), '\\bsk-[A-Za-z0-9_-]{12,}\\b', '[redacted-api-key]', 'g')''')} AS t FROM documents)")
def t9_error_output(spark, d):
    return read(spark, d, "documents").select("doc_id", T.error_output(F.concat(F.coalesce("text", F.lit("")), F.lit(" sk-"), F.lpad(F.col("doc_id").cast("string"), 14, "0"))).alias("output"))


@query(f"SELECT conv_id, turn, 'Answer in cards.' || chr(10) || chr(10) || 'Prompt:' || chr(10) || 'Go on' || chr(10) || chr(10) || 'Source text:' || chr(10) || {_trim('text')} AS prompt FROM conversations")
def t10_exec_prompt(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.exec_prompt(F.lit("  Go on\n"), F.col("text"), ("Answer in cards.",)).alias("prompt"))


@query(f"SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN NULL ELSE nullif({_trim('text')}, '') || CASE turn % 3 WHEN 1 THEN chr(10) || 'end' ELSE '' END END AS answer FROM conversations")
def t11_answer_text(spark, d):
    one = F.to_json(F.struct(F.col("text").alias("s")))
    plain = F.substring(one, F.lit(6), F.length(one) - 6)  # the text as a JSON string
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("  ").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(" end ").alias("text"))))
    kind = F.col("turn") % 3
    content = F.when(kind == 0, plain).when(kind == 1, parts).otherwise(F.lit("[]"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.answer_text(content).alias("answer"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'model: 503, retrying (' || (event_id % 5) || ' left)' WHEN 1 THEN 'model: connection timed out, retrying (1 left)' WHEN 2 THEN 'model: error, retrying (2 left)' END AS line FROM events")
def t13_retry_log(spark, d):
    k = F.col("event_id") % 4
    message = F.when(k == 0, F.concat(F.lit("[req] failed with status 503, retrying, "), (F.col("event_id") % 5).cast("string"), F.lit(" attempts remaining"))).when(k == 1, "connection timed out; retrying, 1 attempt remaining").when(k == 2, "odd - retrying, 2 attempts remaining").otherwise("sending request")
    return read(spark, d, "events").select("event_id", T.retry_log_line(F.lit("model"), message).alias("line"))


@query("SELECT page_id, url || ' +x' AS decoded FROM pages")
def t16_uri_decode(spark, d):
    return read(spark, d, "pages").select("page_id", T.uri_decode(F.concat(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("%20+x"))).alias("decoded"))


@query("SELECT conv_id, turn, CASE length(coalesce(text, '')) % 4 WHEN 0 THEN CAST(400 + length(text) % 150 AS VARCHAR) WHEN 1 THEN role ELSE left(coalesce(text, 'unknown error'), 60) END AS reason FROM conversations")
def t20_short_reason(spark, d):
    """A status, a code or the turn's own text, by its length."""
    n = F.length(F.coalesce("text", F.lit("")))
    return read(spark, d, "conversations").select("conv_id", "turn", retry.short_reason(F.when(n % 4 == 0, 400 + F.length("text") % 150), F.when(n % 4 == 1, F.array(F.lit(None).cast("string"), F.col("role"))), F.col("text")).alias("reason"))


@query("SELECT conv_id, turn, coalesce(CASE WHEN length(text) % 3 > 0 THEN text END, 'unknown error') AS said FROM conversations")
def t12_describe_error(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.describe_error(F.when(F.length("text") % 3 > 0, F.col("text"))).alias("said"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang || '_' || doc_id END AS profile FROM documents")
def t19_profile(spark, d):
    return read(spark, d, "documents").select("doc_id", T.profile(F.when(F.col("doc_id") % 4 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("  "), "lang", F.lit("_"), F.col("doc_id").cast("string")))).alias("profile"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'bash' WHEN 2 THEN 'constructor' ELSE 'rust' END AS language FROM pages")
def j8_language(spark, d):
    k = F.col("page_id") % 4
    return read(spark, d, "pages").select("page_id", T.language(F.when(k == 0, "py").when(k == 1, "sh").when(k == 2, "constructor").otherwise("rs"), T.LANGUAGE_ALIASES).alias("language"))


@query("SELECT event_id, CAST(CASE WHEN x IS NULL OR x <= 0 THEN 600000 ELSE floor(x) END AS BIGINT) AS ms FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN -value ELSE value * 10 END AS x FROM events)")
def n11_timeout(spark, d):
    k = F.col("event_id") % 5
    return read(spark, d, "events").select("event_id", fmt.timeout_ms(F.when(k == 1, -F.col("value")).when(k > 1, F.col("value") * 10)).alias("ms"))


@query("""WITH e AS (SELECT doc_id, lang, CASE WHEN length(coalesce(text, '')) % 5 = 1 THEN overlay_ ELSE coalesce(text, '') END AS said FROM (SELECT *, left(coalesce(text, ''), CAST(doc_id % 40 AS INTEGER)) || 'TimeOut' || substr(coalesce(text, ''), CAST(doc_id % 40 AS INTEGER) + 1) AS overlay_ FROM documents))
SELECT doc_id, lang = 'fr' OR contains(lower(said), 'timeout') AS timeout FROM e""")
def f20_timeout(spark, d):
    """Whole texts as messages, some with the word at some place; one language stands for calls that were given up."""
    t = F.coalesce("text", F.lit(""))
    at = (F.col("doc_id") % 40).cast("int")
    message = F.when(F.length(t) % 5 == 1, F.concat(F.substring(t, F.lit(1), at), F.lit("TimeOut"), F.substring(t, at + 1, F.length(t)))).otherwise(t)
    return read(spark, d, "documents").select("doc_id", retry.is_timeout(F.when(F.col("lang") == "fr", "AbortError").otherwise(F.col("lang")), message).alias("timeout"))


_NUMBERED = r"n AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS book_id, CAST(row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) ORDER BY page_id) AS BIGINT) AS ord FROM pages)"


def _numbered(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("book_id"))
    return pages.withColumn("ord", F.row_number().over(Window.partitionBy("book_id").orderBy("page_id")).cast("bigint"))


@query(f"WITH {_NUMBERED} SELECT book_id, ord, page_id FROM n WHERE ord NOT IN (0, 1, 3, 4, 99)")
def f5_excluded(spark, d):
    excluded = spark.createDataFrame([(n,) for n in selectors.parse_exclude(" 1, 3-4,99,0")], "ord bigint")
    return _numbered(spark, d).join(F.broadcast(excluded), "ord", "left_anti").select("book_id", "ord", "page_id")


@query(f"WITH {_NUMBERED} SELECT book_id, CAST(i AS BIGINT) AS ord, CAST(a AS BIGINT) AS \"start\", CAST(b AS BIGINT) AS \"end\", count(*) AS pages FROM n JOIN (VALUES (1, 1, 2), (2, 3, 4), (3, 5, 80)) r(i, a, b) ON n.ord BETWEEN a AND b GROUP BY ALL")
def s9_inline_ranges(spark, d):
    ranges = selectors.ranges_table(spark, selectors.parse_index_ranges(" 1-2, 3 - 4,5-80")).drop("book_id", "title")
    numbers = ranges.withColumn("page_no", F.explode(F.sequence("start", "end")))
    met = _numbered(spark, d).withColumnRenamed("ord", "page_no").join(F.broadcast(numbers), "page_no")
    return met.groupBy("book_id", *[F.col(c).cast("bigint").alias(c) for c in ("ord", "start", "end")]).agg(F.count(F.lit(1)).alias("pages"))


@query("WITH b AS (SELECT source || '/' || lang AS book_id, count(*) AS n FROM documents GROUP BY ALL) SELECT book_id, n - 1 AS extracted_sections, CAST(3 AS BIGINT) AS filtered_sections FROM b WHERE n > 1")
def a6_update_metadata(spark, d):
    docs = read(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("book_id"), "doc_id")
    s = docs.withColumn("index", F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id")))
    books = s.groupBy("book_id").agg(F.count(F.lit(1)).alias("extracted_sections")).where("extracted_sections > 1").withColumn("filtered_sections", F.lit(2).cast("bigint"))
    out = edits.recount(books, edits.delete_section(s, 1), 1)
    return out.select("book_id", F.col("extracted_sections").cast("bigint").alias("extracted_sections"), F.col("filtered_sections").cast("bigint").alias("filtered_sections"))


@query("SELECT conv_id, CAST(n AS BIGINT) AS count, CASE WHEN n > 0 THEN last END AS title FROM (SELECT conv_id, least(count(*), 3) AS n, max_by(role, turn) AS last FROM conversations GROUP BY conv_id)")
def m3_undo_summary(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), F.lit(0).cast("bigint").alias("timestamp")))).alias("turns"))  # a conversation is a book in size
    items = F.transform("turns", lambda x: F.struct(x["title"].alias("title"), x["timestamp"].alias("timestamp")))
    stack = F.aggregate(items, F.array().cast("array<struct<title:string,timestamp:bigint>>"), lambda a, x: edits.push(a, x, 3))
    s = turns.select("conv_id", edits.undo_summary(stack).alias("u"))
    return s.select("conv_id", F.coalesce(F.col("u.count"), F.lit(0)).cast("bigint").alias("count"), F.col("u.section_title").alias("title"))


@query(f"WITH {_NUMBERED} SELECT n.book_id, n.ord, CASE WHEN n.page_id % 2 = 0 THEN 'T ' || n.page_id ELSE 'Section ' || n.ord END AS title, {_html('html')} AS text FROM n JOIN pages USING (page_id)")
def p5_chapter_titles(spark, d):
    from quire.sources.books import chapters

    raw = _numbered(spark, d).join(read(spark, d, "pages").select("page_id", "html"), "page_id")
    raw = raw.withColumns({"title": F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T "), F.col("page_id").cast("string"))).otherwise(F.lit(" ")), "error": F.lit(None).cast("string")})
    return chapters(raw).select("book_id", "ord", "title", "text")


@query(f"WITH {_PAGES}, b AS (SELECT book_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page_no) AS raw FROM p GROUP BY book_id) SELECT book_id, CAST(1 AS BIGINT) AS index, replace(book_id, '.pdf', '') AS title, {_trim('raw')} AS text FROM b WHERE CAST(regexp_extract(book_id, '[0-9]+') AS INT) % 2 = 0 AND {_trim('raw')} <> ''")
def a9_raw_text(spark, d):
    """All turns of a conversation as the raw text of a book; every second one has a section already."""
    pages = _conversation_pages(spark, d)
    raw = pages.groupBy("book_id").agg(assemble.ordered_concat("page_no", F.coalesce("text", F.lit("")), "\n").alias("raw_text")).withColumn("file_name", F.col("book_id"))
    odd = raw.where(F.regexp_extract("book_id", "[0-9]+", 0).cast("int") % 2 == 1).select("book_id", F.lit(1).alias("index"))
    return assemble.raw_text_sections(raw, odd).withColumn("index", F.col("index").cast("bigint"))


@query(f"WITH {_PAGES} SELECT book_id, CAST(page_no AS BIGINT) AS page_no, {_trim(_RUNS)} AS text FROM p")
def o1_reading_order(spark, d):
    pages = _conversation_pages(spark, d)
    run = lambda x, y, t: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.array(F.struct(t.alias("T"))).alias("R"))
    first = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("+"))
    runs = F.array(run(9.0, 1.09, F.lit("a")), run(2.0, 1.04, F.lit("b")), run(3.0, 1.04, F.lit("")), run(0.0, 1.0, first))
    out = assemble.pages_from_runs(pages.select("book_id", "page_no", runs.alias("runs")))
    return out.select("book_id", F.col("page_no").cast("bigint").alias("page_no"), "text")


@query(f"WITH {_ISSUES} SELECT CAST(conv_id AS VARCHAR) AS book_id, turn AS section_index, 'Markdown validation failed:' || chr(10) || string_agg(ord || '. ' || message || lines, chr(10) ORDER BY ord) AS report FROM o GROUP BY conv_id, turn")
def a10_issue_report(spark, d):
    found = cards.issue_table(_answers(spark, d))
    line = F.concat(F.col("ord").cast("string"), F.lit(". "), "message", F.when(F.size("lines") > 0, F.concat(F.lit(" (lines "), F.array_join(F.col("lines").cast("array<string>"), ", "), F.lit(")"))).otherwise(""))
    out = found.groupBy("book_id", "section_index").agg(assemble.ordered_concat("ord", line, "\n").alias("lines"))
    return out.select("book_id", F.col("section_index").cast("bigint").alias("section_index"), F.concat(F.lit("Markdown validation failed:\n"), "lines").alias("report"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS sections, CAST(min(CASE WHEN role = 'user' OR text IS NULL THEN turn + 1 END) AS BIGINT) AS position FROM conversations GROUP BY conv_id")
def f16_first_fault(spark, d):
    c = read(spark, d, "conversations")
    s = c.select(F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("ord"), (F.col("turn") + 1).cast("double").alias("index"), F.when(F.col("role") != "user", F.col("role")).alias("title"), "text")
    first = validate.violations(s).select("book_id", F.col("position").cast("bigint").alias("position"))
    return s.groupBy("book_id").agg(F.count(F.lit(1)).alias("sections")).join(first, "book_id", "left").withColumnRenamed("book_id", "conv_id")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'epub' ELSE 'pdf' END AS kind FROM pages")
def s2_file_type(spark, d):
    k = F.col("page_id") % 3
    path = F.concat(F.col("page_id").cast("string"), F.when(k == 0, ".PDF").when(k == 1, ".bin").otherwise(".pdf"))
    return read(spark, d, "pages").select("page_id", meta.file_type(path, F.when(k == 1, " Application/EPUB+zip ").when(k == 2, "what")).alias("kind"))


@query(f"WITH t AS (SELECT conv_id, turn, {_clean('text')} AS c FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS book_id, CAST(count(*) AS BIGINT) AS cards, '# Deck' || chr(10) || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || '- ' || c, chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM t JOIN conversations USING (conv_id, turn) WHERE c <> '' GROUP BY conv_id")
def k2_deck(spark, d):
    clean = T.clean_text(F.col("text"))
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("section_index"), F.lit(1).alias("card_ord"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("heading_text"), F.lit("").alias("front_body"), F.concat(F.lit("- "), clean).alias("back"), F.lit(False).alias("has_separator")).where("back <> '- '")
    return cards.deck_markdown(c).select("book_id", F.col("cards").cast("bigint").alias("cards"), "markdown")


@query("SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY index) AS BIGINT) AS place, index FROM (SELECT source AS book_id, doc_id AS index FROM documents)")
def w5_positions(spark, d):
    s = read(spark, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("index"))
    return summary.selection(s).select("book_id", F.col("place").cast("bigint").alias("place"), "index")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'matches filter pattern: ' || lang ELSE NULL END AS reason FROM documents")
def j4_string_rules(spark, d):
    rules = [{"type": "string", "value": x} for x in ("en", "de", "fr", "es")] + [{"type": "string", "value": " "}]
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit("\t"))).otherwise(F.concat("lang", F.lit("x")))
    return read(spark, d, "documents").select("doc_id", filters.title_reason(title, rules).alias("reason"))
