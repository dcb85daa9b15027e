"""The registered queries of the document-section engine, each with the SQL that it is held against.

Driver tables stand in for the engine's: pages of one host are a book's chapters, a conversation is a PDF whose turns
are pages, documents of one source are a book's sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import fmt
from quire.functions import text as T
from quire.operators import assemble, cards, edits, filters, meta, retry, selectors, summary, validate

#: The default title rules and one that generated titles do match.
RULES = [*filters.DEFAULT_TITLE_RULES, {"type": "regex", "pattern": r"^the\s+and\s+.+$", "flags": "i"}, {"type": "string", "value": "Contents"}]
FIRST, LAST, EXCLUDED, MIN_CHARS = 2, 40, [3, 5], 300
INDEX = [(1, 2, "Opening"), (3, 4, "  "), (5, 8, "Rest")]
EDITED = 3

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


W = T.RE2_WS


def _clean(c: str) -> str:
    return f"trim(regexp_replace(replace(replace(coalesce({c}, ''), chr(0), ''), chr(13), ''), '{W}+', ' ', 'g'))"


def _html(c: str) -> str:
    s = f"coalesce({c}, '')"
    for tag in ("script", "style"):
        s = f"regexp_replace({s}, '<{tag}[^>]*>.*?</{tag}>', '', 'gi')"
    s = f"regexp_replace({s}, '<[^>]*>', '', 'g')"
    for name, value in T.ENTITIES:
        s = f"replace({s}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({s}, '{W}+', ' ', 'g'))"


def _groups(c: str) -> str:
    return f"replace(format('{{:,}}', {c}), ',', ' ')"


def _rules_sql(title: str) -> str:
    lower = f"trim(lower({title}))"
    out = []
    for r in RULES:
        if r["type"] == "regex":
            out.append(f"WHEN regexp_matches({lower}, '(?i)' || '{r['pattern'].replace(chr(39), chr(39) * 2)}') THEN 'matches filter pattern: {r['pattern'].replace(chr(39), chr(39) * 2)}'")
        else:
            out.append(f"WHEN {lower} = '{r['value'].lower()}' THEN 'matches filter pattern: {r['value']}'")
    return "CASE WHEN coalesce(" + title + ", '') = '' THEN NULL " + " ".join(out) + " END"


_HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_TITLE = "regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)"
_CHAPTERS = f"""
chapters AS (
  SELECT {_HOST} AS book_id, CAST(row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS BIGINT) AS ord,
    {_TITLE} AS title, {_html('html')} AS text FROM pages
), marked AS (
  SELECT *, CASE WHEN ord NOT BETWEEN {FIRST} AND {LAST} THEN 'outside range {FIRST}-{LAST}'
    WHEN ord IN ({', '.join(map(str, EXCLUDED))}) THEN 'excluded by --exclude-sections'
    WHEN trim(text) = '' THEN 'empty content'
    WHEN length(text) < {MIN_CHARS} THEN 'below minimum characters: ' || {_groups('length(text)')} || ' < {MIN_CHARS}'
    ELSE {_rules_sql('title')} END AS filter_reason FROM chapters
)"""


def host_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host, in the order of page_id, as a book's chapters of clean text."""
    pages = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("book_id")
    # pages are numbered by their ids alone; texts meet the numbers and are not sorted
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("page_id"))
    numbers = pages.select(host, "page_id").select("page_id", n.alias("ord"))
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.join(numbers, "page_id").select(host, "ord", title.alias("title"), T.clean_html(F.col("html")).alias("text"))


def cascade() -> dict:
    return {"start": FIRST, "end": LAST, "excluded": EXCLUDED, "min_chars": MIN_CHARS, "rules": RULES}


@query(f"SELECT doc_id, {_clean('text')} AS clean FROM documents")
def t1_clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT page_id, {_html('html')} AS clean FROM pages")
def t3_clean_html(spark, d):
    return read(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("clean"))


@query(f"SELECT doc_id, CASE WHEN c = '' THEN '[empty]' WHEN length(c) <= 120 THEN c ELSE rtrim(left(c, 120)) || '...' END AS preview FROM (SELECT doc_id, {_clean('text')} AS c FROM documents)")
def t4_preview(spark, d):
    return read(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(f"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim({_TITLE})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'deck') AS slug FROM pages")
def t5_kebab(spark, d):
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return read(spark, d, "pages").select("page_id", T.kebab(title).alias("slug"))


_SECRET = "coalesce(text, '') || ' Bearer  abc.def sk-' || lpad(CAST(doc_id AS VARCHAR), 14, '0') || ' openai_api_key=x' || CAST(doc_id AS VARCHAR) || ' end'"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_SECRET}, '(Bearer{W}+)[A-Za-z0-9._-]+', '\1[redacted]', 'gi'), '\bsk-[A-Za-z0-9_-]{{12,}}\b', '[redacted-api-key]', 'g'), '((?:CODEX|OPENAI)_API_KEY=)\S+', '\1[redacted]', 'gi') AS redacted FROM documents")
def t8_redact(spark, d):
    secret = F.concat(F.coalesce("text", F.lit("")), F.lit(" Bearer  abc.def sk-"), F.lpad(F.col("doc_id").cast("string"), 14, "0"), F.lit(" openai_api_key=x"), F.col("doc_id").cast("string"), F.lit(" end"))
    return read(spark, d, "documents").select("doc_id", T.redact(secret).alias("redacted"))


@query(r"SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '[^/](\.[^./]*)$', 1) AS extension, 'GEMINI_API_KEY' AS env FROM pages")
def t17_url_extension(spark, d):
    return read(spark, d, "pages").select("page_id", T.url_extension(F.col("url")).alias("extension"), T.env_var(F.lit("gemini")).alias("env"))


@query("SELECT doc_id, CASE WHEN n_chars * 997 < 1048576 THEN format('{:.1f} KB', floor(n_chars * 997 / 1024.0 * 10 + 0.5) / 10) ELSE format('{:.2f} MB', floor(n_chars * 997 / 1048576.0 * 100 + 0.5) / 100) END AS size FROM documents")
def n1_file_size(spark, d):
    return read(spark, d, "documents").select("doc_id", fmt.file_size(F.col("n_chars") * 997).alias("size"))


@query(f"SELECT doc_id, {_groups('n_chars * 12345')} AS spaced, format('{{:,}}', n_chars * 12345) AS counted, lpad(CAST(doc_id % 1000 AS VARCHAR), 4, ' ') || '.' AS label FROM documents")
def n2_groups(spark, d):
    n = F.col("n_chars") * 12345
    return read(spark, d, "documents").select("doc_id", fmt.number_groups(n).alias("spaced"), fmt.count(n).alias("counted"), fmt.chapter_label(F.col("doc_id") % 1000, F.lit(1000)).alias("label"))


# real ties of the decimal form, at multiples of 125 ms, go up; all others go by the double
_MS = "SELECT event_id, CAST(round(value * 1000) AS BIGINT) + event_id % 1000 AS ms FROM events"


@query(f"SELECT event_id, format('{{:.2f}}s', CASE WHEN ms % 125 = 0 THEN floor(ms / 10 + 0.5) / 100 ELSE ms / 1000.0::DOUBLE END) AS duration, lpad(CAST(s // 60 AS VARCHAR), CAST(greatest(2, length(CAST(s // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT *, CAST(floor(ms / 1000.0::DOUBLE + 0.5) AS BIGINT) AS s FROM ({_MS}))")
def n4_duration(spark, d):
    ms = F.round(F.col("value") * 1000) + F.col("event_id") % 1000
    return read(spark, d, "events").select("event_id", fmt.duration(ms).alias("duration"), fmt.clock(ms).alias("clock"))


@query(f"SELECT page_id, {_rules_sql(_TITLE)} AS reason FROM pages")
def f8_title_rules(spark, d):
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return read(spark, d, "pages").select("page_id", filters.title_reason(title, RULES).alias("reason"))


@query(f"WITH {_CHAPTERS} SELECT book_id, ord, title, filter_reason FROM marked")
def f10_reason(spark, d):
    return filters.with_reason(host_chapters(spark, d), **cascade()).select("book_id", F.col("ord").cast("bigint").alias("ord"), "title", "filter_reason")


@query(f"WITH {_CHAPTERS} SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY ord) AS BIGINT) AS index, title, text, ord AS original_chapter_index FROM marked WHERE filter_reason IS NULL")
def w2_reindex(spark, d):
    out = assemble.chapters_to_sections(host_chapters(spark, d), **cascade())
    return out.select("book_id", F.col("index").cast("bigint").alias("index"), "title", "text", F.col("original_chapter_index").cast("bigint").alias("original_chapter_index"))


@query(f"WITH {_CHAPTERS} SELECT book_id, count(*) AS total, count(*) FILTER (WHERE filter_reason IS NULL) AS extracted_sections, count(*) FILTER (WHERE filter_reason IS NOT NULL) AS filtered_sections FROM marked GROUP BY book_id")
def a5_counters(spark, d):
    return meta.counters(filters.with_reason(host_chapters(spark, d), **cascade()))


@query(f"WITH {_CHAPTERS} SELECT book_id, index, text FROM (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY ord) AS index, {_clean('text')} AS text FROM marked WHERE filter_reason IS NULL)")
def p1_minimal(spark, d):
    out = assemble.clean_sections(assemble.chapters_to_sections(host_chapters(spark, d), **cascade()))
    return out.select("book_id", F.col("index").cast("bigint").alias("index"), "text")


def _conversation_pages(spark, d):
    return read(spark, d, "conversations").select(F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("book_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text")


def _index(spark, d):
    books = read(spark, d, "conversations").select(F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("book_id")).distinct()
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("title")) for i, (a, b, t) in enumerate(INDEX, 1)])
    return books.select("book_id", F.explode(rows).alias("x")).select("book_id", "x.*")


_PAGES = "p AS (SELECT 'conv' || conv_id || '.pdf' AS book_id, turn + 1 AS page_no, text FROM conversations), totals AS (SELECT book_id, max(page_no) AS total FROM p GROUP BY 1), idx(ord, s, e, title) AS (VALUES " + ", ".join(f"({i}, {a}, {b}, '{t}')" for i, (a, b, t) in enumerate(INDEX, 1)) + ")"


@query(f"WITH {_PAGES} SELECT book_id, CAST(ord AS BIGINT) AS index, CASE WHEN trim(title) = '' THEN 'Section ' || ord ELSE trim(title) END AS title, string_agg(trim(text), chr(10) || chr(10) ORDER BY page_no) AS text, s || '-' || e AS page_range, CAST(e - s + 1 AS BIGINT) AS page_count FROM p JOIN totals USING (book_id) JOIN idx ON page_no BETWEEN s AND e AND e <= total WHERE trim(coalesce(text, '')) <> '' GROUP BY book_id, ord, s, e, title")
def j1_index_join(spark, d):
    out = assemble.by_index(_conversation_pages(spark, d), _index(spark, d))
    return out.withColumns({"index": F.col("index").cast("bigint"), "page_count": F.col("page_count").cast("bigint")})


@query(f"WITH {_PAGES} SELECT book_id, 1::BIGINT AS index, replace(book_id, '.pdf', '') AS title, string_agg(trim(text), chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE trim(coalesce(text, '')) <> '') AS text, '1-' || max(page_no) AS page_range, CAST(max(page_no) AS BIGINT) AS page_count, count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') AS processed_pages FROM p GROUP BY book_id HAVING count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') > 0")
def a2_single_text(spark, d):
    out = assemble.whole_book(_conversation_pages(spark, d))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("index", "page_count", "processed_pages")})


@query(f"WITH {_PAGES} SELECT book_id, CAST(sum(e - s + 1) AS BIGINT) AS pages FROM totals, idx GROUP BY book_id")
def a4_index_pages(spark, d):
    return assemble.index_pages(_index(spark, d))


_PDF_SECTIONS = f"WITH {_PAGES}, sec AS (SELECT book_id, ord AS index, string_agg(trim(text), chr(10) || chr(10) ORDER BY page_no) AS text FROM p JOIN totals USING (book_id) JOIN idx ON page_no BETWEEN s AND e AND e <= total WHERE trim(coalesce(text, '')) <> '' GROUP BY book_id, ord)"


@query(_PDF_SECTIONS + ", m AS (SELECT *, length(text) < 400 AS short, count(*) FILTER (WHERE length(text) < 400) OVER (PARTITION BY book_id) AS dropped FROM sec) SELECT book_id, CAST(CASE WHEN dropped > 0 THEN row_number() OVER (PARTITION BY book_id ORDER BY index) ELSE index END AS BIGINT) AS index, text, CAST(dropped AS BIGINT) AS dropped FROM m WHERE NOT short")
def f11_min_chars(spark, d):
    out = filters.min_chars(assemble.by_index(_conversation_pages(spark, d), _index(spark, d)), 400)
    return out.select("book_id", F.col("index").cast("bigint").alias("index"), "text", "dropped")


@query(_PDF_SECTIONS + ", n AS (SELECT book_id, count(*) AS c FROM sec GROUP BY 1) SELECT book_id, replace(book_id, '.pdf', '') AS title, 'Unknown Author' AS author, CAST(total AS BIGINT) AS \"totalPages\", CAST(8 AS BIGINT) AS \"extractedPages\", coalesce(c, 0)::BIGINT AS \"extractedSections\", 'Chapters 1-3' AS \"extractedRange\", 'pdf-parse-with-index' AS \"processingMethod\" FROM totals LEFT JOIN n USING (book_id)")
def p2_pdf_meta(spark, d):
    pages, idx = _conversation_pages(spark, d), _index(spark, d)
    counts = assemble.by_index(pages, idx).groupBy("book_id").agg(F.count(F.lit(1)).alias("extracted"))
    books = pages.groupBy("book_id").agg(F.max("page_no").alias("total")).join(counts, "book_id", "left").join(idx.groupBy("book_id").agg(F.count(F.lit(1)).alias("index_size")), "book_id").join(assemble.index_pages(idx).withColumnRenamed("pages", "index_pages"), "book_id")
    none = F.lit(None).cast("string")
    books = books.withColumns({"file_name": F.col("book_id"), "info": F.create_map(F.lit("Title"), F.lit("  ")), "meta_title": none, "meta_author": none, "version": none, "extracted": F.coalesce("extracted", F.lit(0))})
    out = meta.pdf_metadata(books)
    return out.select("book_id", "title", "author", *[F.col(c).cast("bigint").alias(c) for c in ("totalPages", "extractedPages", "extractedSections")], "extractedRange", "processingMethod")


@query(f"WITH {_CHAPTERS} SELECT book_id, book_id AS title, 'Unknown Author' AS author, 'xx' AS language, 'Unknown Date' AS date, count(*) AS \"totalPages\", CAST({LAST} - {FIRST} + 1 AS BIGINT) AS \"extractedPages\", count(*) FILTER (WHERE filter_reason IS NULL) AS \"extractedSections\", count(*) FILTER (WHERE filter_reason IS NOT NULL) AS \"filteredSections\", 'Chapters {FIRST}-{LAST}' AS \"extractedRange\" FROM marked GROUP BY book_id")
def p3_epub_meta(spark, d):
    c = meta.counters(filters.with_reason(host_chapters(spark, d), **cascade()))
    none = F.lit(None).cast("string")
    books = c.select("book_id", F.concat("book_id", F.lit(".epub")).alias("file_name"), F.lit("").alias("title"), none.alias("creator"), none.alias("publisher"), F.lit("").alias("date"), F.lit("xx").alias("language"), none.alias("isbn"), "total", F.lit(FIRST).alias("first"), F.lit(LAST).alias("last"), F.col("extracted_sections").alias("extracted"), F.col("filtered_sections").alias("filtered"))
    return meta.epub_metadata(books).select("book_id", "title", "author", "language", "date", "totalPages", F.col("extractedPages").cast("bigint").alias("extractedPages"), "extractedSections", "filteredSections", "extractedRange")


_SECTIONS = "s AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS index, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || ' ' || doc_id END AS title, text FROM documents)"


def _source_sections(spark, d):
    docs = read(spark, d, "documents")
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select(F.col("source").alias("book_id"), n.alias("index"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat("lang", F.lit(" "), F.col("doc_id").cast("string"))).alias("title"), "text")


_SHELF = "s AS (SELECT source || '/' || (doc_id // 100) AS book_id, row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) AS index, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || ' ' || doc_id END AS title, text FROM documents)"


@query(f"WITH {_SHELF} SELECT book_id, trim(string_agg(CASE WHEN title <> '' THEN index || '. ' || title ELSE 'Section ' || index END || CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || text END, chr(10) || chr(10) ORDER BY index), E' \\n\\t\\r') AS plain FROM s GROUP BY book_id")
def a7_plain_text(spark, d):
    """A book is what a source has among a hundred ids, so that its text stays a book in size."""
    docs = read(spark, d, "documents").withColumn("book_id", F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string")))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id"))
    s = docs.select("book_id", n.alias("index"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat("lang", F.lit(" "), F.col("doc_id").cast("string"))).alias("title"), "text")
    return assemble.plain_text(s)


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query("""WITH w AS (SELECT conv_id * 1000 + turn AS ord, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS ws FROM conversations)
SELECT CAST(min(ord) AS BIGINT) AS ord, type, value, pattern, flags FROM (
  SELECT ord, CASE WHEN len(ws) % 2 = 0 THEN 'string' ELSE 'regex' END AS type, CASE WHEN len(ws) % 2 = 0 THEN ws[1] END AS value, CASE WHEN len(ws) % 2 = 1 THEN ws[2] END AS pattern, CASE WHEN len(ws) % 3 = 1 THEN 'i' END AS flags FROM w)
GROUP BY type, value, pattern, flags""")
def a11_rule_distinct(spark, d):
    """Words of turns as rules, many of them alike."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), 0)
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), words.alias("ws"))
    n = F.size("ws")
    rules = turns.select("ord", F.when(n % 2 == 0, "string").otherwise("regex").alias("type"), F.when(n % 2 == 0, F.get("ws", F.lit(0))).alias("value"), F.when(n % 2 == 1, F.get("ws", F.lit(1))).alias("pattern"), F.when(n % 3 == 1, "i").alias("flags"))
    return filters.distinct_rules(rules).select(F.col("ord").cast("bigint").alias("ord"), "type", "value", "pattern", "flags")


_RANGES = "r AS (SELECT l_orderkey AS book_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, l_partkey % 50 + 1 AS s, l_partkey % 50 + 1 + CAST(l_quantity AS INT) % 5 AS e FROM lineitem)"


def _line_ranges(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    start = F.col("l_partkey") % 50 + 1
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), n.alias("ord"), start.alias("start"), (start + F.col("l_quantity").cast("int") % 5).alias("end"))


@query(f"WITH {_RANGES}, l AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM r WINDOW w AS (PARTITION BY book_id ORDER BY ord)), m AS (SELECT book_id, ord, CASE WHEN s > e THEN 'Index ranges entry ' || ord || ' has start page ' || s || ' greater than end page ' || e || '.' WHEN s < ps THEN 'Index ranges entries must be sorted by start page in ascending order.' WHEN s <= pe THEN 'Index ranges entries ' || (ord - 1) || ' and ' || ord || ' overlap on pages ' || s || '-' || least(pe, e) || '.' END AS message FROM l) SELECT book_id, min(ord) AS ord, arg_min(message, ord) AS message FROM m WHERE message IS NOT NULL GROUP BY book_id")
def w3_index_check(spark, d):
    return selectors.index_issues(_line_ranges(spark, d)).withColumn("ord", F.col("ord").cast("bigint"))


@query(f"WITH {_RANGES} SELECT a.book_id, a.ord AS left_index, b.ord AS right_index, a.s || '-' || a.e AS left_range, b.s || '-' || b.e AS right_range, greatest(a.s, b.s) AS overlap_start, least(a.e, b.e) AS overlap_end, CASE WHEN greatest(a.s, b.s) = least(a.e, b.e) THEN 'page ' || greatest(a.s, b.s) ELSE 'pages ' || greatest(a.s, b.s) || '-' || least(a.e, b.e) END AS label FROM r a JOIN r b ON a.book_id = b.book_id AND a.ord < b.ord AND greatest(a.s, b.s) <= least(a.e, b.e)")
def j5_overlaps(spark, d):
    s = _line_ranges(spark, d).select("book_id", F.col("ord").alias("index"), F.lit("").alias("title"), F.format_string("%d-%d", "start", "end").alias("page_range"))
    out = summary.page_overlaps(s)
    return out.select("book_id", F.col("left_index").cast("bigint").alias("left_index"), F.col("right_index").cast("bigint").alias("right_index"), "left_range", "right_range", "overlap_start", "overlap_end", "label")


@query(f"WITH {_PAGES}, sec AS (SELECT book_id, ord AS index, CASE WHEN trim(title) = '' THEN 'Section ' || ord ELSE trim(title) END AS title, sum(length(trim(text))) + 2 * (count(*) - 1) AS n, s, e FROM p JOIN totals USING (book_id) JOIN idx ON page_no BETWEEN s AND e AND e <= total WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL) SELECT book_id, index::BIGINT AS index, '- ' || title || ' | pages: ' || s || '-' || e || ' (' || (e - s + 1) || ' pages) | chars: ' || format('{{:,}}', n::BIGINT) AS line FROM sec")
def p9_section_line(spark, d):
    return summary.section_line(assemble.by_index(_conversation_pages(spark, d), _index(spark, d))).withColumn("index", F.col("index").cast("bigint"))


@query(f"WITH {_SECTIONS} SELECT book_id, min(index) AS position, 'Section ' || min(index) || ' is missing required properties (index, title, or text)' AS error FROM s WHERE coalesce(title, '') = '' OR text IS NULL GROUP BY book_id")
def f15_validate(spark, d):
    out = validate.violations(_source_sections(spark, d).withColumn("ord", F.col("index")))
    return out.withColumn("position", F.col("position").cast("bigint"))


_DUP = "c AS (SELECT doc_id AS book_id, lang AS section, no AS card_ord, trim(line) AS heading FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents))"


@query(f"WITH {_DUP} SELECT book_id, heading, card_ord FROM (SELECT *, row_number() OVER (PARTITION BY book_id, section, heading ORDER BY card_ord) AS n FROM c WHERE heading <> '') WHERE n > 1")
def w4_duplicates(spark, d):
    """Every line of a document is a card front of its deck."""
    lines = read(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    c = lines.select(F.col("doc_id").alias("book_id"), F.col("lang").alias("section_index"), (F.col("no") + 1).cast("bigint").alias("card_ord"), F.trim("line").alias("heading_text"))
    return cards.duplicate_fronts(c).select("book_id", F.col("heading_text").alias("heading"), "card_ord")


@query(f"WITH {_SECTIONS} SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY index) AS index, title FROM s WHERE index <> {EDITED}")
def m1_delete(spark, d):
    return edits.delete_section(_source_sections(spark, d), EDITED).select("book_id", F.col("index").cast("bigint").alias("index"), "title")


@query(f"WITH {_SECTIONS} SELECT book_id, index, title FROM s")
def m2_undo(spark, d):
    s = _source_sections(spark, d)
    out = edits.undo_delete(edits.delete_section(s, EDITED), edits.deleted(s, EDITED, 0))
    return out.select("book_id", F.col("index").cast("bigint").alias("index"), "title")


@query("SELECT source, least(n, 3) AS size, CASE WHEN n > 0 THEN ids[n] END AS top, CASE WHEN n > 1 THEN ids[n - 1] END AS under FROM (SELECT source, list(doc_id ORDER BY doc_id) AS ids, count(*) AS n FROM documents GROUP BY source)")
def o3_undo_stack(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id")
    # a stack keeps its last three: each part of a source gives its largest, then the parts are put together
    of = lambda *by: Window.partitionBy(*by).orderBy(F.col("doc_id").desc())
    part = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    last = part.withColumn("n", F.row_number().over(of("source", "part"))).where("n <= 3").withColumn("n", F.row_number().over(of("source"))).where("n <= 3")
    ids = last.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    stack = F.aggregate("ids", F.array().cast("array<bigint>"), lambda a, x: edits.push(a, x, 3))
    s = ids.select("source", stack.alias("stack"))
    return s.select("source", F.size("stack").cast("bigint").alias("size"), edits.top(F.col("stack")).alias("top"), edits.top(edits.pop(F.col("stack"))).alias("under"))


@query("""WITH b AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, count(*) AS n FROM conversations GROUP BY conv_id), e AS (SELECT book_id, unnest(generate_series(1, n)) AS i FROM b)
SELECT book_id, '[' || chr(10) || string_agg('  { "start": ' || (3 * i - 2) || ', "end": ' || (3 * i) || ', "title": "Section ' || i || '" }', ',' || chr(10) ORDER BY i) || chr(10) || ']' || chr(10) AS template FROM e GROUP BY book_id""")
def k4_index_template(spark, d):
    """A template for each conversation, with as many entries as it has turns."""
    books = read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("book_id")).agg(F.count(F.lit(1)).cast("int").alias("count"))
    return selectors.format_templates(selectors.index_templates(books, 3))


_CODES = [*retry.TRANSIENT_CODES, "EOTHER", "ENOENT", "econnreset", ""]


@query(f"""WITH c AS (SELECT event_id, 380 + CAST(floor(value * 11) AS BIGINT) % 160 AS status, value, [{', '.join(f"'{c}'" for c in _CODES)}] AS codes FROM events),
t AS (SELECT *, codes[1 + CAST(floor(value * 100) AS BIGINT) % {len(_CODES)}] AS one, codes[1 + user % {len(_CODES)}] AS two FROM (SELECT c.*, user_id AS user FROM c JOIN events USING (event_id)))
SELECT event_id, CASE WHEN status % 3 = 0 THEN one IN ({', '.join(f"'{c}'" for c in retry.TRANSIENT_CODES)}) OR two IN ({', '.join(f"'{c}'" for c in retry.TRANSIENT_CODES)}) ELSE status IN (429, 500, 502, 503, 504) END AS transient FROM t""")
def f19_transient(spark, d):
    """Statuses and chains of two codes by the events' values and users."""
    codes = F.array(*[F.lit(c) for c in _CODES])
    status = 380 + F.floor(F.col("value") * 11) % 160
    chain = F.array(F.get(codes, (F.floor(F.col("value") * 100) % len(_CODES)).cast("int")), F.get(codes, (F.col("user_id") % len(_CODES)).cast("int")))
    return read(spark, d, "events").select("event_id", retry.is_transient(F.when(status % 3 != 0, status), chain).alias("transient"))


_BACK = "least(30000.0, 2000 * pow(2.0, event_id % 6))"


@query(f"SELECT event_id, {_BACK} AS backoff, CASE WHEN server > 120000 THEN NULL WHEN server IS NOT NULL THEN server ELSE floor({_BACK} / 2 + 0.25 * {_BACK} / 2 + 0.5) END AS delay FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 200 * 1000 AS DOUBLE) END AS server FROM events)")
def n7_backoff(spark, d):
    server = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 200 * 1000).cast("double"))
    attempt = F.col("event_id") % 6 + 1
    return read(spark, d, "events").select("event_id", retry.backoff_ms(attempt).alias("backoff"), retry.delay_ms(attempt, server, F.lit(0.25)).cast("double").alias("delay"))


_NOW_MS = 1445412480000  # Wed, 21 Oct 2015 07:28:00 GMT


@query(f"""WITH e AS (SELECT event_id, ts, value, CASE event_id % 5 WHEN 0 THEN CAST(round(abs(value), 2) AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN strftime(TIMESTAMP '2015-10-21 07:00:00' + to_seconds(CAST(floor(value * 20) AS BIGINT)), '%a, %d %b %Y %H:%M:%S GMT') END AS header FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(header AS DOUBLE) * 1000 WHEN 2 THEN CAST(greatest(0, epoch_ms(strptime(header, '%a, %d %b %Y %H:%M:%S GMT')) - {_NOW_MS}) AS DOUBLE) WHEN 3 THEN CAST(CAST(round(value, 1) AS VARCHAR) AS DOUBLE) * 1000 END AS wait FROM e""")
def n8_retry_after(spark, d):
    k, value = F.col("event_id") % 5, F.col("value")
    date = F.date_format(F.expr("timestamp_ntz'2015-10-21 07:00:00' + make_dt_interval(0, 0, 0, floor(value * 20))"), "EEE, dd MMM yyyy HH:mm:ss")
    header = F.when(k == 0, F.round(F.abs(value), 2).cast("string")).when(k == 1, F.col("event_type")).when(k == 2, F.concat(date, F.lit(" GMT")))
    message = F.when(k != 4, F.concat(F.lit('{"retryDelay" : "'), F.round(value, 1).cast("string"), F.lit('s"}')))
    return read(spark, d, "events").select("event_id", retry.retry_after_ms(header, message, F.lit(_NOW_MS)).cast("double").alias("wait"))


def _answers(spark, d):
    """A Markdown answer for each turn, made of all its lines: heads, bullets, empty bullets and prose by their lengths."""
    line = lambda x, i: F.when(F.length(x) % 4 == 0, F.concat(F.lit("## h"), (F.length(x) % 7).cast("string"))).when(F.length(x) % 4 == 1, F.concat(F.lit("- b"), i.cast("string"))).when((F.length(x) % 4 == 2) & (i % 2 == 0), "-").otherwise(F.concat(F.lit("p "), F.translate(x, "`~#*-+\r", "")))
    markdown = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("section_index"), markdown.alias("markdown"))


_ISSUES = """l AS (SELECT conv_id, turn, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k, length(unnest(string_split(coalesce(text, ''), chr(10)))) AS n FROM conversations),
m AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'head' WHEN n % 4 = 1 THEN 'bullet' WHEN n % 4 = 2 AND k % 2 = 1 THEN 'empty' ELSE 'prose' END AS kind FROM l),
c AS (SELECT *, count(*) FILTER (WHERE kind = 'head') OVER (PARTITION BY conv_id, turn ORDER BY k) AS card FROM m),
h AS (SELECT conv_id, turn, card, min(k) AS k, 'h' || min(n) FILTER (WHERE kind = 'head') % 7 AS front, count(*) FILTER (WHERE kind = 'bullet') AS bullets FROM c WHERE card > 0 GROUP BY ALL),
i AS (
  SELECT conv_id, turn, 1 AS class, k, 'Card "' || front || '" is missing bullet items' AS message, '' AS lines FROM h WHERE bullets = 0
  UNION ALL SELECT conv_id, turn, 2, k, 'Empty bullet item', ' (lines ' || k || ')' FROM c WHERE kind = 'empty'
  UNION ALL SELECT conv_id, turn, 3, k, 'Duplicate card front "' || front || '"', '' FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, front ORDER BY card) AS nth FROM h) WHERE nth > 1
  UNION ALL SELECT conv_id, turn, 4, 0, 'Content found before the first card front', '' FROM c WHERE k = 1 AND card = 0
  UNION ALL SELECT conv_id, turn, 5, 0, 'No flashcards detected (expected lines starting with "## ")', '' FROM c GROUP BY conv_id, turn HAVING max(card) = 0
), o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY class, k) AS ord, message, lines FROM i)"""


@query(f"WITH {_ISSUES} SELECT CAST(conv_id AS VARCHAR) AS book_id, turn AS section_index, ord, message FROM o")
def g4_policy(spark, d):
    out = cards.issue_table(_answers(spark, d))
    return out.select("book_id", F.col("section_index").cast("bigint").alias("section_index"), F.col("ord").cast("bigint").alias("ord"), "message")


def queries() -> dict:
    from quire.plans import deeper, more  # noqa: F401  their queries register themselves

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from quire.plans import deeper, more  # noqa: F401

    return dict(_sql)
