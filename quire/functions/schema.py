"""Schemas of the engine's tables."""

SECTION = "index int, title string, text string, page_range string, page_count int, processed_pages int, original_chapter_index int"
PAGES = "book_id string, page_no int, text string"
RAW_CHAPTERS = "book_id string, ord int, title string, html string, error string"
SECTIONS = f"book_id string, {SECTION}"
INDEX_RANGES = "book_id string, ord int, start int, end int, title string"
TITLE_RULES = "ord int, type string, value string, pattern string, flags string"
CARDS = "book_id string, section_index int, card_ord int, heading_text string, front_body string, back string, has_separator boolean"
ISSUES = "book_id string, section_index int, ord int, message string, lines array<int>"
METADATA = "title string, author string, fileType string, totalPages int, extractedPages int, extractedSections int, filteredSections int, extractedRange string, processingMethod string, hasIndex boolean, indexChapters int, creator string, producer string, creationDate string, modificationDate string, pdfVersion string, hasAcroForm boolean, hasXFA boolean, publisher string, date string, language string, isbn string"
BOOK = f"metadata struct<{', '.join(x.replace(' ', ':', 1) for x in METADATA.split(', '))}>, content array<struct<index:double,title:string,text:string,pageRange:string,pageCount:int,processedPages:int,originalChapterIndex:int>>"
RUNS = "array<struct<x:double,y:double,R:array<struct<T:string>>>>"
