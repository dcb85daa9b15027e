"""Files as data sources and files of chosen names."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not

from quire.plans import convert
from quire.sources import books, files


def epub(path, n=6, broken=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="c{k}.html" media-type="application/xhtml+xml"/>' for k in range(1, n + 1))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(1, n + 1))
        z.writestr("O/c.opf", f'<package xmlns="p" xmlns:dc="d"><metadata><dc:title>Book {os.path.basename(path)}</dc:title><dc:creator>Me</dc:creator></metadata><manifest>{items}<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{spine}</spine></package>')
        points = "".join(f'<navPoint><navLabel><text>Title {k}</text></navLabel><content src="c{k}.html"/></navPoint>' for k in range(1, n + 1))
        z.writestr("O/t.ncx", f'<ncx xmlns="n"><navMap>{points}</navMap></ncx>')
        for k in range(1, n + 1):
            if k not in broken:
                z.writestr(f"O/c{k}.html", f"<p>text of chapter {k}</p>")


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shelf")
    for i in range(5):
        epub(str(folder / f"b{i}.epub"), n=3 + i, broken={2} if i == 4 else ())
    return folder


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_epub_source_equals_the_reader(spark, shelf):
    files.register(spark)
    source = spark.read.format("epub").load(str(shelf / "*.epub"))
    cols = ["ord", "title", "html", "facts"]
    name = F.regexp_extract("book_id", r"([^/]+)$", 1)
    by_spark = books.read_epub_parts(spark, str(shelf / "*.epub"))
    assert rows(source.select(name, *cols)) == rows(by_spark.select(name, *cols))
    assert rows(source.where("ord > 0").select(name, "ord", "html")) == rows(books.read_epub(spark, str(shelf / "*.epub")).select(name, "ord", "html"))
    assert source.where("error is not null").select("ord").collect()[0]["ord"] == 2
    assert rows(source.where("ord between 2 and 3 and title like '%2'").select(name, "ord")) == [(f"b{i}.epub", 2) for i in range(5)]
    facts = source.where("ord = 0").select(*books.epub_facts(F.col("facts")))
    assert rows(facts.select("file_name", "title", "total")) == [(f"b{i}.epub", f"Book b{i}.epub", 3 + i) for i in range(5)]


def test_filters_are_pushed(spark, shelf):
    files.register(spark)
    source = spark.read.format("epub").load(str(shelf))
    plan = lambda: source.where((F.col("ord") >= 2) & (F.col("ord") < 4)).select("ord")._jdf.queryExecution().executedPlan().toString()
    assert ">= 2" not in plan() and "< 4" not in plan()  # the reader answers for them
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert ">= 2" in plan() and "< 4" in plan()
    files.register(spark)


def test_unread_chapters_and_files(shelf, monkeypatch):
    read = []

    class Counting(zipfile.ZipFile):
        def read(self, name, *a):
            read.append((os.path.basename(self.filename or ""), name))
            return super().read(name, *a)

    monkeypatch.setattr(books.zipfile, "ZipFile", Counting)
    reader = files.EpubReader({"path": str(shelf)})
    one = str(shelf / "b3.epub")
    left = list(reader.pushFilters([GreaterThan(("ord",), 1), LessThanOrEqual(("ord",), 4), Not(EqualTo(("ord",), 3)), In(("book_id",), (one,)), IsNotNull(("title",))]))
    assert left == [IsNotNull(("title",))]
    parts = reader.partitions()
    assert [p.files for p in parts] == [[one]]
    assert [(r[1], r[3]) for r in reader.read(parts[0])] == [(2, "<p>text of chapter 2</p>"), (4, "<p>text of chapter 4</p>")]
    assert [n for _, n in read] == ["META-INF/container.xml", "O/c.opf", "O/t.ncx", "O/c2.html", "O/c4.html"]  # each once, no other chapter


def test_tasks_have_a_bounded_size(shelf, monkeypatch):
    monkeypatch.setattr(files, "TASK_FILES", 2)
    assert [len(p.files) for p in files.EpubReader({"path": f"{shelf}/b*.epub"}).partitions()] == [2, 2, 1]
    assert [p.files for p in files.EpubReader({"path": f"{shelf}/none*.epub"}).partitions()] == [[]]
    with pytest.raises(FileNotFoundError):
        files.EpubReader({"path": f"{shelf}/none.epub"}).partitions()
    with pytest.raises(ValueError, match="path"):
        files.EpubReader({})


def test_conversion_by_one_read(spark, shelf):
    files.register(spark)
    source = spark.read.format("epub").load(str(shelf / "b3.epub"))
    one, two = convert.epub(spark, str(shelf / "b3.epub"), 2, 5, "3"), convert.epub(spark, "", 2, 5, "3", parts=source)
    for name in ("sections", "plain", "audit", "metadata"):
        a, b = getattr(one, name).drop("book_id"), getattr(two, name).drop("book_id")
        assert rows(a) == rows(b) and a.count()
    m = one.metadata.first()
    assert (m["title"], m["extractedSections"], m["filteredSections"]) == ("Book b3.epub", 3, 3)


def test_pdf_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.pdf").write_bytes("\f".join(f"page {k}" for k in range(i + 1)).encode())

    def extract(data):
        pages = data.decode().split("\f")
        return {"pages": pages, "text": " ".join(pages), "info": {"Title": "T", "PDFFormatVersion": "1.4", "IsAcroFormPresent": len(pages) > 1, "n": 3}, "metadata": {"_metadata": {"author": "A"}}}

    files.register(spark, extract)
    source = spark.read.format("pdf").load(str(tmp_path / "*.pdf"))
    name = F.regexp_extract("book_id", r"([^/]+)$", 1)
    assert rows(source.select(name, "page_no", "text", "facts")) == rows(books.read_pdf_parts(spark, str(tmp_path / "*.pdf"), extract).select(name, "page_no", "text", "facts"))
    assert rows(source.where("page_no > 0").select("text")) == rows(books.read_pdf(spark, str(tmp_path / "*.pdf"), extract).select("text"))
    facts = books.pdf_info(source.where("page_no = 0")).orderBy("file_name").collect()
    assert [(r["file_name"], r["info"], r["meta_author"], r["version"], r["total"], r["has_acro_form"], r["has_xfa"]) for r in facts] == [(f"p{i}.pdf", {"Title": "T", "PDFFormatVersion": "1.4"}, "A", "1.4", i + 1, i > 0, None) for i in range(3)]
    done = convert.pdf(spark, str(tmp_path / "*.pdf"), extract, store=str(tmp_path / "store"))
    assert sorted((r["title"], r["hasAcroForm"], r["hasXFA"]) for r in done.metadata.collect()) == [("T", False, False), ("T", True, False), ("T", True, False)]
