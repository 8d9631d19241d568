"""Web archives and main text."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import html_blocks, warc

ROWS = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages():
    tricky = "<p>été</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\n\n"
    rows = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, "http://a/9", "same"), (4, "http://a/4", None), (6, None, "")]
    return rows + [(7, "http://a/7\nx", tricky), (8, "http://a/8", "long " * 40_000), (10, "http://a/10", "\n"), (11, "http://a/11", "\r")]


def test_round_trip(spark, tmp_path):
    rows = pages()
    resolved = warc.resolve_revisits(spark.createDataFrame(rows, ROWS).withColumn("payload_digest", F.lit("mine")))
    path = f"file://{tmp_path}/out"
    warc.write_archives(resolved, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        assert got[i].payload_digest == digest(html) and got[i].payload_bytes == len((html or "").encode())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 3, 9: 3, 6: 4}
    files = [f for f in os.listdir(tmp_path / "out") if f.endswith(".gz")]
    text = b"".join(gzip.open(tmp_path / "out" / f).read() for f in files)
    assert text.count(b"WARC-Type: revisit") == 3 and text.count(b"long long") > 0
    assert text.count(b"\r\n\r\nsame\r\n\r\n") == 1  # a revisit has no payload


def test_smaller_payloads_are_no_revisits(spark):
    rows = warc.resolve_revisits(spark.createDataFrame(pages(), ROWS), min_bytes=5)
    assert rows.where("record_type = 'revisit'").count() == 0


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (1, "v", "x"), (None, "w", "x")]
    got = warc.resolve_revisits(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((str(r.page_id), r.url, r.record_type) for r in got) == [
        ("1", "u", "response"), ("1", "u", "response"), ("1", "v", "revisit"), ("None", "w", "revisit"),
    ]
    assert warc.resolve_revisits(spark.createDataFrame([], ROWS)).count() == 0


def test_damaged_archive_raises():
    with pytest.raises(ValueError):
        list(warc._records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))
    with pytest.raises(ValueError):
        list(warc._records(iter([b"nonsense\r\n\r\n"])))


LONG = "Some long text that goes on for a while, so that a window of it surges well beyond the least length."


@pytest.mark.parametrize("page, text", [
    (f"<nav>a</nav><article><h1>T &amp; <b>u</b>v</h1><p>{LONG}<br>x\n y</p><p>Z.</p></article><footer>f</footer>", f"T & uv {LONG} x y Z."),
    (f"<div class=menu>Home About</div><div><p>{LONG}</p><p>End.</p></div><div id='comments'><p>{LONG} {LONG}</p></div>", f"{LONG} End."),
    (f"<script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p><form><p>mail</p></form>", LONG),
    (f"<main><p>{LONG}</p><aside>side</aside><p>tail</p><div class='cookie-notice'>ok?</div></main>", f"{LONG} tail"),
    ("<p>tiny</p>", "tiny"),
    ("no markup at all: 1 < 2", "no markup at all: 1 < 2"),
    ("<script>only</script>", ""),
    (None, ""),
    ("", ""),
])
def test_main_text(page, text):
    assert html_blocks.main_text(page) == text


def test_link_lists_do_not_surge():
    menu = "".join(f"<li><a href='/{i}'>a rather long entry of a menu {i}</a></li>" for i in range(30))
    gap = "<div></div>"
    assert html_blocks.main_text(f"<ul>{menu}</ul><aside></aside>{gap}<p>{LONG}</p>") == LONG


def test_regions_surge_and_dive():
    assert html_blocks.regions([0, 5, 0, 0, 0, 60, 60, 1, 0, 0, 0, 2], 3, 86) == [(5, 10)]
    assert html_blocks.regions([]) == []


def test_extract_pages(spark):
    rows = [(1, "u", f"<article>{LONG}</article>", "x"), (2, None, None, "y"), (2, "v", "<p>é😀</p>", "z")]
    got = html_blocks.extract_pages(spark.createDataFrame(rows, ROWS + ", text string")).collect()
    assert {tuple(r) for r in got} == {(1, "u", LONG, len(LONG)), (2, None, "", 0), (2, "v", "é😀", 2)}
    assert html_blocks.extract_pages(spark.createDataFrame([], ROWS)).count() == 0


def test_long_unclosed_markup_ends():
    assert html_blocks.main_text("<a " * 20_000) == " ".join(["<a"] * 20_000)
    assert html_blocks.main_text("<div>" * 5_000 + "x") == "x"


@pytest.mark.parametrize("page, text", [
    (f"<p>{LONG}</p><div class=ad>x</div><p>Short end.</p>", f"{LONG} Short end."),
    (f"<p>{LONG}</p><div><div class=ad>x</div></div><p>Short end.</p>", f"{LONG} Short end."),
    (f"<nav>Home</nav><div class='sidebar-page'><p>{LONG}</p></div><footer>foot</footer>", LONG),
    (f"<form><div class=menu>Home page</div><p>{LONG}</p><p>End.</p></form><p>foot</p>", f"{LONG} End. foot"),
    (f"<div class='has-sidebar'><p>{LONG}</p></div><div><p>{LONG} {LONG} {LONG}</p></div>", " ".join([LONG] * 4)),
    (f"<article><p>{LONG}</p><section id='related-work'><h2 id='search-methods'>Search</h2><p>Older.</p></section></article>", f"{LONG} Search Older."),
    (f"<article><p>{LONG}</p><div class='related-posts'>More</div></article>", LONG),
    (f"<p>{LONG}</p><svg width='1' /><p>After.</p>", f"{LONG} After."),
    ("<nav>Home</nav><div class=menu>A menu.</div><footer>foot</footer>", "A menu."),
])
def test_no_article_text_is_lost(page, text):
    assert html_blocks.main_text(page) == text


LINKS = "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(6))


@pytest.mark.parametrize("page, text", [
    (f"<div><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><article><p>Teaser one</p></article><article><p>Teaser two</p></article>", f"{LONG} {LONG} End."),
    (f"<div><p>{LONG}</p></div><article class='comment'><p>{LONG} {LONG} {LONG}</p></article><p>{LONG}</p>" + f"<p>{LONG}</p>" * 4, " ".join([LONG] * 6)),
    (f"<main><article><h1><a href='/'>Title</a></h1><p>{LONG}</p></article><article class=comment><p>No.</p></article></main>", f"Title {LONG}"),
    (f"<article><p>{LONG}</p><ul>{LINKS}</ul><p>Short end.</p></article>", f"{LONG} entry 0 entry 1 Short end."),
    (f"<article><p>{LONG}</p></article><div><p>{LONG} A text beside it.</p></div>", LONG),
    (f"<article><ul>{LINKS}</ul></article>", " ".join(f"entry {i}" for i in range(6))),
])
def test_windows_run_on_pages_with_articles(page, text):
    assert html_blocks.main_text(page) == text
