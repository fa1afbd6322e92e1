"""WARC round trips and main text of pages."""

from __future__ import annotations

import gzip
import hashlib
import random
import time

import pytest

from sparkrisk.llm import html_text, warc

from .tables import words


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    long = words(60, 1)
    trap = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" * 4
    rows = [(5, "http://a/ x\r\ny", long), (3, None, long), (9, "http://b", long), (4, "u", None),
            (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (1, "u", trap), (2, "u", trap),
            (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "é" * 49), (13, "u", "é" * 49)]
    got = {r["page_id"]: r for r in warc.warc_round_trip(
        _pages(spark, rows).repartition(3)).collect()}
    source = {9: 3, 5: 3, 2: 1, 11: 10}
    for page, url, html in rows:
        r, raw = got[page], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"], r["url"], r["intact"]) == (
            len(raw), hashlib.sha256(raw).hexdigest(), url, True)
        assert r["refers_to"] == source.get(page)
        assert r["record_type"] == ("revisit" if page in source else "response")


def test_records_keep_payloads_and_are_assembled(spark, tmp_path):
    rows = [(k, f"http://h/{k}", words(40 + k % 3, k % 5)) for k in range(30)]
    path = str(tmp_path / "archive")
    warc.write_warc(_pages(spark, rows), path, pages_per_file=4)
    records = warc.read_warc(spark, path)
    assert records.count() == 90
    captures = warc.assemble(records).collect()
    assert len(captures) == 30
    held = {c["record_id"]: c["response"]["payload"] for c in captures
            if c["record_type"] == "response"}
    for c in captures:
        assert c["request"]["head"].startswith("GET http://h/")
        assert '"page_id"' in c["metadata"]["fields"]
        body = held[c["refers_to"] or c["record_id"]]
        assert hashlib.sha256(body).hexdigest() == c["response"]["payload_digest"]


def test_records_without_partners_are_null_or_left_out(spark):
    rows = [("r1", "response", None, None, "d", "h", None), ("q1", "request", "r1", None, None, "g", None),
            ("q0", "request", "r1", None, None, "f", None), ("m9", "metadata", "gone", None, None, None, "{}"),
            ("r2", "revisit", None, "r1", "d", "h", None)]
    records = spark.createDataFrame(
        rows, "record_id string, record_type string, concurrent_to string, refers_to string, "
              "payload_digest string, head string, fields string")
    got = {r["record_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "r2"}
    assert got["r1"]["request"]["record_id"] == "q0" and got["r1"]["metadata"] is None
    assert got["r2"]["request"] is None


def test_parser_reads_plain_and_member_wise_gzip():
    one = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http"
           b"\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n")
    two = b"WARC/1.1\nWARC-Type: metadata\nWARC-Record-ID: <b>\nContent-Length: 0\n\n\r\n\r\n"
    for raw in (one + two, gzip.compress(one + two), gzip.compress(one) + gzip.compress(two)):
        a, b = warc.parse_records(raw)
        assert a["payload"] == b"hello" and b["fields"] == ""
    with pytest.raises(ValueError):
        list(warc.parse_records(b"not an archive"))


MARKED = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style>
<script>var t="</p><article>";</script></head><body><header>Site name</header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c <p>no</p> -->
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy
now.</div><article><h1>Head &amp; line</h1><p>First <b>para</b>graph,&nbsp;with
  many   spaces.<br>More.<p>Unclosed &lt;one&gt; &#233;<aside>Aside</aside>
<p>Short.</p><form><input value=x>Send <button>Go</button></form><ul><li>Item <a href=#>one</a></li>
<li>Item two</li></ul><div class="share">Share this</div><p>End.</p></article>
<section id="comments"><article class="comment"><p>Nice, a long comment by a reader.</p></article>
</section><footer>&copy; 2024 &middot; Site</footer></body>"""


def test_marked_article():
    assert html_text.extract(MARKED) == "\n".join([
        "Head & line", "First paragraph, with many spaces. More.", "Unclosed <one> é", "Short.",
        "Item one", "Item two", "End."])


def test_page_without_a_marked_article():
    body = "".join(f"<p>{words(25, k)}</p>" for k in range(4))
    page = (f"<html><body><div id=menu><a href=a>A</a></div><div><a href=b>Some link text here that"
            f" is long enough to count</a></div><div class='content'><h2>Title</h2>{body}<p>Bye.</p>"
            "</div><div><a href=b>Next</a> | <a href=c>Prev</a></div><div class=footer>Foot</div>")
    assert html_text.extract(page) == "\n".join(["Title", *[words(25, k) for k in range(4)], "Bye."])


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>", "</div></p>",
                                  "<nav><p>all menu</p></nav>", "&copy;" * 2])
def test_pages_without_text(page):
    assert html_text.extract(page) == ""


def test_odd_markup_is_read_to_the_end():
    page = f"<article><p>{'word ' * 20000}</p><p title='a > b'>kept</p><p>a < b &notaref; &amp;amp;"
    lines = html_text.extract(page).split("\n")
    assert len(lines[0]) == 99_999 and lines[1:] == ["kept", "a < b ¬aref; &amp;"]


def test_containers_that_are_never_closed_do_not_swallow_the_article():
    page = "<div class=ad>Buy<nav>Menu<article><p>Text stays.</p></article>"
    assert html_text.extract(page) == "Text stays."


@pytest.mark.parametrize("attribute", [
    'class="overflow-hidden"', "class='md:hidden lg:block'", 'style="overflow: hidden"',
    'data-title="hidden gems"', "title=hidden", 'aria-hidden="false"', 'hidden="false"',
    'data-hidden="1"', 'style="--x-display: none"', 'data-aria-hidden="true"'])
def test_the_word_hidden_in_a_value_hides_nothing(attribute):
    for page in (f"<div {attribute}><p>{words(25, 1)}</p></div>",
                 f"<body {attribute}><p>{words(25, 1)}</p></body>",
                 f"<main {attribute}><p>{words(25, 1)}</p></main>",
                 f"<article><div {attribute}>{words(25, 1)}</div></article>"):
        assert html_text.extract(page) == words(25, 1)


@pytest.mark.parametrize("attribute", [
    "hidden", 'hidden=""', "id=x hidden class=y", 'HIDDEN="hidden"', 'aria-hidden="true"',
    "aria-hidden=true", 'style="color:red; display : none"', "style='display:none !important'"])
def test_hidden_elements_are_dropped(attribute):
    page = f"<article><p>Shown.</p><div {attribute}><p>{words(25, 1)}</p></div><p>Too.</p></article>"
    assert html_text.extract(page) == "Shown.\nToo."


def test_names_that_only_hold_a_mark_drop_nothing():
    long = words(25, 1)
    page = (f'<article><h2 id="related-work">Related work</h2><p>{long}</p><h2 id="search">Search</h2>'
            f'<section id="notice-period"><p>Notice.</p></section><section id="comments"><p>On '
            'comments.</p></section><div class="has-comments comment-open">Open.</div></article>')
    assert html_text.extract(page) == "\n".join(
        ["Related work", long, "Search", "Notice.", "On comments.", "Open."])
    page = (f'<div class="layout has-sidebar"><h2 id="search-algorithms">Algorithms</h2><p>{long}</p>'
            f'</div><div class="left-sidebar"><p>{words(25, 2)}</p></div><div id="siteFooter"><p>'
            f'{words(25, 3)}</p></div><div role="search"><p>{words(25, 4)}</p></div>')
    assert html_text.extract(page) == f"Algorithms\n{long}"


def test_captions_formulas_and_plain_text_are_kept():
    page = ("<article><p>Given <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math>."
            "</p><figure><img src=a><figcaption>The figure.</figcaption></figure><xmp>a <b> &amp; c"
            "</xmp><p>End.</p></article>")
    assert html_text.extract(page) == "Given x+1.\nThe figure.\na <b> &amp; c\nEnd."


@pytest.mark.parametrize("mark", ["class=entry", 'class="post-content x"', "id=content",
                                  'class="articleBody"', 'itemprop="articleBody"'])
def test_articles_marked_by_name_keep_short_lines(mark):
    items = "".join(f"<li>Item {k}</li>" for k in range(9))
    page = (f"<div class=top>Site</div><div {mark}><div><h1>T</h1></div><p>Intro.<ul>{items}</ul>"
            f"<p>{words(12, 1)}</p><p>End.</div><p>After.</p>")
    assert html_text.extract(page).split("\n") == [
        "T", "Intro.", *[f"Item {k}" for k in range(9)], words(12, 1), "End."]


def test_small_boxes_named_content_do_not_replace_the_article():
    page = f"<div class=content>Box</div><div><p>{words(40, 1)}</p><p>{words(40, 2)}</p></div>"
    assert html_text.extract(page).split("\n")[-2:] == [words(40, 1), words(40, 2)]


def test_extract_text(spark):
    rows = [(1, "u", MARKED), (1, "u", MARKED), (2, None, None), (None, "v", "<article>x</article>")]
    got = html_text.extract_text(_pages(spark, rows)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == sorted(
        [(1, len(html_text.extract(MARKED)))] * 2 + [(2, 0), (0, 1)])


@pytest.mark.parametrize("shape", [
    "<a", "<", "<x", '<a "', "<a '\"' ", '<a href="x', "<script>", "</script", "<script></script",
    "<xmp></xmp", "<!--", "<![CDATA[", "<?", "&#", "<a x=", "<p a='='"])
@pytest.mark.parametrize("end", ["", ">", "-->", "a" * 100_000])
def test_broken_pages_take_linear_time(shape, end):
    page = shape * (1_000_000 // len(shape)) + end
    start = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - start < 10


def test_deeply_nested_and_unclosed_elements_take_linear_time():
    for page in ("<nav>" + "<div>" * 100_000 + "</span2>" * 100_000,
                 "<div class=content>" + "<div>" * 100_000 + "</b2>" * 100_000 + "x"):
        start = time.perf_counter()
        html_text.extract(page)
        assert time.perf_counter() - start < 15


def test_a_tag_left_open_at_the_end_has_no_text_and_open_quotes_end_at_the_tag():
    assert html_text.extract("<article><p>Text.</p><a href=x") == "Text."
    assert html_text.extract("<article><p title='it>Text.</p><p>More.</p>") == "Text.\nMore."
    assert html_text.extract('<article><p title="a > b">Text.</p>') == "Text."


def test_short_pages_and_short_lines_keep_their_text():
    page = "<body><div><p>First short paragraph.</p><p>Second one here.</p></div></body>"
    assert html_text.extract(page) == "First short paragraph.\nSecond one here."
    long, link = words(60, 1), words(12, 2)
    page = (f"<p>{long}</p><ul><li>one<li>two<li>three</ul><p><a href=x>{link}</a> end</p>"
            f"<p>{long}</p>")
    assert html_text.extract(page) == "\n".join([long, "one", "two", "three", f"{link} end", long])


def test_only_listed_kinds_are_dropped_inside_the_article():
    page = ("<article><p>A.</p><section class='related'>Related work.</section><svg><title>no</title>"
            "<text>In the figure.</text></svg><aside class=sidebar>Side</aside><p class=widget>B.</p>"
            "<div class=comments>No.</div></article><svg><text>icon</text></svg>")
    assert html_text.extract(page) == "A.\nRelated work.\nIn the figure.\nB."


def _by_definition(lengths, linked, window, surge, share):
    """Surge and dive straight from the definition, sum by sum."""
    n, half = len(lengths), window // 2
    near = [range(max(0, k - half), min(n, k + half + 1)) for k in range(n)]
    own = []
    for k in range(n):
        sides = [next((j for j in places if lengths[j]), None)
                 for places in (range(k - 1, -1, -1), range(k + 1, n))]
        menu = any(j is None or linked[j] > share * lengths[j] for j in sides)
        own.append(0 if linked[k] > share * lengths[k] and menu else lengths[k])
    sums = [sum(own[j] for j in near[k]) for k in range(n)]
    high = [k for k in range(n) if own[k] and sums[k] >= max(1, surge * max(sums))]
    return [bool(high) and min(high) <= k <= max(high) and own[k] > 0 for k in range(n)]


def test_surges_equal_the_definition():
    rng = random.Random(6)
    for _ in range(500):
        n = rng.randrange(30)
        lengths = [rng.choice([0, 3, 20, 200, 900]) for _ in range(n)]
        linked = [rng.choice([0, 0, x // 2, x]) for x in lengths]
        args = rng.choice([1, 3, 5]), rng.choice([0.05, 0.1, 0.5]), rng.choice([0.3, 0.6])
        assert html_text.surging(lengths, linked, *args) == _by_definition(lengths, linked, *args)


def test_generated_pages_give_their_blocks():
    """Pages put together from known blocks, with menus and links around them."""
    rng = random.Random(9)
    for trial in range(150):
        blocks = [words(rng.randrange(20, 90), trial * 50 + k) for k in range(rng.randrange(2, 9))]
        body = "".join(rng.choice([f"<p>{b}</p>", f"<p>{b}", f"<div><p>{b}</p></div>",
                                   f"<p>{b[:9]}<b title='>'>{b[9:]}</b></p>"]) for b in blocks)
        menu = "".join(f"<li><a href='/{k}'>{words(2, k)}</a></li>" for k in range(rng.randrange(9)))
        page = (f"<body><nav><ul>{menu}</ul></nav><ul>{menu}</ul><div>{body}</div><ul>{menu}</ul>"
                f"<footer>{words(30, 1)}</footer><script>var a = '<p>{words(9, 2)}</p>'</script>")
        assert html_text.extract(page) == "\n".join(blocks)
