"""HTML extraction and WARC tables."""

import gzip
import hashlib
import math

import pytest

from tessera.llm import html_extract, warc

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, please agree to all of them.</div>
<article><h1>A  title</h1><p>First &amp; <b>bold</b>
text.<p>Second&nbsp;one<br>goes on</p><div class="ad">Buy now, a very long advert that has much text in it</div><p>Short.</p>
<form><label>Name</label></form><section class="comments"><p>A reader says so and so at some length, too.</p></section></article><aside>Elsewhere</aside><footer>&copy; me</footer></body></html>"""


def test_extraction():
    assert html_extract.main_text(PAGE) == "A title\n\nFirst & bold text.\n\nSecond one goes on\n\nShort."


def test_extraction_of_odd_pages(spark):
    pages = [None, "", "plain text only", "<p>unclosed <b>bold<p>next", "<nav>only menus</nav>", "<article><p>" + "word " * 50_000 + "</p></article>", "<div" * 2000, "<article><p>a</article><article><p>b</article>"]
    d = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(pages)] + [(1, "u", "", "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract(d).collect()
    assert [r.text for r in got[:5]] == ["", "", "plain text only", "unclosed bold\n\nnext", ""]
    assert got[5].n_chars == len("word " * 50_000) - 1 and len(got) == 9 and got[7].text == "a\n\nb"
    assert html_extract.extract(d.limit(0)).count() == 0


LONG = ["The first paragraph of the story has enough words to be told from a menu, as it goes on and on.", "The second one follows it, and says a little more about what the first one left unsaid, with a comma.", "A third closes the story with as many words as the two before it had, give or take a few of them."]
MENU = '<div><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/m">More</a></li></ul></div>'


def test_extraction_without_articles():
    """Clusters choose the lines and the region where no element says what it is."""
    divs = "".join(f"<div>{x}</div>" for x in LONG)
    for page in (
        f"<body>{MENU}<div>{divs}</div><div>About us</div><div>Terms</div></body>",
        f"<body>{MENU}{divs}<div>About us</div><div>Terms</div></body>",
        f"<body><div class='x1'>{MENU}<div><div>{divs}</div><div><a href='/'>Next story</a></div></div></div><div><span>Contact</span></div></body>",
        f"<body><table><tr><td>{MENU}</td><td>{divs}</td></tr></table></body>",
    ):
        assert html_extract.main_text(page) == "\n\n".join(LONG), page
    story = f"<h2>A title</h2><p>{LONG[0]}</p><p>Short.</p><ul><li>one</li><li>two</li></ul><p>{LONG[1]}</p><p>Bye.</p>"
    assert html_extract.main_text(f"<body>{MENU}<section>{story}</section><div>Terms</div></body>") == "\n\n".join(("A title", LONG[0], "Short.", "one", "two", LONG[1], "Bye."))


def test_extraction_of_several_articles_and_odd_names():
    two = f"<article><p>{LONG[0]} {LONG[1]} {LONG[2]}</p></article><article><p>{LONG[1]}</p></article>"
    assert html_extract.main_text(two) == " ".join(LONG) + "\n\n" + LONG[1]
    page = f"<body><div class='tags-and-notes'><p>{LONG[0]}</p></div><p class='ads-free'>{LONG[1]}</p><div class='ad-box'>{LONG[2]}</div></body>"
    assert html_extract.main_text(page) == LONG[0] + "\n\n" + LONG[1]
    assert html_extract.main_text(f"<body><div class='content comment'><p>{LONG[0]}</p></div></body>") == LONG[0]
    outside = f"<body><article><a href='/'>Teaser</a></article><div>{''.join(f'<p>{x}</p>' for x in LONG)}</div></body>"
    assert html_extract.main_text(outside) == "\n\n".join(LONG)


def test_clusters_of_ratios():
    page = html_extract.lines_of(f"<body>{MENU}{''.join(f'<p>{x}</p>' for x in LONG)}</body>")
    lines, parents = page.lines, page.parents
    ratio = html_extract.ratios(lines)
    smooth = html_extract.smoothed(ratio)
    weights = [math.exp(-0.5 * k * k) for k in range(-3, 4)]
    raw = [max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    want = [math.log1p(sum(w * raw[min(max(i + k, 0), len(raw) - 1)] for w, k in zip(weights, range(-3, 4), strict=True)) / sum(weights)) for i in range(len(raw))]
    assert smooth.tolist() == pytest.approx(want) and raw[:4] == [0] * 4
    assert (smooth >= html_extract.threshold(smooth)).tolist()[-3:] == [True] * 3 and not (smooth >= html_extract.threshold(smooth))[:3].any()
    assert all(p < n for n, p in enumerate(parents) if n)


def test_warc_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/1", big, 0), (5, None, big, 0), (3, "http://a/3\r\nX: y", big, 0), (2, "u", "small", 0), (4, "u", "small", 0), (6, "u", None, 0), (7, "u", "x" * 2_000_000, 0), (7, "u", "x" * 2_000_000, 0), (None, "u", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    for r in got:
        body = (next(h for p, _, h, _ in rows if p == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "revisit", 5), (3, "revisit", 5), (None, "revisit", 5), (5, "response", None), (2, "response", None), (4, "response", None), (6, "response", None), (7, "response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_make_a_gzip_file(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 1_000_000), (2, "v", "b" * 10)], "page_id long, url string, html string")
    rows = sorted(warc.write(pages, chunk=1 << 16).collect(), key=lambda r: (r.record_id, r.chunk))
    assert max(r.chunk for r in rows) == 15
    whole = gzip.decompress(b"".join(bytes(r.data) for r in rows))
    assert whole.count(b"WARC/1.1\r\n") == 2 and b"a" * 1_000_000 in whole
    last = {r.record_id: r.sha1 for r in rows}
    assert set(last.values()) == {hashlib.sha1(x).hexdigest() for x in (b"a" * 1_000_000, b"b" * 10)}


def test_records_of_other_writers():
    """Lower-case headers, folded lines, hex digests, records cut anywhere."""
    body = b"hello payload"
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    head = b"WARC/1.0\r\nwarc-type:response\r\nWarc-Target-URI: http://a/\r\n\tb\r\nWARC-PAYLOAD-DIGEST: sha1:%s\r\ncontent-length: %d\r\n\r\n" % (hashlib.sha1(body).hexdigest().encode(), len(http) + len(body))
    packed = gzip.compress(head + http + body + b"\r\n\r\n")
    for step in (1, 7, 1000):
        reader = warc.Reader("r")
        for k in range(0, len(packed), step):
            reader.feed(packed[k : k + step])
        assert reader.row() == ("r", None, "http://a/ b", "response", None, len(body), hashlib.sha1(body).hexdigest(), True)


def test_equal_ids_of_unlike_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 1500), (1, "u", "b" * 1500), (2, "u", "a" * 1500), (2, "u", "b" * 999), (None, "u", "c" * 1200), (None, "u", "c" * 1200)], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    sha1 = lambda c, n: hashlib.sha1(c * n).hexdigest()
    want = [(1, sha1(b"a", 1500), "revisit", 2), (1, sha1(b"b", 1500), "response", None), (2, sha1(b"a", 1500), "response", None), (2, sha1(b"b", 999), "response", None)] + [(0, sha1(b"c", 1200), "response", None)] * 2
    assert got == sorted(want, key=str)
