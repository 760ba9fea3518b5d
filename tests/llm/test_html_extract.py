import random
import time
from html.parser import HTMLParser

import pytest

from plumbline.llm import html_extract as m
from plumbline.llm.common import table

SCHEMA = "page_id long, url string, html string, text string, host int, path string"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h2>Site</h2><p>%(junk)s</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- <article>no</article> --><div class="cookie-notice">We use cookies. %(junk)s</div>
<div class="wrap-%(n)d"><aside class="sidebar"><p>%(junk)s</p></aside><div class="post-%(n)d content"><h1>Head &amp; line</h1><p><b>First
 part<br>of %(body)s.<p>Second&nbsp;&#233; part. %(body)s</p><ul><li>one<li>two</ul><div class="ad">Buy %(junk)s</div>
<form><p>Search</p><input name=q><button>Go</button></form><div id="comments"><p>Nice! %(junk)s %(junk)s</p></div></div></div>
<footer>&copy; foot %(junk)s</footer></body></html>"""


def want(body):
    return "\n\n".join(["Head & line", f"First part of {body}.", f"Second é part. {body}", "one", "two"])


def test_a_page():
    page = PAGE % {"n": 3, "junk": "lorem", "body": "body " * 20 + "end"}
    body = " ".join(("body " * 20 + "end").split())
    assert m.text_at(page, None) == want(body)
    assert m.best_paths(page)[0][0] == ">html>body>div.wrap-#>div.content.post-#"


def test_broken_pages():
    assert m.text_at(None, None) == m.text_at("", None) == m.text_at("<div><p></div>", None) == ""
    assert m.text_at("plain  text &lt;b&gt;", None) == "plain text <b>"
    assert m.text_at("<nav><ul><li>menu<article><p>a long article text<p>more</article>", None) == "a long article text\n\nmore"
    assert m.text_at("<article><p>kept</p><script>never closed <p>x", None) == "kept"
    assert m.text_at("<article><p>kept</p><!-- never closed <p>x", None) == "kept"
    assert m.text_at('<p title="a > b">q</p>', None) == "q"
    assert m.text_at("<article><p>" + "word " * 200_000 + "</article>", None) == ("word " * 200_000).strip()
    assert m.text_at("<p>1 < 2 and 3 > 2</p>", None) == "1 < 2 and 3 > 2"


def test_consensus_beats_a_page_of_its_own(spark):
    rng = random.Random(1)
    rows = []
    for k in range(40):
        body = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(20, 60)))
        rows.append((k, f"https://User@Host.example:80/p/{k}", PAGE % {"n": k, "junk": "lorem", "body": body}, "clash", 0, "clash"))
    # here a box that no word marks is longer than the article
    odd = "<html><body><div class='wrap-1'><div class='content post-9'><h1>Small</h1><p>little text</p></div></div><div class='x'><p>" + "noise " * 200 + "</p></div></body></html>"
    rows += [(100, "http://host.example/odd", odd, "", 0, ""), (101, None, odd, "", 0, ""), (102, "http://host.example/none", None, "", 0, ""), (103, "http://host.example/own", "<html><body><main><p>own page</p></main></body></html>", "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {r.page_id: r for r in m.extract(df).collect()}
    assert len(out) == 44 and all(r.n_chars == len(r.text) for r in out.values())
    assert all(out[k].text.startswith("Head & line\n\nFirst part of ") and "lorem" not in out[k].text for k in range(40))
    assert out[100].text == "Small\n\nlittle text" and out[101].text.startswith("noise") and out[102].text == "" and out[103].text == "own page"
    assert out[101].url is None


def test_large_winners_use_a_join_and_empty(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_BYTES", -1)
    df = spark.createDataFrame([(1, "http://a.b/", "<article><p>x y</article>", "", 0, "")] * 2, SCHEMA)
    assert [r.text for r in m.extract(df).collect()] == ["x y", "x y"]
    assert m.extract(df.limit(0)).collect() == []


def test_attribute_values_and_parts_of_names_are_no_marks():
    page = """<article><p>First.</p><p title="a hidden gem">Second.</p><div data-id="promo" data-class='ad'><p>Third.</p></div>
    <div class="side-by-side form-factor"><p>Fourth.</p></div><section id="login-guide">Fifth.</section><ul class="search-results"><li>Sixth.</ul><div class="skip-list-theory">Seventh.</div>
    <div class="cookie-notice">no</div><div class=adSlot3>no</div><div hidden>no</div><div role="complementary">no</div><p id='ad'>no</article>"""
    assert m.text_at(page, None) == "\n\n".join(["First.", "Second.", "Third.", "Fourth.", "Fifth.", "Sixth.", "Seventh."])
    # a name is a vote: what holds most of the page is the article whatever it is called
    assert m.text_at("<body><div class='widget'>" + "<p>long text here</p>" * 9 + "</div><p>short</p>", None).startswith("long text here")


def test_tags_are_read_like_a_browser_does():
    assert m.text_at("<p a='>' b=\">\" c=x>kept</p><p/>also</p>", None) == "kept\n\nalso"
    assert m.text_at("<article><p>kept<b", None) == m.text_at("<article><p>kept<b class='x", None) == "kept"
    assert m.text_at("<article><p>1<2 and <3, a <- b</p>", None) == "1<2 and <3, a <- b"
    assert m.text_at("<article><title>no</title ><p>kept</TITLE></article>", None) == "kept"
    assert m.text_at("<article><p CLASS=x CLASS=ad>kept</article>", None) == "kept"


@pytest.mark.parametrize("unit", ["<b", "y", "<a", '<a x="', "<a x='\" ", "<div>", "<title>", "<script>", "<!--", "<!", "<", "<a =", "</x ", "<a b=c ", "<nav><article>", "<ul><blockquote><li></li>", "<p></div>", "&", "&#", "<li>", "<article></section>"])
def test_a_megabyte_of_any_shape_is_read_in_linear_time(unit):
    for page in (unit * ((1 << 20) // len(unit)), "<div>" * 50_000 + unit * ((1 << 19) // len(unit)), "<b" + unit * ((1 << 20) // len(unit))):
        began = time.process_time()
        m.text_at(page, None)
        assert time.process_time() - began < 15


class Slow(HTMLParser):
    """An extractor of its own for well-formed pages: the text of the elements that hold it, article only, unwanted ones out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.blocks, self.parts = [], [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text and "article" in self.path and not {"nav", "footer", "aside", "script", "style", "ad"} & set(self.path):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("b", "a", "meta"):
            self.flush()
            if tag in ("p", "li") and self.path and self.path[-1] == tag:
                self.path.pop()
            self.path.append("ad" if dict(attrs).get("class") == "ad" else tag)

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "br", "meta"):
            self.flush()
            at = len(self.path) - 1
            while at >= 0 and self.path[at] != tag and not (self.path[at] == "ad" and tag == "div"):
                at -= 1
            if at >= 0:
                del self.path[at:]

    def handle_data(self, data):
        self.parts.append(data)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_given_pages_against_another_reader(spark, sf):
    pages = table(spark, f"/root/testdata/sf{sf}", "pages").collect()
    got = {r.page_id: r.text for r in m.query(spark, f"/root/testdata/sf{sf}").collect()}
    assert len(got) == len(pages)
    for r in pages:
        slow = Slow()
        slow.feed(r.html)
        slow.close()
        slow.flush()
        assert got[r.page_id] == "\n\n".join(slow.blocks)
