import html
import random
from html.entities import html5
from html.parser import HTMLParser

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagework.functions import css, markup

PAGE = """<!DOCTYPE html><!-- <a href="/c"> --><A HREF=/yes>t</A><p class="x>y" data-href='q'>
<a href='/s&amp;b&#233;&#x1F600;&lt;'>z</a><abbr href=x></abbr><a href>v</a><a href=''/>
<script src="a.js" >var x="<img src='/no'>";</script><style>a{}<a href=n></style>
<img src=x.png srcset="a 1x, b 2x"/><a title=it's href=/w>1 < 2</a><a href=/1 href=/2>"""


def _attrs(tag):
    return F.transform(markup.attributes(tag), lambda a: F.concat(a["name"], F.lit("="), a["value"]))


def test_tokens_lose_nothing(apply):
    pages = [PAGE, "", "<", "a<b", "<a href=\"x", "<!-- open <a>", "<script>x", "<a <b>>", "</p x='>'>"]
    assert ["".join(t) for t in apply(markup.tokens, pages)] == pages


def test_tags_and_attributes(apply):
    marked = [t for t in apply(markup.marked_tokens, [PAGE])[0] if t]
    heads = apply(markup.opening_tag, marked)
    assert apply(markup.tag_name, heads) == [
        "a", "p", "a", "abbr", "a", "a", "script", "style", "img", "a", "a",
    ]
    values = apply(lambda t: markup.attribute_of(t, "href"), heads)
    assert values == ["/yes", None, "/s&bé😀<", "x", "", "", None, None, None, "/w", "/2"]
    assert apply(_attrs, heads)[8] == ["src=x.png", "srcset=a 1x, b 2x"]


def test_wanted_tags_keep_their_positions(apply):
    every = apply(markup.marked_tokens, [PAGE])[0]
    links = apply(lambda h: markup.marked_tokens(h, ["a"]), [PAGE])[0]
    assert len(every) == len(links)
    assert [i for i, t in enumerate(links) if t] == [
        i for i, t in enumerate(every) if t.lower().startswith(("<a ", "<a>"))
    ]


def test_huge_tags_and_open_quotes(apply):
    big = "<a " + " ".join(f'x{i}="{i}"' for i in range(20000)) + ' href="/b">'
    page = big + "<script>" + "x" * 500000 + "</script>" + '<p title="' + "a" * 5000 + '">' + '<a href="' + "z" * 9000
    assert "".join(apply(markup.tokens, [page])[0]) == page
    assert apply(lambda t: markup.attribute_of(t, "href"), [big]) == ["/b"]


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "a" and "href" in values:
            self.found.append(values["href"] or "")

    handle_startendtag = handle_starttag


WORD = st.text("abc/.#?=é ", min_size=0, max_size=6)
ELEMENT = st.one_of(
    WORD,
    WORD.map(lambda w: f'<a href="{w}">'),
    WORD.map(lambda w: f"<p title='{w}' ><a class=x href='{w}'/>"),
    WORD.map(lambda w: f"<!--<a href={w}>-->"),
    WORD.map(lambda w: f"<script>'<a href=\"{w}\">'</script>"),
    st.just("<br></a>"),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ELEMENT, max_size=8).map("".join), min_size=20, max_size=40))
def test_anchors_agree_with_the_standard_library(apply, pages):
    def hrefs(html):
        tags = F.filter(markup.marked_tokens(html, ["a"]), lambda t: t != "")
        values = F.transform(tags, lambda t: markup.attribute_of(t, "href"))
        return F.filter(values, lambda v: v.isNotNull())

    for page, found in zip(pages, apply(hrefs, pages)):
        parser = _Anchors()
        parser.feed(page)
        assert found == parser.found, page


def test_set_attributes(apply):
    edits = "array(named_struct('name','src','value','N&\"w'), named_struct('name','onclick','value','z'))"
    set_both = lambda t: markup.set_attributes(t, F.expr(edits))
    assert apply(set_both, ['<img src=x alt="q" />', '<script SRC = "a" x>var b;</script>', "<li>"]) == [
        '<img src="N&amp;&quot;w" alt="q" onclick="z" />',
        '<script SRC="N&amp;&quot;w" x onclick="z">var b;</script>',
        '<li src="N&amp;&quot;w" onclick="z">',
    ]


def test_css_references(apply):
    text = "a{background:url('x.png')}@import url(z.css);u{ url( 'sp.png' ) uurl(data:a) url(\"f.woff2?x\")}"
    found = apply(css.css_urls, [text, "none"])
    assert [u["ref"] for u in found[0]] == ["x.png", "z.css", "data:a", "f.woff2?x"] and found[1] == []
    assert apply(css.is_kept, [u["ref"] for u in found[0]]) == [False, False, True, True]
    assert "".join(apply(css.css_tokens, [text])[0]) == text
    pos = found[0][0]["pos"]
    edit = F.expr(f"array(named_struct('pos', {pos}L, 'value', 'NEW'))")
    assert apply(lambda t: css.splice_css(t, edit), [text]) == [text.replace("url('x.png')", "url(NEW)")]


def test_all_character_references(apply):
    rng = random.Random(5)
    names = sorted(html5)
    texts = [f"&{n}" for n in names] + [f"a&{n.rstrip(';')}b&{n}" for n in names]
    texts += [f"&#{n};" for n in [*range(0, 300), 0xB, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000]]
    texts += [f"&#x{n:x}" for n in (0, 9, 13, 128, 150, 159, 160, 0x20AC, 0x1F600, 0xD900, 0x100000, 0x10FFFF, 10**30)]
    texts += ["&#" + "0" * 50 + "65;", "&#x" + "0" * 50 + "41z", "&#" + "9" * 40, "&#;", "&#x;", "&;", "&", "a & b", "&& &amp;amp;", "&ampersand", "?a=1&copy=2&ref=x&lt", "&" + "x" * 40 + ";", "&notit;", "&notin;", "&eacute&eacute;"]
    pieces = ["&", "#", "x", "amp", "lt", "not", "in", ";", "65", "e", " ", "=", "Eacute", "é", "<", "\n"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    got = apply(markup.decode_references, texts)
    wrong = [(t, g, html.unescape(t)) for t, g in zip(texts, got) if g != html.unescape(t)]
    assert not wrong, wrong[:5]
