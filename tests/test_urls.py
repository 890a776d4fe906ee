from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from pagework.functions import urls

REFS = [
    "/x", "x", "./x", "../x", "../../../x", "", "?q=2", "#f", "//cdn.c/y.js", "http://o.e/a?b#c",
    "mailto:a", "tel:+1", "data:x", "x/./y/../z", "/a/../b", "..", ".", "x?y#z", "für", "a b.png",
    "javascript:void(0)", "HTTP:foo", "a//b", "/a//b", "x;p=1", "..;x", "/..", "a/..", "a/.", "?", "#",
    "x:y", "1:2", "a\tb", "//h", "//h?q",
]
BASES = [
    "https://e.com/", "https://e.com", "https://e.com/a/b?c=1", "http://e.com/a/b/",
    "https://e.com/a//b/c;x?y#z", "https://e.com:80/a/../b/c",
]


def test_resolve_agrees_with_the_standard_library(apply):
    pairs = [(b, r) for b in BASES for r in REFS]
    assert apply(urls.resolve, pairs) == [urljoin(b, r) for b, r in pairs]


def test_resolve_of_null_is_null(apply):
    assert apply(urls.resolve, [("https://e.com/", None), (None, "x")]) == [None, None]


def test_parts_agree_with_the_standard_library(apply):
    texts = [u for u in REFS + BASES if not u.startswith("//h")] + ["a\x01b?c", "HTTPS://E.com/A?b=c?d#e#f"]
    for text, parts in zip(texts, apply(urls.split_url, texts)):
        p = urlparse(text)
        path = p.path + (f";{p.params}" if p.params else "")
        assert tuple(parts) == (p.scheme, p.netloc, path, p.query, p.fragment), text


def test_normalize_and_same_site(apply):
    cases = [
        ("https://e.com/a/#x", "https://e.com/a", True),
        ("https://e.com/", "https://e.com/", True),
        ("https://e.com", "https://e.com", True),
        ("http://e.com/", "http://e.com", True),
        ("https://e.com:8080/a", "https://e.com:8080/a", False),
        ("https://e.com/a?", "https://e.com/a", True),
        ("https://e.com/a?b#c", "https://e.com/a?b", True),
        ("tel:+1", "tel:+1", False),
        ("HTTPS://e.com/q/", "https://e.com/q", True),
    ]
    given = [c[0] for c in cases]
    assert apply(lambda u: urls.normalize(u, F.lit("https://e.com/")), given) == [c[1] for c in cases]
    assert apply(lambda u: urls.is_same_site(u, F.lit("e.com")), given) == [c[2] for c in cases]
    assert apply(lambda u: urls.is_same_site(u, F.lit("e.com"), True), ["tel:+1"]) == [True]


def test_saved_pages_resolve_with_and_without_a_base(apply):
    rows = [
        ("https://e.com/a/b", "//h/x"), ("https://e.com/a/b", "/x/../y"), ("https://e.com/a/b", "x"),
        (None, "//h/x"), (None, "http://h/x"), (None, "x"),
    ]
    assert apply(urls.resolve_saved, rows) == [
        "https://h/x", "https://e.com/x/../y", "https://e.com/a/x", "https://h/x", "http://h/x", None,
    ]
    assert apply(lambda b, r: urls.is_resolvable(r, b), rows) == [True] * 5 + [False]


def test_hash_and_language(apply):
    import hashlib

    texts = ["https://e.com/", "für"]
    assert apply(urls.short_hash, texts) == [hashlib.md5(t.encode()).hexdigest()[:8] for t in texts]
    assert apply(urls.language_url, [("https://e.com/", "fr"), ("https://e.com/?a=1", "fr")]) == [
        "https://e.com/?lang=fr", "https://e.com/?a=1&lang=fr",
    ]
