import hashlib
import posixpath


from pagework.functions import paths
from pagework.functions.paths import FLAT, TREE


def test_clean_name(apply):
    cases = {
        "seal_0badcafe.png": "seal.png",
        "wide_photo-xl_77ee88ff.jpg": "wide_photo-xl.jpg",
        "mark_00ff11ee22dd.svg": "mark.svg",
        "x-facade.png": "x.png",
        "rep-20240115.png": "rep.png",
        "A_ABCDEF1.png": "A_ABCDEF1.png",
        "a_123456_654321.png": "a_123456.png",
        "n.tar.gz": "n.tar.gz",
        ".hidden": ".hidden",
        "noext": "noext",
    }
    assert apply(paths.clean_name, list(cases)) == list(cases.values())


def test_stem_and_suffix_agree_with_the_standard_library(apply):
    names = ["a.b", "a", ".a", "..a.b", "a.", "a.tar.gz", "...", ".a.b", "a..b"]
    assert apply(paths.stem_of, names) == [posixpath.splitext(n)[0] for n in names]
    assert apply(paths.suffix_of, names) == [posixpath.splitext(n)[1] for n in names]


def test_flat_page_names(apply):
    cases = {
        "https://e.org/": "index.html",
        "https://e.org/team": "team.html",
        "https://e.org/garden/tools": "tools.html",
        "https://e.org/news/2021_first-snow": "2021_first-snow.html",
        "https://e.org/a/b.c.php?x=1": "b-c.html",
    }
    assert apply(paths.page_path_flat, list(cases)) == list(cases.values())


def test_tree_page_paths(apply):
    url = "https://e.com/list?page=2"
    mark = hashlib.md5(url.encode()).hexdigest()[:8]
    cases = {
        "https://e.com/": "index.html",
        "https://e.com/about": "about/index.html",
        "https://e.com/a/b.htm": "a/b.htm",
        "https://e.com/a/b.php": "a/b.php.html",
        url: f"list/index_{mark}.html",
    }
    assert apply(paths.page_path_tree, list(cases)) == list(cases.values())


def test_asset_folders_and_suffixes(apply):
    rows = [("a.css", "other"), ("a", "css"), ("a.png", "js"), ("a.PNG", "image"), ("f.woff2", "other"), ("q", "other")]
    for layout, last in ((FLAT, ".html"), (TREE, "")):
        suffix = lambda n, k: paths.asset_suffix(n, k, layout)
        assert apply(suffix, rows) == [".css", ".css", ".png", ".PNG", ".woff2", last]
        folder = lambda n, k: paths.asset_folder(suffix(n, k), k, layout)
        assert apply(folder, rows) == [
            layout.prefix + f for f in ("css", "css", "js", "images", "fonts", "other")
        ]
    name = lambda u: paths.asset_name(u, TREE)
    assert apply(name, ["https://e.com/a:b.png", "https://e.com/", "https://e.com/x.png;j=1"]) == [
        "a_b.png", "resource", "x.png",
    ]


def test_relative_paths_agree_with_the_standard_library(apply):
    rows = [
        ("img/a.png", ""), ("img/a.png", "css"), ("css/a.css", "css"), ("index.html", "a/b/c"),
        ("a/b/x.html", "a/c"), ("a", "a"), ("a", "a/b"), ("a/b/c/d", "a/x/c"),
    ]
    assert apply(paths.relative_path, rows) == [
        posixpath.relpath("/r/" + t, "/r/" + f) for t, f in rows
    ]


def test_language_file(apply):
    assert apply(paths.language_file, ["th"]) == ["index-th.html"]
