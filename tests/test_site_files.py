"""Files of saved sites: written by tasks, read again, refused, made of pieces; and the store of backups."""

import os

import pytest
from pyspark.sql import functions as F

from pagework.operators import bundles
from pagework.operators.linkfix import restore
from pagework.functions.paths import FLAT, TREE
from pagework.plans.mirror import mirror_pages
from pagework.plans.save import save_copy, saved_references
from pagework.sources.backups import BackupStore
from pagework.sources.scan import decode_text, scan_html_files
from pagework.sources.scratch import Scratch
from pagework.sources.site_files import SiteFilesWriter, read_files, save_files, why_refused

ROWS = "site string, path string, body binary"
PIECES = "site string, path string, start long, size long, body binary"


def found(spark, root, **options):
    return {(r.site, r.path): bytes(r.content) for r in read_files(spark, root, **options).collect()}


def test_files_come_back_byte_for_byte(spark, tmp_path):
    rows = [("s", f"a/{i}/x.bin", bytes([i, 255, 0, 128]) * i) for i in range(40)] + [("", "top.html", b"t"), ("s t", "é ü.png", b"\x89")]
    root = str(tmp_path / "out")
    assert save_files(spark.createDataFrame(rows, ROWS).repartition(5), root).count() == 0
    assert found(spark, root) == {(s, p): bytes(b) for s, p, b in rows}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_staging", "s", "s t", "top.html"]
    assert not any(files for _, _, files in os.walk(tmp_path / "out" / "_staging"))
    # A path that comes again is replaced; others stay.
    save_files(spark.createDataFrame([("s", "a/1/x.bin", b"new")], ROWS), root)
    assert found(spark, root)["s", "a/1/x.bin"] == b"new" and len(found(spark, root)) == len(rows)
    listed = read_files(spark, root, content=False, suffixes=(".html", ".png"))
    assert {(r.site, r.path, r.length, r.content) for r in listed.collect()} == {("", "top.html", 1, None), ("s t", "é ü.png", 1, None)}


def test_bad_rows_are_refused_and_the_rest_is_written(spark, tmp_path):
    rows = [
        ("s", "../x", b"1"), ("s", "a//b", b"1"), ("s", "", b"1"), (None, "x", b"1"), ("s", None, b"1"), ("s", "n" * 300, b"1"),
        ("s", "z\0", b"1"), ("s", "null.html", None), ("_staging", "x", b"1"), ("s", "ok.html", b"fine"), ("s", "dir/inner", b"in"),
    ]
    root = str(tmp_path / "out")
    refused = save_files(spark.createDataFrame(rows, ROWS).repartition(4), root)
    assert len(refused.collect()) == 9 and refused.columns == ["site", "path", "reason"]
    assert found(spark, root) == {("s", "ok.html"): b"fine", ("s", "dir/inner"): b"in"}
    clash = save_files(spark.createDataFrame([("s", "dir", b"a file"), ("s", "ok.html/x", b"below a file"), ("t", "y", b"y")], ROWS), root)
    assert {(r.path, r.reason) for r in clash.collect()} == {("dir", "a file and a folder of one name"), ("ok.html/x", "a file and a folder of one name")}
    assert found(spark, root)["t", "y"] == b"y"
    assert why_refused("s", "a/b.html") is None and save_files(spark.createDataFrame([], ROWS), root).count() == 0


def test_an_attempt_that_fails_leaves_no_file(spark, tmp_path):
    import pyarrow as pa

    writer = SiteFilesWriter(f"file://{tmp_path}", "run")
    columns = [pa.array([x] if x is not None else [None], t) for x, t in (("s", pa.string()), ("a", pa.string()), (None, pa.int64()), (None, pa.int64()), (b"x", pa.binary()))]
    batch = pa.RecordBatch.from_arrays(columns, ["site", "path", "start", "size", "body"])

    def broken():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert not (tmp_path / "s").exists()
    # Two attempts of one task leave one file, and the list of refused rows of the good one.
    bad = batch.set_column(1, "path", pa.array([".."]))
    one, two = writer.write(iter([batch, bad])), writer.write(iter([batch, bad]))
    writer.commit([two, None])
    assert (tmp_path / "s" / "a").read_bytes() == b"x" and one.files == two.files == 1
    assert [p.stem for p in (tmp_path / "_rejected" / "run").iterdir()] == [two.name]
    writer.abort([])
    assert not (tmp_path / "_rejected" / "run").exists()


def test_pieces_of_many_tasks_make_one_file(spark, tmp_path):
    chunks = [("s", k, i, f"u{i}", "é" * (i * 37 % 90) + f"\n{i}") for k in ("css", "js") for i in range(500)] + [("t", "css", 0, "u", "")]
    frame = spark.createDataFrame(chunks, "site string, kind string, chunk_order long, source_url string, chunk string").repartition(9)
    pieces = bundles.bundle_pieces(frame, TREE, Scratch(spark))
    assert save_files(pieces.repartition(7, "start"), str(tmp_path)).count() == 0
    wanted = {("s", f"assets/{p}"): "\n".join(c[4] for c in chunks if c[:2] == ("s", k)).encode() for k, p in (("css", "css/all-styles.css"), ("js", "js/all-scripts.js"))}
    assert found(spark, str(tmp_path)) == {**wanted, ("t", "assets/css/all-styles.css"): b""}
    # A shorter bundle replaces the longer one as a whole.
    short = spark.createDataFrame([("s", "assets/css/all-styles.css", 0, 3, b"abc"), ("s", "../x", 0, 1, b"x")], PIECES)
    assert [tuple(r) for r in save_files(short, str(tmp_path)).collect()] == [("s", "../x", "not a path inside the site")]
    assert found(spark, str(tmp_path))["s", "assets/css/all-styles.css"] == b"abc"


def test_a_saved_copy_has_every_file_that_it_refers_to(spark, tmp_path):
    html = '<link rel="stylesheet" href="https://c/a.css"><script src="https://c/a.js"></script><img src="https://c/p.png"><img src="https://c/gone.png">'
    pages = spark.createDataFrame([("e", f"https://e/{i}", i, html) for i in range(3)], "site string, url string, page_order long, html string")
    rows = [("https://c/a.css", 200, b"a{background:url(p.png)}\xff"), ("https://c/a.js", 200, "é()".encode()), ("https://c/p.png", 200, b"\x89\xff\x00"), ("https://c/gone.png", 404, b"no")]
    assets = spark.createDataFrame(rows, "url string, status int, content binary")
    for consolidate in (True, False):
        root = str(tmp_path / f"copy{consolidate}")
        copy = mirror_pages(pages, assets, Scratch(spark), consolidate)
        assert save_copy(copy, assets, root, FLAT, Scratch(spark), consolidate).count() == 0
        files = found(spark, root)
        names = {p: b for (_, p), b in files.items()}
        assert names["images/p.png"] == b"\x89\xff\x00" and len(names) == (8 if consolidate else 6)
        css = next(b for p, b in names.items() if p.startswith("css/a_"))
        assert css == b"a{background:url(../images/p.png)}"
        if consolidate:
            assert names["css/all-styles.css"] == b"\n/* Source: https://c/a.css */\n" + css
            assert names["js/all-scripts.js"] == "\n/* Source: https://c/a.js */\né()".encode()
        counted = saved_references(read_files(spark, root)).collect()
        assert [tuple(r) for r in counted] == [("e", 9, 0)]
    os.remove(f"{root}/e/images/p.png")
    assert [tuple(r) for r in saved_references(read_files(spark, root)).collect()] == [("e", 9, 3)]


def test_replacement_characters_in_a_text_stay(spark, tmp_path):
    texts = ["a�b".encode() + b"\xff", b"\xf0\xef\xbf\xbd", "AB".encode(), b"\xe2\x82A", b"", "plain é".encode()]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t binary")
    got = [r.t for r in rows.select("i", decode_text(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == [t.decode("utf-8", "ignore") for t in texts]
    (tmp_path / "d").mkdir()
    for i, t in enumerate(texts):
        (tmp_path / "d" / f"{i}.html").write_bytes(t)
    assert {r.path: r.html for r in scan_html_files(spark, str(tmp_path)).collect()} == {f"d/{i}.html": t.decode("utf-8", "ignore") for i, t in enumerate(texts)}


def test_backups_of_several_repairs(spark, tmp_path):
    schema = "site string, path string, html string"
    store = BackupStore(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("s", "a", "a2"), ("s", "b", "b1"), ("s", "c", "c0")], schema)
    assert store.generations() == [] and store.rows().count() == 0
    assert restore(files, store.rows()).filter("restored").count() == 0
    assert store.add(spark.createDataFrame([("s", "a", "a0"), ("s", "b", "b0")], schema)) == 1
    assert store.add(spark.createDataFrame([("s", "a", "a1")], schema)) == 2
    (tmp_path / "store" / "generation=3").mkdir()  # one that was not finished
    assert store.generations() == [1, 2]
    back = {which: sorted(tuple(r) for r in store.restore(files, which).collect()) for which in ("first", "last")}
    assert back["first"] == [("s", "a", "a0", True), ("s", "b", "b0", True), ("s", "c", "c0", False)]
    assert back["last"] == [("s", "a", "a1", True), ("s", "b", "b0", True), ("s", "c", "c0", False)]
    store.clear()
    assert store.generations() == [] and store.add(files) == 1
    with pytest.raises(ValueError):
        store.rows("other")
