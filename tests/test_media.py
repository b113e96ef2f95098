"""Headers, archives, sizes, names and searches on small cases with known answers."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inkstrata.operators import budget, resample
from inkstrata.sources import archives, headers, readers, writers


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I4s", len(b), k) + b + b"\0" * 4 for k, b in chunks)


def tiff(order, tags, pages=1):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    out, at = mark + struct.pack(order + "I", 8), 8
    for page in range(pages):
        entries = b"".join(struct.pack(order + "HHI", t, 3, 1) + struct.pack(order + "HH", v, 0) for t, v in tags)
        at += 2 + 12 * len(tags) + 4
        out += struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", at if page + 1 < pages else 0)
    return out


def test_headers_of_all_formats():
    ihdr = (b"IHDR", struct.pack(">IIBB", 7, 9, 8, 2) + b"\0" * 3)
    p = headers.probed(png(ihdr, (b"iCCP", b"x\0\0y"), (b"IDAT", b"")))
    assert (p["format"], p["width"], p["height"], p["mode"], p["icc"], p["error"]) == ("png", 7, 9, "RGB", True, None)
    assert headers.probed(png((b"IHDR", struct.pack(">IIBB", 7, 9, 16, 0)), (b"IDAT", b"")))["mode"] == "I;16"
    turned = headers.probed(png(ihdr, (b"eXIf", tiff(">", [(274, 6)])), (b"IDAT", b"")))
    assert (turned["width"], turned["height"], turned["orientation"]) == (9, 7, 6)
    assert headers.probed(png(ihdr, (b"acTL", struct.pack(">II", 3, 0)), (b"IDAT", b"")))["error"] == "multi_frame"
    for order in "<>":
        t = headers.probed(tiff(order, [(256, 40), (257, 30), (258, 8), (262, 2), (277, 4)]))
        assert (t["width"], t["height"], t["mode"], t["frames"], t["error"]) == (40, 30, "RGBA", 1, None)
        assert headers.probed(tiff(order, [(256, 4), (257, 3), (262, 1)], 2))["error"] == "multi_frame"
    extended = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0" + bytes([0x30, 0, 0, 0]) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    w = headers.probed(extended)
    assert (w["width"], w["height"], w["mode"], w["icc"], w["error"]) == (100, 50, "RGBA", True, None)
    lossless = b"RIFF\0\0\0\0WEBPVP8L\x05\0\0\0\x2f" + (99 | 49 << 14 | 1 << 28).to_bytes(4, "little")
    assert [headers.probed(lossless)[k] for k in ("width", "height", "mode")] == [100, 50, "RGBA"]
    assert [headers.probed(b"BM" + b"\0" * 16 + struct.pack("<iiHH", 5, -6, 1, 8))[k] for k in ("width", "height", "mode")] == [5, 6, "P"]
    for broken in (None, b"", b"GIF89a", b"BM", b"\xff\xd8\xffxyz", png(), b"RIFF\0\0\0\0WAVE", tiff("<", [(256, 4)]), b"II*\0\xff\xff\xff\xff", png((b"IHDR", struct.pack(">IIBB", 0, 9, 8, 2)))):
        assert headers.probed(broken)["error"] == "not_an_image"


def test_probe_of_a_column_with_nulls(spark):
    b = spark.createDataFrame([(1, None), (2, bytearray(b"BM" + b"\0" * 16 + struct.pack("<iiHH", 5, 6, 1, 24)))], "id int, content binary")
    rows = {r.id: r.h for r in b.select("id", headers.probe("content").alias("h")).collect()}
    assert rows[1].error == "not_an_image" and rows[1].width is None and (rows[2].width, rows[2].icc, rows[2].error) == (5, False, None)


def test_archives_open_elsewhere_and_depend_on_members_alone(spark):
    rows = [("a", "b/ü.txt", b"two" * 99), ("a", "a.txt", b""), ("b", "x", None), ("a", "c", bytes(range(256)) * 300)]
    make = lambda r, n: {x.k: x for x in archives.zipped(spark.createDataFrame(r, "k string, name string, content binary").repartition(n), ["k"], "name", "content").collect()}
    found = make(rows, 1)
    assert {k: bytes(v.archive) for k, v in found.items()} == {k: bytes(v.archive) for k, v in make(rows[::-1], 3).items()}
    with zipfile.ZipFile(io.BytesIO(found["a"].archive)) as z:
        assert z.testzip() is None and z.namelist() == ["a.txt", "b/ü.txt", "c"] and found["a"].members == 3
        assert {i.filename: z.read(i) for i in z.infolist()} == {n: c for k, n, c in rows if k == "a"}
        assert {(i.date_time, i.create_system, i.external_attr >> 16) for i in z.infolist()} == {((1980, 1, 1, 0, 0, 0), 3, 0o100644)}
    with zipfile.ZipFile(io.BytesIO(found["b"].archive)) as z:
        assert z.read("x") == b""
    assert make([], 1) == {}


@pytest.mark.parametrize("names", [["../x"], ["/x"], [None], ["x", "x"], ["a\\b"]])
def test_archives_refuse_names(spark, names):
    members = spark.createDataFrame([("a", n, b"1") for n in names], "k string, name string, content binary")
    with pytest.raises(PySparkException):
        archives.zipped(members, ["k"], "name", "content").collect()


def test_lanczos_keeps_flat_images_and_sizes():
    flat = np.full((9, 7, 3), 93, np.uint8)
    for size in ((7, 9), (20, 3), (1, 1), (70, 90)):
        out = resample.lanczos(flat, size)
        assert out.shape == (size[1], size[0], 3) and (out == 93).all()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (9, 7), np.uint8)
    assert (resample.lanczos(a, (7, 9)) == a).all()
    assert (resample.lanczos(a[:, ::-1], (15, 4)) == resample.lanczos(a, (15, 4))[:, ::-1]).all()
    assert (np.abs(resample.weights(11, 4).sum(1) - (1 << 22)) < 11).all()
    with pytest.raises(ValueError):
        resample.lanczos(a, (0, 3))


def test_mattes_stay_in_their_support():
    mask = np.zeros((6, 6), bool)
    mask[2:4, 2:5] = True
    assert (resample.resized_support(mask, (12, 12)) == np.kron(mask, np.ones((2, 2), bool))).all()
    grown = resample.resized_support(mask, (6, 6), runway=True)
    assert grown.sum() == 6 + 10 and (grown >= mask).all() and not grown[1, 1]
    out = resample.resized_alpha(mask, mask * np.float32(0.5), (6, 6))
    assert out.max() == np.float32(128 / 255) and (out[~mask] == 0).all()
    for bad in (np.ones((6, 6)), mask * 2.0, mask * np.nan, np.zeros((3, 3))):
        with pytest.raises(ValueError):
            resample.resized_alpha(mask, bad, (3, 3))


def test_tokens_resolve_by_place_then_extension(spark):
    files = spark.createDataFrame([("INPUT/a.png", False), ("a.png", False), ("b.jpg", False), ("INPUT/c.png", False), ("INPUT/c.webp", False), ("INPUT/d.PNG", False), ("INPUT/set", True), ("INPUT/e.tif", False), ("/x/f.bmp", False), ("INPUT/n.txt", False), ("INPUT/g.png", True)], "path string, is_dir boolean")
    want = {"a.png": ("INPUT/a.png", None), "b.jpg": ("b.jpg", None), "c": (None, "ambiguous"), "d": (None, "missing"), "d.PNG": ("INPUT/d.PNG", None), "set": ("INPUT/set", None), "e": ("INPUT/e.tif", None), "/x/f.bmp": ("/x/f.bmp", None), "/x/f": (None, "missing"), "n.txt": (None, "unsupported"), "g": (None, "missing"), None: (None, "missing"), "": (None, "missing")}
    found = readers.resolved(spark.createDataFrame([(t,) for t in [*want, "c"]], "token string"), files)
    assert {r.token: (r.path, r.problem) for r in found.collect()} == want


def test_pinned_tools_take_the_first_that_fits(spark):
    rows = [("x", "own", True, False, 0, 0, ""), ("x", "old", False, True, 1, 0, "v 1"), ("x", "bad", False, True, 2, 1, "v 2"), ("x", "new", False, True, 3, 0, "v 2"), ("x", "later", False, True, 4, 0, "v 2"), ("y", "own", True, True, 0, None, None), ("y", "old", False, True, 1, 0, "v 1"), ("z", "gone", False, False, 0, 0, "v 2"), ("z", "mute", False, True, 1, None, None)]
    c = spark.createDataFrame(rows, "k string, path string, bundled boolean, exists boolean, ord int, exit_code int, output string")
    found = {r.k: (r.path, r.incompatible) for r in readers.pinned_tools(c, ["k"], r"^v 2$").collect()}
    assert found == {"x": ("new", ["old", "bad"]), "y": ("own", []), "z": (None, ["mute"])}


def test_halving_equals_trying_all(spark):
    d = spark.range(60).select("id", budget.largest_fitting(F.lit(1), F.lit(50), lambda s: s * 3 <= F.col("id")).alias("best"))
    assert {r.id: r.best for r in d.collect()} == {i: max((s for s in range(1, 51) if 3 * s <= i), default=None) for i in range(60)}


def test_plain_json(spark):
    d = spark.sql("SELECT 1 AS id, map(2, array(X'00FF', NULL)) AS m, named_struct('b', DATE'2020-01-02', 'a', 1.50BD) AS s, CAST(NULL AS struct<q:int>) AS n")
    (r,) = writers.plain_json(d, ["id"]).collect()
    assert json.loads(r.json) == {"m": {"2": [[0, 255], None]}, "n": None, "s": {"a": 1.5, "b": "2020-01-02"}}


def test_layer_report_counts_overlaps_once(spark):
    rows = [(1, 1, "object", None, 0, 0, 4, 4), (1, 2, "object", 1, 2, 2, 6, 4), (1, 3, "text", None, 0, 0, 2, 2), (2, 4, "text", 9, 3, 3, 3, 8)]
    d = spark.createDataFrame(rows, "image int, id int, category string, parent int, x0 long, y0 long, x1 long, y1 long")
    found = {r.image: (r.layers, r.edges, r.by_category, r.coverage, r.top_level) for r in budget.layer_report(d, "image", "category", "parent", F.lit(100.0)).collect()}
    assert found == {1: (3, 1, {"object": 2, "text": 1}, 0.2, 0.16), 2: (1, 1, {"text": 1}, 0.0, 0.0)}
