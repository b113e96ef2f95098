"""Folds, graphs, reviews, readers and writers on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import geometry as g
from inkstrata.functions import hashing, numeric, text
from inkstrata.operators import folds, graph, manifest, review, selection, spatial, tiles, votes
from inkstrata.plans import catalogue, catalogue_drafts, resources
from inkstrata.sources import readers, writers


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_tile_starts_and_ladder(spark):
    r = one(spark, a=tiles.starts(F.lit(1280), F.lit(512), F.lit(128)), b=tiles.starts(F.lit(100), F.lit(512), F.lit(128)), l=tiles.ladder(F.lit(512), F.lit(16), F.lit(128)), c=tiles.crop_origins(F.lit(1000), F.lit(384), 8))
    assert r.a == [0, 384, 768] and r.b == [0] and [tuple(x) for x in r.l[:3]] == [(512, 128), (384, 96), (320, 80)] and r.c == [0, 308, 616]


def test_tapers_add_to_one(spark):
    t = spark.range(128).select((numeric.cosine_taper(F.col("id"), F.lit(128), F.lit(0), F.lit(128)) + numeric.cosine_taper(F.col("id"), F.lit(128), F.lit(128), F.lit(0))).alias("s"))
    assert all(abs(r.s - 1) < 1e-5 for r in t.collect())


def test_floor_division_of_negatives(spark):
    r = one(spark, a=numeric.floor_div(F.lit(-7), F.lit(2)), b=numeric.ceil_div(F.lit(-7), F.lit(2)), c=numeric.ceil_div(F.lit(7), F.lit(2)), d=numeric.half_even(F.lit(2.5)), e=numeric.half_even(F.lit(-3.5)))
    assert tuple(r) == (-4, -3, 4, 2, -4)


def test_print_geometry(spark):
    nine = resources.print_geometry(F.lit(9000), F.lit(100), F.lit(96.0), F.lit(9000.0), F.lit(0.0))
    wide = resources.print_geometry(F.lit(9000), F.lit(100), F.lit(96.0), F.lit(100000.0), F.lit(100.0))
    r = one(spark, a=nine["denominator"], b=wide["denominator"])
    assert (r.a, r.b) == (2, 21)


def test_vote_keeps_a_single_engine_yellow(spark):
    rows = [(1, "SALE HOT", votes.PADDLE, 0.99)] * 3 + [(1, "SALE HOT", votes.TESSERACT, 0.50)]
    (r,) = votes.gated(votes.weighted_vote(spark.createDataFrame(rows, "cluster int, text string, engine string, confidence double"))).collect()
    assert r.status == "yellow" and r.reasons == ["independent_engine_confidence_below_green_gate", "recognition_confidence_below_green_gate"]


def test_recognition_tables_keep_lone_quotes(spark, tmp_path):
    rows = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext", '5\t1\t1\t1\t1\t1\t10\t10\t80\t20\t93\tSALE "HOT', "5\t1\t1\t1\t2\t1\t12\t42\t88\t20\t91\t35.000đ", "4\t1\t1\t1\t2\t0\t0\t0\t9\t9\t-1\t"]
    (tmp_path / "a.tsv").write_text("\n".join(rows) + "\n", encoding="utf-8")
    lines = votes.assemble_lines(readers.recognition_tsv(spark, str(tmp_path / "a.tsv")), ["block_num", "par_num", "line_num"]).orderBy("line_num").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.text) for r in lines] == [(10, 10, 90, 30, 'SALE "HOT'), (12, 42, 100, 62, "35.000đ")]


BOXES = "image int, id long, x0 long, y0 long, x1 long, y1 long"


def test_overlap_join_finds_each_pair_once(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(120):
        x, y = rng.randint(-40, 90), rng.randint(-40, 90)
        rows.append((i % 2, i, x, y, x + rng.randint(0, 70), y + rng.randint(0, 40)))
    b = spark.createDataFrame(rows, BOXES)
    for reach in (0, 11):
        got = sorted((r.a_id, r.b_id) for r in spatial.overlap_join(b, b, ["image"], cell=16, reach=reach).collect())
        meets = lambda p, q: min(p[4], q[4]) + 2 * reach > max(p[2], q[2]) and min(p[5], q[5]) + 2 * reach > max(p[3], q[3])
        assert got == sorted((p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and meets(p, q))


def test_suppression_leaves_no_duplicates(spark):
    rows = [(1, 1, 0, 0, 10, 10, 0.9, 1), (1, 2, 0, 0, 10, 9, 0.8, 1), (1, 3, 30, 30, 40, 40, 0.7, 1), (1, 4, 0, 0, 10, 10, 0.9, 2)]
    d = spark.createDataFrame(rows, "image int, raw_id long, x0 long, y0 long, x1 long, y1 long, score double, component_id int")
    assert sorted((r.raw_id, r.component_id) for r in folds.component_nms(d, ["image"]).collect()) == [(1, 1), (3, 1)]


def test_replacement_moves_to_the_end_or_stays_in_place(spark):
    rows = [(1, 1, 0, 0, 10, 10, 0.5, "a"), (1, 2, 50, 50, 60, 60, 0.5, "a"), (1, 3, 0, 0, 10, 10, 0.9, "a"), (1, 4, 0, 0, 10, 10, 0.95, "b")]
    d = spark.createDataFrame(rows, "image int, id long, x0 long, y0 long, x1 long, y1 long, score double, label string")
    assert [r.id for r in folds.detections(d, ["image"], "id").collect()] == [4, 3, 2]
    layers = d.withColumn("category", F.lit("object")).drop("label")
    assert [r.id for r in folds.layer_suppression(layers, ["image"], "id").collect()] == [4, 2]


def test_clusters_follow_the_moving_median(spark):
    rows = [(1, 1, 0, 0, 100, 20), (1, 2, 4, 1, 104, 21), (1, 3, 300, 0, 380, 20), (1, 4, 2, 60, 90, 80)]
    d = spark.createDataFrame(rows, "image int, reading long, x0 long, y0 long, x1 long, y1 long")
    got = {r.reading: r.cluster for r in folds.reading_clusters(d, ["image"]).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_names_stay_apart(spark):
    rows = [("a/X.png", "a", "X", ".png", 3), ("a/x.JPG", "a", "x", ".JPG", 3), ("a/x.jpg", "a", "x", ".jpg", 3), ("a/y.png", "a", "y", ".png", 1)]
    d = spark.createDataFrame(rows, "relative string, parent string, stem string, suffix string, same_stem long")
    out = [r.stem_out for r in folds.output_names(d, ["parent"]).orderBy("relative").collect()]
    assert len({x.lower() for x in out}) == 4 and "y" in out and "X_png" in out


def test_contexts(spark):
    d = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([100, 80, 20, 200, 5])], "doc int, ord int, text string")
    assert [r.context for r in folds.context_groups(d, ["doc"], "ord", "text").orderBy("ord").collect()] == [0, 0, 1, 2, 3]
    many = spark.createDataFrame([(1, i, "a") for i in range(17)], "doc int, ord int, text string")
    assert [r.context for r in folds.context_groups(many, ["doc"], "ord", "text").orderBy("ord").collect()] == [0] * 8 + [1] * 8 + [2]


def test_cycles_and_missing_parents(spark):
    rows = [(1, None, "object", 1), (2, 1, "object", 2), (3, 9, "object", 0), (4, 5, "object", 0), (5, 4, "object", 0)]
    d = spark.createDataFrame(rows, "id long, parent long, category string, display_order int")
    assert sorted(r.id for r in graph.in_cycle(d).collect()) == [4, 5]
    assert {r.id: r.depth for r in graph.paths(graph.repaired(d)).collect()} == {1: 0, 2: 1, 3: 0}


def test_components_of_a_path(spark):
    nodes = spark.range(40).withColumnRenamed("id", "n")
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)], "a long, b long")
    got = {r.n: r.component for r in graph.components(nodes, edges, "n").collect()}
    assert all(got[i] == 0 for i in range(26)) and all(got[i] == i for i in range(26, 40))


def test_merge_is_fail_closed(spark):
    h = lambda x: format(x, "064x")
    current = spark.createDataFrame([(h(1),), (h(2),)], "fingerprint string")
    rows = [(h(1), h(1), "keep", ""), (h(3), h(3), "replace", "x"), (h(4), h(4), "pending", ""), (h(5), h(6), "keep", ""), ("zz", "zz", "pending", "")]
    merged, problems = review.merge_decisions(current, spark.createDataFrame(rows, "fingerprint string, recomputed string, action string, approved_text string"))
    assert {r.fingerprint: r.action for r in merged.collect()} == {h(1): "keep", h(2): "pending"}
    assert sorted((r.fingerprint, r.problem) for r in problems.collect()) == sorted([(h(3), "stale"), (h(5), "stale"), (h(5), "tampered"), ("zz", "malformed")])
    with pytest.raises(ValueError):
        review.require_none(problems, "review")


def test_compare_and_swap(spark):
    t = spark.createDataFrame([("a", "pending", "", 1), ("b", "pending", "", 1), ("c", "keep", "", 2), ("d", "pending", "", 1)], "k string, action string, approved_text string, version long")
    d = spark.createDataFrame([("a", 1, "replace", " né "), ("b", 0, "keep", ""), ("c", 2, "replace", " "), ("d", 1, "keep", ""), ("d", 1, "skip", ""), ("x", 1, "keep", "")], "k string, expected_version long, action string, approved_text string")
    updated, rejected = review.apply_decisions(t, d, "k")
    got = {r.k: (r.action, r.approved_text, r.version) for r in updated.collect()}
    assert got == {"a": ("replace", "né", 2), "b": ("pending", "", 1), "c": ("keep", "", 2), "d": ("pending", "", 1)}
    assert {r.k: r.why for r in rejected.collect()} == {"b": "version_conflict", "c": "no_clean_text", "d": "conflicting_decisions", "x": "unknown_row"}
    assert {r.k: r.action for r in review.keep_pending(t).collect()} == {"a": "keep", "b": "keep", "c": "keep", "d": "keep"}


def test_readers(spark, tmp_path):
    d = spark.createDataFrame([("﻿" + '{"id": 1}',), ("",), ("[1]",), ("{bad",)], "value string")
    assert [(r.ok, r.request.id if r.ok else None) for r in readers.json_lines(d, "id INT").collect()] == [(True, 1), (False, None), (False, None)]
    m = spark.createDataFrame([("A" * 64 + "  m\\x.bin",), ("# c",), ("short  x",), ("b" * 64 + "  ../up",), ("c" * 64 + "  m/x.bin",)], "value string")
    entries, problems = readers.hash_manifest(m)
    assert sorted(r.problem for r in problems.collect()) == ["malformed", "repeated", "unsafe_path"] and entries.count() == 3
    pins, bad = readers.pinned(spark.createDataFrame([("A.b_c==1.0",), ("a-b-c==2",), ("x>=1",)], "value string"))
    assert {r.package for r in pins.collect()} == {"a-b-c"} and sorted(r.problem for r in bad.collect()) == ["not_a_pin", "repeated"]
    for name in ("b.PNG", "sub/a.jpg", "skip/c.png", "x.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"12")
    assert [r.relative for r in readers.image_files(spark, str(tmp_path), ("skip",)).collect()] == ["b.PNG", "sub/a.jpg"]


def test_published_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        writers.published(spark, root)
    writers.publish(spark.range(3), root)
    writers.publish(spark.range(5), root)
    assert writers.published(spark, root).count() == 5
    r = one(spark, a=writers.recovery(F.lit(False), F.lit(True), F.lit("old_moved")), b=writers.recovery(F.lit(False), F.lit(False), F.lit("old_moved")), c=writers.recovery(F.lit(True), F.lit(True), F.lit("published")), d=writers.recovery(F.lit(True), F.lit(True), F.lit("?")))
    assert tuple(r) == ("restore_backup", "error_ambiguous", "drop_backup_and_journal", "error_unknown_phase")


def test_layout_plan(spark):
    d = spark.createDataFrame([("b", "manifest.json", "PASS"), ("b", "x_REPAIRED_x4.png", "PASS"), ("b", "technical/_other/note", "PASS"), ("b", "note/a.txt", "PASS"), ("b", "TECHNICAL/source.png", "PASS"), ("b", "a_SOURCE_NORMALIZED.png", "PASS")], "bundle string, path string, status string")
    plan, problems = manifest.layout_plan(d, "bundle", "status")
    assert {r.path: r.destination for r in plan.collect()}["x_REPAIRED_x4.png"] == "RESULT.png"
    assert sorted((r.k, r.problem) for r in problems.collect()) == [("technical/_other/note", "file_and_folder"), ("technical/source.png", "claimed_twice")]


def test_text_and_hashes(spark):
    d = spark.createDataFrame([("  a  b \n",), ("",), (None,)], "t string")
    assert [r.c for r in d.select(text.clean_ocr(F.col("t")).alias("c")).collect()] == ["a b", "", None]
    e = text.edge_whitespace(F.lit(" \n x y \t"))
    r = one(spark, p=e["prefix"], c=e["core"], s=e["suffix"], t=text.scale_tag(F.lit(2.5)), u=text.scale_tag(F.lit(4.0)), k=text.is_critical(F.lit("Hotline")), n=text.is_critical(F.lit("plain words")))
    assert tuple(r) == (" \n ", "x y", " \t", "2p5", "4", True, False)
    import hashlib
    import json

    want = hashlib.sha256(b"V7_REVIEW_REGION_V1\0" + json.dumps({"bbox": [1, 2, 3, 4], "selected_text": 'é/"x'}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, f=hashing.region_fingerprint(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), F.lit('é/"x'))).f == want


def test_position_and_gates(spark):
    r = one(spark, h=g.position_hint(g.Box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), F.lit(100), F.lit(100)), p=g.placed(F.lit("middle"), F.lit(0), F.lit(5), F.lit(10)))
    assert (r.h, r.p) == ("top_left", -3)
    claims = spark.createDataFrame([("use", True, True), ("use", True, False), ("use", False, None)], "decision string, simulated boolean, verified boolean")
    assert [r.decision for r in selection.after_render(claims).collect()] == ["use", "fallback_after_render_verification", "fallback"]


def test_entry_without_the_llm_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "inkstrata"), tmp_path / "inkstrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_join_grows_up_and_down_by_its_own_reach(spark):
    import random

    rng = random.Random(2)
    rows = [(i % 2, i, x, y, x + rng.randint(0, 70), y + rng.randint(0, 40)) for i in range(120) for x, y in [(rng.randint(-400, 400), rng.randint(-40, 90))]]
    b = spark.createDataFrame(rows, BOXES)
    got = sorted((r.a_id, r.b_id) for r in spatial.overlap_join(b, b, ["image"], reach=96, reach_y=0).collect())
    meets = lambda p, q: min(p[4], q[4]) + 192 > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3])
    assert got == sorted((p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and meets(p, q))


def test_dealt_boxes_are_never_broadcast(spark, sf):
    """A dealt side has many times its file's rows; 1.2 million boxes of 5 MB on disk took more than the driver has."""
    assert "BroadcastHashJoin" not in _plan(catalogue.visual_rows(spark, sf))


def test_residual_joins_code_stays_small_enough_to_be_compiled(spark, sf, capsys):
    """Java compiles no method of over 8,000 bytes; the join's condition was interpreted."""
    import re

    df = catalogue.residual_joins(spark, sf)
    assert "BroadcastHashJoin" not in _plan(df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        catalogue.residual_joins(spark, sf).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))) < 8000


def test_components_and_rows_broadcast_no_labels(spark, sf, monkeypatch):
    plans, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df, name: (plans.append(_plan(df)), cut(df, name))[1])
    plans.append(_plan(catalogue_drafts.text_rows(spark, sf)))
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p for p in plans)
