"""Protected spans and text functions, by known cases and by properties."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.functions import spans as s
from inkstrata.streaming import lines


def kinds(text, **k):
    return [(x.kind, x.text) for x in s.find(text, **k)]


def test_kinds_of_a_shop_line():
    t = "TOP GIA® bán SKU-ABC-123 giá 35.000đ/chai, gọi 0902.111.333, tại 142X Nguyễn Khoái, Phường 1, Quận 4"
    found = s.find(t, addresses=["142X Nguyễn Khoái"])
    assert {x.kind for x in found} >= {"brand", "sku", "price", "phone", "address"}
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


def test_numbers_and_prices():
    assert kinds("Chai 750ml được cộng 5 điểm, niêm yết 35.000") == [("number", "750ml"), ("number", "5 điểm"), ("number", "35.000")]
    assert kinds("Giá 35.000đ") == [("price", "35.000đ")]
    assert ("brand", "Acme") in kinds("by ACME or Acme", brands=["acme"]) and ("brand", "ACME") in kinds("by ACME", brands=["acme", "Acme"])


def test_composition_is_not_compatibility():
    assert s.composed("Đồ") == "Đồ" and s.composed("Ａ①") == "Ａ①"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 019.,đ₫+()-/SKU:#\nÀé́%®", max_size=60))
def test_masking_is_lossless(t):
    for style in ("plain", "t5"):
        found = s.find(t)
        masked, marks, error = s.protect(t, found, style)
        assert error is None
        assert s.restore(masked, marks, [x.text for x in found]) == (s.composed(t), None)


def test_damaged_placeholders_are_errors():
    masked, marks, _ = s.protect("12 and 34")
    values = ["12", "34"]
    assert s.restore(masked.replace(marks[0], ""), marks, values)[1] == "placeholder_count"
    assert s.restore(masked + marks[1], marks, values)[1] == "placeholder_count"
    swapped = masked.replace(marks[0], "@").replace(marks[1], marks[0]).replace("@", marks[1])
    assert s.restore(swapped, marks, values)[1] == "placeholder_order"
    assert s.restore(masked + "__V7_PROTECTED_0009__", marks, values)[1] == "invented_placeholder"
    assert s.protect("__V7_PROTECTED_0000__ 5")[2] == "placeholder_in_text"


def test_proposals_fail_closed():
    bad = s.propose("Giá 35.000đ", "Giá 45.000đ", 0.99)
    assert not bad["safe"] and bad["proposed"] == "Giá 35.000đ" and bad["confidence"] == 0 and not bad["changed"]
    good = s.propose("ĐÔ GIA DỤNG 35.000đ", "ĐỒ GIA DỤNG 35.000đ", 0.91)
    assert good["safe"] and good["changed"] and good["confidence"] == 0.91 and good["reasons"][-1] == "human-approval-required"


def test_corrections_reach_gaps_only():
    seen = []

    def upper(gap):
        seen.append(gap)
        return gap.upper(), 0.5

    out = s.corrected("call 0902.111.333 now", upper)
    assert out["proposed"] == "CALL 0902.111.333 NOW" and seen == ["call ", " now"] and out["confidence"] == 0.5


def test_line_service():
    ok = json.loads(lines.respond('{"id": 1, "op": "propose", "text": "abc 12"}', lines.unchanged))
    assert ok["ok"] and ok["proposal"]["proposed"] == "abc 12"
    for bad, code in (("{", "worker-error"), ("[1]", "invalid-request"), ('{"op": "x"}', "unsupported-operation"), ('{"text": 5}', "invalid-request"), ('{"text": "a", "brands": [1]}', "invalid-request")):
        r = json.loads(lines.respond(bad, lines.unchanged))
        assert not r["ok"] and r["error"]["code"] == code
    assert json.loads(lines.respond('{"op": "health"}', lines.unchanged))["status"] == "ready"


def test_stream_answers_as_the_batch_does(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    text = '﻿{"id": 1, "text": "a 5"}\n\n{bad\n{"id": 2, "op": "health"}\n'
    (source / "a.txt").write_text(text, encoding="utf-8")
    q = lines.serve(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    batch = sorted(r.response for r in lines.responses(spark.read.text(str(source))).collect())
    assert got == batch and len(got) == 3
