import random
import re

from pyspark.sql import functions as F

from inkstrata.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c))) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "b.", "@", ".", "1", "2", "25", "255", "+", "+1 ", "-", "(", ")", " ", "😀", "é", "_", "4111111111111111", "\n", "0", "256", "%", "a@b.c", "1.2.3.4", "5500 0000-0000 0004"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    rows += [(10000, None), (10001, ""), (10002, "1" * 50_000), (10003, "a" * 50_000), (10004, "a." * 20_000 + "@b" + ".c" * 10_000), (10005, "+1" + " 2" * 30_000), (10006, "0000255.1.1.1 " + "9" * 400 + ".1.1.1")]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("found")).alias("f"), "n_ip")
    texts = dict(rows)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.b == base(texts[r.doc_id])
        assert r.f.startswith(r.b) and r.n_ip == r.b.count("ip:")


def plain_instances(t):
    """(start, end, word, seed, patterns) by walking the text."""
    stop = "\\s\"'=<>()\\[\\],;:"
    kinds = [re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), re.compile(r"[0-9]{2,7}(?:[\x20-][0-9]{2,7}){2,}(?![0-9])"), re.compile(rf"(?=[^{stop}0-9@]*[0-9@])[^{stop}]+")]
    ok = [lambda i, last: True, lambda i, last: i == 0 or t[i - 1] not in "0123456789", lambda i, last: i in (0, last) or re.match(f"[{stop}]", t[i - 1])]
    spans, i, last = [], 0, 0
    while i < len(t):
        m = next((m for k, fits in zip(kinds, ok) if fits(i, last) for m in [k.match(t, i)] if m), None)
        if m:
            spans.append(m.span())
            i = last = m.end()
        else:
            i += 1
    flat = re.sub("[\n\t\r\x0b\x0c]", " ", t.lower())
    out = []
    for n, (a, b) in enumerate(spans):
        before, after = spans[n - 1][1] if n else 0, spans[n + 1][0] if n + 1 < len(spans) else len(t)
        left = (("# # " if n else "^ ^ ") + flat[before:a].rstrip(" \"'(<[{").lstrip(" ")).rstrip(" ").split(" ")
        right = (flat[b:after].lstrip(" \"')>]}.,;:!?").rstrip(" ") + (" ^ ^" if n + 1 == len(spans) else " # #")).lstrip(" ").split(" ")
        (l2, l1), (r1, r2) = left[-2:], right[:2]
        lead = re.match(r"[^\w+]*|_*", t[a:b])[0]
        word = t[a:b][len(lead) :].rstrip("!?.,;:&%$#*-_)(\"'")
        if sum(c.isalnum() for c in word) >= 6:
            a += len(lead)
            out.append((a, a + len(word), word, bool(base(word)), [("l1", l1), ("l2l1", l2, l1), ("l2", l2), ("r1", r1), ("r1r2", r1, r2), ("r2", r2), ("l1r1", l1, r1)]))
    return out


def plain_found(texts, rounds=3, support=3, precision=0.6):
    """All spans of every text, from dictionaries of patterns and words."""
    inst = {k: plain_instances(t or "") for k, t in texts.items()}
    words, seeds = {}, set()
    for rows in inst.values():
        for _, _, w, seed, patterns in rows:
            words.setdefault(w, set()).update(patterns)
            if seed:
                seeds.add(w)
    of = {}
    for w, ps in words.items():
        for p in ps:
            of.setdefault(p, set()).add(w)
    trust = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        rate = {p: sum(trust.get(w, 0.0) for w in ws) / len(ws) for p, ws in of.items() if len(ws) >= support}
        rate = {p: r for p, r in rate.items() if r >= precision}
        trust = {w: 1.0 if w in seeds else max((rate[p] for p in ps if p in rate), default=0.0) for w, ps in words.items()}
    out = {}
    for k, rows in inst.items():
        own = [tuple(map(int, x.split(":")[1:])) for x in base(texts[k]).split(",") if x]
        more = sorted((a, b) for a, b, w, seed, _ in rows if not seed and trust[w] >= precision and not any(s < b and a < e for s, e in own))
        out[k] = ",".join([*filter(None, [base(texts[k])]), *(f"other:{a}:{b}" for a, b in more)])
    return out


def test_bootstrap_against_dictionaries(spark, sf):
    rng = random.Random(9)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    cues = ["account", "call", "from", "ref", "the"]
    ends = ["today", "again", "now", "then"]
    for i in range(150):
        kind = rng.random()
        what = f"a{i}@b.co" if kind < 0.25 else f"10.0.{i}.1" if kind < 0.5 else f"+1 (555) 555-{i:04}" if kind < 0.6 else f"AB-{i:05}" if kind < 0.9 else f"9{i:04} 12345 678"
        docs[10_000 + i] = f"some words {rng.choice(cues)} {rng.choice(['', 'no. '])}{what} {rng.choice(ends)} and {rng.choice(cues)}: '{1900 + i}00' more"
    out = {r.doc_id: r.f for r in pii.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).select("doc_id", pii.joined(F.col("found")).alias("f")).collect()}
    want = plain_found(docs)
    assert sum("other" in v for v in want.values()) >= 5
    assert out == want


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"filler text then account {4000000000000000 + k} was charged again") for i, k in enumerate(range(2, 400, 10)) if luhn(str(4000000000000000 + k))]
    assert len(rows) >= 3
    rows += [(1000, "filler text then account AB4000003-x was charged again"), (1001, "in the year 20240101 nothing was charged"), (1002, "chapter 12 of 34")]
    out = {r.doc_id: r.f for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined(F.col("found")).alias("f")).collect()}
    at = rows[-3][1].index("AB4000003-x")
    assert out[1000] == f"other:{at}:{at + 11}" and out[1001] == "" and out[1002] == ""


def test_many_matches_in_one_text(spark):
    t = "10.0.0.1 and 1234567 " * 6000 + "w" * 50_000 + "1 end"
    r = pii.find(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert r.n_ip == 6000 and pii_spans(r.base) == base(t)


def pii_spans(spans):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def test_masking(spark):
    t = "mail a@b.co or +1 (555) 555-1234 😀 end"
    df = spark.createDataFrame([(1, t), (2, "nothing"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.m for r in pii.find(df).join(df, "doc_id").select("doc_id", pii.masked(F.col("text"), F.col("found")).alias("m")).collect()}
    assert out == {1: "mail [EMAIL] or [PHONE] 😀 end", 2: "nothing", 3: None}


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a@b.co", 5), (1, "a@b.co", 5), (None, "a@b.co", 5), (2, None, 5)], "doc_id long, text string, base int")
    got = pii.find(df).collect()
    assert len(got) == 4 and sum(r.n_email for r in got) == 3
    assert pii.find(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "account 4111111111111111 x")], "doc_id long, text string")
    plan = pii.find(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
