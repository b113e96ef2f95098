import itertools
import random

from tests.llm.test_pii import base

import corpus_pipeline as p
from inkstrata.llm import common, simhash
from inkstrata.llm.common import written


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = [docs]
    for _, stage in p.STAGES:
        kept.append(written(stage(spark, kept[-1], sf), "stage"))
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    assert all(k.columns == list(p.COLUMNS) for k in kept[:-1])
    # toxicity: clean documents stay
    gone = set(rows[0]) - set(rows[1])
    assert sum(labels.get(k) == 0 for k in gone) <= 0.02 * sum(v == 0 for v in labels.values())
    # near duplicates: of alike documents one stays, the smallest id; unlike ones stay
    shingles = {k: shingled(rows[1][k].text) for k in rows[1]}
    alike = {(a, b): jaccard(shingles[a], shingles[b]) for a, b in itertools.combinations(sorted(shingles), 2) if shingles[a] & shingles[b]}
    assert not any(j >= 0.9 and a in rows[2] and b in rows[2] for (a, b), j in alike.items())
    near = {b for (_, b), j in alike.items() if j >= 0.5}
    assert set(rows[1]) - set(rows[2]) <= near
    # decontamination: no item is left whole, nothing else goes
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in rows[3][k].text for k in rows[3] for i in items)
    leaking = {k for k in rows[2] if any(len(shingled(i) & shingled(rows[2][k].text)) >= 0.3 * len(shingled(i)) for i in items)}
    assert set(rows[2]) - set(rows[3]) <= leaking
    # PII: all stay, none of the base spans is left
    assert set(rows[4]) == set(rows[3])
    for k, r in rows[4].items():
        assert r.n_chars == len(r.text)
        assert base(r.text) == "" or base(rows[3][k].text) != base(r.text)
    assert set(rows[5]) == set(rows[4]) and all(len(r.ids) == r.n_tokens for r in rows[5].values())


def test_odd_documents(spark, tmp_path):
    rows = [(1, "some words in a row here", "en", "s", 1), (1, "some words in a row here", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id at all in this one", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = sorted(str(r.doc_id) for r in p.run(spark, d).collect())
    assert out == ["1", "2", "None"]  # 2 and 3 are both without words
    assert simhash.near_duplicates(docs).count() == 5
    empty = str(tmp_path / "empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert p.run(spark, empty).count() == 0


def test_null_and_repeated_ids_by_row(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    item, clean, twice, other, copy = (prose(60) for _ in range(5))
    leaking, private = prose(40) + " " + item + " " + prose(40), prose(8) + " jane.doe@example.org " + prose(40)
    rows = [(None, clean), (None, leaking), (None, private), (7, twice), (7, twice), (7, other), (8, copy), (None, copy)]
    d = str(tmp_path)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in p.STAGES[1:4]:
        docs = written(stage(spark, docs, d), "stage")
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=str)
    want = [(None, clean), (None, private.replace("jane.doe@example.org", "[EMAIL]")), (7, twice), (7, other), (8, copy)]
    assert got == sorted([(k, t, len(t)) for k, t in want], key=str)


def test_decontamination_fits_on_no_sample(spark, tmp_path, monkeypatch):
    from inkstrata.llm import decontaminate

    def sampled(*a, **k):
        raise AssertionError("a sample")

    monkeypatch.setattr(decontaminate, "sampled_bags", sampled)
    say = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    spark.createDataFrame([(0, say("item", 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, say(f"d{i}", 70) + (" " + say("item", 40) if i == 7 else ""), "en", "s", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.drop_leaks(spark, docs, str(tmp_path)).collect()) == [i for i in range(30) if i != 7]


def test_intermediate_tables_have_no_marker(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    some, none = written(spark.range(5), "some"), written(spark.range(5).where("id > 9"), "none")
    assert sorted(r.id for r in some.collect()) == list(range(5)) and none.collect() == [] and none.dtypes == some.dtypes
    assert len(list(tmp_path.iterdir())) == 2 and all(x.name.lstrip(".").startswith("part-") for d in tmp_path.iterdir() for x in d.iterdir())
