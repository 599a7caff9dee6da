"""The pipeline's stages: columns of any name, nulls, repeats, and run() against its stages one by one."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quillon.llm import lines, mixing, packing, simhash, toxicity

#: Names that the stages use inside.
NAMES = """key dropped _key _kept _lines _dropped at d t s z copies size turn copy _id _uid _rank own id uid n rank text_hash group last tokens row part tail fp p toxic score pos leaf template
sources texts block order chance whole target taken""".split()


def documents():
    draw = random.Random(12)
    common, bad = [f"word{k}" for k in range(200)], [f"vile{k}" for k in range(9)]
    made = []
    for d in range(260):
        words = [draw.choice(common) for _ in range(draw.randrange(30, 120))]
        if d % 6 == 0:
            words[5:5] = [draw.choice(bad) for _ in range(12)]
        at = draw.randrange(5, 25)
        text = " ".join(words[:at]) + "\n" + ("All rights of these pages are reserved here\n" if d % 4 == 1 else "") + " ".join(words[at:])
        made.append((d, text, "abc"[d % 3]))
    made += [(300 + k, made[7][1] + f" extra{k}", "a") for k in range(20)] + [(7, made[7][1], "b"), (None, None, None), (None, "", "a"), (400, None, "c"), (401, "", None)]
    return made


def table(spark, rows):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in NAMES)) for r in rows], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, 1, int(d % 6 == 0), "x") for d in range(260)] + [(None, 1, 1, "x"), (5, 1, None, "x")], "doc_id long, quality int, toxic int, text string")


def test_stages_keep_columns_of_any_name(spark, labels):
    docs = table(spark, documents())
    stages = [lambda x: toxicity.without_toxic(x, labels), lines.without_boilerplate, simhash.keep_one, mixing.mixed_documents]
    for stage in stages:
        got = stage(docs)
        assert got.columns == docs.columns
        for r in got.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in NAMES)
    assert packing.pack(docs).count() > 0
    for stage in stages:
        assert stage(docs.limit(0)).collect() == []


def test_each_stage_does_its_work(spark, labels):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    clean = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert len(clean & {d for d in range(260) if d % 6 == 0}) <= 3 and len(clean & {d for d in range(260) if d % 6}) >= 210
    kept = lines.without_boilerplate(docs).collect()
    assert len(kept) == len(documents()) and not any("All rights" in (r.text or "") for r in kept)
    assert Counter(r.text is None for r in kept)[True] == 2
    once = Counter(r.doc_id for r in simhash.keep_one(docs).collect())
    assert once[7] == 1 and not any(once[300 + k] for k in range(20)) and sum(once.values()) == 261  # the four texts without words are one group
    sizes = Counter()
    for _, t, s in documents():
        sizes[s] += len((t or "").split())
    taken = Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[r.source] += len((r.text or "").split())
    want = {r.source: r.target for r in mixing.targets(docs.selectExpr("source", "size(regexp_extract_all(coalesce(text, ''), '([^ \\n]+)', 1)) size")).collect()}
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)


def test_run_is_its_stages_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, s, "en", len(t or "")) for d, t, s in documents()], "doc_id long, text string, source string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 6 == 0)) for d in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at.write.mode("overwrite").parquet(f"{tmp_path}/stage{k}")
        at = stage(spark, spark.read.parquet(f"{tmp_path}/stage{k}"), str(tmp_path))
        if k < 4:
            assert at.columns == docs.columns
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, whole.select(*key).collect())) == Counter(map(tuple, at.select(*key).collect()))
