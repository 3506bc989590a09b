"""The stages one by one against plain versions, and as a whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contentloom.llm import decontam, secrets
from tests.llm.test_joins import brute_join, corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Near copies, two languages, leaks, secrets, and rows with nulls."""
    r = random.Random(11)
    out = str(tmp_path_factory.mktemp("tables"))
    items = [(k, " ".join(f"q{r.randrange(300)}" for _ in range(30))) for k in range(5)]
    rows = []
    for k, text in corpus(21, 50):
        if k % 9 == 0:
            text += " " + items[k % 5][1]
        if k % 7 == 0:
            text += f' token = "{r.getrandbits(160):040x}" end'
        rows.append((k, text, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(text)))
    rows += [(900, None, "en", "a", None), (901, "", "en", "a", 0), (902, "12 34", None, "b", 5), (903, "word " * 30_000, "en", "a", 150_000), (904, "some words here", None, None, 15), (904, "some words here", None, None, 15), (None, "lonely text", "en", "a", 11)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 200, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, rows, items


def test_stages_and_run(spark, folder):
    out, rows, items = folder
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{out}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, docs, out)
        if k < 4:
            assert frame.columns == corpus_pipeline.COLUMNS
        frame.write.parquet(f"{out}/stage{k}")
        docs = spark.read.parquet(f"{out}/stage{k}")
        kept[name] = [tuple(x) for x in docs.collect()]
    by_stage = [kept[n] for n in names]

    assert sorted(map(str, by_stage[0])) == sorted(str(x) for x in rows if x[1] and re.search("[A-Za-z]", x[1]))

    ids = {i: c for i, _, c in brute_join([x[:2] for x in by_stage[0]])}
    want = {i for i, c in ids.items() if i == c} | {None}
    assert sorted((x[0] for x in by_stage[1]), key=str) == sorted(want, key=str)
    assert len(by_stage[1]) == len(want)

    held = [x for x in by_stage[1] if not any(re.search(re.escape(item), x[1].lower()) for _, item in items)]
    assert sorted(map(str, by_stage[2])) == sorted(map(str, held)) and len(held) < len(by_stage[1])

    clean = [(x[0], secrets.redact(x[1]), x[2], x[3], len(secrets.redact(x[1]))) for x in held]
    assert sorted(map(str, by_stage[3])) == sorted(map(str, clean)) and any("[SECRET]" in x[1] for x in clean) and not any(re.search("[0-9a-f]{16}", x[1]) for x in clean)

    assert sorted(str(x[0]) for x in by_stage[4]) == sorted(str(x[0]) for x in clean)
    assert sum(x[4] for x in by_stage[4]) == pytest.approx(1.5 * sum(x[1] for x in by_stage[4]), abs=3)
    assert sorted(map(str, map(tuple, corpus_pipeline.run(spark, out).collect()))) == sorted(map(str, by_stage[4]))


def test_nulls_and_clashing_columns(spark, folder):
    """Each stage on the raw table, with null rows and with extra columns of names that the operators use."""
    out, rows, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(["r", "n", "s1", "cid", "count", "members", "component_id", "item_id", "quality", "size", "taken"])])
    for _, stage in corpus_pipeline.STAGES:
        plain, more = stage(spark, docs, out), stage(spark, wide, out)
        assert more.columns == plain.columns
        assert sorted(str(tuple(x)) for x in more.collect()) == sorted(str(tuple(x)) for x in plain.collect())
    _, second, third, fourth, last = (stage for _, stage in corpus_pipeline.STAGES)
    without = {900: None, 901: ""}  # id and text of those without a shingle
    for stage in (second, third, fourth):
        kept = {x[0]: x[1] for x in stage(spark, docs, out).collect()}
        assert {k: kept[k] for k in without} == without and kept[None] == "lonely text"
    assert [x.n_chars for x in fourth(spark, docs, out).where("doc_id IN (900, 901)").orderBy("doc_id").collect()] == [None, 0]
    mixed = last(spark, docs, out).collect()
    assert len(mixed) == len(rows) and all(x.size == x.taken == 0 for x in mixed if x.doc_id in without)


def test_empty_tables(spark, folder):
    out, _, _ = folder
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, out)
        assert docs.collect() == []
    assert decontam.find_leaks(spark.createDataFrame([], SCHEMA), spark.read.parquet(f"{out}/benchmark.parquet")).collect() == []
