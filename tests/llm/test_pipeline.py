import hashlib
import random
from collections import Counter

import corpus_pipeline
from eventloom.llm import exact_dedup, jaccard, queries, suffix_dedup
from eventloom.llm.shared import documents

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = documents(spark, FOLDER)
    assert len(corpus_pipeline.STAGES) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, before, FOLDER), name)
        assert after.columns == docs.columns
        assert 0 < after.count() <= before.count()
        before = after
    assert exact_dedup.exact_groups(docs).where("kept").count() < docs.count()
    assert before.count() == before.select("doc_id").distinct().count()


def test_near_stage_leaves_one_of_each_group(spark):
    docs = documents(spark, FOLDER)
    groups = jaccard.near_duplicates(docs, 5, 80).select("component_id").distinct().count()
    assert jaccard.one_of_each(docs).count() == groups


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns[:2] == ["doc_id", "piece"]
    full = rows.groupBy("sequence_id").sum("length").toDF("sequence_id", "n")
    assert full.where("n > 2048").count() == 0


def test_copies_go_that_share_an_id_or_have_none(spark):
    rng = random.Random(5)
    bases = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(8)]
    rows = []
    for k, base in enumerate(bases):
        near = f"{base} end{k}"
        rows += [(None, base, "a"), (None, base, "b"), (None, near, "c")]  # without an id
        rows += [(k, f"own {k} {base}", "a")] * 3 if k % 2 else []  # repeated rows
    for k in range(8):
        rows += [(100, f"{bases[k][::-1]} {n}", "d") for n in range(3)]  # near copies of several groups under one id
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exact = corpus_pipeline.stored(exact_dedup.without_copies(docs), "exact")
    assert Counter((x.doc_id, x.text) for x in exact.collect()) == Counter({x[:2] for x in rows})
    near = corpus_pipeline.stored(jaccard.one_of_each(exact), "near")
    left = [(x.doc_id, x.text) for x in near.collect()]
    assert len(left) == 16 and near.columns == docs.columns
    assert sum(d is None for d, _ in left) == 4 and sum(d == 100 for d, _ in left) == 8
    assert sorted(d for d, _ in left if d is not None and d < 100) == [1, 3, 5, 7]
    shared = "this passage of far more than fifty bytes stands in each of these rows, word for word. "
    rows = [(d, f"{shared}{n} is here", n) for d, n in [(None, "one"), (None, "two"), (7, "three"), (7, "four"), (8, "five")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = suffix_dedup.by_row(docs)
    assert found.columns == docs.columns
    assert Counter((x.doc_id, x.source) for x in found.collect()) == Counter((d, n) for d, _, n in rows)
    texts = {x.source: x.text for x in found.collect()}
    first = min(("one", "two"), key=lambda n: hashlib.sha256(f"{shared}{n} is here".encode()).digest())
    assert [n for n, x in texts.items() if shared.strip() in x] == [first]
    assert all(x.endswith(" is here") for x in texts.values())


def test_registered():
    names = list(queries.queries())
    assert [n for n in range(1, 11) if any(x.startswith(f"op{n}_") for x in names)] == list(range(1, 11))
    assert "pipeline" in names
    assert queries.oracle_sql().keys() <= queries.queries().keys()
