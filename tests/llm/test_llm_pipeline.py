import llm_brute as brute
import corpus_pipeline
import pytest
from test_llm_operators import DOCS, corpus, words

import random


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with junk, and tables the stages read."""
    path = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(21)
    rows = [(1000 + i, *r[1:]) for i, r in enumerate(corpus(31, 80))]
    rows += [(5000 + i, " ".join(w.upper() + "###" for w in words(rnd, 80)), "en", "junk", 0) for i in range(20)]
    rows += [(None, " ".join(words(rnd, 70)), None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    good = [r for r in rows if r[0] is not None and r[0] < 5000]
    spark.createDataFrame([(r[0], 1, 0) for r in good[::2]] + [(5000 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    passage = " ".join((good[40][1] or "ont ere").split()[:30])
    spark.createDataFrame([(1, passage), (2, "kukuku never here at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, folder)
    assert good.columns == corpus_pipeline.COLUMNS
    kept = rows_of(good)
    assert not [r for r in kept if r[0] is not None and r[0] >= 5000]
    assert sum(1 for r in kept if len((r[1] or "").split()) > 20) >= 0.9 * sum(1 for r in rows_of(docs) if (r[0] or 0) < 5000 and len((r[1] or "").split()) > 20)

    found = brute.near_components(kept)
    want = sorted((r for r, (k, _, c) in zip(kept, found, strict=True) if k is None or c is None or k <= c), key=repr)
    one = stages["near_duplicates"](spark, good, folder)
    assert rows_of(one) == want

    cut = stages["repeats"](spark, one, folder)
    texts = [(k, b[3].decode("utf-8", "ignore") if b[1] else t) for (k, t), b in zip(want, brute.cut_repeats([t for _, t in want]), strict=True)]
    assert rows_of(cut) == sorted(texts, key=repr)
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"] or "") or r["text"] in {t for _, t in want} for r in cut.collect())

    items = brute.windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    clean = stages["decontamination"](spark, cut, folder)
    bad = {k for k, t in texts if k is not None and brute.contamination(t, items)[4]}
    assert rows_of(clean) == sorted((r for r in texts if r[0] not in bad), key=repr)

    packed = stages["packing"](spark, clean, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
