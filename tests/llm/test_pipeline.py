"""The pipeline against a plain version of every stage, on a small corpus, and what is registered."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from compare import TABLES, connect, differences
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from evenstep.llm import quality_classifier, quality_rules
from llm_cases import CLASHING, DOCUMENTS, prose
from test_near_dedup import brute_force, edited


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: good and bad ones, near copies, a shared passage, awkward rows."""
    folder = tmp_path_factory.mktemp("corpus")
    passage = prose(500, 70)
    rows, labels = [], []
    for i in range(160):
        text = prose(i, 150)
        if i % 4 == 0:
            text = " ".join(w + "###" for w in text.split(" "))
        elif i % 10 == 1:
            # Words of its own on both sides end the passage at the same place in every document.
            text = f"{prose(i, 40)} b{i} {passage}\ne{i} {prose(1000 + i, 60)}"
        elif i % 10 == 3:
            text = edited(prose(3, 150), i % 3 + 1, i)
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(i % 4 != 0), 0))
    rows += [(300, None), (301, ""), (302, "few words"), (303, prose(303, 20_000)), (None, prose(7, 150)), (5, prose(5, 150))]
    frame = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(frame, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def _without_shared(rows, width=50):
    """Exact passages of ``width`` words or more that a document with a smaller id has, cut out word by word."""
    words = {(i, t): t.split() for i, t in rows if i is not None}
    firsts: dict[tuple, int] = {}
    for (i, _), w in sorted(words.items()):
        for k in range(len(w) - width + 1):
            firsts.setdefault(tuple(x.lower() for x in w[k : k + width]), i)
    left = []
    for i, t in rows:
        w = t.split()
        gone = {
            k + n
            for k in range(len(w) - width + 1 if i is not None else 0)
            if firsts[tuple(x.lower() for x in w[k : k + width])] < i
            for n in range(width)
        }
        left.append((i, [x for k, x in enumerate(w) if k not in gone]))
    return left


def test_stages_equal_their_plain_versions(spark, corpus):
    folder, rows = corpus
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns = docs.columns

    model = quality_classifier.learn(docs, labels)
    score = lambda t: model.calibrated(np.array([quality_classifier.measures(None if t is None else t.encode())], float))[0]
    expected = [(i, t) for i, t in rows if score(t) >= quality_classifier.THRESHOLD]
    assert not [i for i, _ in expected if i is not None and i < 160 and i % 4 == 0]
    assert len([i for i, _ in expected if i is not None and i < 160]) >= 115

    def step(name, docs, expected):
        found = stages[name](spark, docs, folder)
        assert found.columns == columns
        assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(expected, key=str)
        return found

    found = step("quality_classifier", docs, expected)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(expected)), "text": [t for _, t in expected]}))
    verdicts = con.execute(f"SELECT kept FROM ({quality_rules.judged_sql()}) ORDER BY doc_id").fetchall()
    expected = [row for row, (kept,) in zip(expected, verdicts) if kept]
    found = step("quality_rules", found, expected)
    roots = brute_force([r for r in expected if r[0] is not None])
    expected = [r for r in expected if r[0] is None or roots[r[0]] == r[0]]
    found = step("near_dedup", found, expected)

    cut = stages["substring_dedup"](spark, found, folder)
    assert cut.columns == columns
    left = sorted(((r.doc_id, r.text.split()) for r in cut.collect()), key=str)
    plain = sorted(_without_shared(expected), key=str)
    assert [i for i, _ in left] == [i for i, _ in plain]
    assert [w for _, w in left] == [w for _, w in plain]

    packed = stages["best_fit_packing"](spark, cut, folder).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = sorted(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in cut.collect())
    assert packed.length.sum() == sum(sizes)
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert packed.sequence_id.nunique() <= 1.05 * sum(sizes) / 1024 + 1


def test_run_applies_all_stages(spark, corpus):
    folder, _ = corpus
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 100


def test_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_with_clashing_names_come_through(spark, documents, tmp_path):
    texts = [prose(i, 120) for i in range(30)] + [prose(3, 120), None, ""]
    rows = [*enumerate(texts), (None, prose(40, 120)), (5, texts[5])]
    documents(rows, CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    # Labels of one kind teach nothing, so that all documents go on.
    spark.createDataFrame([(i, 1, 0, "x") for i in range(4)], "doc_id long, quality int, toxic int, score string").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() > 0 and packed.where("doc_id is null").count() > 0


def test_stages_leave_only_their_results(spark, corpus, tmp_path):
    folder, _ = corpus
    before = spark.conf.get("spark.evenstep.storage", None)
    spark.conf.set("spark.evenstep.storage", str(tmp_path))
    try:
        assert corpus_pipeline.run(spark, folder).count() > 100
        assert len([p for p in tmp_path.iterdir() if any(p.iterdir())]) == len(corpus_pipeline.STAGES)
    finally:
        spark.conf.unset("spark.evenstep.storage") if before is None else spark.conf.set("spark.evenstep.storage", before)


@pytest.mark.parametrize("name", sorted(driver.LLM_ORACLES))
def test_query_equals_its_sql(spark, name):
    if not (TABLES / "sf0.01").exists():
        pytest.skip("no driver tables here")
    got = driver.queries()[name](spark, str(TABLES / "sf0.01")).toPandas()
    assert differences(got, connect("sf0.01").execute(driver.oracle_sql()[name]).df()) is None


def test_one_query_for_each_operator():
    names = [n.split("_")[0] for n in driver.queries() if n.startswith("op")]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{n}" for n in range(1, 14)] and "pipeline" in driver.queries()
