"""The pipeline's stages beside what was planted, and the registered corpus queries beside their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimspark.llm import common, pieces, queries

from ..oracle import compare, connect
from .conftest import SF


@pytest.fixture(scope="module")
def planted(spark, docs_of, words, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(120):  # clean documents, half of them labelled
        rows.append((i, "\n".join(" ".join(words(25, 40 * i + k)) for k in range(3))))
        labels.append((i, 1, 0))
    for i in range(200, 230):
        w = words(60, 7000 + i)
        rows.append((i, " ".join([*w[:30], "scumbag" if i % 2 else "sc|_|mbag".replace("|_|", "u"), *w[30:]])))
        labels.append((i, 0, 1))
    rows += [(300, rows[5][1]), (301, rows[6][1] + "\n" + " ".join(words(40, 9001)))]  # a copy, and a document that repeats lines
    base = words(200, 9100)
    rows += [(310, " ".join(base)), (311, " ".join([*base[:100], "differs", *base[101:]]))]  # near duplicates
    item = " ".join(words(20, 9200))
    rows.append((320, " ".join([*words(30, 9300), item.replace("a", "e", 1), *words(30, 9400)])))
    rows += [(330, None), (331, "")]
    docs_of(rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, dict(rows)


def test_stages(spark, planted):
    sf, rows = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, gone = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        gone[name] = before - {r["doc_id"] for r in docs.collect()}
    clean = set(range(120))
    assert gone["toxicity"] == set(range(200, 230))
    # the repeated lines go from 300 and 301; of the near duplicates one line is like the other
    assert gone["line dedup"] | gone["near duplicates"] == {300, 311} and 300 in gone["line dedup"]
    assert gone["benchmark decontamination"] == {320}
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert clean <= kept.keys() and all(kept[i]["text"] == rows[i] for i in clean)
    assert kept[301]["text"] == rows[301].rsplit("\n", 1)[1] and kept[301]["n_chars"] == len(kept[301]["text"])
    assert kept[330]["text"] is None and kept[331]["text"] == ""


def test_run(spark, planted):
    from sentencepiece import SentencePieceProcessor

    sf, _ = planted
    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    want = {r["doc_id"]: None if r["text"] is None else sp.encode(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_of_awkward_rows(spark, planted, awkward):
    """Nulls, empty and long texts, repeats; columns named like the operators' own keep their values."""
    sf, _ = planted
    docs = awkward.withColumn("predicted", F.lit("mine")).withColumn("n_removed", F.lit(-1)).withColumn("kept", F.col("doc_id")).withColumn("a.b", F.lit(2.5))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = common.saved(docs)
    rows = docs.collect()
    assert all((r["score"], r["n_lines"], r["predicted"], r["n_removed"], r["a.b"], r["cluster"], r["z"]) == ("x", "y", "mine", -1, 2.5, "c", "z") for r in rows)
    assert all(r["kept"] == r["doc_id"] and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 7, 8, 9, None}  # 6 is like 5
    assert [r["text"] for r in rows if r["doc_id"] == 8] == ["same row"] * 2
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert corpus_pipeline.encode_pieces(spark, docs, sf).count() == len(rows)


def test_stages_of_nothing(spark, planted, docs_of):
    sf, _ = planted
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    compare(queries.queries()[name](spark, SF), connect(SF).sql(queries.oracle_sql()[name]))
