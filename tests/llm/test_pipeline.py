import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchday.llm import common, jaccard_join, quality, suffix_dedup
from matchday.sources.tables import read_table

from .test_jaccard_join import brute as brute_components
from .test_suffix_dedup import brute as brute_spans
from .test_token_files import check_pieces

SF = "/root/testdata/sf0.001"


def test_ids_that_pass_the_filter(spark):
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "i")
    test = common.maybe_among(ids, "i")
    got = {r.id for r in spark.range(3000).filter(test(F.col("id"))).collect()}
    assert set(range(0, 3000, 7)) <= got and len(got) < 500
    assert spark.range(100).filter(common.maybe_among(ids.limit(0), "i")(F.col("id"))).count() == 0


def test_stages_equal_brute_force(spark, tmp_path):
    from matchday.llm.tokens import encoder
    docs, kept = common.documents(spark, SF), []
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
        if name != names[-1]:
            assert docs.columns == columns
    rows = common.documents(spark, SF).collect()
    labels = {r.doc_id: r for r in read_table(spark, SF, "labels").collect()}
    # quality: labelled rows are judged as labelled
    left = {r.doc_id for r in kept[0]}
    agree = [(i in left) == bool(x.quality) for i, x in labels.items()]
    assert sum(agree) / len(agree) > 0.9 and all(r in rows for r in kept[0])
    # one of each group
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in kept[0]]) if i == c}
    assert sorted(r.doc_id for r in kept[1]) == sorted(want)
    # passages
    first = sorted(kept[1], key=lambda r: r.doc_id)
    texts = [r.text.encode() for r in first]
    got = {r.doc_id: r for r in kept[2]}
    for r, t, runs in zip(first, texts, brute_spans(texts, 200, "first")):
        text = suffix_dedup.kept_bytes(t, suffix_dedup.whole_characters(t, runs)).decode()
        assert got[r.doc_id].text == text and got[r.doc_id].n_chars == len(text)
    # mixing: rows as they were, toxic ones mostly gone
    assert {r for r in kept[3]} <= {r for r in kept[2]}
    clean = [r.doc_id for r in kept[2] if r.doc_id in labels and not labels[r.doc_id].toxic]
    assert len({r.doc_id for r in kept[3]} & set(clean)) >= 0.98 * len(clean)
    # packing
    import numpy as np
    e = encoder("byte_bpe_50k.json")
    check_pieces(kept[4], [(r.doc_id, np.array([*e.whole(r.text), 1], "<u4")) for r in kept[3]])


def test_one_of_each_with_odd_ids(spark):
    text = "one two three four five six seven"
    rows = [(5, text, "a"), (3, text + " ", "b"), (None, text, "c"), (7, "alone", "d"), (7, "again", "e"), (None, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, may string")
    assert sorted(r.may for r in jaccard_join.one_of_each(docs).collect()) == ["b", "d", "e", "f", "g"]
    # of rows with one id only the linked one goes; of linked rows with null ids one stays, after all others
    other = "uno dos tres cuatro cinco seis siete"
    rows = [(1, text, "a"), (7, text, "b"), (7, "alone", "c"), (None, other, "d"), (None, other, "e"), (None, other + " .", "f"),
            (9, "x y", "g"), (9, "x y", "h"), (9, "X  y", "i"), (None, "solo", "j")]
    kept = {r.may for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, may string").repartition(3)).collect()}
    assert {"a", "c", "j", "i", "f"} <= kept and len(kept & {"d", "e"}) == 1 and len(kept) == 6 and "b" not in kept
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_quality_stage_keeps_columns_that_clash(spark, monkeypatch):
    docs = common.documents(spark, SF).withColumn("score", F.lit("x")).withColumn("label", F.lit(1))
    got = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert got.columns == docs.columns and got.count() > 100


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.filter("sequence_length = 2048").count() > 10


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_documents(spark, name):
    docs = common.documents(spark, SF).limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0
