"""The pipeline's stages on the smallest tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, columns, left = [n for n, _ in corpus_pipeline.STAGES], docs.columns, docs
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, left, SF)
        assert out.columns == columns and out.join(left, columns, "left_anti").count() == 0
        assert 0 < out.count() <= left.count()
        left = out
    assert left.select("doc_id").distinct().count() == left.count()
    mixed = corpus_pipeline.STAGES[3][1](spark, left, SF)
    assert mixed.columns == columns and mixed.count() > 0
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == mixed.count() and sorted(r.start for r in rows)[0] == 0


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows, texts without words, clashing columns and empty tables through every stage."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    rows = [tuple(r) for r in base]
    rows += [rows[3], (9001, None, None, None, 0), (9002, "", "en", None, 0), (9003, " \n ", "en", "src1", 0), (None, rows[5][1], "en", "src1", 9), (9004, rows[6][1], "en", "src2", 9)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, posterior double, rid string, n_words int"
    docs = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], kind)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.join(docs, docs.columns, "left_anti").where("text is not null and doc_id is not null and lang is not null and source is not null").count() == 0
        none = stage(spark, docs.where("false"), SF)
        assert none.columns == docs.columns and none.count() == 0
    ids = lambda d: sorted(str(r.doc_id) for r in d.select("doc_id").collect())
    near = ids(corpus_pipeline.near_duplicates(spark, docs, SF))
    assert near.count(str(rows[3][0])) == 1 and "9004" not in near and "None" not in near and {"9001", "9002", "9003"} <= set(near)
    clean = ids(corpus_pipeline.decontamination(spark, docs, SF))
    assert {"9001", "9002", "9003"} <= set(clean)
    assert not {"9001", "9002", "9003"} & set(ids(corpus_pipeline.weighted_mix(spark, docs, SF))) | set(ids(corpus_pipeline.quality_rules(spark, docs, SF))) & {"9001", "9002", "9003"}
    last = corpus_pipeline.STAGES[4][1]
    assert last(spark, docs, SF).count() == len(rows) and last(spark, docs.where("false"), SF).count() == 0
