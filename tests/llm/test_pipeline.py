"""The pipeline's stages on odd and empty tables, and the mix's keys."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voltloom.llm import durable, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic string, row string, piece string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(4)
    words = "market price wind solar unit plant load curve offer".split()
    rows = [(k, " ".join(r.choices(words, k=60)) + (" vilezor hateword" if k % 5 == 0 else ""), "en", "ab"[k % 2], 1, None, "x", "y") for k in range(80)]
    rows += rows[:7] + [(200, rows[3][1] + " more", "en", None, 1, "x", "y", None), (None, rows[4][1], None, "a", None, None, None, None), (None, "no id here but words of its own", "en", "b", 1, "x", "y", "z")]
    rows += [(300, None, None, None, None, None, None, None), (301, "", "en", "a", 0, "x", "y", "z"), (302, " \t\n", "en", "b", 3, "x", "y", "z"), (303, "long words here " * 9000, "en", "a", 1, "x", "y", "z")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(0, 80)] + [(None, 0, 1), (3, None, None)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def stages(spark, folder):
    after = spark.read.parquet(f"{folder}/documents.parquet")
    out = [after]
    for name, stage in corpus_pipeline.STAGES:
        after = durable.Workspace(spark, "t").settle(stage(spark, after, folder), name)
        out.append(after)
    return out


def test_odd_rows_pass_all_stages(spark, folder):
    docs, clean, distinct, mixed, packed = stages(spark, folder)
    assert clean.columns == distinct.columns == mixed.columns == docs.columns
    kept = clean.collect()
    assert not any("vilezor" in (r["text"] or "") for r in kept)
    # everything else stays: nulls, empty and repeated rows, rows without id
    assert len(kept) == docs.filter("not coalesce(text like '%vilezor%', false)").count()
    ones = distinct.collect()
    texts = [r["text"] for r in ones if (r["text"] or "").strip()]
    assert len(texts) == len(set(texts)) and not any((t or "").endswith(" more") for t in texts)
    assert sum(not (r["text"] or "").strip() for r in ones) == 3
    assert mixed.filter("trim(coalesce(text, '')) = ''").count() == 0 and mixed.filter("char_length(text) <> n_chars").count() == 0
    rows = packed.collect()
    assert {r["sequence_id"] for r in rows} == set(range(max(r["sequence_id"] for r in rows) + 1))
    assert all(sum(r["length"] for r in rows if r["sequence_id"] == s) == 2048 for s in range(max(r["sequence_id"] for r in rows)))


def test_empty_documents_pass_all_stages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert [df.count() for df in stages(spark, str(tmp_path))] == [0, 0, 0, 0, 0]


def test_rows_without_ids_have_keys_of_their_own(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    got = mixing.mix_to_targets(rows.union(spark.createDataFrame([(1, "one two", "b")], rows.schema)))
    taken = got.agg(F.sum("taken"), F.sum("size"), F.max("size")).first()
    assert taken[1] == 6002 and got.filter("size = 2").count() == 3001
