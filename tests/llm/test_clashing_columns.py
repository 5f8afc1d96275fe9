"""Stages keep the caller's columns, whatever their names."""

import pytest

import corpus_pipeline

NAMES = ["id", "_id", "__id", "keep", "__keep", "digest", "__digest", "sha", "__sha", "times", "__times", "epoch", "__epoch", "n", "sig", "comp", "rep", "key", "size"]
EN = "the cat and the dog went to the old house by the river where they had seen the birds of the morning "
DE = "der hund und die katze gingen zum alten haus am fluss wo sie die vögel des morgens gesehen hatten und blieben "


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_any_name_stay(spark, stage):
    rows = [(i, (EN if i % 2 else DE) * 3 + f"number {i} " * 4, "en" if i % 2 else "de", "a", 1) for i in range(40)] + [(99, EN * 3 + "number 1 " * 4, "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in NAMES]) for r in rows], schema)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in NAMES)
