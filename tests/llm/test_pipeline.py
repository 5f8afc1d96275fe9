"""The pipeline's stages, each held against a plain version on its own input."""

import corpus_pipeline
from vouchlake.llm.near_dedup import Shingler

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}

    kept = stages["language_id"](spark, docs, SF).cache()
    assert kept.columns == columns and kept.count() > 0.95 * docs.count()

    unique, before = stages["exact_dedup"](spark, kept, SF).cache(), rows(kept)
    best = {}
    for doc, text in before.items():
        best[text] = max(doc, best.get(text, doc))
    assert unique.columns == columns and set(rows(unique)) == set(best.values())

    one, before, shingle = stages["near_dedup"](spark, unique, SF).cache(), rows(unique), Shingler()
    sets = {i: set(shingle(t)[0].tolist()) for i, t in before.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert one.columns == columns and set(rows(one)) == {root(i) for i in sets}

    mixed = stages["mixing"](spark, one, SF).cache()
    assert mixed.columns == columns and set(rows(mixed)) <= set(rows(one))
    packed = stages["packing"](spark, mixed, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(rows(mixed))


def test_stages_on_awkward_rows(spark):
    text = " ".join(f"the word{i} and" for i in range(60))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text, "en", None), (3, text + " more", "en", "a"), (4, None, "en", "a"), (5, "", None, None), (6, "le la que " * 40_000, "fr", "b"), (7, "que le la les des " * 30, "fr", "b"), (8, "!!!", "en", "a")]
    schema = "doc_id long, text string, lang string, source string, kept string, id string, n long"
    docs = spark.createDataFrame([(*r, "clash", "clash", 9) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    unique = stages["exact_dedup"](spark, docs, SF)
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in unique.collect()) == [2, 3, 5, 6, 7, 8]
    one = stages["near_dedup"](spark, unique, SF)
    assert one.columns == docs.columns and {2, 5, 6, 7, 8} == {r["doc_id"] for r in one.collect()}
    sure = stages["language_id"](spark, docs, SF)
    assert sure.columns == docs.columns and not {4, 5, 8} & {r["doc_id"] for r in sure.collect()}
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r[0] for r in rows}
    assert {r["doc_id"] for r in stages["packing"](spark, docs, SF).collect()} == {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
