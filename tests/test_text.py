"""Text and vector operators against their SQL in another engine and against plain versions."""

import duckdb
import pytest

from vouchlake.operators import text

SF = "/root/testdata/sf0.001"
SPACED = "\n".join(" ".join(f"letterspacedtext{i}line") for i in range(40))
PLAIN = "\n".join(f"An ordinary line of readable words, number {'x' * (i % 7)}" for i in range(40))
TEXTS = [None, "", SPACED, PLAIN, PLAIN + "\n", PLAIN.replace("\n", "\r\n"), PLAIN.replace("\n", " "), "\n" * 2000, "Été élevé où ßñ àéîõü\n" * 60, "1234567890 абв\n" * 90, "𝒳a𝒳b𝒳c𝒳d𝒳e𝒳f\n" * 90]


def is_garbage(t):
    """The reference's tests, written out."""
    lines = (t := t or "").splitlines()
    average = sum(map(len, lines)) / len(lines) if lines else 0
    alpha = sum(map(str.isalpha, t)) / len(t) if t else 0
    return len(lines) < 30, len(t) < 1000, average < 10, sum(len(set(x[1::2])) > 1 for x in lines) < 15, alpha < 0.5


@pytest.mark.parametrize("name", [n for n in text.QUERIES if n in text.ORACLE_SQL])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = text.QUERIES[name](spark, SF).toPandas(), db.sql(text.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].astype(str).values.tolist())) == sorted(map(str, want[cols].astype(str).values.tolist()))


def test_garbage_makes_all_five_tests(spark):
    rows = list(enumerate(TEXTS))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in text.garbage(frame).collect()}
    assert got == {i: (*is_garbage(t), any(is_garbage(t))) for i, t in rows}
    assert got[2][3] and not got[3][5]
    db = duckdb.connect()
    documents = frame.toPandas()  # noqa: F841
    assert {r[0]: tuple(r[1:]) for r in db.sql(text.ORACLE_SQL["garbage_text_detector"]).fetchall()} == got


@pytest.mark.parametrize(("queries", "rows"), [(128, 16384), (2, 50)])
def test_search_takes_every_query_and_all_blocks(spark, monkeypatch, queries, rows):
    monkeypatch.setattr(text, "QUERY_BLOCK", queries)
    monkeypatch.setattr(text, "ROW_BLOCK", rows)
    e = [(i, i % 3, [float(i * 37 % 101), float(i * 11 % 7)]) for i in range(640)]
    frame = spark.createDataFrame(e, "vec_id long, label int, embedding array<float>")
    want = {}
    for q, _, v in e[::100]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i, label) for i, label, w in e)[:90]
        for label in range(3):
            if d := [x[0] for x in near if x[2] == label]:
                want[q, label] = (len(d), round(0.7 * min(d) + 0.3 * sum(d) / len(d), 4))
    got = {(r["query_id"], r["label"]): (r["n"], round(r["score"], 4)) for r in text.vector_search(frame, k=90).collect()}
    assert got == want and len({q for q, _ in got}) == 7
    assert text.vector_search(frame.limit(0)).count() == 0
