"""Pages that break the rules of their kind, and odd markup."""

import pytest
from pyspark.sql import functions as F

from vouchlake.functions import columns
from vouchlake.plans import pages as plans
from vouchlake.sources import pages

ROW = "<tr>" + "".join(f"<td>{c}</td>" for c in ("n", "m", "", "", "", "", "s")) + "</tr>"


def _rows(spark, *html):
    return pages.rows(spark.createDataFrame(list(enumerate(html)), "k int, html string"), "k", "html")


def test_no_rows(spark):
    found = _rows(spark, None, "", "<p>no table", "<table></table>", "<table><tr></table>")
    assert found.count() == 0
    for kind in (pages.products, pages.profiles, pages.algorithm_list, pages.capabilities, pages.modules, pages.queue):
        assert kind(found).count() == 0


@pytest.mark.parametrize(
    "html",
    [
        f'<table id="tblIC"><tr><th>a</th></tr><tr><th>b</th></tr>{ROW}<tr><td>short</td></tr></table>',
        f'<table id="tblIC"><tr><th>a</th></tr></table><table id="tblIC"><tr><th>a</th></tr><tr><th>b</th></tr>{ROW}</table>',
    ],
)
def test_bad_product_pages_raise(spark, html):
    with pytest.raises(Exception, match="bad row or table"):
        pages.products(_rows(spark, html)).collect()


def test_unknown_state_raises(spark):
    found = _rows(spark, "<table><tbody><tr><td>m</td><td>v</td><td>s</td><td>Lost</td></tr></tbody></table>").withColumn("taken_at", F.lit("2021-01-01").cast("timestamp"))
    with pytest.raises(Exception, match="unknown state"):
        pages.in_process(found).collect()


def test_unclosed_and_nested(spark):
    got = _rows(spark, "<table id=o><tr><td>a<td>b <i>c</i><tr><td><table id=i><tr><td>x</table>after<td>d</table>").orderBy("table_id", "row").collect()
    assert [(r.table_id, r.row, [" ".join(c.strings) for c in r.cells], [c.own for c in r.cells]) for r in got] == [("i", 0, ["x"], ["x"]), ("o", 0, ["a", "b c"], ["a", "b"]), ("o", 1, ["after", "d"], ["after", "d"])]


def test_divided_algorithms(spark):
    panel = '<div class="panel panel-default">{}</div>'
    html = panel.format(
        '<div class="row padrow"><div class="col-md-3">Approved Algorithms</div><div class="col-md-9"><div class="col-md-12"><div class="col-md-3">AES</div><div class="col-md-4"> A12 </div></div>'
        '<div class="col-md-12"><div class="col-md-3">SHS</div><div class="col-md-4">3</div></div></div></div>'
    )
    assert pages.modules(_rows(spark, html)).first().algorithms == ["AESA12", "SHS3"]


def test_module_columns(spark):
    rows = [("software-hybrid", "Multi-chip  standalone", "Cert. #5, AES Cert. #7 and Certificate 5", "Table 1\n\f\nx\f\n"), (None, None, None, None), ("", "Other", "", "")]
    d = spark.createDataFrame(rows, "t string, e string, c string, p string").select(columns.module_type(F.col("t")), columns.embodiment(F.col("e")), columns.mentioned_certificates(F.col("c")), columns.pages_with_tables(F.col("p")))
    assert [tuple(r) for r in d.collect()] == [("Software-Hybrid", "Multi-Chip Stand Alone", {"5": 2}, [1, 2]), (None, None, None, None), ("", "Other", {}, [])]


def test_plain_pages_are_read_as_fed_ones():
    import random

    rnd, plain = random.Random(5), 0
    bits = ['<table id="t">', "</table>", "<tr>", "</tr>", '<td class="x mip">', "</td>", "<th>", "a &amp; b", "&lt", "x", "<br>", '<a href="/a?b=1&amp;c=2">', "</a>", '<div class="row padrow">', '<DIV CLASS="col-md-9" id="S1">', "</div>", "<li>", "</li>", "<h4>", "</h4>", "<tbody>", " \n "]
    odd = ["<br/>", "<!-- c -->", "<td id=5>", "a < b", "<p", "<script>", "</script>", '<a href="x>y">', "<td class='y'>", '<a href="&ampx">']
    for i in range(1500):
        html = "".join(rnd.choice(bits + odd * (i % 2)) for _ in range(rnd.randrange(1, 50)))
        fed = pages._Rows()
        fed.feed(html)
        fed.close()
        assert [r for some in pages._Rows().read(html) for r in some] == fed.out, html
        plain += bool(pages._PLAIN.fullmatch(html))
    assert 750 <= plain < 1400


def test_long_pages_are_handed_on_in_parts():
    html = "<table><tbody>" + "<tr><td>a</td><td>b</td></tr>" * 5000 + "</tbody></table>"
    parts = list(pages._Rows().read(html))
    assert max(map(len, parts)) <= 1000 and [r[6] for p in parts for r in p] == list(range(5000))


@pytest.mark.parametrize("name", ["module_pages", "key_value_pages"])
def test_pages_of_a_small_file_are_dealt(spark, name):
    from vouchlake.plans import pages as plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(c_custkey" in plan[plan.index("MapInArrow"):]


ROWS = ["<tr><td>a</td><th class=' b  c '>1 &amp; 2</th></tr>".replace("'", '"'), '<tr>\n<td>x<a href="/h?a=1&amp;b" title="t">y</a> z</td> <td>v<div id="S1">w</div><div>q</div></td></tr>', "<tr><td></td></tr>"]
ODD = ['<tr><td><a class="col-md-12">i</a></td></tr>', '<tr><td><div class="panel-default">p</div></td></tr>', "<tr><td>u<td>w</tr>", "<tr><td><table><tr><td>in</td></tr></table>after</td></tr>", "<h4>h<tr><td>k</td></tr></h4>", "<tr><td><ul><li>l</li></ul></td></th></tr>"]


def test_whole_rows_are_read_as_the_general_parser_reads_them(monkeypatch):
    quick = []
    monkeypatch.setattr(pages._Rows, "_whole_row", lambda self, text, do=pages._Rows._whole_row: quick.append(text) or do(self, text))
    for body in [*ROWS, *ODD, *(o + r for o in ODD for r in ROWS), "".join(ROWS)]:
        html = f'<table id="t"><tbody>{body}</tbody></table>'
        fed = pages._Rows()
        fed.feed(html)
        fed.close()
        assert [r for some in pages._Rows().read(html) for r in some] == fed.out, html
    assert {r[4:-5].strip() for r in ROWS} <= {q.strip() for q in quick}


@pytest.mark.parametrize("name", ["algorithm_pages", "process_pages", "queue_pages", "product_pages"])
def test_pages_are_dealt_in_a_given_number_of_parts(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    over = [x for x in plan[: next(i for i, x in enumerate(plan) if "Scan parquet" in x)] if "Exchange" in x]
    assert "REPARTITION_BY_NUM" in over[-1], over


def test_algorithm_lists_sort_no_cells(spark):
    plan = plans.QUERIES["algorithm_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if " Window " in x)
    assert "cells" not in plan[at] and "Project" in plan[at + 1] and "own" in plan[at + 1], plan[at : at + 3]
