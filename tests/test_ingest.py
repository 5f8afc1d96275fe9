"""Paged feeds from a local service, restarts of streams, and datasets made in stages."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from vouchlake.sources.paged_feed import PagedFeed
from vouchlake.sources.versioned import StagedDataset, VersionedTable, documents_to_do


class Service:
    """Pages of items by index and time of change, with pages that fail at first."""

    def __init__(self):
        self.items, self.clock, self.asked, self.fail = {}, "2024-01-01T00:00:00", [], Counter()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                start, size, since = int(q["startIndex"]), int(q["resultsPerPage"]), q.get("lastModStartDate", "")
                if service.fail[start] > 0 and size > 1:
                    service.fail[start] -= 1
                    self.send_error(503)
                    return
                mine = sorted((i for i in service.items.values() if i["lastModified"] > since and i["lastModified"] <= q.get("lastModEndDate", "9")), key=lambda i: i["id"])
                service.asked.append((start, size, since))
                body = json.dumps({"timestamp": service.clock, "totalResults": len(mine), "vulnerabilities": [{"cve": i} for i in mine[start : start + size]]}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/feed"

    def put(self, clock, **values):
        self.clock = clock
        for k, v in values.items():
            self.items[k] = {"id": k, "lastModified": clock, "score": v}


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def options(service):
    return {"url": service.url, "items": "vulnerabilities", "item": "cve", "page": "2", "delay": "0.01", "attempts": "3"}


def scores(df):
    return {r["key"]: json.loads(r["body"])["score"] for r in df.collect()}


def test_pages_are_read_and_tried_again(spark, service):
    spark.dataSource.register(PagedFeed)
    service.put("2024-01-02T00:00:00", a=1, b=2, c=3, d=4, e=5)
    service.fail[2] = 2
    df = spark.read.format("paged_feed").options(**options(service)).load()
    assert scores(df) == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5} and df.rdd.getNumPartitions() == 3
    service.items.clear()
    assert spark.read.format("paged_feed").options(**options(service)).load().count() == 0


def test_a_stream_goes_on_where_it_stopped_and_takes_each_batch_in_once(spark, service, tmp_path):
    spark.dataSource.register(PagedFeed)
    table, seen = VersionedTable(spark, f"file://{tmp_path}/table"), []

    def run(die=False):
        def take(rows, batch):
            table.upsert(rows, f"feed {batch}")
            seen.append(batch)
            if die:
                raise RuntimeError("died after writing")

        stream = spark.readStream.format("paged_feed").options(**options(service)).load()
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/offsets").trigger(once=True).start()
        query.awaitTermination(60)

    service.put("2024-01-02T00:00:00", a=1, b=2, c=3)
    run()
    assert scores(table.read()) == {"a": 1, "b": 2, "c": 3}
    service.put("2024-01-05T00:00:00", b=20, d=4)
    with pytest.raises(Exception, match="died after writing"):
        run(die=True)
    versions = len(table.log())
    service.asked.clear()
    run()  # the batch that died is done again, and not taken in again
    assert seen.count(seen[-2]) >= 1 and scores(table.read()) == {"a": 1, "b": 20, "c": 3, "d": 4}
    assert sum(e["made_by"] == "feed 1" for e in table.log()) == 1 and len(table.log()) >= versions
    assert all(since in ("", "2024-01-02T00:00:00", "2024-01-05T00:00:00") for _, size, since in service.asked if size > 1 and since)
    service.put("2024-09-01T00:00:00", e=5)  # beyond the reach of a span: all is read anew
    service.asked.clear()
    run()
    assert scores(table.read()) == {"a": 1, "b": 20, "c": 3, "d": 4, "e": 5}
    assert {since for _, size, since in service.asked if size > 1} == {""}
    table.vacuum(1)
    assert len(scores(table.read())) == 5


def test_stages_that_are_done_are_not_done_again(spark, tmp_path):
    calls, broken = [], [True]

    def load(_):
        calls.append("load")
        return spark.range(6).select("id", F.lit(None).cast("boolean").alias("ok"), F.lit(0).alias("tries"))

    def convert(df):
        calls.append("convert")
        if broken[0]:
            raise RuntimeError("killed")
        return df.withColumn("ok", F.col("id") % 3 != 0).withColumn("tries", F.col("tries") + 1)

    stages = [("load", load), ("convert", convert)]
    path = f"file://{tmp_path}/set"
    with pytest.raises(RuntimeError, match="killed"):
        StagedDataset(spark, path).run(stages)
    broken[0] = False
    got = StagedDataset(spark, path).run(stages)
    assert calls == ["load", "convert", "convert"] and got.where("ok").count() == 4
    assert StagedDataset(spark, path).run(stages).count() == 6 and len(calls) == 3
    again = StagedDataset(spark, path).retry("convert", lambda df: df.withColumn("ok", F.lit(True)).withColumn("tries", F.col("tries") + 1), "ok")
    assert {r["id"]: r["tries"] for r in again.collect()} == {0: 2, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1}
    assert StagedDataset(spark, path).retry("convert", lambda df: df, "ok").count() == 6
    assert [e["made_by"] for e in StagedDataset(spark, path).table.log()] == ["load", "convert", "convert, again 1"]


def test_documents_that_a_stage_has_to_do(spark):
    docs = spark.createDataFrame([(1, None, None), (2, True, None), (3, False, True)], "id int, done boolean, failed boolean")
    assert [r["id"] for r in documents_to_do(docs, "done", "failed").collect()] == [1]
    assert [r["id"] for r in documents_to_do(docs, "done", "failed", fresh=False).collect()] == [3]
