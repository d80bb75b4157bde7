"""The REST source against a local service."""

import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from millrace.sources import rest

ITEMS = [{"id": i, "kind": "ab"[i % 2], "v": None if i % 7 == 0 else i / 2, "more": {"k": i}} for i in range(257)]


@pytest.fixture
def service():
    asked, failed = [], Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            asked.append(q)
            failed[self.path] += 1
            if q["page"] == "3" and failed[self.path] == 1:  # once, each question for the third page fails
                self.send_error(503)
                return
            rows = [r for r in ITEMS if q.get("kind") in (None, r["kind"]) and q.get("id") in (None, str(r["id"]))]
            page, size = int(q["page"]), int(q["size"])
            body = json.dumps({"items": rows[(page - 1) * size : page * size], "total_items": len(rows)}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/items", asked
    server.shutdown()


def test_pages_are_partitions_and_filters_are_parameters(spark, service):
    url, asked = service
    rest.register(spark)
    df = spark.read.format("rest").schema("id long, kind string, v double, more string").option("url", url).option("page_size", "20").option("pages_per_task", "3").load()
    assert df.rdd.getNumPartitions() == 5
    got = sorted(df.collect())
    assert [(r.id, r.kind, r.v, json.loads(r.more)) for r in got] == [(r["id"], r["kind"], r["v"], r["more"]) for r in ITEMS]
    asked.clear()
    some = df.where("kind = 'a' AND v > 20").collect()
    assert sorted(r.id for r in some) == [r["id"] for r in ITEMS if r["kind"] == "a" and r["v"] is not None and r["v"] > 20]
    assert asked and all(q.get("kind") == "a" for q in asked)
    assert [r.id for r in df.where("id = 40").collect()] == [40] and df.where("kind = 'none'").count() == 0


def test_a_service_that_is_gone_is_an_error(spark):
    rest.register(spark)
    with pytest.raises(Exception, match="refused|URLError"):
        spark.read.format("rest").schema("id long").option("url", "http://127.0.0.1:9/items").option("tries", "2").load().collect()
