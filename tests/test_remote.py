import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import pytest
from pyspark.sql import functions as F

from shiftloom.sources import remote

HOLDS = {"=": lambda a, b: a == b, ">": lambda a, b: a is not None and a > b, ">=": lambda a, b: a is not None and a >= b, "<": lambda a, b: a is not None and a < b, "<=": lambda a, b: a is not None and a <= b, "in": lambda a, b: a in b, "null": lambda a, b: a is None, "not null": lambda a, b: a is not None, "starts": lambda a, b: (a or "").startswith(b)}
DDL = "id bigint, word string, weight double, at timestamp, vec array<float>"


class Served:
    """A server of one table, that fails the first requests of some pages."""

    def __init__(self):
        self.rows = [[k, None if k % 11 == 0 else f"w{k % 7} \"é\"", k / 3 if k % 5 else None, f"2024-01-{1 + k % 28:02d}T00:00:00", [0.5, k]] for k in range(537)]
        self.failing, self.seen, self.posts = {}, [], 0
        served = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def say(self, body, code=200):
                self.send_response(code)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self):  # noqa: N802
                path, _, query = self.path.partition("?")
                q = dict(urllib.parse.parse_qsl(query))
                served.seen.append(q)
                if path != "/words%20%2F%20all":
                    return self.say(b"no such table", 404)
                if served.failing.get(q.get("offset"), 0) > 0:
                    served.failing[q["offset"]] -= 1
                    kind = served.failing[q["offset"]] % 3
                    return self.say(b"oh", 503) if kind == 0 else self.say(b'{"rows": [[1') if kind == 1 else self.say(b'{"rows": []}')
                names = [x.split()[0] for x in DDL.split(", ")]
                rows = [r for r in served.rows if all(HOLDS[op](r[names.index(c)], v) for op, c, v in json.loads(q["where"]))]
                if "offset" not in q:
                    return self.say(json.dumps({"schema": DDL, "rows": len(rows)}).encode())
                at = int(q["offset"])
                self.say(json.dumps({"rows": [[r[names.index(c)] for c in q["columns"].split(",")] for r in rows[at : at + int(q["limit"])]]}).encode())

            def do_POST(self):  # noqa: N802
                served.posts += 1
                if served.posts in (1, 4):
                    return self.say(b"busy", 500)
                rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["rows"]
                self.say(json.dumps({"rows": [[r["prompt"], w, len(w) / 2] for r in rows for w in (r["prompt"] or "").split()]}).encode())

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture()
def served():
    out = Served()
    yield out
    out.server.shutdown()
    out.server.server_close()


def scan(spark, served, **options):
    return remote.read_remote(spark, served.url, "words / all", page=50, pages_per_task=3, wait=0.01, **options)


def test_whole_table_also_after_failed_pages(spark, served):
    served.failing = {"0": 1, "150": 3, "500": 2}
    df = scan(spark, served)
    assert df.dtypes == [tuple(x.split()) for x in DDL.split(", ")] and df.rdd.getNumPartitions() == 4
    got = sorted(df.select("id", "word", "weight", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), "vec").collect())
    assert [list(r) for r in got] == served.rows and not any(served.failing.values())


def test_only_asked_columns_and_rows_travel(spark, served):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = scan(spark, served).where("id >= 100 AND word IS NOT NULL AND word LIKE 'w3%' AND id % 2 = 0 AND id IN (101, 108, 122, 136, 500)").select("id", "word").collect()
        assert sorted(r.id for r in got) == [k for k in (108, 122, 136, 500) if k % 7 == 3 and k % 11]
        where = json.loads(served.seen[-1]["where"])
        assert {op for op, _, _ in where} >= {">=", "not null", "starts"} and int(served.seen[-1]["limit"]) < 50
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_errors_are_told_apart(spark, served):
    served.failing = {"50": 99}
    with pytest.raises(Exception, match="3 times"):
        scan(spark, served, retries=2).count()
    before = len(served.seen)
    with pytest.raises(Exception, match="404"):
        remote.read_remote(spark, served.url, "other", wait=0.01).count()
    assert len(served.seen) == before + 1
    served.failing, served.rows = {}, []
    assert scan(spark, served).count() == 0


def test_a_given_table_comes_back_whole(spark, served):
    import os

    path = "/root/testdata/sf0.001/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables aren't here")
    served.rows = [[i, str(label), None, "2024-01-01", v] for i, label, v in duckdb.sql(f"SELECT vec_id, label, embedding FROM '{path}' ORDER BY 1").fetchall()]
    got = scan(spark, served).select(F.col("id").alias("vec_id"), F.col("word").cast("bigint").alias("label"), F.col("vec").alias("embedding"))
    given = spark.read.parquet(path).select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    assert got.exceptAll(given).count() == 0 == given.exceptAll(got).count()


def test_rows_that_a_server_makes(spark, served):
    prompts = spark.createDataFrame([(f"a{k} bb ccc",) for k in range(30)] + [(None,), ("",)], "prompt string").repartition(2)
    got = remote.posted(prompts, f"{served.url}/top_words", "prompt string, word string, prob double", batch=7, wait=0.01).collect()
    assert Counter(r.word for r in got)["ccc"] == 30 and {r.prob for r in got if r.word == "bb"} == {1.0} and served.posts >= 6
