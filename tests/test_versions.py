import threading
import time

import pytest

from shiftloom.sources.versions import VersionedTable

DDL = "k string, part int, v int"


@pytest.fixture()
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "cache"), DDL, ("k", "part"), 4, most=2)


def frame(spark, *rows):
    return spark.createDataFrame([(k, 0, v) for k, v in rows], DDL)


def held(df):
    return sorted((r.k or "-", r.v) for r in df.collect())


def test_puts_adds_and_removals_make_versions(spark, table):
    assert table.version() == 0 and held(table.rows()) == []
    assert table.put(frame(spark, ("a", 1), ("b", 2), ("b", 3), (None, 9))) == 1
    assert table.add(frame(spark, ("a", 7), ("c", 4))) == 2 and table.add(frame(spark, ("c", 5))) == 2
    assert table.put(frame(spark, ("b", 8))) == 3 and table.remove(frame(spark, (None, 0), ("zz", 0)).select("k", "part")) == 4
    assert held(table.rows()) == [("a", 1), ("b", 8), ("c", 4)]
    assert held(table.rows(1)) == [("-", 9), ("a", 1), ("b", 2), ("b", 3)] and held(table.rows(3)) == [("-", 9), ("a", 1), ("b", 8), ("c", 4)]
    assert table.put(frame(spark)) == 4


def test_only_touched_buckets_are_written_and_full_ones_compacted(spark, table):
    table.put(frame(spark, *((f"k{i}", i) for i in range(40))))
    before = table.manifest(1)
    table.put(frame(spark, ("k0", 100)))
    after = table.manifest(2)
    assert len(before) == 4 and sum(after[k] != before[k] for k in before) == 1
    for i in range(6):
        table.add(frame(spark, *((f"n{i}-{j}", j) for j in range(12))))
        assert all(len(f) <= 3 for f in table.manifest(table.version()).values())
    assert table.rows().count() == 40 + 72 and ("k0", 100) in held(table.rows())


def test_writers_at_once_lose_nothing(spark, table):
    errors = []

    def work(n):
        try:
            mine = VersionedTable(spark, table.files.path, DDL, ("k", "part"), 4, most=2)
            mine.add(frame(spark, *((f"w{n}-{j}", n) for j in range(5)), ("shared", n)))
            mine.put(frame(spark, (f"own{n}", 1)))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = held(table.rows())
    assert not errors and table.version() == 8 and len(rows) == 4 * 5 + 4 + 1 and sum(k == "shared" for k, _ in rows) == 1
    assert len(table.files.names("versions")) == 8


def test_one_writer_wins_a_version(table):
    won = []
    threads = [threading.Thread(target=lambda n=n: won.append((table.files.create("versions/0000000001.json", f'{{"{n}": []}}'), n))) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(w for w, _ in won) == 1 and table.manifest(1) == {str(next(n for w, n in won if w)): []}
    assert [n for n, _ in table.files.names("")] == ["versions"]


def test_cleaning_keeps_what_is_named(spark, table):
    for v in range(3):
        table.put(frame(spark, ("a", v), (f"b{v}", v)))
    want = held(table.rows())
    table.clean(1, older_s=9999)
    folders = len(table.files.names("data"))
    assert folders == 3 and [n for n, _ in table.files.names("versions")] == ["0000000003.json"]
    time.sleep(0.05)
    table.clean(1, older_s=0)
    assert len(table.files.names("data")) < folders and held(table.rows()) == want and table.put(frame(spark, ("z", 1))) == 4


def test_read_through_works_out_only_what_is_missing(spark, table):
    asked = []

    def compute(keys):
        asked.append(sorted(r.k for r in keys.collect()))
        return keys.selectExpr("k", "part", "length(k) AS v")

    wanted = frame(spark, ("a", 0), ("bb", 0), ("bb", 0)).select("k", "part")
    assert held(table.read_through(wanted, compute)) == [("a", 1), ("bb", 2)]
    assert held(table.read_through(frame(spark, ("bb", 0), ("ccc", 0)).select("k", "part"), compute)) == [("bb", 2), ("ccc", 3)]
    assert held(table.read_through(wanted, compute)) == [("a", 1), ("bb", 2)] and asked == [["a", "bb"], ["ccc"]] and table.version() == 2
