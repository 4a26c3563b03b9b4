"""Debouncing in batch and stream, routing of changing files, and what a compaction leaves."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dredge.conf import EngineConf
from dredge.operators import delta as D
from dredge.operators import index
from dredge.operators.index import shard_of
from dredge.plans.search import search
from dredge.sources.corpus import document_files, first_beyond, route, searchable
from dredge.streaming.changes import burst_paths, bursts, debounced, latest_state

T0 = datetime(2024, 1, 1)


def events(spark):
    rows = [(T0 + timedelta(milliseconds=ms), p) for ms, p in ((0, "a"), (150, "b"), (340, "a"), (900, "c"), (1100, "c"))]
    return spark.createDataFrame(rows, "ts timestamp, path string")


def test_debounce(spark):
    for ranges in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        got = debounced(events(spark), "200 milliseconds").orderBy("batch_start").collect()
        assert [(r["n"], r["n_paths"]) for r in got] == [(3, 2), (2, 1)]
        assert got[0]["batch_end"] == T0 + timedelta(milliseconds=340)
        assert sorted(map(tuple, burst_paths(events(spark), "200 milliseconds").collect())) == [(0, "a"), (0, "b"), (1, "c")]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_bursts(spark):
    rng = random.Random(5)
    times, at = [], 0
    for _ in range(3000):
        at += rng.choice([0, 0, 1, 50, 199, 200, 201, 900])
        times.append(at)
    rows = spark.createDataFrame([(T0 + timedelta(milliseconds=ms), f"p{k % 7}") for k, ms in enumerate(times)], "ts timestamp, path string")
    want = [[times[0]]]
    for a, b in zip(times, times[1:]):
        if b - a > 200:
            want.append([])
        want[-1].append(b)
    got = debounced(rows.repartition(3), "200 milliseconds").orderBy("batch_start").collect()
    assert [(r["batch_start"], r["n"]) for r in got] == [(T0 + timedelta(milliseconds=w[0]), len(w)) for w in want]


def test_debounce_stream(spark, tmp_path):
    events(spark).withColumn("root", F.lit("r")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string, root string").parquet(str(tmp_path / "in"))
    q = bursts(stream, "200 milliseconds", "root", watermark="0 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    try:
        q.processAllAvailable()
        late = spark.createDataFrame([(T0 + timedelta(seconds=60), "z", "r")], "ts timestamp, path string, root string")
        late.write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        assert sorted(r["n"] for r in spark.table("bursts").collect()) == [2, 3]
    finally:
        q.stop()


def test_latest_state(spark):
    got = latest_state(events(spark), "path", ["ts"], ["ts"]).collect()
    assert {r["path"]: r["ts"] for r in got}["a"] == T0 + timedelta(milliseconds=340)


def test_file_moves_between_sets(spark):
    conf = EngineConf(max_filesize_mb=2, max_index_mb=0)

    def routes(content):
        f = spark.createDataFrame([("f", len(content), bytearray(content))], "path string, size long, content binary")
        return [r["route"] for r in route(f, conf).collect()]

    assert routes(b"small") == ["indexed"] and routes(b"x" * (3 << 20)) == ["large"] and routes(b"a\0b") == ["binary"]


def test_budget_and_text_mode(spark):
    f = spark.createDataFrame([(f"f{i}", 600 << 10, bytearray(b"x")) for i in range(4)] + [("g", 1, bytearray(b"\0")), ("h", 1, None)], "path string, size long, content binary")
    routed = route(f, EngineConf(max_index_mb=1))
    assert sorted(r["route"] for r in routed.collect()) == ["binary", "budget", "budget", "budget", "error", "indexed"]
    assert searchable(routed).count() == 4 and searchable(routed, text=True).count() == 5


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans_meet_no_strangers_and_no_single_task(spark):
    """No nested loop, and no exchange of rows to one partition but for aggregates and totals of ranges."""
    files = spark.range(1000).selectExpr("concat('d', id % 10, '/f', id) AS path", "id AS size", "CAST('x' AS BINARY) AS content")
    shards = spark.range(10).selectExpr("concat('d', id, '/f') AS path_min", "concat('d', id, '/g') AS path_max", "int(id) AS shard")
    at = shard_of(files.select("path"), shards)
    assert "NestedLoop" not in plan_of(at) and "Cartesian" not in plan_of(at)
    assert {r["shard"] for r in at.collect()} == set(range(10)) and at.where("shard <> int(substring(path, 2, 1))").count() == 0
    owned = D.containing_root(files.select("path"), spark.createDataFrame([("d1",), ("d1/f1",)], "root string"))
    assert "NestedLoop" not in plan_of(owned)
    assert {r["root"] for r in owned.where("path LIKE 'd1/%'").collect()} == {"d1", "d1/f1"} and owned.where("root IS NULL").count() == 900
    beyond = first_beyond(files.select("path", "size"), 100_000)
    total, want = 0, None
    for path, size in sorted((r["path"], r["size"]) for r in files.collect()):
        total += size
        if total > 100_000:
            want = path
            break
    assert spark.range(1).select(beyond).first()[0] == want


def test_ranges_of_shards(spark, monkeypatch):
    monkeypatch.setattr(index, "RANGE_SHARDS", 5)
    files = spark.range(400).selectExpr("concat('f', lpad(id, 4, '0')) AS path", "10L AS size")
    packed = index.pack_shards(files, 40, 30).join(files, "path")
    per = index.manifest(packed).orderBy("path_min").collect()
    assert sum(r["n_files"] for r in per) == 400 and all(30 <= r["bytes"] < 80 for r in per) and max(r["shard"] for r in per) >= index.SHARDS_A_RANGE
    assert all(a["path_max"] < b["path_min"] and a["shard"] < b["shard"] for a, b in zip(per, per[1:]))


def test_no_row_loses_its_path(spark):
    docs = spark.createDataFrame([(1, "hit", None, "s"), (2, "hit", "en", None), (3, "hit", "en", "s"), (None, "hit", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r["path"] for r in search(document_files(docs), "hit", mode="files").collect()] == ["null/en/2.txt", "s/en/3.txt", "s/en/null.txt", "s/null/1.txt"]


def test_pending(spark):
    rows = [("a", False, 1, 1, "x"), ("a", True, 3, None, None), ("b", False, 2, 1, "y")]
    delta = spark.createDataFrame(rows, "path string, deleted boolean, seq long, size long, text string")
    left = D.pending(delta, delta.where("seq < 3")).collect()
    assert [(r["path"], r["seq"]) for r in left] == [("a", 3)]
    assert [(r["path"], r["deleted"]) for r in D.latest(delta).orderBy("path").collect()] == [("a", True), ("b", False)]
    sharded = spark.createDataFrame([("a", 0), ("b", 1)], "path string, shard int")
    assert D.dirty_shards(sharded, delta, 5).count() == 2 and D.dirty_shards(sharded, delta.withColumn("path", F.concat("path", "seq")), 1).where("shard = -1").count() == 1


def test_sql_functions(spark):
    from dredge import generated as G
    from dredge.functions.register import register

    register(spark)
    docs = spark.createDataFrame([(i, f"one\ntwo */ {i}") for i in range(5)], "doc_id long, text string")
    G.source_files(docs).createOrReplaceTempView("sources")
    got = spark.sql("SELECT s.path, d.* FROM sources s, LATERAL extract_defs(s.path, s.text) d").collect()
    want = [(f"src/{k}{t.ext}", n.replace("@K", str(k)), kind, c.replace("@K", str(k)), line + behind) for k, t in enumerate(G.TEMPLATES) for n, kind, c, line, behind in t.defs]
    assert sorted(map(tuple, got)) == sorted(want)
    uses = spark.sql("SELECT r.* FROM sources s, LATERAL find_refs(s.path, s.text, 'ring') r ORDER BY 1").collect()
    assert [tuple(r) for r in uses] == [(line + 1, kind) for kind, line in G.USED]
    assert spark.sql("SELECT t.tri FROM trigrams('AbC') t").collect() == [(0x616263,)]
    assert spark.sql(r"SELECT rlike('a\n', re2('a$'))").first()[0] is False
