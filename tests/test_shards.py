"""Shards packed over many ranges of paths: the same as by one fold over all files."""

import random

import pytest
from oracle import answers, same

from dredge.operators import index
from dredge.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
OF_SHARDS = ["shard_packing", "shard_manifest", "path_to_shard", "dirty_shards", "shard_skip"]


@pytest.fixture(scope="module")
def expected(tmp_path_factory):
    return answers(DIR, {n: SQL[n] for n in OF_SHARDS}, tmp_path_factory.mktemp("oracle"))


def folded(sizes, target, least):
    shards, shard, filled = [], 0, 0
    for size in sizes:
        if filled >= target:
            shard, filled = shard + 1, 0
        shards.append(shard)
        filled += size
    return [min(s, shard - 1) for s in shards] if shard and filled < least else shards


@pytest.mark.parametrize("name", OF_SHARDS)
def test_ranges_equal_sql(spark, expected, monkeypatch, name):
    monkeypatch.setattr(index, "RANGE_SHARDS", 1)
    assert same(QUERIES[name](spark, DIR), expected[name])


def test_manifest_has_each_file_once(spark, tmp_path):
    """Rows of one path and size are so many files."""
    docs = spark.range(90).selectExpr("id div 2 AS doc_id", "repeat('x', 9000) AS text", "'en' AS lang", "'s' AS source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in QUERIES["shard_manifest"](spark, str(tmp_path)).select("shard", "n_files", "bytes").orderBy("shard").collect()]
    assert rows == [(k, 12, 108_000) for k in range(6)] + [(6, 18, 162_000)]


@pytest.mark.parametrize("kind", ["mixed", "even", "tiny", "zeros", "large", "one", "none"])
def test_packing_equals_one_fold(spark, monkeypatch, kind):
    rng = random.Random(kind)
    sizes = {
        "mixed": [rng.choice((0, 1, 7, 30, 99, 100, 101, 450)) for _ in range(700)],
        "even": [7] * 600,
        "tiny": [rng.randrange(2) for _ in range(900)],  # ranges of less than a shard
        "zeros": [0] * 150 + [100] + [0] * 150,
        "large": [1000] * 80,
        "one": [5],
        "none": [],
    }[kind]
    files = spark.createDataFrame([(f"f{k:05}", s) for k, s in enumerate(sizes)][::-1], "path string, size long")
    monkeypatch.setattr(index, "RANGE_SHARDS", 2)
    monkeypatch.setattr(index, "RANGE_FILES", 25)
    for target, least in ((100, 60), (100, 0), (101, 101)):
        got = [tuple(r) for r in index.packed(files, target, least, apart=0).orderBy("path").collect()]
        assert got == [(f"f{k:05}", s, n) for k, (s, n) in enumerate(zip(sizes, folded(sizes, target, least)))]
        apart = [r["shard"] for r in index.pack_shards(files, target, least).orderBy("path").collect()]
        assert [a != b for a, b in zip(apart, apart[1:])] == [a[2] != b[2] for a, b in zip(got, got[1:])] and apart == sorted(apart)


def test_crossings_of_every_open_shard():
    rng = random.Random(4)
    for _ in range(200):
        sizes, target = [rng.choice((0, 1, 3, 9, 25)) for _ in range(rng.randrange(1, 30))], rng.randrange(1, 40)
        upto, closed, filled = index.crossings(index.np.array(sizes), target)
        for had in range(target):
            n, left = 0, had
            for s in sizes:
                left += s
                if left >= target:
                    n, left = n + 1, 0
            k = int(index.np.searchsorted(upto, target - had))
            assert (n, left) == ((closed[k], filled[k]) if k < len(upto) else (0, had + sum(sizes)))
