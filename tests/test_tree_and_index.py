"""The file-tree source, the change stream with its barrier, and the index on disk."""

import os

import pytest

from dredge.cli import main
from dredge.conf import EngineConf, parse_size
from dredge.functions import paths
from dredge.operators.delta import overlay
from dredge.operators.ignores import load_rules
from dredge.operators.index import Index
from dredge.operators.symbols import outline
from dredge.plans.search import search
from dredge.schemas import DELTA
from dredge.sources import tree
from dredge.sources.corpus import route
from dredge.streaming.changes import DeltaWriter


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "root"
    for name, text in {"a.go": "// lamps\npackage lamps\n\nfunc LightLamp(n int) int { return n }\n", "b.go": "package lamps\n\ntype wick struct{}\n", ".hidden/h": "LightLamp\n", "_x/y.txt": "LightLamp\n"}.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    (tmp_path / "far").mkdir()
    (tmp_path / "far/z.txt").write_text("LightLamp\n")
    os.symlink(tmp_path / "far", base / "link")
    os.symlink(base, base / "_x/loop")
    return base


def test_walk(root):
    assert [p for p, _, _ in tree.walk(str(root))] == [".hidden/h", "_x/y.txt", "a.go", "b.go"]
    assert [p for p, _, _ in tree.walk(str(root), follow=True)] == [".hidden/h", "_x/y.txt", "a.go", "b.go", "link/z.txt"]


def test_tree_search(spark, root):
    tree.register(spark)
    files = route(spark.read.format("filetree").option("path", str(root)).load(), EngineConf(max_index_mb=0))
    found = lambda **k: [r["path"] for r in search(files, "LightLamp", mode="files", **k).collect()]
    assert found() == ["_x/y.txt", "a.go"] and found(hidden=True) == [".hidden/h", "_x/y.txt", "a.go"]
    assert found(globs=["*.go"]) == ["a.go"] and found(subtree="_x") == ["y.txt"]


def test_barrier(spark, root, tmp_path):
    tree.register(spark)
    stream = spark.readStream.format("filetree").option("path", str(root)).option("changes", "true").option("listings", str(tmp_path / "listings")).load()
    writer = DeltaWriter(stream, str(tmp_path / "delta"), str(tmp_path / "check"))
    try:
        base = spark.createDataFrame([], "path string, size long, text string")
        for k in range(3):
            (root / "w.go").write_text(f"ember{k}\n")
            assert writer.barrier(60_000)
            now = overlay(base, writer.delta())
            assert search(now, f"ember{k}", mode="files").collect() == [("w.go",)]
            assert not k or search(now, f"ember{k - 1}").count() == 0
        (root / "w.go").unlink()
        assert writer.barrier(0)
        assert search(overlay(base, writer.delta()), "ember").count() == 0 and writer.progress()["batchId"] >= 3
        big = bytes(3 << 20)
        (root / "w.go").write_bytes(big)
        assert writer.barrier(0)
        assert writer.delta().where("path = 'w.go' AND text IS NULL AND NOT deleted").count() == 1
        assert len(list((tmp_path / "listings").iterdir())) <= 2
    finally:
        writer.stop()


def test_index(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}.txt", 8, 0, f"ember{i} x\n") for i in range(40)] + [("d0/a.py", 20, 0, "def kindle(): pass\n")]
    files = spark.createDataFrame(rows, "path string, size long, mtime_ns long, text string")
    index = Index(spark, str(tmp_path / "index"))
    index.build(files, target=64, least=32)
    assert [r["path"] for r in index.search("ember17 ").collect()] == ["d2/f17.txt"]
    assert index.search("nothing").count() == 0 and index.search("EMBER3", nocase=True).count() == 11
    assert index.table("defs").select("name").collect() == [("kindle",)] and index.manifest().count() > 3
    change = spark.createDataFrame([("d0/f0.txt", False, 1, 9, 5, "renewed17\n"), ("d0/f3.txt", True, 1, None, None, None), ("new.py", False, 1, 9, 5, "def fresh(): pass\n")], DELTA)
    for delta in (change, None):
        found = lambda p: [r["path"] for r in index.search(p, delta=delta).collect()]  # noqa: E731, B023
        assert found("renewed17") == ["d0/f0.txt"] and found("ember3 ") == [] and found("fresh") == ["new.py"] and found("ember0 ") == []
        assert {r["name"] for r in index.definitions(delta).collect()} == {"kindle", "fresh"}
        if delta is not None:
            pinned, rows = index.state(), index.table("files").count()
            assert -1 in index.compact(change, threshold=20)
            assert index.table("files", pinned).count() == rows  # a reader keeps its version
            assert index.compact(change.limit(0)) == [] and len(index.clean()) == 0
            known = index.table("files").select("path", "size", "mtime_ns")
            assert {r["mtime_ns"] for r in known.where("path IN ('d0/f0.txt', 'new.py')").collect()} == {5}
    index.build(files.limit(1), target=64, least=32)
    assert len(index.clean()) == 2 and index.table("files").count() == 1 and index.size() > 0
    assert [r["path"] for r in index.references("ember0").collect()] == ["d0/f0.txt"]
    assert index.file("d0/f0.txt").first()["size"] == 8 and [r["path"] for r in index.listing("d0").collect()] == ["d0/f0.txt"]
    with pytest.raises(FileNotFoundError):
        index.file("none")
    with pytest.raises(RuntimeError):  # two writers began with one version
        index._point(index.shards(), max(index._versions()) - 1)
    assert index.forget()
    with pytest.raises(FileNotFoundError):
        index.search("ember17")


def test_stream_compacts_its_index(spark, root, tmp_path):
    tree.register(spark)
    index = Index(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame([("a.go", 1, 1, "old\n")], "path string, size long, mtime_ns long, text string"), target=64, least=32)
    stream = spark.readStream.format("filetree").option("path", str(root)).option("changes", "true").option("listings", str(tmp_path / "listings")).load()
    writer = DeltaWriter(stream, str(tmp_path / "delta"), str(tmp_path / "check"), EngineConf(rebuild_interval_ms=0), index)
    try:
        assert writer.barrier(0)
        assert [r["path"] for r in index.search("LightLamp", hidden=True).collect()] == [".hidden/h", "_x/y.txt", "a.go"] and index.search("old").isEmpty()
        assert {r["mtime_ns"] for r in index.listing().collect()} == {m for _, _, m in tree.walk(str(root))}
    finally:
        writer.stop()


def test_small_helpers(spark):
    assert EngineConf().uses_index(10 << 20) and not EngineConf().uses_index(5) and EngineConf(engine="disk").uses_index(5) and not EngineConf(engine="memory").uses_index(1 << 40)
    assert EngineConf.load({"DREDGE_ENGINE": "odd", "DREDGE_GITIGNORE": "1"}).overrides() == ["gitignore=True"]
    assert parse_size("2K") == 2048 and parse_size("1G") == 1 << 30 and EngineConf.load({"DREDGE_LIMIT": "5"}).overrides() == ["limit=5"]
    with pytest.raises(ValueError):
        parse_size("2X")
    for glob in ("[", "a[b-", "\\"):
        with pytest.raises(paths.BadGlob):
            paths.glob_regex(glob)
    assert paths.is_ignored("attic", True, ["attic/"]) and not paths.is_ignored("attic", False, ["attic/"])
    with pytest.raises(FileNotFoundError):
        outline(spark.createDataFrame([("a.go", "x")], "path string, text string"), "b.go")


def test_ignore_files(spark):
    texts = {".gitignore": "*~\nattic/\n", "lib/.gitignore": "# none\n/gen/\n q?.dat \n", "x~": "hit", "in/y~": "hit", "attic/z.c": "hit", "in/attic/z.c": "hit", "run.c": "hit", "lib/gen/a.c": "hit", "lib/in/gen/a.c": "hit", "lib/in/q1.dat": "hit", "q1.dat": "hit", ".git/x": "hit"}
    files = spark.createDataFrame([(p, len(t), t) for p, t in texts.items()], "path string, size long, text string")
    found = lambda **k: [r["path"] for r in search(files, "hit", mode="files", gitignore=True, **k).collect()]
    assert found() == ["lib/in/gen/a.c", "q1.dat", "run.c"] and found(include=["attic/*"]) == ["attic/z.c", "lib/in/gen/a.c", "q1.dat", "run.c"] and found(subtree="lib") == ["in/gen/a.c"]
    assert [r["folder"] for r in load_rules(files, root_only=True).collect()] == ["", ""] and ".git/x" not in found(hidden=True)


def test_command_line(spark, root, capsys):
    run = lambda *a: (main(list(a), spark), capsys.readouterr().out)
    assert run("search", "Light[A-Z]", str(root), "-g", "*.go") == (0, "a.go:4:func LightLamp(n int) int { return n }\n")
    assert run("search", "-c", "lamps", str(root)) == (0, "a.go:2\nb.go:1\n")
    assert run("search", "nothing", str(root))[0] == 1 and run("search", "(", str(root))[0] == 2
    assert run("def", "LightLamp", str(root)) == (0, "a.go:4: [func LightLamp] func LightLamp(n int) int { return n }\n")
    assert run("symbols", "none.go", str(root))[0] == 2 and '"files":4' in run("status", "", str(root))[1]


def test_command_line_with_an_index(spark, root, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("DREDGE_ENGINE", "disk")
    monkeypatch.setenv("DREDGE_REBUILD_THRESHOLD", "2")
    run = lambda *a: (main([*a, "--index", str(tmp_path / "ix")], spark), capsys.readouterr().out)
    (root / "big.go").write_bytes(b"LightLamp big\n" + b"x" * (3 << 20))
    (root / "bin").write_bytes(b"LightLamp\0")
    (root / ".dredgeignore").write_text("skip/\n")
    (root / "skip").mkdir()
    (root / "skip/s.go").write_text("LightLamp")
    assert run("search", "-l", "LightLamp", str(root)) == (0, "_x/y.txt\na.go\nbig.go\n")
    (root / "b.go").write_text("package lamps\nfunc Other() { LightLamp(2) }\n")
    assert run("search", "-l", "LightLamp", str(root), "--no-sync") == (0, "_x/y.txt\na.go\nbig.go\n")
    assert run("search", "-l", "LightLamp", str(root)) == (0, "_x/y.txt\na.go\nb.go\nbig.go\n")
    assert run("refs", "LightLamp", str(root), "--limit", "1")[1].startswith("_x/y.txt:1:")
    assert run("def", "Other", str(root))[1] == "b.go:2: [func Other] func Other() { LightLamp(2) }\n"
    (root / "c.go").write_text("LightLamp()\n")  # with b.go the second change: both are written into the index
    assert run("search", "LightLamp", str(root), "--json", "-g", "[bc].go")[1].splitlines()[-1] == '{"type":"done","matches":2,"file_hits":2,"truncated":false}'
    assert run("search", "-l", "Other", str(root), "--no-sync") == (0, "b.go\n")
    assert run("search", "-l", "LightLamp", str(root / "_x")) == (0, "y.txt\n")  # a part of the indexed root
    assert '"engine":"disk"' in run("status", "", str(root))[1]
    assert run("forget", "", str(root)) == (0, f"{root}\n") and run("forget", "", str(root))[0] == 1
