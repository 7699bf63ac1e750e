"""Scans, streams with a restart, snapshots, and the outbox."""

import os
import zipfile

from inkwell.operators import budgets, sinks, sync
from inkwell.sources.scan import scan
from inkwell.streaming.ingest import appeared, ingest
from inkwell.streaming.state import Snapshots


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_scan(spark, tmp_path):
    for name in ("a.txt", "d/b.MD", "d/_x/c.txt", ".git/e.txt", "f.tmp", "g.exe", "~l.txt"):
        put(str(tmp_path / name), b"12345")
    assert [(r.rel, r.size) for r in scan(spark, str(tmp_path)).select("rel", "size").collect()] == [("a.txt", 5), ("d/b.MD", 5)]
    assert scan(spark, str(tmp_path / "missing")).count() == 0


def test_ingest_and_restart(spark, tmp_path):
    root, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    put(f"{root}/a.html", b"<h1>T</h1><p>one")
    with zipfile.ZipFile(f"{root}/b.zip", "w") as z:
        z.writestr("x.txt", "inside")
    ingest(spark, root, out, state)
    ingest(spark, root, out, state)
    put(f"{root}/c.txt", b"later")
    ingest(spark, root, out, state)
    rows = {r.path.rpartition("/in/")[2]: r.markdown for r in spark.read.parquet(out).collect()}
    assert rows == {"a.html": "# T\n\none", "b.zip/x.txt": "inside", "c.txt": "later"}
    assert spark.read.parquet(out).count() == 3


def test_watcher_sees_a_file_that_came_back(spark, tmp_path):
    put(str(tmp_path / "a.txt"), b"1")
    new, known = appeared(spark, str(tmp_path), spark.createDataFrame([], "rel string"))
    assert [r.rel for r in new.collect()] == ["a.txt"]
    known = spark.createDataFrame(known.collect(), "rel string")
    os.remove(tmp_path / "a.txt")
    put(str(tmp_path / "b.txt"), b"1")
    new, gone = appeared(spark, str(tmp_path), known)
    assert [r.rel for r in new.collect()] == ["b.txt"]
    gone = spark.createDataFrame(gone.collect(), "rel string")
    put(str(tmp_path / "a.txt"), b"2")
    assert [r.rel for r in appeared(spark, str(tmp_path), gone)[0].collect()] == ["a.txt"]


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "reg"), "k string, v long")
    assert s.read().count() == 0
    for i in range(4):
        s.update(lambda old, i=i: old.unionByName(spark.createDataFrame([(str(i), i)], "k string, v long")))
    assert s.versions() == [2, 3] and sorted(r.v for r in s.read().collect()) == [0, 1, 2, 3]
    os.makedirs(tmp_path / "reg" / "v=4")
    assert s.read().count() == 4


def test_vanished_is_empty_where_the_scan_is(spark):
    reg = spark.createDataFrame([(1,), (2,)], "id long")
    assert sync.vanished(reg, spark.createDataFrame([], "id long"), "id").count() == 0
    assert [r.id for r in sync.vanished(reg, spark.createDataFrame([(2,)], "id long"), "id").collect()] == [1]


def test_markdown_files_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a\\..\\b.md", "x"), ("c/d.md", None)], "rel string, markdown string")
    written = sinks.write_markdown(df, str(tmp_path / "o"))
    sinks.manifest(written, str(tmp_path / "m"))
    assert (tmp_path / "o/a/b.md").read_text() == "x" and (tmp_path / "o/c/d.md").read_text() == ""
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_outbox(spark):
    def send(rel, text):
        if rel == "dup":
            raise FileExistsError(rel)
        if rel == "bad":
            raise OSError("down")
        return f"id-{rel}"

    df = spark.createDataFrame([("ok", "x"), ("dup", "x"), ("bad", "x")], "rel string, markdown string")
    got = {r.rel: (r.status, r.attempts, r.detail) for r in sinks.deliver(df, send).collect()}
    assert got == {"ok": ("sent", 1, "id-ok"), "dup": ("exists", 1, ""), "bad": ("dead", 3, "down")}


def test_greedy_budget_skips_without_use(spark):
    df = spark.createDataFrame([("m", i, s) for i, s in enumerate([50, 90, 30, 20, 10])], "g string, o int, s int")
    got = [r.verdict for r in budgets.greedy_budget(df, "g", "o", "s", 80, 100).orderBy("o").collect()]
    assert got == ["kept", "too large", "kept", "kept", "over budget"]
