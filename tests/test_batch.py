"""A batch run, again, and after changes; settings."""

import os

from inkwell.functions import config
from inkwell.plans.batch import Report, quality_report, run_batch


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_runs(spark, tmp_path):
    from inkwell.plans.format_plans import pack

    root, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    put(f"{root}/a.txt", b"# T\n\nhello")
    put(f"{root}/d/b.docx", pack("docx", ["word"]))
    put(f"{root}/bad.pdf", b"%PDF-1.4")
    put(f"{root}/z.zip", pack("zip", ["inside"]))
    assert run_batch(spark, root, out, state) == Report(4, 3, 1, 0, 0)
    assert open(f"{out}/a.txt.md").read() == "# T\n\nhello" and open(f"{out}/d/b.md").read() == "word" and open(f"{out}/z.zip/d/a.txt.md").read() == "inside"
    assert run_batch(spark, root, out, state) == Report(4, 0, 1, 3, 0)
    put(f"{root}/a.txt", b"changed text")
    os.remove(f"{root}/d/b.docx")
    assert run_batch(spark, root, out, state) == Report(3, 1, 1, 1, 1)
    assert open(f"{out}/a.txt.md").read() == "changed text"
    assert {r.path for r in spark.read.json(f"{state}/vanished/run=2").collect()} == {"d/b.md"}
    os.remove(f"{out}/z.zip/d/a.txt.md")  # an output that is gone is made again
    assert run_batch(spark, root, out, state) == Report(3, 1, 1, 1, 0)
    assert open(f"{out}/z.zip/d/a.txt.md").read() == "inside"
    report = {r.kind: r.n for r in quality_report(spark.read.parquet(f"{state}/outputs/run=0")).collect()}
    assert report["txt"] == 2 and report["docx"] == 1


def test_five_runs_keep_all_outputs(spark, tmp_path):
    """Each run adds a file; names are no globs; a copy that keeps size and time but not its text is seen."""
    root, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    names = ["f0.txt", "f[1].txt", "f {2}.md", "f*3.doc", "f4.msg"]
    for i, name in enumerate(names):
        put(f"{root}/{name}", f"text {i}".encode())
        report = run_batch(spark, root, out, state)
        assert report.scanned == i + 1 and report.converted + report.failed >= 1
    made = spark.read.parquet(f"{state}/outputs")
    assert {r.source for r in made.collect()} == set(names) and {r.run for r in made.select("run").distinct().collect()} == {0, 1, 2, 3, 4}
    before = os.stat(f"{root}/f0.txt")
    put(f"{root}/f0.txt", b"text X")
    os.utime(f"{root}/f0.txt", ns=(before.st_atime_ns, before.st_mtime_ns))
    run_batch(spark, root, out, state)
    assert open(f"{out}/f0.txt.md").read() == "text X"


def test_one_file(spark, tmp_path):
    from inkwell.sources.decoders import markdown_of

    put(str(tmp_path / "a[1].html"), b"<h1>T</h1><p>x")
    assert [(r.markdown, r.error) for r in markdown_of(spark, str(tmp_path / "a[1].html")).collect()] == [("# T\n\nx", None)]
    assert [(r.markdown, r.error) for r in markdown_of(spark, str(tmp_path / "a[1].html"), 5).collect()] == [(None, "resource_limit")]


def test_settings():
    base = {"a": {"b": 1, "f": 1.5, "on": True}, "api_key": "abcdefghijkl"}
    new = config.put(base, "a.b", 2)
    assert new["a"] == {"b": 2, "f": 1.5, "on": True} and base["a"]["b"] == 1
    assert config.get(new, "a.b") == 2 and config.get(new, "a.x.y", 7) == 7
    assert config.masked(new)["api_key"] == "****ijkl"
    assert config.wrong_types(base, {"a": {"b": "x", "f": 2, "on": 1}, "c": 1}) == ["a.b", "a.on", "c"]
