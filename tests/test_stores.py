"""Folders, ignore rules, remote contents and workspaces against plain models."""

import json
import os
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sightline.sources import folder, ignore, remote, workspace

# ---- ignore rules ------------------------------------------------------------------------

CASES = [
    (["*.log"], {"a.log", "x/b.log", "x.log/c.py"}, {"a.logs", "log"}),
    (["/a.py"], {"a.py"}, {"x/a.py"}),
    (["logs/"], {"logs/x", "a/logs/b/c"}, {"logs", "a/logs"}),
    (["doc/*.txt"], {"doc/a.txt"}, {"doc/x/a.txt", "x/doc/a.txt"}),
    (["doc/**/*.txt"], {"doc/a.txt", "doc/x/y/a.txt"}, {"x/doc/a.txt"}),
    (["**/tmp"], {"tmp", "a/b/tmp", "a/tmp/c"}, {"tmpx"}),
    (["a/**"], {"a/b", "a/b/c"}, {"a", "b/a/c"}),
    (["*.py", "!keep.py"], {"a.py", "x/b.py"}, {"keep.py", "x/keep.py"}),
    (["file[0-3].[!x]?"], {"file0.py", "x/file3.ab"}, {"file4.py", "file0.xy", "file0.p"}),
    (["\\#a", "\\!b", "c\\ ", "d  ", "e\\*"], {"#a", "!b", "c ", "d", "e*"}, {"c", "d  ", "ex", "e"}),
    (["# a comment", "", "   "], set(), {"# a comment", "a"}),
    (["[a-"], {"[a-"}, {"a"}),
    (["build/*", "!build/keep/"], {"build/x", "build/y/z"}, {"build/keep/a", "build"}),
]


@pytest.mark.parametrize("lines,dropped,kept", CASES)
def test_ignore_rules(spark, lines, dropped, kept):
    for path in dropped | kept:
        walk = ignore.Walk(lines)
        state, parts = walk.start(), path.split("/")
        for k, name in enumerate(parts):
            state = walk.step(state, name, k < len(parts) - 1)
        assert walk.drops(state) == (path in dropped), path
        hit = False
        for r in filter(None, map(ignore.parse, lines)):
            if re.search(ignore.path_pattern(r), path):
                hit = not r.negated
        assert hit == (path in dropped), path
    rows = spark.createDataFrame([(p,) for p in sorted(dropped | kept)], "path string")
    assert {r.path for r in ignore.pruned(rows, lines).collect()} == kept


def test_pruned_folders_are_never_listed(tmp_path, monkeypatch):
    for name in ("a.py", "logs/x.py", "logs/deep/y.py", "node_modules/z.js", "src/b.py", "src/security-scan-report.md", "src/c.patch", "src/big.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (50 if "big" in name else 5))
    (tmp_path / ".gitignore").write_text("logs/\n.gitignore\n")
    reader = folder.FolderReader({"path": str(tmp_path), "maxsize": "20", "batchfiles": "1"})
    seen = []
    real = reader._open

    class Watched:
        def __init__(self, store):
            self.store = store

        def get_file_info(self, what):
            seen.append(os.path.relpath(what.base_dir, tmp_path))
            return self.store.get_file_info(what)

        def __getattr__(self, name):
            return getattr(self.store, name)

    monkeypatch.setattr(reader, "_open", lambda: (Watched(real()[0]), real()[1]))
    parts = reader.partitions()
    assert sorted(seen) == [".", "src"]
    assert [p.names for p in parts] == [[("a.py", 5)], [("src/b.py", 5)]]
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert rows == [{"path": "a.py", "size": 5, "content": "xxxxx"}, {"path": "src/b.py", "size": 5, "content": "xxxxx"}]


def test_folder_texts(spark, tmp_path):
    for name, data in {"a.txt": b"one\r\ntwo\rthree\n", "b.bin": b"\xff\xfe", "c/é.txt": "é".encode(), "e.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.content for r in folder.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\ntwo\nthree\n", "c/é.txt": "é", "e.txt": ""}
    assert {r.path for r in folder.scan(spark, str(tmp_path), under="c").collect()} == {"c/é.txt"}
    assert folder.scan(spark, str(tmp_path / "none")).collect() == []


# ---- remote contents -----------------------------------------------------------------------


def test_recorded_batches_read_their_row_groups(spark, tmp_path):
    """A batch reads the row groups that may have its files, not the whole table; tables in no order give the same rows."""
    names = [f"d{i % 3}/{i:04}.py" for i in range(600)]
    rows = [(n, json.dumps({"type": "file", "path": n, "content": n})) for n in names if not n.endswith("7.py")]
    listed = lambda of, kind, items: (of, json.dumps([{"type": kind, "path": x} for x in items]))
    rows += [listed(f"d{k}", "file", sorted(n for n in names if n.startswith(f"d{k}/"))) for k in range(3)] + [listed("", "dir", ["d0", "d1", "d2"])]
    table = pa.Table.from_pylist([{"path": p, "answer": a} for p, a in sorted(rows)])
    for at, t in (("ordered", table), ("mixed", table.take([(i * 101) % len(table) for i in range(len(table))]))):
        (tmp_path / at).mkdir()
        pq.write_table(t, tmp_path / at / "part-0.parquet", row_group_size=20)
        got = remote.contents(spark, f"file://{tmp_path}/{at}", batch=10).collect()
        assert {(r.path, r.content, r.error) for r in got} == {(n, None, "status 404") if n.endswith("7.py") else (n, n, None) for n in names} and len(got) == 600
    parts = remote.RemoteReader({"base": f"file://{tmp_path}/ordered", "batch": "10"}).partitions()
    assert len(parts) == 60 and all(sum(len(g) for g in p.where.values()) <= 3 for p in parts)


def test_remote_over_http(spark):
    answers = {
        "": [{"type": "file", "path": "a.py"}, {"type": "dir", "path": "lib"}, {"type": "symlink", "path": "l"}, {"type": "file", "path": "gone.py"}],
        "lib": [{"type": "file", "path": "lib/b c.py"}, {"type": "file", "path": "lib/odd.py"}, {"type": "dir", "path": "lib/missing"}],
        "a.py": {"type": "file", "path": "a.py", "encoding": "base64", "content": "/3ggPSAx"},
        "lib/b c.py": {"type": "file", "path": "lib/b c.py", "content": "plain"},
        "lib/odd.py": {"type": "file", "path": "lib/odd.py", "encoding": "base64", "content": "a"},
    }
    asked = []

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            from urllib.parse import parse_qs, unquote, urlparse

            url = urlparse(self.path)
            path = unquote(url.path.removeprefix("/contents/"))
            asked.append((path, parse_qs(url.query)["ref"], self.headers["Authorization"]))
            self.send_response(200 if path in answers else 404)
            self.end_headers()
            self.wfile.write(json.dumps(answers.get(path, {})).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = remote.contents(spark, f"http://127.0.0.1:{server.server_port}", batch=2, pause="0", ref="main", token="t0k")
        assert df.rdd.getNumPartitions() == 3  # two batches of files, the folder that can't be listed
        got = {(r.path, r.content, r.error) for r in df.collect()}
        one = {(r.path, r.content) for r in remote.contents(spark, f"http://127.0.0.1:{server.server_port}", start="a.py", pause="0").collect()}
    finally:
        server.shutdown()
    assert got == {("a.py", "�x = 1", None), ("lib/b c.py", "plain", None), ("gone.py", None, "status 404"), ("lib/odd.py", None, "content is no base64"), ("lib/missing", None, "status 404")}
    assert one == {("a.py", "�x = 1")}
    assert all(ref == ["main"] and bearer == "Bearer t0k" for _, ref, bearer in asked[:3])


def test_diff_files(spark):
    rows = [(1, json.dumps({"files": [{"filename": "a", "patch": "@@"}, {"filename": "b"}, {"filename": "", "patch": "x"}, {"patch": "y"}, {"filename": "c", "patch": ""}]})), (2, "{}"), (3, None), (4, "no json")]
    got = remote.diff_files(spark.createDataFrame(rows, "n int, answer string"), F.col("answer"), "n").collect()
    assert {tuple(r) for r in got} == {(1, "a", "@@"), (1, "c", "")}


# ---- workspace -------------------------------------------------------------------------------

FILES = "run string, ord int, path string, content string, size string"


def plain_admit(rows, per_file, per_run):
    out, totals = {}, {}
    for run, ord_, path, content, _ in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        parts = [p for p in (path or "").split("/") if p not in ("", ".")]
        n = len((content or "").encode())
        fault = "NUL in name" if path and "\0" in path else "absolute path" if path and path.startswith("/") else "parent folder in path" if ".." in parts else "no name" if not parts else "file too large" if n > per_file else None
        if fault is None and totals.get(run, 0) + n > per_run:
            fault = "run too large"
        if fault is None:
            totals[run] = totals.get(run, 0) + n
        out[run, ord_] = (n, fault)
    return out


def rows_of(n):
    names = ["a/b.py", "/abs", "../up", "a/../b", "x\0y", "", ".", "./c//d.py", None, "é.txt", "..hidden", "a..b"]
    named = [names[i % 12] and names[i % 12] + (str(i) if i >= 12 else "") for i in range(n)]
    return [(f"r{i % 3}" if i % 7 else None, i, named[i], ["x" * (i % 40), "é" * (i % 30), None][i % 3], "clash") for i in range(n)]


def test_admission_equals_plain_fold(spark):
    rows = rows_of(200)
    df = spark.createDataFrame(rows, FILES).drop("size").repartition(5)
    got = {(r.run, r.ord): (r.size, r.fault) for r in workspace.admit(df, per_file=35, per_run=300).collect()}
    assert got == plain_admit(rows, 35, 300)
    assert workspace.admit(df.limit(0)).collect() == []


def test_written_files(spark, tmp_path):
    rows = [r for r in rows_of(60) if r[0] is not None]
    df = workspace.admit(spark.createDataFrame(rows, FILES).drop("size").repartition(3), per_file=35, per_run=100)
    good = df.filter("fault IS NULL").collect()
    workspace.write(df.filter("fault IS NULL"), str(tmp_path / "w"))
    want = {f"{r.run}/" + "/".join(p for p in r.path.split("/") if p not in ("", ".")): (r.content or "").encode() for r in good}
    found = {os.path.relpath(os.path.join(d, n), tmp_path / "w"): open(os.path.join(d, n), "rb").read() for d, _, ns in os.walk(tmp_path / "w") for n in ns}
    assert found == want and not (tmp_path / "w" / workspace.STAGING).exists()


def test_failed_tasks_leave_nothing(spark, tmp_path):
    boom = F.when(F.col("ord") == 150, F.raise_error(F.lit("task fails"))).otherwise(F.col("content"))
    df = spark.createDataFrame([("r", i, f"f{i}", "x", "clash") for i in range(200)], FILES).repartition(4).withColumn("content", boom.cast("string"))
    with pytest.raises(Exception, match="task fails"):
        workspace.write(df, str(tmp_path / "w"))
    assert [n for _, _, ns in os.walk(tmp_path) for n in ns] == []


def test_links_are_not_followed(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "w" / "r").mkdir(parents=True)
    os.symlink(tmp_path / "out", tmp_path / "w" / "r" / "link")
    workspace.write(spark.createDataFrame([("r", 1, "link/a.py", "x", ""), ("r", 2, "b.py", "y", "")], FILES), str(tmp_path / "w"))
    assert os.listdir(tmp_path / "out") == [] and (tmp_path / "w" / "r" / "b.py").read_text() == "y"
