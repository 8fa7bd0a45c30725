"""Listing in rounds, stores by URI, incremental polls, folder digests, the exchange of requests."""

import json
import os

import pytest
from pyspark.sql import functions as F
from sheaf.functions.text import content_hash
from sheaf.operators.stale import KEPT, advance_hashes, current_hashes, stale_by_digests, stale_files
from sheaf.session import folder_names, remove_folder
from sheaf.sources.contents import read_contents
from sheaf.sources.listing import list_directory, list_tree
from sheaf.streaming.serve import respond, responses, serve


@pytest.fixture
def tree(tmp_path):
    base = tmp_path / "t"
    for i in range(3):
        for j in range(20):
            for k in range(2):
                folder = base / ("hot" if j else f"cold{i}") / f"d{i}_{j}" / f"e{k}"
                folder.mkdir(parents=True, exist_ok=True)
                (folder / "_f.txt").write_bytes(b"x" * (i + j))
    (base / "__init__.py").write_bytes(b"")
    (base / ".secret").write_bytes(b"s")
    os.symlink(base / "hot", base / "again")
    return str(base)


def rows(df, head=""):
    return sorted((r.path.removeprefix(head), r.parent.removeprefix(head) if r.parent else None, r.name, r.is_dir, r.length, r.mtime, r.error) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"hidden": True}, {"max_depth": 1}, {"ignore": "hot$", "prune_ignored_dirs": True}, {"ignore": "_f"}])
def test_rounds_equal_the_walk(spark, tree, options):
    want = rows(list_directory(spark, tree, **options))
    assert rows(list_tree(spark, tree, folders_per_task=3, **options)) == want
    assert rows(list_tree(spark, "file://" + tree, folders_per_task=3, **options), "file://") == want


def test_a_hot_subtree_is_listed_by_many_tasks(spark, tree):
    listed = list_tree(spark, tree, folders_per_task=4)
    files = listed.where("path LIKE '%/hot/%' AND NOT is_dir").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 4
    assert list_tree(spark, tree + "/none").first().error


def test_stores_read_heads_and_bounded_bodies(spark, tmp_path):
    (tmp_path / "_a").write_bytes(b"a" * 3000)
    (tmp_path / "b").write_bytes(b"\x00" + b"b" * 3000)
    (tmp_path / "empty").write_bytes(b"")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        found = {r.path[-2:].strip("/"): r for r in read_contents(list_tree(spark, root), text_only=True).collect()}
        assert {n: len(r.content) for n, r in found.items()} == {"_a": 3000, "b": 1027, "ty": 0}
        grown = list_tree(spark, root).withColumn("length", F.when(F.col("is_dir"), None).otherwise(F.lit(1).cast("bigint")))
        got = {r.path[-2:].strip("/"): (r.error, r.content) for r in read_contents(grown, max_bytes=2000).collect()}
        assert got["_a"] == ("too large", None) and got["ty"] == (None, b"")
        gone = list_tree(spark, root).where("NOT is_dir").limit(1).withColumn("path", F.concat("path", F.lit("x")))
        assert read_contents(gone).first().error == "missing"


def test_polls_read_what_changed(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}").write_bytes(b"x%d" % i)
    read = []

    def tick(kept, n):
        def contents(listing):
            read.append(sorted(r.path[-2:] for r in listing.collect()))
            return read_contents(listing)

        return spark.createDataFrame(advance_hashes(kept, list_directory(spark, str(tmp_path)), contents, n).collect(), KEPT)

    first = tick(spark.createDataFrame([], KEPT), 0)
    second = tick(first, 1)
    os.remove(tmp_path / "f0")
    (tmp_path / "f1").write_bytes(b"longer")
    (tmp_path / "new").write_bytes(b"n")
    third = tick(second, 2)
    assert read == [[f"f{i}" for i in range(6)], [], ["ew", "f1"]]
    assert {r.path[-2:]: r.read_at for r in third.collect()} == {"f1": 2, "ew": 2, "f2": 0, "f3": 0, "f4": 0, "f5": 0}
    snapshot = first.selectExpr("'s' AS session_id", "path", "current_hash AS hash")
    assert {r.path[-2:]: r.status for r in stale_files(snapshot, third).collect()} == {"f0": "missing", "f1": "modified"}


def test_folder_digests_find_the_same(spark):
    paths = [f"/a/{i % 3}/{i % 5}/f{i}" for i in range(60)] + ["/top", "flat"]
    snapshot = spark.createDataFrame([(s, p, "old") for s in ("s", "t") for p in paths] + [("u", "/a/0/0/f0", "new")], "session_id string, path string, hash string")
    snapshot = snapshot.withColumn("hash", content_hash(F.col("hash").cast("binary")))
    now = [(p, b"new" if p == "/a/0/0/f0" else b"old", "error" if p == "/top" else None) for p in paths if p != "/a/1/1/f1"]
    now += [("/a/2/2/added", b"n", None)]
    current = current_hashes(spark.createDataFrame(now, "path string, content binary, error string"))
    want = sorted(map(tuple, stale_files(snapshot, current).collect()))
    assert len(want) == 6
    assert sorted(map(tuple, stale_by_digests(snapshot, current, ["session_id"]).collect())) == want
    assert stale_by_digests(snapshot.where("false"), current, ["session_id"]).count() == 0


UUID = "00000000-0000-4000-8000-000000000001"


def line(action="process_files", files=("/d/a",)):
    return json.dumps({"action": action, "session_id": UUID, "timestamp": "2024-01-01T00:00:00Z", "payload": {"files": list(files)}})


def _answer(asked):
    size = F.size(F.try_variant_get("request_data.payload", "$.files", "array<string>"))
    return asked.where(size > 1).select("request", F.struct(size.alias("n")).alias("payload"))


def test_respond(spark):
    lines = spark.createDataFrame(
        [("1", line(files=["/d/a", "/d/b"])), ("2", line("dance")), ("3", line(files=["/d/a", "/d/gone"])), ("4", line()), ("5", "{"), ("6", None)],
        "request string, value string")
    listing = spark.createDataFrame([("/d/a", False), ("/d/b", False)], "path string, is_dir boolean")
    got = {r.request: (r.success, json.loads(r.value)) for r in respond(lines, _answer, listing, ["/d"]).collect()}
    assert got["1"] == (True, {"action": "process_files", "session_id": UUID, "success": True, "payload": {"n": 2}})
    kinds = {k: v["error"]["type"] for k, (ok, v) in got.items() if not ok}
    assert kinds == {"2": "ValidationError", "3": "FileNotFoundError", "4": "ProcessingError", "5": "ValidationError", "6": "ValidationError"}


def test_a_batch_run_again_answers_once(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    (incoming / "a.txt").write_text("\n".join([line(files=["/d/a", "/d/b"])] * 3 + [line("dance")]))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    fail = [True]

    def answer(asked):
        if fail.pop() if fail else False:
            raise RuntimeError("stopped")
        return _answer(asked)

    def run():
        started = serve(spark.readStream.text(str(incoming)).select("value", "_metadata"), out, marks, answer)
        try:
            started.awaitTermination()
        except Exception:
            pass
        return started

    run()
    assert responses(spark, out).count() == 0
    run()
    assert responses(spark, out).count() == 4
    remove_folder(spark, f"{marks}/commits/0")
    run()
    (incoming / "b.txt").write_text(line())
    run()
    found = responses(spark, out).collect()
    assert sorted((r.batch, r.success) for r in found) == [(0, False), (0, True), (0, True), (0, True), (1, False)]
    assert folder_names(spark, str(tmp_path / "none")) == []
