"""Numbered parts: no list of all bounds, no plan that grows with the parts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from sheaf.operators import packing
from sheaf.operators.packing import Parts, number, with_part
from sheaf.plans import packs as P
from sheaf.plans.packs import PackOptions, process_files

MTIME = dt.datetime(2024, 1, 2, 3, 4, tzinfo=dt.timezone.utc)


def test_a_hundred_thousand_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 16)
    bounds = spark.range(100_000).select(F.lit("hot").alias("k"), F.col("id").alias("part"), F.struct((F.col("id") * 10).alias("o")).alias("first"))
    bounds = bounds.union(spark.createDataFrame([("two", 0, (5,)), ("two", 1, (8,))], "k string, part long, first struct<o:long>"))
    rows = spark.range(5, 1_000_005, 997).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    rows = rows.union(spark.createDataFrame([("two", 0), ("two", 5), ("two", 7), ("two", 8), ("two", 99), ("none", 3)], "k string, o long"))
    parts = Parts(["k"], ["o"], None, bounds)
    out = with_part(rows, parts, limit=1 << 30)
    for row in out.collect():
        want = {"hot": min(row.o // 10, 99_999), "two": int(row.o >= 8), "none": 0}[row.k]
        assert (row.part, row.parts) == (want, {"hot": 100_000, "two": 2, "none": 1}[row.k])
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_both_ways_agree(spark, limit):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.lit(10).alias("w"))
    parts = number(rows, ["k"], ["o"], "w", part_bytes=95, rows_per_slice=50)
    got = {(r.k, r.o): (r.part, r.parts) for r in with_part(rows, parts, limit).collect()}
    for (k, o), (part, count) in got.items():
        assert part == o // 3 * 10 // 95 and count == max(p for (j, _), (p, _) in got.items() if j == k) + 1
    assert len(got) == 500


def _checkpoints(spark, monkeypatch, n):
    made = []
    for module in (P, packing):
        real = module.freeze
        monkeypatch.setattr(module, "freeze", lambda df, real=real: made.append(1) or real(df))
    rows = [("s", f"/h/p/f{i:03}.py", b"def :" if i else b"x = 1", MTIME) for i in range(n)]
    files = spark.createDataFrame(rows, "session_id string, path string, content binary, mtime timestamp")
    roots = spark.createDataFrame([("s", "/h/p")], "session_id string, root string")
    none = spark.createDataFrame([], "session_id string, mode string, selected_file string, selected_items array<string>")
    packs = process_files(files, roots, none, PackOptions(home="/h", part_bytes=300)).collect()
    assert len(packs) == 1 and packs[0].parts == 1 and len(packs[0].errors) == n - 1
    monkeypatch.undo()
    return len(made)


def test_planning_does_not_grow_with_the_parts(spark, monkeypatch):
    assert _checkpoints(spark, monkeypatch, 6) == _checkpoints(spark, monkeypatch, 60)


def test_own_patterns_and_stored_trees(spark):
    rows = [(s, f"/h/p/{n}", b"t", MTIME) for s in ("a", "b", "c") for n in ("x.md", "y.md", "dist.md")]
    files = spark.createDataFrame(rows, "session_id string, path string, content binary, mtime timestamp")
    roots = spark.createDataFrame([("a", "/h/p", "x"), ("b", "/h/p", None), ("c", "/h/p", "(")], "session_id string, root string, ignore string")
    none = spark.createDataFrame([], "session_id string, mode string, selected_file string, selected_items array<string>")
    trees = spark.createDataFrame([("a", 0, 2, "# Tree\n"), ("a", 1, 2, "end\n")], "session_id string, part long, parts long, rendered string")
    packs = process_files(files, roots, none, PackOptions(home="/h"), stored_trees=trees)
    text = {r.session_id: r.output_text for r in packs.collect()}
    shown = {s: [n for n in ("x.md", "y.md", "dist.md") if f"~/p/{n}" in t] for s, t in text.items()}
    assert shown == {"a": ["y.md", "dist.md"], "b": ["x.md", "y.md"], "c": ["x.md", "y.md", "dist.md"]}
    assert text["a"].startswith("# Tree\nend\n\n\n# ~/p/dist.md") and text["b"].startswith("# ~/p/x.md")


def test_a_refresh_reads_only_changed_parts(spark, tmp_path):
    from sheaf.functions.text import content_hash, is_text
    from sheaf.plans.refresh import refresh_parts, stored_parts

    schema = "session_id string, path string, content binary, mtime timestamp"
    none = spark.createDataFrame([], "session_id string, mode string, selected_file string, selected_items array<string>")
    state = spark.createDataFrame([("one", "Single File", "/h/p/f01.md", [])], none.schema)
    names = [f"f{i:02}.md" for i in range(12)] + ["z1.py", "z2.py"]
    first = {(s, f"/h/p/{n}"): (b"def :" if n.endswith(".py") else b"text " * 20) for s in ("a", "b", "one") for n in names}
    first |= {("bin", "/h/p/x"): b"\x00", ("gone", "/h/p/dist/x.md"): b"ignored"}
    second = dict(first) | {("a", "/h/p/f03.md"): b"TEXT " * 20, ("b", "/h/p/z1.py"): b"x = 1", ("b", "/h/p/new.md"): b"n"}
    del second["b", "/h/p/f11.md"]
    roots = spark.createDataFrame([(s, "/h/p") for s in ("a", "b", "one", "bin", "gone")], "session_id string, root string")
    options, seen = PackOptions(home="/h", part_bytes=1500), []

    def refresh(files, tick):
        table = spark.createDataFrame([(s, p, c, MTIME) for (s, p), c in files.items()], schema)
        entries = table.select("session_id", "path", "mtime", F.length("content").cast("bigint").alias("length"), content_hash("content").alias("current_hash"), is_text("content").alias("is_text"))

        def read(listed):
            seen.append(sorted(r.path for r in listed.collect()))
            return listed.select("path").join(spark.createDataFrame([(p, c) for (_, p), c in by_path(files).items()], "path string, content binary"), "path")

        got = refresh_parts(entries, read, roots, state, options, str(tmp_path / "store"), tick).drop("tick")
        want = process_files(table, roots, state, options)
        key = lambda r: (r.session_id, r.part, r.parts, r.output_text, sorted(map(tuple, r.errors)), r.line_count)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))

    def by_path(files):
        return {(0, p): c for (_, p), c in files.items()}

    # contents by path alone, so each session's files need names of their own where they differ
    def own(files):
        return {(s, p.replace("/h/p/", f"/h/p/{s}-") if s != "gone" else p): c for (s, p), c in files.items()}

    state = spark.createDataFrame([("one", "Single File", "/h/p/one-f01.md", [])], none.schema)
    refresh(own(first), 0)
    refresh(own(first), 1)
    assert seen[1] == []
    refresh(own(second), 2)
    assert 0 < len(seen[2]) < 20 and "/h/p/a-f03.md" in seen[2] and "/h/p/one-f01.md" not in seen[2] and "/h/p/a-f11.md" not in seen[2]
    refresh(own(second), 2)
    assert seen[3] == seen[2]
    assert {r.tick for r in stored_parts(spark, str(tmp_path / "store")).collect()} == {0, 2}
