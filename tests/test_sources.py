"""Directories, contents, sessions, states, trees and requests."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from sheaf.operators.requests import missing_files, validate
from sheaf.operators.roots import marker_dirs, project_roots
from sheaf.operators.selection import resolve_basenames
from sheaf.operators.stale import current_hashes, snapshot, stale_files
from sheaf.operators.tree import tree_lines, tree_text
from sheaf.schema import SESSION
from sheaf.sources.contents import read_contents
from sheaf.sources.export import export_blocks, exportable
from sheaf.sources.listing import list_directory
from sheaf.sources.ndjson import error_response, parse_requests, stream_requests, success_response
from sheaf.sources.sessions import parse_sessions, read_sessions, session_json


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "proj"
    for name, content in {
        "_x.py": b"x = 1\n",
        "_dir/y.py": b"y = 2\n",
        ".hidden": b"h",
        ".git/config": b"c",
        "__main__.py": b"",
        "sp ace/é.md": "é".encode(),
        "sub/deep/er/z.bin": b"\x00",
        "build/out.txt": b"o",
    }.items():
        target = base / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    (base / "empty").mkdir()
    os.symlink(base, base / "sub" / "loop")
    os.symlink(base / "nowhere", base / "dangling")
    os.symlink(base / "_x.py", base / "link.py")
    return str(base)


def names(df, base):
    return sorted(r.path[len(base) + 1 :] for r in df.collect())


def test_listing_rules(spark, folder):
    files = list_directory(spark, folder).where("not is_dir")
    want = ["__main__.py", "_dir/y.py", "_x.py", "build/out.txt", "link.py", "sp ace/é.md", "sub/deep/er/z.bin"]
    assert names(files, folder) == want
    assert names(list_directory(spark, folder, ignore="build").where("not is_dir"), folder) == [
        n for n in want if not n.startswith("build")
    ]
    everything = list_directory(spark, folder, hidden=True)
    assert {".hidden", ".git", ".git/config", "empty"} <= set(names(everything, folder))
    shallow = list_directory(spark, folder, max_depth=0)
    assert all("/" not in n for n in names(shallow, folder))
    pruned = list_directory(spark, folder, ignore="sub$", prune_ignored_dirs=True)
    assert not [n for n in names(pruned, folder) if n.startswith("sub")]
    missing = list_directory(spark, folder + "/none").collect()
    assert len(missing) == 1 and missing[0].error


def test_late_read(spark, folder):
    listed = list_directory(spark, folder)
    rows = {r.path[len(folder) + 1 :]: r for r in read_contents(listed).collect()}
    assert rows["__main__.py"].content == b"" and rows["__main__.py"].error is None
    assert rows["sp ace/é.md"].content == "é".encode()
    gone = spark.createDataFrame([("/none/x", False, None, 1)], "path string, is_dir boolean, mtime timestamp, length bigint")
    assert read_contents(gone).first().error == "missing"


def test_stale_round_trip(spark, folder):
    def now():
        return read_contents(list_directory(spark, folder)).withColumn("session_id", F.lit("s"))

    stored = spark.createDataFrame(snapshot(now()).collect(), "session_id string, path string, hash string")
    assert stale_files(stored, current_hashes(now())).count() == 0
    with open(folder + "/_x.py", "ab") as f:
        f.write(b"more\n")
    os.remove(folder + "/_dir/y.py")
    with open(folder + "/new.py", "w") as f:
        f.write("n")
    got = {r.path[len(folder) + 1 :]: r.status for r in stale_files(stored, current_hashes(now())).collect()}
    assert got == {"_x.py": "modified", "link.py": "modified", "_dir/y.py": "missing"}


def test_tree_of_a_directory(spark, folder):
    bases = spark.createDataFrame([(folder, "~/proj/")], "base string, display string")
    listed = list_directory(spark, folder, hidden=True)
    lines = tree_lines(listed, bases, "build|.git")
    want = (
        "# Folder Tree of ~/proj/\n\n```text\nproj/\n├── _dir/\n│   └── y.py\n├── empty/\n├── sp ace/\n│   └── é.md\n"
        "├── sub/\n│   └── deep/\n│       └── er/\n│           └── z.bin\n├── .hidden\n├── __main__.py\n├── _x.py\n"
        "└── link.py\n```\n"
    )
    rows = tree_text(lines, bases).collect()
    assert [r.rendered for r in rows] == [want]
    parts = sorted(tree_text(lines, bases, part_bytes=40).collect(), key=lambda r: r.part)
    assert len(parts) > 3 and "".join(r.rendered for r in parts) == want


def tree_of(spark, entries, pattern="zzz", depth=5):
    listing = spark.createDataFrame(entries, "path string, is_dir boolean, error string")
    bases = spark.createDataFrame([("/b",)], "base string")
    rows = tree_lines(listing, bases, pattern, depth).collect()
    return [r.line for r in sorted(rows, key=lambda r: [tuple(k) for k in r.key])]


def test_tree_edges(spark):
    chain = [("/b" + "/d" * i, True, None) for i in range(0, 8)]
    assert tree_of(spark, chain) == ["    " * i + "└── d/" for i in range(5)]
    cases = [("/b", True, None), ("/b/a.md", False, None), ("/b/A.md", False, None), ("/b/B.md", False, None)]
    assert tree_of(spark, cases) == ["├── A.md", "├── a.md", "└── B.md"]
    denied = [("/b", True, None), ("/b/x", True, "denied"), ("/b/y", False, None)]
    assert tree_of(spark, denied) == ["├── x/", "│   └── [permission denied]", "└── y"]
    inside = [("/b", True, None), ("/b/t", True, None), ("/b/t/k", False, None), ("/b/u", False, None)]
    assert tree_of(spark, inside, "/t$") == ["└── u"]
    assert tree_of(spark, inside, "/b") == []
    assert tree_of(spark, inside, "(") == ["├── t/", "│   └── k", "└── u"]


def test_project_roots(spark):
    selection = spark.createDataFrame(
        [("a", "/home/u/p/x/1.py"), ("a", "/home/u/p/x/y/2.py"), ("b", "/home/u/q/only.py"), ("c", "/srv/m/a"), ("d", "/home/u/z/a")],
        "session_id string, path string",
    )
    listing = spark.createDataFrame(
        [("/home/u/p/.git",), ("/home/u/package.json",), ("/home/setup.py",), ("/Cargo.toml",), ("/home/u/z/pom.xml/x",)],
        "path string",
    )
    rows = project_roots(selection, marker_dirs(listing), "/home/u").collect()
    assert {r.session_id: (r.common, r.root) for r in rows} == {
        "a": ("/home/u/p/x", "/home/u/p"),
        "b": ("/home/u/q/only.py", "/home/u"),
        "c": ("/srv/m/a", "/"),
        "d": ("/home/u/z/a", "/home/u"),
    }
    none = project_roots(selection.where("session_id = 'b'"), marker_dirs(listing.limit(0)), "/home/u").first()
    assert none.root == "/home/u/q/only.py"


def test_basename_takes_the_first(spark):
    selection = spark.createDataFrame([("s", 2, "/b/x.py"), ("s", 1, "/z/x.py")], "session_id string, ord int, path string")
    wanted = spark.createDataFrame([("s", "x.py"), ("s", "/b/x.py"), ("s", "none")], "session_id string, name string")
    got = {r.name: r.path for r in resolve_basenames(wanted, selection).collect()}
    assert got == {"x.py": "/z/x.py", "/b/x.py": "/b/x.py"}


FULL_SESSION = {
    "id": "7d1c6a5e-0000-4000-8000-000000000001",
    "timestamp": "2031-03-04T05:06:07.000120+00:00",
    "files": ["/work/shop/cart.py", "/work/shop/notes.md"],
    "file_metadata": [
        {"path": "/work/shop/cart.py", "display_path": "~/shop/cart.py", "is_text_file": True, "language": "python",
         "last_modified": "2031-03-01T00:00:00+00:00", "file_hash": "00ff", "size_bytes": 77},
        {"path": "/work/shop/notes.md", "display_path": "~/shop/notes.md", "is_text_file": False, "language": None,
         "last_modified": None, "file_hash": None, "size_bytes": None},
    ],
    "selection_state": {"mode": "Single File", "selected_file": "/work/shop/cart.py", "selected_items": ["Cart", "add"]},
    "project_root": "/work/shop",
    "tree_snapshot": {"base_path": "/work/shop", "base_path_display": "~/shop/", "ignore_regex": r"tmp|\.lock",
                      "rendered": "shop/\n├── cart.py\n└── notes.md"},
    "output_text": "Überschrift\n\"quoted\"",
    "settings": {"auto_copy": False, "depth": 5, "include_tree": True},
}


def test_session_round_trip(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(FULL_SESSION, indent=2), encoding="utf-8")
    good, bad = read_sessions(spark, str(tmp_path / "one.json"), whole_file=True)
    assert bad.count() == 0
    line = good.select(session_json()).first()[0]
    assert json.loads(line) == FULL_SESSION
    assert list(json.loads(line)) == list(FULL_SESSION)


def test_session_defaults_and_required_keys(spark):
    least = {"id": "a", "timestamp": "2025-07-05T12:00:00Z", "files": []}
    lines = [least, {**least, "id": None}, {"id": "b", "files": []}, {"id": "c", "timestamp": "2025-07-05T12:00:00Z"},
             {**least, "file_metadata": [{"path": "/x"}]}]
    texts = [json.dumps(x) for x in lines] + ["{broken"]
    good, bad = parse_sessions(spark.createDataFrame([(t,) for t in texts], "value string"))
    row = json.loads(good.select(session_json()).first()[0])
    assert good.count() == 1
    assert row["selection_state"] == {"mode": "All Files", "selected_file": None, "selected_items": []}
    assert (row["file_metadata"], row["settings"], row["project_root"]) == ([], {}, None)
    assert sorted(r.problem for r in bad.collect()) == ["file_metadata", "files", "id", "malformed", "timestamp"]


def test_timestamp_has_an_offset(spark):
    row = (None, datetime(2025, 1, 1, tzinfo=timezone.utc), [], [], None, None, None, None, None)
    df = spark.createDataFrame([(row,)], "session " + SESSION.simpleString())
    assert json.loads(df.select(session_json()).first()[0])["timestamp"] == "2025-01-01T00:00:00+00:00"


UUID = "550e8400-e29b-41d4-a716-446655440000"


def request(action="process_files", session=UUID, payload=None):
    return json.dumps({"action": action, "session_id": session, "timestamp": "2025-07-05T14:30:00Z",
                       "payload": {"files": ["/p/a"]} if payload is None else payload})


@pytest.mark.parametrize(
    ("line", "kind", "message"),
    [
        (request(), None, None),
        (request("update_selection", payload={"selection_state": {"mode": "All Files"}}), None, None),
        (request("save_session", payload={"file_path": "/p/s.json"}), None, None),
        (request("dance"), "ValidationError", "Unknown action"),
        (request(session="invalid-session-id"), "ValidationError", "Invalid session ID format"),
        (request(payload={}), "ValidationError", "Missing payload field files"),
        (request("load_session", payload={}), "ValidationError", "Missing payload field file_path"),
        (request(payload={"files": ["a"]}), "ValidationError", "Invalid file path provided"),
        (request(payload={"files": ["/p/../q"]}), "ValidationError", "Invalid file path provided"),
        (request(payload={"files": ["/private/a"]}), "PermissionError", "Path outside allowed directories"),
        (request(payload={"files": ["/p/" + "x" * 500]}), "ValidationError", "Request is too large"),
        ("{oops", "ValidationError", "Malformed JSON request"),
    ],
)
def test_request_validation(spark, line, kind, message):
    parsed = parse_requests(spark.createDataFrame([(1, line)], "key int, value string"))
    valid, rejects = validate(parsed, ["/p"], max_bytes=400)
    if kind is None:
        assert (valid.count(), rejects.count()) == (1, 0)
    else:
        error = rejects.first().error
        assert (error.type, error.message) == (kind, message)


def test_missing_files_and_responses(spark):
    lines = [(1, request(payload={"files": ["/p/a", "/p/b"]})), (2, request())]
    parsed = parse_requests(spark.createDataFrame(lines, "key int, value string"))
    listing = spark.createDataFrame([("/p/a", False)], "path string, is_dir boolean")
    row = missing_files(parsed, "key", listing).collect()
    assert [(r.key, r.error.type) for r in row] == [(1, "FileNotFoundError")]
    assert row[0].error.details.toPython() == {"missing_files": ["/p/b"], "accessible_files": ["/p/a"]}
    flat = missing_files(parsed, "key", listing).select(
        F.lit("process_files").alias("action"),
        F.lit(UUID).alias("session_id"),
        F.col("error").withField("debug", F.lit("trace")).alias("error"),
    )
    plain = json.loads(flat.select(error_response("action", "session_id", "error")).first()[0])
    debug = json.loads(flat.select(error_response("action", "session_id", "error", debug=True)).first()[0])
    assert "debug" not in plain["error"] and debug["error"]["debug"] == "trace"
    assert plain["success"] is False
    good = flat.select(success_response("refresh", "session_id", F.struct(F.lit(1).alias("n")))).first()[0]
    assert json.loads(good) == {"action": "refresh", "session_id": UUID, "success": True, "payload": {"n": 1}}


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(request() + "\n" + request("dance") + "\n")
    stream = stream_requests(spark, str(tmp_path / "in"))
    valid, rejects = validate(stream)
    lines = rejects.select(F.col("request.action").alias("action"), F.col("request.session_id").alias("session_id"), "error")
    query = (
        lines.select(error_response("action", "session_id", "error").alias("value"))
        .writeStream.format("text")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "marks"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    answers = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [(a["action"], a["error"]["message"]) for a in answers] == [("dance", "Unknown action")]


def test_exports(spark, tmp_path):
    packs = spark.createDataFrame([("a", " \n\t"), ("b", "x")], "session_id string, output_text string")
    assert [r.session_id for r in exportable(packs).collect()] == ["b"]
    rows = [("s", f"/f{i:03}", f"block {i}\n\n") for i in range(50)]
    blocks = spark.createDataFrame(rows, "session_id string, path string, block string").repartition(5)
    export_blocks(blocks, str(tmp_path / "out"), ["path"])
    folder = tmp_path / "out" / "session_id=s"
    files = sorted(p for p in folder.iterdir() if p.name.startswith("part-"))
    assert b"".join(p.read_bytes() for p in files).decode() == "".join(r[2] for r in rows)


def test_export_check_gathers_no_session(spark, tmp_path, monkeypatch):
    """Digests over several files and pieces; the plan builds no array and no text of a session."""
    import hashlib

    from registry import QUERIES
    from sheaf.sources import export

    rows = [(f"s{i % 3}", f"/f{i:03}", f"blöck {i}\n\n" * (i % 5 * 40)) for i in range(60)]
    blocks = spark.createDataFrame(rows, "session_id string, path string, block string").repartition(5)
    export_blocks(blocks, str(tmp_path / "out"), ["path"])
    monkeypatch.setattr(export, "PIECE_BYTES", 101)
    want = {}
    for folder in (tmp_path / "out").glob("session_id=*"):
        joined = b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))
        want[folder.name[len("session_id="):]] = hashlib.sha256(joined).hexdigest()
    assert {r.session_id: r.joined for r in export.exported_digests(spark, str(tmp_path / "out")).collect()} == want
    cut = {}
    for r in export.exported_pieces(spark, str(tmp_path / "out"), piece_bytes=101).collect():
        cut[r.session_id, r.piece] = (r.size, r.digest)
    for folder in (tmp_path / "out").glob("session_id=*"):
        joined = b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))
        for i in range(0, len(joined), 101):
            assert cut.pop((folder.name[len("session_id="):], i // 101)) == (len(joined[i : i + 101]), hashlib.sha256(joined[i : i + 101]).hexdigest())
    assert not cut
    plan = QUERIES["s8_export_parts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "array_join" not in plan


def test_staleness_reads_only_files_whose_listing_differs(spark, tmp_path):
    from sheaf.operators.stale import current_hashes, stale_by_listing

    for i in range(6):
        (tmp_path / f"f{i}.txt").write_text(f"text {i}")
    first = list_directory(spark, str(tmp_path))
    kept = spark.createDataFrame(first.join(current_hashes(read_contents(first)), "path").selectExpr(
        "'s' AS session_id", "path", "current_hash AS hash", "length", "mtime").collect())
    (tmp_path / "f1.txt").write_text("other text")
    (tmp_path / "f2.txt").unlink()
    seen = []

    def read(listing):
        seen.extend(r.path for r in listing.collect())
        return read_contents(listing)

    found = stale_by_listing(kept, list_directory(spark, str(tmp_path)), read).collect()
    assert {(r.path.rsplit("/", 1)[1], r.status) for r in found} == {("f1.txt", "modified"), ("f2.txt", "missing")}
    assert [p.rsplit("/", 1)[1] for p in seen] == ["f1.txt"]


def test_one_folder_is_read_by_many_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"n{i}").write_bytes(b"x" * (i % 7))
    (tmp_path / "_bin").write_bytes(b"\x00" * 5000)
    files = read_contents(list_directory(spark, str(tmp_path)), text_only=True, max_bytes=4999)
    rows = files.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 401 and len({r.task for r in rows}) > 1
    by = {r.path.rsplit("/", 1)[1]: r for r in rows}
    assert by["n0"].content == b"" and by["_bin"].error is None and len(by["_bin"].content) == 1027
    whole = read_contents(list_directory(spark, str(tmp_path)), max_bytes=4999).where("path LIKE '%_bin'").first()
    assert (whole.content, whole.error) == (None, "too large")


def test_a_wide_level_stays_out_of_the_plan(spark, tmp_path):
    from sheaf.sources.listing import ListingReader

    for i in range(40):
        for j in range(30):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
    parts = ListingReader({"path": str(tmp_path)}).partitions()
    assert sum(len(p.paths) for p in parts) <= 600
    assert list_directory(spark, str(tmp_path)).count() == 40 + 40 * 30


def test_tree_needs_a_valid_pattern_and_a_folder(spark):
    from sheaf.operators.tree import drawable

    listing = spark.createDataFrame([("/p/a", True), ("/p/f", False)], "path string, is_dir boolean")
    bases = spark.createDataFrame([("/p/a",), ("/p/f",), ("/p",)], "base string")
    assert sorted(r.base for r in drawable(listing, bases, None).collect()) == ["/p", "/p/a"]
    assert drawable(listing, bases, "(").count() == 0
