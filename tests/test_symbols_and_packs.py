"""Symbol rules, the selection truth table and packs."""

import datetime as dt
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sheaf.functions import pysource
from sheaf.functions.pysource import scan_source
from sheaf.operators.symbols import import_names, imports, symbol_lists, symbols, with_source
from sheaf.plans.packs import PackOptions, pack_errors, process_files

SOURCE = '''
import os, sys as system
from . import sibling
from ..pkg.mod import thing as other

if True:
    def chosen(): pass
else:
    def chosen(): return 1
try:
    class Inside:
        def method(self): import hidden
except E:
    import late
with x:
    for y in z:
        def deep(): pass
async def waits():
    import inner_import
    def from_async(): pass
@deco
def decorated():
    def nested(): pass
class both: pass
def both(): pass
'''

LISTED = [
    ("function", "chosen"),
    ("function", "chosen"),
    ("class", "Inside"),
    ("function", "deep"),
    ("function", "from_async"),
    ("function", "decorated"),
    ("class", "both"),
    ("function", "both"),
]


def test_symbol_rules(spark):
    df = spark.createDataFrame([("/p/a.py", SOURCE), ("/p/b.md", SOURCE)], "path string, text string")
    parsed = with_source(df)
    rows = symbols(parsed, ["path"]).orderBy("ord").collect()
    assert [(r.kind, r.name) for r in rows] == LISTED
    assert {r.path for r in rows} == {"/p/a.py"}
    assert rows[5].code == "@deco\ndef decorated():\n\n    def nested():\n        pass"
    assert [r.stmt for r in imports(parsed, ["path"]).collect()] == [
        "from . import sibling",
        "from ..pkg.mod import thing as other",
        "import inner_import",
        "import late",
        "import os, sys as system",
    ]
    names = {r.alias: r.origin for r in import_names(parsed, ["path"]).collect()}
    assert names == {
        "os": "os",
        "system": "sys",
        "sibling": "..sibling",
        "other": "..pkg.mod.thing",
        "late": "late",
        "inner_import": "inner_import",
    }


def test_bad_sources_are_rows_not_failures(spark):
    texts = ["def :", "\ufeffx = 1", "a\x00b", "(" * 5000, ""]
    df = spark.createDataFrame([(f"/p/{i}.py", t) for i, t in enumerate(texts)], "path string, text string")
    errors = {r.path: r.e for r in with_source(df).select("path", F.col("source.error").alias("e")).collect()}
    assert errors["/p/0.py"] == "Syntax error in 0.py: line 1 - invalid syntax"
    assert errors["/p/1.py"].startswith("Syntax error in 1.py: line 1 - ")
    assert errors["/p/2.py"] and errors["/p/3.py"]
    assert errors["/p/4.py"] is None
    lists = symbol_lists(with_source(df), ["path"]).collect()
    assert [(r.path, r.classes, r.functions, r.imports) for r in lists] == [("/p/4.py", [], [], [])]


def test_only_wanted_code_is_unparsed():
    found = scan_source("a.py", "def a(): pass\ndef b(): pass\n", {"b"})["symbols"]
    assert [s["code"] for s in found] == [None, "def b():\n    pass"]


MTIME = dt.datetime(2024, 1, 2, 3, 4, tzinfo=dt.timezone.utc)
LABEL = "**Last modified: Jan 02, 2024 03:04 AM UTC**"
A_PY = "import os\n\n\ndef f():\n    return 1\n\n\nclass C:\n    pass\n"
FILES = [("/h/p/a.py", A_PY), ("/h/p/b.py", "def g():\n    return 2"), ("/h/p/bad.py", "def :"), ("/h/p/n.md", " # hi \n")]
FULL_A = f"# ~/p/a.py\n{LABEL}\n\n```python\n{A_PY.strip()}\n```"
FULL_B = f"# ~/p/b.py\n{LABEL}\n\n```python\ndef g():\n    return 2\n```"
FULL_N = f"# ~/p/n.md\n{LABEL}\n\n```markdown\n# hi\n```"
PART_A = (
    f"# Code from: ~/p/a.py\n{LABEL}\n\n# Imports (potentially includes more than needed):\nimport os\n\n"
    "# Selected Classes/Functions:\ndef f():\n    return 1\n\nclass C:\n    pass\n"
)
PART_B = f"# Code from: ~/p/b.py\n{LABEL}\n# Selected Classes/Functions:\ndef g():\n    return 2\n"


def run(spark, files, state=None, options=None, listing=None, bases=None):
    rows = [("s", p, t if isinstance(t, bytes | None) else t.encode(), MTIME) for p, t in files]
    df = spark.createDataFrame(rows, "session_id string, path string, content binary, mtime timestamp")
    roots = spark.createDataFrame([("s", "/h/p")], "session_id string, root string")
    chosen = spark.createDataFrame(
        [("s", *state)] if state else [],
        "session_id string, mode string, selected_file string, selected_items array<string>",
    )
    options = options or PackOptions(home="/h")
    return process_files(df, roots, chosen, options, listing, bases), (df, roots, chosen, options)


def text(packs):
    return "".join(r.output_text for r in sorted(packs.collect(), key=lambda r: r.part))


@pytest.mark.parametrize(
    ("mode", "file", "items", "want"),
    [
        ("All Files", None, [], f"{FULL_A}\n\n{FULL_B}\n\n{FULL_N}"),
        ("All Files", None, ["zzz"], f"{FULL_A}\n\n{FULL_B}\n\n{FULL_N}"),
        ("All Files", None, ["C", "f"], f"{PART_A}\n\n{FULL_B}\n\n{FULL_N}"),
        ("All Files", None, ["C", "f", "g"], f"{PART_A}\n\n{PART_B}\n\n{FULL_N}"),
        ("Single File", "/h/p/b.py", [], FULL_B),
        ("Single File", "/h/p/b.py", ["g", "f"], PART_B.strip()),
        ("Single File", "/h/p/b.py", ["f"], ""),
        ("Single File", "/h/p/n.md", ["f"], FULL_N),
        ("Single File", "/h/p/x.py", [], "# Error: Selected file x.py is not found."),
        ("Single File", None, [], f"{FULL_A}\n\n{FULL_B}\n\n{FULL_N}"),
    ],
)
def test_selection_truth_table(spark, mode, file, items, want):
    packs, _ = run(spark, FILES, (mode, file, items))
    assert text(packs) == want


def test_failed_files_are_reported_and_skipped(spark):
    packs, _ = run(spark, FILES)
    errors = [(r.path, r.error) for r in pack_errors(packs).collect()]
    assert errors == [
        ("/h/p/bad.py", "~/p/bad.py: Error processing - Syntax error in bad.py: line 1 - invalid syntax")
    ]


def test_binary_and_empty_sessions(spark):
    note = "# No text files selected or available to display content."
    assert text(run(spark, [("/h/p/x.bin", b"\x00")])[0]) == note
    assert text(run(spark, [])[0]) == ""
    assert text(run(spark, [("/h/p/x.md", b"\x00")], ("Single File", "/h/p/x.md", []))[0]) == (
        "# Error: Selected file x.md is not a text file."
    )
    assert text(run(spark, [("/h/p/dist/x.md", "ignored")])[0]) == ""
    assert text(run(spark, [("/h/p/x.bin", b"\x00"), ("/h/p/e.txt", "")])[0]) == f"# ~/p/e.txt\n{LABEL}\n\n```\n\n```"


@pytest.mark.parametrize("part_bytes", [1, 7, 40, 10_000])
def test_parts_join_to_the_whole(spark, part_bytes):
    many = [*FILES, ("/h/p/z.bin", b"\x00"), ("/h/p/zz.py", "def ("), *[(f"/h/p/m{i}.md", "x" * i) for i in range(9)]]
    whole, _ = run(spark, many)
    parts, _ = run(spark, many, options=PackOptions(home="/h", part_bytes=part_bytes))
    assert text(parts) == text(whole)
    if part_bytes == 1:
        assert parts.count() > 5


TREE_ROWS = [("/h/p", True), ("/h/p/sub", True), ("/h/p/sub/a.md", False), ("/h/p/B.md", False), ("/h/p/empty", True)]
TREE = "# Folder Tree of ~/p/\n\n```text\np/\n├── empty/\n├── sub/\n│   └── a.md\n└── B.md\n```\n"


@pytest.mark.parametrize("part_bytes", [30, 10_000])
def test_pack_with_tree(spark, part_bytes):
    listing = spark.createDataFrame([(p, d, None) for p, d in TREE_ROWS], "path string, is_dir boolean, error string")
    bases = spark.createDataFrame([("s", "/h/p")], "session_id string, base string")
    options = PackOptions(home="/h", include_tree=True, part_bytes=part_bytes)

    def packed(files, state=None):
        return text(run(spark, files, state, options, listing, bases)[0])

    assert packed([("/h/p/n.md", "hi")]) == f"{TREE}\n\n# ~/p/n.md\n{LABEL}\n\n```markdown\nhi\n```"
    assert packed([]) == TREE
    assert packed([("/h/p/bad.py", "def :")]) == TREE
    assert packed([("/h/p/x.bin", b"\x00")]) == (
        f"{TREE}\n\n# No text files selected or available to display content."
    )
    assert packed([("/h/p/n.md", "hi")], ("Single File", "/h/q", [])) == "# Error: Selected file q is not found."


def test_dates_for_machines(spark):
    packs, _ = run(spark, [("/h/p/n.md", "hi")], options=PackOptions(home="/h", machine_time=True))
    assert "**Last modified: 2024-01-02T03:04:00+00:00**" in text(packs)


def test_a_batch_of_sources_is_not_held_as_python_objects():
    sources = [f"import os{i % 3}\n" + "# a\n" * 2500 if i % 7 else None for i in range(3000)] + ["def :"]
    names = pa.array([f"{i}.py" for i in range(len(sources))])
    texts, wanted = pa.array(sources), pa.array([[]] * len(sources), pa.list_(pa.string()))
    tracemalloc.start()
    found = pysource._scan_batch(names, texts, wanted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6 < sum(map(len, filter(None, sources)))
    alone = [None if s is None else scan_source(n, s, set()) for n, s in zip(names.to_pylist(), sources)]
    assert found.to_pylist() == pa.array(alone, found.type).to_pylist()
    assert len(pysource._scan_batch(names[:0], texts[:0], wanted[:0])) == 0
