"""Column functions on hand-made edge cases."""

import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from sheaf.functions.paths import ancestors, basename, common_path, display_path, language, parent, suffix
from sheaf.functions.patterns import (
    display_pattern,
    effective_pattern,
    first_non_blank,
    ignored,
    is_valid_pattern,
    matches_any_extension,
    native_form,
    normalize_pattern,
    python_pattern,
)
from sheaf.functions.text import content_hash, decode_text, is_text, non_blank_lines, strip
from sheaf.functions.times import iso_timestamp, modified_line
from sheaf.operators.filters import drop_hidden, drop_ignored, drop_ignored_by_session, in_group
from sheaf.operators.tree import prune_ignored


def values(df):
    return [r[0] for r in df.collect()]


def over(spark, items, expression, dtype="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {dtype}")
    return [r[1] for r in sorted(df.select("i", expression(F.col("x"))).collect())]


def test_text_check(spark):
    cases = [
        (b"", True),
        (b"a" * 1023 + b"\x00", False),
        (b"a" * 1024 + b"\x00", True),
        (b"a" * 1023 + "é".encode(), True),
        (b"a" * 1021 + "\U0010ffff".encode() + b"\xff", True),
        (b"a" * 1023 + b"\xff\xff", False),
        (b"a" * 1023 + b"\xc3", False),
        (b"a" * 1022 + "é".encode() + b"more", True),
        (b"\xed\xa0\x80", False),
        (b"\xc0\xaf", False),
        ("\U0010ffff".encode(), True),
        (b"a" * 1024 + b"\xe9", True),
        (None, False),
    ]
    got = over(spark, [c for c, _ in cases], is_text, "binary")
    assert got == [want for _, want in cases]
    strict = over(spark, [b"a" * 1023 + "é".encode(), b"a" * 1022 + "é".encode()], lambda c: is_text(c, True), "binary")
    assert strict == [False, True]


def test_decode(spark):
    cases = [
        (b"x" * 1500 + b"\xe9", "x" * 1500 + "é"),
        (b"a\r\nb\rc\n", "a\nb\nc\n"),
        ("\ufeffx".encode(), "\ufeffx"),
        ("naïve ✓".encode(), "naïve ✓"),
        (b"", ""),
    ]
    assert over(spark, [c for c, _ in cases], decode_text, "binary") == [w for _, w in cases]


def test_strip_and_line_count_follow_python(spark):
    texts = [
        "",
        "  \n\t\n",
        "a\n\nb\n",
        "\u00a0a\u2003\n\x1c b \x85c\u2028\u2029d",
        "a\x0bb\x0cc\x1cd\x1de\x1ef\x1fg",
        "x\r\ny\rz",
        "\u3000\u1680\n q \u205f",
        "typo\u2019s \u2026 \n\u2014\n",
    ]
    assert over(spark, texts, strip) == [t.strip() for t in texts]
    assert over(spark, texts, non_blank_lines) == [sum(1 for line in t.splitlines() if line.strip()) for t in texts]


def test_names_and_languages(spark):
    paths = ["/a/x.py", "/a/b.tar.gz", "/a/Dockerfile", "/a/x.dockerfile", "/a/foo.", "/.bashrc", "/a/X.PY", "/a/t.txt"]
    assert over(spark, paths, basename) == [p.rsplit("/", 1)[1] for p in paths]
    assert over(spark, paths, suffix) == [".py", ".gz", "", ".dockerfile", "", "", ".py", ".txt"]
    assert over(spark, paths, language) == ["python", "", "", "dockerfile", "", "", "python", ""]
    assert over(spark, ["/a", "/a/b", "/a/b/c"], parent) == ["/", "/a", "/a/b"]
    assert over(spark, ["/a/b", "/"], ancestors) == [["/", "/a", "/a/b"], ["/"]]


@pytest.mark.parametrize(
    ("path", "root", "plain", "short"),
    [
        ("/srv/x/y.py", None, "/srv/x/y.py", "/srv/x/y.py"),
        ("/home/user2/y.py", None, "/home/user2/y.py", "/home/user2/y.py"),
        ("/home/u/y.py", None, "~/y.py", "~/y.py"),
        ("/home/u", None, "~/.", "~/."),
        ("/home/u/a/b/c/d/e", None, "~/a/b/c/d/e", "~/a/b/c/d/e"),
        ("/home/u/a/b/c/d/e/f", None, "~/a/b/c/d/e/f", "~/a/b/…/e/f"),
        ("/home/u/a/b/x/y.py", "/home/u/a/b", "~/a/b/x/y.py", "~/a/b/x/y.py"),
        ("/home/u/a/b/c/x/y.py", "/home/u/a/b/c", "~/a/b/c/x/y.py", "~/a/…/c/x/y.py"),
        ("/home/u/a/b/c/d/y.py", "/home/u/a/b/c/d", "~/a/b/c/d/y.py", "~/a/…/d/y.py"),
        ("/home/u/a/b", "/home/u/a/b", "~/a/b/", "~/a/b/"),
        ("/home/u/y.py", "/home/u", "~//y.py", "~//y.py"),
        ("/home/u/a/bc/y.py", "/home/u/a/b", "~/a/bc/y.py", "~/a/bc/y.py"),
        ("/home/u/a/y.py", "/srv", "~/a/y.py", "~/a/y.py"),
    ],
)
def test_display_path(spark, path, root, plain, short):
    df = spark.createDataFrame([(path, root)], "path string, root string")
    row = df.select(
        display_path("path", "root", "/home/u"), display_path("path", "root", "/home/u", show_ellipsis=True)
    ).first()
    assert tuple(row) == (plain, short)


@pytest.mark.parametrize(
    ("paths", "want"),
    [
        (["/a/b/c.py"], "/a/b/c.py"),
        (["/a/b", "/a/bc"], "/a"),
        (["/a/b", "/a/b-x", "/a/b/c"], "/a"),
        (["/a/b/c", "/a/b/d", "/a/b/e/f"], "/a/b"),
        (["/a", "/b"], "/"),
        (["/a/b/c", "/a/b"], "/a/b"),
    ],
)
def test_common_path(spark, paths, want):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert df.agg(common_path("path")).first()[0] == want


def test_common_path_of_nothing(spark):
    assert spark.createDataFrame([], "path string").agg(common_path("path")).first()[0] is None


def test_patterns(spark):
    assert over(spark, [" a \n\n b|c \r\n"], normalize_pattern) == ["a|b|c"]
    assert over(spark, ["a|(b|c)"], display_pattern) == ["a\n(b\nc)"]
    assert effective_pattern(spark, "(") is None
    assert effective_pattern(spark, None) == effective_pattern(spark, "  \n ")
    assert effective_pattern(spark, r"(?P<n>x)") == "(?:x)"
    assert matches_any_extension(python_pattern(None))
    assert not matches_any_extension("tmp$")
    df = spark.createDataFrame([("", " ", " c ", "d")], "a string, b string, c string, d string")
    assert df.select(first_non_blank("a", "b", "c", "d")).first()[0] == "c"


def test_default_ignore_is_unanchored(spark):
    paths = ["/p/digit.py", "/p/distance.py", "/p/legit/a.py", "/p/ok.py", "/p/__init__.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert values(drop_ignored(df)) == ["/p/ok.py"]
    assert len(values(drop_ignored(df, "["))) == 5
    assert values(drop_ignored(df, "digit\nlegit\nok")) == ["/p/distance.py", "/p/__init__.py"]


def test_hidden_and_groups(spark):
    df = spark.createDataFrame([("/h/.x/base/a.ts",), ("/h/.x/base/.b.tsx",), ("/h/.x/base/.c/d.md",)], "path string")
    assert values(drop_hidden(df, "/h/.x/base")) == ["/h/.x/base/a.ts"]
    assert df.where(in_group("TypeScript")).count() == 2
    assert df.where(in_group("All")).count() == 3


def test_times(spark):
    stamps = [datetime(2025, 7, 5, 14, 5, tzinfo=timezone.utc), datetime(2025, 7, 5, 2, 0, 1, 20, tzinfo=timezone.utc), None]
    assert over(spark, stamps[:2], iso_timestamp, "timestamp") == [s.isoformat() for s in stamps[:2]]
    shown = over(spark, stamps, modified_line, "timestamp")
    assert shown == [
        "**Last modified: Jul 05, 2025 02:05 PM UTC**",
        "**Last modified: Jul 05, 2025 02:00 AM UTC**",
        "**Last modified: ?**",
    ]


def test_hash_marks(spark):
    df = spark.createDataFrame(
        [(b"x", "ok"), (None, "missing"), (None, "error"), (b"", None)], "content binary, status string"
    )
    got = values(df.select(content_hash("content", "status")))
    assert got[1:3] == ["FILE_MISSING", "HASH_ERROR"]
    assert got[3] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@pytest.mark.parametrize(
    "pattern",
    [
        r"(?P<my_name>tmp|a)(?P=my_name)", r"a\Z", r"foo{bar}|tmp", r"x{2,3}", r"x{,2}y", r"x{2", r"[[a]b", r"[]x]", r"[^]x]+$", r"[a&&b]",
        r"^\w+$", r"\bé", r"(?i)É", r"\d", r"\s", r"a.c", r"a$", r"\.git|\[x\]", r"}", r"[\w-]+é",
    ],
)
def test_python_patterns_keep_their_meaning(spark, pattern):
    got = over(spark, TEXTS, lambda c: ignored(spark, c, pattern))
    assert got == [re.search(pattern, t) is not None for t in TEXTS]


TEXTS = [
    "tmptmp", "aa", "foo{bar}", "xx", "xxy", "y", "x{2", "[", "b", "]", "x", "ab", "&", "é", "naïve", "É", "٣", "\u00a0", "a\rc", "a\nc", "a", "a\n",
    "b a", "{}", ".git", "[x]", "abé", "a{", "", "a\nb", "a\vb", "a\x1cb", "e\u0301", "x²", "foo", "foo\u0301", "fooa", "a\u2028b", "a\x85", "\U0001f600", "A", "bc",
]


@pytest.mark.parametrize(
    "pattern",
    [
        r"a\vb", r"^e\w$", r"^x\w$", r"a\sb", r"\bfoo\b", r"a\Sb", r"[\s]$", r"[^\sa]", r"(?s)a.b", r"a.b$", r"(?m)^b", r"(?x) a  b", r"\101", r"(a)?(?(1)b|c)", r"(?a)\w",
        r"(?>a)b", r"a++", r"(?<=a)b", r"(?<!a)b", r"(?!a)", r"(a|b)c|(aa)", r"(?:ab|a)+?$", "\U0001f600", r"[\U0001f5ff-\U0001f610]", r"(a)\1", r"[a-c&&b]",
    ],
)
def test_engines_agree_or_python_decides(spark, pattern):
    test_python_patterns_keep_their_meaning(spark, pattern)


def test_which_engine(spark):
    for pattern in (r"\d", r"\w", r"\bx", "(?i)x", r"(a)\1", r"(a)?(?(1)b|c)", "(?m)^x", "(?>a)"):
        assert native_form(pattern) is None
        with pytest.raises(ValueError):
            effective_pattern(spark, pattern)
    for pattern in (r"\s", "a.c", "^x$", r"\.git|\[x\]", "(?s).", r"(?<=a)[^b-d]{2,}?"):
        assert is_valid_pattern(spark, native_form(pattern))
    assert effective_pattern(spark, r"\p{L}") is None  # Python refuses it: nothing is ignored


def test_patterns_by_session(spark):
    settings = [("default", None), ("blank", " "), ("invalid", "("), ("own", "legit\n[.]json$"), ("digits", r"doc_\d+1[.]"), ("none", "zzz")]
    paths = ["/c/legit/doc_1.json", "/c/doc_11.md", "/c/digit.py", "/c/doc_٣1.md", None]
    files = spark.createDataFrame([(s, p, 1) for s, _ in [*settings, ("absent", None)] for p in paths], "session_id string, path string, known int")
    chosen = spark.createDataFrame(settings, "session_id string, ignore string")
    want = set()
    for session, raw in [*settings, ("absent", None)]:
        joined = python_pattern(raw)
        want |= {(session, p, 1) for p in paths if p is None or joined is None or not re.search(joined, p)}
    assert {tuple(r) for r in drop_ignored_by_session(files, chosen).collect()} == want
    many = spark.createDataFrame([(f"s{i}", f"a{i}$") for i in range(40)] + [("digits", r"a\d")], "session_id string, ignore string")
    files = spark.createDataFrame([(f"s{i}", f"a{j}") for i in range(40) for j in (i, i + 1)] + [("digits", "a1"), ("digits", "a")], "session_id string, path string")
    assert sorted(map(tuple, drop_ignored_by_session(files, many).collect())) == sorted([(f"s{i}", f"a{i + 1}") for i in range(40)] + [("digits", "a")])


def test_trees_prune_by_either_engine(spark):
    nodes = spark.createDataFrame([("/b", n) for n in ("/b/x1", "/b/x1/y", "/b/q", "/b/q/x")], "base string, node string")
    assert values(prune_ignored(nodes, r"x\d$").select("node")) == ["/b/q", "/b/q/x"]
    assert values(prune_ignored(nodes, r"x1$").select("node")) == ["/b/q", "/b/q/x"]
