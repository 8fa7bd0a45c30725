"""Secret scans against Python's regular expressions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from sheaf.llm.queries import QUERIES
from sheaf.llm.secrets import redacted, scan, train

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(spans)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def test_query_on_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_secret_scans"](spark, SF).collect()
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        want = brute(texts[r.doc_id])
        found += len(want)
        assert r.base_sha256 == digest(want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert set(filter(None, ",".join(f"{k}:{a}:{b}" for a, _, b, k in want).split(","))) <= set(r.spans.split(","))
    assert found


def test_odd_texts(spark):
    rng = random.Random(3)
    texts = [
        None, "", "x", 'TOKEN = "abcdef" Secret:short5 api_key=abcdefg APIKEY : \'qwerty12', "secret=token=abcdef", "AKIAAKIA" + "A1" * 9,
        "é日\U0001f600 password=hunter22 " + "0123456789abcdef" * 2, "\u0001\u0003 token:abcdefgh \u0001", "paſſword=abcdefg",
        " ".join(f"k{i} token={i:08d} " + "a" * (i % 40) for i in range(700)), "token=abcdef" * 3,
    ]
    texts += ["".join(rng.choice("tokensecret=: \"'aA1f\n") for _ in range(400)) for _ in range(30)]
    rows = [(i, t, 5, "c") for i, t in enumerate(texts + texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, other string")
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "other", "base_spans", "spans"}
    for i, text, _, _ in rows:
        assert [tuple(s) for s in got[i].base_spans] == brute(text), text
    assert scan(docs.limit(0)).count() == 0


def test_model_adds_random_strings_only(spark):
    rng = random.Random(1)
    secret = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    word = "chlichschlichheitschachverungen"
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    docs = spark.createDataFrame([(0, f"the {word} of {secret} and")], "doc_id long, text string")
    row = scan(docs, model).withColumn("clean", redacted(F.col("text"), "spans")).first()
    assert [s.kind for s in row.spans] == ["random"] and row.clean == f"the {word} of [SECRET] and"


def test_redaction_merges_overlaps(spark):
    docs = spark.createDataFrame([(0, 'é token = "' + "0a" * 20 + '" end'), (1, "none"), (2, None)], "doc_id long, text string")
    out = scan(docs).select(redacted(F.col("text"), "spans").alias("t")).collect()
    assert sorted([r.t for r in out], key=str) == sorted(['é [SECRET]" end', "none", None], key=str)


def test_random_parts_beside_a_rule(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz") for _ in range(n))
    left, right = some(24), some(23)
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    docs = spark.createDataFrame([(0, f"x {left}{'0a' * 15}{right} y"), (1, f"x {some(19)}{'0a' * 15}{some(19)} y")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in scan(docs, model).collect()}
    assert got == {0: [("random", 2, 26), ("hex", 26, 56), ("random", 56, 79)], 1: [("hex", 21, 51)]}
