"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as contaminated
from test_near_dedup import brute as groups

from sheaf.llm.queries import QUERIES
from sheaf.llm.tables import written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of each stage, as its rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = written(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), done.collect(), done.columns)
        docs = done
    return out


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    before, after, columns = stages["quality_classifier"]
    scores = {r.doc_id: r.predicted for r in QUERIES["op7_quality"](spark, SF).collect()}
    assert columns == COLUMNS and after
    assert Counter(after) == Counter(r for r in before if scores[r.doc_id] == 1)


def test_one_document_of_each_group_stays(stages):
    before, after, columns = stages["minhash_near_dedup"]
    kept = {d for d, _, _, keep in groups([(r.doc_id, r.text) for r in before]) if keep}
    assert columns == COLUMNS and Counter(after) == Counter(r for r in before if r.doc_id in kept)


def test_contaminated_documents_go(spark, stages):
    before, after, columns = stages["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, n, hit, _ in contaminated([(r.doc_id, r.text) for r in before], items) if hit and 20 * hit >= n}
    assert columns == COLUMNS and Counter(after) == Counter(r for r in before if r.doc_id not in bad)


def test_secrets_are_masked_and_nothing_else_changes(spark, stages):
    before, after, columns = stages["secret_scans"]
    spans = {r.doc_id: r.spans for r in QUERIES["op5_secret_scans"](spark, SF).collect()}
    texts = {r.doc_id: r for r in before}
    assert columns == COLUMNS and len(after) == len(before)
    for r in after:
        old = texts[r.doc_id]
        changed = r.text != old.text
        assert changed == ("[SECRET]" in r.text) and r.n_chars == (len(r.text) if changed else old.n_chars)
        assert changed or not [s for s in spans[r.doc_id].split(",") if s and not s.startswith("random")]


def test_pieces_decode_exactly(spark, stages):
    before, after, columns = stages["sentencepiece_encoding"]
    assert columns == [*COLUMNS, "ids", "round_trip", "n_pieces"]
    assert len(after) == len(before) and all(r.round_trip and r.n_pieces == len(r.ids) for r in after)
    assert corpus_pipeline.run(spark, SF).select(*COLUMNS).count() == len(after)


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "de", "t", 11), (None, "a b c d e f g h i j", "en", "s", 19), (None, None, None, None, None), (5, "", "en", "s", 0), (6, "password=abcdef1234", "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        done = stage(spark, docs, SF)
        if name == "minhash_near_dedup":
            assert Counter(r.text for r in done.collect()) == Counter({"a b c d e f": 1, "a b c d e f g h i j": 1, None: 1, "": 1, "password=abcdef1234": 1})
        if name == "secret_scans":
            assert done.filter("doc_id = 6").select("text", F.col("n_chars")).first() == ("[SECRET]", 8)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).count() <= len(rows)


def test_columns_of_any_name_pass(spark):
    names = ["hex", "clean", "assign", "access", "candidates", "_key", "_id", "_row", "class", "band", "rest", "key", "words"]
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "password=abcdef1234 x"), (None, None)]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    tests = spark.createDataFrame([("t", "x")], "item_id string, text string")
    from sheaf.llm.decontaminate import without_contaminated
    from sheaf.llm.near_dedup import one_of_each
    from sheaf.llm.secrets import redact

    for made, ids in ((one_of_each(docs), {1, 3, None}), (without_contaminated(docs, tests), {1, 2, None}), (redact(docs), {1, 2, 3, None})):
        assert made.columns == docs.columns
        found = {r.doc_id: tuple(r)[2:] for r in made.collect()}
        assert found == {i: tuple(f"{n}{i}" for n in names) for i in ids}
