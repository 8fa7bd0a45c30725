"""Quality classifier by compression: dictionaries of good and bad text, and the difference they make.

A zstandard dictionary is built from good labelled texts and one from bad ones.  Each whole text is compressed with
either and with none; the normalised differences of the sizes (logarithms of their ratios) become a score by
logistic regression on other labelled texts.  At most ROWS labelled rows of each label are used, half for the
dictionaries and half for the calibration; the model is bounded by DICTIONARY bytes each.

Rules: a null or empty text has its constant score like any other text.  If rows of one label are missing, every score is
the share of label 1 among the labelled rows, 0.5 without any.  Repeated rows get equal scores.  Result columns replace
columns of the same name; others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import small_batches
from sheaf.llm.learning import apply_logistic, fit_logistic, label_counts, labelled_sample
from sheaf.llm.words import slices

ROWS = 4000
DICTIONARY = 112 << 10
LEVEL = 3


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return b"".join(texts)[:size]


class _Sizes:
    """Compressed sizes of texts under each dictionary and none."""

    def __init__(self, dictionaries: list[bytes]):
        import zstandard

        made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in dictionaries]
        self.compressors = [*made, zstandard.ZstdCompressor(level=LEVEL)]

    def features(self, texts: list[bytes]) -> np.ndarray:
        rows = [[*(len(c.compress(t)) for c in self.compressors), len(t)] for t in texts]
        bad, good, plain, size = np.log(np.array(rows, dtype=float).reshape(-1, 4) + 8).T
        return np.stack([bad - good, plain - good, plain - bad, size - plain, (size - plain) ** 2, size], axis=1)


def train(docs: DataFrame, labels: DataFrame, ids: Column, rows: int = ROWS) -> dict:
    """The dictionaries and the calibration, from a bounded sample."""
    sample = labelled_sample(docs, labels, "quality", rows, ids).orderBy("doc_id").collect()
    y = np.array([r.y for r in sample], dtype=float)
    parts = [[r.text.encode() for r in sample if r.y == label and r.part == 0] for label in (0, 1)]
    fitted = [r for r in sample if r.part == 1]
    if not all(parts) or len({r.y for r in fitted}) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    dictionaries = [_dictionary(p, DICTIONARY) for p in parts]
    x = _Sizes(dictionaries).features([r.text.encode() for r in fitted])
    return {"dictionaries": dictionaries, "logistic": fit_logistic(x, np.array([r.y for r in fitted], dtype=float), label_counts(labels, "quality", ids))}


def _score(model, names: list[str]):
    def run(batches):
        sizes = _Sizes(model.value["dictionaries"]) if "dictionaries" in model.value else None
        for batch in batches:
            for part in slices(batch):
                if sizes is None:
                    scores = np.full(part.num_rows, model.value["constant"])
                else:
                    texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                    scores = apply_logistic(model.value["logistic"], sizes.features(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores)], names=[*names, "score"])

    return run


def score_quality(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows with score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double"
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    out = docs.mapInArrow(_score(shared, names), schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
