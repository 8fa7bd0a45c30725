"""MinHash near-dedup: HyperMinHash sketches, banded, estimated, then verified on full sets.

A document's set holds its distinct shingles of words (lower-cased A to Z).  One hash per shingle
picks a bucket; of the least hash in each bucket the sketch stores the number of leading zeros and
the next MANTISSA bits.  Empty buckets borrow the register of the first full
one in an order of their own over all buckets.  Bands of ROWS registers become keys; documents that share a key are candidates, whose Jaccard similarity is estimated
from equal registers, corrected for chance collisions, and then confirmed on the whole sets.

Documents of equal sets form one class, so copies cost nothing more.  Within a key, each class is
compared with the key's smallest class, in every input partition first and then over all, so a
hot key never sends more than one class per partition.  Where that leaves a key's classes in several components,
the full sets of those outside the largest meet those of all others, in blocks; only links leave a block.

Rules: a null or empty text has an empty set, linked with nothing.  A null ``doc_id`` counts as the largest, and as
equal to itself.  Rows with the same ``doc_id`` keep their own sets.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.blobs import pack, unpack
from sheaf.llm.common import parts_for, small_batches, whole_row
from sheaf.llm.tables import components, written
from sheaf.llm.words import Words, cut, grams, inside_text, mix, slices
from sheaf.operators.sizes import small_side

BANDS, ROWS = 40, 4
BUCKETS = BANDS * ROWS
MANTISSA = 10
VALUE_BITS = 40
SLACK = 0.2  # six standard deviations of the estimate from BUCKETS registers
BLOCK = 512

_LAST = 2**63 - 1  # stands for a null doc_id

# every register's own order of all buckets: an empty one takes the first full bucket of its order
_PROBE = np.argsort(mix(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64)).reshape(BUCKETS, BUCKETS), axis=0)
_RANK = np.argsort(_PROBE, axis=0).astype(np.uint8)  # [bucket, register] → place of the bucket in the register's order
_PROBES = 48  # places tried one by one; what is empty after them takes the least place of the text's full buckets


def _distinct_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of the distinct shingles of each text."""
    hashes = words.hashes()
    value = grams(hashes, k)
    held = inside_text(words.first, k)
    text = words.text_of()
    values, owners = [value[held]], [text[: len(value)][held]]
    for n in range(1, k):  # short texts: the whole sequence is one shingle
        short = np.flatnonzero(words.counts == n)
        if len(short):
            at = words.first[short]
            own = np.zeros(len(short), np.uint64)
            for j in range(n):
                own = mix(own + hashes[at + j] + np.uint64(n))
            values.append(own)
            owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    _, first = np.unique(value ^ mix(owner.astype(np.uint64) + np.uint64(7)), return_index=True)
    return owner[first], value[first]


def _registers(n_texts: int, owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One row of BUCKETS registers for each text; rows of texts without shingles hold zeros."""
    spread = mix(value + np.uint64(0xA5A5A5A5))
    bucket = ((spread >> np.uint64(VALUE_BITS)) * np.uint64(BUCKETS)) >> np.uint64(24)
    low = spread & np.uint64((1 << VALUE_BITS) - 1)
    least = np.full(n_texts * BUCKETS, np.uint64(1 << VALUE_BITS), dtype=np.uint64)
    slot = owner.astype(np.int64) * BUCKETS + bucket.astype(np.int64)
    order = np.argsort(low, kind="stable")[::-1]
    least[slot[order]] = low[order]  # the last write, the smallest, stays
    least = least.reshape(n_texts, BUCKETS)
    full = least < np.uint64(1 << VALUE_BITS)
    some = full.any(axis=1)
    out = least.copy()
    gap = ~full & some[:, None]
    for probe in _PROBE[:_PROBES]:
        if not gap.any():
            break
        row, column = np.nonzero(gap)
        source = probe[column]
        hit = full[row, source]
        out[row[hit], column[hit]] = least[row[hit], source[hit]]
        gap[row[hit], column[hit]] = False
    late = np.flatnonzero(gap.any(axis=1))
    if len(late):
        held, bucket = np.nonzero(full[late])
        rank = np.minimum.reduceat(_RANK[bucket], np.searchsorted(held, np.arange(len(late))), axis=0)
        source = _PROBE[rank, np.arange(BUCKETS)]
        out[late] = np.where(gap[late], least[late[:, None], source], out[late])
    out[~some] = 0
    bits = np.frexp(out.astype(np.float64))[1]  # number of significant bits, exact below 2**53
    zeros = VALUE_BITS - bits
    shift = bits - 1 - MANTISSA
    mantissa = np.where(shift >= 0, out >> np.maximum(shift, 0).astype(np.uint64), out << np.maximum(-shift, 0).astype(np.uint64))
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (mantissa & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def _sketch(k: int):
    names = ["doc_id", "key", "n_shingles", "class", "registers"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = cut(part.column("text"), lower=True)
                owner, value = _distinct_shingles(words, k)
                count = np.bincount(owner, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.uint64)
                np.add.at(total, owner, mix(value + np.uint64(99)))
                name = mix(total + count.astype(np.uint64)).view(np.int64)
                registers = _registers(part.num_rows, owner, value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(count.astype(np.int64)), pa.array(name),
                     pa.array([r.tobytes() for r in registers], pa.binary())], names=names)

    return run


def _sets(k: int):
    """Texts of classes → their sets."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                owner, value = _distinct_shingles(cut(part.column("text"), lower=True), k)
                order = np.argsort(owner, kind="stable")
                at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=part.num_rows))))
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("class"), sets], names=["class", "shingles"])

    return run


def _band_keys(registers: np.ndarray) -> np.ndarray:
    """Registers [n, BUCKETS] → keys [n, BANDS]."""
    wide = registers.astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(65537) + wide[:, :, j])
    return key


def _stars(key: np.ndarray, member: np.ndarray):
    """Sorted by key and member: (order, each entry's smallest fellow, whether it is the smallest)."""
    order = np.lexsort((member, key))
    k, m = key[order], member[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    return order, m[np.flatnonzero(new)][np.cumsum(new) - 1], new


def _send_bands(parts: int):
    """Classes → keys: pairs of classes that meet here, and one class per key for its bucket."""
    schema = pa.schema([("to", pa.int64()), ("pairs", pa.bool_()), ("blob", pa.binary())])

    def run(batches):
        place = TaskContext.get().partitionId()
        for batch in batches:
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            key = _band_keys(registers).ravel()
            member = np.repeat(batch.column("class").to_numpy(), BANDS)
            order, least, new = _stars(key, member)
            key, member = key[order], member[order]
            rows = []
            if not new.all():
                rows.append((place % parts, True, pack(key[~new], member[~new], least[~new])))
            key, member = key[new], member[new]
            edges = np.searchsorted((key >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24), np.arange(parts + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edges)):
                rows.append((int(b), False, pack(key[edges[b] : edges[b + 1]], member[edges[b] : edges[b + 1]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _meet():
    """In a bucket of keys: each class with the key's smallest class."""

    def run(_, table):
        made, keys, members = [], [], []
        for pairs, blob in zip(table.column("pairs").to_pylist(), table.column("blob").to_pylist()):
            arrays = unpack(blob)
            if pairs:
                made.append(arrays)
            else:
                keys.append(arrays[0])
                members.append(arrays[1])
        if keys:
            key, member = np.concatenate(keys), np.concatenate(members)
            order, least, _ = _stars(key, member)
            key, member = key[order], member[order]
            apart = member != least
            made.append((key[apart], member[apart], least[apart]))
        columns = [np.concatenate(c) for c in zip(*made)] if made else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 2
        return pa.table([pa.array(c.view(np.int64)) for c in columns], names=["band", "a", "b"])

    return run


def _chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that the registers of unrelated sets of these sizes agree."""
    zeros = np.arange(VALUE_BITS)[None, :]
    level = lambda n: (1 - 2.0 ** -(zeros + 1)) ** n[:, None] - (1 - 2.0**-zeros) ** n[:, None]
    each = lambda n: np.maximum(n / BUCKETS, 1.0)
    return np.abs(level(each(n_a)) * level(each(n_b))).sum(axis=1) / 2**MANTISSA


def _estimates(a: np.ndarray, b: np.ndarray, n_a, n_b) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    chance = _chance(n_a, n_b)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _estimate_pairs(threshold: float):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("reg_a", "reg_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            likely = (_estimates(a, b, n_a, n_b) >= threshold - SLACK) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b))
            yield batch.select(["a", "b"]).filter(pa.array(likely))

    return run


def _cross(percent: int):
    """One block of a group: full sets of classes outside its largest component against those of other components."""

    def run(table):
        names = ["class", "label", "outside", "as_row", "as_column"]
        name, label, outside, row, column = (table.column(c).to_numpy() for c in names)
        sets = table.column("shingles").combine_chunks()
        at = sets.offsets.to_numpy().astype(np.int64)
        size = np.diff(at)
        _, value = np.unique(sets.values.to_numpy(), return_inverse=True)
        value = value[at[0] :] if at[0] else value
        at = at - at[0]
        others = np.flatnonzero(column)
        flat = np.concatenate([value[at[j] : at[j + 1]] for j in others]) if len(others) else value[:0]
        edges = np.concatenate(([0], np.cumsum(size[others])))
        mark = np.zeros(len(value) + 1, dtype=np.int64)
        found = []
        for i in np.flatnonzero(row):
            own = value[at[i] : at[i + 1]]
            mark[own] = 1
            common = np.diff(np.concatenate(([0], np.cumsum(mark[flat])))[edges])
            mark[own] = 0
            linked = 100 * common >= percent * (size[i] + size[others] - common)
            linked &= (label[others] != label[i]) & (~outside[others] | (name[others] > name[i]))
            found.append((np.full(linked.sum(), name[i]), name[others[linked]]))
        a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return run


def _full_sets(met: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The sets of all classes that met another one, once each."""
    asked = met.select(F.col("a").alias("class")).union(met.select("b")).distinct()
    asked = classes.join(asked, "class").select("class", "doc_id", "key")
    texts = docs.join(asked, docs.doc_id.eqNullSafe(asked.doc_id) & (docs.key == asked.key)).select("class", "text")
    return written(texts.dropDuplicates(["class"]).mapInArrow(_sets(k), "class long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("shingles").alias(f"set_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    met = met.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return written(met.filter(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b"), "links")


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).withColumnRenamed("node", "class")
    return classes.select("class", "doc_id", "key").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _stragglers(met: DataFrame, labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes that share a key and still stand in different components.

    Keys with the same smallest class form one group, so that a class comes into few groups.
    """
    name = labelled.select("class", "label")
    side = lambda c: name.select(F.col("class").alias(c), F.col("label").alias(f"label_{c}"))
    tops = met.groupBy("band").agg(F.min("b").alias("top"))
    rows = met.join(side("a"), "a").join(side("b"), "b")
    split = rows.filter("label_a != label_b").select("band").distinct()
    rows = rows.join(split, "band").join(tops, "band")
    own = rows.select("top", F.col("a").alias("class"), F.col("label_a").alias("label")).union(rows.select("top", "b", "label_b")).distinct()
    own = written(own, "members")
    sizes = own.groupBy("top", "label").count()
    largest = sizes.groupBy("top").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = own.join(small_side(largest), "top").withColumn("outside", F.col("label") != F.col("main")).withColumn("blocks", blocks)
    own = own.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    rows = own.filter("outside").select("top", "class", "label", "outside", F.col("block").alias("i"), every.alias("j"), F.lit(True).alias("as_row"), F.lit(False).alias("as_column"))
    columns = own.select("top", "class", "label", "outside", every.alias("i"), F.col("block").alias("j"), F.lit(False).alias("as_row"), F.lit(True).alias("as_column"))
    spread = rows.unionByName(columns).join(sets, "class")
    return spread.groupBy("top", "i", "j").applyInArrow(_cross(percent), "a long, b long")


def _groups(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sketches: one row per document, labelled: one row per class with its component)."""
    spark, threshold = docs.sparkSession, percent / 100
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))
    sketches = written(docs.mapInArrow(_sketch(shingle), "doc_id long, key long, n_shingles long, class long, registers binary"), "sketches")
    filled = sketches.filter("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = filled.groupBy("class").agg(F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = written(classes.select("class", "first.doc_id", "first.key", "n_shingles", "registers"), "classes")
    parts = parts_for(spark, classes.count() * BANDS * 16, 16 << 20)
    met = classes.select("class", "registers").mapInArrow(_send_bands(parts), "to long, pairs boolean, blob binary")
    met = written(met.groupBy("to").applyInArrow(_meet(), "band long, a long, b long"), "met")
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"reg_{c}"))
    pairs = met.select("a", "b").distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimate_pairs(threshold), "a long, b long")
    sets = _full_sets(met, classes, docs, shingle)
    links = _confirmed(pairs, sets, percent)
    labelled = written(_labelled(classes, links), "labelled")
    more = written(_stragglers(met, labelled, sets, percent), "links")
    if not more.isEmpty():
        # components of components: links between the labels found so far
        side = lambda c: labelled.select(F.col("class").alias(c), F.col("label").alias(f"label_{c}"))
        joined = more.join(side("a"), "a").join(side("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        top = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
        labelled = labelled.join(top, "label", "left").withColumn("label", F.coalesce("top", "label")).drop("top")
    return sketches, labelled


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    ``percent``: documents are linked where 100 * intersection >= percent * union.
    """
    sketches, labelled = _groups(docs, shingle, percent)
    heads = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("head"))
    named = labelled.join(heads, "label").select("class", F.col("head").alias("head"))
    out = sketches.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    linked = (F.col("n_shingles") > 0) & F.col("head").isNotNull()
    out = out.select("doc_id", "n_shingles", F.when(linked, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` (whole) of which one stays for each group: that of the smallest id, then text hash.

    Of equal rows one stays, whatever their other columns; rows without words all stay.
    """
    _, labelled = _groups(docs.select("doc_id", "text"), shingle, percent)
    none = F.col("doc_id").isNull()
    heads = labelled.groupBy("label").agg(F.min(F.struct(none.alias("none"), "doc_id", "key")).alias("head"))
    heads = heads.select(F.coalesce("head.doc_id", F.lit(_LAST)).alias("_id"), F.col("head.key").alias("_key"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id")
    keyed = docs.filter(worded).select(whole_row(docs), ident, F.xxhash64("text").alias("_key"))
    stay = keyed.join(heads, ["_id", "_key"]).dropDuplicates(["_id", "_key"]).select("rest.*")
    return stay.unionByName(docs.filter(~worded))
