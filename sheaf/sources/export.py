"""Markdown export of packs."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import strip
from sheaf.operators.ordered import Ordered
from sheaf.operators.sizes import small_side
from sheaf.session import freeze


def exportable(packs: DataFrame, text: str = "output_text") -> DataFrame:
    """Packs that are not blank."""
    return packs.where(strip(text) != "")


def _line(text: str):
    """The text without the final line feed that the sink adds itself."""
    return F.regexp_replace(text, r"\n\z", "").alias("value")


def export_packs(packs: DataFrame, path: str, stamp, text: str = "output_text") -> None:
    """Write packs as UTF-8 text below session_id=…/stamp=…/part=….

    ``stamp`` is a timestamp column; the folder carries it as yyyyMMdd_HHmmss.  The text sink
    ends every record with a line feed, so a file ends in one even where its pack does not.
    """
    stamp = F.col(stamp) if isinstance(stamp, str) else stamp
    named = exportable(packs, text).select(
        "session_id", F.date_format(stamp, "yyyyMMdd_HHmmss").alias("stamp"), "part", _line(text)
    )
    named.hint("rebalance", "session_id", "part").write.mode("append").partitionBy("session_id", "stamp", "part").text(path)


def export_blocks(blocks: DataFrame, path: str, order: list[str], text: str = "block") -> None:
    """Write a session too big for packs straight from its blocks, range-partitioned in order.

    Within a session's folder, files in name order hold its blocks in order; no session is
    gathered in one task.
    """
    ranged = blocks.where(F.col(text).isNotNull()).repartitionByRange("session_id", *order)
    ranged.sortWithinPartitions("session_id", *order).select("session_id", _line(text)).write.mode(
        "append"
    ).partitionBy("session_id").text(path)


PIECE_BYTES = 64 << 10  # of a file in one row; an Arrow batch holds 10,000 rows


def _digests(batches):
    """Pieces sorted by session and place → the sessions' SHA-256; holds one batch and one hash."""
    session, digest = None, None
    for batch in batches:
        kind = batch.schema.field("session_id").type
        done = []
        for name, piece in zip(batch.column("session_id").to_pylist(), batch.column("piece")):
            if digest is None or name != session:
                if digest is not None:
                    done.append((session, digest.hexdigest()))
                session, digest = name, hashlib.sha256()
            digest.update(piece.as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done])], names=["session_id", "joined"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([session], kind), pa.array([digest.hexdigest()])], names=["session_id", "joined"])


def exported_digests(spark: SparkSession, path: str) -> DataFrame:
    """session_id, joined: the SHA-256 of each session's exported files, one after the other in name order.

    The hash of a whole text is serial, so a session's bytes pass through one task, in small pieces from a sort
    that can spill; no row and no task holds more than some pieces of a session.
    """
    files = spark.read.format("binaryFile").load(path).withColumn("file", F.col("_metadata.file_name"))
    starts = F.explode(F.sequence(F.lit(0), F.col("length"), F.lit(PIECE_BYTES))).alias("at")
    pieces = files.select("session_id", "file", "content", starts).withColumn("piece", F.expr(f"substring(content, CAST(at AS INT) + 1, {PIECE_BYTES})"))
    ordered = pieces.select("session_id", "file", "at", "piece").repartition("session_id").sortWithinPartitions("session_id", "file", "at")
    kind = files.schema["session_id"].dataType.simpleString()
    return ordered.select("session_id", "piece").mapInArrow(_digests, f"session_id {kind}, joined string")


def exported_pieces(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """session_id, piece, size, digest: the SHA-256 of each piece of ``piece_bytes`` of a session's exported files, one after the other in name order.

    Two exports are equal if and only if their pieces are, and the first piece that differs says where.  Where a file begins follows from the lengths of the files before
    it, so every file is cut in its own task, and a hot session's pieces are hashed in all tasks; no task holds more of a session than one file.
    """
    files = spark.read.format("binaryFile").load(path).withColumn("file", F.col("_metadata.file_name"))
    narrow = freeze(files.select("session_id", "file", "length"))
    starts = Ordered(narrow, ["session_id"], ["file"]).prefix_sums(start=F.col("length")).to_df().select("session_id", "file", "start")
    placed = files.where("length > 0").join(small_side(freeze(starts)), ["session_id", "file"])
    first, last = f"start div {piece_bytes}", f"(start + length - 1) div {piece_bytes}"
    cut = placed.select("session_id", "start", "content", F.explode(F.expr(f"sequence({first}, {last})")).alias("piece"))
    begin = F.greatest(F.col("piece") * piece_bytes - F.col("start"), F.lit(0))
    end = (F.col("piece") + 1) * piece_bytes - F.col("start")
    part = F.substring("content", (begin + 1).cast("int"), (end - begin).cast("int"))
    pieces = cut.select("session_id", "piece", F.struct("start", part.alias("bytes")).alias("part"))
    joined = F.aggregate(F.array_sort(F.collect_list("part")), F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["bytes"]))
    whole = pieces.groupBy("session_id", "piece").agg(joined.alias("bytes"))
    return whole.select("session_id", F.col("piece").cast("bigint").alias("piece"), F.octet_length("bytes").cast("bigint").alias("size"), F.sha2("bytes", 256).alias("digest"))
