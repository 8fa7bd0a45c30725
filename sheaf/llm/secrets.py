"""Secret scans: fixed rules, and Markov models of characters for what the rules miss.  DataFrame functions only.

Rules, leftmost and not overlapping within a kind: ``assign`` (a secret's name, a sign, a value of at least 6
characters), ``access`` (AKIA and 16 or more capitals or digits) and ``hex`` (24 or more hex digits).
A span covers the whole match, in code points, end exclusive.

``random``: runs of at least CANDIDATE characters of the alphabet below, or what of them no rule touches, whose log-likelihood as a
random string exceeds that as an ordinary identifier by MARGIN per character.  Both are first-order models of
characters.  The labelled samples are taken from the documents: values found by the rules are random, other
words of at least ORDINARY characters are ordinary; each distinct string counts once.  They come from about SAMPLE
documents, chosen by a hash of the text; the models are tables of a fixed size.

Rules for odd input: a null or empty text has no spans; repeated rows each get theirs; other columns pass through, whatever their
names, but for those of results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import whole_row

SAMPLE = 20_000
CANDIDATE, ORDINARY = 20, 8
MARGIN = 0.3
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
_RUN = r"[A-Za-z0-9+/_=-]"
_MARK, _OTHER = "\u0001", "\u0003"
_STEP = 256
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _starts(lengths: Column) -> Column:
    """Sums of all earlier lengths, in blocks, so that an array of n takes about n**1.5 steps at most."""
    none = F.array().cast("array<int>")

    def running(values: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("t"), none.alias("a"))
        add = lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["a"], F.array(acc["t"])).alias("a"))
        return F.aggregate(values, first, add, lambda acc: acc["a"])

    zero = F.lit(0)
    blocks = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / _STEP).cast("int")), lambda b: F.slice(lengths, b * _STEP + 1, F.lit(_STEP)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, running(sums, zero), running))


def _matches(df: DataFrame, text: str, pattern: str, out: str, gate: Column) -> DataFrame:
    """Adds ``out``: array of (start, end, value) of the pattern's matches; empty where ``gate`` is false."""
    parts = F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{_MARK}$1{_MARK}")), _MARK)
    df = df.withColumn("_parts", F.when(gate, parts))
    lengths = F.transform("_parts", lambda p: F.length(p))
    df = df.withColumn("_at", F.when(F.size("_parts") > 1, _starts(lengths)))
    each = F.transform("_parts", lambda p, i: F.struct((i % 2 == 1).alias("hit"), F.get("_at", i).alias("start"), (F.get("_at", i) + F.length(p)).alias("end"), p.alias("value")))
    hits = F.filter(each, lambda m: m["hit"])
    bare = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return df.withColumn(out, F.when(F.size("_parts") > 1, bare).otherwise(empty)).drop("_parts", "_at")


def _value(match: Column) -> Column:
    return F.regexp_extract(match, _ASSIGN, 2)


def base_matches(docs: DataFrame) -> DataFrame:
    """Adds ``clean`` (the text without the mark) and the arrays assign, access, hex."""
    df = docs.withColumn("clean", F.translate(F.coalesce("text", F.lit("")), _MARK, _OTHER))
    df = _matches(df, "clean", _ASSIGN, "assign", F.col("clean").rlike(_ASSIGN))
    df = df.withColumn("assign", F.filter("assign", lambda m: F.length(_value(m["value"])) >= 6))
    df = _matches(df, "clean", _ACCESS, "access", F.contains("clean", F.lit("AKIA")))
    return _matches(df, "clean", _HEX, "hex", F.col("clean").rlike(_HEX))


def _bigrams(strings: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring characters; the table is bounded by the alphabet."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1))
    pairs = strings.filter(F.length("s") > 1).select("s", at.alias("i"))
    one = F.instr(F.lit(ALPHABET), F.substring("s", F.col("i"), F.lit(1)))
    two = F.instr(F.lit(ALPHABET), F.substring("s", F.col("i") + 1, F.lit(1)))
    return {(r.a, r.b): r.n for r in pairs.groupBy(one.alias("a"), two.alias("b")).agg(F.count("*").alias("n")).collect()}


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of character pairs, random over ordinary, row by row."""
    total = docs.count()
    share = min(1.0, sample / max(total, 1))
    chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + (share > 0))
    chosen = base_matches(chosen.select("text"))
    found = F.concat(F.transform("assign", lambda m: _value(m["value"])), F.transform("access", lambda m: m["value"]), F.transform("hex", lambda m: m["value"]))
    # outer explodes: no filter on the arrays is inferred, which would repeat the steps that make them
    random = chosen.select(F.explode_outer(found).alias("s")).distinct()
    words = F.regexp_extract_all("clean", F.lit(f"({_RUN}{{{ORDINARY},}})"), F.lit(1))
    ordinary = chosen.select(F.explode_outer(F.array_distinct(words)).alias("s")).distinct()
    ordinary = ordinary.filter(~F.col("s").rlike(f"{_HEX}|{_ACCESS}|{_ASSIGN}|[0-9]"))
    size = len(ALPHABET) + 1  # 0: not in the alphabet

    def logs(counts: dict, spare: float) -> list[list[float]]:
        table = [[counts.get((a, b), 0) + spare for b in range(size)] for a in range(size)]
        return [[math.log(x / sum(row)) for x in row] for row in table]

    # the rules know few alphabets: many pseudo-counts keep other random strings likely
    up, down = logs(_bigrams(random), 5.0), logs(_bigrams(ordinary), 0.5)
    return [u - d for r, s in zip(up, down) for u, d in zip(r, s)]


def _ratio(value: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a string's character pairs."""
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))
    pairs = F.sequence(F.lit(1), F.length(value) - 1)
    cell = lambda i: F.get(table, place(i) * (len(ALPHABET) + 1) + place(i + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + cell(i)) / (F.length(value) - 1)


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """The rows of ``docs`` with ``base_spans`` and ``spans``: sorted arrays of (start, rank, end, kind)."""
    model = train(docs) if model is None else model
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    run = f"{_RUN}{{{CANDIDATE},}}"
    df = base_matches(docs.select("text", whole_row(docs)))
    df = _matches(df, "clean", run, "candidates", F.col("clean").rlike(run))

    def spans(name: str) -> Column:
        rank = KINDS.index("random" if name == "candidates" else name)
        one = lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"))
        return F.transform(name, one).cast(_SPAN)

    df = df.withColumn("base_spans", F.array_sort(F.concat(spans("assign"), spans("access"), spans("hex"))))
    df = df.withColumn("candidates", F.flatten(F.transform("candidates", lambda m: _outside(m, F.col("base_spans")))))
    df = df.withColumn("candidates", F.filter("candidates", lambda m: _ratio(m["value"], table) > MARGIN))
    df = df.withColumn("spans", F.array_sort(F.concat("base_spans", spans("candidates"))))
    return df.select(*[F.col(f"rest.`{c}`") for c in docs.columns if c not in ("base_spans", "spans")], "base_spans", "spans")


def _outside(run: Column, spans: Column) -> Column:
    """The parts of a run of at least CANDIDATE characters that no span (sorted by start) touches."""
    piece = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.substring(run["value"], a - run["start"] + 1, b - a).alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    touching = F.filter(spans, lambda s: (s["start"] < run["end"]) & (run["start"] < s["end"]))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.concat(acc["found"], F.array(piece(acc["at"], s["start"])))).otherwise(acc["found"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), gap.alias("found"))

    def finish(acc: Column) -> Column:
        return F.when(acc["at"] < run["end"], F.concat(acc["found"], F.array(piece(acc["at"], run["end"])))).otherwise(acc["found"])

    cut = F.aggregate(touching, F.struct(run["start"].alias("at"), none.alias("found")), step, finish)
    return F.filter(F.when(F.size(touching) == 0, F.array(run)).otherwise(cut), lambda p: p["end"] - p["start"] >= CANDIDATE)


def span_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with their secrets replaced; n_chars, where there is one, follows the new text."""
    found = scan(docs)
    touched = F.size("spans") > 0
    changes = {"text": redacted(F.col("text"), "spans", mark)}
    if "n_chars" in docs.columns:
        length = F.length(changes["text"]).cast(docs.schema["n_chars"].dataType)
        changes["n_chars"] = F.when(touched, length).otherwise(F.col("n_chars"))
    return found.withColumns(changes).select(*docs.columns)


def redacted(text: Column, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(apart, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, first, step)
    rest = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(rest)
