"""Process files into packs, list symbols, update a selection, refresh, check staleness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.constants import MODE_ALL, MODE_SINGLE, NO_TEXT_FILES, PART_BYTES, ROWS_PER_SLICE
from sheaf.functions.paths import basename, display_path
from sheaf.functions.patterns import first_non_blank
from sheaf.functions.text import content_hash, decode_text, is_text, non_blank_lines, rstrip
from sheaf.operators.filters import drop_ignored, drop_ignored_by_session, is_python, keep_python
from sheaf.operators.history import file_list_digest
from sheaf.operators.packing import Parts, concat_parts, number, with_part
from sheaf.operators.render import blocks
from sheaf.operators.selection import apply_mode, selected_file_problem, selection_changed
from sheaf.operators.sizes import small_side
from sheaf.operators.stale import current_hashes, headlines, stale_by_digests, stale_files
from sheaf.operators.symbols import error_message, filter_decision, names_of, with_source
from sheaf.operators.tree import KEY_TYPE, drawable, tree_lines, tree_rows
from sheaf.session import freeze

TREE, FILES = 0, 1


@dataclass(frozen=True)
class PackOptions:
    """What a pack looks like."""

    home: str = "/"
    ignore: str | None = None
    tree_ignore: str | None = None
    include_tree: bool = False
    machine_time: bool = False
    show_ellipsis: bool = True
    include_date_modified: bool = True  # kept for callers; the line is always written
    reference_strict: bool = False
    part_bytes: int = PART_BYTES
    rows_per_slice: int = ROWS_PER_SLICE


def session_settings(
    files: DataFrame, roots: DataFrame, state: DataFrame, options: PackOptions
) -> DataFrame:
    """One row per session: session_id, root, mode, selected_file, selected_items, message.

    ``files`` have content, or is_text.  ``message`` is set where the selected single file cannot be shown.  The table is frozen
    (it is read several times) and marked for broadcast if it is small.
    """
    slim = state.select("session_id", "mode", "selected_file", "selected_items")
    joined = roots.select("session_id", "root").join(slim, "session_id", "full")
    single = (F.col("mode") == MODE_SINGLE) & F.coalesce(F.col("selected_file") != "", F.lit(False))
    settings = freeze(
        joined.select(
            "session_id",
            "root",
            F.coalesce("mode", F.lit(MODE_ALL)).alias("mode"),
            F.when(single, F.col("selected_file")).alias("selected_file"),
            F.coalesce("selected_items", F.array().cast("array<string>")).alias("selected_items"),
        )
    )
    chosen = settings.where(F.col("selected_file").isNotNull()).select("session_id", "mode", "selected_file")
    if chosen.isEmpty():
        return small_side(settings.withColumn("message", F.lit(None).cast("string")))
    wanted = chosen.select("session_id", F.col("selected_file").alias("path"))
    # the text check runs on the selected files only
    found = kept_files(files, roots, options).join(small_side(wanted), ["session_id", "path"], "left_semi")
    if "content" in files.columns:
        found = found.withColumn("is_text", is_text("content", options.reference_strict))
    problems = selected_file_problem(found, chosen)
    return small_side(freeze(settings.join(problems, "session_id", "left")))


def kept_files(files, roots, options):
    """Files that their session's own pattern, or else the common one, does not ignore."""
    if "ignore" not in roots.columns:
        return drop_ignored(files, options.ignore)
    own = roots.select("session_id", first_non_blank("ignore", F.lit(options.ignore).cast("string")).alias("ignore"))
    return drop_ignored_by_session(files, own, default=options.ignore)


def prepare(files: DataFrame, roots: DataFrame, settings: DataFrame, options: PackOptions) -> DataFrame:
    """Files of each session that pass the ignore filter and the selection mode, with is_text and text.

    A file that is not text keeps its row, without text.
    """
    joined = kept_files(files, roots, options).join(settings, "session_id")
    shown = joined.where(F.col("selected_file").isNull() | (F.col("path") == F.col("selected_file")))
    checked = shown.where(F.col("message").isNull()).withColumn("is_text", is_text("content", options.reference_strict))
    return checked.withColumn("text", F.when(F.col("is_text"), decode_text("content")))


def _file_bytes(files):
    return F.col("length") if "length" in files.columns else F.octet_length("content").cast("bigint")


def weight(size, path):
    """Upper bound of a rendered block: a byte that is not UTF-8 becomes two; path, heading and fence around it."""
    return 2 * size + F.octet_length(path) + 256


def process_files(
    files: DataFrame,
    roots: DataFrame,
    state: DataFrame,
    options: PackOptions,
    listing: DataFrame | None = None,
    bases: DataFrame | None = None,
    stored_trees: DataFrame | None = None,
) -> DataFrame:
    """The packs: session_id, part, parts, output_text, line_count and errors of the part.

    ``files``: session_id, path, content, mtime and perhaps length.  ``roots``: one row per
    session (session_id, root, and perhaps ignore: the session's own pattern, which goes before ``options.ignore``).
    ``state``: one selection row per session; sessions may lack
    one.  For a tree section also ``listing`` and ``bases`` (session_id, base), or ``stored_trees`` (session_id, part, parts, rendered)
    of trees drawn earlier.  Parts of a
    session in order make up its text; one below ``options.part_bytes`` has exactly one.
    ``errors``: the files (path, error) left out because they failed.

    Contents are read twice: once for a narrow table of sizes and text checks, which is frozen and numbers the
    parts, and once to be rendered.  The rendered blocks are shuffled once, by session and part; binary
    files take no part in that.
    """
    settings = session_settings(files, roots, state, options)
    prepared = prepare(files, roots, settings, options)
    sizes = prepared.select("session_id", "path", _file_bytes(files).alias("bytes"), "is_text")
    narrow = freeze(
        sizes.select(
            "session_id",
            F.lit(FILES).alias("section"),
            path_key("path").alias("key"),
            weight(F.col("bytes"), "path").alias("weight"),
            "is_text",
        )
    )
    parsed = with_source(prepared.where("is_text"), "selected_items")
    rendered = blocks(parsed, options.home, options.machine_time, options.show_ellipsis)
    failed = F.when(F.col("error").isNotNull(), F.struct("path", "error"))
    file_rows = rendered.select(
        "session_id",
        F.lit(FILES).alias("section"),
        path_key("path").alias("key"),
        F.coalesce("block", F.lit("")).alias("text"),
        failed.alias("failed"),
    )
    # one row per session, before its files: sessions without files appear, errors replace them
    kinds = narrow.groupBy("session_id").agg(F.bool_or("is_text").alias("any_text"))
    only_binary = F.coalesce(~F.col("any_text"), F.lit(False))
    marks = settings.join(kinds, "session_id", "left").select(
        "session_id",
        F.lit(FILES).alias("section"),
        path_key(F.lit("")).alias("key"),
        F.coalesce("message", F.when(only_binary, F.lit(NO_TEXT_FILES)), F.lit("")).alias("text"),
        F.lit(None).cast("struct<path:string,error:string>").alias("failed"),
    )
    rows = file_rows.unionByName(marks)
    order = ["section", "key"]
    weighed = narrow.where("is_text").drop("is_text")
    if options.include_tree or stored_trees is not None:
        healthy = settings.where(F.col("message").isNull())
        drawn = _tree_rows(listing, bases.join(healthy, "session_id"), options) if stored_trees is None else _stored_rows(stored_trees, healthy)
        before = drawn.unionByName(marks.where("text != ''").drop("failed"))
        rows = rows.unionByName(drawn, allowMissingColumns=True)
        weighed = freeze(weighed.unionByName(before.select("session_id", *order, F.octet_length("text").cast("bigint").alias("weight"))))
    parts = number(weighed, ["session_id"], order, "weight", options.part_bytes, options.rows_per_slice)
    if parts is not None:
        parts = _without_empty_ends(parts, prepared)
    numbered = with_part(rows, parts)
    extra = {
        "shown": F.bool_or((F.col("section") == FILES) & (F.col("text") != "")),
        "errors": F.array_sort(F.collect_list("failed")),
    }
    packed = concat_parts(numbered, ["session_id"], order, "text", extra=extra)
    last = F.col("part") == F.col("parts") - 1
    text = (
        F.when(last & ~F.col("shown") & (F.col("text") != ""), F.concat(rstrip("text"), F.lit("\n")))
        .when(last, rstrip("text"))
        .otherwise(F.col("text"))
    )
    packs = packed.select("session_id", "part", "parts", text.alias("output_text"), "errors")
    return packs.withColumn("line_count", non_blank_lines("output_text"))


def _without_empty_ends(parts: Parts, prepared: DataFrame) -> Parts:
    """Merge the parts at a session's end of which no file shows anything into the last one that does.

    Only ``.py`` files can show nothing.  Those behind everything else of a session that must show are parsed, all in one pass.
    """
    path = F.element_at("key", 1)["name"]
    doubtful = (F.col("section") == FILES) & path.endswith(".py")
    sure = parts.placed.groupBy("session_id").agg(F.coalesce(F.max(F.when(~doubtful, F.col("part"))), F.lit(-1)).alias("__sure"))
    behind = parts.placed.where(doubtful).join(small_side(sure), "session_id").where(F.col("part") > F.col("__sure"))
    behind = freeze(behind.select("session_id", path.alias("path"), "part"))
    if behind.isEmpty():
        return parts
    # contents of .py files only; the few columns of ``behind`` are joined to them by path
    parsed = with_source(prepared.where(is_python()).join(small_side(behind), ["session_id", "path"]), F.array().cast("array<string>"))
    solid = parsed.where(filter_decision().isin("full", "filtered")).groupBy("session_id").agg(F.max("part").alias("__solid"))
    last = F.greatest(F.col("__sure"), F.coalesce("__solid", F.lit(-1)), F.lit(0)).cast("bigint")
    return parts.ending_at(freeze(sure.join(solid, "session_id", "left").select("session_id", last.alias("__last"))))


def path_key(path):
    path = F.col(path) if isinstance(path, str) else path
    entry = F.struct(F.lit(0).alias("file"), F.lit("").alias("fold"), path.alias("name"))
    return F.array(entry).cast(KEY_TYPE)


def _tree_rows(listing, bases, options):
    bases = drawable(listing, bases, options.tree_ignore)
    owners = bases.select(
        "session_id", "base", display_path("base", "root", options.home, show_ellipsis=True).alias("display")
    )
    drawn = tree_rows(tree_lines(listing, bases, options.tree_ignore), owners)
    # the last row ends the section; the blank lines before the files belong to it
    is_tail = F.get("key", F.lit(0))["file"] == 9
    text = F.when(is_tail, F.concat("text", F.lit("\n\n"))).otherwise(F.col("text"))
    return drawn.select(
        "session_id",
        F.lit(TREE).alias("section"),
        "key",
        text.alias("text"),
    )


def _stored_rows(stored, healthy):
    """Trees drawn earlier as rows before the files; the last part carries the blank lines before them."""
    at = F.array(F.struct(F.col("part").cast("int").alias("file"), F.lit("").alias("fold"), F.lit("").alias("name")))
    ends = F.col("part") == F.col("parts") - 1
    return stored.join(healthy.select("session_id"), "session_id", "left_semi").select(
        "session_id",
        F.lit(TREE).alias("section"),
        at.cast(KEY_TYPE).alias("key"),
        F.when(ends, F.concat("rendered", F.lit("\n\n"))).otherwise(F.col("rendered")).alias("text"),
    )


def pack_errors(packs: DataFrame) -> DataFrame:
    """Files left out of the packs: session_id, path, error."""
    return packs.select("session_id", F.inline("errors"))


def python_symbols(files: DataFrame) -> DataFrame:
    """session_id, path, classes, functions, imports, error of the Python text files: one parse for both outcomes.

    A file that cannot be parsed has null lists and an error.
    """
    sources = keep_python(files).withColumn("text", decode_text("content"))
    parsed = with_source(sources, F.array().cast("array<string>"))
    fine = F.col("source.error").isNull()
    return parsed.select(
        "session_id",
        "path",
        F.when(fine, names_of("class")).alias("classes"),
        F.when(fine, names_of("function")).alias("functions"),
        F.when(fine, F.col("source.imports")).alias("imports"),
        F.when(~fine, error_message()).alias("error"),
    )


def update_selection(
    files: DataFrame, roots: DataFrame, before: DataFrame, after: DataFrame, options: PackOptions
) -> DataFrame:
    """Packs of the sessions whose selection changed.

    ``before`` and ``after``: session_id, mode, selected_file, selected_items.  A selected file named without a
    folder is the first path of the session with that name.
    """
    named = F.coalesce(F.contains("selected_file", F.lit("/")), F.lit(True))
    by_name = files.select("session_id", "path", basename("path").alias("name"))
    wanted = after.where(~named).select("session_id", F.col("selected_file").alias("name"))
    first = by_name.join(small_side(wanted), ["session_id", "name"], "left_semi").groupBy("session_id").agg(F.min("path").alias("first"))
    resolved = after.join(first, "session_id", "left").withColumn("selected_file", F.coalesce("first", "selected_file")).drop("first")
    old = before.select("session_id", *[F.col(c).alias(f"old_{c}") for c in ("mode", "selected_file", "selected_items")])
    both = resolved.join(old, "session_id", "left")
    moved = selection_changed("old_selected_items", "selected_items", "old_mode", "mode", "old_selected_file", "selected_file")
    changed = freeze(both.where(F.coalesce(moved, F.lit(True))).select("session_id", "mode", "selected_file", "selected_items"))
    mine = files.join(small_side(changed.select("session_id")), "session_id", "left_semi")
    owners = changed.select("session_id").join(roots, "session_id", "left")
    return process_files(mine, owners, changed, options)


def decisions(files: DataFrame, state: DataFrame) -> DataFrame:
    """session_id, path, decision for every text file a session shows."""
    parsed = with_source(apply_mode(files, state), F.array().cast("array<string>"))
    return parsed.select("session_id", "path", filter_decision().alias("decision"))


def refresh_states(files: DataFrame, state: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """A new snapshot of each session as a replay event state: session_id, st.

    The digest covers the file list, the hashes of its text files, the selection and, where ``tree`` (session_id, key,
    text: the lines of its tree) is given, the tree.  It is built by partial aggregation.
    """
    hashed = files.select("session_id", "path", F.when(is_text("content"), content_hash("content")).alias("hash"))
    digests = file_list_digest(hashed, ["session_id"], ["path", "hash"])
    fields = ["digest", "mode", "selected_file", "selected_items"]
    if tree is not None:
        lines = tree.select("session_id", F.to_json(F.struct("key")).alias("key"), "text")
        trees = file_list_digest(lines, ["session_id"], ["key", "text"]).withColumnRenamed("digest", "tree")
        digests, fields = digests.join(trees, "session_id", "full"), [*fields, "tree"]
    slim = state.select("session_id", "mode", "selected_file", "selected_items")
    joined = digests.join(slim, "session_id", "left")
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return joined.select("session_id", F.sha2(whole, 256).alias("st"))


def check_stale(
    snapshots: DataFrame, files: DataFrame, keys: list[str], reference_strict: bool = False, by_digests: bool = False
) -> DataFrame:
    """Headline of each snapshot that is out of date: keys…, status, files, headline.

    ``by_digests`` compares folders first, and files only in folders that differ.
    """
    current = current_hashes(files)
    if by_digests and not reference_strict:
        return headlines(stale_by_digests(snapshots, freeze(current), keys), keys)
    return headlines(stale_files(snapshots, current, reference_strict), keys)
