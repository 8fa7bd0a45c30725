"""Go back or forward in a history: load the state that the cursor reaches and pack it anew."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.history import loaded_history, move_cursors
from sheaf.operators.sizes import small_side
from sheaf.plans.packs import PackOptions, process_files
from sheaf.session import freeze


def load_states(
    history: DataFrame,
    moves: DataFrame,
    selections: DataFrame,
    listed: DataFrame,
    trees: DataFrame,
    files: DataFrame,
    roots: DataFrame,
    options: PackOptions,
) -> tuple[DataFrame, DataFrame]:
    """(packs, history): the packs of the states that the moves reach, and the histories after them.

    ``history``: session_id, pos, st, is_cursor; ``moves``: session_id, by.  Of each state (session_id, st) there are stored: one row of
    ``selections`` (mode, selected_file, selected_items), the paths of its files (``listed``: path) and, if it had a tree, the parts of its text
    (``trees``: part, parts, rendered).  A state without a row of ``selections`` cannot be loaded.  ``files`` (session_id, path, content, mtime) are the
    current ones: a state is rendered from what its files hold now, those that are gone are left out, but its tree is the stored one.  A move that
    leaves the cursor where it is loads nothing.
    """
    moved = freeze(move_cursors(history, moves))
    reached = moved.where("target != cursor").select("session_id", F.col("target").alias("pos"))
    targets = freeze(history.join(small_side(reached), ["session_id", "pos"]).select("session_id", "st"))
    state = freeze(selections.join(small_side(targets), ["session_id", "st"], "left_semi"))
    broken = targets.join(small_side(state.select("session_id", "st")), ["session_id", "st"], "left_anti")
    loaded = state.select("session_id", "st")

    def stored(rows):
        return rows.join(small_side(loaded), ["session_id", "st"], "left_semi").drop("st")

    mine = files.join(stored(listed).select("session_id", "path"), ["session_id", "path"], "left_semi")
    owners = loaded.select("session_id").join(roots, "session_id", "left")
    chosen = state.select("session_id", "mode", "selected_file", "selected_items")
    packs = process_files(mine, owners, chosen, replace(options, include_tree=False), stored_trees=stored(trees))
    return packs, loaded_history(history, moved, broken, options.rows_per_slice)
