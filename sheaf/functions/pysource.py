"""Symbols of one Python source, as an Arrow UDF around the standard ``ast`` module."""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.constants import PARSE_ERROR, SYNTAX_ERROR

SOURCE_TYPE = (
    "struct<symbols:array<struct<kind:string,name:string,code:string>>,"
    "imports:array<string>,"
    "import_names:array<struct<alias:string,origin:string>>,"
    "error:string>"
)


def _definitions(tree):
    """Classes, functions and import statements in source order.

    Classes and plain functions are leaves; everything else, async functions included, is
    walked through.
    """
    pending = [tree]
    while pending:
        node = pending.pop()
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.Import, ast.ImportFrom)):
            yield node
        else:
            pending.extend(reversed(list(ast.iter_child_nodes(node))))


def scan_source(name: str, text: str, wanted) -> dict:
    """One parse: symbols (with code for the wanted names), imports, import names, or an error."""
    found = {"symbols": [], "imports": set(), "names": {}}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        for node in _definitions(tree):
            if isinstance(node, (ast.ClassDef, ast.FunctionDef)):
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                code = ast.unparse(node).strip() if node.name in wanted else None
                found["symbols"].append({"kind": kind, "name": node.name, "code": code})
                continue
            found["imports"].add(ast.unparse(node).strip())
            prefix = "" if isinstance(node, ast.Import) else "." * node.level + (node.module or "") + "."
            for item in node.names:
                found["names"][item.asname or item.name] = prefix + item.name
    except SyntaxError as e:
        return {"error": SYNTAX_ERROR.format(name=name, line=e.lineno, reason=e.msg)}
    except Exception as e:  # a hostile source must not fail the job
        return {"error": PARSE_ERROR.format(name=name, reason=e)}
    return {
        "symbols": found["symbols"],
        "imports": sorted(found["imports"]),
        "import_names": [{"alias": a, "origin": o} for a, o in found["names"].items()],
        "error": None,
    }


class _Everything:
    def __contains__(self, name):
        return True


_ARROW_TYPE = pa.struct([
    ("symbols", pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("code", pa.string())]))),
    ("imports", pa.list_(pa.string())),
    ("import_names", pa.list_(pa.struct([("alias", pa.string()), ("origin", pa.string())]))),
    ("error", pa.string()),
])


# Rows of a batch that are Python objects at once; the rest of it stays in Arrow's buffers.
_ROWS = 128


def _scan_rows(names, texts, wanted) -> pa.Array:
    rows = [
        None if text is None else scan_source(name, text, _Everything() if items is None else set(items))
        for name, text, items in zip(names.to_pylist(), texts.to_pylist(), wanted.to_pylist())
    ]
    return pa.array(rows, type=_ARROW_TYPE)


def _scan_batch(names, texts, wanted) -> pa.Array:
    parts = [_scan_rows(*(c.slice(at, _ROWS) for c in (names, texts, wanted))) for at in range(0, len(names), _ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=_ARROW_TYPE)


def parse_source(name, text, wanted=None) -> Column:
    """Struct of what a Python source defines; null text gives null and costs no parse.

    ``wanted`` is an array of names whose code is needed: null means all, empty means none.
    """

    def scan(names: pa.Array, texts: pa.Array, items: pa.Array) -> pa.Array:
        return _scan_batch(names, texts, items)

    name = F.col(name) if isinstance(name, str) else name
    text = F.col(text) if isinstance(text, str) else text
    if wanted is None:
        wanted = F.lit(None).cast("array<string>")
    elif isinstance(wanted, str):
        wanted = F.col(wanted)
    return F.arrow_udf(scan, SOURCE_TYPE)(name, text, wanted)
