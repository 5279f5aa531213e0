"""Sources to entity and reference rows: Python by the interpreter's own parser, Java and TypeScript by ``braces``."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import module_of
from lodestone.session import spread
from lodestone.sources import braces

ENTITY = "file_id string, row_kind string, kind string, name string, qualified_name string, parent string, doc_comment string, signature string, is_async boolean, is_static boolean, visibility string, start_line int, end_line int, target string"


def _visibility(name: str) -> str:
    return "private" if name.startswith("_") and not name.startswith("__") else "public"


def rows_of(file_id: str, module: str, text: str, nested: bool = False) -> Iterator[tuple]:
    """Module, classes, functions, methods, fields; imports and bases as references; a diagnostic where it doesn't parse.

    Functions and classes inside of functions give a row only with nested, as they are no members. __init__ is a constructor.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield (file_id, "diagnostic", "syntax_error", type(e).__name__, None, None, str(getattr(e, "msg", e))[:200], None, None, None, None, getattr(e, "lineno", None), None, None)
        return
    n = max(1, text.count("\n") + (not text.endswith("\n")))
    yield (file_id, "entity", "module", module.rpartition(".")[2], module, None, ast.get_docstring(tree), None, False, False, "public", 1, n, None)

    def reference(kind: str, source: str, target: str, line: int) -> tuple:
        return (file_id, "reference", kind, None, source, None, None, None, None, None, None, line, None, target)

    def members(body: list[ast.stmt], owner: str, in_class: bool) -> Iterator[tuple]:
        for s in body:
            if isinstance(s, ast.ClassDef):
                q = f"{owner}.{s.name}"
                yield (file_id, "entity", "class", s.name, q, owner, ast.get_docstring(s), f"class {s.name}", False, False, _visibility(s.name), s.lineno, s.end_lineno, None)
                for b in s.bases:
                    yield reference("extends", q, ast.unparse(b), s.lineno)
                yield from members(s.body, q, True)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                marks = {ast.unparse(d) for d in s.decorator_list}
                kind = ("constructor" if s.name == "__init__" else "method") if in_class else "function"
                sig = f"{s.name}({ast.unparse(s.args)})" + (f" -> {ast.unparse(s.returns)}" if s.returns else "")
                q = f"{owner}.{s.name}"
                for a in [*s.args.posonlyargs, *s.args.args, *([s.args.vararg] if s.args.vararg else []), *s.args.kwonlyargs, *([s.args.kwarg] if s.args.kwarg else [])]:
                    yield (file_id, "parameter", None, a.arg, f"{q}.{a.arg}", q, None, ast.unparse(a), None, None, None, a.lineno, a.end_lineno, ast.unparse(a.annotation) if a.annotation else None)
                for d in s.decorator_list:
                    yield reference("decorator", q, ast.unparse(d.func if isinstance(d, ast.Call) else d), d.lineno)
                yield (file_id, "entity", kind, s.name, f"{owner}.{s.name}", owner, ast.get_docstring(s), sig, isinstance(s, ast.AsyncFunctionDef), bool(marks & {"staticmethod", "classmethod"}), _visibility(s.name), s.lineno, s.end_lineno, None)
                if nested:
                    yield from (r for r in members(s.body, q, False) if r[2] != "variable")
            elif isinstance(s, (ast.Assign, ast.AnnAssign)):
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if isinstance(t, ast.Name):
                        yield (file_id, "entity", "variable", t.id, f"{owner}.{t.id}", owner, None, None, False, in_class, _visibility(t.id), s.lineno, s.end_lineno, None)
            elif isinstance(s, ast.Import):
                for a in s.names:
                    yield reference("import", owner, a.name, s.lineno)
            elif isinstance(s, ast.ImportFrom):
                for a in s.names:
                    yield reference("import", owner, "." * s.level + ".".join(x for x in (s.module, a.name) if x), s.lineno)

    yield from members(tree.body, module, False)


def _parsed(nested: bool):
    cols = [c.split()[0] for c in ENTITY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for f, m, t in zip(b["file_id"], b["module"], b["content"]) for r in rows_of(f, m, t, nested)], columns=cols)

    return run


def _braced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in ENTITY.split(", ")]
    for b in batches:
        out = [r for f, m, t, lang in zip(b["file_id"], b["module"], b["content"], b["lang"]) for r in braces.rows_of(f, m, t, lang)]
        yield pd.DataFrame(out, columns=cols)


def parse_sources(files: DataFrame, nested: bool = True) -> DataFrame:
    """Rows of ENTITY for the Python, Java and TypeScript files of (file_id, path, language, content).

    Rows of kind entity, parameter (target: its type), reference (import, extends, implements, decorator) and
    diagnostic. Null contents and other languages give none.
    """
    lang = F.lower(F.trim("language"))
    rows = files.where("content is not null and path is not null and file_id is not null").where(lang.isin("java", "typescript"))
    other = spread(rows).select("file_id", module_of("path").alias("module"), F.regexp_replace("content", r"\r\n?", "\n").alias("content"), lang.alias("lang")).mapInPandas(_braced, ENTITY)
    return parse_python(files, nested).unionByName(other)


def parse_python(files: DataFrame, nested: bool = False) -> DataFrame:
    """Rows of ENTITY for the Python files of (file_id, path, language, content); null contents give none."""
    rows = files.where("content is not null and path is not null and file_id is not null").where(F.lower(F.trim("language")) == "python")
    return spread(rows).select("file_id", module_of("path").alias("module"), F.regexp_replace("content", r"\r\n?", "\n").alias("content")).mapInPandas(_parsed(nested), ENTITY)
