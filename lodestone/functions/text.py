"""Scalar functions on code and text, as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of search queries that are left out, or that mark prose.
STOP_WORDS = tuple("a an the in on at to for of with by from and or is are was were be been being".split())
PROSE_WORDS = tuple(
    "how where what why who which does do is are can should work works handled handles processed created implemented defined used authenticated "
    "validates process payments service classes".split()
)
# Words in types that name nothing, modules and packages of the languages' own libraries.
TYPE_WORDS = ("any", "bool", "boolean", "byte", "char", "const", "double", "extends", "final", "float", "infer", "int", "keyof", "long", "never", "new", "null", "number", "object", "readonly", "short", "str", "string", "super", "symbol", "typeof", "undefined", "unknown", "void", "None")
PYTHON_MODULES = ("__future__", "abc", "argparse", "array", "ast", "asyncio", "base64", "bisect", "builtins", "calendar", "collections", "concurrent", "configparser", "contextlib", "copy", "csv", "ctypes", "dataclasses", "datetime", "decimal", "difflib", "dis", "email", "enum", "errno", "functools", "gc", "getpass", "glob", "gzip", "hashlib", "heapq", "hmac", "html", "http", "importlib", "inspect", "io", "ipaddress", "itertools", "json", "logging", "lzma", "math", "mimetypes", "multiprocessing", "numbers", "operator", "os", "pathlib", "pickle", "platform", "pprint", "queue", "random", "re", "sched", "secrets", "select", "shelve", "shlex", "shutil", "signal", "socket", "sqlite3", "ssl", "stat", "statistics", "string", "struct", "subprocess", "sys", "tarfile", "tempfile", "textwrap", "threading", "time", "timeit", "tkinter", "traceback", "types", "typing", "unicodedata", "unittest", "urllib", "uuid", "warnings", "weakref", "xml", "zipfile", "zlib", "zoneinfo")
JAVA_PACKAGES = ("java", "javax", "jdk", "sun", "com.sun", "org.w3c.dom", "org.xml.sax")
RAW_TOKEN = r"[A-Za-z0-9_\-./]+"
EXTENSIONS = {".py": "python", ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(c: Column, f) -> Column:
    """f of c, which is evaluated once, though f uses it often."""
    return F.transform(F.array(c), f)[0]


def split_camel(c: Column | str) -> Column:
    """camelCase and PascalCase words, with blanks between their parts."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")


def code_tokens(c: Column | str) -> Column:
    """Lexical tokens of code: each run of word signs in lower case, then its pieces and their camel-case parts.

    A piece equal to its run, and a part equal to its piece or run, is left out; repeats stay. Null gives no tokens.
    """

    none = F.array().cast("array<string>")

    def pieces(run: Column, whole: Column) -> Column:
        def parts(p: Column) -> Column:
            low = F.lower(p)
            subs = F.filter(F.transform(F.split(split_camel(p), " "), F.lower), lambda s: (s != "") & (s != low) & (s != whole))
            own = F.when(low != whole, F.array(low)).otherwise(none)
            return F.when(p == low, own).otherwise(F.concat(own, subs))  # without capitals there are no parts

        split = F.filter(F.split(run, r"[._\-/]+"), lambda p: p != "")
        return F.when(run == "", none).otherwise(F.concat(F.array(whole), F.flatten(F.transform(split, parts))))

    def expand(raw: Column) -> Column:
        run = F.regexp_replace(raw, r"^[._\-/]+|[._\-/]+$", "")
        # Most runs are one lower-case word, which has no parts.
        return F.when(raw.rlike("^[a-z0-9]+$"), F.array(raw)).otherwise(_once(run, lambda r: _once(F.lower(r), lambda whole: pieces(r, whole))))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(f"({RAW_TOKEN})")), expand))


def estimated_tokens(c: Column | str) -> Column:
    """Words and signs, but at least a quarter of the characters; 0 for null and empty."""
    c = _c(c)
    pieces = F.regexp_count(c, F.lit(r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), pieces, F.ceil(F.length(c) / 4).cast("int")))


def language_of(path: Column | str) -> Column:
    """The language by extension, null for others."""
    out = F.lit(None).cast("string")
    for ext, lang in EXTENSIONS.items():
        out = F.when(F.lower(_c(path)).endswith(ext), lang).otherwise(out)
    return out


def module_of(path: Column | str) -> Column:
    """A module's qualified name from its path: no extension, dots for slashes, no __init__ at the end."""
    return F.regexp_replace(F.translate(F.regexp_replace(_c(path), r"\.[^./]*$", ""), "/", "."), r"\.__init__$", "")


def uuid5(namespace: str, key: Column) -> Column:
    """The name-based UUID (version 5) of key within a namespace UUID, without a Python function."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), key.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def embedding_text(header: dict[str, Column], content: Column) -> Column:
    """What of a chunk is embedded: a header line for each part that is known, a blank line, the trimmed content.

    header: language, path, chunk_type, symbol, signature, parent, doc; a doc comment becomes one line, a blank content a
    fixed text.
    """
    names = {"language": "Language", "path": "Path", "chunk_type": "ChunkType", "symbol": "Symbol", "signature": "Signature", "parent": "Parent", "doc": "Doc"}
    if set(header) - set(names):
        raise ValueError("unknown header")
    doc = F.array_join(F.filter(F.transform(F.split(header.get("doc", F.lit(None).cast("string")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    parts = [F.when(c != "", F.concat(F.lit(f"[{names[k]}: "), c, F.lit("]"))) for k in names if k in header for c in (doc if k == "doc" else header[k],)]
    body = F.coalesce(F.nullif(F.trim(content), F.lit("")), F.lit("[Content: (Empty implementation)]"))
    return F.concat_ws("\n", *parts, F.when(F.coalesce(*parts, F.lit("")) != "", ""), body) if parts else body


def hash_embedding(text: Column, model: str = "hash", version: str = "1", dimension: int = 64) -> Column:
    """A deterministic unit vector from SHA-256: value i of the bytes i % 32 and (7 i + 13) % 32, a zero vector even."""
    def byte(h: Column, k: Column) -> Column:
        return F.conv(F.substring(h, 2 * k + 1, F.lit(2)), 16, 10).cast("int")

    def values(h: Column) -> Column:
        held = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: byte(h, k))
        return _once(held, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (F.get(b, i % 32) * 256 + F.get(b, (7 * i + 13) % 32)) / F.lit(32767.5) - 1))

    def unit(r: Column) -> Column:
        return _once(F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.when(n == 0, F.array_repeat(F.lit(1.0 / dimension**0.5), dimension)).otherwise(F.transform(r, lambda x: x / n)))

    h = F.sha2(F.concat_ws(":", F.lit(model), F.lit(version), F.coalesce(text, F.lit(""))), 256)
    return _once(_once(h, values), unit)


def claims(c: Column | str) -> Column:
    """An answer's statements: split at line feeds and behind a full stop that blanks and a capital follow."""
    return F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"\n+|(?<=\.)\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: s != "")


def normalised_query(c: Column | str) -> Column:
    """One blank for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\s+", " "))


def identifiers(c: Column | str) -> Column:
    """Identifier-like words of a query, in the order of kinds: qualified, camel, Pascal, snake, acronym, capitalised.

    Words of prose are left out, qualified names never; repeats once.
    """
    c = _c(c)
    word = "[A-Za-z_][A-Za-z0-9_]*"
    kinds = [r"\b[a-z0-9]+[A-Z][a-zA-Z0-9]*\b", r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b", r"\b[a-zA-Z0-9]+_[a-zA-Z0-9_]+\b", r"\b[A-Z]{2,}\b", r"\b[A-Z][a-zA-Z0-9]*\b"]
    others = F.concat(*[F.regexp_extract_all(c, F.lit(f"({k})"), 1) for k in kinds])
    prose = F.array(*map(F.lit, PROSE_WORDS))
    return F.array_distinct(F.concat(qualified_names(c), F.filter(others, lambda w: ~F.array_contains(prose, F.lower(w)))))


def qualified_names(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)\b"), 1))


def text_tokens(tokens: Column, ids: Column) -> Column:
    """A query's tokens that are neither stop words nor parts of its identifiers; repeats stay."""
    parts = F.flatten(F.transform(ids, lambda i: code_tokens(i)))
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS) & ~F.array_contains(parts, t))


def fused_relevance(score: Column) -> Column:
    """A fused score, which rarely exceeds a thirtieth, on the scale from 0 to 1. Null and NaN give 0."""
    return F.when(score.isNull() | F.isnan(score), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * 30)))


def clamped(score: Column) -> Column:
    """A score between 0 and 1; null and NaN give 0."""
    return F.when(score.isNull() | F.isnan(score), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def type_names(c: Column | str) -> Column:
    """The names in a type: Map<String, List<a.B[]>> gives Map, String, List, a.B; builtin words and repeats are left out.

    Signs of arrays, unions, generics and functions only separate names.
    """
    names = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)"), 1)
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(*TYPE_WORDS)))


def split_type_args(c: Column | str) -> Column:
    """What stands between the commas outside of all brackets, trimmed: a, Map<b, c>, d gives three parts."""
    signs = F.split(F.coalesce(_c(c), F.lit("")), "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("depth"))

    def step(s: Column, x: Column) -> Column:
        cut = (x == ",") & (s["depth"] == 0)
        return F.struct(
            F.when(cut, F.concat(s["done"], F.array(F.trim(s["now"])))).otherwise(s["done"]).alias("done"),
            F.when(cut, F.lit("")).otherwise(F.concat(s["now"], x)).alias("now"),
            (s["depth"] + F.when((x == ">") & s["now"].endswith("="), 0).when(x.isin("<", "[", "(", "{"), 1).when(x.isin(">", "]", ")", "}"), -1).otherwise(0)).alias("depth"),
        )

    return F.filter(F.aggregate(signs, start, step, lambda s: F.concat(s["done"], F.array(F.trim(s["now"])))), lambda p: p != "")


def relative_module(importer: Column | str, spec: Column | str) -> Column:
    """The path that a relative TypeScript import names, without extension; null where the import isn't relative.

    ./b from a/x.ts gives a/b, ../c gives c; steps above the root are left out.
    """
    spec, importer = _c(spec), _c(importer)
    parts = F.split(F.concat_ws("/", F.nullif(F.regexp_replace(importer, r"(^|/)[^/]*$", ""), F.lit("")), F.regexp_replace(spec, r"\.(?:tsx?|jsx?|d\.ts)$", "")), "/")
    none = F.array().cast("array<string>")
    way = F.aggregate(
        parts, none, lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    )
    return F.when(spec.startswith("./") | spec.startswith("../") | (spec == ".") | (spec == ".."), F.array_join(way, "/"))


def is_external(module: Column | str, language: Column | str) -> Column:
    """Whether an import names a module of the language's own library or, in TypeScript, any package: it isn't relative."""
    m, lang = _c(module), F.lower(F.trim(_c(language)))
    first = F.substring_index(m, ".", 1)
    java = F.lit(False)
    for p in JAVA_PACKAGES:
        java = java | (m == p) | m.startswith(p + ".")
    return F.coalesce(F.when(lang == "python", first.isin(*PYTHON_MODULES)).when(lang == "java", java).when(lang == "typescript", ~m.startswith(".") & ~m.startswith("/")), F.lit(False))


def body_slice(text: Column | str, start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    """Text from a line and column to another, line feeds kept; lines count from 1, columns from 0, the end column is excluded.

    Null or senseless places give an empty text.
    """
    lines = F.split(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\r\n?", "\n"), "\n")
    n = end_line - start_line + 1
    ok = F.coalesce((start_line >= 1) & (n >= 1) & (start_column >= 0) & (end_column >= 0) & (start_line <= F.size(lines)), F.lit(False))
    got = F.slice(lines, F.when(ok, start_line).otherwise(1), F.when(ok, n).otherwise(0))
    cut = F.transform(got, lambda x, i: F.when(i == n - 1, F.substring(x, F.lit(1), end_column)).otherwise(x))
    return F.when(ok, F.array_join(F.transform(cut, lambda x, i: F.when(i == 0, F.substring(x, start_column + 1, F.length(x))).otherwise(x)), "\n")).otherwise("")


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(c: Column | str) -> Column:
    """Texts in Unicode's composed form (NFC), which no built-in function makes. Nulls stay."""
    return F.pandas_udf(_nfc, "string")(_c(c))
