"""Source files that do not parse.

Every file is cut into chunks of about ``chunk_chars``. A chunk becomes a map over lexer states with bracket summaries
(codelex); the maps reduce associatively. A Java or TypeScript file whose reduced map leaves a string, a comment or a
bracket open is broken. What balances is parsed with a grammar of its language, statement by statement: Python's
balanced runs of top-level statements with the interpreter's own, Java and TypeScript by recursive descent. In Python,
whose f-strings may hold their own quotes, the interpreter has the last word on a file that seems not to balance.

The files are read once. Where one has more than ``long_chars``, its chunks are dealt out, summarised and reduced on
whichever executors hold them; those that balance are then parsed, one file a task.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id
from lodestone.llm import grammar_java, grammar_typescript
from lodestone.llm.codelex import CODE, BadLex, Piece, Tokens, brackets, combine, cut, lex, summarise, verdict
from lodestone.session import cut_lineage, spread

CHUNK_CHARS = 4_096
LONG_CHARS = 1_000_000
LANGUAGES = ("python", "java", "typescript")
_GOES_ON = re.compile(r"(?:else|elif|except|finally|case)\b|[)\]}]")


def chunk_maps(text: str, lang: str, chunk_chars: int = CHUNK_CHARS) -> list[dict[str, Piece]]:
    """The map of each chunk, in order."""
    out, begin = [], 0
    for c in cut(text, chunk_chars):
        out.append(summarise(c, lang, begin))
        begin += len(c)
    return out


def balanced(text: str, lang: str, chunk_chars: int = CHUNK_CHARS) -> bool:
    """The chunks' maps, reduced."""
    return verdict(reduce(combine, chunk_maps(text, lang, chunk_chars)))


def _python_parses(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def python_statements(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Runs of whole top-level statements of about size characters; one run where the text is short."""
    begin = at = 0
    while len(text) - begin > size:
        at = text.find("\n", max(at, begin + size)) + 1
        if not at:
            break
        head = text[at : at + 10]
        if not head or head[0] in " \t\r\n#\f" or _GOES_ON.match(head) or text[begin:at].rstrip("\r\n").endswith("\\"):
            continue
        last = text.rfind("\n", begin, at - 1) + 1
        if text[last : last + 1] == "@":  # a decorator belongs to what follows
            continue
        run = text[begin:at]
        if verdict(summarise(run, "python")):
            yield run
            begin = at
        else:  # within a long text or bracket: look again twice as far on
            at = begin + 2 * (at - begin)
    yield text[begin:]


def parses(text: str, lang: str, chunk_chars: int = CHUNK_CHARS) -> bool:
    """Whether text is valid in the language. An empty text is."""
    if text.startswith("﻿"):
        text = text[1:]
    if lang == "python":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        # Cuts never decide against a file: where a run fails, the interpreter has the last word on the whole.
        return (balanced(text, lang, chunk_chars) and all(map(_python_parses, python_statements(text, chunk_chars)))) or _python_parses(text)
    return valid_tokens(text, lang, chunk_chars) is not None


def valid_tokens(text: str, lang: str, chunk_chars: int = CHUNK_CHARS) -> Tokens | None:
    """The tokens of a Java or TypeScript text without a byte order mark, None where it is broken."""
    try:
        if len(text) > chunk_chars:
            if not balanced(text, lang, chunk_chars):
                return None
            t = lex(text, lang)
        else:  # one chunk, whose map is read off the tokens that the grammar takes
            t = lex(text, lang)
            if not verdict({CODE: Piece(t.state, *brackets(t))}):
                return None
    except BadLex:
        return None
    return t if _derived(t, grammar_java if lang == "java" else grammar_typescript) else None


def _derived(t: Tokens, grammar) -> bool:
    """Whether the grammar derives the tokens. A text may nest as deep as it has tokens, so the parser's stack may, too."""
    was = sys.getrecursionlimit()
    sys.setrecursionlimit(max(was, 20_000, 60 * len(t.kind)))
    try:
        return grammar.parses(t)
    finally:
        sys.setrecursionlimit(was)


_CHUNKS = "rid string, broken boolean, lang string, k int, begin bigint, chunk string"


def _decided(chunk_chars: int, long_chars: int):
    """A verdict for each file, and the chunks of long ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, lang, text in zip(b["rid"], b["lang"], b["content"]):
                if len(text) <= long_chars:
                    out.append((rid, not parses(text, lang, chunk_chars), lang, 0, 0, None))
                    continue
                begin = 0
                for k, c in enumerate(cut(text.removeprefix("﻿"), chunk_chars)):
                    yield pd.DataFrame([(rid, None, lang, k, begin, c)], columns=[c.split()[0] for c in _CHUNKS.split(", ")])
                    begin += len(c)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _CHUNKS.split(", ")])

    return run


_MAP = "array<struct<entry:string,state:string,closes:string,opens:string,bad:boolean,block:string,part:string>>"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        maps = [[{"entry": s} | p._asdict() for s, p in summarise(c, lang, begin).items()] for c, lang, begin in zip(b["chunk"], b["lang"], b["begin"])]
        yield b[["rid", "lang", "k", "chunk"]].assign(map=maps)


def _reduced(chunk_chars: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        lang = pdf["lang"].iloc[0]
        maps = ({x["entry"]: Piece(*(x[f] for f in Piece._fields)) for x in m} for m in pdf["map"])
        ok = (verdict(reduce(combine, maps)) or lang == "python") and parses("".join(pdf["chunk"]), lang, chunk_chars)
        return pd.DataFrame({"rid": [pdf["rid"].iloc[0]], "broken": [not ok]})

    return run


def broken_files(files: DataFrame, chunk_chars: int = CHUNK_CHARS, long_chars: int = LONG_CHARS) -> DataFrame:
    """(file_id, repository_id, language, broken): one row per file whose text was kept, in a known language.

    language compares trimmed and in lower case. Null contents and unknown or null languages give no row, empty
    contents are valid, a byte order mark is skipped. Of redelivered files the latest row holds, at equal times a
    broken one. A Python file is valid if the interpreter's grammar takes it; what only its compiler rejects (a return
    outside of a function, an argument named twice) isn't looked at.
    """
    rows = files.select(
        norm_id("file_id").alias("file_id"), norm_id("repository_id").alias("repository_id"), F.lower(F.trim("language")).alias("lang"), "content",
        F.col("indexed_at").cast("timestamp_ntz").alias("indexed_at"),
    ).where(F.col("content").isNotNull() & F.col("lang").isin(*LANGUAGES) & F.col("file_id").isNotNull())
    rid = F.struct("file_id", "repository_id", "lang", "indexed_at")
    kind = "struct<file_id:string,repository_id:string,lang:string,indexed_at:timestamp_ntz>"
    keyed = spread(rows).select(F.to_json(rid, {"ignoreNullFields": "false"}).alias("rid"), "lang", "content")
    out = cut_lineage(keyed.mapInPandas(_decided(chunk_chars, long_chars), _CHUNKS))
    long = out.where("broken is null")
    out = out.where("broken is not null").select("rid", "broken")
    if long.limit(1).count():
        summed = long.repartition("rid", "k").mapInPandas(_summaries, f"rid string, lang string, k int, chunk string, map {_MAP}")
        out = out.unionByName(summed.groupBy("rid").applyInPandas(_reduced(chunk_chars), "rid string, broken boolean"))  # a group is one file
    return (
        out.select(F.from_json("rid", kind).alias("r"), "broken")
        .groupBy("r.file_id")
        .agg(F.max(F.struct("r.indexed_at", "broken", "r.repository_id", "r.lang")).alias("m"))
        .select("file_id", "m.repository_id", F.col("m.lang").alias("language"), "m.broken")
    )


def broken_rates(verdicts: DataFrame) -> DataFrame:
    """(repository_id, language, n_files, n_broken, broken_rate) of broken_files()."""
    n, k = F.count("*"), F.count_if("broken")
    return verdicts.groupBy("repository_id", "language").agg(n.alias("n_files"), k.alias("n_broken"), F.round(k / n, 6).alias("broken_rate"))
