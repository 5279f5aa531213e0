"""Functions paired with their documentation.

Signatures are found by regular expressions on a text whose strings and comments are blanked, bodies are delimited by
an indentation stack (Python) or a stack of braces (Java, TypeScript), and a comment belongs to a declaration if it ends
before it with nothing but blanks, annotations and modifiers between them. Each file is read on its own, in one pass.

Braces inside of brackets (callbacks, arguments) are walked like all others. Bodies of anonymous classes, of class
expressions and of enum constants and object literals hold methods, but add no name of their own. Functions that are only
values (arrow functions, function expressions) and members of type literals aren't declarations.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id, norm_path
from lodestone.llm.codelex import Tokens, lex
from lodestone.session import spread
from lodestone.llm.syntax import CHUNK_CHARS, LANGUAGES, parses, valid_tokens

# First words, filler words and headings of the definition of a trivial comment.
PLACEHOLDERS = frozenset(("todo", "fixme", "tbd", "xxx"))
FILLERS = frozenset(("a", "an", "the", "of", "for", "to", "and", "this", "is", "it"))
HEADINGS = frozenset(("Args:", "Returns:", "Raises:"))


class Found(NamedTuple):
    name: str  # the enclosing declarations' names and its own
    begin: int
    end: int
    comment: str | None  # without comment signs


def description(comment: str) -> str:
    """The comment's text up to the first tag or heading, without {@...} parts."""
    lines = []
    for line in re.sub(r"\{@[^}]*\}", " ", comment).split("\n"):
        s = line.strip()
        if s[:1] in ("@", ":") or s in HEADINGS:
            break
        lines.append(s)
    return "\n".join(lines).strip()


def trivial(text: str, function: str) -> bool:
    """Fewer than four words, a placeholder, or only parts of the function's name and filler words."""
    words = [w.lower() for w in re.findall(r"[A-Za-z]+", text)]
    if len(words) < 4 or words[0] in PLACEHOLDERS:
        return True
    parts = {p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", function)}
    return all(w in parts or w in FILLERS for w in words)


def block_text(comment: str) -> str:
    """A /** */ block without its signs."""
    return "\n".join(re.sub(r"^\s*\*+ ?", "", line) if k else line for k, line in enumerate(comment[3:-2].replace("\r", "").split("\n")))


# --- Java and TypeScript
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_ANNOTATION = r"@(?!interface\b)[\w$.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?"
_MODIFIER = {
    "java": rf"(?:{_ANNOTATION}|(?:public|protected|private|static|abstract|final|native|synchronized|transient|volatile|strictfp|default|sealed|non-sealed)\b)",
    "typescript": rf"(?:{_ANNOTATION}|(?:export|default|declare|public|protected|private|static|readonly|abstract|override|async|accessor|get|set)\b(?!\s*[(<?:=;!]))",
}
_LEAD = {k: re.compile(rf"\s*(?:{m}\s*)*") for k, m in _MODIFIER.items()}
_TYPE_WORD = {
    "java": re.compile(rf"(?:class|interface|enum|record|@\s*interface)\s+({_NAME})"),
    "typescript": re.compile(rf"(?:class|interface|namespace|module|(?:const\s+)?enum)\s+(?!(?:extends|implements)\b)((?:{_NAME})(?:\.(?:{_NAME}))*)"),
}
_SPACE = re.compile(r"(?:namespace|module)\b")
_NEW = re.compile(r"\bnew\s+(?:@[\w.]+\s*)*[\w$.]+\s*(?:<[^;{}()]*>)?\s*$")
_CLASS_VALUE = re.compile(rf"(?<![\w$.])class\b(?:\s+(?!(?:extends|implements)\b)(?:{_NAME}))?\s*(?:<[^;{{}}()]*>)?\s*(?:(?:extends|implements)\b[^;{{}}]*)?$")
_CASE = re.compile(rf"(?:^|\n)[ \t]*(?:case\b[^\n]*|(?:{_NAME})\s*):\s*$")
_BEFORE_OBJECT = re.compile(r"(?<![\w$.])(?:return|default|typeof|yield|await|throw|in|of|void|delete|as|satisfies|extends)$")
_TYPE = r"(?:[\w$.]+(?:\s*<[^;{}()=]*>)?(?:\s*\.\s*[\w$]+(?:\s*<[^;{}()=]*>)?)*(?:\s*\[\s*\])*)"
_JAVA_METHOD = re.compile(rf"(?:<[^;{{}}()=]*>\s*)?(?:(?!(?:new|return|throw|else|case|package|import)\b)(?:{_ANNOTATION}\s*)*{_TYPE}\s+)?({_NAME})\s*\(")
_TS_FUNCTION = re.compile(rf"function\b\s*\*?\s*({_NAME})\s*(?:<[^;{{}}()]*>)?\s*\(")
_TS_METHOD = re.compile(rf"\*?\s*(#?(?:{_NAME}))\s*[?!]?\s*(?:<[^;{{}}()]*>)?\s*\(")
_NOT_NAMES = frozenset("if for while switch catch return new throw do else try synchronized assert super this function typeof await yield".split())


def _masked(text: str, t: Tokens) -> tuple[str, list[tuple[int, int]]]:
    """(text with strings and comments blanked, the comments' places)."""
    out, comments, at = [], [], 0
    for k, v, p in zip(t.kind, t.val, t.pos):
        gap = text[at:p]
        if v == '""' and text.startswith('"""', p):  # a text block
            v = text[p : text.index('"""', _closing(text, p + 3)) + 3]
        if gap.strip():
            out.append(_blank_comments(gap, at, comments))
        else:
            out.append(gap)
        out.append(re.sub(r"[^\n]", " ", v) if k in ("tmpl", "head", "mid", "tail", "regex") else "0" * len(v) if k in ("str", "num") and "\n" not in v else re.sub(r"[^\n]", " ", v) if k == "str" else v)
        at = p + len(v)
    out.append(_blank_comments(text[at:], at, comments))
    return "".join(out), comments


def _closing(text: str, at: int) -> int:
    """Where the text block's end sign stands."""
    while not text.startswith('"""', at):
        at += 2 if text[at] == "\\" else 1
    return at


_COMMENT = re.compile(r"/\*[\s\S]*?\*/|//[^\r\n]*")


def _blank_comments(gap: str, at: int, comments: list[tuple[int, int]]) -> str:
    def blank(m: re.Match) -> str:
        comments.append((at + m.start(), at + m.end()))
        return "\n".join(" " * len(x) for x in m[0].split("\n"))

    return _COMMENT.sub(blank, gap)


class _Open(NamedTuple):
    kind: str  # type, enum (Java's, up to the end of its constants), object, body, other
    names: tuple[str, ...]
    found: int  # its place in the list of declarations, or -1
    outer: tuple = ()  # begin, opens, piece and groups around a brace inside of brackets


def braced(text: str, lang: str, tokens: Tokens | None = None) -> list[Found]:
    """The functions and methods of a Java or TypeScript file, from a stack of braces."""
    mask, comments = _masked(text, tokens or lex(text, lang))
    out: list[list] = []
    stack = [_Open("file", (), -1)]
    begin, i, c = 0, 0, 0
    opens: list[tuple[int, int]] = []  # the open brackets since begin, each with the piece around it
    piece = 0  # where the argument or element begins that is being read inside of brackets
    closed = (0, 0)  # the last bracket that was closed, and where
    groups: list[tuple[int, int]] = []  # the outermost closed brackets since begin
    delimiter = re.compile(r"[(){};,\[\]\n]")

    def declared(end: int) -> tuple[str, str, int] | None:
        """(kind, name, begin) of the header mask[begin:end]; outside of types it may follow a statement without a semicolon."""
        got = header(begin, end)
        at, k = end, len(groups)
        while not got and lang == "typescript" and stack[-1].kind not in ("type", "object") and (at := mask.rfind("\n", begin, at)) >= 0:
            while k and groups[k - 1][0] >= at:
                k -= 1
            if k and at < groups[k - 1][1]:  # a line inside of brackets
                at = groups[k - 1][0]
            else:
                got = header(at, end)
        return got

    def other(start: int, at: int) -> str:
        """The kind of the brace at at, which no declaration stands before."""
        head = mask[start:at].rstrip()
        first = opens[-1][0] if opens else begin  # commas of type arguments end pieces, too
        if lang == "java":
            if stack[-1].kind == "enum" and not opens:
                return "type"
            if not head.endswith(")") or closed[1] != start + len(head):
                return "other"
            for sign in "(){}":
                first = max(first, mask.rfind(sign, first, closed[0]) + 1)
            return "type" if _NEW.search(mask[first : closed[0]]) else "other"
        first = mask.rfind("class", max(first, mask.rfind("}", first, at)), at)
        if first >= 0 and _CLASS_VALUE.match(mask, first, at):
            return "type"
        if not head:
            return "object" if opens else "other"
        if head[-1] == ":":
            return "other" if not opens and stack[-1].kind not in ("type", "object") and _CASE.search(head) else "object"
        if head.endswith("=>"):
            return "other"
        return "object" if head[-1] in "=(,[?&|<!+-*/%^~." or _BEFORE_OBJECT.search(head) else "other"

    def header(begin: int, end: int) -> tuple[str, str, int] | None:
        lead = _LEAD[lang].match(mask, begin, end)
        at = lead.end()
        m = _TYPE_WORD[lang].match(mask, at, end)
        if m:
            kind = "body" if _SPACE.match(m[0]) else "enum" if lang == "java" and m[0].startswith("enum") else "type"
            return kind, m[1], at
        top = stack[-1].kind
        if lang == "java":
            m = _JAVA_METHOD.match(mask, at, end) if top == "type" else None
        else:
            m = _TS_METHOD.match(mask, at, end) if top in ("type", "object") else _TS_FUNCTION.match(mask, at, end)
        if m and m[1] not in _NOT_NAMES:
            return "function", m[1], at
        return None

    def add(name: str, at: int, end: int) -> int:
        nonlocal c
        first = begin + len(mask[begin:at]) - len(mask[begin:at].lstrip()) if mask[begin:at].strip() else at
        near = [x for x in _before(comments, at) if x[0] >= begin]
        doc = None
        if near and text.startswith("/**", near[-1][0]) and near[-1][1] - near[-1][0] >= 5 and _LEAD[lang].fullmatch(mask, near[-1][1], at):
            doc = block_text(text[near[-1][0] : near[-1][1]])
        out.append([".".join((*stack[-1].names, name)), first, end, doc])
        return len(out) - 1

    while True:
        m = delimiter.search(mask, i)
        if not m:
            break
        ch, at = m[0], m.start()
        i = at + 1
        if ch in "([":
            opens.append((at, piece))
            piece = i
        elif ch in ")]":
            if opens:
                first, piece = opens.pop()
                closed = (first, i)
                if not opens:
                    groups.append(closed)
        elif ch == "{":
            if opens:  # a body or an object inside of brackets
                stack.append(_Open(other(piece, at), stack[-1].names, -1, (begin, opens, piece, groups)))
                begin, opens, groups = i, [], []
                continue
            head = mask[begin:at]
            if lang == "typescript" and stack[-1].kind in ("type", "object", "file", "body") and re.search(r"\)\s*:[^=]*[:|&<]\s*$|\)\s*:\s*$", head) and declared(at):
                i = _skip(mask, at)  # the type of the result
                continue
            d = declared(at) if stack[-1].kind != "enum" else None
            if d and "=" not in _outside(mask[d[2] : at]):
                kind, name, where = d
                f = add(name, where, at) if kind == "function" else -1
                stack.append(_Open("body" if kind == "function" else kind, (*stack[-1].names, name), f))
            else:
                stack.append(_Open(other(begin, at), stack[-1].names, -1))
            begin, groups = i, []
        elif ch == "}":
            opens = []
            if len(stack) > 1:
                _ends(mask, begin, at, stack, declared, add, lang)
                o = stack.pop()
                if o.found >= 0:
                    out[o.found][2] = i
                if o.outer:
                    begin, opens, piece, groups = o.outer
                    continue
            begin, groups = i, []
        elif opens:
            if ch == ",":
                piece = i
        elif ch == ";" or (ch == "," and lang == "typescript" and stack[-1].kind in ("type", "object")):
            _ends(mask, begin, at, stack, declared, add, lang)
            if stack[-1].kind == "enum":
                stack[-1] = stack[-1]._replace(kind="type")
            begin, groups = i, []
        elif ch == "\n" and lang == "typescript" and stack[-1].kind == "type" and _line_ends(mask, begin, at):
            _ends(mask, begin, at, stack, declared, add, lang)
            begin, groups = i, []
    return [Found(*x) for x in out]


def _before(comments: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
    """The last few comments that end at or before at."""
    lo, hi = 0, len(comments)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if comments[mid][1] <= at else (lo, mid)
    return comments[max(0, lo - 2) : lo]


def _ends(mask, begin, at, stack, declared, add, lang) -> None:
    """A declaration without a body, if the header mask[begin:at] is one."""
    if not mask[begin:at].strip():
        return
    if stack[-1].kind == "type" or (lang == "typescript" and stack[-1].kind != "object"):
        d = declared(at)
        if d and d[0] == "function" and "=" not in _outside(mask[d[2] : at]):
            add(d[1], d[2], at + 1)


def _outside(head: str) -> str:
    """head without arrows and what stands in brackets."""
    head = head.replace("=>", "")
    while True:
        x = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>", "", head)
        if x == head:
            return x
        head = x


def _line_ends(mask: str, begin: int, at: int) -> bool:
    """Whether a member without a semicolon ends at this line feed."""
    head = mask[begin:at].strip()
    if not head or _LEAD["typescript"].fullmatch(head + " ") or head[-1] in "=,|&:?.<({[+-*/":
        return False
    return not re.match(r"\s*(?:[{|&:?=.,)\]>+*/-]|extends\b|implements\b)", mask[at : at + 200])


_BRACES = re.compile(r"[{}]")


def _skip(mask: str, at: int) -> int:
    """Behind the brace that closes the one at at."""
    depth = 0
    for m in _BRACES.finditer(mask, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(mask)


# --- Python
_PY_LITERAL = re.compile(
    r"#[^\n]*|((?:(?<!\w)[rRbBuUfF]{1,2})?)(\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
)
_PY_DECLARED = re.compile(r"^([ \t\f]*)(?:(?:async[ \t]+)?def|(class))[ \t]+(\w+)", re.M)


def indented(text: str) -> list[Found]:
    """The functions and methods of a Python file, from a stack of indentations."""
    strings: list[tuple[int, int, str]] = []

    def blank(m: re.Match) -> str:
        if m[2] is not None:
            strings.append((m.start(), m.end(), m[1].lower()))
            return '"' * len(m[0])
        return " " * len(m[0])

    mask = _PY_LITERAL.sub(blank, text)
    starts = {s: (e, p) for s, e, p in strings}
    inside = bytearray(len(mask) + 1)  # lines that begin inside of brackets
    depth = 0
    for m in re.finditer(r"[()\[\]{}]|\n", mask):
        if m[0] == "\n":
            inside[m.end()] = depth > 0 or mask[m.start() - 1 : m.start()] == "\\"
        else:
            depth = depth + 1 if m[0] in "([{" else max(0, depth - 1)
    out: list[list] = []
    stack: list[tuple[int, str, int]] = []
    events = [(m.start(), m) for m in _PY_DECLARED.finditer(mask) if not inside[m.start()]]
    k = 0
    for line in re.finditer(r"^([ \t\f]*)(?=[^\s#])", mask, re.M):
        if inside[line.start()]:
            continue
        width = len(line[1].replace("\f", "").expandtabs(8))
        while stack and width <= stack[-1][0]:
            _, _, f = stack.pop()
            if f >= 0:
                out[f][2] = line.start()
        if k < len(events) and events[k][0] == line.start():
            m = events[k][1]
            k += 1
            f = -1
            if not m[2]:
                f = len(out)
                out.append([".".join((*(s[1] for s in stack), m[3])), m.start(), len(text), _docstring(text, mask, starts, inside, m.end())])
            stack.append((width, m[3], f))
    return [Found(*x) for x in out]


_SIGNS, _BLANKS, _JOINED = re.compile(r"[()\[\]{}:]"), re.compile(r"\s*"), re.compile(r"[ \t\f]*(?:\\\n[ \t\f]*)*")


def _docstring(text: str, mask: str, starts: dict[int, tuple[int, str]], inside: bytearray, at: int) -> str | None:
    """The string that is the first statement of the body after the header whose name ends at at."""
    depth = 0
    for m in _SIGNS.finditer(mask, at):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
        elif not depth:
            at = m.end()
            break
    else:
        return None
    at = _BLANKS.match(mask, at).end()
    parts = []
    while at in starts:
        end, prefix = starts[at]
        if "b" in prefix or "f" in prefix:
            return None
        parts.append(text[at:end])
        at = _JOINED.match(mask, end).end()
    if not parts or (at < len(mask) and mask[at] not in "\n;"):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return "".join(ast.literal_eval(p) if "\\" in p else _plain(p) for p in parts)
    except (SyntaxError, ValueError):
        return None


def _plain(literal: str) -> str:
    """The text of a string literal without escapes."""
    s = literal.lstrip("rRuU")
    return s[3:-3] if s[:3] in ('"""', "'''") else s[1:-1]


def module_name(text: str, path: str, lang: str) -> str:
    """The package in Java, the path without extension and with dots elsewhere."""
    if lang == "java":
        m = re.match(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/|@[\w.]+)*package\s+([\w$.\s]+?)\s*;", text)
        return re.sub(r"\s", "", m[1]) if m else ""
    return re.sub(r"\.[^./]*$", "", path or "").replace("/", ".")


def pairs(text: str, path: str, lang: str) -> list[tuple[str, str, str]]:
    """(qualified_name, code, description) of every function with a non-trivial comment; none in a broken file."""
    text = text.removeprefix("﻿")
    if lang == "python":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        found = indented(text) if parses(text, lang, CHUNK_CHARS) else []
    else:
        tokens = valid_tokens(text, lang, CHUNK_CHARS)
        found = [] if tokens is None else braced(text, lang, tokens)
    module = module_name(text, path, lang)
    out = []
    for f in found:
        if f.comment is None:
            continue
        d = description(f.comment)
        if not trivial(d, f.name.rpartition(".")[2]):
            out.append((f"{module}.{f.name}" if module else f.name, text[f.begin : f.end].rstrip(), d))
    return out


def _paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [[{"qualified_name": q, "code": c, "description": d} for q, c, d in pairs(t, p, lang)] for t, p, lang in zip(b["content"], b["path"], b["lang"])]
        yield b[["file_id", "repository_id", "lang", "indexed_at"]].assign(pairs=got)


def documented_functions(files: DataFrame) -> DataFrame:
    """(file_id, repository_id, language, qualified_name, code, description): one row per documented declaration.

    Files without text, in other languages or that do not parse give none. Of redelivered files the latest row holds.
    Declarations of one qualified name (overloads) give one row each with its own code. Null paths leave the module
    name out.
    """
    rows = files.select(
        norm_id("file_id").alias("file_id"), norm_id("repository_id").alias("repository_id"), F.lower(F.trim("language")).alias("lang"),
        norm_path("path").alias("path"), "content", F.col("indexed_at").cast("timestamp").alias("indexed_at"),
    ).where(F.col("content").isNotNull() & F.col("lang").isin(*LANGUAGES) & F.col("file_id").isNotNull())
    got = spread(rows).mapInPandas(
        _paired, "file_id string, repository_id string, lang string, indexed_at timestamp, pairs array<struct<qualified_name:string,code:string,description:string>>"
    )
    return (
        got.groupBy("file_id")
        .agg(F.max(F.struct("indexed_at", "repository_id", "lang", "pairs")).alias("m"))
        .select("file_id", "m.repository_id", F.col("m.lang").alias("language"), F.explode("m.pairs").alias("p"))
        .select("file_id", "repository_id", "language", "p.qualified_name", "p.code", "p.description")
    )
