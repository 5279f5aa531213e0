"""Lexers for Java and TypeScript, and the summaries of file chunks.

A chunk of a file is a map from the lexer state at its begin to the state at its end, with the brackets that it leaves
open or closes for others. Two neighbouring chunks combine into one, associatively, so a file's chunks can be reduced
in any grouping, on any executors.

In TypeScript a closing brace that a chunk doesn't open itself may end a block or the part of a template, which only the
chunks before it know. The chunk's map then has a node for either case, named by the place behind the brace.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Lexer states that may hold at a chunk's begin (chunks begin after a line feed, where strings and // comments end).
CODE, COMMENT, BLOCK_TEXT, BLOCK_TEXT_2 = "code", "comment", "text", "text2"
STATES = {"java": (CODE, COMMENT, BLOCK_TEXT), "typescript": (CODE, COMMENT, BLOCK_TEXT), "python": (CODE, BLOCK_TEXT, BLOCK_TEXT_2)}
CLOSES = {")": "(", "]": "[", "}": "{"}

_COMMON = r"""(?P<ws>[ \t\f\v ﻿\r\n  ]+)|(?P<line>//[^\r\n  ]*)|(?P<block>/\*)"""
_JAVA = re.compile(
    _COMMON
    + r"""|(?P<text>\"\"\"[ \t\f]*\r?\n)|(?P<str>"(?:[^"\\\r\n]|\\[^\r\n])*")|(?P<chr>'(?:[^'\\\r\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[^\r\n])')"""
    + r"""|(?P<num>0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?[0-9_]+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[lLfFdD]?)"""
    + r"""|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\.\.\.|<<=|<<|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|[(){}\[\];,.@=<>!~?:+\-*/&|^%])"""
)
_TS = re.compile(
    _COMMON
    + r"""|(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')|(?P<tick>`)"""
    + r"""|(?P<num>(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)n?)"""
    + r"""|(?P<id>\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4})*)"""
    + r"""|(?P<op>=>|\.\.\.|===|!==|==|!=|\*\*=|\*\*|<<=|<<|&&=|\|\|=|\?\?=|\?\?|\?\.(?![0-9])|\+\+|--|&&|\|\||[<>+\-*/%&|^]=|[(){}\[\];,.@=<>!~?:+\-*/&|^%])"""
)
_MASTER = {"java": _JAVA, "typescript": _TS}
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_TEXT_END = re.compile(r"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case do else in of instanceof new delete void throw await yield".split())


class BadLex(Exception):
    """No token begins here."""


class Tokens(NamedTuple):
    kind: list[str]  # id, num, str, op, tmpl, regex, and head, mid, tail of a template with parts
    val: list[str]
    pos: list[int]
    new_line: list[bool]  # a line feed stands before it
    state: str  # after the last
    templates: tuple[int, ...]  # depth of brackets at each open ${
    stop: int = 0  # behind the brace at which lexing stopped


def lex(text: str, lang: str, state: str = CODE, at: int = 0, stop: bool = False) -> Tokens:
    """The tokens of text from at, entered in the given state, with stop up to the first closing brace opened before. BadLex where none fits."""
    master, kind, val, pos, new_line = _MASTER[lang], [], [], [], []
    i, n, fresh, depth, open_at = at, len(text), True, 0, []
    if state == CODE and not at and text.startswith("#!") and lang == "typescript":
        i = (text.find("\n") + 1) or n

    def add(k: str, v: str, p: int) -> None:
        nonlocal fresh
        kind.append(k)
        val.append(v)
        pos.append(p)
        new_line.append(fresh)
        fresh = False

    def template(at: int, first: bool) -> int:
        nonlocal state
        m = _TEMPLATE.match(text, at)
        if not m:
            state = BLOCK_TEXT
            return n
        p = max(0, at - 1)  # with the sign before it
        if m[1] == "`":
            add("tmpl" if first else "tail", text[p : m.end()], p)
        else:
            add("head" if first else "mid", text[p : m.end()], p)
            open_at.append(depth)
        return m.end()

    if state == COMMENT:
        e = text.find("*/", at)
        if e < 0:
            return Tokens(kind, val, pos, new_line, COMMENT, ())
        i, state = e + 2, CODE
    elif state == BLOCK_TEXT:
        state = CODE
        if lang == "typescript":
            i = template(at, True)
        else:
            m = _TEXT_END.match(text)
            if not m:
                return Tokens(kind, val, pos, new_line, BLOCK_TEXT, ())
            add("str", '""', 0)
            i = m.end()
    while i < n:
        if text[i] == " ":
            i += 1
            continue
        m = master.match(text, i)
        if not m:
            if text[i] == "\x1a" and i == n - 1:
                break
            raise BadLex(i)
        k, e = m.lastgroup, m.end()
        if k == "ws":
            fresh = fresh or "\n" in m[0] or "\r" in m[0] or " " in m[0]
        elif k == "block":
            end = text.find("*/", e)
            if end < 0:
                state = COMMENT
                break
            fresh = fresh or "\n" in text[e:end]
            e = end + 2
        elif k == "text":
            t = _TEXT_END.match(text, e)
            if not t:
                state = BLOCK_TEXT
                break
            add("str", '""', i)
            e = t.end()
        elif k == "tick":
            e = template(e, True)
        elif k == "op":
            v = m[0]
            if v in ("/", "/=") and lang == "typescript" and _regex_may_begin(kind, val, at):
                r = _REGEX.match(text, i)
                if not r:
                    raise BadLex(i)
                add("regex", r[0], i)
                e = r.end()
            elif v == "}" and open_at and open_at[-1] == depth:
                open_at.pop()
                e = template(e, False)
            elif v == "}" and stop and not depth and not open_at:
                return Tokens(kind, val, pos, new_line, "}", (), e)
            else:
                if v in "([{":
                    depth += 1
                elif v in ")]}":
                    depth = max(0, depth - 1)
                add("op", v, i)
        elif k != "line":
            if k == "num" and e < n and (text[e].isalnum() or text[e] in "_$"):
                raise BadLex(i)
            if k == "num" and lang == "typescript" and re.fullmatch(r"0[0-9]+", m[0]):
                raise BadLex(i)
            if k == "num" and lang == "java" and re.fullmatch(r"0[0-9_]*[89][0-9_]*[lL]?", m[0]):
                raise BadLex(i)
            add("str" if k == "chr" else k, m[0], i)
        i = e
    return Tokens(kind, val, pos, new_line, state, tuple(open_at))


def _regex_may_begin(kind: list[str], val: list[str], at: int) -> bool:
    if not kind:
        return not at  # elsewhere lexing begins behind a brace
    k, v = kind[-1], val[-1]
    if k == "op":
        return v not in (")", "]", "}", "++", "--")
    return k in ("head", "mid") or (k == "id" and v in _BEFORE_REGEX)


class Piece(NamedTuple):
    """A run of chunks entered in one state: the state after it, brackets it closes for others and leaves open.

    A run that stopped at a brace has the nodes from which it goes on: block for one that ends a block, part for one
    that ends the part of a template. It leaves nothing open then.
    """

    state: str
    closes: str
    opens: str
    bad: bool
    block: str = ""
    part: str = ""


def brackets(t: Tokens) -> tuple[str, str, bool]:
    """(closes, opens, bad) of a token run; an open ${ counts as $."""
    closes, opens, bad = [], [], False
    for k, v in zip(t.kind, t.val):
        if k == "head":
            opens.append("$")
        elif k in ("mid", "tail"):
            bad = bad or not opens or opens.pop() != "$"
            if k == "mid":
                opens.append("$")
        elif k == "op":
            if v in "([{":
                opens.append(v)
            elif v in ")]}":
                if opens:
                    bad = bad or opens.pop() != CLOSES[v]
                else:
                    closes.append(CLOSES[v])
    return "".join(closes), "".join(opens), bad


def summarise(text: str, lang: str, begin: int = 0) -> dict[str, Piece]:
    """The map of the chunk that begins at begin of its file: from each state that may hold there, and its nodes behind braces."""
    out: dict[str, Piece] = {}
    todo = [(s, 0) for s in (STATES[lang] if begin else (CODE,))]
    while todo:
        s, at = todo.pop()
        name = f"{s}@{begin + at}" if at else s
        if name in out:
            continue
        if lang == "python":
            out[name] = _python_piece(text, s)
            continue
        try:
            t = lex(text, lang, s, at, lang == "typescript")
        except BadLex:
            out[name] = Piece(CODE, "", "", True)
            continue
        closes, opens, bad = brackets(t)
        if t.stop:
            out[name] = Piece(t.state, closes, "", bad, f"{CODE}@{begin + t.stop}", f"{BLOCK_TEXT}@{begin + t.stop}")
            todo += [(CODE, t.stop), (BLOCK_TEXT, t.stop)]
        else:
            out[name] = Piece(t.state, closes, opens, bad)
    return out


_PY = re.compile(r"#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\"|'''|\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|$|(?=\n))|'(?:[^'\\\n]|\\[\s\S])*(?:'|$|(?=\n)))|[()\[\]{}]|\w+")
_PY_END = {BLOCK_TEXT: re.compile(r"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\""), BLOCK_TEXT_2: re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''")}


def _python_piece(text: str, state: str) -> Piece:
    i, closes, opens, bad = 0, [], [], False
    while True:
        if state != CODE:
            m = _PY_END[state].match(text, i)
            if not m:
                return Piece(state, "".join(closes), "".join(opens), bad)
            i, state = m.end(), CODE
        m = _PY.search(text, i)
        if not m:
            return Piece(CODE, "".join(closes), "".join(opens), bad)
        v, i = m[0], m.end()
        if v.endswith(('"""', "'''")) and len(v.lstrip("rRbBuUfF")) == 3:
            state = BLOCK_TEXT if v[-1] == '"' else BLOCK_TEXT_2
        elif v in "([{":
            opens.append(v)
        elif v in ")]}":
            if opens:
                bad = bad or opens.pop() != CLOSES[v]
            else:
                closes.append(CLOSES[v])


def _joined(x: Piece, b: dict[str, Piece]) -> Piece:
    """x, gone on through the map b."""
    if x.block:
        return x
    stack, closes, bad, y = list(x.opens), x.closes, x.bad, b[x.state]
    while True:
        bad = bad or y.bad
        for k, c in enumerate(y.closes):
            if not stack:
                closes += y.closes[k:]
                break
            bad = stack.pop() != c or bad
        if not y.block:
            return Piece(y.state, closes, "".join(stack) + y.opens, bad)
        if not stack:
            return Piece(y.state, closes, "", bad, y.block, y.part)
        c = stack.pop()
        bad = bad or c not in "{$"
        y = b[y.part if c == "$" else y.block]


def combine(a: dict[str, Piece], b: dict[str, Piece]) -> dict[str, Piece]:
    """The map of two neighbouring runs. Associative."""
    return {s: _joined(x, b) for s, x in a.items()} | {s: y for s, y in b.items() if "@" in s}


def verdict(m: dict[str, Piece]) -> bool:
    """Whether the whole file, entered in code, ends in code with all brackets paired."""
    p = m[CODE]
    return p.state == CODE and not p.closes and not p.opens and not p.bad


_NO_CUT = re.compile(r"[ \t]*/(?![/*])")


def cut(text: str, size: int) -> list[str]:
    """Chunks of about size characters whose join is text, each ending at a line feed that no backslash continues and that no line beginning with a slash follows."""
    out, i, n = [], 0, len(text)
    while n - i > size:
        e = text.find("\n", i + size)
        while e > 0 and (text[max(i, e - 2) : e].rstrip("\r").endswith("\\") or _NO_CUT.match(text, e + 1)):
            e = text.find("\n", e + 1)
        if e < 0 or e + 1 == n:
            break
        out.append(text[i : e + 1])
        i = e + 1
    return [*out, text[i:]]
