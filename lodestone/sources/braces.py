"""Java and TypeScript sources to entity and reference rows, from a stack of braces over text whose strings are blank.

It reads declarations, not statements: what a body does is skipped, apart from the types and functions in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_PLAIN = re.compile(r"""[^"'`/]+""")
_STRING = re.compile(r'"(?:[^"\\\r\n]|\\[\s\S])*"?|\'(?:[^\'\\\r\n]|\\[\s\S])*\'?')
_TEXT_BLOCK = re.compile(r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*(?:"""|$)')
_COMMENT = re.compile(r"//[^\r\n]*|/\*[\s\S]*?(?:\*/|$)")
_REGEX = re.compile(r"/(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-z]*")
_MARK = re.compile(r"[{};()\[\]]")
_INNERMOST = re.compile(r"\([^()]*\)")
_ANNOTATION = re.compile(r"@(?!interface\b)[\w$.]+(?:\s*\(\))?")
_MODIFIER = r"(?:public|private|protected|static|final|abstract|synchronized|native|strictfp|default|sealed|non-sealed|transient|volatile|export|declare|async|readonly|override|get|set|accessor)\s+"
_JAVA_TYPE = re.compile(r"(?:^|\s)(class|interface|enum|record|@interface)\s+([\w$]+)")
_TS_TYPE = re.compile(r"(?:^|\s)(class|interface|enum|namespace|module)\s+([\w$.]+)")
_JAVA_METHOD = re.compile(rf"^(?:{_MODIFIER})*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>\s*)?(?:([\w$.<>\[\],?&\s]+?)\s+)?([\w$]+)\s*\(\)[^=]*$")
_TS_FUNCTION = re.compile(r"(?:^|\s)function\s*\*?\s*([\w$]+)\s*(?:<.*>)?\(\)")
_TS_ARROW = re.compile(r"(?:^|\s)(?:const|let|var)\s+([\w$]+)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:<.*>\s*)?(?:\(\)|[\w$]+)\s*(?::[^=]*)?=>\s*$")
_TS_METHOD = re.compile(rf"^(?:{_MODIFIER})*\*?\s*(#?[\w$]+)\s*[?!]?\s*(?:<.*>)?\(\)\s*(?::.*)?$")
_TS_FIELD = re.compile(rf"^(?:{_MODIFIER})*(#?[\w$]+)\s*[?!]?\s*(?::([^=]*))?(?:=.*)?$", re.S)
_JAVA_FIELD = re.compile(rf"^(?:{_MODIFIER})*([\w$.<>\[\],?&\s]+?)\s+([\w$]+)\s*(?:\[\s*\])*\s*(?:[=,].*)?$", re.S)
_NO_NAMES = frozenset(("if", "for", "while", "switch", "catch", "synchronized", "return", "new", "throw", "else", "do", "try", "with", "function", "await", "yield", "case", "super", "this"))
_TS_IMPORT = re.compile(r"(?:^|[;\n])\s*(?:import|export)\s+(?:type\s+)?([\w$*{}\s,]+?)\s+from\s*(?=['\"])|(?:^|[;\n])\s*import\s*(?=['\"])")
_JAVA_IMPORT = re.compile(r"(?:^|(?<=[;\n]))\s*import\s+(?:static\s+)?([\w$.]+(?:\.\*)?)\s*;")
_PACKAGE = re.compile(r"(?:^|[;\n])\s*package\s+([\w$.]+)\s*;")
_NEAR_DOC = re.compile(r"(?:\s*@[\w$.]+\s*(?:\((?:[^()]|\([^()]*\))*\))?)*[\s\w$<>.,?\[\]&*#@]*")


class _Frame(NamedTuple):
    kind: str  # file, type, enum, interface or other
    owner: str
    row: int


def blanked(text: str, lang: str) -> tuple[str, list[tuple[int, int]]]:
    """(text with strings' insides and comments as blanks, places of documentation comments)."""
    out, docs, i, n, last = [], [], 0, len(text), "\n"
    while i < n:
        m = _PLAIN.match(text, i)
        if m:
            out.append(m[0])
            i = m.end()
            last = m[0].rstrip(" \t")[-1:] or last
            continue
        c = text[i]
        m = _COMMENT.match(text, i)
        if m:
            if m[0].startswith("/**") and len(m[0]) > 4:
                docs.append((i, m.end()))
        elif c == "/":
            m = _REGEX.match(text, i) if lang == "typescript" and last in "=(,:;!&|?{}[\n+" else None
            if not m:
                out.append(c)
                i, last = i + 1, c
                continue
        elif c == "`" and lang == "typescript":
            end = _template_end(text, i)
            out.append(re.sub(r"[^\n]", " ", text[i:end]))
            i, last = end, "x"
            continue
        else:
            m = (_TEXT_BLOCK.match(text, i) if lang == "java" else None) or _STRING.match(text, i)
            if m is None:
                out.append(" ")
                i += 1
                continue
            inside = re.sub(r"[^\n]", " ", m[0][1:-1]) if len(m[0]) > 1 else ""
            out.append(m[0][0] + inside + (m[0][-1] if len(m[0]) > 1 else ""))
            i, last = m.end(), "x"
            continue
        out.append(re.sub(r"[^\n]", " ", m[0]))
        i = m.end()
    return "".join(out), docs


def _template_end(text: str, at: int) -> int:
    """Behind the template that begins at at; its parts may hold templates."""
    stack, i, n = ["`"], at + 1, len(text)
    while stack and i < n:
        c = text[i]
        if c == "\\":
            i += 1
        elif stack[-1] == "`":
            if c == "`":
                stack.pop()
            elif c == "$" and text[i + 1 : i + 2] == "{":
                stack.append("{")
                i += 1
        elif c == "`":
            stack.append("`")
        elif c == "{":
            stack.append("{")
        elif c == "}":
            stack.pop()
        i += 1
    return i


def _collapsed(header: str) -> str:
    """header without what stands in round brackets, and without annotations."""
    while True:
        x = _INNERMOST.sub("\0", header)
        if x == header:
            break
        header = x
    return _ANNOTATION.sub(" ", header.replace("\0", "()")).strip()


def _parts(text: str) -> list[str]:
    """The pieces between commas outside of brackets."""
    out, depth, now = [], 0, ""
    for k, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ")]}" or (c == ">" and text[k - 1 : k] != "="):
            depth -= 1
        if c == "," and depth <= 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*out, now] if p.strip()]


def _bases(header: str) -> Iterator[tuple[str, str]]:
    for kind in ("extends", "implements"):
        m = re.search(rf"\b{kind}\b\s+(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", re.sub(r"^[^{]*?\b(?:class|interface|enum|record)\s+[\w$]+\s*(?:<.*?>(?=\s*(?:extends|implements|\(|$)))?", "", header), re.S)
        for p in _parts(m[1]) if m else ():
            name = re.sub(r"<.*", "", p, flags=re.S).strip()
            if name.strip("() "):
                yield kind, name


def _visibility(head: str, lang: str, name: str) -> str | None:
    m = re.search(r"\b(public|private|protected)\b", head)
    return m[1] if m else "private" if name.startswith("#") else "package" if lang == "java" else None


def rows_of(file_id: str, module: str, text: str, lang: str) -> Iterator[tuple]:
    """Rows of parsing.ENTITY: the module, its types, functions, methods, constructors, fields and parameters, imports and bases, a diagnostic for a brace that isn't paired.

    The module is the package in Java. A type alias is a type without members. Anonymous classes, object literals and
    functions inside of brackets give no rows; functions and types in a body belong to what the body does.
    """
    mask, docs = blanked(text, lang)
    lines = [i for i, c in enumerate(text) if c == "\n"]

    def line(at: int) -> int:
        lo, hi = 0, len(lines)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if lines[mid] < at else (lo, mid)
        return lo + 1

    package = _PACKAGE.search(mask) if lang == "java" else None
    module = package[1] if package else "" if lang == "java" else module
    join = lambda a, b: f"{a}.{b}" if a else b
    out: list[list] = [[file_id, "entity", "module", module.rpartition(".")[2], module, None, None, None, False, False, None, 1, max(1, line(len(text) - 1)), None]]
    for m in (_JAVA_IMPORT if lang == "java" else _TS_IMPORT).finditer(mask):
        target = m[1] if lang == "java" else text[m.end() + 1 : (mask.find(text[m.end()], m.end() + 1))]
        out.append([file_id, "reference", "import", None, module, None, None, None, None, None, None, line(m.end()), None, target])

    def doc(begin: int, at: int, name: str) -> str | None:
        """The last comment before at, if only annotations, modifiers and types stand between it and the name."""
        for a, b in reversed(docs):
            if b <= at:
                m = re.compile(rf"(?<![\w$]){re.escape(name)}(?![\w$])").search(mask, b, at) if a >= begin else None
                return text[a:b] if m and _NEAR_DOC.fullmatch(mask, b, m.start()) else None
        return None

    def declare(kind: str, name: str, owner: str, begin: int, at: int, end: int, head: str) -> int:
        comment = doc(begin, at, name)
        if lang == "typescript":  # statements before it may have ended without a semicolon
            here = [m.start() for m in re.finditer(rf"(?<![\w$#]){re.escape(name)}(?=\s*[?!]?\s*(?:<[^()]*>)?\s*[(:={{]|\s+(?:extends|implements)\b|\s*$)", mask[begin:at])]
            if here:
                first_line = mask.rfind("\n", begin, begin + (here[0] if kind in ("method", "constructor", "variable") else here[-1]))
                begin = max(begin, first_line)
        first = begin + len(mask[begin:at]) - len(mask[begin:at].lstrip())
        sign = " ".join(mask[first:at].split())
        out.append([file_id, "entity", kind, name, join(owner, name), owner or None, comment, sign, bool(re.search(r"\basync\b", head)), bool(re.search(r"\bstatic\b", head)), _visibility(head, lang, name), line(first), line(end), None])
        return len(out) - 1

    def parameters(owner: str, header_begin: int, at: int) -> None:
        own = re.compile(rf"(?<![\w$#@.]){re.escape(owner.rpartition('.')[2])}(?![\w$])").search(mask, header_begin, at)
        a = mask.find("(", own.end() if own else header_begin, at)
        depth, b = 0, a
        while 0 <= a <= b < at:
            depth += {"(": 1, ")": -1}.get(mask[b], 0)
            if not depth:
                break
            b += 1
        for p in _parts(_ANNOTATION.sub(" ", mask[a + 1 : b])) if a >= 0 else ():
            m = re.match(r"(?:(?:public|private|protected|readonly|override)\s+)*(?:\.\.\.)?([\w$]+)\s*\??\s*(?::\s*([^=]*))?", p) if lang == "typescript" else re.match(r"(?:final\s+)?(.+?)\s*(?:\.\.\.)?\s*\b([\w$]+)(?:\s*\[\s*\])*$", p, re.S)
            if m:
                name, kind = (m[1], m[2]) if lang == "typescript" else (m[2], m[1])
                out.append([file_id, "parameter", None, name, join(owner, name), owner, None, p, None, None, None, line(a), line(b), kind.strip() if kind else None])

    def header(begin: int, at: int, top: _Frame) -> tuple[str, str, str] | None:
        """(kind, name, collapsed header) of a declaration that ends at at."""
        head = _collapsed(mask[begin:at])
        if lang == "typescript" and top.kind not in ("file", "other"):
            head = head.rpartition("\n")[2].strip() if "\n" in head and not re.search(r"\b(?:class|interface)\b", head) else head
        m = (_JAVA_TYPE if lang == "java" else _TS_TYPE).search(head)
        if m and "=" not in head[: m.start()] and (lang == "java" or top.kind in ("file", "other", "space")):
            return {"record": "class", "@interface": "interface", "namespace": "module"}.get(m[1], m[1]), m[2], head
        if lang == "java":
            m = _JAVA_METHOD.match(head) if top.kind in ("class", "interface") else None
            if m and m[2] not in _NO_NAMES and (m[1] or m[2] == top.owner.rpartition(".")[2]) and (m[1] or "").split(" ")[0] not in _NO_NAMES:
                return "constructor" if not m[1] or re.fullmatch(rf"(?:{_MODIFIER})*", m[1] + " ") else "method", m[2], head
            return None
        if top.kind in ("class", "interface"):
            m = _TS_METHOD.match(head)
            return ("constructor" if m[1] == "constructor" else "method", m[1], head) if m and m[1] not in _NO_NAMES else None
        m = _TS_FUNCTION.search(head) or _TS_ARROW.search(head)
        return ("function", m[1], head) if m else None

    def fields(begin: int, at: int, top: _Frame) -> None:
        head = _collapsed(mask[begin:at])
        m = (_JAVA_FIELD if lang == "java" else _TS_FIELD).match(head)
        if m and (name := m[2] if lang == "java" else m[1]) not in _NO_NAMES:
            declare("variable", name, top.owner, begin, at, at, head)
            for p in _parts(head)[1:] if lang == "java" else ():
                if more := re.match(r"([\w$]+)\s*(?:\[\s*\])*\s*(?:=|$)", p):
                    declare("variable", more[1], top.owner, begin, at, at, head)

    def lines_before(begin: int, at: int, top: _Frame) -> int:
        """Members of a TypeScript class that end with their line; gives the begin of what is left."""
        if lang != "typescript" or top.kind not in ("class", "interface"):
            return begin
        deep, first = 0, begin
        for k in range(begin, at):
            c = mask[k]
            deep += 1 if c in "([" else -1 if c in ")]" else 0
            if c == "\n" and not deep and mask[first:k].strip():
                rest = mask[k:at].lstrip()
                if not re.search(r"[=:|&,<(+?.@]\s*$|\b(?:static|readonly|abstract|async|public|private|protected|declare|override)\s*$", mask[first:k]) and not _ANNOTATION.fullmatch(_INNERMOST.sub("()", mask[first:k]).strip()) and rest[:1] not in "=:|&?.,":
                    ends(first, k, top)
                    first = k
        return first

    def ends(begin: int, at: int, top: _Frame) -> None:
        """A member or overload without a body."""
        if not mask[begin:at].strip() or top.kind not in ("class", "interface", "file"):
            return
        got = header(begin, at, top)
        if got and got[0] in ("method", "constructor", "function") and not re.search(r"=(?!>)", got[2].partition("(")[0]):
            f = declare(got[0], got[1], top.owner, begin, at, at, got[2])
            parameters(out[f][4], begin, at)
        elif top.kind != "file":
            fields(begin, at, top)

    stack = [_Frame("file", module, 0)]
    begin = i = depth = 0
    opened: list[int] = []
    while m := _MARK.search(mask, i):
        at, c, i = m.start(), m[0], m.end()
        top = stack[-1]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == "{" and (depth or (lang == "typescript" and re.search(r"\)\s*:\s*$|[=:|&<,]\s*$", mask[begin:at]) and not mask[begin:at].rstrip().endswith("=>")) or (lang == "java" and re.search(r"[=\]]\s*$", mask[begin:at]))):
            level = 1  # a value or a type: skipped as a whole
            while level and (m := re.compile(r"[{}]").search(mask, i)):
                level += 1 if m[0] == "{" else -1
                i = m.end()
            if level:
                opened.append(at)
                break
        elif c == "{":
            begin = lines_before(begin, at, top)
            got = header(begin, at, top)
            opened.append(at)
            if not got and lang == "typescript" and top.kind == "class" and "=" in mask[begin:at]:
                fields(begin, at, top)
            if got:
                kind, name, head = got
                f = declare(kind, name, top.owner, begin, at, at, head)
                if kind in ("method", "constructor", "function"):
                    parameters(out[f][4], begin, at)
                else:
                    out.extend([file_id, "reference", k, None, out[f][4], None, None, None, None, None, None, line(at), None, b] for k, b in _bases(head))
                stack.append(_Frame({"module": "file", "enum": "enum"}.get(kind, kind) if kind in ("class", "interface", "enum", "module") else "other", out[f][4], f))
            else:
                stack.append(_Frame("other", top.owner, -1))
            begin = i
        elif c == "}":
            if len(stack) > 1:
                ends(lines_before(begin, at, top), at, top)
                done = stack.pop()
                opened.pop()
                if done.row >= 0:
                    out[done.row][12] = line(at)
            else:
                out.append([file_id, "diagnostic", "syntax_error", "unpaired", None, None, "a brace that nothing opens", None, None, None, None, line(at), None, None])
            begin = i
        elif c == ";" and not depth:
            if top.kind == "enum":
                stack[-1] = top._replace(kind="class")  # behind the constants come members
            else:
                ends(lines_before(begin, at, top), at, top)
            begin = i
        if lang == "typescript" and c == "}" and not depth:
            begin = i
    if len(stack) > 1 or opened or depth:
        out.append([file_id, "diagnostic", "syntax_error", "unpaired", None, None, "a bracket that nothing closes", None, None, None, None, line(opened[-1] if opened else len(text) - 1), None, None])
    if lang == "typescript":
        for m in re.finditer(r"(?:^|[;\n}])\s*(?:export\s+)?type\s+([\w$]+)\s*(?:<[^=]*>)?\s*=", mask):
            out.append([file_id, "entity", "type", m[1], join(module, m[1]), module or None, None, None, False, False, None, line(m.end()), line(m.end()), None])
    yield from map(tuple, out)
