"""A recursive-descent parser for Java 17: says whether tokens form a compilation unit."""

from __future__ import annotations

from lodestone.llm.codelex import Tokens

# The language's keywords, literals, modifiers and operators.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null _".split()
)
PRIMITIVES = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}


class Bad(Exception):
    """The tokens don't fit the grammar."""


class Java:
    def __init__(self, t: Tokens):
        self.k, self.v, self.p = [*t.kind, "end", "end", "end", "end"], [*t.val, "", "", "", ""], [*t.pos, 0, 0, 0, 0]
        self.i = 0

    # --- tokens
    def at(self, *vals: str) -> bool:
        return self.v[self.i] in vals and self.k[self.i] in ("op", "id")

    def take(self, v: str) -> bool:
        if self.at(v):
            self.i += 1
            return True
        return False

    def need(self, v: str) -> None:
        if not self.take(v):
            raise Bad(self.i)

    def word(self) -> None:
        if self.k[self.i] != "id" or self.v[self.i] in KEYWORDS:
            raise Bad(self.i)
        self.i += 1

    def is_word(self, ahead: int = 0) -> bool:
        j = min(self.i + ahead, len(self.k) - 1)
        return self.k[j] == "id" and self.v[j] not in KEYWORDS

    def peek(self, ahead: int = 1) -> str:
        j = min(self.i + ahead, len(self.k) - 1)
        return self.v[j] if self.k[j] in ("op", "id") else ""

    def tries(self, f) -> bool:
        """f, or where it fails nothing."""
        i = self.i
        try:
            f()
            return True
        except Bad:
            self.i = i
            return False

    # --- declarations
    def unit(self) -> None:
        i = self.i
        self.modifiers()
        if self.at("package"):
            self.i += 1
            self.qualified()
            self.need(";")
        else:
            self.i = i
        while True:
            if self.take(";"):
                continue
            if not self.take("import"):
                break
            self.take("static")
            self.word()
            while self.take("."):
                if self.take("*"):
                    break
                self.word()
            self.need(";")
        while self.k[self.i] != "end":
            if not self.take(";"):
                self.modifiers()
                if not self.type_declaration():
                    raise Bad(self.i)

    def qualified(self) -> None:
        self.word()
        while self.take("."):
            self.word()

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.take("("):
            if not self.take(")"):
                while True:
                    if self.is_word() and self.peek() == "=":
                        self.i += 2
                    self.element_value()
                    if not self.take(","):
                        break
                self.need(")")

    def element_value(self) -> None:
        if self.at("@"):
            self.annotation()
        elif self.take("{"):
            while not self.at("}"):
                self.element_value()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.peek() != "interface":
                self.annotation()
            elif self.k[self.i] == "id" and self.v[self.i] in MODIFIERS:
                if self.at("default") and self.peek() in (":", "->"):
                    return
                if self.at("synchronized") and self.peek() == "(":
                    return
                self.i += 1
            elif self.at("sealed") and self.peek() in ("class", "interface", "abstract", "public", "static", "protected", "private"):
                self.i += 1
            elif self.at("non") and self.peek() == "-" and self.peek(2) == "sealed":
                self.i += 3
            else:
                return

    def type_declaration(self) -> bool:
        if self.take("class"):
            self.word()
            self.type_parameters()
            if self.take("extends"):
                self.type()
            if self.take("implements"):
                self.types()
            if self.take("permits"):
                self.types()
            self.body()
        elif self.take("interface"):
            self.word()
            self.type_parameters()
            if self.take("extends"):
                self.types()
            if self.take("permits"):
                self.types()
            self.body()
        elif self.at("@") and self.peek() == "interface":
            self.i += 2
            self.word()
            self.body()
        elif self.take("enum"):
            self.word()
            if self.take("implements"):
                self.types()
            self.need("{")
            while not self.at(";", "}"):
                self.modifiers()
                self.word()
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.body()
                if not self.take(","):
                    break
            if self.take(";"):
                while not self.at("}"):
                    self.member()
            self.need("}")
        elif self.at("record") and self.is_word(1) and self.peek(2) in ("(", "<"):
            self.i += 2
            self.type_parameters()
            self.parameters()
            if self.take("implements"):
                self.types()
            self.body()
        else:
            return False
        return True

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                while self.at("@"):
                    self.annotation()
                self.word()
                if self.take("extends"):
                    self.type()
                    while self.take("&"):
                        self.type()
                if not self.take(","):
                    break
            self.need(">")

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def body(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.member()
        self.need("}")

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("{") or (self.at("static") and self.peek() == "{"):
            self.take("static")
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        while self.at("@"):
            self.annotation()
        if self.is_word() and self.peek() == "(":  # a constructor
            self.i += 1
            self.parameters()
            self.throws()
            self.block()
            return
        if self.is_word() and self.peek() == "{":  # a record's compact one
            self.i += 1
            self.block()
            return
        if not self.take("void"):
            self.type()
        self.word()
        if self.at("("):
            self.parameters()
            self.dims()
            self.throws()
            if self.take("default"):
                self.element_value()
            if not self.take(";"):
                self.block()
            return
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.types()

    def dims(self) -> None:
        while self.at("[", "@"):
            while self.at("@"):
                self.annotation()
            self.need("[")
            self.need("]")

    def parameters(self) -> None:
        self.need("(")
        if not self.at(")"):
            while True:
                self.modifiers()
                self.type()
                while self.at("@"):
                    self.annotation()
                self.take("...")
                if not self.take("this"):
                    self.word()
                    while self.take("."):
                        if not self.take("this"):
                            self.word()
                self.dims()
                if not self.take(","):
                    break
        self.need(")")

    def declarators(self, named: bool = True) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.word()

    def initializer(self) -> None:
        if self.take("{"):
            while not self.at("}"):
                self.initializer()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.expression()

    # --- types
    def type(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.k[self.i] == "id" and self.v[self.i] in PRIMITIVES:
            self.i += 1
        else:
            self.word()
            self.type_arguments()
            while self.at(".") and (self.is_word(1) or self.peek() == "@"):
                self.i += 1
                while self.at("@"):
                    self.annotation()
                self.word()
                self.type_arguments()
        while self.at("[") and self.peek() == "]" or (self.at("@") and self._annotated_dim()):
            self.dims()

    def _annotated_dim(self) -> bool:
        i = self.i
        ok = self.tries(self.annotation) and self.at("[")
        self.i = i
        return ok

    def type_arguments(self) -> None:
        if not self.at("<"):
            return
        self.i += 1
        if self.take(">"):
            return
        while True:
            while self.at("@"):
                self.annotation()
            if self.take("?"):
                if self.take("extends") or self.take("super"):
                    self.type()
            else:
                self.type()
            if not self.take(","):
                break
        self.need(">")

    # --- statements
    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.block_statement()
        self.need("}")

    def block_statement(self) -> None:
        i = self.i
        self.modifiers()
        if self.type_declaration():
            return
        if self.i > i and not self.at("synchronized"):
            self.local_variable()
            self.need(";")
            return
        self.i = i
        if self.tries(self._local_head):
            self.declarators()
            self.need(";")
            return
        self.statement()

    def _local_head(self) -> None:
        if self.is_word() and self.v[self.i] == "yield":
            raise Bad(self.i)
        self.type()
        self.word()
        if not self.at("=", ";", ",", "[", ":"):
            raise Bad(self.i)

    def local_variable(self) -> None:
        self.type()
        self.word()
        self.declarators()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        v = self.v[self.i] if self.k[self.i] in ("id", "op") else ""
        if v == "{":
            self.block()
        elif v == ";":
            self.i += 1
        elif v == "if":
            self.i += 1
            self.paren()
            self.statement()
            if self.take("else"):
                self.statement()
        elif v == "while":
            self.i += 1
            self.paren()
            self.statement()
        elif v == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.paren()
            self.need(";")
        elif v == "for":
            self.i += 1
            self.for_rest()
        elif v == "switch":
            self.i += 1
            self.paren()
            self.switch_body()
        elif v == "try":
            self.i += 1
            resources = self.at("(")
            if resources:
                self.i += 1
                while not self.at(")"):
                    if not self.tries(self._resource):
                        self.expression()
                    if not self.take(";"):
                        break
                self.need(")")
            self.block()
            n = 0
            while self.take("catch"):
                n += 1
                self.need("(")
                self.modifiers()
                self.type()
                while self.take("|"):
                    self.type()
                self.word()
                self.need(")")
                self.block()
            if self.take("finally"):
                n += 1
                self.block()
            if not n and not resources:
                raise Bad(self.i)
        elif v == "return":
            self.i += 1
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif v == "throw":
            self.i += 1
            self.expression()
            self.need(";")
        elif v in ("break", "continue"):
            self.i += 1
            if self.is_word():
                self.i += 1
            self.need(";")
        elif v == "synchronized":
            self.i += 1
            self.paren()
            self.block()
        elif v == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif v == "yield" and self.peek() not in ("=", ".", "[", "++", "--"):
            self.i += 1
            self.expression()
            self.need(";")
        elif self.is_word() and self.peek() == ":":
            self.i += 2
            self.statement()
        else:
            self.statement_expression()
            self.need(";")

    def _resource(self) -> None:
        self.modifiers()
        self.type()
        self.word()
        self.need("=")
        self.expression()

    def for_rest(self) -> None:
        self.need("(")
        i = self.i

        def each() -> None:
            self.modifiers()
            self.type()
            self.word()
            self.dims()
            self.need(":")

        if self.tries(each):
            self.expression()
        else:
            self.i = i

            def declared() -> None:
                self.modifiers()
                self.type()
                self.word()
                if not self.at("=", ",", ";", "["):
                    raise Bad(self.i)

            if not self.at(";"):
                if self.tries(declared):
                    self.declarators()
                else:
                    self.statement_expressions()
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.statement_expressions()
        self.need(")")
        self.statement()

    def statement_expressions(self) -> None:
        self.statement_expression()
        while self.take(","):
            self.statement_expression()

    def statement_expression(self) -> None:
        if self.expression() != "does":
            raise Bad(self.i)

    def switch_body(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.take("default"):
                pass
            else:
                self.need("case")
                while True:
                    if not self.take("default") and not self.tries(self._case_pattern):
                        self.ternary()
                    if not self.take(","):
                        break
            if self.take("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "}") and not (self.at("default") and self.peek() in (":", "->")):
                    self.block_statement()
        self.need("}")

    def _case_pattern(self) -> None:
        self.modifiers()
        self.type()
        self.word()

    # --- expressions; the result "does" marks one that may stand as a statement
    def expression(self) -> str:
        r = self.ternary()
        if (self.k[self.i] == "op" and self.v[self.i] in ASSIGN) or self._shift_assign():
            if r not in ("place",):
                raise Bad(self.i)
            self.i += 1
            self.expression()
            return "does"
        return r

    def _shift_assign(self) -> bool:
        j = self.i
        while self.v[j] == ">" and self.p[j + 1] == self.p[j] + 1:
            j += 1
        if j > self.i and self.v[j] == ">=":
            self.i = j
            return True
        return False

    def ternary(self) -> str:
        r = self.binary(1)
        if self.take("?"):
            self.expression()
            self.need(":")
            self.ternary()
            return "value"
        return r

    def binary(self, least: int) -> str:
        r = self.unary()
        while True:
            v = self.v[self.i] if self.k[self.i] in ("op", "id") else ""
            if v == "instanceof" and least <= 7:
                self.i += 1
                self.take("final")
                self.type()
                if self.is_word():
                    self.i += 1
                r = "value"
                continue
            n = BINARY.get(v) if self.k[self.i] == "op" else None
            width = 1
            if v == ">":
                j = self.i
                while self.v[j + 1] in (">", ">=") and self.p[j + 1] == self.p[j] + 1:
                    j += 1
                if self.v[j] == ">=":
                    return r  # >>=
                if j > self.i:
                    n, width = 8, j - self.i + 1
            if n is None or n < least:
                return r
            self.i += width
            self.binary(n + 1)
            r = "value"

    def unary(self) -> str:
        if self.at("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "value"
        if self.at("++", "--"):
            self.i += 1
            if self.unary() != "place":
                raise Bad(self.i)
            return "does"
        if self._lambda_ahead():
            return self.lambda_()
        if self.at("(") and self.tries(self._cast):
            return "value"
        return self.postfix()

    def _cast(self) -> None:
        self.need("(")
        primitive = self.k[self.i] == "id" and self.v[self.i] in PRIMITIVES
        self.type()
        while self.take("&"):
            self.type()
            primitive = False
        array = self.v[self.i - 1] == "]"
        self.need(")")
        if primitive and not array:
            self.unary()
            return
        if self.k[self.i] in ("num", "str") or self.at("(", "!", "~", "this", "super", "new", "true", "false", "null", "switch", "void") or (self.k[self.i] == "id" and (self.is_word() or self.v[self.i] in PRIMITIVES)):
            if self._lambda_ahead():
                self.lambda_()
            else:
                self.unary()
            return
        raise Bad(self.i)

    def _lambda_ahead(self) -> bool:
        if self.is_word() and self.peek() == "->":
            return True
        if not self.at("("):
            return False
        depth, j = 0, self.i
        while j < len(self.k):
            if self.k[j] == "op":
                if self.v[j] == "(":
                    depth += 1
                elif self.v[j] == ")":
                    depth -= 1
                    if not depth:
                        return self.v[j + 1] == "->" and self.k[j + 1] == "op"
                elif self.v[j] in ("{", "}", ";"):
                    return False
            elif self.k[j] == "end":
                return False
            j += 1
        return False

    def lambda_(self) -> str:
        if self.is_word():
            self.i += 1
        else:
            i = self.i
            self.need("(")

            def names() -> None:
                if not self.at(")"):
                    self.word()
                    while self.take(","):
                        self.word()
                self.need(")")

            if not self.tries(names):
                self.i = i
                self.parameters()
        self.need("->")
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return "lambda"

    def postfix(self) -> str:
        r = self.primary()
        while True:
            if self.at("."):
                self.i += 1
                if self.at("<"):
                    self.type_arguments()
                    if not self.take("super"):
                        self.word()
                    self.arguments()
                    r = "does"
                elif self.take("new"):
                    self.creator()
                    r = "does"
                elif self.take("this") or self.take("class"):
                    r = "value"
                elif self.take("super"):
                    if self.at("("):
                        self.arguments()
                        r = "does"
                    else:
                        r = "value"
                else:
                    self.word()
                    r = "place"
                    if self.at("("):
                        self.arguments()
                        r = "does"
            elif self.at("["):
                if self.peek() == "]":
                    self.dims()
                    if not (self.at("::") or (self.at(".") and self.peek() == "class")):
                        raise Bad(self.i)
                    continue
                self.i += 1
                self.expression()
                self.need("]")
                r = "place"
            elif self.at("++", "--"):
                if r != "place":
                    raise Bad(self.i)
                self.i += 1
                r = "does"
            elif self.at("::"):
                self.i += 1
                self.type_arguments()
                if not self.take("new"):
                    self.word()
                r = "value"
            elif self.at("<") and r == "place" and self.tries(self._generic_reference):
                continue
            else:
                return r

    def _generic_reference(self) -> None:
        self.type_arguments()
        while self.take("."):
            self.word()
            self.type_arguments()
        self.dims()
        if not self.at("::"):
            raise Bad(self.i)

    def primary(self) -> str:
        k, v = self.k[self.i], self.v[self.i]
        if k in ("num", "str"):
            self.i += 1
            return "value"
        if k == "op":
            if v == "(":
                self.paren()
                return "place" if self.at("=", "++", "--", "+=", "-=") else "value"
            raise Bad(self.i)
        if k != "id":
            raise Bad(self.i)
        if v in ("true", "false", "null"):
            self.i += 1
            return "value"
        if v in ("this", "super"):
            self.i += 1
            if self.at("("):
                self.arguments()
                return "does"
            if v == "super" and not self.at(".", "::"):
                raise Bad(self.i)
            return "value"
        if v == "new":
            self.i += 1
            return self.creator()
        if v == "switch":
            self.i += 1
            self.paren()
            self.switch_body()
            return "value"
        if v in PRIMITIVES or v == "void":
            self.i += 1
            self.dims()
            if not (self.at(".") and self.peek() == "class" or self.at("::")):
                raise Bad(self.i)
            return "value"
        self.word()
        if self.at("("):
            self.arguments()
            return "does"
        return "place"

    def arguments(self) -> None:
        self.need("(")
        if not self.at(")"):
            self.expression()
            while self.take(","):
                self.expression()
        self.need(")")

    def creator(self) -> str:
        while self.at("@"):
            self.annotation()
        self.type_arguments()
        if self.k[self.i] == "id" and self.v[self.i] in PRIMITIVES:
            self.i += 1
        else:
            self.word()
            self.type_arguments()
            while self.take("."):
                self.word()
                self.type_arguments()
        if self.at("["):
            sized = False
            while self.at("["):
                self.i += 1
                if not self.at("]"):
                    self.expression()
                    sized = True
                self.need("]")
            if self.at("{"):
                if sized:
                    raise Bad(self.i)
                self.initializer()
            elif not sized:
                raise Bad(self.i)
            return "value"
        self.arguments()
        if self.at("{"):
            self.body()
        return "does"


def parses(t: Tokens) -> bool:
    try:
        Java(t).unit()
        return True
    except Bad:
        return False
