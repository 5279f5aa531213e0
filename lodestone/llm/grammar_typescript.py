"""A recursive-descent parser for TypeScript 5: says whether tokens form a source file."""

from __future__ import annotations

from lodestone.llm.codelex import Tokens

# The language's reserved words, modifiers and operators.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new "
    "null return super switch this throw true try typeof var void while with".split()
)
MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= **= &&= ||= ??=".split())
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "as": 8, "satisfies": 8, "<<": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}


class Bad(Exception):
    """The tokens don't fit the grammar."""


class TypeScript:
    def __init__(self, t: Tokens):
        pad = 6
        self.k, self.v = [*t.kind, *["end"] * pad], [*t.val, *[""] * pad]
        self.p, self.nl = [*t.pos, *[0] * pad], [*t.new_line, *[True] * pad]
        self.i = 0
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for j, (k, v) in enumerate(zip(t.kind, t.val)):
            if k == "op":
                if v in "([{":
                    stack.append(j)
                elif v in ")]}" and stack:
                    self.pair[stack.pop()] = j

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

    def is_word(self, ahead: int = 0) -> bool:
        j = self.i + ahead
        return j < len(self.k) and self.k[j] == "id" and self.v[j] not in RESERVED and self.v[j][0] != "#"

    def word(self) -> None:
        if not self.is_word():
            raise Bad(self.i)
        self.i += 1

    def any_word(self) -> None:
        if self.k[self.i] != "id":
            raise Bad(self.i)
        self.i += 1

    def peek(self, ahead: int = 1) -> str:
        j = min(self.i + ahead, len(self.k) - 1)
        return self.v[j] if self.k[j] in ("op", "id") else ""

    def line_ahead(self, ahead: int = 1) -> bool:
        return self.nl[min(self.i + ahead, len(self.nl) - 1)]

    def tries(self, f) -> bool:
        i = self.i
        try:
            f()
            return True
        except Bad:
            self.i = i
            return False

    def end_statement(self) -> None:
        """A semicolon, written or inserted."""
        if self.take(";") or self.at("}") or self.k[self.i] == "end" or self.nl[self.i]:
            return
        raise Bad(self.i)

    def need_angle(self) -> None:
        if not self.at(">"):
            raise Bad(self.i)
        self.i += 1

    # --- statements
    def file(self) -> None:
        while self.k[self.i] != "end":
            self.statement()

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.statement()
        self.need("}")

    def paren(self) -> None:
        self.need("(")
        self.comma()
        self.need(")")

    def statement(self) -> None:
        if self.k[self.i] == "end":
            raise Bad(self.i)
        v = self.v[self.i] if self.k[self.i] in ("id", "op") else ""
        f = getattr(self, f"s_{v}", None) if v.isidentifier() else None
        if v == "{":
            self.block()
        elif v == ";":
            self.i += 1
        elif v == "@":
            self.decorators()
            self.take("export")
            self.take("default")
            self.take("abstract")
            if not self.at("class"):
                raise Bad(self.i)
            self.class_()
        elif v == "import" and self.peek() in ("(", "."):
            self.comma()
            self.end_statement()
        elif v in ("let", "using") and not (self.is_word(1) or self.peek() in ("[", "{")):
            self.expression_statement()
        elif v in ("type", "namespace", "module", "abstract", "declare", "interface", "global") and not self.declares(v):
            self.expression_statement()
        elif v == "async" and not (self.peek() == "function" and not self.line_ahead()):
            self.expression_statement()
        elif v == "enum" and not self.is_word(1):
            raise Bad(self.i)
        elif f:
            f()
        elif self.is_word() and self.peek() == ":":
            self.i += 2
            self.statement()
        else:
            self.expression_statement()

    def declares(self, v: str) -> bool:
        if self.line_ahead():
            return False
        if v in ("type", "interface", "namespace"):
            return self.is_word(1)
        if v == "module":
            return self.is_word(1) or self.k[self.i + 1] == "str"
        if v == "global":
            return self.peek() == "{"
        if v == "abstract":
            return self.peek() == "class"
        return self.k[self.i + 1] == "id" and self.peek() not in ("in", "instanceof", "as", "satisfies")

    def expression_statement(self) -> None:
        self.comma()
        self.end_statement()

    def s_import(self) -> None:
        self.i += 1
        if self.k[self.i] == "str":
            self.i += 1
            self.attributes()
            return self.end_statement()
        if self.at("type") and (self.is_word(1) and self.peek() != "from" or self.peek() in ("{", "*") or (self.peek() == "from" and self.peek(2) == "from")):
            self.i += 1
        if self.is_word():
            self.i += 1
            if self.take("="):
                if self.at("require") and self.peek() == "(":
                    self.i += 1
                    self.paren()
                else:
                    self.word()
                    while self.take("."):
                        self.any_word()
                return self.end_statement()
            if self.take(","):
                self.import_clause()
        else:
            self.import_clause()
        self.need("from")
        self.string()
        self.attributes()
        self.end_statement()

    def string(self) -> None:
        if self.k[self.i] != "str":
            raise Bad(self.i)
        self.i += 1

    def attributes(self) -> None:
        if self.at("with", "assert") and self.peek() == "{":
            self.i += 1
            self.object()

    def import_clause(self) -> None:
        if self.take("*"):
            self.need("as")
            self.word()
        else:
            self.specifiers()

    def specifiers(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.at("type") and self.peek() not in (",", "}", "as"):
                self.i += 1
            self.module_name()
            if self.take("as"):
                self.module_name()
            if not self.take(","):
                break
        self.need("}")

    def module_name(self) -> None:
        if self.k[self.i] not in ("id", "str"):
            raise Bad(self.i)
        self.i += 1

    def s_export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.at("function") or (self.at("async") and self.peek() == "function"):
                self.take("async")
                self.function(False)
            elif self.at("class") or (self.at("abstract") and self.peek() == "class"):
                self.take("abstract")
                self.class_()
            elif self.at("interface") and self.is_word(1):
                self.s_interface()
            elif self.at("@"):
                self.statement()
            else:
                self.assignment()
                self.end_statement()
        elif self.take("="):
            self.comma()
            self.end_statement()
        elif self.at("as") and self.peek() == "namespace":
            self.i += 2
            self.word()
            self.end_statement()
        elif self.at("*") or (self.at("type") and self.peek() == "*"):
            self.take("type")
            self.i += 1
            if self.take("as"):
                self.module_name()
            self.need("from")
            self.string()
            self.attributes()
            self.end_statement()
        elif self.at("{") or (self.at("type") and self.peek() == "{"):
            self.take("type")
            self.specifiers()
            if self.take("from"):
                self.string()
                self.attributes()
            self.end_statement()
        else:
            v = self.v[self.i] if self.k[self.i] in ("id", "op") else ""
            if v not in ("const", "let", "var", "function", "class", "enum", "interface", "type", "namespace", "module", "abstract", "async", "declare", "import", "@"):
                raise Bad(self.i)
            if v in ("interface", "type", "namespace", "module", "abstract", "declare") and not self.declares(v):
                raise Bad(self.i)
            if v == "async" and self.peek() != "function":
                raise Bad(self.i)
            self.statement()

    def s_declare(self) -> None:
        self.i += 1
        if self.at("global") and self.peek() == "{":
            self.i += 1
            return self.block()
        if not self.at("const", "let", "var", "function", "class", "enum", "interface", "type", "namespace", "module", "abstract", "async"):
            raise Bad(self.i)
        if self.at("module") and self.k[self.i + 1] == "str":
            self.i += 2
            return self.block() if self.at("{") else self.end_statement()
        return self.statement()

    def s_namespace(self) -> None:
        self.i += 1
        if self.k[self.i] == "str":
            self.i += 1
        else:
            self.word()
            while self.take("."):
                self.any_word()
        self.block()

    s_module = s_namespace

    def s_global(self) -> None:
        self.i += 1
        self.block()

    def s_abstract(self) -> None:
        self.i += 1
        self.class_()

    def s_class(self) -> None:
        if not self.is_word(1):
            raise Bad(self.i)
        self.class_()

    def s_interface(self) -> None:
        self.i += 1
        self.word()
        self.type_parameters()
        if self.take("extends"):
            self.heritage()
        self.object_type()

    def s_type(self) -> None:
        self.i += 1
        self.word()
        self.type_parameters()
        self.need("=")
        self.type()
        self.end_statement()

    def s_enum(self) -> None:
        self.i += 1
        self.word()
        self.need("{")
        while not self.at("}"):
            if self.k[self.i] not in ("id", "str"):
                raise Bad(self.i)
            self.i += 1
            if self.take("="):
                self.assignment()
            if not self.take(","):
                break
        self.need("}")

    def s_async(self) -> None:
        self.i += 1
        self.function(True)

    def s_function(self) -> None:
        self.function(True)

    def function(self, named: bool) -> None:
        """From the word function on; without a body it is an overload."""
        self.need("function")
        self.take("*")
        if named or self.is_word():
            self.word()
        self.signature()
        if self.at("{"):
            self.block()
        else:
            self.end_statement()

    def signature(self) -> None:
        self.type_parameters()
        self.parameters()
        if self.take(":"):
            self.return_type()

    def s_const(self) -> None:
        if self.peek() == "enum":
            self.i += 1
            return self.s_enum()
        self.i += 1
        self.bindings()
        return self.end_statement()

    def s_var(self) -> None:
        self.i += 1
        self.bindings()
        self.end_statement()

    s_let = s_using = s_var

    def bindings(self, no_in: bool = False) -> None:
        while True:
            self.binding()
            self.take("!")
            if self.take(":"):
                self.type()
            if self.take("="):
                self.assignment(no_in)
            if not self.take(","):
                return

    def binding(self) -> None:
        if self.take("["):
            while not self.at("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
            self.need("]")
        elif self.take("{"):
            while not self.at("}"):
                if self.take("..."):
                    self.binding()
                else:
                    plain = self.is_word() and self.peek() != ":"
                    self.member_name()
                    if self.take(":"):
                        self.binding()
                    elif not plain:
                        raise Bad(self.i)
                    if self.take("="):
                        self.assignment()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.word()

    def s_if(self) -> None:
        self.i += 1
        self.paren()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.paren()
        self.statement()

    def s_with(self) -> None:
        self.s_while()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.paren()
        self.take(";")

    def s_for(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if self.at("const", "let", "var") and not (self.at("let") and self.peek() in ("in", "of")):
            self.i += 1
            i = self.i
            self.binding()
            if self.take(":"):
                self.type()
            if self.at("of", "in"):
                each = True
            else:
                each = False
                self.i = i
                self.bindings(True)
        elif self.at(";"):
            each = False
        else:
            self.comma(True)
            each = self.at("of", "in")
        if each:
            of = self.at("of")
            self.i += 1
            self.assignment() if of else self.comma()
        else:
            self.need(";")
            if not self.at(";"):
                self.comma()
            self.need(";")
            if not self.at(")"):
                self.comma()
        self.need(")")
        self.statement()

    def s_switch(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        while not self.at("}"):
            if not self.take("default"):
                self.need("case")
                self.comma()
            self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()
        self.need("}")

    def s_try(self) -> None:
        self.i += 1
        self.block()
        if not self.at("catch", "finally"):
            raise Bad(self.i)
        if self.take("catch"):
            if self.take("("):
                self.binding()
                if self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            self.block()

    def s_return(self) -> None:
        self.i += 1
        if not (self.at(";", "}") or self.nl[self.i] or self.k[self.i] == "end"):
            self.comma()
        self.end_statement()

    def s_throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            raise Bad(self.i)
        self.comma()
        self.end_statement()

    def s_break(self) -> None:
        self.i += 1
        if self.is_word() and not self.nl[self.i]:
            self.i += 1
        self.end_statement()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.i += 1
        self.end_statement()

    # --- classes
    def decorators(self) -> None:
        while self.take("@"):
            if self.at("("):
                self.paren()
            else:
                self.word()
                while self.take("."):
                    self.any_word()
                self.tries(self.type_arguments)
                if self.at("("):
                    self.arguments()

    def heritage(self) -> None:
        while True:
            self.word() if not self.at("(") else self.paren()
            while self.take("."):
                self.any_word()
            self.type_arguments_maybe()
            if not self.take(","):
                return

    def type_arguments_maybe(self) -> None:
        if self.at("<"):
            self.type_arguments()

    def class_(self) -> None:
        self.need("class")
        if self.is_word() and not self.at("implements"):
            self.i += 1
        self.type_parameters()
        if self.take("extends"):
            self.left_hand(True)
            self.type_arguments_maybe()
        if self.take("implements"):
            self.heritage()
        self.need("{")
        while not self.at("}"):
            self.member()
        self.need("}")

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        if self.at("static") and self.peek() == "{":
            self.i += 1
            return self.block()
        while self.k[self.i] == "id" and self.v[self.i] in MODIFIERS and not self.ends_name(1):
            if self.line_ahead() and self.v[self.i] not in ("static", "public", "private", "protected"):
                break
            self.i += 1
            self.decorators()
        if self.at("[") and self.is_index():
            self.index_signature()
            return self.end_statement()
        accessor = False
        if self.at("get", "set") and not self.ends_name(1):
            self.i += 1
            accessor = True
        self.take("*")
        self.member_name(True)
        self.take("?") or self.take("!")
        if self.at("(", "<"):
            self.signature()
            return self.block() if self.at("{") else self.end_statement()
        if accessor:
            raise Bad(self.i)
        if self.take(":"):
            self.type()
        if self.take("="):
            self.assignment()
        return self.end_statement()

    def ends_name(self, ahead: int) -> bool:
        """The token there can't begin a member's name, so the word before is one."""
        j = self.i + ahead
        return (self.k[j] == "op" and self.v[j] not in ("[", "*", "@", "{")) or self.k[j] == "end" or (self.k[j] == "op" and self.v[j] == "{")

    def member_name(self, private: bool = False) -> None:
        k = self.k[self.i]
        if k in ("str", "num") or (k == "id" and (private or self.v[self.i][0] != "#")):
            self.i += 1
        elif self.take("["):
            self.assignment()
            self.need("]")
        else:
            raise Bad(self.i)

    def is_index(self) -> bool:
        return self.is_word(1) and self.peek(2) == ":"

    def index_signature(self) -> None:
        self.need("[")
        self.word()
        self.need(":")
        self.type()
        self.need("]")
        if self.take(":"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.decorators()
            while self.at("public", "private", "protected", "readonly", "override") and (self.is_word(1) or self.peek() in ("{", "[")):
                self.i += 1
            self.take("...")
            if not self.take("this"):
                self.binding()
            self.take("?")
            if self.take(":"):
                self.type()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                break
        self.need(")")

    # --- types
    def type_parameters(self) -> None:
        if self.take("<"):
            while not self.at(">"):
                while self.at("const", "in", "out") and (self.is_word(1) or self.peek() in ("in", "out")):
                    self.i += 1
                self.word()
                if self.take("extends"):
                    self.type()
                if self.take("="):
                    self.type()
                if not self.take(","):
                    break
            self.need_angle()

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            if self.at(">"):
                break
            self.type()
        self.need_angle()

    def return_type(self) -> None:
        if self.at("asserts") and (self.is_word(1) or self.peek() == "this") and not self.line_ahead():
            self.i += 2
            if self.take("is"):
                self.type()
            return
        if (self.is_word() or self.at("this")) and self.peek() == "is" and not self.line_ahead():
            self.i += 2
        self.type()

    def type(self) -> None:
        if self.at("<") or (self.at("(") and self.function_type_ahead()) or self.at("new") or (self.at("abstract") and self.peek() == "new"):
            self.take("abstract")
            self.take("new")
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.return_type()
            return
        self.union()
        if self.at("extends") and not self.nl[self.i]:
            def conditional() -> None:
                self.need("extends")
                self.union() if not (self.at("(") and self.function_type_ahead()) else self.type()
                self.need("?")
                self.type()
                self.need(":")
                self.type()

            self.tries(conditional)

    def function_type_ahead(self) -> bool:
        j = self.pair.get(self.i)
        return j is not None and self.v[j + 1] == "=>" and self.k[j + 1] == "op"

    def union(self) -> None:
        self.take("|") or self.take("&")
        while True:
            self.type_operator()
            if not (self.take("|") or self.take("&")):
                return

    def type_operator(self) -> None:
        if self.at("keyof", "unique", "readonly", "infer") and (self.k[self.i + 1] in ("id", "str", "tmpl") or self.peek() in ("(", "[", "{")):
            infer = self.at("infer")
            self.i += 1
            self.type_operator()
            if infer and self.at("extends"):
                def bound() -> None:
                    self.need("extends")
                    self.union()
                    if self.at("?"):
                        raise Bad(self.i)

                self.tries(bound)
            return
        if self.at("(") and self.function_type_ahead():
            return self.type()
        self.type_primary()
        while self.at("[") and not self.nl[self.i]:
            self.i += 1
            if not self.at("]"):
                self.type()
            self.need("]")
        return None

    def type_primary(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k in ("str", "num", "tmpl"):
            self.i += 1
        elif k == "head":
            while True:
                self.i += 1
                self.type()
                if self.k[self.i] == "tail":
                    self.i += 1
                    return
                if self.k[self.i] != "mid":
                    raise Bad(self.i)
        elif k == "op":
            if v == "(":
                self.i += 1
                self.type()
                self.need(")")
            elif v == "[":
                self.i += 1
                while not self.at("]"):
                    self.take("...")
                    if self.k[self.i] == "id" and (self.peek() == ":" or (self.peek() == "?" and self.peek(2) == ":")):
                        self.i += 1
                        self.take("?")
                        self.need(":")
                    self.type()
                    self.take("?")
                    if not self.take(","):
                        break
                self.need("]")
            elif v == "{":
                self.object_type()
            elif v == "-" and self.k[self.i + 1] == "num":
                self.i += 2
            else:
                raise Bad(self.i)
        elif k == "id":
            if v == "typeof":
                self.i += 1
                if self.at("import"):
                    return self.type_primary()
                self.any_word()
                while self.take("."):
                    self.any_word()
                if not self.nl[self.i]:
                    self.type_arguments_maybe()
                return None
            if v == "import":
                self.i += 1
                self.need("(")
                self.type()
                if self.take(","):
                    self.object()
                self.need(")")
                while self.take("."):
                    self.any_word()
                return self.type_arguments_maybe()
            if v in ("void", "null", "this", "true", "false"):
                self.i += 1
                return None
            self.word()
            while self.at(".") and self.k[self.i + 1] == "id":
                self.i += 2
            if not self.nl[self.i]:
                self.type_arguments_maybe()
        else:
            raise Bad(self.i)
        return None

    def object_type(self) -> None:
        self.need("{")
        if self.mapped_ahead():
            if self.take("+") or self.take("-"):
                self.need("readonly")
            else:
                self.take("readonly")
            self.need("[")
            self.word()
            self.need("in")
            self.type()
            if self.take("as"):
                self.type()
            self.need("]")
            if self.take("+") or self.take("-"):
                self.need("?")
            else:
                self.take("?")
            if self.take(":"):
                self.type()
            self.take(";") or self.take(",")
            self.need("}")
            return
        while not self.at("}"):
            self.type_member()
            if not (self.take(";") or self.take(",")) and not self.at("}") and not self.nl[self.i]:
                raise Bad(self.i)
        self.need("}")

    def mapped_ahead(self) -> bool:
        j = self.i
        if self.v[j] in ("+", "-"):
            j += 1
        if self.v[j] == "readonly":
            j += 1
        return self.v[j] == "[" and self.k[j + 1] == "id" and self.v[j + 2] == "in" and self.k[j + 2] == "id"

    def type_member(self) -> None:
        if self.at("(", "<"):
            return self.signature()
        if self.at("new") and self.peek() in ("(", "<"):
            self.i += 1
            return self.signature()
        if self.at("readonly") and not self.ends_name(1):
            self.i += 1
        if self.at("[") and self.is_index():
            return self.index_signature()
        if self.at("get", "set") and not self.ends_name(1):
            self.i += 1
        self.member_name()
        self.take("?")
        if self.at("(", "<"):
            return self.signature()
        if self.take(":"):
            self.type()
        return None

    # --- expressions
    def comma(self, no_in: bool = False) -> None:
        self.assignment(no_in)
        while self.take(","):
            self.assignment(no_in)

    def assignment(self, no_in: bool = False) -> None:
        if self.at("yield") and self.peek() not in ("=", ".", ",", ")", ";", "=>", ":"):
            self.i += 1
            if not self.nl[self.i] and not self.at(")", "]", "}", ",", ";"):
                self.take("*")
                self.assignment(no_in)
            return
        if self.arrow():
            return
        place = self.conditional(no_in)
        if (self.k[self.i] == "op" and self.v[self.i] in ASSIGN) or self.shift_assign():
            if not place:
                raise Bad(self.i)
            self.i += 1
            self.assignment(no_in)

    def shift_assign(self) -> bool:
        j = self.i
        while self.v[j] == ">" and self.k[j] == "op" and self.p[j + 1] == self.p[j] + 1:
            j += 1
        if j > self.i and self.v[j] == ">=":
            self.i = j
            return True
        return False

    def arrow(self) -> bool:
        j = self.i
        if self.at("async") and not self.line_ahead() and (self.is_word(1) or self.peek() in ("(", "<")):
            j += 1
        if self.k[j] == "id" and self.v[j] not in RESERVED and self.v[j + 1] == "=>" and self.k[j + 1] == "op":
            self.i = j + 2
            self.arrow_body()
            return True
        if self.k[j] != "op":
            return False
        if self.v[j] == "(":
            m = self.pair.get(j)
            if m is None or self.v[m + 1] not in ("=>", ":") or self.k[m + 1] != "op":
                return False
        elif self.v[j] != "<":
            return False

        def head() -> None:
            self.i = j
            self.type_parameters()
            self.parameters()
            if self.take(":"):
                self.return_type()
            self.need("=>")

        if not self.tries(head):
            return False
        self.arrow_body()
        return True

    def arrow_body(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.assignment()

    def conditional(self, no_in: bool) -> bool:
        place = self.binary(1, no_in)
        if self.take("?"):
            self.assignment()
            self.need(":")
            self.assignment(no_in)
            return False
        return place

    def binary(self, least: int, no_in: bool) -> bool:
        place = self.unary()
        while True:
            v = self.v[self.i] if self.k[self.i] in ("op", "id") else ""
            n = BINARY.get(v)
            width = 1
            if v == ">" and self.k[self.i] == "op":
                j = self.i
                while self.v[j + 1] in (">", ">=") and self.k[j + 1] == "op" and self.p[j + 1] == self.p[j] + 1:
                    j += 1
                if self.v[j] == ">=":
                    return place
                if j > self.i:
                    n, width = 9, j - self.i + 1
            if n is None or n < least or (v == "in" and no_in) or (v in ("as", "satisfies") and self.nl[self.i]):
                return place
            self.i += width
            if v in ("as", "satisfies"):
                if not self.take("const"):
                    self.type()
                place = True
                continue
            self.binary(n if v == "**" else n + 1, no_in)
            place = False

    def unary(self) -> bool:
        if self.at("!", "~", "+", "-", "typeof", "void", "delete") or (self.at("await") and (self.k[self.i + 1] not in ("op", "end") or self.peek() in ("(", "[", "{"))):
            self.i += 1
            self.unary()
            return False
        if self.at("++", "--"):
            self.i += 1
            if not self.unary():
                raise Bad(self.i)
            return False
        if self.at("<"):
            self.i += 1
            self.type()
            self.need_angle()
            return self.unary()
        place = self.left_hand(False)
        if self.at("++", "--") and not self.nl[self.i]:
            if not place:
                raise Bad(self.i)
            self.i += 1
            return False
        return place

    def left_hand(self, heritage: bool) -> bool:
        place = self.primary()
        while True:
            if self.take(".") or self.take("?."):
                optional = self.v[self.i - 1] == "?."
                if optional and self.at("("):
                    self.arguments()
                    place = False
                elif optional and self.at("["):
                    continue
                elif optional and self.at("<"):
                    self.type_arguments()
                    self.arguments()
                    place = False
                else:
                    self.any_word()
                    place = True
            elif self.take("["):
                self.comma()
                self.need("]")
                place = True
            elif self.at("(") :
                self.arguments()
                place = False
            elif self.at("!") and not self.nl[self.i] and self.peek() != "=":
                self.i += 1
            elif self.k[self.i] in ("tmpl", "head"):
                self.template()
                place = False
            elif self.at("<") and self.tries(self._call_arguments):
                place = False
            else:
                return place

    def _call_arguments(self) -> None:
        self.type_arguments()
        if self.at("("):
            self.arguments()
        elif self.k[self.i] in ("tmpl", "head"):
            return
        elif self.k[self.i] in ("id", "num", "str", "regex") and not self.nl[self.i] and self.v[self.i] not in ("as", "satisfies", "in", "instanceof", "implements"):
            raise Bad(self.i)
        elif self.at("[", "-", "+", "!", "~", "<"):
            raise Bad(self.i)

    def template(self) -> None:
        if self.k[self.i] == "tmpl":
            self.i += 1
            return
        while True:
            self.i += 1
            self.comma()
            if self.k[self.i] == "tail":
                self.i += 1
                return
            if self.k[self.i] != "mid":
                raise Bad(self.i)

    def arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.take("...")
            self.assignment()
            if not self.take(","):
                break
        self.need(")")

    def primary(self) -> bool:
        k, v = self.k[self.i], self.v[self.i]
        if k in ("num", "str", "regex"):
            self.i += 1
            return False
        if k in ("tmpl", "head"):
            self.template()
            return False
        if k == "op":
            if v == "(":
                self.paren()
                return True
            if v == "[":
                self.i += 1
                while not self.at("]"):
                    if self.take(","):
                        continue
                    self.take("...")
                    self.assignment()
                    if not self.at("]"):
                        self.need(",")
                self.need("]")
                return True
            if v == "{":
                self.object()
                return True
            if v == "@":
                self.decorators()
                self.class_()
                return False
            raise Bad(self.i)
        if k != "id":
            raise Bad(self.i)
        if v in ("this", "null", "true", "false", "super"):
            self.i += 1
            return False
        if v == "function" or (v == "async" and self.peek() == "function" and not self.line_ahead()):
            self.take("async")
            self.need("function")
            self.take("*")
            if self.is_word():
                self.i += 1
            self.signature()
            self.block()
            return False
        if v == "class":
            self.class_()
            return False
        if v == "new":
            self.i += 1
            if self.take("."):
                self.any_word()
                return False
            self._new_target()
            self.tries(self.type_arguments)
            if self.at("("):
                self.arguments()
            return False
        if v == "import":
            self.i += 1
            if self.take("."):
                self.any_word()
            else:
                self.arguments()
            return False
        if v[0] == "#":
            self.i += 1
            if not self.at("in"):
                raise Bad(self.i)
            return False
        self.word()
        return True

    def _new_target(self) -> None:
        self.primary()
        while True:
            if self.take("."):
                self.any_word()
            elif self.take("["):
                self.comma()
                self.need("]")
            else:
                return

    def object(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.take("..."):
                self.assignment()
            else:
                while self.at("async", "get", "set") and not self.ends_name(1):
                    self.i += 1
                star = self.take("*")
                short = self.is_word() and not star
                self.member_name()
                if self.at("(", "<"):
                    self.signature()
                    self.block()
                elif self.take(":"):
                    self.assignment()
                elif not short:
                    raise Bad(self.i)
                elif self.take("="):  # a default, where the object is a pattern
                    self.assignment()
            if not self.take(","):
                break
        self.need("}")


def parses(t: Tokens) -> bool:
    try:
        TypeScript(t).file()
        return True
    except Bad:
        return False
