"""Local grammars: recursive descent over token classes, one statement at a time.

A block's tokens are split into statements. Whether a statement is valid
depends on its token classes alone, so each distinct shape is parsed once and
remembered, together with what each brace group in it must contain.
"""

from __future__ import annotations

import ast
import warnings

from weftgraph.llm.lexing import Bad, Group, tokenize

_LEFT = {"(": ")", "[": "]"}


class Parser:
    """Tokens of one piece. ``owes`` collects the brace groups met and what they must be."""

    NAMES: frozenset[str] = frozenset()

    def __init__(self, tokens: list, mode: str) -> None:
        self.t: list[str] = []
        self.nl: list[bool] = []
        self.order: dict[int, int] = {}
        for x in tokens:
            if isinstance(x, Group):
                self.order[len(self.t) - 1] = len(self.order)
            elif x == "\n":
                self.t.append("\n")
                self.nl.append(True)
            else:
                self.nl.append(x[0] == "\n")
                self.t.append(x[1:] if x[0] == "\n" else x)
        self.t += ["", "", "", ""]
        self.nl += [True] * 4
        self.i, self.n, self.mode = 0, len(self.t) - 4, mode
        self.owes: list[tuple[int, str]] = []

    @property
    def c(self) -> str:
        return self.t[self.i]

    def at(self, *xs: str) -> bool:
        return self.t[self.i] in xs

    def eat(self, x: str) -> bool:
        if self.t[self.i] == x and self.i < self.n:
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if self.t[self.i] != x or self.i >= self.n:
            raise Bad(f"{x} expected, found {self.c!r}")
        self.i += 1

    def group(self, mode: str) -> None:
        at = self.i
        self.need("{")
        self.owes.append((self.order[at], mode))

    def end(self) -> bool:
        return self.i >= self.n

    def name(self) -> None:
        if self.c != "x" and self.c not in self.NAMES:
            raise Bad(f"name expected, found {self.c!r}")
        self.i += 1

    def is_name(self, k: int = 0) -> bool:
        c = self.t[self.i + k]
        return c == "x" or c in self.NAMES

    def closing(self, at: int) -> int:
        """Index of the bracket that closes the one at ``at``."""
        depth = 0
        for k in range(at, self.n):
            c = self.t[k]
            if c in ("(", "["):
                depth += 1
            elif c in (")", "]"):
                depth -= 1
                if not depth:
                    return k
        raise Bad("open bracket")

    def attempt(self, f, *args) -> bool:
        i, owes = self.i, len(self.owes)
        try:
            f(*args)
            return True
        except Bad:
            self.i = i
            del self.owes[owes:]
            return False

    def commas(self, f, close: str, *args) -> None:
        """Items up to ``close``, a trailing comma allowed; eats ``close``."""
        while not self.eat(close):
            f(*args)
            if not self.eat(","):
                self.need(close)
                return

    def run(self) -> None:
        raise NotImplementedError


# ---- ECMAScript and TypeScript --------------------------------------------------------------------------------------


class Script(Parser):
    NAMES = frozenset("async get set of as from type namespace module declare abstract readonly keyof infer is asserts satisfies unique override global require out accessor let static private public protected interface implements yield await".split())
    ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
    BINARY = frozenset("== != === !== < > <= >= + - * / % ** << & | ^ && || ??".split())
    UNARY = frozenset("! ~ + - typeof void delete ++ --".split())
    DECLARES = frozenset("var let const function class import export".split())
    ts = False

    def run(self) -> None:
        m = self.mode
        if m in ("stmts", "fn"):
            while not self.end():
                self.stmt()
        elif m == "class":
            while not self.end():
                self.member()
        elif m in ("switch", "switchfn"):
            while not self.end():
                if self.eat("case"):
                    self.expr()
                else:
                    self.need("default")
                self.need(":")
                while not self.end() and not self.at("case", "default"):
                    self.stmt()
        elif m == "object":
            self.listed(self.prop)
        elif m == "pattern":
            self.listed(self.bind_prop)
        elif m == "names":
            self.listed(self.spec)
        elif m == "enum":
            self.listed(self.enum_member)
        elif m == "objtype":
            while not self.end():
                self.type_member()
                if not (self.eat(";") or self.eat(",") or self.end() or self.nl[self.i]):
                    raise Bad("separator expected")
        else:
            raise Bad(m)

    def listed(self, f) -> None:
        while not self.end():
            f()
            if not self.eat(",") and not self.end():
                raise Bad(f"comma expected, found {self.c!r}")

    @property
    def block(self) -> str:
        return "stmts" if self.mode in ("stmts", "switch") else "fn"

    def semi(self) -> None:
        if not (self.eat(";") or self.end() or self.nl[self.i]):
            raise Bad(f"end of statement expected, found {self.c!r}")

    def word(self) -> None:
        """Any name after a dot or as a key, reserved words included."""
        if not (self.c == "x" or self.c[:1].isalpha()):
            raise Bad("name expected")
        self.i += 1

    def stmt(self) -> None:
        c, d = self.c, self.t[self.i + 1]
        if c == "{":
            self.group(self.block)
        elif c == ";":
            self.i += 1
        elif c == "@":
            self.decorators()
            self.stmt()
        elif c in ("var", "const") or c == "let" and (d in ("x", "[", "{") or d in self.NAMES):
            self.i += 1
            if c == "const" and self.ts and self.eat("enum"):
                self.name()
                self.group("enum")
                return
            self.declarators(False)
            self.semi()
        elif c == "function" or c == "async" and d == "function" and not self.nl[self.i + 1]:
            self.function(True)
        elif c == "class":
            self.klass(True)
        elif c == "if":
            self.i += 1
            self.paren()
            self.stmt()
            if self.eat("else"):
                self.stmt()
        elif c == "for":
            self.i += 1
            self.eat("await")
            self.for_head()
            self.stmt()
        elif c == "while":
            self.i += 1
            self.paren()
            self.stmt()
        elif c == "do":
            self.i += 1
            self.stmt()
            self.need("while")
            self.paren()
            self.eat(";")
        elif c == "return":
            if self.block == "stmts":
                raise Bad("return outside of a function")
            self.i += 1
            if not (self.at(";") or self.end() or self.nl[self.i]):
                self.expr()
            self.semi()
        elif c in ("break", "continue"):
            self.i += 1
            if self.is_name() and not self.nl[self.i]:
                self.i += 1
            self.semi()
        elif c == "throw":
            self.i += 1
            if self.nl[self.i]:
                raise Bad("line end after throw")
            self.expr()
            self.semi()
        elif c == "try":
            self.i += 1
            self.group(self.block)
            handled = False
            if self.eat("catch"):
                handled = True
                if self.eat("("):
                    self.binding()
                    if self.ts and self.eat(":"):
                        self.type()
                    self.need(")")
                self.group(self.block)
            if self.eat("finally"):
                handled = True
                self.group(self.block)
            if not handled:
                raise Bad("catch expected")
        elif c == "switch":
            self.i += 1
            self.paren()
            self.group("switch" if self.block == "stmts" else "switchfn")
        elif c == "debugger":
            self.i += 1
            self.semi()
        elif c == "import" and d not in ("(", "."):
            self.imports()
        elif c == "export":
            self.exports()
        elif self.ts and self.ts_decl():
            pass
        elif self.is_name() and d == ":":
            self.i += 2
            self.stmt()
        else:
            self.expr()
            self.semi()

    def ts_decl(self) -> bool:
        c, d = self.c, self.t[self.i + 1]
        names = d == "x" or d in self.NAMES
        if self.nl[self.i + 1] and c != "enum":
            return False
        if c == "interface" and names:
            self.i += 1
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.group("objtype")
        elif c == "type" and names and self.t[self.i + 2] in ("=", "<"):
            self.i += 1
            self.name()
            self.type_params()
            self.need("=")
            self.type()
            self.semi()
        elif c == "enum":
            self.i += 1
            self.name()
            self.group("enum")
        elif c in ("namespace", "module") and (names or d == '""') and self.t[self.i + 2] in ("{", "."):
            self.i += 2
            while self.eat("."):
                self.name()
            self.group("stmts")
        elif c == "global" and d == "{":
            self.i += 1
            self.group("stmts")
        elif c == "abstract" and d == "class":
            self.i += 1
            self.klass(True)
        elif c == "declare" and (d in self.DECLARES or d in ("abstract", "enum", "namespace", "module", "type", "interface", "global", "async")):
            self.i += 1
            if self.at("module") and self.t[self.i + 1] == '""' and self.t[self.i + 2] != "{":
                self.i += 2
                self.semi()
            else:
                self.stmt()
        else:
            return False
        return True

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def for_head(self) -> None:
        self.need("(")
        if self.at("var", "let", "const"):
            self.i += 1
            self.declarators(True)
        elif not self.at(";"):
            self.expr(no_in=True)
        if self.at("of", "in"):
            self.i += 1
            self.expr()
        else:
            self.need(";")
            if not self.at(";"):
                self.expr()
            self.need(";")
            if not self.at(")"):
                self.expr()
        self.need(")")

    def declarators(self, in_for: bool) -> None:
        while True:
            self.binding()
            if self.ts:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assign(in_for)
            if not self.eat(","):
                return

    def binding(self) -> None:
        if self.at("{"):
            self.group("pattern")
        elif self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assign()
                if not self.at("]"):
                    self.need(",")
        else:
            self.name()

    def bind_prop(self) -> None:
        if self.eat("..."):
            self.binding()
            return
        plain = self.is_name()
        self.key()
        if self.eat(":"):
            self.binding()
        elif not plain:
            raise Bad("value expected")
        if self.eat("="):
            self.assign()

    def key(self) -> None:
        if self.eat("["):
            self.assign()
            self.need("]")
        elif self.at("0", '""'):
            self.i += 1
        else:
            self.word()

    def params(self) -> None:
        self.need("(")
        self.commas(self.param, ")")

    def param(self) -> None:
        self.decorators()
        if self.ts:
            while self.at("public", "private", "protected", "readonly", "override") and (self.t[self.i + 1] in ("x", "{", "[") or self.t[self.i + 1] in self.NAMES):
                self.i += 1
        self.eat("...")
        if self.ts and self.at("this"):
            self.i += 1
        else:
            self.binding()
        if self.ts:
            self.eat("?")
            if self.eat(":"):
                self.type()
        if self.eat("="):
            self.assign()

    def signature(self) -> None:
        self.type_params()
        self.params()
        if self.ts and self.eat(":"):
            self.type(True)

    def function(self, declared: bool) -> None:
        self.eat("async")
        self.need("function")
        self.eat("*")
        if self.is_name():
            self.i += 1
        elif declared and not self.at("("):
            raise Bad("name expected")
        self.signature()
        if self.ts and declared and not self.at("{"):
            self.semi()
        else:
            self.group("fn")

    def klass(self, declared: bool) -> None:
        self.need("class")
        if self.is_name() and not self.at("implements"):
            self.i += 1
        self.type_params()
        if self.eat("extends"):
            self.operand()
            if self.ts and self.at("<"):
                self.type_args()
        if self.ts and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.group("class")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.at("("):
                self.paren()
                continue
            self.word()
            while self.eat("."):
                self.word()
            if self.at("("):
                self.args()

    def member(self) -> None:
        if self.eat(";"):
            return
        self.decorators()
        mods = {"static", "async", "get", "set", "accessor"} | ({"readonly", "abstract", "private", "public", "protected", "override", "declare"} if self.ts else set())
        while self.c in mods and (self.t[self.i + 1] not in ("(", "=", ";", ":", "?", "!", "<", "", ",") and not (self.nl[self.i + 1] and self.c not in ("static", "private", "public", "protected", "abstract", "override", "readonly"))):
            if self.c == "static" and self.t[self.i + 1] == "{":
                self.i += 1
                self.group("fn")
                return
            self.i += 1
        self.eat("*")
        if self.ts and self.at("[") and self.t[self.i + 2] == ":":
            self.i += 1
            self.name()
            self.need(":")
            self.type()
            self.need("]")
            if self.eat(":"):
                self.type()
            self.semi()
            return
        self.key()
        if self.ts and self.at("?", "!"):
            self.i += 1
        if self.at("(", "<"):
            self.signature()
            if self.at("{"):
                self.group("fn")
            elif self.ts:
                self.semi()
            else:
                raise Bad("body expected")
            return
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            self.assign()
        self.semi()

    def prop(self) -> None:
        if self.eat("..."):
            self.assign()
            return
        while self.at("async", "get", "set") and self.t[self.i + 1] not in ("(", ":", ",", "=", "", "<"):
            self.i += 1
        star = self.eat("*")
        plain = self.is_name()
        self.key()
        if self.at("(", "<"):
            self.signature()
            self.group("fn")
        elif self.eat(":"):
            self.assign()
        elif not plain or star:
            raise Bad("value expected")
        elif self.eat("="):
            self.assign()

    def spec(self) -> None:
        if self.ts and self.at("type") and self.t[self.i + 1] not in (",", "", "as"):
            self.i += 1
        if not self.eat('""'):
            self.word()
        if self.eat("as") and not self.eat('""'):
            self.word()

    def enum_member(self) -> None:
        self.key()
        if self.eat("="):
            self.assign()

    def source(self) -> None:
        self.need('""')
        if self.at("with") and self.t[self.i + 1] == "{":
            self.i += 1
            self.group("object")
        self.semi()

    def imports(self) -> None:
        if self.mode != "stmts":
            raise Bad("import in a block")
        self.need("import")
        if self.at('""'):
            self.source()
            return
        if self.ts and self.at("type") and self.t[self.i + 1] != "from" and self.t[self.i + 1] != ",":
            self.i += 1
        if self.is_name():
            self.i += 1
            if self.ts and self.eat("="):
                self.expr()
                self.semi()
                return
            if not self.eat(","):
                self.need("from")
                self.source()
                return
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.group("names")
        self.need("from")
        self.source()

    def exports(self) -> None:
        if self.mode != "stmts":
            raise Bad("export in a block")
        self.need("export")
        if self.eat("default"):
            if self.at("function") or self.at("async") and self.t[self.i + 1] == "function":
                self.function(False)
            elif self.at("class"):
                self.klass(False)
            elif self.ts and (self.at("abstract") and self.t[self.i + 1] == "class" or self.at("interface")):
                self.ts_decl()
            else:
                self.assign()
                self.semi()
        elif self.eat("*"):
            if self.eat("as") and not self.eat('""'):
                self.word()
            self.need("from")
            self.source()
        elif self.at("{") or self.ts and self.at("type") and self.t[self.i + 1] in ("{", "*"):
            self.eat("type")
            if self.eat("*"):
                if self.eat("as"):
                    self.word()
                self.need("from")
                self.source()
                return
            self.group("names")
            if self.eat("from"):
                self.source()
            else:
                self.semi()
        elif self.ts and self.eat("="):
            self.expr()
            self.semi()
        elif self.at("var", "let", "const", "function", "class", "async", "@") or self.ts:
            if self.ts and self.eat("import"):
                self.name()
                self.need("=")
                self.expr()
                self.semi()
                return
            if not self.at("var", "let", "const", "function", "class", "async", "@", "declare", "abstract", "interface", "type", "enum", "namespace", "module"):
                raise Bad("declaration expected")
            self.stmt()
        else:
            raise Bad("declaration expected")

    def expr(self, no_in: bool = False) -> None:
        self.assign(no_in)
        while self.eat(","):
            self.assign(no_in)

    def arrow_ahead(self) -> bool:
        i = self.i
        if self.t[i] == "async" and not self.nl[i + 1] and (self.t[i + 1] in ("x", "(", "<")):
            i += 1
        if (self.t[i] == "x" or self.t[i] in self.NAMES) and self.t[i + 1] == "=>":
            return True
        if self.t[i] == "<" and self.ts:
            return False
        if self.t[i] != "(":
            return False
        j = self.closing(i) + 1
        if self.t[j] == "=>":
            return True
        if self.ts and self.t[j] == ":":
            keep, owes = self.i, len(self.owes)
            self.i = j + 1
            try:
                self.type(True)
                return self.c == "=>"
            except Bad:
                return False
            finally:
                self.i = keep
                del self.owes[owes:]
        return False

    def arrow(self) -> None:
        if self.at("async") and self.t[self.i + 1] != "=>":
            self.i += 1
        if self.at("(", "<"):
            self.signature()
        else:
            self.name()
        if self.nl[self.i]:
            raise Bad("line end before arrow")
        self.need("=>")
        if self.at("{"):
            self.group("fn")
        else:
            self.assign()

    def generic_arrow(self) -> None:
        self.eat("async")
        self.signature()
        self.need("=>")
        if self.at("{"):
            self.group("fn")
        else:
            self.assign()

    def assign(self, no_in: bool = False) -> None:
        if self.arrow_ahead():
            self.arrow()
            return
        if self.ts and self.at("<") and self.attempt(self.generic_arrow):
            return
        if self.at("yield"):
            self.i += 1
            self.eat("*")
            if not (self.at(")", "]", ",", ";", ":") or self.end() or self.nl[self.i]):
                self.assign(no_in)
            return
        self.unary()
        while True:
            c = self.c
            if c in self.BINARY or c == "instanceof" or c == "in" and not no_in:
                self.i += 1
                if c == ">":
                    while self.eat(">"):
                        pass
                self.unary()
            elif self.ts and c in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if not self.eat("const"):
                    self.type()
            else:
                break
        if self.eat("?"):
            self.assign()
            self.need(":")
            self.assign(no_in)
        elif self.c in self.ASSIGN:
            self.i += 1
            self.assign(no_in)

    def unary(self) -> None:
        while self.c in self.UNARY or self.at("await") and not (self.t[self.i + 1] in (")", ",", ";", "=", ".", "")):
            self.i += 1
        if self.ts and self.at("<"):
            self.type_args()
            self.unary()
            return
        self.operand()
        if self.at("++", "--") and not self.nl[self.i]:
            self.i += 1

    def args(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.assign()
            if not self.eat(","):
                self.need(")")
                return

    def operand(self) -> None:
        c = self.c
        if c in ('""', "0", "this", "null", "true", "false") or c == "super":
            self.i += 1
        elif c == "async" and self.t[self.i + 1] == "function" and not self.nl[self.i + 1] or c == "function":
            self.function(False)
        elif c == "class" or c == "@":
            self.decorators()
            self.klass(False)
        elif c == "new":
            self.i += 1
            if self.eat("."):
                self.word()
            else:
                self.operand_of_new()
        elif c == "import":
            self.i += 1
            if self.eat("."):
                self.word()
            else:
                self.args()
        elif c == "(":
            self.i += 1
            self.expr()
            self.need(")")
        elif c == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assign()
                if not self.at("]"):
                    self.need(",")
        elif c == "{":
            self.group("object")
        elif self.is_name():
            self.i += 1
        else:
            raise Bad(f"expression expected, found {c!r}")
        self.postfix()

    def operand_of_new(self) -> None:
        if self.eat("new"):
            self.operand_of_new()
            return
        if self.at("("):
            self.paren()
        elif self.at("function", "class"):
            self.function(False) if self.at("function") else self.klass(False)
        elif self.at("this"):
            self.i += 1
        else:
            self.name()
        while self.at(".", "["):
            if self.eat("."):
                self.word()
            else:
                self.i += 1
                self.expr()
                self.need("]")
        if self.ts and self.at("<"):
            self.attempt(self.type_args)
        if self.at("("):
            self.args()

    def postfix(self) -> None:
        while True:
            c = self.c
            if c == ".":
                self.i += 1
                self.word()
            elif c == "?.":
                self.i += 1
                if self.at("("):
                    self.args()
                elif self.eat("["):
                    self.expr()
                    self.need("]")
                else:
                    self.word()
            elif c == "(":
                self.args()
            elif c == "[":
                self.i += 1
                self.expr()
                self.need("]")
            elif c == "``":
                self.i += 1
            elif self.ts and c == "!" and not self.nl[self.i]:
                self.i += 1
            elif self.ts and c == "<" and self.attempt(self.call_types):
                pass
            else:
                return

    def call_types(self) -> None:
        self.type_args()
        if not self.at("(", "``"):
            raise Bad("call expected")

    # types

    def type_params(self) -> None:
        if self.at("<"):
            if not self.ts:
                raise Bad("type parameters")
            self.i += 1
            while not self.eat(">"):
                while self.at("const", "in", "out") and self.t[self.i + 1] in ("x", "in", "out"):
                    self.i += 1
                self.name()
                if self.eat("extends"):
                    self.type()
                if self.eat("="):
                    self.type()
                if not self.eat(","):
                    self.need(">")
                    return

    def type_args(self) -> None:
        self.need("<")
        self.commas(self.type, ">")

    def type(self, returns: bool = False) -> None:
        if returns and self.at("asserts") and (self.t[self.i + 1] in ("x", "this")):
            self.i += 1
        if returns and (self.is_name() or self.at("this")) and self.t[self.i + 1] == "is":
            self.i += 2
            self.type()
            return
        if returns and self.t[self.i - 1] == "asserts":
            self.i += 1
            return
        if self.at("(") and self.t[self.closing(self.i) + 1] == "=>" or self.at("<") or self.at("new") or self.at("abstract") and self.t[self.i + 1] == "new":
            self.eat("abstract")
            self.eat("new")
            self.type_params()
            self.params()
            self.need("=>")
            self.type(True)
            return
        self.eat("|") or self.eat("&")
        self.type_unit()
        while self.at("|", "&"):
            self.i += 1
            if self.at("(") and self.t[self.closing(self.i) + 1] == "=>":
                self.type()
            else:
                self.type_unit()
        if self.at("extends") and not self.nl[self.i]:
            keep, owes = self.i, len(self.owes)
            self.i += 1
            self.type_unit()
            while self.at("|", "&"):
                self.i += 1
                self.type_unit()
            if self.eat("?"):
                self.type()
                self.need(":")
                self.type()
            else:
                self.i = keep
                del self.owes[owes:]

    def type_unit(self) -> None:
        while self.at("keyof", "unique", "readonly", "infer") and self.t[self.i + 1] not in (",", ")", ">", "]", "=", ";", "|", "&", "", "."):
            self.i += 1
        c = self.c
        if c == "{":
            self.group("objtype")
        elif c == "[":
            self.i += 1
            self.commas(self.tuple_item, "]")
        elif c == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif c == "typeof":
            self.i += 1
            if self.at("import"):
                self.i += 1
                self.args()
            else:
                self.word()
            while self.eat("."):
                self.word()
        elif c == "import":
            self.i += 1
            self.args()
            while self.eat("."):
                self.word()
        elif c in ('""', "0", "null", "this", "void", "true", "false", "``"):
            self.i += 1
        elif c == "-" and self.t[self.i + 1] == "0":
            self.i += 2
        else:
            self.name()
            while self.eat("."):
                self.word()
        if self.at("<") and not self.nl[self.i]:
            self.type_args()
        while self.at("[") and not self.nl[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def tuple_item(self) -> None:
        self.eat("...")
        if self.is_name() and (self.t[self.i + 1] == ":" or self.t[self.i + 1] == "?" and self.t[self.i + 2] == ":"):
            self.i += 1
            self.eat("?")
            self.need(":")
        self.type()
        self.eat("?")

    def type_member(self) -> None:
        while self.at("readonly", "get", "set", "+", "-") and self.t[self.i + 1] not in ("(", ":", "?", "<", ",", ";", ""):
            self.i += 1
        if self.at("(", "<") or self.at("new") and self.t[self.i + 1] in ("(", "<"):
            self.eat("new")
            self.signature()
            return
        if self.at("["):
            j = self.closing(self.i)
            inner = self.t[self.i + 2]
            if inner in (":", "in"):
                self.i += 1
                self.name()
                self.i += 1
                self.type()
                if self.eat("as"):
                    self.type()
                self.need("]")
                if self.at("+", "-"):
                    self.i += 1
                self.eat("?")
                if self.eat(":"):
                    self.type()
                return
            self.i += 1
            self.expr()
            self.need("]")
            if self.i != j + 1:
                raise Bad("key")
        else:
            self.key()
        self.eat("?")
        if self.at("(", "<"):
            self.signature()
        elif self.eat(":"):
            self.type()


class TypeScript(Script):
    ts = True


# ---- Go -------------------------------------------------------------------------------------------------------------

_GO_ENDS = frozenset(["x", "0", '""', "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "{"])


class Go(Parser):
    ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
    BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())

    def __init__(self, tokens: list, mode: str) -> None:
        super().__init__(tokens, mode)
        self.no_lit = 0

    def line_end(self) -> bool:
        """Whether a semicolon stands or is inserted here; '{' is the end of a brace group."""
        if self.eat(";"):
            return True
        if self.end():
            return True
        if self.nl[self.i] and self.i and self.t[self.i - 1] in _GO_ENDS:
            self.eat("\n")
            return True
        return False

    def skip(self) -> None:
        while self.at("\n", ";") and not self.end():
            self.i += 1

    def run(self) -> None:
        m = self.mode
        if m == "file":
            self.skip()
            if self.end():
                return
            self.need("package")
            self.name()
            if not self.line_end():
                raise Bad("end of line expected")
            first = True
            while self.skip() or not self.end():
                if self.at("import"):
                    if not first:
                        raise Bad("import after declarations")
                    self.imports()
                else:
                    first = False
                    self.top()
                if not self.line_end():
                    raise Bad(f"end of declaration expected, found {self.c!r}")
        elif m == "tops":
            while self.skip() or not self.end():
                self.top()
                if not self.line_end():
                    raise Bad("end of declaration expected")
        elif m == "stmts":
            while self.skip() or not self.end():
                self.stmt()
                if not self.line_end():
                    raise Bad(f"end of statement expected, found {self.c!r}")
        elif m == "cases":
            while self.skip() or not self.end():
                if self.eat("case"):
                    self.simple_or_types()
                else:
                    self.need("default")
                self.need(":")
                while self.skip() or not (self.end() or self.at("case", "default")):
                    self.stmt()
                    if not self.line_end() and not self.at("case", "default"):
                        raise Bad("end of statement expected")
        elif m == "lit":
            self.skip()
            while not self.end():
                self.element()
                if self.eat(":"):
                    self.element()
                if not self.eat(","):
                    if self.nl[self.i] or not self.end():
                        if self.end() and not self.at("\n"):
                            return
                        raise Bad("comma expected")
                self.skip()
        elif m == "struct":
            while self.skip() or not self.end():
                self.field()
                if self.at('""'):
                    self.i += 1
                if not self.line_end():
                    raise Bad("end of field expected")
        elif m == "interface":
            while self.skip() or not self.end():
                if self.c == "x" and self.t[self.i + 1] == "(":
                    self.i += 1
                    self.sig()
                else:
                    self.union()
                if not self.line_end():
                    raise Bad("end of method expected")
        else:
            raise Bad(m)

    def union(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def element(self) -> None:
        if self.at("{"):
            self.group("lit")
        else:
            self.expr()

    def field(self) -> None:
        if self.eat("*"):
            self.type()
            return
        self.name()
        if self.eat("."):
            self.name()
            return
        if self.at("\n", ";", '""') or self.end() or self.nl[self.i]:
            return
        if self.at("[") and self.attempt(self.embedded):
            return
        while self.eat(","):
            self.name()
        self.type()

    def embedded(self) -> None:
        self.type_args()
        if not (self.nl[self.i] or self.end() or self.at('""')):
            raise Bad("field")

    def imports(self) -> None:
        self.need("import")
        if self.eat("("):
            while self.skip() or not self.eat(")"):
                self.import_spec()
                if not self.line_end() and not self.at(")"):
                    raise Bad("import")
        else:
            self.import_spec()

    def import_spec(self) -> None:
        if self.at("x", "."):
            self.i += 1
        self.need('""')

    def top(self) -> None:
        if self.at("func"):
            self.i += 1
            if self.at("("):
                self.params()
            self.name()
            if self.at("["):
                self.type_params()
            self.sig()
            if self.at("{") and not self.nl[self.i]:
                self.group("stmts")
        elif self.at("var", "const", "type"):
            self.decl()
        else:
            raise Bad(f"declaration expected, found {self.c!r}")

    def decl(self) -> None:
        kind = self.c
        self.i += 1
        if self.eat("("):
            while self.skip() or not self.eat(")"):
                self.spec(kind)
                if not self.line_end() and not self.at(")"):
                    raise Bad("end of declaration expected")
        else:
            self.spec(kind)

    def spec(self, kind: str) -> None:
        self.name()
        if kind == "type":
            if self.at("[") and self.t[self.i + 1] == "x" and self.t[self.i + 2] != "]":
                self.type_params()
            self.eat("=")
            self.type()
            return
        while self.eat(","):
            self.name()
        bare = self.nl[self.i] or self.at("\n", ";", ")") or self.end()
        if not bare and not self.at("="):
            self.type()
        if self.eat("="):
            self.exprs()
        elif kind == "var" and bare:
            raise Bad("type or value expected")

    def type_params(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.name()
            while self.eat(","):
                self.name()
            self.union()
            if not self.eat(","):
                self.need("]")
                return

    def type_args(self) -> None:
        self.need("[")
        self.commas(self.type, "]")

    def sig(self) -> None:
        self.params()
        if self.nl[self.i]:
            return
        if self.at("("):
            self.params()
        elif self.at("x", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def params(self) -> None:
        self.need("(")
        while self.skip() or not self.eat(")"):
            if self.eat("..."):
                self.type()
            else:
                self.type()
                if self.eat("..."):
                    self.type()
                elif not self.at(",", ")"):
                    self.type()
            if not self.eat(","):
                self.need(")")
                return

    def type(self) -> None:
        c = self.c
        if c == "x":
            self.i += 1
            if self.eat("."):
                self.name()
            if self.at("[") and not self.nl[self.i] and self.t[self.i + 1] != "]":
                self.attempt(self.type_args)
        elif c == "*":
            self.i += 1
            self.type()
        elif c == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif c == "[":
            self.i += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    self.expr()
                self.need("]")
            self.type()
        elif c == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif c in ("chan", "<-"):
            self.eat("<-")
            self.need("chan")
            self.eat("<-")
            self.type()
        elif c == "func":
            self.i += 1
            self.sig()
        elif c == "struct":
            self.i += 1
            self.group("struct")
        elif c == "interface":
            self.i += 1
            self.group("interface")
        else:
            raise Bad(f"type expected, found {c!r}")

    def stmt(self) -> None:
        c, d = self.c, self.t[self.i + 1]
        if c == "{":
            self.group("stmts")
        elif c in ("var", "const", "type"):
            self.decl()
        elif c == "if":
            self.if_()
        elif c == "for":
            self.i += 1
            self.no_lit += 1
            if not self.at("{"):
                if not self.at(";"):
                    self.simple()
                if self.at(";"):
                    self.i += 1
                    if not self.at(";"):
                        self.simple()
                    self.need(";")
                    if not self.at("{"):
                        self.simple()
            self.no_lit -= 1
            self.group("stmts")
        elif c in ("switch", "select"):
            self.i += 1
            self.no_lit += 1
            if not self.at("{"):
                if not self.at(";"):
                    self.simple()
                if self.eat(";") and not self.at("{"):
                    self.simple()
            self.no_lit -= 1
            self.group("cases")
        elif c == "return":
            self.i += 1
            if not (self.nl[self.i] or self.at(";", "case", "default") or self.end()):
                self.exprs()
        elif c in ("break", "continue"):
            self.i += 1
            if self.c == "x" and not self.nl[self.i]:
                self.i += 1
        elif c == "goto":
            self.i += 1
            self.name()
        elif c == "fallthrough":
            self.i += 1
        elif c in ("go", "defer"):
            self.i += 1
            self.expr()
        elif c == "x" and d == ":" :
            self.i += 2
            self.skip()
            if not self.end():
                self.stmt()
        elif c in (";", "\n"):
            return
        else:
            self.simple()

    def if_(self) -> None:
        self.need("if")
        self.no_lit += 1
        self.simple()
        if self.eat(";"):
            self.simple()
        self.no_lit -= 1
        self.group("stmts")
        if self.at("else") and not self.nl[self.i]:
            self.i += 1
            if self.at("if"):
                self.if_()
            else:
                self.group("stmts")

    def simple(self) -> None:
        if self.eat("range"):
            self.expr()
            return
        self.exprs()
        if self.c in self.ASSIGN:
            self.i += 1
            if self.eat("range"):
                self.expr()
            else:
                self.exprs()
        elif self.at("++", "--"):
            self.i += 1
        elif self.eat("<-"):
            self.expr()

    def simple_or_types(self) -> None:
        self.item()
        while self.eat(","):
            self.item()
        if self.c in self.ASSIGN:
            self.i += 1
            self.exprs()
        elif self.eat("<-"):
            self.expr()

    def item(self) -> None:
        if not self.attempt(self.expr) or not self.at(",", ":", "=", ":=", "<-"):
            self.type()

    def exprs(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def expr(self) -> None:
        while True:
            while self.at("+", "-", "!", "^", "*", "&", "<-"):
                self.i += 1
            self.operand()
            if self.c in self.BINARY and not (self.nl[self.i] and self.t[self.i - 1] in _GO_ENDS):
                self.i += 1
                continue
            return

    def operand(self) -> None:
        c = self.c
        literal = False
        if c in ("0", '""'):
            self.i += 1
        elif c == "(":
            self.i += 1
            keep, self.no_lit = self.no_lit, 0
            if not self.attempt(self.paren_expr):
                self.type()
                self.need(")")
            self.no_lit = keep
        elif c == "func":
            self.i += 1
            self.sig()
            if self.at("{"):
                self.group("stmts")
        elif c == "x":
            self.i += 1
            literal = True
        elif c in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if self.at("{"):
                self.group("lit")
        else:
            raise Bad(f"expression expected, found {c!r}")
        while not (self.nl[self.i] and self.t[self.i - 1] in _GO_ENDS):
            if self.eat("."):
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif self.at("("):
                self.i += 1
                keep, self.no_lit = self.no_lit, 0
                self.call()
                self.no_lit = keep
                literal = False
            elif self.at("["):
                self.i += 1
                keep, self.no_lit = self.no_lit, 0
                self.index()
                self.no_lit = keep
            elif self.at("{") and literal and not self.no_lit:
                self.group("lit")
                literal = False
            else:
                return

    def paren_expr(self) -> None:
        self.expr()
        self.need(")")

    def call(self) -> None:
        while self.skip() or not self.eat(")"):
            if self.at("[", "map", "chan", "func", "*", "struct", "interface") and self.attempt(self.type_arg):
                pass
            else:
                self.expr()
                self.eat("...")
            if not self.eat(","):
                self.need(")")
                return

    def type_arg(self) -> None:
        self.type()
        if not self.at(",", ")"):
            raise Bad("argument")

    def index(self) -> None:
        while True:
            if not self.at(":", "]"):
                if not self.attempt(self.expr_in_index):
                    self.type()
            if self.eat("]"):
                return
            if not (self.eat(":") or self.eat(",")):
                raise Bad("] expected")

    def expr_in_index(self) -> None:
        self.expr()
        if not self.at(":", "]", ","):
            raise Bad("index")


# ---- Rust -----------------------------------------------------------------------------------------------------------


class Rust(Parser):
    NAMES = frozenset(["union", "default", "macro_rules"])
    ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
    BINARY = frozenset("+ - * / % ^ & | << >> && || == != < > <= >=".split())
    ITEMS = frozenset("pub fn struct enum impl trait mod use const static type extern unsafe async macro_rules union".split())

    def run(self) -> None:
        m = self.mode
        if m in ("file", "items", "traits"):
            while not self.end():
                self.attrs(True)
                if not self.end():
                    self.item()
        elif m == "stmts":
            while not self.end():
                self.stmt()
        elif m == "match":
            while not self.end():
                self.attrs()
                self.pattern()
                if self.eat("if"):
                    self.expr(False)
                self.need("=>")
                block = self.at("{")
                self.expr()
                closed = block and self.t[self.i - 1] == "{"
                if not self.eat(",") and not self.end() and not closed:
                    raise Bad("comma expected")
        elif m == "fields":
            self.listed(self.field)
        elif m == "variants":
            self.listed(self.variant)
        elif m == "lit":
            self.listed(self.lit_field)
        elif m == "patfields":
            self.listed(self.pat_field)
        elif m == "use":
            self.listed(self.use_tree)
        elif m == "any":
            return
        else:
            raise Bad(m)

    def listed(self, f) -> None:
        while not self.end():
            f()
            if not self.eat(",") and not self.end():
                raise Bad(f"comma expected, found {self.c!r}")

    def attrs(self, inner: bool = False) -> None:
        while self.at("#") and (self.t[self.i + 1] == "[" or self.t[self.i + 1] == "!" and self.t[self.i + 2] == "["):
            self.i += 2 if self.t[self.i + 1] == "!" else 1
            end = self.closing(self.i)
            for k in range(self.i, end):
                if k in self.order:
                    self.owes.append((self.order[k], "any"))
            self.i = end + 1

    def vis(self) -> None:
        if self.eat("pub") and self.at("(") and self.t[self.i + 1] in ("crate", "super", "self", "in"):
            self.i = self.closing(self.i) + 1

    def item(self) -> None:
        self.vis()
        while self.at("default", "async", "unsafe", "const", "extern") and self.t[self.i + 1] in ("fn", "async", "unsafe", "extern", "const", '""', "impl", "trait", "type", "mod", "{"):
            if self.at("extern") and self.t[self.i + 1] == '""':
                self.i += 1
            if self.at("extern") and self.t[self.i + 1] == "{":
                break
            self.i += 1
            if self.at("{"):
                self.group("items")
                return
        c = self.c
        if c == "fn":
            self.i += 1
            self.name()
            self.generics()
            self.need("(")
            self.commas(self.fn_param, ")")
            if self.eat("->"):
                self.type()
            self.where()
            if not self.eat(";"):
                self.group("stmts")
        elif c in ("struct", "union") and (self.t[self.i + 1] == "x"):
            self.i += 1
            self.name()
            self.generics()
            self.where()
            if self.eat("("):
                self.commas(self.tuple_field, ")")
                self.where()
                self.need(";")
            elif not self.eat(";"):
                self.group("fields")
        elif c == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.group("variants")
        elif c == "impl":
            self.i += 1
            if self.at("<"):
                self.generics()
            self.eat("const")
            self.eat("!")
            self.type()
            if self.eat("for"):
                self.type()
            self.where()
            self.group("items")
        elif c == "trait":
            self.i += 1
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            self.group("items")
        elif c == "mod":
            self.i += 1
            self.name()
            if not self.eat(";"):
                self.group("items")
        elif c == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif c in ("const", "static"):
            self.i += 1
            self.eat("mut")
            self.name()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr()
            self.need(";")
        elif c == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
            self.where()
            self.need(";")
        elif c == "extern":
            self.i += 1
            self.eat('""')
            if self.at("{"):
                self.group("items")
            else:
                self.need("crate")
                self.i += 1
                if self.eat("as"):
                    self.name()
                self.need(";")
        elif c == "macro_rules" and self.t[self.i + 1] == "!":
            self.i += 2
            self.name()
            self.delimited()
            self.eat(";")
        elif c in ("x", "crate", "self", "super", "::"):
            self.path(False)
            self.need("!")
            braces = self.at("{")
            self.delimited()
            if not braces:
                self.need(";")
        else:
            raise Bad(f"item expected, found {c!r}")

    def delimited(self) -> None:
        if self.at("{"):
            self.group("any")
        elif self.at("(", "["):
            end = self.closing(self.i)
            for k in range(self.i, end):
                if k in self.order:
                    self.owes.append((self.order[k], "any"))
            self.i = end + 1
        else:
            raise Bad("macro input expected")

    def fn_param(self) -> None:
        self.attrs()
        if self.eat("..."):
            return
        keep = self.i
        if self.eat("&"):
            if self.at("'x"):
                self.i += 1
        self.eat("mut")
        if self.eat("self"):
            if self.eat(":"):
                self.type()
            return
        self.i = keep
        self.pattern()
        self.need(":")
        self.type()

    def tuple_field(self) -> None:
        self.attrs()
        self.vis()
        self.type()

    def field(self) -> None:
        self.attrs()
        self.vis()
        self.name()
        self.need(":")
        self.type()

    def variant(self) -> None:
        self.attrs()
        self.vis()
        self.name()
        if self.at("{"):
            self.group("fields")
        elif self.eat("("):
            self.commas(self.tuple_field, ")")
        if self.eat("="):
            self.expr()

    def lit_field(self) -> None:
        self.attrs()
        if self.eat(".."):
            if not self.end():
                self.expr()
            return
        if not self.eat("0"):
            self.name()
        if self.eat(":"):
            self.expr()

    def pat_field(self) -> None:
        self.attrs()
        if self.eat(".."):
            return
        while self.at("ref", "mut"):
            self.i += 1
        if not self.eat("0"):
            self.name()
        if self.eat(":"):
            self.pattern()

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.at("{"):
                self.group("use")
                return
            if self.eat("*"):
                return
            if self.at("crate", "self", "super", "Self"):
                self.i += 1
            else:
                self.name()
            if not self.eat("::"):
                break
        if self.eat("as"):
            self.name()

    def generics(self) -> None:
        if not self.eat("<"):
            return
        while not self.close_angle():
            self.attrs()
            if self.eat("'x"):
                if self.eat(":"):
                    self.bounds()
            else:
                const = self.eat("const")
                self.name()
                if self.eat(":"):
                    self.type() if const else self.bounds()
                if self.eat("="):
                    self.type() if not const else self.operand(True)
            if not self.eat(","):
                if not self.close_angle():
                    raise Bad("> expected")
                return

    def close_angle(self) -> bool:
        """Eats one '>', splitting the operators that begin with it."""
        c = self.c
        if c in (">", ">>", ">=", ">>="):
            if c == ">":
                self.i += 1
            else:
                self.t[self.i] = c[1:]
            return True
        return False

    def where(self) -> None:
        if not self.eat("where"):
            return
        while not (self.at("{", ";", "=") or self.end()):
            if self.eat("'x"):
                pass
            else:
                if self.eat("for"):
                    self.generics()
                self.type()
            self.need(":")
            self.bounds()
            if not self.eat(","):
                return

    def bounds(self) -> None:
        while not (self.at("{", ",", ">", "=", ";", ")", "where") or self.end()):
            if not self.eat("'x"):
                paren = self.eat("(")
                self.eat("?")
                if self.eat("for"):
                    self.generics()
                self.type_path()
                if paren:
                    self.need(")")
            if not self.eat("+"):
                return

    def type(self) -> None:
        c = self.c
        if c in ("&", "&&"):
            self.i += 1
            self.eat("'x")
            self.eat("mut")
            self.type()
        elif c == "*":
            self.i += 1
            if not (self.eat("const") or self.eat("mut")):
                raise Bad("pointer")
            self.type()
        elif c == "[":
            self.i += 1
            self.type()
            if self.eat(";"):
                self.expr()
            self.need("]")
        elif c == "(":
            self.i += 1
            self.commas(self.type, ")")
        elif c == "!":
            self.i += 1
        elif c in ("dyn", "impl"):
            self.i += 1
            self.bounds()
        elif c == "for":
            self.i += 1
            self.generics()
            self.type()
        elif c in ("fn", "unsafe", "extern"):
            self.eat("unsafe")
            if self.eat("extern"):
                self.eat('""')
            self.need("fn")
            self.need("(")
            self.commas(self.fn_type_arg, ")")
            if self.eat("->"):
                self.type()
        else:
            self.type_path()
            if self.at("!"):
                self.i += 1
                self.delimited()

    def fn_type_arg(self) -> None:
        if self.c == "x" and self.t[self.i + 1] == ":":
            self.i += 2
        self.type()

    def type_path(self) -> None:
        if self.eat("<"):
            self.type()
            if self.eat("as"):
                self.type()
            if not self.close_angle():
                raise Bad("> expected")
            self.need("::")
        self.eat("::")
        while True:
            if self.at("crate", "self", "super", "Self"):
                self.i += 1
            else:
                self.name()
            if self.at("::") and self.t[self.i + 1] == "<":
                self.i += 1
            if self.at("<"):
                self.angle_args()
            elif self.at("("):
                self.i += 1
                self.commas(self.type, ")")
                if self.eat("->"):
                    self.type()
            if not self.eat("::"):
                return

    def angle_args(self) -> None:
        self.need("<")
        while not self.close_angle():
            if self.eat("'x"):
                pass
            elif self.at("0", '""', "true", "false", "-"):
                self.eat("-")
                self.i += 1
            elif self.at("{"):
                self.group("stmts")
            elif self.c == "x" and self.t[self.i + 1] in ("=", ":"):
                eq = self.t[self.i + 1] == "="
                self.i += 2
                self.type() if eq else self.bounds()
            else:
                self.type()
            if not self.eat(","):
                if not self.close_angle():
                    raise Bad("> expected")
                return

    def pattern(self) -> None:
        self.eat("|")
        self.pat_one()
        while self.eat("|"):
            self.pat_one()

    def pat_one(self) -> None:
        c = self.c
        if c in ("&", "&&"):
            self.i += 1
            self.eat("mut")
            self.pat_one()
        elif c == "(":
            self.i += 1
            self.commas(self.pattern, ")")
        elif c == "[":
            self.i += 1
            self.commas(self.pattern, "]")
        elif c in ("..", "..="):
            self.i += 1
            if self.at("0", '""', "-"):
                self.pat_lit()
        elif c in ("0", '""', "-", "true", "false"):
            self.pat_lit()
            self.pat_range()
        elif c in ("ref", "mut"):
            while self.at("ref", "mut"):
                self.i += 1
            self.name()
            if self.eat("@"):
                self.pat_one()
        else:
            self.path(True)
            if self.eat("@"):
                self.pat_one()
            elif self.eat("("):
                self.commas(self.pattern, ")")
            elif self.at("{") :
                self.group("patfields")
            elif self.at("!"):
                self.i += 1
                self.delimited()
            else:
                self.pat_range()

    def pat_lit(self) -> None:
        self.eat("-")
        if not self.at("0", '""', "true", "false"):
            raise Bad("literal expected")
        self.i += 1

    def pat_range(self) -> None:
        if self.at("..", "..=", "..."):
            self.i += 1
            if self.at("0", '""', "-"):
                self.pat_lit()
            elif self.at("x"):
                self.path(True)

    def path(self, turbofish: bool) -> None:
        if self.at("<"):
            self.i += 1
            self.type()
            if self.eat("as"):
                self.type()
            if not self.close_angle():
                raise Bad("> expected")
            self.need("::")
        self.eat("::")
        while True:
            if self.at("crate", "self", "super", "Self"):
                self.i += 1
            else:
                self.name()
            if self.at("::") and self.t[self.i + 1] == "<":
                self.i += 1
                self.angle_args()
            if not self.eat("::"):
                return

    def stmt(self) -> None:
        if self.eat(";"):
            return
        self.attrs()
        c, d = self.c, self.t[self.i + 1]
        if c == "let":
            self.i += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr()
                if self.eat("else"):
                    self.group("stmts")
            self.need(";")
            return
        if c in self.ITEMS and not (c in ("unsafe", "async", "const") and d in ("{", "move")) and not (c in ("union", "macro_rules") and d != "x" and d != "!") and not (c == "async" and d in ("|", "||")):
            self.item()
            return
        blocky = c in ("if", "match", "while", "for", "loop", "unsafe", "{") or c == "'x" and d == ":" or c in ("async", "const") and d in ("{", "move")
        if blocky:
            self.operand(True, statement=True)
            if self.at(".", "?"):
                self.postfix(True)
                self.rest(True)
            elif self.c in self.ASSIGN or self.at("as", "==", "!=", "+", "/", "%", "<=", ">=", "..", "..="):
                self.rest(True)
            else:
                self.eat(";")
                return
        else:
            macro = self.i
            self.expr()
            if self.t[self.i - 1] == "{" and self.t[macro] == "x" and "!" in self.t[macro : self.i]:
                self.eat(";")
                return
        if not self.eat(";") and not self.end():
            raise Bad(f"; expected, found {self.c!r}")

    def expr(self, lit: bool = True) -> None:
        if self.at("..", "..="):
            self.i += 1
            if self.at(")", "]", ",", ";", "{", "=>") or self.end():
                return
            self.unary(lit)
        else:
            self.unary(lit)
        self.rest(lit)

    def rest(self, lit: bool) -> None:
        while True:
            c = self.c
            if c in self.BINARY or c in self.ASSIGN:
                self.i += 1
                self.unary(lit)
            elif c == "as":
                self.i += 1
                self.type()
            elif c in ("..", "..="):
                self.i += 1
                if self.at(")", "]", ",", ";", "{", "=>", "}") or self.end():
                    return
                self.unary(lit)
            else:
                return

    def unary(self, lit: bool) -> None:
        while self.at("-", "!", "*", "&", "&&"):
            amp = self.at("&", "&&")
            self.i += 1
            if amp:
                if self.at("raw") and self.t[self.i + 1] in ("const", "mut"):
                    self.i += 1
                self.eat("mut")
        self.operand(lit)

    def operand(self, lit: bool, statement: bool = False) -> None:
        c, d = self.c, self.t[self.i + 1]
        if c in ("0", '""', "true", "false"):
            self.i += 1
        elif c == "(":
            self.i += 1
            self.commas(self.expr, ")")
        elif c == "[":
            self.i += 1
            if not self.eat("]"):
                self.expr()
                if self.eat(";"):
                    self.expr()
                    self.need("]")
                elif self.eat(","):
                    self.commas(self.expr, "]")
                else:
                    self.need("]")
        elif c == "{":
            self.group("stmts")
        elif c in ("unsafe", "async", "const") and d in ("{", "move"):
            self.i += 1
            self.eat("move")
            if self.at("|", "||"):
                self.closure(lit)
                return
            self.group("stmts")
        elif c == "'x" and d == ":":
            self.i += 2
            if not self.at("for", "while", "loop", "{"):
                raise Bad("loop expected")
            self.operand(lit, statement)
            return
        elif c == "if":
            self.if_()
        elif c == "match":
            self.i += 1
            self.expr(False)
            self.group("match")
        elif c == "while":
            self.i += 1
            self.condition()
            self.group("stmts")
        elif c == "for":
            self.i += 1
            self.pattern()
            self.need("in")
            self.expr(False)
            self.group("stmts")
        elif c == "loop":
            self.i += 1
            self.group("stmts")
        elif c in ("|", "||", "move", "static") or c == "async" and d in ("|", "||"):
            self.closure(lit)
            return
        elif c in ("return", "break", "continue"):
            self.i += 1
            if c != "return":
                self.eat("'x")
            if c != "continue" and not (self.at(";", ")", "]", ",", "=>") or self.end() or self.at("{") and not lit):
                self.expr(lit)
            return
        elif c == "let":
            self.i += 1
            self.pattern()
            self.need("=")
            self.unary(False)
            return
        else:
            self.path(True)
            if self.at("!") and self.t[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.delimited()
            elif self.at("{") and lit:
                self.group("lit")
        if not statement:
            self.postfix(lit)

    def closure(self, lit: bool) -> None:
        self.eat("static")
        self.eat("async")
        self.eat("move")
        if not self.eat("||"):
            self.need("|")
            while not self.eat("|"):
                self.pat_one()
                if self.eat(":"):
                    self.type()
                if not self.eat(","):
                    self.need("|")
                    break
        if self.eat("->"):
            self.type()
            self.group("stmts")
        else:
            self.expr(lit)

    def condition(self) -> None:
        self.expr(False)

    def if_(self) -> None:
        self.need("if")
        self.condition()
        self.group("stmts")
        if self.eat("else"):
            if self.at("if"):
                self.if_()
            else:
                self.group("stmts")

    def postfix(self, lit: bool) -> None:
        while True:
            if self.eat("?"):
                pass
            elif self.eat("."):
                if self.at("0", "await"):
                    self.i += 1
                else:
                    self.name()
                    if self.at("::"):
                        self.i += 1
                        self.angle_args()
            elif self.at("("):
                self.i += 1
                self.commas(self.expr, ")")
            elif self.at("["):
                self.i += 1
                self.expr()
                self.need("]")
            else:
                return


# ---- Java -----------------------------------------------------------------------------------------------------------


class Java(Parser):
    NAMES = frozenset(["var", "record", "sealed", "permits", "yield", "non", "module"])
    PRIMS = frozenset("boolean byte char short int long float double".split())
    MODS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default".split())
    ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
    BINARY = frozenset("|| && == != < > <= >= + - * / % << & | ^".split())

    def run(self) -> None:
        m = self.mode
        if m == "file":
            if self.at("@", "package") and self.attempt(self.package):
                pass
            while not self.end():
                if self.eat("import"):
                    self.eat("static")
                    self.name()
                    while self.eat("."):
                        if self.eat("*"):
                            break
                        self.name()
                    self.need(";")
                elif self.eat(";"):
                    continue
                else:
                    self.mods()
                    if not self.type_decl():
                        raise Bad(f"type expected, found {self.c!r}")
        elif m == "members":
            while not self.end():
                self.member(False)
        elif m == "enum":
            while not self.end() and not self.at(";"):
                self.annotations()
                self.name()
                if self.at("("):
                    self.args()
                if self.at("{"):
                    self.group("members")
                if not self.eat(","):
                    break
            if not self.end():
                self.need(";")
                while not self.end():
                    self.member(False)
        elif m == "stmts":
            while not self.end():
                self.stmt()
        elif m == "switch":
            self.cases()
        elif m == "array":
            while not self.end():
                self.init()
                if not self.eat(",") and not self.end():
                    raise Bad("comma expected")
        elif m == "values":
            while not self.end():
                self.value()
                if not self.eat(",") and not self.end():
                    raise Bad("comma expected")
        else:
            raise Bad(m)

    def package(self) -> None:
        self.annotations()
        self.need("package")
        self.name()
        while self.eat("."):
            self.name()
        self.need(";")

    def annotations(self) -> None:
        while self.at("@") and self.t[self.i + 1] != "interface":
            self.i += 1
            self.name()
            while self.eat("."):
                self.name()
            if self.eat("("):
                while not self.eat(")"):
                    if self.is_name() and self.t[self.i + 1] == "=":
                        self.i += 2
                    self.value()
                    if not self.eat(","):
                        self.need(")")
                        break

    def value(self) -> None:
        if self.at("@"):
            self.annotations()
        elif self.at("{"):
            self.group("values")
        else:
            self.expr()

    def mods(self) -> None:
        while True:
            self.annotations()
            if self.c in self.MODS and not (self.at("default") and self.t[self.i + 1] in (":", "->")):
                self.i += 1
            elif self.at("sealed") and self.t[self.i + 1] in ("class", "interface", "abstract", "public"):
                self.i += 1
            elif self.at("non") and self.t[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def type_decl(self) -> bool:
        c = self.c
        if c == "class":
            self.i += 1
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.type()
            if self.eat("implements"):
                self.types()
            if self.eat("permits"):
                self.types()
            self.group("members")
        elif c == "interface" or c == "@" and self.t[self.i + 1] == "interface":
            self.eat("@")
            self.i += 1
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.types()
            if self.eat("permits"):
                self.types()
            self.group("members")
        elif c == "enum":
            self.i += 1
            self.name()
            if self.eat("implements"):
                self.types()
            self.group("enum")
        elif c == "record" and self.t[self.i + 1] == "x" and self.t[self.i + 2] in ("(", "<"):
            self.i += 1
            self.name()
            self.type_params()
            self.params()
            if self.eat("implements"):
                self.types()
            self.group("members")
        else:
            return False
        return True

    def types(self) -> None:
        self.type()
        while self.eat(","):
            self.type()

    def type_params(self) -> None:
        if self.eat("<"):
            while True:
                self.annotations()
                self.name()
                if self.eat("extends"):
                    self.type()
                    while self.eat("&"):
                        self.type()
                if not self.eat(","):
                    break
            self.need(">")

    def type(self) -> None:
        self.annotations()
        if self.c in self.PRIMS or self.at("void"):
            self.i += 1
        else:
            self.name()
            self.type_args()
            while self.at(".") and (self.t[self.i + 1] == "x" or self.t[self.i + 1] == "@"):
                self.i += 1
                self.annotations()
                self.name()
                self.type_args()
        self.dims()

    def dims(self) -> None:
        while self.at("[") and self.t[self.i + 1] == "]":
            self.i += 2

    def type_args(self) -> None:
        if self.eat("<"):
            if self.eat(">"):
                return
            while True:
                self.annotations()
                if self.eat("?"):
                    if self.at("extends", "super"):
                        self.i += 1
                        self.type()
                else:
                    self.type()
                if not self.eat(","):
                    break
            self.need(">")

    def params(self) -> None:
        self.need("(")
        self.commas(self.param, ")")

    def param(self) -> None:
        self.mods()
        self.type()
        self.annotations()
        self.eat("...")
        if self.at("this"):
            self.i += 1
            return
        self.name()
        if self.eat("."):
            self.need("this")
        self.dims()

    def member(self, _: bool) -> None:
        if self.eat(";"):
            return
        if self.at("static") and self.t[self.i + 1] == "{":
            self.i += 1
            self.group("stmts")
            return
        if self.at("{"):
            self.group("stmts")
            return
        self.mods()
        if self.type_decl():
            return
        self.type_params()
        if self.is_name() and self.t[self.i + 1] == "(":
            self.i += 1
            self.params()
            self.throws()
            self.group("stmts")
            return
        if self.is_name() and self.t[self.i + 1] == "{":
            self.i += 1
            self.group("stmts")
            return
        self.type()
        self.name()
        if self.at("("):
            self.params()
            self.dims()
            self.throws()
            if self.eat("default"):
                self.value()
            if not self.eat(";"):
                self.group("stmts")
            return
        self.dims()
        self.declared()
        self.need(";")

    def throws(self) -> None:
        if self.eat("throws"):
            self.types()

    def declared(self) -> None:
        """The rest of declarators after the first name."""
        if self.eat("="):
            self.init()
        while self.eat(","):
            self.name()
            self.dims()
            if self.eat("="):
                self.init()

    def init(self) -> None:
        if self.at("{"):
            self.group("array")
        else:
            self.expr()

    def local(self) -> None:
        self.mods()
        self.type()
        self.name()
        self.dims()
        if not self.at("=", ";", ",", ":"):
            raise Bad("declaration")
        self.declared()

    def stmt(self) -> None:
        c, d = self.c, self.t[self.i + 1]
        if c == "{":
            self.group("stmts")
        elif c == ";":
            self.i += 1
        elif c in ("class", "interface", "enum", "abstract", "static") or c == "@" or c == "final" or c == "record" and d == "x" and self.t[self.i + 2] in ("(", "<"):
            keep = self.i
            self.mods()
            if not self.type_decl():
                self.i = keep
                self.local()
                self.need(";")
        elif c == "if":
            self.i += 1
            self.paren()
            self.stmt()
            if self.eat("else"):
                self.stmt()
        elif c == "while":
            self.i += 1
            self.paren()
            self.stmt()
        elif c == "do":
            self.i += 1
            self.stmt()
            self.need("while")
            self.paren()
            self.need(";")
        elif c == "for":
            self.i += 1
            self.need("(")
            if not self.at(";"):
                if not self.attempt(self.local):
                    self.expr()
                    while self.eat(","):
                        self.expr()
            if self.eat(":"):
                self.expr()
            else:
                self.need(";")
                if not self.at(";"):
                    self.expr()
                self.need(";")
                if not self.at(")"):
                    self.expr()
                    while self.eat(","):
                        self.expr()
            self.need(")")
            self.stmt()
        elif c == "return":
            self.i += 1
            if not self.at(";"):
                self.expr()
            self.need(";")
        elif c in ("break", "continue"):
            self.i += 1
            if self.is_name():
                self.i += 1
            self.need(";")
        elif c == "throw" or c == "yield" and d not in ("=", ".", "(", "++", "--", "["):
            self.i += 1
            self.expr()
            self.need(";")
        elif c == "assert":
            self.i += 1
            self.expr()
            if self.eat(":"):
                self.expr()
            self.need(";")
        elif c == "synchronized":
            self.i += 1
            self.paren()
            self.group("stmts")
        elif c == "try":
            self.i += 1
            res = False
            if self.eat("("):
                res = True
                while not self.eat(")"):
                    if not self.attempt(self.local):
                        self.expr()
                    if not self.eat(";"):
                        self.need(")")
                        break
            self.group("stmts")
            handled = res
            while self.eat("catch"):
                handled = True
                self.need("(")
                self.mods()
                self.type()
                while self.eat("|"):
                    self.type()
                self.name()
                self.need(")")
                self.group("stmts")
            if self.eat("finally"):
                handled = True
                self.group("stmts")
            if not handled:
                raise Bad("catch expected")
        elif c == "switch":
            self.i += 1
            self.paren()
            self.group("switch")
            if self.at(".", ";"):
                self.postfix()
                self.eat(";")
        elif self.is_name() and d == ":":
            self.i += 2
            self.stmt()
        elif (self.is_name() or c in self.PRIMS) and self.attempt(self.local):
            self.need(";")
        else:
            start = self.i
            self.expr()
            seen = self.t[start : self.i]
            if not (seen[0] in ("new", "++", "--") or seen[-1] in (")", "++", "--") or any(x in self.ASSIGN for x in seen)):
                raise Bad("not a statement")
            self.need(";")

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def cases(self) -> None:
        while not self.end():
            if self.eat("case"):
                self.label()
                while self.eat(","):
                    self.label()
                if self.at("x") and self.c == "when":
                    self.i += 1
            else:
                self.need("default")
            if self.eat("->"):
                if self.at("{"):
                    self.group("stmts")
                elif self.at("throw"):
                    self.stmt()
                else:
                    self.expr()
                    self.need(";")
                continue
            self.need(":")
            while not self.end() and not (self.at("case") or self.at("default") and self.t[self.i + 1] in (":", "->")):
                self.stmt()

    def label(self) -> None:
        if self.eat("default"):
            return
        if not self.attempt(self.type_pattern):
            self.ternary()

    def type_pattern(self) -> None:
        self.mods()
        self.type()
        if self.eat("("):
            self.commas(self.type_pattern, ")")
            if self.is_name() and self.t[self.i + 1] != "->":
                self.i += 1
        else:
            self.name()
        if self.is_name():
            self.i += 1
            self.ternary()
        if not self.at("->", ":", ",", ")", "&&", "||"):
            raise Bad("pattern")

    def expr(self) -> None:
        self.ternary()
        if self.c in self.ASSIGN:
            self.i += 1
            self.expr()

    def lambda_ahead(self) -> bool:
        if self.is_name() and self.t[self.i + 1] == "->":
            return True
        return self.at("(") and self.t[self.closing(self.i) + 1] == "->"

    def lambda_(self) -> None:
        if self.eat("("):
            if not self.attempt(self.commas, self.name, ")"):
                self.commas(self.param, ")")
        else:
            self.name()
        self.need("->")
        if self.at("{"):
            self.group("stmts")
        else:
            self.expr()

    def ternary(self) -> None:
        if self.lambda_ahead():
            self.lambda_()
            return
        self.unary()
        while True:
            c = self.c
            if c == "instanceof":
                self.i += 1
                self.eat("final")
                if not self.attempt(self.inst_pattern):
                    self.type()
            elif c in self.BINARY:
                self.i += 1
                if c == ">":
                    while self.eat(">"):
                        pass
                    if self.at(">="):
                        self.i += 1
                self.unary()
            else:
                break
        if self.eat("?"):
            self.expr()
            self.need(":")
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.ternary()

    def inst_pattern(self) -> None:
        self.type()
        if self.eat("("):
            self.commas(self.param_or_pattern, ")")
        else:
            self.name()

    def param_or_pattern(self) -> None:
        self.type()
        if self.eat("("):
            self.commas(self.param_or_pattern, ")")
        else:
            self.name()

    def unary(self) -> None:
        while self.at("+", "-", "!", "~", "++", "--"):
            self.i += 1
        if self.at("(") and self.attempt(self.cast):
            return
        self.operand()
        while self.at("++", "--"):
            self.i += 1

    def cast(self) -> None:
        self.need("(")
        prim = self.c in self.PRIMS
        self.type()
        while self.eat("&"):
            self.type()
        self.need(")")
        if self.lambda_ahead():
            self.lambda_()
            return
        if not prim and not (self.is_name() or self.at("(", "!", "~", '""', "0", "this", "super", "new", "true", "false", "null", "switch")):
            raise Bad("no cast")
        self.unary()

    def args(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.expr()
            if not self.eat(","):
                self.need(")")
                return

    def operand(self) -> None:
        c = self.c
        if c in ("0", '""', "true", "false", "null", "this", "super"):
            self.i += 1
        elif c == "(":
            self.paren()
        elif c == "new":
            self.new()
        elif c == "switch":
            self.i += 1
            self.paren()
            self.group("switch")
        elif c in self.PRIMS or c == "void":
            self.i += 1
            self.dims()
            if not self.at("::", "."):
                raise Bad("type as expression")
        elif self.is_name():
            self.i += 1
            if self.at("<"):
                self.attempt(self.generic_ref)
            if self.at("[") and self.t[self.i + 1] == "]":
                self.dims()
        else:
            raise Bad(f"expression expected, found {c!r}")
        self.postfix()

    def generic_ref(self) -> None:
        self.type_args()
        self.dims()
        if not self.at("::"):
            raise Bad("reference")

    def new(self) -> None:
        self.need("new")
        self.annotations()
        if self.c in self.PRIMS:
            self.i += 1
        else:
            self.name()
            self.type_args()
            while self.eat("."):
                self.name()
                self.type_args()
        if self.at("["):
            while self.eat("["):
                if not self.eat("]"):
                    self.expr()
                    self.need("]")
            if self.at("{"):
                self.group("array")
        else:
            self.args()
            if self.at("{"):
                self.group("members")

    def postfix(self) -> None:
        while True:
            if self.eat("."):
                if self.at("<"):
                    self.type_args()
                if self.at("new"):
                    self.new()
                elif self.at("class", "this", "super"):
                    self.i += 1
                else:
                    self.name()
            elif self.at("("):
                self.args()
            elif self.at("["):
                self.i += 1
                self.expr()
                self.need("]")
            elif self.eat("::"):
                if not self.eat("new"):
                    self.name()
            else:
                return


# ---- pieces ---------------------------------------------------------------------------------------------------------

_JS_GOES_ON = frozenset("else catch finally while . ?. ( [ , ; ) ] ? : = == === != !== + - * / % & | ^ && || ?? < > <= >= instanceof in of as satisfies from => ``".split())
_RUST_STARTS = frozenset("x let if for while loop match return break continue pub fn struct enum impl trait mod use const static type unsafe async self Self macro_rules extern #".split())


def _pieces_js(tokens: list) -> list[list]:
    out, piece, depth = [], [], 0
    n = len(tokens)
    for k, t in enumerate(tokens):
        piece.append(t)
        if isinstance(t, Group):
            nxt = tokens[k + 1] if k + 1 < n else None
            if not depth and nxt is not None and nxt[0] == "\n" and nxt[1:] not in _JS_GOES_ON:
                out.append(piece)
                piece = []
            continue
        c = t[1:] if t[0] == "\n" else t
        if c in ("(", "["):
            depth += 1
        elif c in (")", "]"):
            depth -= 1
        elif c == ";" and not depth:
            # only where no statement without braces can go on with else
            nxt = tokens[k + 1] if k + 1 < n else None
            if nxt is None or nxt.lstrip("\n") not in ("else", "while"):
                out.append(piece)
                piece = []
    if piece:
        out.append(piece)
    return out


def _pieces_rust(tokens: list) -> list[list]:
    out, piece, depth = [], [], 0
    n = len(tokens)
    for k, t in enumerate(tokens):
        piece.append(t)
        if isinstance(t, Group):
            if not depth and k + 1 < n and tokens[k + 1] in _RUST_STARTS and "where" not in piece:
                out.append(piece)
                piece = []
        elif t in ("(", "["):
            depth += 1
        elif t in (")", "]"):
            depth -= 1
        elif t == ";" and not depth:
            out.append(piece)
            piece = []
    if piece:
        out.append(piece)
    return out


def _pieces_java(tokens: list) -> list[list]:
    out, piece, depth = [], [], 0
    n = len(tokens)
    goes_on = ("else", "catch", "finally", "while", ";", ".", ",", ")", "]", "::", "[", "(", "=", "+", "?", ":", "==")
    for k, t in enumerate(tokens):
        piece.append(t)
        if isinstance(t, Group):
            if not depth and k + 1 < n and tokens[k + 1] not in goes_on:
                out.append(piece)
                piece = []
        elif t in ("(", "["):
            depth += 1
        elif t in (")", "]"):
            depth -= 1
        elif t == ";" and not depth and (k + 1 >= n or tokens[k + 1] not in ("else", "while")):
            out.append(piece)
            piece = []
    if piece:
        out.append(piece)
    return out


def _pieces_go(tokens: list) -> list[list]:
    out, piece, depth = [], [], 0
    prev = ""
    for t in tokens:
        if isinstance(t, Group):
            piece.append(t)
            prev = "{"
            continue
        if t[0] == "\n" and not depth and prev in _GO_ENDS and piece:
            out.append([*piece, "\n"])
            piece = []
            if t == "\n":
                prev = ""
                continue
        c = t[1:] if t[0] == "\n" and len(t) > 1 else t
        piece.append(t)
        if c in ("(", "["):
            depth += 1
        elif c in (")", "]"):
            depth -= 1
        prev = c
    if piece and piece != ["\n"]:
        out.append(piece)
    return out


_GRAMMAR = {
    "js": (Script, {"stmts", "fn", "class"}, _pieces_js), "ts": (TypeScript, {"stmts", "fn", "class"}, _pieces_js), "tsx": (TypeScript, {"stmts", "fn", "class"}, _pieces_js),
    "rust": (Rust, {"file", "items", "stmts"}, _pieces_rust), "java": (Java, {"members", "stmts"}, _pieces_java), "go": (Go, {"stmts"}, _pieces_go),
}
#: Shapes remembered in a worker; beyond this the memory starts anew.
REMEMBER = 200_000
_memory: dict[tuple, list | None] = {}


def _parsed(lang: str, mode: str, piece: list, last: bool) -> list[tuple[int, str]]:
    parser = _GRAMMAR[lang][0](piece, mode)
    parser.run()
    if not parser.end():
        raise Bad(f"unexpected {parser.c!r}")
    if lang == "rust" and mode == "stmts" and not last and parser.t[parser.n - 1] not in (";", "{"):
        raise Bad("; expected")
    return parser.owes


def _parsed_or_none(*args) -> list[tuple[int, str]] | None:
    try:
        return _parsed(*args)
    except Bad:
        return None


def _deep(f, n_tokens: int, *args):
    """Runs a parser on a piece that nests deeper than the usual limit of calls: each token can cost some tens of them.

    Calls between Python functions take no room on the C stack, and the thread
    that runs this has a large one for what else is called.
    """
    import sys
    import threading

    before, out = sys.getrecursionlimit(), []
    old = threading.stack_size(256 << 20)
    sys.setrecursionlimit(before + 60 * n_tokens + 1000)
    try:
        t = threading.Thread(target=lambda: out.append(f(*args)))
        t.start()
        t.join()
    finally:
        sys.setrecursionlimit(before)
        threading.stack_size(old)
    if not out:
        raise RecursionError("nested too deep to be parsed")
    return out[0]


def _parse_piece(lang: str, mode: str, piece: list, last: bool) -> list[tuple[Group, str]]:
    """Parses one piece, or looks up its shape; the groups in it and their modes."""
    shape = (lang, mode, last, " ".join(["{}" if isinstance(x, Group) else x for x in piece]))
    owes = _memory.get(shape, 0)
    if owes == 0:
        try:
            owes = _parsed(lang, mode, piece, last)
        except Bad:
            owes = None
        except RecursionError:
            owes = _deep(_parsed_or_none, len(piece), lang, mode, piece, last)
        if len(_memory) >= REMEMBER:
            _memory.clear()
        _memory[shape] = owes
    if owes is None:
        raise Bad(shape[3][:120])
    groups = [x for x in piece if isinstance(x, Group)]
    return [(groups[k], m) for k, m in owes]


def parse(group: Group, lang: str) -> None:
    """Parses a whole file, block by block; raises Bad."""
    split_modes, cut = _GRAMMAR[lang][1], _GRAMMAR[lang][2]
    todo = [(group, "stmts" if lang in ("js", "ts", "tsx") else "file")]
    while todo:
        g, mode = todo.pop()
        if mode == "any":
            continue
        if mode not in split_modes:
            todo += _parse_piece(lang, mode, g.tokens, True)
            continue
        pieces = cut(g.tokens)
        for k, piece in enumerate(pieces):
            todo += _parse_piece(lang, mode, piece, k == len(pieces) - 1)


def parse_python(text: str) -> None:
    """Parses Python with the interpreter's own grammar, compile-time syntax errors included."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text.lstrip("﻿"), "f", "exec", ast.PyCF_ALLOW_TOP_LEVEL_AWAIT & 0, dont_inherit=True)
        except (SyntaxError, ValueError) as e:
            raise Bad(str(e)) from None
        except (RecursionError, MemoryError):
            _parse_deep_python(text)


def _parse_deep_python(text: str) -> None:
    """A file that the interpreter's compiler cannot hold: its parser alone decides, or where that gives up too, its tokenizer."""
    import io
    import tokenize as tk

    try:
        ast.parse(text.lstrip("\ufeff"))
    except (SyntaxError, ValueError) as e:
        raise Bad(str(e)) from None
    except (RecursionError, MemoryError):
        try:
            for _ in tk.generate_tokens(io.StringIO(text.lstrip("\ufeff")).readline):
                pass
        except (tk.TokenError, SyntaxError) as e:
            raise Bad(str(e)) from None


def valid(text: str | None, lang: str | None) -> bool:
    """Whether a text is valid syntax. Null, blank and comment-only texts and unknown languages are."""
    if not text or not lang or not text.strip():
        return True
    try:
        if lang == "python":
            parse_python(text)
        else:
            parse(tokenize(text, lang), lang)
    except Bad:
        return False
    return True
