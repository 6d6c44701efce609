"""Lexers: states at chunk borders, bracket summaries, and token groups.

A file is cut into chunks at line ends. For every state in which a chunk can
begin, its map gives the state in which it ends and what brackets it leaves
open. Maps compose associatively, so chunks of one file may lie in any
partition. Files whose maps end in code with nothing open are then cut into
statements, which are parsed on their own.
"""

from __future__ import annotations

import re

# The language of each file extension.
LANGUAGE = {
    "py": "python", "pyi": "python", "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js",
    "go": "go", "rs": "rust", "java": "java",
}


def language(path: str | None) -> str | None:
    return LANGUAGE.get((path or "").rsplit(".", 1)[-1].lower()) if "." in (path or "") else None


class Bad(Exception):
    """The text is not valid syntax."""


CODE = "code"
#: The state of a chunk that begins in a state of which the map before has no entry.
UNKNOWN = "?"
#: States in which a line can begin, by language. Rust comments nest, so a depth follows the name. In ECMAScript "`" is the text of a
#: template and "`{n" the code of an expression in it with n braces open since; they nest. States nested deeper than these are not mapped.
STATES = {
    "python": [CODE, '"""', "'''"],
    "js": [CODE, "/*", "`", "`{0", "`{1", "`{0`"],
    "go": [CODE, "/*", "`"],
    "rust": [CODE, "/*1", "/*2", '"', 'r"', 'r#"', 'r##"'],
    "java": [CODE, "/*", '"""'],
}
STATES["ts"] = STATES["tsx"] = STATES["js"]

_PAIR = {")": "(", "]": "[", "}": "{"}
_SCAN = {
    "python": re.compile(r"#[^\n]*|[rRbBuUfFtT]{0,2}(?P<q>\"\"\"|'''|\"|')|[()\[\]{}]"),
    "js": re.compile(r"//[^\n]*|/\*|(?P<q>[\"'`])|[()\[\]{}]|(?P<re>/)"),
    "go": re.compile(r"//[^\n]*|/\*|(?P<q>[\"'`])|[()\[\]{}]"),
    "rust": re.compile(r"//[^\n]*|/\*|b?r(?P<h>#*)\"|(?P<q>b?\")|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'|'\w+|[()\[\]{}]"),
    "java": re.compile(r"//[^\n]*|/\*|(?P<q>\"\"\"|\"|')|[()\[\]{}]"),
}
_SCAN["ts"] = _SCAN["tsx"] = _SCAN["js"]
_LINE = {q: re.compile(rf"(?:[^{q}\\\n]|\\(?:\r\n|.|\n))*{q}", re.S) for q in "\"'"}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def _skip(text: str, at: int, state: str) -> tuple[int, str]:
    """Leaves a string or comment that began before ``at``: where, and the state if it does not end."""
    if state.startswith("/*"):
        if len(state) == 2:
            end = text.find("*/", at)
            return (len(text), state) if end < 0 else (end + 2, CODE)
        depth = int(state[2:])
        for m in re.compile(r"/\*|\*/").finditer(text, at):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end(), CODE
        return len(text), f"/*{depth}"
    if state in ('"""', "'''") or state == '"':
        for m in re.compile(r"\\.|" + state, re.S).finditer(text, at):
            if m[0] == state:
                return m.end(), CODE
        return len(text), state
    if state == "`":
        for m in re.compile(r"\\.|`", re.S).finditer(text, at):
            if m[0] == "`":
                return m.end(), CODE
        return len(text), state
    mark = '"' + state[1:-1]
    end = text.find(mark, at)
    return (len(text), state) if end < 0 else (end + len(mark), CODE)


def _context(state: str) -> tuple[list[str], bool]:
    """Brackets open around a place in templates, and whether the place is in a template's text."""
    stack: list[str] = []
    for level in state.split("`")[1:]:
        if level:
            stack += ["$", *["{"] * int(level[1:])]
    return stack, state.endswith("`")


def _named(stack: list[str], text: bool) -> str:
    depths: list[int] = []
    for t in stack:
        if t == "$":
            depths.append(0)
        elif t == "{" and depths:
            depths[-1] += 1
    return "".join(f"`{{{d}" for d in depths) + ("`" if text else "") or CODE


_TEXT_END = re.compile(r"\\.|`|\$\{", re.S)


def chunk_map(text: str, lang: str, start: str) -> tuple[str, str, str, bool]:
    """(end state, unmatched closers, unmatched openers, valid) of a chunk that begins in ``start``."""
    scan, script = _SCAN[lang], lang in ("js", "ts", "tsx")
    around, in_text = _context(start) if start[0] == "`" and script else ([], False)
    at, state = (0, CODE) if start == CODE or around or in_text else _skip(text, 0, start)
    closers: list[str] = []
    openers: list[str] = []
    if state != CODE:
        return state, "", "", True
    while True:
        if in_text:
            while (e := _TEXT_END.search(text, at)) and e[0][0] == "\\":
                at = e.end()
            if not e:
                return _named(around + openers, True), "".join(closers), "".join(openers), True
            at, in_text = e.end(), False
            if e[0] == "${":
                openers.append("$")
        m = scan.search(text, at)
        if not m:
            break
        t = m[0]
        at = m.end()
        if t in ("(", "[", "{"):
            openers.append(t)
        elif t in _PAIR:
            if openers:
                top = openers.pop()
                if top == "$" and t == "}":
                    in_text = True
                elif top != _PAIR[t]:
                    return CODE, "", "", False
            else:
                closers.append(t)
                if t == "}" and around:
                    in_text = around.pop() == "$"
        elif t.startswith("//") or t.startswith("#"):
            continue
        elif t == "/*":
            at, state = _skip(text, at, "/*1" if lang == "rust" else "/*")
        elif t == "/":
            before = text[: m.start()].rstrip()[-1:]
            if not before or before in "(,=:[!&|?{};+-*%<>~^" or re.search(r"\b(?:return|typeof|case|in|of|void|delete|throw|new|else|do)$", text[max(0, m.start() - 12) : m.start()].rstrip()):
                r = _REGEX.match(text, m.start())
                at = r.end() if r else at
        elif lang == "rust" and m["h"] is not None:
            at, state = _skip(text, at, f'r{m["h"]}"')
        elif m["q"] is not None:
            q = m["q"].lstrip("b")
            if len(q) == 3:
                at, state = _skip(text, at, q)
            elif q == "`":
                if script:
                    in_text = True
                else:
                    at, state = _skip(text, at, "`")
            elif lang == "rust":
                at, state = _skip(text, at, '"')
            else:
                s = _LINE[q].match(text, at)
                if not s or lang in ("go", "java") and "\n" in s[0]:
                    return CODE, "", "", False
                at = s.end()
        if state != CODE:
            inside = _named(around + openers, False) if script else CODE
            return (state if inside == CODE else inside + state), "".join(closers), "".join(openers), True
    return (_named(around + openers, False) if script else CODE), "".join(closers), "".join(openers), True


def _template(text: str, at: int) -> tuple[int, str]:
    """Behind a template literal; the expressions in it are skipped by their brackets."""
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1, CODE
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                c = text[at]
                if c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                elif c == "`":
                    at, state = _template(text, at + 1)
                    if state != CODE:
                        return at, state
                    continue
                elif c in "\"'":
                    s = _LINE[c].match(text, at + 1)
                    at = s.end() - 1 if s else at
                at += 1
        else:
            at += 1
    return len(text), "`"


def compose(left: dict[str, tuple], right: dict[str, tuple]) -> dict[str, tuple]:
    """The map of two adjoining pieces. Associative. A state that the right one does not map leads to UNKNOWN."""
    out = {}
    for start, (mid, closers, openers, ok) in left.items():
        if not ok:
            out[start] = (CODE, "", "", False)
            continue
        if mid not in right:
            out[start] = (UNKNOWN, "", "", True)
            continue
        end, c2, o2, ok2 = right[mid]
        if not ok2 or end == UNKNOWN:
            out[start] = (end, "", "", ok2)
            continue
        stack = list(openers)
        valid, extra = True, []
        for c in c2:
            if stack:
                top = stack.pop()
                if top != _PAIR[c] and not (top == "$" and c == "}"):
                    valid = False
                    break
            else:
                extra.append(c)
        out[start] = (end, closers + "".join(extra), "".join(stack) + o2, True) if valid else (CODE, "", "", False)
    return out


def balanced(m: tuple) -> bool | None:
    """Whether a whole file's map, begun in code, ends in code with no bracket open; None if the map does not tell."""
    end, closers, openers, ok = m
    return None if ok and end == UNKNOWN else ok and end == CODE and not closers and not openers


# ---- tokens -------------------------------------------------------------------------------------------------------

# The reserved and contextual words that the grammars tell apart.
WORDS = {
    "js": "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static async of get set as from",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while macro_rules union default",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record sealed permits var yield non module",
}
WORDS["ts"] = WORDS["js"] + " interface type namespace module declare abstract readonly private public protected implements keyof infer is asserts satisfies unique override global require out accessor"
WORDS["tsx"] = WORDS["ts"]
WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}

_NUM = r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?"
_TOKEN = {
    "js": re.compile(rf"(?P<ws>[^\S\n  ]+|//[^\n]*)|(?P<nl>[\n  ])|(?P<bc>/\*.*?\*/)|(?P<id>#?[^\W\d]\w*|#?\$[\w$]*|#?[^\W\d][\w$]*)|(?P<num>(?:{_NUM})n?)|(?P<str>\"(?:[^\"\\\n]|\\(?:\r\n|.|\n))*\"|'(?:[^'\\\n]|\\(?:\r\n|.|\n))*')|(?P<tm>`)|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%=<>!&|^~?:;,.()\[\]{{}}@])", re.S),
    "go": re.compile(rf"(?P<ws>[^\S\n]+|//[^\n]*)|(?P<nl>\n)|(?P<bc>/\*.*?\*/)|(?P<id>[^\W\d]\w*)|(?P<num>(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?|{_NUM})i?)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}}|.))')|(?P<op>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%=<>!&|^~:;,.()\[\]{{}}])", re.S),
    "rust": re.compile(r"(?P<ws>\s+|//[^\n]*)|(?P<bc>/\*)|(?P<raw>b?c?r(?P<h>#*)\".*?\"(?P=h))|(?P<str>[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')|(?P<life>'[^\W\d]\w*)|(?P<id>r#[^\W\d]\w*|[^\W\d]\w*)|(?P<num>0[xX][0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0[bB][01_]+(?:[iu]\w+)?|0[oO][0-7_]+(?:[iu]\w+)?|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?)|(?P<op><<=|>>=|\.\.=|\.\.\.|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[-+*/%=<>!&|^~?:;,.()\[\]{}@#$])", re.S),
    "java": re.compile(rf"(?P<ws>\s+|//[^\n]*)|(?P<bc>/\*.*?\*/)|(?P<str>\"\"\"(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)')|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?|{_NUM})[lLfFdD]?)|(?P<op>>>>=|\.\.\.|<<=|>>=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%=<>!&|^~?:;,.()\[\]{{}}@])", re.S),
}
_TOKEN["ts"] = _TOKEN["tsx"] = _TOKEN["js"]

_OPERAND_END = frozenset(["x", "0", '""', ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"])


class Group:
    """The tokens between a pair of braces. A token is its class; a brace group within is a Group."""

    __slots__ = ("tokens",)

    def __init__(self) -> None:
        self.tokens: list = []


def tokenize(text: str, lang: str) -> Group:
    """Token classes of a text, braces as groups; raises Bad at what is no token, an open string or bracket.

    Names become 'x', numbers '0', texts '""'; words and operators stay. A line
    end is kept as a leading newline where the language cares for it.
    """
    match, words, lines = _TOKEN[lang].match, WORDS[lang], lang in ("js", "ts", "tsx", "go")
    js = lang in ("js", "ts", "tsx")
    at, n = (1 if text.startswith("﻿") else 0), len(text)
    if text.startswith("#!", at) and (js or lang == "rust" and not text.startswith("#![", at)):
        at = text.find("\n", at) if "\n" in text else n
    top = here = Group()
    stack: list[tuple[str, Group]] = []
    nl = ""
    last = ""
    while at < n:
        m = match(text, at)
        if not m:
            raise Bad(f"no token at {at}")
        kind = m.lastgroup
        t = m[0]
        start, at = at, m.end()
        if kind == "ws":
            continue
        if kind == "nl":
            nl = "\n"
            continue
        if kind == "bc":
            if lang == "rust":
                at, state = _skip(text, start + 2, "/*1")
                if state != CODE:
                    raise Bad("open comment")
            elif lines and "\n" in t:
                nl = "\n"
            continue
        if kind == "id":
            c = t if t in words else "x"
        elif kind == "num":
            if at < n and (text[at].isalnum() or text[at] == "_"):
                raise Bad("name joins number")
            c = "0"
        elif kind in ("str", "raw", "h"):
            c = '""'
        elif kind == "life":
            c = "'x"
        elif kind == "tm":
            at, state = _template(text, at)
            if state != CODE:
                raise Bad("open template")
            c = '""' if last not in _OPERAND_END else "``"
        else:
            c = t
            if t == "/" or t == "/=":
                if js and last not in _OPERAND_END:
                    r = _REGEX.match(text, start)
                    if not r:
                        raise Bad("open regular expression")
                    at, c = r.end(), '""'
            elif t == "<" and js and lang != "ts" and last not in _OPERAND_END and (e := _jsx(text, start)):
                at, c = e, '""'
            elif t in "([{" and t:
                stack.append((t, here))
                if t == "{":
                    g = Group()
                    here.tokens.append(nl + "{" if lines else "{")
                    here.tokens.append(g)
                    here = g
                    nl, last = "", "{"
                    continue
            elif t in _PAIR:
                if not stack or stack[-1][0] != _PAIR[t]:
                    raise Bad(f"unmatched {t}")
                _, outer = stack.pop()
                if t == "}":
                    if lang == "go" and nl:
                        here.tokens.append("\n")
                    here, nl, last = outer, "", "}"
                    continue
        here.tokens.append(nl + c if lines else c)
        nl, last = "", c
    if stack:
        raise Bad("open bracket")
    if lang == "go":
        top.tokens.append("\n")
    return top


_JSX_OPEN = re.compile(r"<(?P<name>[A-Za-z_$][\w$.:-]*)?")
_JSX_ATTR = re.compile(r"\s*(?:[A-Za-z_$][\w$:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?P<b>\{)))?|(?P<s>\{))")


def _braces(text: str, at: int) -> int:
    """Behind the braces that open at ``at``."""
    depth = 0
    for m in re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|/\*.*?\*/|[{}]", re.S).finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    raise Bad("open braces in markup")


def _jsx(text: str, at: int) -> int | None:
    """Behind an element of markup, or None if there is none."""
    m = _JSX_OPEN.match(text, at)
    name, at = m["name"], m.end()
    if name:
        while a := _JSX_ATTR.match(text, at):
            at = a.end()
            if a["b"] or a["s"]:
                at = _braces(text, at - 1)
        end = re.compile(r"\s*(/?>)").match(text, at)
        if not end:
            return None
        at = end.end()
        if end[1] == "/>":
            return at
    elif text[at : at + 1] == ">":
        at += 1
    else:
        return None
    while at < len(text):
        c = text[at]
        if text.startswith("</", at):
            close = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(text, at)
            if not close or close[1] != name:
                raise Bad("markup closes another element")
            return close.end()
        if c == "<":
            inner = _jsx(text, at)
            if inner is None:
                raise Bad("markup expected")
            at = inner
        elif c == "{":
            at = _braces(text, at)
        elif c in ">}":
            raise Bad("bare sign in markup")
        else:
            at += 1
    raise Bad("open markup")
