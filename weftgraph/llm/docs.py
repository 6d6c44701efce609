"""Functions paired with their documentation.

Comment spans and function spans are extracted independently of each other; an
as-of join then attaches to each function the nearest comment before it (or the
docstring right after its header), unless a statement stands between the two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no information of their own in a description.
EMPTY_WORDS = set(
    "a an the this that these those of for to in on at by from with and or is are be it its as does do did "
    "function functions method methods class classes constructor helper getter setter procedure routine func fn def "
    "param params parameter parameters arg args argument arguments return returns returned value values type void "
    "object instance implementation implements called named name new default self none null".split()
)

# What stands where a description should be. Matched against the whole text, lower case, without end marks.
PLACEHOLDERS = re.compile(
    r"(?:to[ -]?do|fix ?me|xxx|tbd|tba|wip|hack|n/?a|none|null|nil|nothing|empty|undocumented|placeholder|stub|dummy|temp|temporary|test|foo|bar|baz|"
    r"\(?non-?(?:doc|javadoc)\)?|docstring(?: here)?|doc(?: string)? here|documentation(?: here)?|summary|description|desc|comment(?: here)?|"
    r"(?:insert|add|write|put|enter|your|missing|no|needs?) (?:an? |the |some |any |more |your )*(?:docs?|docstrings?|description|documentation|comments?|summary|text)(?: (?:here|available|yet|provided|needed|needs? (?:docs?|documentation)))*|"
    r"(?:short |brief )?(?:description|summary|documentation|docs?) (?:of|for) (?:the |this )?(?:function|method|class|module|code|parameters?|return value)|"
    r"(?:auto-?generated|automatically generated|generated) ?(?:method|function|constructor|code)? ?(?:stub|comment|docs?|documentation)?|"
    r"(?:see|same as|as) (?:above|below|before|parent|super|super ?class|base ?class|interface|overrides?)|(?:ditto|idem|inherited|inherit(?:s|ed)? docs?)|"
    r"constructor|destructor|getter|setter|getters? and setters?|accessor|mutator|overrides?|main|work in progress|coming soon|lorem ipsum.*)"
)
TASK_NOTE = re.compile(r"(?:to[ -]?do|fix ?me|xxx|hack|wip|tbd)\b")

# Tags whose text names people, versions or dates and says nothing on behaviour.
ORIGIN_TAGS = set("author authors since version date created creator copyright license licence package module file ingroup category maintainer revision id".split())
DIRECTIVES = re.compile(
    r"(?:noqa\b|type:\s*ignore|pylint:|pyright:|mypy:|flake8|fmt:\s*(?:on|off|skip)|isort:|yapf:|ruff:|pragma\b|nosec\b|eslint|prettier|tslint:|jshint|jslint|@ts-|ts-ignore|"
    r"nolint|go:[a-z]|\+build|clippy|rustfmt|#?\[(?:allow|cfg|inline|derive|test|must_use|doc)|noinspection|checkstyle|spotbugs|sonar|c8 ignore|istanbul|v8 ignore|coverage:|"
    r"#?(?:end)?region\b|language=|cspell|spell-?checker|codespell|suppress(?:warnings)?\b|@formatter:|clang-format|-\*-|vim?:|lint[: ]|biome|deno-|webpack|@vite|@jsx|@flow|nocover|no cover|no-?lint)",
    re.I,
)
NOTICE = re.compile(
    r"(?:copyright\b|\(c\)\s|©|all rights reserved|spdx-|licen[cs]ed? (?:under|to)\b|licen[cs]e:|use of this (?:file|source)|permission is hereby|created (?:on|by|at|with)?:?\s*[\d\w]|"
    r"(?:code )?(?:auto-?)?generated (?:by|from|on|with|using)|(?:last )?(?:modified|updated|changed) (?:on|by|at)?:?\s*[\d@]|written by|authored? (?:by|:)|authors?:|(?:copied|adapted|ported|taken|borrowed|derived|lifted) from|"
    r"from:? https?://|source:? |origin(?:ally)?:? |imported from|vendored from|maintained by|maintainer:|owner:|reviewed by|ticket:|jira:|date:)",
    re.I,
)
_TAG = re.compile(r"^\s*(?:[@\\](\w+)|:(\w+)(?:\s+[^:\n]*)?:)\s*(.*)$")
_FIELD = re.compile(r"^\s*[\w*.]+\s*(?:\([^)]*\))?\s*(?::|--?|–)\s*(.*)$")
_SECTION = re.compile(r"^\s*(args|arguments|params|parameters|returns?|yields?|raises|throws|examples?|notes?|attributes|see also|usage|todo)\s*:?\s*$", re.I)
_CODE = re.compile(
    r"^(?:[\w.\[\]>:-]+\s*(?:[-+*/|&^%]?=(?!=)|:=|<-)\s*\S.*|(?:await |return |let |const |var |val |mut |yield |raise |throw |del |assert |print)\s*\S.*[;)\]}]|"
    r"[\w.:>-]+\(.*\)\s*[;{]?|(?:if|for|while|switch|match|else|try|catch)\b.*[{:(]\s*.*|[{}\[\]();,.]+|(?:return|break|continue|pass)\b[^.!?]*;?|"
    r"(?:def|func|fn|class|public|private|protected|static|import|from|use|package|export|function|async|#include|struct|impl|pub)\b[^.!?]*[({;:]?.*[;{:)]|<[^>]+>.*</[^>]+>|>>> .*|\$ .*|[^\s]+;)$"
)
_SIGNS = re.compile(r"[\W_]+", re.U)
_WORD = re.compile(r"[^\W\d_]+|\d+", re.U)
_CAMEL = re.compile(r"([^A-Z\s])([A-Z])|([A-Z])([A-Z][a-z])")
_BRACKETED = re.compile(r"\[\s*(?:type|summary|description|desc|name|value|todo|return|text|insert[^\]]*|your[^\]]*)\s*\]|<\s*(?:description|summary|text|type|name|todo|insert[^>]*|your[^>]*)(?: here)?\s*>|_(?:description|summary|type)_", re.I)


def comment_text(raw: str) -> str:
    """A comment without its signs: line leaders, block and docstring quotes."""
    t = raw.strip().replace("\r\n", "\n")
    t = re.sub(r'^[rRuUbBfF]{0,2}("""|\'\'\')', "", t)
    t = re.sub(r'("""|\'\'\')$', "", t)
    t = re.sub(r"^/\*+!?", "", t)
    t = re.sub(r"\*+/$", "", t)
    lines = [re.sub(r"^\s*(?://[/!]*|#(?!\[)!?(?=\s|$|#)#*|\*(?!\*)|--|;;+)\s?", "", x) for x in t.split("\n")]
    return "\n".join(lines).strip()


def _stem(w: str) -> str:
    for end in ("ies", "ing", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)] + ("y" if end == "ies" else "")
            break
    return w[:-1] if len(w) > 4 and w[-1] == w[-2] else w


def _split_name(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(_CAMEL.sub(r"\1\3 \2\4", name or ""))]


def informative(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether documentation tells something beyond the name and the parameters.

    False for null, empty and sign-only text, placeholders and task notes,
    tags without text, directives to tools, licence and origin notes, code,
    and words that only repeat the name, the parameters or their types.
    """
    if not doc:
        return False
    text = comment_text(doc)
    if not _SIGNS.sub("", text):
        return False
    known = {_stem(w) for w in _split_name(name)} | {_stem(w) for w in EMPTY_WORDS}
    for token in re.findall(r"\w+", signature or ""):
        known |= {_stem(w) for w in _split_name(token)}
    section, in_fence = "", False
    for line in text.split("\n"):
        raw, line = line, line.strip()
        if line.startswith("```"):
            in_fence = not in_fence
            continue
        if in_fence or not _SIGNS.sub("", line):
            continue
        if m := _SECTION.match(line):
            section = m[1].lower()
            continue
        if section and not raw[:1].isspace() and raw == raw.lstrip() and not _FIELD.match(line):
            section = ""
        if section in ("example", "examples", "usage", "todo"):
            continue
        tag = _TAG.match(line)
        if tag:
            kind, rest = (tag[1] or tag[2]).lower(), tag[3].strip()
            if kind in ORIGIN_TAGS or kind in ("inheritdoc", "see", "link", "override", "type", "rtype"):
                continue
            if kind in ("param", "arg", "argument", "throws", "exception", "raises", "property", "tparam", "typeparam", "template") and tag[1]:
                rest = re.sub(r"^(?:\{[^}]*\}\s*)?[\w.$\[\]]+\s*(?:[-:–]\s*)?", "", rest)
            line = rest
        elif section in ("args", "arguments", "params", "parameters", "raises", "throws", "attributes") and (m := _FIELD.match(line)):
            line = m[1]
        if _line_tells(line, known):
            return True
    return False


def _line_tells(line: str, known: set[str]) -> bool:
    line = _BRACKETED.sub(" ", re.sub(r"\{@inherit[Dd]oc\}", "", line)).strip()
    if not line or DIRECTIVES.match(line) or NOTICE.match(line):
        return False
    low = line.lower().strip(" .!:;-*#\"'`,_=~<>|")
    if not low or PLACEHOLDERS.fullmatch(low) or TASK_NOTE.match(low) or _CODE.match(line.strip("` ")):
        return False
    words = _WORD.findall(_CAMEL.sub(r"\1\3 \2\4", line))
    fresh = [w for w in words if not w.isdigit() and _stem(w.lower()) not in known and (len(w) > 1 or ord(w) > 0x2E7F)]
    return bool(fresh)


_OPEN, _CLOSE = "([{", ")]}"
_PIECE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)'|`[^`]*`?|#[^\n]*|[()\[\]{}:;]|=>", re.S)


def header_end(body: str, python: bool) -> int:
    """Offset behind the header of a function that begins at 0: behind its colon or opening brace."""
    depth = 0
    for m in _PIECE.finditer(body):
        t = m[0]
        if t in ("(", "["):
            depth += 1
        elif t in (")", "]"):
            depth -= 1
        elif depth <= 0 and t == (":" if python else "{"):
            return m.end()
        elif depth <= 0 and t == ";" and not python:
            return m.end()
        elif t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
    return len(body)


_DOCSTRING = re.compile(r"\s*([rRuU]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))", re.S)
_ATTRIBUTE = re.compile(r"\s*(?:@[\w.]+(?:\([^)]*\))?|#\[[^\]]*\])", re.S)

def header_of(code: str) -> str:
    """The header of a captured function."""
    start, end = function_span(code, False)
    return code[start:end]


SPANS = "branch string, id string, at int, span string, text string"
_COMMENT = re.compile(r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<h>#(?!\[)[^\n]*))|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)'|`[^`]*`?", re.S)
#: The head of a function in a text without comments and literals, at the start of a line.
_HEAD = re.compile(r"^[ \t]*(?:(?:pub(?:\([\w ]+\))?|export|default|async|static|const|unsafe|extern|public|private|protected|final|abstract|override|synchronized|inline)\s+)*(?:def|func|fn|function\*?)\b", re.M)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def comment_spans(body: str, python: bool) -> list[tuple[int, int, str]]:
    """(start, end, text) of all comments of a text; lines of comments that directly follow each other are one."""
    out: list[tuple[int, int, str]] = []
    for m in _COMMENT.finditer(body):
        if m["c"] is None or m["h"] is not None and not python:
            continue
        if out and m[0][:2] != "/*" and out[-1][2][:2] != "/*" and re.fullmatch(r"[ \t]*\n[ \t]*", body[out[-1][1] : m.start()]):
            out[-1] = (out[-1][0], m.end(), body[out[-1][0] : m.end()])
        else:
            out.append((m.start(), m.end(), m[0]))
    return out


def function_span(body: str, python: bool) -> tuple[int, int]:
    """Where the function's head begins and ends in a captured text, whatever comments stand around it."""
    code = _COMMENT.sub(lambda m: _blank(m) if m["c"] is not None and (m["h"] is None or python) else m[0], body)
    bare = _COMMENT.sub(_blank, code)
    head = _HEAD.search(bare)
    if head:
        start = head.start() + len(head[0]) - len(head[0].lstrip())
    else:
        start = 0
        while m := _ATTRIBUTE.match(bare, start):
            start = m.end()
        start += len(bare[start:]) - len(bare[start:].lstrip())
    return start, start + header_end(body[start:], python)


def statement_spans(body: str, python: bool, upto: int, since: int) -> list[int]:
    """Where statements begin: lines of code before ``upto`` that are no attributes, and the first code from ``since`` on."""
    code = _COMMENT.sub(lambda m: _blank(m) if m["c"] is not None and (m["h"] is None or python) else m[0], body)
    head, out = code[:upto], []
    bare = _ATTRIBUTE.sub(_blank, _COMMENT.sub(_blank, head)) if head.strip() else ""
    out += [m.start() for m in re.finditer(r"(?m)^[ \t]*\S", bare)]
    rest = code[since:]
    if rest.strip():
        out.append(since + len(rest) - len(rest.lstrip()))
    return out


def _spans_of(branch: str, key: str, body: str, doc: str | None, file: str | None) -> Iterator[tuple]:
    """Spans of one captured function, each kind found by itself. The stored documentation lies before offset 0."""
    if doc is not None:
        yield branch, key, -1, "comment", doc
    python = (file or "").endswith((".py", ".pyi")) or bool(re.match(r"\s*(?:async\s+)?def\s+\w+\s*\(", body))
    start, end = function_span(body, python or not re.search(r"\.\w+$", file or ""))
    yield branch, key, start, "function", None
    for at, to, text in comment_spans(body, python or bool(re.match(r"\s*#", body))):
        if to <= start:
            yield branch, key, at, "comment", text
    for at in statement_spans(body, python, start, end):
        if at >= end and python and (m := _DOCSTRING.match(body, at)):
            yield branch, key, at, "docstring", m[1]
        else:
            yield branch, key, at, "statement", None


def node_spans(nodes: DataFrame) -> DataFrame:
    """Comment, docstring, function and statement spans of captured functions, in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                s
                for b, i, body, doc, f in zip(pdf["branch"], pdf["id"], pdf["def_body"], pdf["def_doc"], pdf["file"], strict=True)
                for s in _spans_of(b, i, body, doc, f)
            ]
            yield pd.DataFrame(rows, columns=["branch", "id", "at", "span", "text"])

    return nodes.select("branch", "id", "def_body", "def_doc", "file").mapInPandas(run, SPANS)


def attach(spans: DataFrame, keys: list[str]) -> DataFrame:
    """As-of join of functions with comments: keys, at, before, after.

    The spans of a key lie in order of position. ``before`` has the texts of
    the comments that precede a function, the nearest first, as far as no
    statement stands between; ``after`` is the docstring that directly follows
    its head, unless a statement comes first.
    """
    w = Window.partitionBy(*keys).orderBy("at")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    near = spans.select(
        *keys, "at", "span",
        F.max(F.when(F.col("span") == "statement", F.col("at"))).over(past).alias("stop"),
        F.collect_list(F.when(F.col("span") == "comment", F.struct("at", "text"))).over(past).alias("c"),
        F.lead(F.struct("span", "text")).over(w).alias("n"),
    )
    free = F.filter("c", lambda x: F.col("stop").isNull() | (x["at"] > F.col("stop")))
    return near.where(F.col("span") == "function").select(
        *keys, "at", F.transform(F.reverse(free), lambda x: x["text"]).alias("before"),
        F.when(F.col("n")["span"] == "docstring", F.col("n")["text"]).alias("after"),
    )


def current_functions(nodes: DataFrame) -> DataFrame:
    """Functions and methods with a body; of rows delivered again, the latest stands."""
    w = Window.partitionBy("branch", "id").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("def_doc").desc_nulls_last(), F.col("def_body").desc_nulls_last())
    return (
        nodes.where(F.col("kind").isin("function", "method") & F.col("id").isNotNull())
        .select("branch", "id", "name", "file", "def_signature", "def_body", "def_doc", "indexed_at")
        .withColumn("__rn", F.row_number().over(w)).where("__rn = 1 and trim(def_body) <> ''").drop("__rn", "indexed_at")
    )


PAIRS = T.StructType([T.StructField(c, T.StringType()) for c in ("branch", "id", "name", "def_signature", "code", "description", "doc_from")])


def function_pairs(nodes: DataFrame) -> DataFrame:
    """Code and description of each function or method whose documentation tells something.

    Functions with a null or blank body, and with no, empty or trivial
    documentation are dropped. The nearest comment goes first; if it is trivial,
    the next one before it that no statement parts from the function, the
    stored documentation last, and then the docstring may serve. A null name or
    signature only means that there are fewer words to repeat. Rows delivered
    twice count once. Columns: branch, id, name, def_signature, code,
    description, doc_from ('comment' or 'docstring').
    """
    f = current_functions(nodes)
    near = attach(node_spans(f), ["branch", "id"])
    joined = (
        f.select("branch", "id", "name", "def_signature", F.col("def_body").alias("code"))
        .join(near.where((F.size("before") > 0) | F.col("after").isNotNull()).select(
            F.coalesce("branch", F.lit("\0")).alias("__b"), F.col("id").alias("__i"), "before", "after"),
            (F.coalesce("branch", F.lit("\0")) == F.col("__b")) & (F.col("id") == F.col("__i")))
        .drop("__b", "__i")
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for doc, where in (*((d, "comment") for d in r.before), (r.after, "docstring")):
                    if isinstance(doc, str) and informative(doc, r.name, r.def_signature or header_of(r.code)):
                        rows.append((r.branch, r.id, r.name, r.def_signature, r.code, comment_text(doc), where))
                        break
            yield pd.DataFrame(rows, columns=PAIRS.names)

    return joined.mapInPandas(judge, PAIRS)
