"""Column functions: ranks, predicates, names, paths and scores of the code graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.schema import NON_CODE_KINDS

TYPES = ["struct", "trait", "interface", "enum"]


def case(value: Column, ranks: dict[str, int], other: int) -> Column:
    out = None
    for k, v in ranks.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(other)


def symbol_rank(kind: Column) -> Column:
    """Definitions before members before the rest."""
    return (
        F.when(kind.isin("struct", "trait", "interface", "enum", "type_alias"), 0)
        .when(kind.isin("function", "method"), 1)
        .when(kind.isin("macro", "constant", "property", "annotation", "enum_member"), 2)
        .otherwise(5)
    )


def confidence_rank(c: Column) -> Column:
    """extracted 0, resolved 1, inferred 2; an unknown or null label counts as extracted."""
    return F.when(c == "resolved", 1).when(c == "inferred", 2).otherwise(0)


def visibility_rank(v: Column) -> Column:
    """pub 0, pub_crate 1, private 2; null is private."""
    return F.when(v == "pub", 0).when(v == "pub_crate", 1).otherwise(2)


def risk(n: Column, low: int, medium: int, high: int) -> Column:
    return F.when(n <= low, "LOW").when(n <= medium, "MEDIUM").when(n <= high, "HIGH").otherwise("CRITICAL")


def risk_callers(n: Column) -> Column:
    return risk(n, 2, 10, 30)


def risk_by_id(n: Column) -> Column:
    return risk(n, 2, 9, 29)


def risk_changes(n: Column) -> Column:
    return risk(n, 5, 20, 50)


#: Fixed value: paths of tests and of test support, as one expression both engines read.
TEST_FILE = (
    r"(^|/)(tests|test|spec|__tests__)/"
    r"|(^|/)test_[^/]*$|(_test\.rs|_test\.py|_spec\.rs|\.(test|spec)\.(ts|tsx|js|jsx)|_test\.go|Test\.java|Spec\.java)$"
    r"|(^|/)(testutil|testutils|test_util|test_utils|testing|conftest)(\.[^./]*)?$"
)


def is_test_file(file: Column) -> Column:
    return F.coalesce(file.rlike(TEST_FILE), F.lit(False))


def is_code(kind: Column) -> Column:
    return ~kind.isin(NON_CODE_KINDS)


def agent_relevant(kind: Column, file: Column, visibility: Column) -> Column:
    """Public production symbols: no docs, generated, vendored or test files, nothing private."""
    low = F.lower(file)
    aside = low.rlike(r"^(docs|site|examples)/|/(generated|vendor|node_modules|target)/")
    return ~aside & ~is_test_file(file) & (F.coalesce(visibility, F.lit("private")) != "private") & kind.isin("function", "method", *TYPES)


def tour_score(kind: Column, in_degree: Column) -> Column:
    weight = F.when(kind.isin(TYPES), 100).when(kind == "function", 70).when(kind == "method", 10).otherwise(0)
    return weight + F.least(in_degree, F.lit(30))


# Language families by extension.
FAMILIES = {"rust": ["rs"], "python": ["py"], "script": ["ts", "tsx", "js", "jsx", "mjs", "cjs"], "go": ["go"], "java": ["java"]}


def language_family(file: Column) -> Column:
    """Family of the extension, null where unknown: then no constraint holds."""
    ext = F.regexp_extract(file, r"\.([A-Za-z]+)$", 1)
    out = None
    for k, v in FAMILIES.items():
        out = F.when(ext.isin(v), k) if out is None else out.when(ext.isin(v), k)
    return out


def component_of(file: Column) -> Column:
    """The directory of a file, '<root>' at the top."""
    return F.when(F.instr(file, "/") > 0, F.regexp_extract(file, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("<root>"))


def cluster_for_file(file: Column) -> Column:
    """The package or first directory that a file belongs to."""
    p = F.filter(F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    src = F.array_position(p, "src").cast("int") - 1  # 0-based, -1: none
    roots = ["crates", "packages", "apps"]
    at = lambda i: F.get(p, i)
    return (
        F.when((src > 0) & F.coalesce(at(src - 2).isin(roots) & (src >= 2), F.lit(False)), F.concat_ws("/", at(src - 2), at(src - 1)))
        .when(src > 0, at(src - 1))
        .when(F.coalesce(at(F.lit(0)).isin(roots), F.lit(False)) & at(F.lit(1)).isNotNull(), F.concat_ws("/", at(F.lit(0)), at(F.lit(1))))
        .when(F.size(p) > 1, at(F.lit(0)))
        .otherwise("repository root")
    )


def tokenize(name: Column) -> Column:
    """Lower-case tokens of an identifier: separators and case changes cut, runs of capitals stay together."""
    spaced = F.regexp_replace(name, r"[_\-.:/ ]+", " ")
    spaced = F.regexp_replace(spaced, r"([^A-Z\s])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), " "), lambda x: x != "")


def sanitize_branch(branch: Column) -> Column:
    s = F.regexp_replace(F.replace(branch, F.lit("/"), F.lit("__")), r"[^A-Za-z0-9_]", "_")
    return F.when(s.rlike(r"^[0-9]"), F.concat(F.lit("b_"), s)).otherwise(s)


def slugify(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def symbol_candidate(text: Column) -> Column:
    """The symbol that a code span or link text may name, or null: call signs dropped, last path segment, three characters at least."""
    bare = F.regexp_replace(F.trim(text), r"\(\)$", "")
    last = F.element_at(F.split(bare, r"::|\."), -1)
    return F.when(bare.rlike(r"^[A-Za-z_][A-Za-z0-9_:.]*$") & (F.length(last) >= 3), last)


def path_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def doc_text(doc: Column) -> Column:
    """Documentation without comment leaders, line by line."""
    return F.trim(F.regexp_replace(doc, r'(?m)^\s*(///|//!|//|/\*\*|/\*|\*/|\*|#+|"""|\'\'\')\s?|\s*(\*/|"""|\'\'\')\s*$', ""))


def first_line(text: Column, most: int) -> Column:
    return F.substring(F.get(F.filter(F.split(text, r"\n"), lambda x: F.trim(x) != ""), F.lit(0)), 1, most)


def escape_dot(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_cypher(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


# ---- search ---------------------------------------------------------------------------------------------------------


def lexical_score(query: str) -> Column:
    """Score of columns name, qualified_name, kind and file against a query, null if they do not match.

    Exact 100, prefix 60, all query tokens 50, substring 30, some tokens of
    three characters or more 10 and 5 for each up to 15, substring of the
    qualified name 10, small typos 20 or 10; then the boost of the kind, 8 for
    the same case and -45 for tests. Headings never match.
    """
    low = query.lower()
    name, qualified = F.lower("name"), F.lower("qualified_name")
    tokens = tokenize(F.col("name"))
    wanted = query_tokens(query)
    all_in = F.lit(bool(wanted))
    for t in wanted:
        all_in = all_in & F.array_contains(tokens, t)
    overlap = F.lit(0)
    for t in wanted:
        if len(t) >= 3:
            overlap = overlap + F.array_contains(tokens, t).cast("int")
    base = (
        F.when(name == low, 100).when(name.startswith(low), 60).when(all_in, 50).when(name.contains(low), 30)
        .when(overlap > 0, 10 + F.least(overlap * 5, F.lit(15))).when(qualified.contains(low), 10)
    )
    if 4 <= len(low) <= 15:
        near = edit_distance(name, F.lit(low))
        base = base.when((F.length(name) <= 25) & (near <= 1), 20).when((F.length(name) <= 25) & (near <= 2), 10)
    boost = (
        F.when(F.col("kind").isin("function", "method"), 5).when(F.col("kind").isin("struct", "trait", "interface"), 4)
        .when(F.col("kind").isin("enum", "type_alias"), 3).when(F.col("kind").isin("constant", "macro", "annotation"), 2)
        .when(F.col("kind") == "file", -25).when(F.col("kind") == "folder", -45).otherwise(0)
    )
    total = base + boost + F.when(F.col("name") == query, 8).otherwise(0) + F.when(is_test_file(F.col("file")), -45).otherwise(0)
    return F.when(F.col("kind") != "section", total)


def query_tokens(query: str) -> list[str]:
    """The tokenizer on the driver, for a query text."""
    import re

    s = re.sub(r"[_\-.:/ ]+", " ", query)
    s = re.sub(r"([^A-Z\s])([A-Z])", r"\1 \2", s)
    s = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", s)
    return [t for t in s.lower().split(" ") if t]


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; a length gap above 3 is as good as no match."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 3, 1_000_000).otherwise(F.levenshtein(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if either is all zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


# Names of built-in types and traits by language, which give no reference.
BUILTINS = {
    "rust": "bool char str i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 String Vec Option Result Box Rc Arc Cell RefCell Cow HashMap HashSet BTreeMap BTreeSet PathBuf Path OsString OsStr Send Sync Sized Clone Copy Debug Display Default".split(),
    "python": "int str bool float complex bytes bytearray None list dict set frozenset tuple type object Any Optional Union List Dict Set FrozenSet Tuple Callable Type ClassVar Final Literal TypeVar Generic Protocol Sequence Iterable Iterator Generator Coroutine Awaitable AsyncIterator AsyncGenerator NoReturn Never Self Annotated TypeAlias ParamSpec TypeVarTuple overload abstractmethod staticmethod classmethod".split(),
    "script": "string number boolean void any unknown never null undefined object symbol bigint Array Object Function Promise ReadonlyArray Readonly Partial Required Record Pick Omit Exclude Extract NonNullable ReturnType InstanceType Parameters ConstructorParameters ThisType Map Set WeakMap WeakSet Iterator IterableIterator Generator AsyncGenerator".split(),
    "go": "bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr any comparable".split(),
    "java": "String Object Integer Long Double Float Boolean Byte Short Character Number Math System StringBuilder StringBuffer Comparable Serializable Cloneable Iterable Iterator Collection List Set Map Queue Deque Stack ArrayList HashMap HashSet LinkedList Optional Stream Collectors Arrays Collections Enum Throwable Exception RuntimeException Error Override Deprecated SuppressWarnings FunctionalInterface void".split(),
}


def is_builtin(name: Column, family: Column) -> Column:
    out = F.lit(False)
    for k, v in BUILTINS.items():
        out = out | ((family == k) & name.isin(v))
    return F.coalesce(out, F.lit(False))
