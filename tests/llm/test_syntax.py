"""Lexer maps and grammars, and the operator on files that do not parse."""

import random

import pytest

from weftgraph.llm import grammars as G
from weftgraph.llm import lexing as L
from weftgraph.llm import unparsable as U

GOOD = {
    "js": [
        "", "// nothing\n", "export default { a, b: 1, c() {}, get d() { return 1 }, [e]: 2, ...f };\n", "const f = async (a, {b, c = 2}, ...d) => { await a; };\n",
        "for (const [k, v] of Object.entries(x)) { if (k) continue; else break }\n", "let a = b\nlet c = a / 2 / b, r = /[/]\\/x/gi.test(s)\n", "class A extends B { #p = 1; static { x() } async *g() { yield* h() } get q() { return this.#p } }\n",
        "try { x() } catch { y() } finally { z() }\nswitch (a) { case 1: b(); break; default: c() }\n", "const t = `a ${b ? `c ${d}` : '}'} e`;\nlabel: while (1) { break label }\n",
        "export const X = <div className=\"a\" {...p}>{y.map(z => <b key={z}>don't</b>)}<br/></div>;\n", "import a, { b as c } from 'd'; export * as e from 'f';\nx?.y?.[z]?.(1) ?? (a, b)\n", "if (a) b(); else c();\ndo d(); while (e)\n!function (e, t) { var a = e || t }(1, 2);\n",
    ],
    "ts": [
        "interface A<T extends B = C> extends D, E<F> { readonly a?: string; [k: string]: number | (() => void); m<U>(x: U): x is U }\n", "type M = { [K in keyof T]?: T[K] } & (A | B)[] ; type F = (a: number, ...b: string[]) => void\n",
        "enum E { A = 1, B = A << 2, C }\nabstract class X<T> implements Y { private constructor(public a: T, protected b?: U) { super() } abstract f(): void; g = <T>(x: T): T => x; }\n",
        "declare module 'm' { export function f(x: any): asserts x is string }\nnamespace N.M { const x = y as unknown as Z<W>; let q = a! + <number>b }\n", "function f(this: A, x?: Map<string, Array<number>>): Promise<void>;\nfunction f(x: any) { return g<string>(x) < 3 }\nexport type { T } from './t'\n",
    ],
    "go": [
        "package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\ntype S[T any] struct {\n\tx, y int `json:\"x\"`\n\t*E\n}\n\nfunc (s *S[T]) M(a, b int, c ...string) (x int, err error) {\n\tfor i := 0; i < 3; i++ {\n\t\tif v, ok := m[i]; ok && v != (T{1}).x {\n\t\t\tcontinue\n\t\t} else if x {\n\t\t}\n\t}\n\tswitch y := z.(type) {\n\tcase int, []string:\n\t\tgo f()\n\tdefault:\n\t\tdefer func() { recover() }()\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t\t_ = v\n\t}\n\treturn a[1:2], map[string][]int{\"a\": {1, 2}}[x]\n}\n",
        "package a\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y = func() int { return 1 }(), `raw\n\"`\n\ntype I interface {\n\tM(int) error\n\t~int | ~string\n}\n",
    ],
    "rust": [
        "use a::{b, c::{self, *}};\n#[derive(Debug)]\npub(crate) struct S<'a, T: Clone + 'a> where T: Copy { a: &'a [T; 3], b: Option<Box<dyn Fn(u8) -> T>> }\nimpl<'a, T> S<'a, T> { pub async fn f(&mut self, x: impl A) -> Result<(), E> { let v = vec![1, 2]; if let Some(x) = y && z { return Err(e)? } match a { 1 | 2..=5 if b => {}, S { a, .. } => c(), _ => { d } } for i in 0..n { 'l: loop { break 'l } } let c = |x: u8| -> u8 { x }; Ok(()) } }\n",
        "fn f() -> u8 { let S { a, b: (c, _) } = s else { return 1 }; x.y::<Vec<u8>>()[0] as usize; r#\"a\"b\"#; unsafe { *p += 1 }; println!(\"{}\", 'a'); 1 }\nenum E { A, B(u8), C { d: i32 } = 3 }\nmacro_rules! m { ($a:expr) => { $a } }\ntrait T: A { type X; const C: u8 = 1; fn g(self); }\n",
    ],
    "java": [
        "package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class C<T extends B & D> extends E implements F, G<H> {\n  static { x(); }\n  private int[] a = {1, 2}, b;\n  @Override public <U> List<? super U> m(final int x, String... y) throws IOException {\n    for (int i = 0, j = 1; i < 3; i++, j--) { if (x instanceof Foo f && f.g()) continue; else break; }\n    for (var v : vs) { int k = switch (v) { case 1, 2 -> 3; default -> { yield 4; } }; }\n    try (var r = open()) { throw new A<>() { void z() {} }; } catch (B | D e) { } finally { }\n    Runnable q = () -> { }; Function<A, B> f2 = (A x2) -> (B) x2; int[][] d = new int[3][]; a[0]++; this.<T>w(C::new);\n    return x > 1 ? (List<? super U>) y : null;\n  }\n  enum E2 { A(1) { }, B; int z; }\n  record R(int a, T b) { R { } }\n  @interface N { int v() default 1; }\n}\n",
    ],
    "python": ["def f(x, /, *, y=1):\n    return x\n", "\ufeffx = 1\n", 'x = f"{a["b"]}"\n'],
}
BAD = {
    "js": ["function f(", "let a = ;\n", "const x = 'a\n", "<<<<<<< a\nlet b\n=======\nlet c\n>>>>>>> d\n", "def f():\n    pass\n", "function f(a: string) {}\n", "let x = `a ${b\n", "if (a) { b(] }\n", "return 1\n", "a b\n", "<!doctype html>\n<html></html>\n"],
    "ts": ["package a\n\nfunc f() {\n}\n", "interface A { a: }\n", "let x: = 1\n", "fn f() -> u8 { 1 }\n", "export function f(): string {\n"],
    "go": ["package a\n\nfunc f() {\n\tx := 1 2\n}\n", "func f() {}\n", "package a\n\nfunc f()\n{\n\tx y\n}\n", "package a\nlet x = 1;\n", "package a\n\n/* open"],
    "rust": ["fn f() { let x = 1 }\n", "fn f() { a b; }\n", "struct S { a }\n", "import a from 'b';\n", "fn f() {\n<<<<<<< x\n}\n", "def f():\n    pass\n", "/* /* */ fn f() {}\n"],
    "java": ["class A { void f() { x } }\n", "class A { int }\n", "void f() { }\n", "package a\nclass A { }\n", "class A { void f() { int x = ; } }\n", "class A {\n", 'class A { String s = "a\n; }\n'],
    "python": ["def f(:\n  pass\n", "if x:\n", "<<<<<<< a\nx = 1\n", "x = (1\n", "print 'a'\n", "return 1\n"],
}


@pytest.mark.parametrize("lang", list(GOOD))
def test_valid(lang):
    for text in GOOD[lang]:
        assert G.valid(text, lang), text
        assert G.valid(text.replace("\n", "\r\n"), lang) or lang != "python"


@pytest.mark.parametrize("lang", list(BAD))
def test_invalid(lang):
    for text in BAD[lang]:
        assert not G.valid(text, lang), text


def test_conflict_marks_in_comments_and_strings_are_valid():
    assert G.valid("const a = `\n<<<<<<< x\n=======\n`;\n// >>>>>>> y\n", "js")
    assert G.valid('x = """\n<<<<<<< a\n=======\n"""\n', "python")


def test_maps_compose_like_the_whole_text():
    rng = random.Random(2)
    for lang, texts in {**GOOD, "mix": []}.items():
        for text in texts + BAD.get(lang, []):
            whole = L.chunk_map(text, lang, L.CODE)
            lines = text.splitlines(keepends=True) or [""]
            for _ in range(4):
                cuts = sorted({0, len(lines), *(rng.randrange(len(lines) + 1) for _ in range(3))})
                parts = ["".join(lines[a:b]) for a, b in zip(cuts, cuts[1:])]
                maps = [U.chunk_maps(p, lang, i == 0) for i, p in enumerate(parts)]
                left = maps[0]
                for m in maps[1:]:
                    left = L.compose(left, m)
                right = maps[-1]
                for m in reversed(maps[:-1]):
                    right = L.compose(m, right)
                told = {L.balanced(left[L.CODE]), L.balanced(right[L.CODE]), L.balanced(whole)} - {None}
                assert len(told) <= 1 and L.balanced(left[L.CODE]) == L.balanced(right[L.CODE])


def test_operator(spark):
    long = "package a\n\n" + "func f() {\n\tx(1)\n}\n\n" * 9000
    rows = [
        (1, "r", "a.py", "x = 1\n", 1), (1, "r", "a.py", "x = (\n", 0), (2, "r", "b.ts", "let x = {\n", 1), (3, None, "c.rs", None, 1), (4, "r", "d.go", "", 1), (5, "r", None, "x = (", 1),
        (6, "r", "e.xyz", "((", 1), (7, "q", "f.go", long, 1), (8, "q", "g.go", long + "func g() {\n", 1), (9, "q", "h.go", long + "func g() {\n\ta b c\n}\n", 1), (None, "q", "i.py", "(", 1),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, file string, source_text string, parsed_at int").selectExpr("*", "'py' as lang", "1 as balanced")
    got = {r.file_id: r.reason for r in U.unparsable_files(df).collect()}
    assert got == {2: "brackets", 8: "brackets", 9: "statement"}
    rates = {(r.repo, r.language): (r.n_files, r.n_unparsable, r.share) for r in U.unparsable_rates(df).collect()}
    assert rates["q", "go"] == (3, 2, 0.666667) and rates["r", "python"] == (1, 0, 0.0)
    assert U.unparsable_files(df.limit(0)).count() == 0


def test_template_expressions_cross_chunks():
    text = "const t = `a ${\n  f({\n    b: `c ${\n      d\n    } e`,\n  })\n} g`;\nf(`\n}{ ${\nx} (\n`);\n"
    lines = text.splitlines(keepends=True)
    for bad, want in (("", True), ("}\n", False), ("`\n", False)):
        m = None
        for i, p in enumerate([*lines, bad] if bad else lines):
            one = U.chunk_maps(p, "js", i == 0)
            m = one if m is None else L.compose(m, one)
        assert L.balanced(m[L.CODE]) in (want, None)
    simple = ["let a = `x ${\n", "  f({ b: 1,\n", "  })\n", "} y`;\n"]
    m = None
    for i, p in enumerate(simple):
        one = U.chunk_maps(p, "ts", i == 0)
        m = one if m is None else L.compose(m, one)
    assert L.balanced(m[L.CODE]) is True


DEEP = {
    "js": ("x = {};\n", "1 2 3", "1 + 2"), "ts": ("let x = {};\n", "1 2 3", "1 + 2"), "go": ("package a\n\nvar x = {}\n", "1 2 3", "1 + 2"),
    "rust": ("fn f() {{ let x = {}; }}\n", "1 2 3", "1 + 2"), "java": ("class A {{ int x = {}; }}\n", "1 2 3", "1 + 2"),
}


@pytest.mark.parametrize("lang", list(DEEP))
@pytest.mark.parametrize("depth", [3, 50, 500, 3000])
def test_deep_nesting_is_parsed_and_not_taken_for_valid(lang, depth):
    frame, bad, good = DEEP[lang]
    assert not G.valid(frame.format("(" * depth + bad + ")" * depth), lang)
    assert G.valid(frame.format("(" * depth + good + ")" * depth), lang)


def test_long_python_expressions():
    assert G.valid("x = " + " + ".join(["a"] * 30_000) + "\n", "python")
    assert not G.valid("x = " + " + ".join(["a"] * 30_000) + " b\n", "python")


def test_chunk_size_does_not_change_the_result(spark):
    rows = [(i, f"f{i}.{ext}", t, 1) for i, (ext, t) in enumerate((e, t) for lang, e in (("js", "jsx"), ("ts", "ts"), ("go", "go"), ("rust", "rs"), ("java", "java"), ("python", "py")) for t in GOOD[lang] + BAD[lang])]
    df = spark.createDataFrame(rows, "file_id bigint, file string, source_text string, parsed_at int")
    want = {(i, t) for i, _, t, _ in rows if not G.valid(t, L.language(rows[i][1]))}
    for size in (1, 40, 100_000):
        assert {(r.file_id, rows[r.file_id][2]) for r in U.unparsable_files(df, size).collect()} == want
