"""Documentation pairs, provenance of files, and residue in documents."""

from weftgraph.llm import docs as D
from weftgraph.llm import provenance as P
from weftgraph.llm import residue as R

NODES = "branch string, id string, kind string, name string, file string, def_signature string, def_body string, def_doc string, indexed_at int"


def test_informative():
    good = [
        "Cheap; never blocks on the edge.", "/** Caller must hold the lock. */", "@param x the count to keep\n@return what is left", "# Half-open: the end is excluded.", "在发布之前检查索引。", '"""Drains the queue\n\n    TODO: also close it.\n    """',
        "Args:\n    x: how many to read", "@deprecated use other_thing instead",
    ]
    bad = [
        None, "", "   ", "/** */", "---------", "TODO", "TODO: document read_file", "FIXME: add docs", "read_file", "The read file method.", "Reads the file.", "read_file(path)", "@param path\n@return", ":param path:\n:return:", "noqa", "eslint-disable-next-line",
        "Copyright 2020. All rights reserved.", "SPDX-License-Identifier: X", "Created 2020-01-01", "@author someone", "x = record + 3;", "retry(path, 6);", "if path > 0:\n    read(path)", "[summary]\n\nArgs:\n    path ([type]): [description]", "???", "N/A", "See above.", "#region header", "{@inheritDoc}",
    ]
    for d in good:
        assert D.informative(d, "read_file", "def read_file(path):"), d
    for d in bad:
        assert not D.informative(d, "read_file", "def read_file(path):"), d


def test_function_pairs(spark):
    body = "def f(x):\n    {doc}\n    return x\n"
    rows = [
        ("m", "1", "function", "f", "a.py", "def f(x):", body.format(doc='"""Keeps the lock for long."""'), None, 1),
        ("m", "2", "function", "f", "a.py", "def f(x):", body.format(doc='y = 1\n    """Keeps the lock for long."""'), None, 1),  # a statement stands between
        ("m", "3", "method", "g", "a.ts", "g(a)", "g(a) {\n  // Keeps the lock for long.\n  return 1;\n}", None, 1),  # no documentation
        ("m", "4", "method", "g", "a.ts", "g(a)", "g(a) { return 1; }", "/** Keeps the lock for long. */", 1),
        ("m", "5", "struct", "g", "a.ts", "g", "x", "Keeps the lock for long.", 1), ("m", "6", "method", "g", "a.ts", None, "", "Keeps the lock for long.", 1), ("m", "7", "method", "g", "a.ts", None, None, "Keeps the lock for long.", 1),
        ("m", "8", "method", None, None, None, "g() {}", "Keeps the lock for long.", 1), ("m", "9", "function", "f", "a.py", "def f(x):", body.format(doc='"""Keeps the lock for long."""'), "TODO", 1),
        ("m", "10", "function", "f", "a.go", None, "func f() {}", "Keeps the lock for long.", 1), ("m", "10", "function", "f", "a.go", None, "func f() {}", "TODO", 2), (None, "11", "function", "f", "a.go", None, "// Keeps the lock for long.\nfunc f() {}", None, 2),
        ("m", "13", "function", "f", "a.go", None, "// Keeps the lock for long.\n\n// nolint\nfunc f() {}", None, 1),  # the nearer comment says nothing
        ("m", "14", "function", "f", "a.go", None, "// Keeps the lock for long.\nvar x = 1\n\nfunc f() {}", None, 1),  # a statement stands between
        ("m", "15", "function", "f", "a.go", None, "var x = 1\n\n// Keeps the lock for long.\nfunc f() {}", None, 1),
        ("m", "16", "function", "f", "a.rs", None, "// nothing\n#[inline]\nfn f() {}", "Keeps the lock for long.", 1), ("m", "17", "method", "f", "a.ts", None, "f() { // Keeps the lock for long.\n}", None, 1),
        ("m", "12", "function", "f", "a.py", "def f(x):", body.format(doc='"""Keeps ' + "the lock " * 50_000), None, 1),
    ]
    df = spark.createDataFrame(rows, NODES).selectExpr("*", "1 as at", "2 as text", "3 as code")
    got = {(r.branch, r.id): r.doc_from for r in D.function_pairs(df).collect()}
    assert got == {("m", "1"): "docstring", ("m", "4"): "comment", ("m", "8"): "comment", ("m", "9"): "docstring", (None, "11"): "comment", ("m", "12"): "docstring", ("m", "13"): "comment", ("m", "15"): "comment", ("m", "16"): "comment"}
    assert D.function_pairs(df.limit(0)).count() == 0


def test_provenance_of_single_files():
    a = P.automaton()
    long = "var a=function(b){return b+1};" * 40
    table = "import os\n\nTABLE = [\n" + "    0x01, 0x02, 0x03,\n" * 40 + "]\n\ndef f(x):\n    return TABLE[x]\n"
    cases = {
        ("a/vendor/lib/x.py", "x = 1\n"): "vendored", ("a/vendor_portal/x.py", "x = f(1)\n"): None, ("a/gen/x.go", "package a\n"): "generated", ("a/generators/x.go", "package a\n"): None, ("x_pb2.py", "x = f(1)"): "generated", ("a.min.js", ""): "minified",
        ("a.js", long): "minified", ("a.js", "// Code generated by toolx. DO NOT EDIT.\nlet a = f(1)\n"): "generated", ("a.js", "// Do not edit the order of the list below.\nlet a = f(1)\n"): None, ("a.py", "# This module generates stubs; the output is marked DO NOT EDIT.\nf()\n"): None,
        ("a.py", "# Used to be generated by toolx, edited by hand since 2020.\nf()\n"): None, ("a.py", "# Writes the '@generated' banner.\nf()\n"): None, ("a.py", "TABLE = [\n" + "    0x01, 0x02,\n" * 40 + "]\n"): "data", ("a.py", table): None, ("a.py", 'B = "' + "QUJD" * 100 + '"\n'): "data",
        ("a.rs", "use a::b;\n\n// toolx v1.2 output, sha abc\n// Any change here is overwritten at the next build.\n"): None, ("a.rs", "/*\n * compiled from a/b.idl by toolx\n */\nfn f() {}\n"): "generated", (None, None): None, ("a.py", ""): None,
        ("a.py", "# Copyright 2020 us\n# Use of this file is governed by LICENSE.\nf()\n"): None,
    }
    for (path, text), want in cases.items():
        assert P.verdict(path, text, a) == want, (path, text)


def test_library_copies_and_operator(spark):
    body = "\n".join(f"def f{i}(a, b):\n    return g{i}(a) + h{i}(b)" for i in range(40))
    lib = spark.createDataFrame([("l", "1", "l.py", body), ("k", "1", "k.py", ""), ("n", "1", "n.py", None)], "lib string, lib_version string, file string, source_text string")
    altered = body.replace("return g7(a)", "return changed(a)") + "\n# local patch\n"
    rows = [(1, "a/x.py", altered, 1), (2, "a/y.py", body, 1), (2, "a/y.py", body, 2), (3, "a/z.py", "\n".join(f"def q{i}(z):\n    return p{i}(z)" for i in range(40)), 1), (4, None, None, 1), (5, "a/w.py", "", 1), (None, "a/gen/x.py", "", 1)]
    files = spark.createDataFrame(rows, "file_id bigint, file string, source_text string, parsed_at int").selectExpr("*", "1 as k", "2 as reason")
    assert {r.file_id for r in P.library_copies(files, lib).collect()} == {1, 2}
    assert {(r.file_id, r.reason) for r in P.not_handwritten(files, lib).collect()} == {(1, "vendored"), (2, "vendored")}
    assert P.not_handwritten(files.limit(0), lib.limit(0)).count() == 0


DOCS = {
    1: ("JavaScript is disabled.", "script"), 2: ("Error 404: Not Found\nBack to the start page", "error"), 3: ("Text text text. More text to fill the page.", "filler"),
    4: ("# {{ project_name }}\n\nMaintained by __OWNER__.", "slots"), 5: ("Title: <short title>\nComponent: <component>", "form"), 6: ("Span To go on, enable JS and reload! Try again in a few minutes.", "script"),
    7: ("The viewer shows a notice when JavaScript is disabled; we moved that notice below the span.", None), 8: ("Placeholders such as `{{ x }}` that remain after rendering now make the build fail.", None),
    9: ("```html\n<h1>[INSERT AUTHOR HERE]</h1>\n```\n\nThe block above is the default theme.", None), 10: ("Access denied errors went away once the span had its own token.", None), 11: ("", None), 12: (None, None), 13: ("   \n ", None),
    14: ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "filler"), 15: ("The fixture holds 40 paragraphs of lorem ipsum so that the node has something to flush.", None), 16: ("页面不存在", "error"), 17: ("グラフを読み込むにはJavaScriptを有効にしてください。", "script"),
    18: ("When the indexer receives a 404 Not Found from the mirror it marks the lease as stale and retries after 8 seconds.", None), 19: ("Menu\nHome  Docs  Blog\nThe span is kept as long as its lease has more than one open session in the recent graph.", None), 20: ("word " * 30_000, "filler"),
    21: ("runs-on: `${{ matrix.os }}`", None), 22: ("HTTP 502\nhttpd/2.21\nRequest id: 888a4bf910", "error"), 23: ("Real content goes on.\n\nLast release: %%version%%", "slots"),
}


def test_residue(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in DOCS.items()], "doc_id bigint, text string").selectExpr("*", "1 as line", "2 as verdict")
    got = {r.doc_id: r.residue for r in R.residue_documents(df).collect()}
    assert got == {k: v[1] for k, v in DOCS.items() if v[1]}
    assert R.residue_documents(df.limit(0)).count() == 0


def test_pseudo_latin_is_learned_from_other_documents(spark):
    a = "Nubrio lorem amet elit velorum tibus. Strami ipsum dolim amet lorem fanta elit. Tibus nubrio velorum strami fanta dolim lorem elit amet ipsum nubrio."
    words = a.replace(".", "").lower().split()
    docs = [(i, " ".join(words[i:] + words[:i]).capitalize() + ".") for i in range(4)] + [(9, "Fanta strami tibus velorum nubrio dolim. Strami nubrio fanta tibus."), (10, "Please keep nubrio away from fanta when loading strami in tests.")]
    got = {r.doc_id for r in R.residue_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {0, 1, 2, 3, 9}


def test_generation_notice_after_a_long_licence():
    auto = P.automaton()
    licence = "".join(f"// line {i} of the licence\n" for i in range(60))
    assert P.generation_notice(licence + "// Code generated by protoc. DO NOT EDIT.\npackage x\n", auto)
    assert not P.generation_notice(licence + "package x\nfunc f() {}\n// Code generated by protoc. DO NOT EDIT.\n", auto)


def test_residue_in_indented_lines_and_behind_an_open_fence(spark):
    from weftgraph.llm.residue import residue_documents

    page = "<html>\n<body>\n\t<h1>404 Not Found</h1>\n</body>\n</html>"
    docs = [
        (1, page), (2, "```\n404 Not Found"), (3, "Steps to take:\n\n    404 Not Found"), (4, "```\n404 Not Found\n```"),
        (5, "    404 Not Found"), (6, "~~~\nx = 1\n~~~\n```\n404 Not Found"),
    ]
    got = {r.doc_id: r.residue for r in residue_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == dict.fromkeys((1, 2, 5, 6), "error")


# Wordings that the lexicon was not written from: what a reader would take for a notice, and what tells about one.
NOTICES = {
    "error": [
        "The requested page could not be located on this host", "You have been blocked by the firewall", "Error 1020 Ray ID: 7a8b", "Sorry, we could not find that page.", "This content is no longer available.", "503 Backend fetch failed", "Your connection was interrupted",
        "We're sorry, but something went wrong.", "Oops! That page can't be found.", "The server encountered an internal error and was unable to complete your request.", "You don't have permission to access this resource.", "Your access to this site has been limited by the site owner",
        "The page you are looking for might have been removed or is temporarily unavailable", "Access to this resource on the server is denied!", "This site is under maintenance", "La página solicitada no existe", "Le serveur est momentanément indisponible", "Die angeforderte Seite existiert nicht", "无法访问此页面", "The service is currently down for scheduled maintenance. Please try again later.",
        "HTTP Error 429: Too Many Requests", "Verify you are human", "Proxy error: upstream connection refused",
    ],
    "script": [
        "You need to enable JavaScript to run this app.", "Please turn JavaScript on and reload the page.", "Your browser does not support JavaScript!", "This site requires JavaScript to work properly.", "JavaScript must be enabled in your browser to view this page", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.",
        "Bitte aktiviere JavaScript in deinem Browser.", "您需要启用 JavaScript", "Please switch on scripts and cookies",
    ],
    None: [
        "Handle the error that the parser raises for a missing header.", "We serve a 404 page from the cache when the upstream has gone away, which saved 40 percent of the load last week.", "JavaScript files above 500 KiB are skipped by the extractor and listed in a report.", "The message that scripts are required was translated into three languages.",
        "Forbidden names are listed in the appendix together with the rules that forbid them.", "Fix crash in the proxy when the session token is empty", "Retries a lost connection five times before the queue gives up.", "We use lorem ipsum dolor sit amet as the sample text in the tests of the layout.", "In Vue templates the braces in {{ message }} are filled in by the component.",
        "Run `make docs` to expand {{ version }} in the template.", "Set ${HOME}/bin as the first entry of the path, then run the installer again.", "export CACHE=${HOME}/.cache/node", 'The text "Page not found" is shown by the router and was translated in this release.', "The reader answers 503 Service Unavailable while the lease is cold, so the client has to warm it again.",
        "スナップショットがない場合は直近94件からインデックスを作り直します。", "如果缺少索引，就用最近157条记录重建目录。",
    ],
}


def test_residue_of_other_wordings(spark):
    rows = [(i, t, want) for i, (t, want) in enumerate((t, w) for w, ts in NOTICES.items() for t in ts)]
    got = {r.doc_id: r.residue for r in R.residue_documents(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()}
    wrong = [(t, want, got.get(i)) for i, t, want in rows if got.get(i) != want]
    assert not wrong
    long = "Nothing in the ledger is written until every session of the batch has been checked, which takes a while on large trees. "
    told = spark.createDataFrame([(i, long + t) for i, t, want in rows if want], "doc_id bigint, text string")
    assert R.residue_documents(told).count() == 0


def test_templates_join_sentences_that_differ_in_free_words(spark):
    docs = [(i, f"The {w} waits as long as the server has failed.") for i, w in enumerate(("lexer", "ledger", "digest"))] + [(9, "This page could not be loaded.")]
    got = {r.template: (r.verdict, r.n_sentences) for r in R.templates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {"the <*> <*> as long as the server has failed": ("content", 3), "this page could not be loaded": ("error", 1)}


def test_notices_of_other_wordings():
    a = P.automaton()
    yes = [
        "// Code generated by stringer; DO NOT EDIT.", "# This file was automatically generated with buildtool 3.2", "/* AUTO-GENERATED FILE. DO NOT MODIFY. */", "// @generated SignedSource<<abc>>", "# Generated from schema.proto", "// THIS FILE IS MACHINE GENERATED - changes will be lost",
        "# Please do not edit this file by hand.", "// Diese Datei wurde automatisch generiert.", "# Do not modify: all changes will be overwritten", "// Compiled from main.coffee by the build",
    ]
    no = [
        "// Names are generated by the server and sent back.", "# Do not edit the entries between the two marks", "// Do not change without asking the owners.", "# Auto-generated keys are kept for a week.", "// The banner says 'do not edit' in generated files.", "# Generated files are written to build/",
        "// Checks that the code generated by the tool compiles.", "# Formerly generated from a schema, now maintained by hand. Do not edit the header.", "// The cache is overwritten by each run.", "# Reports generated by users are listed below.",
    ]
    assert [x for x in yes if not P.generation_notice(x + "\nf(1)\n", a)] == []
    assert [x for x in no if P.generation_notice(x + "\nf(1)\n", a)] == []


def test_short_files_are_no_copies(spark):
    body = "\n".join(f"def f{i}(a, b):\n    return g{i}(a) + h{i}(b)" for i in range(40))
    lib = spark.createDataFrame([("l", "1", "l.py", "from .core import main, helper, run\n" + body), ("l", "1", "tiny.py", "x = one(two, three)\n")], "lib string, lib_version string, file string, source_text string")
    mine = "\n".join(f"def q{i}(z):\n    return p{i}(z)" for i in range(40))
    rows = [(1, "from .core import main, helper, run\n"), (2, mine + "\nx = one(two, three)\n"), (3, "x = one(two, three)\n"), (4, "# local\n" + body)]
    got = {r.file_id for r in P.library_copies(spark.createDataFrame(rows, "file_id bigint, source_text string"), lib).collect()}
    assert got == {3, 4}
