"""Exports of a graph: JSON, Markdown map, DOT, GraphML, Cypher, SVG, HTML, wiki pages and reports.

Documents are built line by line as DataFrames (ordered by ``seq``) and can be
written with ``write.text``; only pages for people are put together on the
driver, from rows whose number is bounded.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators.analytics import in_degrees
from weftgraph.schema import STRUCTURAL_KINDS
from weftgraph.sources.graph import Graph


def json_lines(g: Graph) -> DataFrame:
    """One JSON object for each symbol (files and folders left out) and edge: kind_of, line."""
    s = g.nodes.where(~F.col("kind").isin("file", "folder")).select(
        F.lit("symbol").alias("kind_of"), F.to_json(F.struct("branch", "id", "kind", "name", "qualified_name", "file", "start_line", "end_line", "visibility")).alias("line")
    )
    e = g.edges.select(F.lit("edge").alias("kind_of"), F.to_json(F.struct("branch", "src", "dst", "kind", "line", "confidence")).alias("line"))
    return s.unionByName(e)


def dot_lines(g: Graph) -> DataFrame:
    """A DOT digraph: seq, line."""
    colour = F.when(F.col("kind").isin("function", "method"), "lightblue").when(F.col("kind").isin("struct", "enum", "trait", "interface"), "lightgreen").otherwise("lightgrey")
    n = g.nodes.select(F.lit(1).alias("seq"), F.format_string('  "%s" [label="%s", fillcolor="%s"];', F.col("id"), C.escape_dot(F.coalesce("name", F.lit(""))), colour).alias("line"))
    e = g.edges.select(F.lit(2).alias("seq"), F.format_string('  "%s" -> "%s" [label="%s"];', F.col("src"), F.col("dst"), F.col("kind")).alias("line"))
    return _framed(g, "digraph code {", n.unionByName(e), "}")


def _framed(g: Graph, head: str, body: DataFrame, tail: str) -> DataFrame:
    spark = g.nodes.sparkSession
    ends = spark.createDataFrame([(0, head), (9, tail)], "seq int, line string")
    return ends.unionByName(body.withColumn("seq", F.col("seq").cast("int"))).orderBy("seq", "line")


GRAPHML_KEYS = ["name", "kind", "qualified_name", "file", "start_line"]
GRAPHML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(f'<key id="{k}" for="node" attr.name="{k}" attr.type="string"/>' for k in GRAPHML_KEYS)
    + '<key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'
)


def graphml_lines(g: Graph) -> DataFrame:
    """GraphML with five node keys and one edge key: seq, line."""
    x = lambda c: C.escape_xml(F.coalesce(F.col(c).cast("string"), F.lit("")))
    keys = GRAPHML_KEYS
    data = F.concat(*[F.concat(F.lit(f'<data key="{k}">'), x(k), F.lit("</data>")) for k in keys])
    n = g.nodes.select(F.lit(1).alias("seq"), F.concat(F.lit('<node id="'), x("id"), F.lit('">'), data, F.lit("</node>")).alias("line"))
    e = g.edges.select(F.lit(2).alias("seq"), F.concat(F.lit('<edge source="'), x("src"), F.lit('" target="'), x("dst"), F.lit('"><data key="relation">'), x("kind"), F.lit("</data></edge>")).alias("line"))
    head = GRAPHML_HEAD
    return _framed(g, head, n.unionByName(e), "</graph></graphml>")


def cypher_lines(g: Graph) -> DataFrame:
    """A script of CREATE and MATCH statements: seq, line."""
    q = lambda c: C.escape_cypher(F.coalesce(F.col(c).cast("string"), F.lit("")))
    n = g.nodes.select(F.lit(1).alias("seq"), F.format_string("CREATE (:Symbol {id: '%s', name: '%s', kind: '%s', file: '%s'});", q("id"), q("name"), q("kind"), q("file")).alias("line"))
    e = g.edges.select(F.lit(2).alias("seq"), F.format_string("MATCH (a:Symbol {id: '%s'}), (b:Symbol {id: '%s'}) CREATE (a)-[:%s]->(b);", q("src"), q("dst"), F.upper("kind")).alias("line"))
    return n.unionByName(e).orderBy("seq", "line")


def ring_layout(g: Graph) -> DataFrame:
    """Places of nodes on one ring for each kind: branch, id, ring, x, y. Radius 80 + 95 for each ring, equal angles."""
    kinds = g.nodes.select("branch", "kind").distinct().withColumn("ring", F.row_number().over(Window.partitionBy("branch").orderBy("kind")) - 1)
    from weftgraph.operators.skew import grouped_rank

    ranked = grouped_rank(g.nodes.select("branch", "kind", "id"), ["branch", "kind"], "id", out="j")
    n = g.nodes.groupBy("branch", "kind").agg(F.count(F.lit(1)).alias("n"))
    angle = 2 * F.pi() * F.col("j") / F.col("n")
    r = F.lit(80) + F.lit(95) * F.col("ring")
    return ranked.join(n, ["branch", "kind"]).join(kinds, ["branch", "kind"]).select("branch", "id", "ring", F.round(r * F.cos(angle), 3).alias("x"), F.round(r * F.sin(angle), 3).alias("y"))


def svg_page(g: Graph, most: int = 2000) -> str:
    """An SVG of a graph of at most ``most`` nodes."""
    rows = ring_layout(g).join(g.nodes.select("branch", "id", "name"), ["branch", "id"]).orderBy("branch", "id").limit(most).collect()
    dots = "".join(f'<circle cx="{r.x + 800:.1f}" cy="{r.y + 800:.1f}" r="4"><title>{_xml(r.name or "")}</title></circle>' for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1600 1600">{dots}</svg>'


def _xml(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def html_page(g: Graph, most: int = 2000) -> str:
    """A page with the graph as JSON inside; the payload cannot close its script."""
    n = [r.asDict() for r in g.nodes.select("id", "name", "kind", "file").orderBy("id").limit(most).collect()]
    e = [r.asDict() for r in g.edges.select("src", "dst", "kind").orderBy("src", "dst", "kind").limit(4 * most).collect()]
    payload = json.dumps({"nodes": n, "edges": e}).replace("</", "<\\/")
    return f"<!doctype html><html><body><script>const GRAPH = {payload};</script></body></html>"


def markdown_map(g: Graph) -> DataFrame:
    """Symbols of each file as a nested list, by the contains tree: branch, file, sort_path, line."""
    from weftgraph.operators.hierarchy import hierarchy

    h = hierarchy(g.edges, "contains", with_path=True).where("status = 'tree'").select("branch", "id", "path")
    n = g.nodes.where(~F.col("kind").isin(STRUCTURAL_KINDS)).select("branch", "id", "kind", "name", "file", "start_line")
    order = g.nodes.select("branch", F.col("id").alias("step"), F.format_string("%08d", F.coalesce("start_line", F.lit(0))).alias("o"), F.col("kind").isin(STRUCTURAL_KINDS).alias("outer"))
    steps = h.select("branch", "id", F.posexplode("path").alias("p", "step")).join(order, ["branch", "step"]).where("not outer")
    keyed = steps.groupBy("branch", "id").agg(F.sort_array(F.collect_list(F.struct("p", F.concat("o", F.lit(":"), "step").alias("k")))).alias("ks"))
    joined = n.join(keyed, ["branch", "id"], "left")
    depth = F.greatest(F.size(F.coalesce("ks", F.array().cast("array<struct<p:int,k:string>>"))) - 1, F.lit(0))
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("- `"), F.coalesce("name", F.lit("")), F.lit("` ("), F.col("kind"), F.lit(", line "), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit(")"))
    return joined.select("branch", "file", F.concat_ws("/", F.transform("ks", lambda x: x["k"])).alias("sort_path"), line.alias("line"))


def top_symbols(g: Graph, limit: int = 20) -> DataFrame:
    """The most called symbols of six kinds: branch, place, id, name, in_degree."""
    kinds = ["function", "method", "struct", "trait", "interface", "enum"]
    n = g.nodes.where(F.col("kind").isin(kinds)).join(in_degrees(g), ["branch", "id"])
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    order = [F.desc("in_degree"), F.col("qualified_name"), F.col("id")]
    first = n.withColumn("r", F.row_number().over(Window.partitionBy("branch", salt).orderBy(*order))).where(F.col("r") <= limit)
    return first.withColumn("place", F.row_number().over(Window.partitionBy("branch").orderBy(*order))).where(F.col("place") <= limit).select("branch", "place", "id", "name", "in_degree")


def upsert_block(text: str, block: str, begin: str = "<!-- symbols:begin -->", end: str = "<!-- symbols:end -->") -> str:
    """Puts a block between markers, or at the end where there are none."""
    if begin in text and end in text:
        head, rest = text.split(begin, 1)
        return f"{head}{begin}\n{block}\n{end}{rest.split(end, 1)[1]}"
    return f"{text.rstrip()}\n\n{begin}\n{block}\n{end}\n"


def wiki_page(g: Graph, node_id: str, most: int = 5) -> str:
    """A Markdown page of one node; neighbours are capped at five names a list."""
    from weftgraph.operators.traverse import relations

    row = g.nodes.where(F.col("id") == node_id).orderBy("branch").limit(1).collect()
    if not row:
        return ""
    n = row[0]
    seeds = g.nodes.where(F.col("id") == node_id).select("branch", "id").limit(1)
    rel = relations(g, seeds).join(g.nodes.select("branch", F.col("id").alias("other_id"), "name"), ["branch", "other_id"]).where(F.col("branch") == n["branch"])
    w = Window.partitionBy("relation").orderBy("place")
    rows = rel.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).orderBy("relation", "r").collect()
    lines = [f"# {n['name']}", "", f"`{n['qualified_name']}` ({n['kind']}) in `{n['file']}`"]
    if n["def_doc"]:
        lines += ["", g.nodes.where(F.col("id") == node_id).select(C.doc_text(F.col("def_doc")).alias("d")).first()["d"]]
    for label in dict.fromkeys(r["relation"] for r in rows):
        lines += ["", f"## {label}", *[f"- {r['name']}" for r in rows if r["relation"] == label]]
    return "\n".join(lines) + "\n"


def blast_report(affected: DataFrame, changed: int, form: str = "text") -> str:
    """A report of what a change reaches, as text, comment or JSON, from at most 100 rows."""
    total = affected.count()
    risk = "LOW" if total <= 5 else "MEDIUM" if total <= 20 else "HIGH" if total <= 50 else "CRITICAL"
    rows = affected.orderBy("hop", "id").limit(100).collect()
    if form == "json":
        return json.dumps({"changed": changed, "affected": total, "risk": risk, "nodes": [r.asDict() for r in rows]})
    mark = "- " if form == "comment" else "  "
    head = f"### Reach of the change: {risk}\n" if form == "comment" else "Reach of the change\n"
    return head + f"Changed {changed}, affected {total}, risk {risk}\n" + "".join(f"{mark}{r['id']} (hop {r['hop']})\n" for r in rows)
