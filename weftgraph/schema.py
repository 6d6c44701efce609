"""Table schemas and the fixed vocabularies of the code graph."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 14

# The node kinds, edge kinds, confidences and visibilities of the data model.
NODE_KINDS = [
    "folder", "file", "module", "struct", "enum", "trait", "interface", "type_alias",
    "function", "method", "property", "constant", "macro", "annotation", "enum_member", "section",
]
EDGE_KINDS = ["contains", "calls", "implements", "inherits", "uses", "imports", "annotated", "throws", "references"]
CONFIDENCES = ["extracted", "resolved", "inferred"]
VISIBILITIES = ["private", "pub_crate", "pub"]

# Thresholds and defaults that results depend on.
MAX_DEPTH = 5
TRACE_MAX_HOPS = 6
RESOLVE_FANOUT = 8
MAX_SOURCE_BYTES = 524_288
MAX_BODY_BYTES = 2_048
SIMILARITY_FLOOR = 0.50
RRF_K = 60
SUPPORTED_EXTENSIONS = ["rs", "py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "java", "md", "markdown"]
STRUCTURAL_KINDS = ["file", "folder", "module"]
NON_CODE_KINDS = ["section", "file", "folder", "module"]

FLAGS = ["is_async", "is_unsafe", "is_static", "is_abstract", "is_final", "is_property", "is_generator", "is_const"]

NODES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("branch", "id", "kind", "name", "qualified_name", "file")]
    + [T.StructField(c, T.IntegerType()) for c in ("start_line", "end_line", "loc")]
    + [T.StructField("visibility", T.StringType())]
    + [T.StructField(c, T.BooleanType()) for c in FLAGS]
    + [T.StructField("generic_bounds", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("def_signature", "def_body", "def_doc")]
    + [T.StructField(c, T.IntegerType()) for c in ("def_start_byte", "def_end_byte", "complexity")]
    + [T.StructField("annotations", T.ArrayType(T.StringType()))]
)
EDGES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("branch", "src", "dst", "kind")]
    + [T.StructField("line", T.IntegerType()), T.StructField("confidence", T.StringType())]
)
REFS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("branch", "src", "src_file", "target_name", "ref_kind")]
    + [T.StructField("line", T.IntegerType())]
)
INDEX_STATE = T.StructType(
    [
        T.StructField("branch", T.StringType()),
        T.StructField("last_indexed_sha", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
    ]
)
