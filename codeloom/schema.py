"""Table schemas of the graph store and of parsed source files."""

from __future__ import annotations

NODE = (
    "id string, kind string, language string, repo string, file string, span_start int, span_end int, qualified_name string, "
    "simple_name string, signature string, commit_hash string, indexed_at long, is_entry_point boolean, entry_point_kind string"
)
EDGE = (
    "id string, from_id string, to_id string, type string, provenance string, confidence double, observed_at long, "
    "source_hash string, ambiguous_candidates array<string>"
)
EVIDENCE = "id string, edge_id string, file string, line int, parser_version string, freshness_ts long, verification_status string"
FILE_META = "file string, content_hash string, indexed_at long, node_count int"
UNRESOLVED = (
    "id string, from_id string, type string, target_name string, candidates array<string>, reason string, file string, line int, "
    "site_count int, observed_at long"
)
PARSED_NODE = (
    "struct<kind:string,span_start:int,span_end:int,qualified_name:string,simple_name:string,signature:string,annotations:array<string>>"
)
IMPORT = "struct<imported_name:string,is_wildcard:boolean,is_static:boolean,line:int>"
TYPE_REF = "struct<subtype:string,supertype:string,edge_type:string,line:int>"
CALL = (
    "struct<caller:string,owner:string,name:string,receiver_hint:string,receiver_kind:string,argument_count:int,line:int,"
    "argument_hints:array<string>>"
)
TYPE_USE = "struct<caller:string,owner:string,type_name:string,context:string,line:int>"
PARSED_FILE = (
    f"file string, package string, content_hash string, source string, has_error boolean, imports array<{IMPORT}>, "
    f"nodes array<{PARSED_NODE}>, top_level_types array<string>, type_refs array<{TYPE_REF}>, calls array<{CALL}>, type_uses array<{TYPE_USE}>"
)

#: Confidence of an edge by how it was found.
STRUCTURAL, DECLARED, BLIND_UNIQUE, TYPED = 1.0, 0.95, 0.7, 0.95
#: An edge of at least this confidence, without candidates, is resolved.
RESOLVED = 0.5
TYPE_KINDS = ["class", "interface", "enum", "annotation"]
EDGE_TYPES = ["CALLS", "EXTENDS", "IMPLEMENTS", "IMPORTS", "REFERENCES"]
TYPED_EDGE_TYPES = ["CALLS_TYPED", "EXTENDS_TYPED", "IMPLEMENTS_TYPED", "REFERENCES_TYPED"]
