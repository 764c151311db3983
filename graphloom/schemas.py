"""Schemas of the model tables, as Spark DDL. Columns are never null: empty strings and zeros stand for nothing."""

FILES = "path string, language string, module string, package_name string, local_symbols array<string>, ingest_seq bigint, deleted boolean"
IMPORTS = "path string, module string, seq int, target string, raw string, alias string, items array<string>, is_relative boolean, line int, col int"
DEFINITIONS = (
    "path string, module string, seq int, name string, full_name string, kind int, exported boolean, visibility string, scope string, "
    "signature string, type_hint string, decorators array<string>, branches int, params int, nesting int, loc int, complexity_score int, line int, col int"
)
REFERENCES = "path string, module string, language string, seq int, name string, context string, line int, col int"
SECRETS = "kind string, severity string, value string, entropy double, confidence double, file string, line int, col int"
SNAPSHOTS = (
    "project_key string, ts timestamp, commit_hash string, commit_ts timestamp, module_count int, file_count int, cycle_count int, "
    "unresolved_count int, unused_import_count int, violation_count int, hotspot_count int, avg_fan_in double, avg_fan_out double, "
    "max_fan_in int, max_fan_out int"
)
LAYERS = "name string, ord int, pattern string"
LAYER_RULES = "name string, from_layer string, allow array<string>"
PACKAGE_RULES = (
    "name string, modules array<string>, max_files int, allow array<string>, deny array<string>, exclude_tests boolean, exclude_files array<string>"
)
BRIDGES = "from_language string, from_module string, to_language string, to_module string, reason string, references array<string>"
OVERLAYS = (
    "id bigint, project_key string, symbol string, file_path string, overlay_type string, reason string, verified_by string, "
    "source_hash string, status string, created_at timestamp"
)
SPOOL = (
    "id bigint, project_key string, operation string, file_path string, payload string, attempts int, next_attempt_at timestamp, "
    "created_at timestamp, last_error string"
)
EDGES = "src string, dst string, path string, line int, col int"

#: Kinds of definitions, by number.
KINDS = ("function", "class", "method", "variable", "constant", "type", "interface")
FUNCTION, CLASS, METHOD, VARIABLE, CONSTANT, TYPE, INTERFACE = range(7)
#: Contexts of references across a language bridge.
FFI, PROCESS, SERVICE = "ffi_bridge", "process_bridge", "service_bridge"
