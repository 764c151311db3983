"""Names of symbols, modules and references, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schemas import FFI, PROCESS, SERVICE

# Suffixes of service names, in the order in which they are tried; words of service definitions;
# words of API modules.
SERVICE_SUFFIXES = ("service", "servicer", "server", "client", "stub", "handler", "endpoint", "api", "rpc")
SERVICE_WORDS = ("grpc", "thrift", "rpc", "route", "endpoint", "handler", "service", "servicer", "server")
SERVICE_DECORATORS = ("grpc", "thrift", "route", "api")
API_WORDS = ("api", "gateway", "handler", "server", "service")
# Prefixes of names and modules that cross a language bridge.
BRIDGE_PREFIXES = {
    "python": ("ctypes.", "cffi.", "subprocess.", "grpc.", "thrift."),
    "go": ("C.", "exec.", "grpc."),
    "javascript": ("ffi.", "nodeffi.", "child_process.", "grpc.", "thrift."),
    "java": ("jni.", "io.grpc.", "thrift.", "processbuilder."),
    "rust": ("libloading.", "tonic::", "grpc::", "thrift::"),
}
BRIDGE_IMPORTS = {
    "python": ("ctypes", "cffi", "subprocess", "grpc", "thrift"),
    "go": ("c", "os/exec", "exec", "google.golang.org/grpc", "grpc"),
    "javascript": ("ffi", "nodeffi", "child_process", "grpc", "thrift"),
    "java": ("jni", "io.grpc", "thrift", "processbuilder"),
    "rust": ("libloading", "tonic", "grpc", "thrift"),
}
CALL_CONTEXTS = {
    "python": {
        FFI: ("ctypes.", "cffi.", "ffi.", "cython."),
        PROCESS: ("subprocess.", "os.exec", "os.spawn", "multiprocessing."),
        SERVICE: ("grpc.", "thrift.", "requests.", "httpx.", "aiohttp."),
    },
    "go": {FFI: ("C.", "syscall."), PROCESS: ("exec.", "os/exec."), SERVICE: ("grpc.", "rpc.", "http.")},
    "javascript": {
        FFI: ("ffi.", "nodeffi.", "koffi.", "napi."),
        PROCESS: ("child_process.", "Bun.spawn", "Deno.Command"),
        SERVICE: ("grpc.", "@grpc/", "thrift.", "axios.", "fetch", "http."),
    },
    "java": {
        FFI: ("jni.", "java.lang.foreign.", "foreign."),
        PROCESS: ("processbuilder.", "runtime.getruntime().exec"),
        SERVICE: ("grpc.", "io.grpc.", "thrift.", "retrofit.", "httpclient."),
    },
    "rust": {
        FFI: ("libloading.", "jni.", "bindgen."),
        PROCESS: ("std::process::command", "tokio::process::command"),
        SERVICE: ("tonic::", "grpc::", "thrift::", "reqwest::", "hyper::"),
    },
}
SCRIPT_LANGUAGES = ("javascript", "typescript", "tsx")
GO_BASES = (("go-tree-sitter", "sitter"), ("tree-sitter-go/bindings/go", "tree_sitter_go"), ("tree-sitter-python/bindings/go", "tree_sitter_python"))


def _either(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _starts(name: Column, prefixes: tuple[str, ...]) -> Column:
    return _either([name.startswith(p) for p in prefixes])


def _language_is(language: Column, key: str) -> Column:
    return language.isin(*SCRIPT_LANGUAGES) if key == "javascript" else language == key


def canonical(name: Column) -> Column:
    """Letters and digits of any script, lower-cased."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{Nd}]", ""))


def service_key(name: Column) -> Column:
    """The canonical name without service suffixes, stripped again and again while more than suffix and two are left."""

    def strip(s: Column) -> Column:
        out = s
        for suffix in reversed(SERVICE_SUFFIXES):
            fits = s.endswith(suffix) & (F.length(s) > len(suffix) + 2)
            out = F.when(fits, s.substr(F.lit(1), F.length(s) - len(suffix))).otherwise(out)
        return out

    base = canonical(name)
    turns = F.sequence(F.lit(0), F.floor(F.length(base) / 3).cast("int"))
    return F.aggregate(turns, base, lambda s, _: strip(s))


def leaf(name: Column) -> Column:
    """The last part of a reference between ``. : / ( ) [ ]``."""
    trimmed = F.trim(name)
    parts = F.filter(F.split(trimmed, r"[.:/()\[\]]"), lambda x: x != "")
    return F.when(F.size(parts) == 0, trimmed).otherwise(F.get(parts, F.size(parts) - 1))


def prefix(name: Column) -> Column:
    """The part of a reference before the first dot and bracket, without ``*`` and ``&`` before it."""
    return F.regexp_replace(F.regexp_extract(F.trim(name), r"^([^.\[]*)", 1), r"^[*&]+", "")


def module_base(language: Column, module: Column) -> Column:
    """The name by which code refers to an imported module."""
    last_slash, last_dot = F.substring_index(module, "/", -1), F.substring_index(module, ".", -1)
    go = last_slash
    for end, base in reversed(GO_BASES):
        go = F.when(module.endswith(end), base).otherwise(go)
    return (
        F.when(module == "", "")
        .when(language == "go", go)
        .when(language.isin("python", "java"), last_dot)
        .when(language.isin(*SCRIPT_LANGUAGES), F.regexp_replace(last_slash, r"\.[^.]*$", ""))
        .when(language == "rust", F.substring_index(module, "::", -1))
        .otherwise(module)
    )


def import_name(language: Column, module: Column, alias: Column) -> Column:
    return F.when(alias != "", alias).otherwise(module_base(language, module))


def is_bridge_context(context: Column) -> Column:
    return context.isin(FFI, PROCESS, SERVICE)


def is_bridge_reference(language: Column, name: Column, context: Column) -> Column:
    trimmed = F.trim(name)
    return is_bridge_context(context) | _either([_language_is(language, k) & _starts(trimmed, v) for k, v in BRIDGE_PREFIXES.items()])


def is_bridge_import(language: Column, module: Column, base: Column) -> Column:
    m, b, lang = F.lower(F.trim(module)), F.lower(F.trim(base)), F.lower(F.trim(language))
    return _either([_language_is(lang, k) & (_starts(m, v) | _starts(b, v)) for k, v in BRIDGE_IMPORTS.items()])


def call_context(language: Column, name: Column) -> Column:
    """The bridge context of a call by its name, else the empty string."""
    n = F.trim(name)
    out = F.lit("")
    for lang, kinds in reversed(CALL_CONTEXTS.items()):
        tests = {k: _starts(n, v) for k, v in kinds.items()}
        if lang == "python":
            tests[FFI] = tests[FFI] | n.contains(".CDLL") | n.contains(".PyDLL") | n.contains(".dlopen")
        if lang == "go":
            tests[PROCESS] = tests[PROCESS] & n.endswith(".Command")
        own = F.when(tests[FFI], FFI).when(tests[PROCESS], PROCESS).when(tests[SERVICE], SERVICE).otherwise("")
        out = F.when(_language_is(language, lang), own).otherwise(out)
    return out


def usage_tag(context: Column) -> Column:
    """What stands before a context's first bar; a context without one is a bridge and makes its own tag."""
    return F.when(context.contains("|"), F.substring_index(context, "|", 1)).when(context != "", F.concat(F.lit("REF_"), F.upper(context))).otherwise("")


def usage_confidence(context: Column) -> Column:
    # Confidence by usage tag.
    values = {"REF_CALL": 0.9, "REF_TYPE": 0.8, "REF_SIDE": 0.7, "REF_DYN": 0.4}
    tagged = F.lit(0.5)
    for k, v in values.items():
        tagged = F.when(usage_tag(context) == k, v).otherwise(tagged)
    return F.when(context.contains("|"), tagged).when(context != "", 0.6).otherwise(0.0)


def ancestry(context: Column) -> Column:
    return F.when(context.contains("|"), F.regexp_extract(context, r"^[^|]*\|(?s)(.*)$", 1)).otherwise("")


def is_api_module(name: Column) -> Column:
    return F.lower(name).rlike("|".join(API_WORDS))


def is_service_definition(name: Column, full: Column, signature: Column, hint: Column, decorators: Column, kind: Column) -> Column:
    from graphloom.schemas import CLASS, INTERFACE

    text = F.lower(F.concat_ws("\n", name, full, signature, hint))
    decorated = F.exists(decorators, lambda d: F.lower(d).rlike("|".join(SERVICE_DECORATORS)))
    stripped = kind.isin(CLASS, INTERFACE) & (service_key(name) != "") & (service_key(name) != canonical(name))
    return text.rlike("|".join(SERVICE_WORDS)) | decorated | stripped


def is_exported_name(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def qualified(module: Column, name: Column) -> Column:
    """module.name, unless name begins like that already or there is no module."""
    return F.when((module == "") | name.startswith(F.concat(module, F.lit("."))), name).otherwise(F.concat_ws(".", module, name))


def python_relative(from_module: Column, statement: Column, level: Column) -> Column:
    """The module that a Python import with ``level`` leading dots means."""
    parts = F.split(from_module, r"\.")
    up = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0)))
    rest = F.regexp_replace(statement, r"^\.+", "")
    return F.when(level <= 0, statement).otherwise(F.array_join(F.filter(F.concat(up, F.array(rest)), lambda x: x != ""), "."))


def without_space(name: Column) -> Column:
    """A reference's name without blanks, tabs and line ends."""
    return F.regexp_replace(name, r"[ \t\r\n]+", "")


def unquoted(value: Column) -> Column:
    """A literal without white space and quotes around it."""
    return F.regexp_replace(F.trim(value), "^[\"'`]+|[\"'`]+$", "")


def split_trimmed(value: Column, separator: str) -> Column:
    """The parts between separators without white space around them, without empty ones."""
    return F.filter(F.transform(F.split(value, re.escape(separator), -1), lambda x: F.trim(x)), lambda x: x != "")
