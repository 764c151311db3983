"""The language registry: which files belong to which language."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dynamic:
    """Kinds of tree nodes that a configured extractor takes as namespace, imports and definitions."""

    namespace_kind: str = ""
    import_kinds: tuple[str, ...] = ()
    definition_kinds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    test_suffixes: tuple[str, ...] = ()
    enabled: bool = False
    dynamic: Dynamic | None = field(default=None)


# The languages, their files, and those that are on by default.
DEFAULTS = (
    Language("css", (".css",)),
    Language("go", (".go",), test_suffixes=("_test.go",), enabled=True),
    Language("gomod", filenames=("go.mod",)),
    Language("gosum", filenames=("go.sum",)),
    Language("html", (".html", ".htm")),
    Language("java", (".java",)),
    Language("javascript", (".js", ".cjs", ".mjs")),
    Language("python", (".py",), test_suffixes=("_test.py",), enabled=True),
    Language("rust", (".rs",)),
    Language("tsx", (".tsx",)),
    Language("typescript", (".ts",)),
)


def registry(overrides: Mapping[str, Mapping] | None = None, dynamic: Sequence[Language] = ()) -> dict[str, Language]:
    """The defaults with overridden fields, and dynamic languages.

    ValueError for an override of an unknown language, a dynamic language with a taken name, and a file
    extension or name that two enabled languages claim.
    """
    out = {x.name: x for x in DEFAULTS}
    for name, fields in (overrides or {}).items():
        if name not in out:
            raise ValueError(f"unknown language {name!r}")
        out[name] = replace(out[name], **{k: tuple(v) if isinstance(v, list | tuple) else v for k, v in fields.items()})
    for x in dynamic:
        if x.name in out:
            raise ValueError(f"language {x.name!r} exists already")
        out[x.name] = x
    owner: dict[str, str] = {}
    for x in out.values():
        for key in (*x.extensions, *x.filenames) if x.enabled else ():
            if owner.setdefault(key.lower(), x.name) != x.name:
                raise ValueError(f"{key} belongs to {owner[key.lower()]} and to {x.name}")
    return out


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of(path: Column, languages: Mapping[str, Language]) -> Column:
    """The enabled language of a file by its exact name, else by its extension; the empty string for none."""
    name = base_name(path)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    out = F.lit("")
    on = [x for x in languages.values() if x.enabled]
    for x in on:
        if x.extensions:
            out = F.when(extension.isin(*x.extensions), x.name).otherwise(out)
    for x in on:
        if x.filenames:
            out = F.when(name.isin(*x.filenames), x.name).otherwise(out)
    return out


def is_test(path: Column, languages: Mapping[str, Language]) -> Column:
    out = F.lit(False)
    for x in languages.values():
        for s in x.test_suffixes:
            out = out | path.endswith(s)
    return out
