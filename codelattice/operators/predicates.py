"""Column predicates over paths, symbols and kinds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
VENDORED_SEGMENTS = ("vendor", "node_modules", "third_party", "thirdparty", "bower_components")
CLONE_EXCLUDED_KINDS = ("package", "chunk", "file", "module", "field", "import")
CONTAINER_KINDS = ("package", "file", "module", "chunk")
DEFINITION_KINDS = ("function", "method", "type", "struct", "interface", "class")
EXPORTED_KINDS = ("function", "method", "type", "struct", "interface", "class", "variable")
CODE_KINDS = ("function", "method", "class")
SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("unresolved", "probable", "strong", "definite")
IDIOMATIC_NAMES = ("init", "main", "String", "Error", "TestMain")
NOISE_SUFFIXES = ("_test.go", ".d.ts")
NOISE_PARTS = ("/legacy/", "/examples/", "/vendor/", "/testdata/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test_file(path: Column) -> Column:
    return F.coalesce(basename(path).rlike(r"_test\.go$|^test_.*\.py$|_test\.py$|\.(test|spec)\.(ts|tsx|js|jsx)$"), F.lit(False))


def is_vendored(path: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDORED_SEGMENTS))), F.lit(False))


def is_noise_path(path: Column) -> Column:
    """Paths whose hits count less, in any letter case; a folder counts only below another one."""
    low, none = F.lower(path), F.lit(False)
    noise = none
    for s in NOISE_SUFFIXES:
        noise = noise | F.endswith(low, F.lit(s))
    for s in NOISE_PARTS:
        noise = noise | F.contains(low, F.lit(s))
    return F.coalesce(noise, none)


def last_segment(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", -1)


def is_external_entry(symbol: Column) -> Column:
    """Reachable from outside whatever calls it: main, init, tests, or an exported first letter of the whole symbol; an empty name counts."""
    s = F.coalesce(symbol, F.lit(""))
    return (s == "") | s.rlike(r"^(main|init)$|^(Test|Example|Benchmark)") | s.rlike(r"^\p{Lu}")


def is_go_test_name(symbol: Column) -> Column:
    return last_segment(symbol).rlike(r"^(Test|Benchmark|Fuzz|Example)($|[^a-z])")


def is_external_module(path: Column) -> Column:
    return F.split(path, "/").getItem(0).contains(".")


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place of an ordered enum's value, from 0; null for unknown ones."""
    return F.element_at(F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))]), value)


def heuristic_summary(signature: Column, kind: Column, symbol: Column) -> Column:
    """Signature, else kind and name, at most 280 characters."""
    sig = F.nullif(F.trim(signature), F.lit(""))
    return F.substring(F.coalesce(sig, F.concat_ws(" ", kind, symbol)), 1, 280)
