"""Path expressions: extension, base name, cleaning and containment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def extension(path: Column) -> Column:
    """From the last dot of the last path element, lowered; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_go_file(path: Column) -> Column:
    """Case-sensitive suffix test: ``.GO`` is not a Go file."""
    return path.endswith(".go")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_path(path: Column) -> Column:
    """Lexically shortest equal path: no ``.``, no ``//``, ``..`` resolved.

    A rooted path drops leading ``..``; a relative one keeps them. An empty
    result is ``.`` (relative) or ``/`` (rooted).
    """
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # ``get`` is null on an empty list, so nothing is taken off it.
    can_pop = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1) != "..", F.lit(False))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p)))
        .when(can_pop(acc), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(rooted, acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    cleaned = _once(F.array_join(folded, "/"), lambda joined: F.when(rooted, F.concat(F.lit("/"), joined))
                    .when(joined == "", F.lit(".")).otherwise(joined))
    # Only a path with an empty, '.' or '..' element needs the fold.
    return F.when(path.rlike(r"(^|/)\.{0,2}(/|$)"), cleaned).otherwise(path)


def escapes_workspace(path: Column) -> Column:
    """True if the cleaned path starts with ``..`` (``..foo`` counts too)."""
    return clean_path(path).startswith("..")


def workspace_path(path: Column) -> Column:
    """Key of a path inside the workspace: cleaned, without a leading slash, '.' for the root."""
    return _once(F.ltrim(clean_path(path), F.lit("/")), lambda key: F.when(key == "", F.lit(".")).otherwise(key))


def traversal_error(path: Column) -> Column:
    return F.format_string("invalid path: '%s' attempts to traverse outside the workspace", path)
