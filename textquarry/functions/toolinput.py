"""Checked decoding of JSON tool inputs.

Types are checked on the JSON itself: a number where text belongs is an error,
not text. Columns: ``format_error`` and one column per field, with '' and 0 for
what is missing or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_KINDS = {
    "string": (["STRING", "VOID"], "string", ""),
    "int": (["BIGINT", "VOID"], "bigint", 0),
}


def _kind_of(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _field(given: Column, name: str) -> Column:
    named = F.filter(given, lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def _read(value: Column, kind: str) -> tuple[Column, Column]:
    """A field's value, and whether the JSON given for it is of the right kind."""
    if kind == "text_map":
        entries = F.try_variant_get(value, "$", "map<string,variant>")
        texts = F.forall(F.map_values(entries), lambda v: _kind_of(v).isin("STRING", "VOID"))
        ok = (_kind_of(value) == "VOID") | F.coalesce(texts, F.lit(False))
        read = F.transform_values(F.try_variant_get(value, "$", "map<string,string>"),
                                  lambda k, v: F.coalesce(v, F.lit("")))
        return F.coalesce(read, F.create_map().cast("map<string,string>")), ok
    kinds, target, empty = _KINDS[kind]
    return F.coalesce(F.try_variant_get(value, "$", target), F.lit(empty).cast(target)), _kind_of(value).isin(kinds)


def decode_calls(calls: DataFrame, tools: dict[str, dict[str, str]], blank_ok: tuple[str, ...] = ()) -> DataFrame:
    """Decode ``input`` of calls of several tools (``name``) at once; ``tools`` maps a name to its fields and their kinds: ``string``, ``int``,
    ``text_map``. A field name has one kind. Fields that a call's tool does not have are empty.

    Names match in any case. JSON null stands for an input without fields; for tools in ``blank_ok`` so does an empty input.
    """
    kinds = {field: kind for fields in tools.values() for field, kind in fields.items()}
    blank = (F.length(F.trim("input")) == 0) & F.col("name").isin(list(blank_ok))
    source = F.when(blank, F.lit("{}")).otherwise(F.col("input")) if blank_ok else F.col("input")
    given = F.map_entries(F.try_variant_get("_root", "$", "map<string,variant>"))
    found = (calls.withColumn("_root", F.try_parse_json(source)).withColumn("_given", given)
             .withColumns({f"_{field}": _field(F.col("_given"), field) for field in kinds}))
    is_object = F.col("_given").isNotNull() | (F.col("_root").isNotNull() & (_kind_of(F.col("_root")) == "VOID"))
    read = {field: _read(F.col(f"_{field}"), kind) for field, kind in kinds.items()}
    error, values = F.lit(None).cast("string"), {}
    for field in kinds:
        of = [name for name, fields in tools.items() if field in fields]
        values[field] = read[field][0] if len(of) == len(tools) else F.when(F.col("name").isin(of), read[field][0])
    for name, fields in tools.items():
        ok = is_object
        for field in fields:
            ok = ok & read[field][1]
        error = F.when((F.col("name") == name) & ~ok, F.lit(f"invalid input format for {name}")).otherwise(error)
    kept = [c for c in calls.columns if c not in values]
    return found.select(*kept, *[v.alias(n) for n, v in values.items()], error.alias("format_error"))


def decode_inputs(calls: DataFrame, tool: str, fields: dict[str, str], blank_ok: bool = False) -> DataFrame:
    """Decode ``input`` of one tool's calls, whatever they are named."""
    named = calls.withColumn("name", F.lit(tool))
    decoded = decode_calls(named, {tool: fields}, (tool,) if blank_ok else ())
    return decoded.select(*[c for c in calls.columns if c not in fields and c != "name"],
                          *([F.lit(tool).alias("name")] if "name" in calls.columns and "name" not in fields else []), *fields, "format_error")


def whole_k(k: Column, default: int) -> Column:
    """A missing or non-positive k means the default."""
    return F.when(k <= 0, F.lit(default)).otherwise(k).cast("int")
