"""Validation of nested records: a spec is compiled into one expression over a VARIANT that lists every broken place by its path.

A spec maps a field to (kind, options). Kinds are those of validate.field_problem, and two that nest: group (options fields: a spec)
and rows (options fields and max). Paths read like seo.title or variants[3].sku. Codes: required, invalid-<kind>, expected-object, and
unsupported-field for keys that the spec does not name, at any depth. A null or absent value is only a fault where it is required;
an absent group is checked as an empty one."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sitemill.functions import paths as P
from sitemill.operators.validate import field_problem

MAX_ROWS = 500
_ISSUES = "array<struct<field:string,code:string>>"
_NONE = lambda: F.array().cast(_ISSUES)
_STRINGS = {"text", "textarea", "html", "date", "select", "path", "slug", "key", "media"}
_NUMBERS = {"int", "number", "money", "cents", "stock"}


def _at(where: Column | None, name: Column) -> Column:
    return name if where is None else F.concat(where, F.lit("."), name)


def _issue(where: Column, code: Column) -> Column:
    return F.struct(where.alias("field"), code.alias("code"))


def _get(value: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(value, f"$['{quoted}']", "variant")


def _absent(value: Column) -> Column:
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))


def _is(value: Column, *names: str) -> Column:
    return F.schema_of_variant(value).rlike(r"\A(?:" + "|".join(names) + ")")


def _scalar(value: Column, kind: str, options: Mapping) -> Column:
    """The code of a present scalar."""
    bad = F.lit(f"invalid-{kind}")
    rules = {name: option for name, option in options.items() if name != "required"}
    if kind == "bool":
        return F.when(~_is(value, "BOOLEAN"), bad)
    if kind in _NUMBERS:
        return F.when(~_is(value, "BIGINT", "DECIMAL", "DOUBLE"), bad).otherwise(field_problem(F.try_variant_get(value, "$", "double"), kind, **rules))
    if kind in _STRINGS:
        return F.when(~_is(value, "STRING"), bad).otherwise(field_problem(F.try_variant_get(value, "$", "string"), kind, **rules))
    raise ValueError(f"unknown kind {kind}")


def _each_row(value: Column, where: Column, make: Callable[[Column, Column], Column], empty: Column) -> Column:
    rows = F.try_variant_get(value, "$", "array<variant>")
    found = F.transform(rows, lambda row, i: make(row, F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))))
    return F.coalesce(F.flatten(found), empty)


def _field(value: Column, kind: str, options: Mapping, where: Column) -> Column:
    missing = F.array(_issue(where, F.lit("required"))) if options.get("required") else _NONE()
    if kind == "group":
        inner = F.when(_is(value, "OBJECT"), object_issues(value, options["fields"], where)).otherwise(F.array(_issue(where, F.lit("expected-object"))))
        empty = object_issues(F.parse_json(F.lit("{}")), options["fields"], where)
        return F.when(_absent(value), missing if options.get("required") else empty).otherwise(inner)
    if kind == "rows":
        one = lambda row, at: F.when(F.coalesce(_is(row, "OBJECT"), F.lit(False)), object_issues(row, options["fields"], at)).otherwise(F.array(_issue(at, F.lit("expected-object"))))
        size = F.size(F.try_variant_get(value, "$", "array<variant>"))
        broken = ~_is(value, "ARRAY") | (size > options.get("max", MAX_ROWS))
        inner = F.when(broken, F.array(_issue(where, F.lit("invalid-rows")))).otherwise(_each_row(value, where, one, _NONE()))
        return F.when(_absent(value), missing).otherwise(inner)
    code = _scalar(value, kind, options)
    return F.when(_absent(value), missing).when(code.isNotNull(), F.array(_issue(where, code))).otherwise(_NONE())


def object_issues(value: Column, spec: Mapping[str, tuple], where: Column | None = None) -> Column:
    """array<struct<field, code>> of a VARIANT object."""
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    unknown = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, spec)))
    parts = [F.transform(unknown, lambda k: _issue(_at(where, k), F.lit("unsupported-field")))]
    parts += [_field(_get(value, name), kind, options, _at(where, F.lit(name))) for name, (kind, options) in spec.items()]
    return F.flatten(F.array(*parts))


def values_of(value: Column, spec: Mapping[str, tuple], wanted: str, where: Column | None = None) -> Column:
    """array<struct<field, value>> of the string values of one kind, with their paths."""
    kind_of = "array<struct<field:string,value:string>>"
    none = F.array().cast(kind_of)
    parts = [none]
    for name, (kind, options) in spec.items():
        at, inner = _at(where, F.lit(name)), _get(value, name)
        if kind == "group":
            parts.append(F.when(_absent(inner), none).otherwise(values_of(inner, options["fields"], wanted, at)))
        elif kind == "rows":
            parts.append(F.when(_absent(inner), none).otherwise(_each_row(inner, at, lambda row, here, o=options: values_of(row, o["fields"], wanted, here), none)))
        elif kind == wanted:
            text = F.try_variant_get(inner, "$", "string")
            parts.append(F.when(text.isNull(), none).otherwise(F.array(F.struct(at.alias("field"), text.alias("value")))))
    return F.flatten(F.array(*parts))


def validate_nested(df: DataFrame, spec: Mapping[str, tuple], data: str = "data", key: str = "key", bundle: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """df with JSON texts in data -> (clean rows, issues(key, field, code)). Text that is no JSON object is invalid-json.

    bundle(key): the files that come with the batch; a media value must name one of them (media-missing). Media values are
    looked up by a join, whatever their depth; everything else is one pass."""
    parsed = df.withColumn("_value", F.try_parse_json(F.col(data)))
    is_object = F.coalesce(_is(F.col("_value"), "OBJECT"), F.lit(False))
    found = F.when(is_object, object_issues(F.col("_value"), spec)).otherwise(F.array(_issue(F.lit(None).cast("string"), F.lit("invalid-json"))))
    marked = parsed.withColumn("_found", found)
    issues = marked.select(F.col(key).alias("key"), F.explode("_found").alias("i")).select("key", "i.field", "i.code")
    clean = marked.where(F.size("_found") == 0)
    if bundle is None:
        return clean.drop("_found", "_value"), issues
    named = marked.where(is_object).select(F.col(key).alias("key"), F.explode(values_of(F.col("_value"), spec, "media")).alias("v")).select("key", "v.field", "v.value")
    known = P.is_key(F.substr(F.col("value"), F.lit(7))) & F.col("value").startswith("media:")
    named = named.where(known).withColumn("_media", F.substr(F.col("value"), F.lit(7)))
    missing = named.join(bundle.select(F.col("key").alias("_media")).distinct(), "_media", "left_anti").select("key", "field", F.lit("media-missing").alias("code"))
    kept = clean.drop("_found", "_value").join(missing.select(F.col("key").alias(key)).distinct(), key, "left_anti")
    return kept, issues.unionByName(missing)
