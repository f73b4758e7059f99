"""Column helpers for loosely typed JSON text. Every helper stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^\s*-?\d+(\.\d+)?\s*$"
TRUE_TEXTS = ("true", "1", "yes")
COUNT_TYPE = "decimal(38,6)"


def _unwrap_once(text: Column) -> Column:
    inner = F.try_variant_get(F.try_parse_json(text), "$", "string")
    return F.when(F.ltrim(text).startswith('"'), inner).otherwise(text)


def plain_json(text: Column) -> Column:
    """JSON text with up to three layers of string quoting removed."""
    unwrapped = F.reduce(F.sequence(F.lit(1), F.lit(3)), text, lambda inner, _: _unwrap_once(inner))
    return F.when(F.ltrim(text).startswith('"'), unwrapped).otherwise(text)


def json_object_of(text: Column) -> Column:
    """Parse JSON text to a VARIANT object, NULL when it holds none.

    Text that is itself a JSON string holding JSON is unwrapped first; scalars, arrays and
    broken text hold no object.
    """
    plain = plain_json(text)
    return F.when(F.ltrim(plain).startswith("{"), F.try_parse_json(plain))


def json_fields(plain: Column, keys: Sequence[str]) -> Column:
    """Struct of top-level entries of a `plain_json` object as text, from one parse; absent ones are NULL."""
    return F.when(F.ltrim(plain).startswith("{"), F.from_json(plain, ", ".join(f"`{k}` string" for k in keys)))


def _plain_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).cast(COUNT_TYPE))


def number_of(text: Column) -> Column:
    """Plain decimal text, else 0."""
    return F.coalesce(_plain_number(text), F.lit(0).cast(COUNT_TYPE))


def bool_of(text: Column) -> Column:
    """JSON true, or one of the accepted texts."""
    return F.coalesce(F.lower(F.trim(text)).isin(*TRUE_TEXTS), F.lit(False))


# The count rules are SQL text: they expand to many nodes, which is far quicker to hand to the
# JVM as one expression than node by node.
_ZERO, _ONE = f"CAST(0 AS {COUNT_TYPE})", f"CAST(1 AS {COUNT_TYPE})"


def _scalar_count(text: str) -> str:
    """Positive number, or 1 for any other non-blank text; NULL sends the caller to the next key."""
    positive = f"nullif(greatest(CAST(trim({text}) AS {COUNT_TYPE}), {_ZERO}), {_ZERO})"
    return f"CASE WHEN {text} RLIKE r'{NUMBER_PATTERN}' THEN {positive} WHEN trim({text}) <> '' THEN {_ONE} END"


def _is_structured(plain: str, key: str, text: str) -> str:
    """Whether an entry's text is a JSON array or object and not a string that looks like one.

    A string shows in the source between quotes; only then, or where the source uses escapes that
    hide it, is the entry's kind looked up.
    """
    slash = "char(92)"
    escaped = f"replace(replace({text}, {slash}, {slash} || {slash}), '\"', {slash} || '\"')"
    doubtful = f"(contains({plain}, '\"' || {escaped} || '\"') OR contains({plain}, {slash} || 'u') OR contains({plain}, {slash} || '/'))"
    kind = f"schema_of_variant(try_variant_get(try_parse_json({plain}), '$.' || {key}, 'variant'))"
    return f"substring({text}, 1, 1) IN ('[', '{{') AND (NOT {doubtful} OR NOT startswith({kind}, 'STRING'))"


def _value_count(plain: str, key: str, text: str) -> str:
    """Count told by one entry, NULL when it tells none."""
    size = f"CAST(nullif(json_array_length({text}), 0) AS {COUNT_TYPE})"
    inner = ", ".join(_scalar_count(f"get_json_object({text}, '$.{k}')") for k in ("count", "total", "length"))
    nested = f"CASE WHEN startswith({text}, '[') THEN {size} ELSE coalesce({inner}) END"
    return f"CASE WHEN {_is_structured(plain, key, text)} THEN {nested} ELSE {_scalar_count(text)} END"


def count_of(plain: str, fields: str, keys: Sequence[str]) -> Column:
    """First of the entries `keys` of the struct column `fields` that yields a positive count.

    An array counts its items, an object its count/total/length entry, a number itself and
    any other non-blank value 1 (so JSON false counts 1). No hit gives 0. `plain` names the
    column the struct was parsed from.

    Nearly every row has at most one of the entries: that one is examined by generated code.
    Rows with several take the general path over the entries present.
    """
    texts = [f"{fields}.`{k}`" for k in keys]
    present = " + ".join(f"CAST({t} IS NOT NULL AS INT)" for t in texts)
    key = "CASE " + " ".join(f"WHEN {t} IS NOT NULL THEN '{k}'" for k, t in zip(keys, texts)) + " END"
    one = _value_count(plain, f"({key})", f"coalesce({', '.join(texts)})")
    pairs = ", ".join(f"CASE WHEN {t} IS NOT NULL THEN named_struct('key', '{k}', 'text', {t}) END" for k, t in zip(keys, texts))
    several = f"get(filter(transform(array_compact(array({pairs})), e -> {_value_count(plain, 'e.key', 'e.text')}), n -> n > 0), 0)"
    return F.expr(f"coalesce(CASE WHEN {present} = 1 THEN {one} WHEN {present} > 1 THEN {several} END, {_ZERO})")


def json_set(text: Column, strings: dict[str, Column], values: dict[str, Column] | None = None) -> Column:
    """Merge top-level entries into a JSON object, replacing equal keys; the others keep their types.

    `strings` are written as JSON strings, `values` are JSON texts. Text that holds no object
    counts as an empty one.
    """
    added = {k: v.cast("variant") for k, v in strings.items()}
    added.update({k: F.parse_json(v) for k, v in (values or {}).items()})
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    base = F.coalesce(F.try_variant_get(json_object_of(text), "$", "map<string,variant>"), empty)
    kept = F.map_filter(base, lambda k, _: ~k.isin(*added))
    extra = F.map_from_arrays(F.array(*(F.lit(k) for k in added)), F.array(*added.values()))
    return F.to_json(F.map_concat(kept, extra))


def json_remove(text: Column, keys: Sequence[str]) -> Column:
    """Drop top-level entries of a JSON object; the others keep their types."""
    entries = F.try_variant_get(json_object_of(text), "$", "map<string,variant>")
    return F.to_json(F.map_filter(entries, lambda k, _: ~k.isin(*keys)))


def json_contains(text: Column, wanted: dict[str, object]) -> Column:
    """Whether the JSON object holds every wanted entry, by type and value.

    Objects hold objects entry by entry, arrays hold arrays whose items each are in one of theirs.
    """
    return F.coalesce(_holds(F.try_parse_json(text), wanted), F.lit(False))


def _holds(value: Column, wanted) -> Column:
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        entries = F.try_variant_get(value, "$", "map<string,variant>")
        out = kind.startswith("OBJECT")
        for key, inner in wanted.items():
            out = out & F.coalesce(_holds(F.try_element_at(entries, F.lit(key)), inner), F.lit(False))
        return out
    if isinstance(wanted, (list, tuple)):
        items = F.try_variant_get(value, "$", "array<variant>")
        out = kind.startswith("ARRAY")
        for inner in wanted:
            out = out & F.exists(items, _item_test(inner))
        return out
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")
    return number & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))


def _item_test(wanted):
    return lambda item: F.coalesce(_holds(item, wanted), F.lit(False))


def json_strings(text: Column) -> Column:
    """JSON array of strings -> array<string>; NULL for anything else."""
    return F.from_json(text, "array<string>")
