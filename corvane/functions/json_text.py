"""Reading JSON that came as text: repair, content of model responses, other field names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane import schema as S


def repaired(text: Column, fences: bool = True) -> Column:
    """A variant from a model's output: code fences off, then the whole text, then its first ``{`` to its last ``}``.

    Null if neither is JSON.
    """
    bare = F.regexp_replace(text, r"(?s)\A\s*```[A-Za-z]*\s*|\s*```\s*\z", "") if fences else text
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)))


def response_content(body: Column) -> Column:
    """The generated text in a response body: the first choice's content, a list of parts joined; else one of the keys under which text
    comes; else the body itself."""
    v = F.try_parse_json(body)
    first = F.coalesce(*(F.try_variant_get(v, f"$.choices[0]{p}", "variant") for p in (".message.content", ".content")))

    def text(value: Column) -> Column:
        return F.when(kind_of(value) == "string", F.try_variant_get(value, "$", "string"))

    def of_part(part: Column) -> Column:
        return F.coalesce(text(part), text(F.try_variant_get(part, "$.text", "variant")), text(F.try_variant_get(part, "$.content", "variant")))

    parts = F.filter(F.transform(F.try_variant_get(first, "$", "array<variant>"), of_part), lambda p: p.isNotNull())
    joined = F.when(kind_of(first) == "array", F.array_join(parts, ""))
    others = [text(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("output_text", "text", "result", "output")]
    return F.coalesce(text(first), joined, *others, body)


def field(record: Column | str, name: str, kind: str = "variant") -> Column:
    """The value of a record's key; SQL null if it is missing or isn't of that kind."""
    column = F.col(record) if isinstance(record, str) else record
    return F.try_variant_get(column, f'$["{name}"]', kind)


def field_by_alias(record: Column | str, name: str, kind: str = "variant") -> Column:
    """As :func:`field`, but other names of the field serve if the canonical one is missing."""
    names = [name, *(a for a, canonical in S.FIELD_ALIASES.items() if canonical == name)]
    return F.coalesce(*(field(record, n, kind) for n in names))


def kind_of(value: Column) -> Column:
    """``missing``, ``null``, ``string``, ``array``, ``object``, ``integer``, ``boolean`` or ``other``."""
    shape = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "missing").when(F.is_variant_null(value), "null").when(shape == "STRING", "string").when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object").when(shape == "BIGINT", "integer").when(shape == "BOOLEAN", "boolean").otherwise("other")
    )


def as_text(value: Column) -> Column:
    """The text of a value: empty if missing, ``None`` if null, lists and objects as JSON."""
    return F.when(value.isNull(), "").when(F.is_variant_null(value), "None").when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def non_empty(value: Column) -> Column:
    """False if missing, null, a blank string, or an empty list or object; all other values are present."""
    from corvane.functions.text import stripped

    kind = kind_of(value)
    return (
        F.when(kind.isin("missing", "null"), False)
        .when(kind == "string", stripped(F.try_variant_get(value, "$", "string")) != "")
        .when(kind.isin("array", "object"), ~F.to_json(value).isin("[]", "{}"))
        .otherwise(True)
    )


def strings(value: Column) -> Column:
    """The elements of a list as text; null for anything else."""
    return F.when(kind_of(value) == "array", F.transform(F.try_variant_get(value, "$", "array<variant>"), as_text))
