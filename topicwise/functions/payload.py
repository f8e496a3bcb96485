"""JSON payload expressions over VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_SPACE = " \t\n\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def framed_array(doc: Column | str) -> Column:
    """``[doc, hash of doc]`` parsed to ``array<variant>``; see :func:`framed_value`."""
    doc = _col(doc)
    text = F.concat(F.lit("["), doc, F.lit(","), F.xxhash64(doc).cast("string"), F.lit("]"))
    return F.try_parse_json(text).try_cast("array<variant>")


def framed_value(arr: Column | str, doc: Column | str) -> Column:
    """The document, if it was exactly one JSON value.

    Spark's parser stops after the first value, so ``{"a":1}} x`` would parse. Followed by its own hash
    inside an array, a text with anything after its value fails to parse or has no hash as second item.
    """
    arr, doc = _col(arr), _col(doc)
    whole = (F.size(arr) == 2) & (F.try_variant_get(arr[1], "$", "bigint") == F.xxhash64(doc))
    return F.when(whole, arr[0])


def strict_json(doc: Column | str) -> Column:
    """Parse a text that is one JSON value and nothing else; NULL otherwise."""
    return framed_value(framed_array(doc), doc)


def looks_bracketed(text: Column | str) -> Column:
    """The text, without outer white space, opens and closes as an object or an array."""
    t = F.btrim(_col(text), F.lit(JSON_SPACE))
    return (F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))) | (
        F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]"))
    )


def kind_of(v: Column | str) -> Column:
    """Type name of a VARIANT: BIGINT, DECIMAL(p,s), STRING, BOOLEAN, VOID, ``OBJECT<...>``, ``ARRAY<...>``."""
    return F.schema_of_variant(_col(v))


def is_object(v: Column | str) -> Column:
    return F.coalesce(F.startswith(kind_of(v), F.lit("OBJECT<")), F.lit(False))


def is_array(v: Column | str) -> Column:
    return F.coalesce(F.startswith(kind_of(v), F.lit("ARRAY<")), F.lit(False))


def _is_number_kind(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL("))


def json_text(payload: Column | str, path: str) -> Column:
    """Field as text, NULL when absent or JSON null."""
    return F.try_variant_get(_col(payload), path, "string")


def json_num(payload: Column | str, path: str) -> Column:
    """Field as DOUBLE only if it is a JSON number. A numeric string does not compare as a number."""
    payload = _col(payload)
    kind = kind_of(F.try_variant_get(payload, path, "variant"))
    return F.when(_is_number_kind(kind), F.try_variant_get(payload, path, "double"))


def json_truthy(payload: Column | str, path: str) -> Column:
    """A bare path as predicate: absent, null, false, 0, "", [] and {} fail."""
    payload = _col(payload)
    text = F.to_json(F.try_variant_get(payload, path, "variant"))
    empty = text.isNull() | text.isin("null", "false", '""', "[]", "{}")
    return ~empty & (F.coalesce(json_num(payload, path), F.lit(1.0)) != 0)


def same_value(x: Column, y: Column) -> Column:
    """JSON equality: numbers by value (1 = 1.0, true = 1) at any depth of a list, everything else by its canonical text.

    An integer and a decimal are compared exactly; a double has 15 to 17 digits, so others are compared as doubles.
    """
    kx, ky = kind_of(x), kind_of(y)

    def number(v: Column, kind: Column, as_type: str) -> Column:
        return F.when(_is_number_kind(kind), F.try_variant_get(v, "$", as_type)).when(
            kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast(as_type)
        )

    exact = "decimal(38,18)"
    integers = (kx == "BIGINT").cast("int") + (ky == "BIGINT").cast("int")
    same_number = F.coalesce(
        F.when(integers >= 1, number(x, kx, exact) == number(y, ky, exact)), number(x, kx, "double") == number(y, ky, "double")
    )
    lists = F.startswith(kx, F.lit("ARRAY<")) & F.startswith(ky, F.lit("ARRAY<"))
    same_list = F.when(lists, _by_value(F.to_json(x)) == _by_value(F.to_json(y)))
    return (F.to_json(x) == F.to_json(y)) | F.coalesce(same_number, same_list, F.lit(False))


def _by_value(json: Column) -> Column:
    """A JSON text with each number and boolean written by its value alone."""
    tokens = F.regexp_extract_all(json, F.lit(r'("(?:[^"\\]|\\.)*"|[^"\s,:\[\]{}]+|[,:\[\]{}])'), 1)

    def plain(t: Column) -> Column:
        double = t.try_cast("double")
        whole = F.when((double == F.floor(double)) & (F.abs(double) < 1e15), double.cast("bigint").cast("string"))
        integer = F.when(t.rlike("^-?[0-9]+$"), F.coalesce(t.try_cast("bigint").cast("string"), t))
        return (
            F.when(t == "true", "1")
            .when(t == "false", "0")
            .when(t.rlike("^-?[0-9]"), F.coalesce(integer, whole, double.cast("string"), t))
            .otherwise(t)
        )

    return F.array_join(F.transform(tokens, plain), "")


def nesting_bound(json: Column | str) -> Column:
    """At least as much as the nesting of a JSON text: its opening brackets, also those inside strings. 0 for NULL."""
    json = _col(json)
    return F.coalesce(F.length(json) - F.length(F.translate(json, "{[", "")), F.lit(0))


def payload_text(payload: Column | str = "payload", value: Column | str = "value") -> Column:
    """Payload as compact JSON text; the record's text when nothing structured was decoded."""
    return F.coalesce(F.to_json(_col(payload)), _col(value))
