"""Text, byte and header expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_empty(c: Column | str) -> Column:
    """NULL for an empty string or empty bytes."""
    c = _col(c)
    return F.when(F.octet_length(c) > 0, c)


def bytes_text(b: Column | str) -> Column:
    """UTF-8 text of the bytes, or ``0x`` and lower-case hex when they are not UTF-8."""
    b = _col(b)
    text = b.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(b))))


def header_map(headers: Column | str) -> Column:
    """``array<struct<key, value binary>>`` to ``map<string, string>``.

    The last of several headers with one name wins. Earlier ones are dropped before the map is
    built, so the result does not depend on the session's map-key policy.
    """
    h = F.coalesce(_col(headers), F.expr("cast(array() as array<struct<key:string,value:binary>>)"))
    names, texts = h["key"], h["value"].cast("array<string>")
    # The common case, in generated code: every name once, every value present and UTF-8. An ASCII separator keeps
    # broken bytes of two values from forming a character.
    plain = (
        (F.size(F.array_compact(F.array_distinct(names))) == F.size(names))
        & (F.size(F.array_compact(texts)) == F.size(names))
        & F.is_valid_utf8(F.array_join(texts, ","))
    )

    def is_last(x: Column, i: Column) -> Column:
        later = F.slice(h, i + 2, F.size(h))
        return x["key"].isNotNull() & ~F.exists(later, lambda y: y["key"] == x["key"])

    def entry(x: Column) -> Column:
        return F.struct(x["key"].alias("key"), bytes_text(F.coalesce(x["value"], F.lit(b""))).alias("value"))

    general = F.map_from_entries(F.transform(F.filter(h, is_last), entry))
    return F.when(plain, F.map_from_arrays(names, texts)).otherwise(general)


def header_array(headers: Column | str) -> Column:
    """``map<string, string>`` to the ``array<struct<key, value binary>>`` a Kafka sink takes; NULL when empty."""
    m = _col(headers)
    entries = F.transform(
        F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value"))
    )
    return F.when(F.size(m) > 0, entries)


def header(headers: Column | str, *names: str) -> Column:
    """First non-empty value among the named headers (exact-case names)."""
    m = _col(headers)
    return F.coalesce(*[non_empty(m[n]) for n in names])


def with_headers(headers: Column, added: dict[str, Column]) -> Column:
    """Set headers, replacing those of the same name."""
    names = list(added)
    kept = F.map_filter(headers, lambda k, v: ~k.isin(names))
    pairs = [x for n in names for x in (F.lit(n), added[n])]
    return F.map_concat(kept, F.create_map(*pairs))


def parse_header_text(text: Column | str) -> Column:
    """``k:v,k:v`` to a map. Splits each pair at its first colon, trims, drops pairs without a colon; last wins."""
    space = F.lit(" \t\r\n")
    parts = F.filter(F.split(_col(text), ",", -1), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(
        parts,
        lambda p: F.struct(
            F.btrim(F.substring_index(p, ":", 1), space).alias("key"),
            F.btrim(F.regexp_replace(p, "^[^:]*:", ""), space).alias(
                "value"
            ),
        ),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def ellipsis(c: Column | str, width: int) -> Column:
    """Cut a text longer than ``width`` to ``width`` characters ending in three dots."""
    c = _col(c)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def digits_or_null(c: Column | str) -> Column:
    """A header of digits as BIGINT, anything else NULL."""
    c = _col(c)
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def exception_class(c: Column | str) -> Column:
    """Last dotted part of the first word ending in Exception or Error (case-sensitive), else NULL."""
    # Fixed value: the pattern, over Unicode letters.
    name = non_empty(F.regexp_extract(_col(c), r"(?U)([\w.]+(?:Exception|Error))", 1))
    return F.substring_index(name, ".", -1)


def dotted(prefix: Column, name: Column) -> Column:
    """``prefix.name``; a root name stands alone."""
    return F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("."), name))
