"""Many substrings searched at once.

Every id is filed under one window of its bytes: the window of its width that the fewest ids have. A text offers its windows of
each width in use, at most five, whatever the lengths of ids and texts. A table of hashed windows tells inside the row which
windows no id has, so a row is built for a likely hit only; then windows are joined and the id is looked for in the text. The table
grows with the ids, so the share of windows that pass does not: one byte each in a literal, for many ids one bit each in a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of windows in bytes; an id has the widest that it is not shorter than.
WIDTHS = (16, 8, 4, 2, 1)
#: Bytes of the table of hashed windows where it is a literal of the plan, at most 1 MB.
FEWEST_SLOTS, MOST_SLOTS = 1 << 12, 1 << 20
SLOTS_PER_ID = 16
#: Bits of the table where that would be too small, at most 64 MB: 32 an id up to 16 million ids.
BITS_PER_ID, MOST_BITS = 32, 1 << 29


def _width(size: Column) -> Column:
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(size >= w, w).otherwise(width)
    return width


def _slot(window: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(window), F.lit(slots)).cast("int")


def anchors(ids: DataFrame, text: str) -> DataFrame:
    """``ids`` with ``width`` and ``window``: the rarest window of each id's ``text`` among those of all ids, the last of equals.

    ``text`` is unique and not empty.
    """
    data = F.col(text).cast("binary")
    sized = ids.withColumns({"_data": data, "width": _width(F.octet_length(data))})
    places = F.sequence(F.lit(1), F.octet_length("_data") - F.col("width") + 1)
    each = sized.withColumn("_at", F.explode(places)).withColumn("window", F.expr("substring(_data, _at, width)"))
    shared = each.groupBy("window").agg(F.count(F.lit(1)).alias("_ids"))
    best = F.min_by(F.struct("window"), F.struct("_ids", -F.col("_at"))).alias("best")
    chosen = each.join(shared, "window").groupBy(text).agg(F.first("width").alias("width"), best)
    return ids.join(chosen.select(text, "width", F.col("best.window").alias("window")), text)


def likely_windows(rows: DataFrame, data: str, anchored: DataFrame, n: int) -> DataFrame:
    """``rows`` with each window of the bytes in column ``data`` that some of the ``n`` rows of ``anchored`` (width, window) may
    have, as ``_offer`` at place ``_at``.

    One small job reads the widths in use and, for few ids, the slots of the table. Windows are cut and tested inside one
    generated loop; what fails the test is never a row.
    """
    slots = FEWEST_SLOTS
    while slots < min(SLOTS_PER_ID * n, MOST_SLOTS):
        slots *= 2
    few = SLOTS_PER_ID * n <= MOST_SLOTS
    taken = F.collect_set(_slot(F.col("window"), slots)) if few else F.lit(None)
    used = anchored.agg(F.collect_set("width").alias("widths"), taken.alias("slots")).first()
    widths = F.array(*[F.lit(w) for w in sorted(used.widths)]).cast("array<int>")
    last = F.octet_length(data) - F.col("_width") + 1
    cut = rows.withColumn("_width", F.explode(widths)).filter(last >= 1)
    cut = cut.withColumn("_at", F.explode(F.sequence(F.lit(1), last))).withColumn("_offer", F.substring(data, F.col("_at"), F.col("_width")))
    if not few:
        return _in_bitmap(cut, anchored, n)
    table = bytearray(slots)
    for s in used.slots:
        table[s] = 1
    return cut.filter(F.substring(F.lit(bytes(table)), _slot(F.col("_offer"), slots) + 1, F.lit(1)) == F.lit(b"\x01"))


def _in_bitmap(cut: DataFrame, anchored: DataFrame, n: int) -> DataFrame:
    """``cut`` without the windows ``_offer`` whose bit is not set in a table of ``BITS_PER_ID`` bits an id, broadcast in parts."""
    bits = 1 << 15
    while bits < min(BITS_PER_ID * n, MOST_BITS):
        bits *= 2
    place = lambda window: F.pmod(F.xxhash64(window), F.lit(bits))
    parts = anchored.select(F.shiftright(place("window"), 15).alias("_part"), place("window").bitwiseAND(F.lit(32767)).alias("_bit"))
    parts = parts.groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = place("_offer").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = cut.join(F.broadcast(parts), F.shiftright(place("_offer"), 15) == F.col("_part"))
    return found.filter(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0).select(*cut.columns)


def is_first(data: str) -> Column:
    """Whether ``_offer`` does not stand in ``data`` before ``_at``: true for one place of each window of a text."""
    return ~F.contains(F.substring(data, F.lit(1), F.col("_at") + F.col("_width") - 2), F.col("_offer"))
