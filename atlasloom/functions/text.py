"""Column expressions for names, labels, run lengths, times and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasloom.functions.geometry import col


def normalize_label(c) -> Column:
    """Underscores to spaces, white space collapsed and trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(col(c), "_", " "), r"\s+", " ")))


def padded(c, width: int) -> Column:
    """Filled up with zeros on the left; longer texts stay whole."""
    c = col(c)
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), F.lit("0"))


def natural_key(c) -> Column:
    """Sort key, an array, under which runs of digits compare as whole numbers of any length and come before text.

    A run of digits is its number of significant digits (ten places) and those digits, a text follows its mark.
    """
    parts = F.regexp_extract_all(col(c), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    number = lambda p: F.concat(F.lit("0"), padded(F.length(p).cast("string"), 10), p)
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(F.ltrim(p, F.lit("0")))).otherwise(F.concat(F.lit("1"), p)))


def frame_name(n, width: int = 6) -> Column:
    return F.concat(F.lit("f"), padded(col(n).cast("string"), width))


def hex_colour(r, g, b) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(col(c).cast("long")), 2, "0")) for c in (r, g, b)])


def attributes(c) -> Column:
    """`k=v,k=v` as a map; an empty text is an empty map."""
    return F.str_to_map(F.coalesce(col(c), F.lit("")), F.lit(","), F.lit("="))


def digest(*cs) -> Column:
    """SHA-256 of the values as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*[col(c) for c in cs])), 256)


def time_in_name(c) -> Column:
    """Timestamp written as `YYYYMMDD-HHMMSS` inside a name, null where there is none."""
    found = F.regexp_extract(col(c), r"(\d{8}-\d{6})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyyMMdd-HHmmss"))


def rle_area(counts) -> Column:
    """Set cells of run lengths that begin with a run of unset ones."""
    return F.aggregate(F.filter(col(counts), lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)


def rle_decode(counts) -> Column:
    """Run lengths as an array of 0 and 1."""
    return F.flatten(F.transform(col(counts), lambda n, i: F.array_repeat((i % 2).cast("int"), n.cast("int"))))
