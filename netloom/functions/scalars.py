"""Column helpers: coercion, clipping, rounding, text and host tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: C, default: float | None = 0.0) -> Column:
    """Coerce to double; what cannot be read becomes the default."""
    n = F.nanvl(col(c).try_cast("double"), F.lit(None).cast("double"))
    return n if default is None else F.coalesce(n, F.lit(float(default)))


def text(c: C, default: str) -> Column:
    return F.coalesce(blank_to_null(col(c).cast("string")), F.lit(default))


def blank_to_null(c: C) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def clip(c: C, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit to [lo, hi]; null stays null (greatest / least would skip it)."""
    out = col(c).cast("double")
    if lo is not None and hi is not None:
        return F.when(out < lo, F.lit(float(lo))).when(out > hi, F.lit(float(hi))).otherwise(out)
    if lo is not None:
        return F.when(out < lo, F.lit(float(lo))).otherwise(out)
    return F.when(out > hi, F.lit(float(hi))).otherwise(out)


def limit(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """clip of a value that is never null: the argument is used, and so evaluated, once."""
    out = c.cast("double")
    if hi is not None:
        out = F.least(F.lit(float(hi)), out)
    return out if lo is None else F.greatest(F.lit(float(lo)), out)


def clip01(c: C) -> Column:
    return clip(c, 0.0, 1.0)


def flag(c: Column) -> Column:
    """Boolean to 0.0 / 1.0; null counts as false."""
    return F.when(c, 1.0).otherwise(0.0)


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when den is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def r6(c: C) -> Column:
    """Six digits. The nudge settles exact halves whatever the order of summation was."""
    x = col(c).cast("double") + 1e-10
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6


def token(c: C) -> Column:
    """Lower-case identifier: runs of other characters become one underscore."""
    t = F.trim(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown"))


def contains_any(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    return c.rlike("|".join(words))


def file_stem(path: C) -> Column:
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_parent(path: C) -> Column:
    return F.coalesce(F.try_element_at(F.split(col(path), "/"), F.lit(-2)), F.lit(""))


def is_private(host: C) -> Column:
    h = F.lower(col(host))
    return (h.startswith("10.") | h.startswith("192.168.") | h.rlike(r"^172\.(1[6-9]|2\d|3[0-1])\.")
            | h.isin("127.0.0.1", "::1") | h.startswith("fc") | h.startswith("fd"))


def is_multicast(host: C) -> Column:
    h = F.lower(col(host))
    octet = F.split_part(h, F.lit("."), F.lit(1)).try_cast("int")
    return F.coalesce(octet.between(224, 239), F.lit(False)) | h.startswith("ff")


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def sha(*parts: C) -> Column:
    return F.sha2(F.concat(*[col(p) for p in parts]), 256)


def rank_by_hash(seed: int | Column, *cols: C) -> Column:
    """Deterministic pseudo-random order for splits and samples: 60 bits of a digest any engine can repeat."""
    start = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", start, *[col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
