"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329
#: The names of the eight labelled shapes.
SHAPES = ("STACK", "BIPARTITE", "FAN-OUT", "RANDOM", "FAN-IN", "GATHER-SCATTER", "CYCLE", "SCATTER-GATHER")


def normalize_bank(c: Column) -> Column:
    """Without leading zeros; nothing left is "0"."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def null_text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def null_number(c: Column, kind: str) -> Column:
    """Empty is null; text is read as a number and cut to ``kind``; anything else is an error."""
    return F.nullif(F.trim(c), F.lit("")).cast("double").cast(kind)


def exact_decimal(c: Column, precision: int, scale: int) -> Column:
    """Text as an exact decimal; empty or malformed text is an error."""
    text = F.trim(c)
    good = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    return F.when(good, text.cast(f"decimal({precision},{scale})")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(c, F.lit("null")))).cast(f"decimal({precision},{scale})"))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def dot(columns: list[Column], weights: list[float], bias: float = 0.0) -> Column:
    """Sum of products in list order, from the bias."""
    out = F.lit(float(bias))
    for c, w in zip(columns, weights, strict=True):
        out = out + c * F.lit(float(w))
    return out


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def ratio(amount: Column, mean: Column) -> Column:
    return F.when(mean <= 0, 1.0).otherwise(amount / mean)


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(precision: Column, recall: Column) -> Column:
    return share(2 * precision * recall, precision + recall)


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search among n rows."""
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(n - 1.0) + EULER) - 2 * (n - 1.0) / n)


def stamp(ts: Column) -> Column:
    """UTC text at microseconds, fixed width."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def short_hash(c: Column) -> Column:
    return F.substring(c, 1, 12)


def next_closure(origin: Column, t: Column, width: int, stride: int) -> Column:
    """First grid closure at or after t, never before the first window closes; whole microseconds."""
    late = F.greatest(F.lit(0).cast("long"), t - origin - F.lit(width))
    return origin + F.lit(width) + F.expr("1L") * F.ceil(late / F.lit(stride)).cast("long") * F.lit(stride)


def size_band(n: Column) -> Column:
    return F.when(n <= 2, "2").when(n <= 5, "3-5").when(n <= 20, "6-20").otherwise("21+")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def client_key(card1: Column, addr1: Column, d1: Column, dt: Column, txn: Column) -> Column:
    """Identity of a card holder; a key of its own where any part lacks. Days round half to even."""
    whole = F.concat(F.lit("uid:"), card1.cast("string"), F.lit(":"), addr1.cast("string"), F.lit(":"), (F.floor(dt / 86400) - F.bround(d1, 0).cast("long")).cast("string"))
    return F.when(card1.isNotNull() & addr1.isNotNull() & d1.isNotNull(), whole).otherwise(F.concat(F.lit("txn:"), txn.cast("string")))


def device_fingerprint(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
