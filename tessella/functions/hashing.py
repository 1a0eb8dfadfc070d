"""Hash family of the engine: digests for identity, whole numbers for draws and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(x: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(x.cast("string"), 256), 1, digits)


def sha1_hex(x: Column, digits: int = 20) -> Column:
    return F.substring(F.sha1(x.cast("string")), 1, digits)


def md5_int(x: Column) -> Column:
    """The first 32 bits of MD5 as a long: the same number in any engine, so draws can be checked elsewhere."""
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 8), 16, 10).cast("long")


def unit_draw(x: Column, parts: int = 1000) -> Column:
    """A number of [0, 1) with ``parts`` values, by hash."""
    return F.pmod(md5_int(x), F.lit(parts)) / F.lit(float(parts))
