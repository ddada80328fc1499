"""SplitMix64 as column arithmetic: one draw for each number, in any order, without state.

Its products wrap at 64 bits, which ANSI mode forbids. A DataFrame that is
built while ANSI mode is off keeps wrapping later on, so the helpers take and
give DataFrames and put the session back as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of SplitMix64.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_M64 = (1 << 64) - 1


def signed(value: int) -> int:
    """The long with the same 64 bits."""
    value &= _M64
    return value - (1 << 64) if value >> 63 else value


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """DataFrames built inside have arithmetic that wraps."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _long(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def _finalised(df: DataFrame, name: str, z: Column) -> DataFrame:
    """df with z mixed. Each step is a column: it is used twice by the next, and would be written out eight times in one expression."""
    df = df.withColumn("_z0", z)
    for i, (shift, factor) in enumerate(((30, MIX_1), (27, MIX_2))):
        df = df.withColumn(f"_z{i + 1}", F.col(f"_z{i}").bitwiseXOR(F.shiftrightunsigned(f"_z{i}", shift)) * _long(factor))
    return df.withColumn(name, F.col("_z2").bitwiseXOR(F.shiftrightunsigned("_z2", 31))).drop("_z0", "_z1", "_z2")


def with_draw(df: DataFrame, name: str, seed: Column | int, nth: Column) -> DataFrame:
    """df with the nth (from 1) 64-bit draw of the stream of seed, as a long of the same bits."""
    seed = _long(seed) if isinstance(seed, int) else seed
    with wrapping(df.sparkSession):
        start = seed.bitwiseXOR(_long(GOLDEN))
        return _finalised(df, name, start + nth.cast("long") * _long(GOLDEN))


def with_uniform(df: DataFrame, name: str, seed: Column | int, nth: Column) -> DataFrame:
    """df with a uniform double in (0, 1): the draw's upper 53 bits, the smallest positive double for 0."""
    drawn = with_draw(df, "_draw", seed, nth)
    u = F.shiftrightunsigned("_draw", 11) * F.lit(2.0**-53)
    return drawn.withColumn(name, F.greatest(u, F.lit(2.2250738585072014e-308))).drop("_draw")


def with_below(df: DataFrame, name: str, draw: str, bound: Column) -> DataFrame:
    """df with the draw scaled to 0 .. bound - 1 (bound up to 2^31): the upper half of their 128-bit product, by 32-bit halves."""
    d, b = F.col(draw), bound.cast("long")
    high, low = F.shiftrightunsigned(d, 32), d.bitwiseAND(F.lit(0xFFFFFFFF))
    return df.withColumn(name, F.shiftrightunsigned(high * b + F.shiftrightunsigned(low * b, 32), 32))


def with_site_bucket(df: DataFrame, name: str, site: Column, bit: Column, seed: Column | int = 0, buckets: int = 4) -> DataFrame:
    """df with the hash class, 0 .. buckets - 1 (a power of two), of a site for a species."""
    seed = _long(seed) if isinstance(seed, int) else seed
    with wrapping(df.sparkSession):
        z = site.cast("long") * _long(GOLDEN) + bit.cast("long") * _long(MIX_1) + seed
        return _finalised(df, name, z).withColumn(name, F.col(name).bitwiseAND(F.lit(buckets - 1)).cast("int"))


def draw_of(seed: int, nth: int) -> int:
    """The same draw as a Python number."""
    z = ((seed ^ GOLDEN) + nth * GOLDEN) & _M64
    z = ((z ^ (z >> 30)) * MIX_1) & _M64
    z = ((z ^ (z >> 27)) * MIX_2) & _M64
    return z ^ (z >> 31)
