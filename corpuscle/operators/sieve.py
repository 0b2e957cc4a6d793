"""A sieve of fixed size: whether a long may be among many others.

One bit for each of SLOTS hash values, kept as bitmaps of 4 KB, so that it may be
broadcast whatever the size of the data: 1 MB at most. It lets through all members
and some others; the join behind it decides. A full sieve lets everything through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, WIDTH = 1 << 23, 1 << 15


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("sieve"), key), F.lit(SLOTS))


def sieve(keys: DataFrame) -> DataFrame:
    """(bucket, bits) of the one column of keys; nulls are no members."""
    place = keys.select(keys[keys.columns[0]].alias("x")).where("x is not null").select(_place(F.col("x")).alias("p"))
    return place.groupBy(F.floor(F.col("p") / WIDTH).alias("bucket")).agg(F.bitmap_construct_agg((F.col("p") % WIDTH).cast("long")).alias("bits"))


def passes(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """rows with the column may: false only where key is not in the sieve."""
    held = F.broadcast(members.withColumnsRenamed({"bucket": "sieve_bucket", "bits": "sieve_bits"}))
    placed = rows.withColumn("sieve_place", _place(F.col(key)))
    joined = placed.join(held, F.floor(F.col("sieve_place") / WIDTH) == F.col("sieve_bucket"), "left")
    byte = F.conv(F.hex(F.substring("sieve_bits", (F.floor((F.col("sieve_place") % WIDTH) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col("sieve_place") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn("may", F.coalesce(bit, F.lit(False))).drop("sieve_place", "sieve_bucket", "sieve_bits")
