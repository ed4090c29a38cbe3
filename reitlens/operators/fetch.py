"""Late fetch of large values: prune a wide scan by the chosen keys before anything is exchanged.

A few keys are chosen from narrow columns, and a large value (a filing's text)
is wanted for those only.  Joining first would shuffle every value.  Here the
chosen keys go to the scan: as they are while their measured size fits a
broadcast, beyond that as a bitmap of hashed keys of at most 64 MB, which Spark
puts together with ``bitmap_construct_agg``.  Values of other keys are dropped
where they are read, what is wanted of a value is computed there too, and only
those results are joined with the chosen rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens.session import ensure_checkpoint_dir

#: Keys are broadcast as they are up to this many bytes of measured column data.
KEY_BYTES = 32 << 20
#: Bits per bitmap row (fixed by ``bitmap_construct_agg``), bits per key, and the most bits in all.
ROW_BITS, BITS_A_KEY, MOST_BITS = 1 << 15, 16, 1 << 29


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, so that its rows are chosen once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_bytes(keys: DataFrame, key: str) -> tuple[int, int]:
    """(rows, bytes) of the column ``key``."""
    kind = keys.schema[key].dataType.typeName()
    size = F.coalesce(F.octet_length(key), F.lit(0)) + 24 if kind in ("string", "binary") else F.lit(24)
    n, total = keys.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return n, total or 0


def _place(key: str, bits: int) -> tuple[Column, Column]:
    """(row of the bitmap, position in it) of a key."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.shiftright(h, 15).cast("long"), h.bitwiseAND(F.lit(ROW_BITS - 1)).cast("int")


def key_bitmap(keys: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """((row, bitmap), bits): a bit per hashed key, 4 KB a row."""
    bits = ROW_BITS
    while bits < MOST_BITS and bits < BITS_A_KEY * rows:
        bits *= 2
    row, at = _place(key, bits)
    marked = keys.where(F.col(key).isNotNull()).select(row.alias("bitmap_row"), at.cast("long").alias("at"))
    return marked.groupBy("bitmap_row").agg(F.bitmap_construct_agg("at").alias("bitmap")), bits


def may_be_chosen(source: DataFrame, key: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """Rows of ``source`` whose key's bit is set: all chosen ones, and a few others."""
    row, at = _place(key, bits)
    held = source.withColumn("bitmap_row", row).join(F.broadcast(bitmap), "bitmap_row")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    return held.where(bit == 1).select(*source.columns)


def late_fetch(chosen: DataFrame, source: DataFrame, key: str, wanted: Sequence[Column], limit: int = KEY_BYTES) -> DataFrame:
    """``chosen`` with the columns ``wanted`` (expressions over ``source``) of its key, null where ``source`` lacks it.

    ``key`` is unique on both sides.  No exchange stands above the scan of
    ``source`` but those of ``wanted`` itself.
    """
    chosen = stored(chosen, "chosen-keys")
    rows, size = key_bytes(chosen, key)
    if size <= limit:
        near = source.join(F.broadcast(chosen.select(key)), key, "left_semi")
    else:
        near = may_be_chosen(source, key, *key_bitmap(chosen, key, rows))
    names = [c for c in chosen.columns if c != key]
    found = near.select(key, *wanted)
    return chosen.join(found, key, "left").select(key, *names, *[c for c in found.columns if c != key])
