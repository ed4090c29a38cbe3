"""Shared pieces of the corpus operators: stored tables, Arrow word splitting, span joins, components.

Every intermediate table is written as Parquet under the session's shared
checkpoint folder and read again.  That cuts the lineage, survives a lost
executor and makes sampled decisions (range bounds) the same for every reader.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reitlens.session import ensure_checkpoint_dir

#: White space of the word pattern ``[^\x20\x09-\x0D]+`` as a Java/RE2 character class.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
#: A side of a join is broadcast up to this many bytes of measured column data; beyond, a shuffle join.
BROADCAST_BYTES = 48 << 20
#: Text bytes handled at a time inside a task, whatever the Arrow batch holds: hashes of a slice take up to 80 times its bytes.
SLICE_BYTES = 512 << 10


def work_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it."""
    import os
    import tempfile
    import zipfile

    import reitlens

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(reitlens.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="reitlens-ship-"), f"{app}-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def data_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df`` (one small aggregation); strings, binaries and arrays are measured."""
    size = F.lit(8)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        elif kind == "array":
            size = size + F.coalesce(F.size(f.name), F.lit(0)) * 24 + 16
        else:
            size = size + 8
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is within ``limit``, else as it is."""
    return F.broadcast(df) if data_bytes(df) <= limit else df


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0), in JVM functions."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, SPACES), "")).cast("long")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of ``batch`` holding about ``limit`` bytes of ``column`` each (one row at least)."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (null: none) one after another, and row offsets into them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten()
    keep = np.asarray(pc.binary_length(flat)) > 0
    if not keep.all():
        row = np.repeat(np.arange(len(counts)), counts)[keep]
        counts = np.bincount(row, minlength=len(counts))
        flat = flat.filter(pa.array(keep))
    return flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public-domain constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S33
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset:words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    return Substrings(BYTE_VALUES[raw]).of(at[:-1], at[1:])


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring values: rows 0 .. n - width (polynomial mod 2**64, then mixed)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for i in range(width):
        out *= base
        out += values[i:i + n]
    return mix(out)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of the undirected graph ``edges``: one row (node, component = smallest node of it).

    Alternating large-star / small-star rounds: each round is two joins on the
    node with aggregated minima, so no component is ever gathered in a task.
    The frame is stored after each round; rounds end when no edge changes.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct()
    e = stored(e, "cc")
    last = None
    while True:
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        small_low = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(small_low, "v")
        e = stored(linked.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
                   .union(small_low.select("v", F.col("m").alias("u"))).distinct(), "cc")
        sums = e.agg(F.count(F.lit(1)), F.sum(F.hash("v", "u").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if tuple(sums) == last:
            break
        last = tuple(sums)
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)


#: The candidate filter has 8 to 16 bits a key, within these bounds (at most 64 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
#: Bytes of the filter that one row of its table holds.
FILTER_PIECE = 1 << 17


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bitmap with two bits set per key of the long column ``column``, put together by Spark piece by piece.

    Every task turns its keys into bits, which are dealt out by the piece of the
    bitmap that they fall in; a task holds the pieces dealt to it, 128 KB each.
    A filter only spares work: it has no false negatives, whatever passes it is
    judged exactly later, and with more keys than its bound can tell apart it
    just lets more through.
    """
    spark = keys.sparkSession
    ship(spark)
    count = keys.count()
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 8 * count:
        bits *= 2
    width = FILTER_PIECE * 8

    def place(batches):
        for b in batches:
            at = np.concatenate(filter_bits(np.asarray(b.column(0)).astype(np.int64).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))], names=["i", "at"])

    def mark(batches):
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            i, at = np.asarray(b.column(0)), np.asarray(b.column(1))
            for k in np.unique(i).tolist():
                piece = pieces.setdefault(k, np.zeros(FILTER_PIECE, np.uint8))
                mine = np.zeros(width, np.uint8)
                mine[at[i == k]] = 1
                piece |= np.packbits(mine, bitorder="little")
        for k, piece in pieces.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([k], pa.int32()), "bits": pa.array([piece.tobytes()], pa.binary())})

    placed = keys.select(column).mapInArrow(place, "i int, at int")
    rows = placed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "i").mapInArrow(mark, "i int, bits binary").toLocalIterator()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.i * FILTER_PIECE:r.i * FILTER_PIECE + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def filter_bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    k = mix(keys)
    mask = np.uint64(bits - 1)
    return (k & mask).astype(np.int64), ((k >> np.uint64(32)) & mask).astype(np.int64)


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in filter_bits(keys, len(bitmap) * 8):
        out &= ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    return out


#: What each byte stands for in hashes.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


#: Powers of the hash's multiplier and of its inverse, kept for sequences of up to this many values.
_POWERS: list[np.ndarray] = []
_KEEP_POWERS = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the multiplier and of its inverse."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= _KEEP_POWERS:
        _POWERS[:] = out
    return out[0][:n], out[1][:n]


class Substrings:
    """Hash of any stretch [lo, hi) of a sequence of 64-bit values, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all stretches of ``width`` values."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + np.uint64(width)) if n > 0 else np.zeros(0, np.uint64)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


def doc_key(doc_id: str) -> Column:
    """The id as a long that orders documents; a null id comes after all others."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))


def row_key(doc_id: str, *columns: str) -> Column:
    """(id, mark): the id and a hash of ``columns``, which tells rows of one id or without an id apart."""
    parts = [x for i, c in enumerate(columns) for x in ((F.lit(i), F.col(c)) if i else (F.col(c),))]
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(*parts).alias("mark"))


def without_rows(docs: DataFrame, gone: DataFrame, doc_id: str, *columns: str) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is not among (id, mark) of ``gone``."""
    gone = sized(gone.select(F.col("id").alias("gone_id__"), F.col("mark").alias("gone_mark__")))
    key = row_key(doc_id, *columns)
    return docs.join(gone, key["id"].eqNullSafe(F.col("gone_id__")) & (key["mark"] == F.col("gone_mark__")), "left_anti")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, mark, text): id as a long, a hash of the text that tells rows of one id apart, and the text."""
    return docs.select(doc_key(doc_id).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all spans in a column of arrays of (start, end); null arrays hold none."""
    rows = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
    flat = column.flatten()
    return rows, np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("end")).astype(np.int64)


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each of ``size`` places lies in one of the stretches [start, end)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge)[:-1] > 0


def stretches(spans: DataFrame) -> DataFrame:
    """``spans`` (doc, mark, start, end) with those that overlap or touch made one; a task holds the spans of one document at a time."""
    order = Window.partitionBy("doc", "mark").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("begins", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = begins.withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("doc", "mark", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` frame behind its last reader."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_spans(src: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``src`` (doc, mark, ...) with ``name``, the array of (start, end) that ``spans`` (doc, mark, start, end) has for the row, or null."""
    lists = stretches(spans).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias(name))
    return src.join(sized(stored(lists, "span-lists")), ["doc", "mark"], "left")


class Lookup:
    """Sorted key array with the payload arrays of each key; a small table held by every task."""

    def __init__(self, keys: np.ndarray, *payload: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.payload = keys[order], [p[order] for p in payload]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


def lookup_of(table: DataFrame, key: str, *payload: str, limit: int = BROADCAST_BYTES) -> Lookup:
    """``table`` as a Lookup if its longs fit ``limit`` bytes, else an empty one (whoever asks then takes the general way)."""
    if table.count() * 8 * (1 + len(payload)) > limit:
        return Lookup(np.zeros(0, np.int64), *[np.zeros(0, np.int64) for _ in payload])
    cols = table.select(key, *payload).toArrow()
    return Lookup(*[cols[c].to_numpy().astype(np.int64, copy=False) for c in (key, *payload)])
