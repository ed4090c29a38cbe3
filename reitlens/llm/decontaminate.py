"""Benchmark decontamination by spaced-seed hashing.

A window of ``WINDOW`` words is cut into blocks; each mask keeps some blocks and
ignores the others, so two windows with at most ``TOLERANCE`` substituted words
agree on all kept positions of at least one mask.  Masked hashes of the test
items and of the documents are joined, and a hit is verified word by word around
it: the windows must agree in all but ``TOLERANCE`` words.  Items shorter than a
window are held whole, with the same share of substitutions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import BROADCAST_BYTES, key_filter, may_hold, mix, rolling, row_key, ship, split_words, stored, text_slices, without_rows, word_hashes

WINDOW = 13
TOLERANCE = 2
#: Items shorter than this are too common to tell a leak by.
SHORTEST = 5


def plain_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in lower case (A-Z) without punctuation at their ends; words of punctuation only stay as they are."""
    words, offsets = split_words(text)
    bare = pc.ascii_trim(pc.ascii_lower(words), characters="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return pc.if_else(pc.equal(pc.binary_length(bare), 0), words, bare), offsets


def masks(width: int, tolerance: int) -> list[np.ndarray]:
    """Position sets: ``width`` cut into tolerance + 2 blocks, each mask ignores ``tolerance`` of them."""
    blocks = np.array_split(np.arange(width), tolerance + 2)
    return [np.concatenate([b for i, b in enumerate(blocks) if i not in skip]) for skip in combinations(range(tolerance + 2), tolerance)]


def allowed(width: int, window: int = WINDOW, tolerance: int = TOLERANCE) -> int:
    """Substitutions that a window of ``width`` words may have."""
    return tolerance * width // window


def seeds(h: np.ndarray, width: int, tolerance: int) -> np.ndarray:
    """Masked hashes: row m holds mask m's hash of the window at each position."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros((0, 0), np.uint64)
    out = []
    for m, kept in enumerate(masks(width, tolerance)):
        acc = np.zeros(n, np.uint64)
        for k in kept:
            acc *= np.uint64(0x9E3779B97F4A7C15)
            acc += h[k:k + n]
        out.append(mix(acc ^ np.uint64(m * 1_000_003 + width)))
    return np.stack(out)


def item_windows(items: DataFrame, item_id: str, text: str, window: int, tolerance: int, shortest: int) -> DataFrame:
    """(seed, item_id, width, at, words): one row per mask and window of every item, with the window's word hashes."""
    id_type = items.schema[item_id].dataType.simpleString()
    ship(items.sparkSession)

    def run(batches):
        for batch in batches:
            for b in text_slices(batch, "text"):
                words, offsets = plain_words(b.column("text"))
                h = word_hashes(words)
                seed, row, width, at, packed = [], [], [], [], []
                for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:])):
                    w = min(window, int(e - s))
                    if w < shortest:
                        continue
                    own = h[s:e]
                    for m in seeds(own, w, allowed(w, window, tolerance)):
                        for k, x in enumerate(m.view(np.int64).tolist()):
                            seed.append(x)
                            row.append(i)
                            width.append(w)
                            at.append(k)
                            packed.append(own[k:k + w].tobytes())
                if seed:
                    yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), b.column("item_id").take(pa.array(row)), pa.array(width, pa.int32()),
                                                      pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names=["seed", "item_id", "width", "at", "words"])

    src = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"seed long, item_id {id_type}, width int, at int, words binary")


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
             window: int = WINDOW, tolerance: int = TOLERANCE, shortest: int = SHORTEST, limit: int = BROADCAST_BYTES, named: bool = True) -> DataFrame:
    """(doc_id, item_id, word, width): verified overlaps, ``word`` is the first word of the window in the document.

    Null or empty texts hold no words and meet nothing; items under ``shortest``
    words are not searched.  Repeated items report under each id, repeated
    documents under each row.  The item hashes go to every task while their
    measured size is within ``limit``; beyond it a bitmap of them, so that few
    words of clean texts reach the join.  Windows that several items share are
    verified once.  Without ``named`` the items' ids are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    grid = stored(item_windows(items, item_id, item_text, window, tolerance, shortest), "decon-items")
    widths = sorted(r[0] for r in grid.select("width").distinct().collect())  # at most ``window`` values
    seed_count = grid.count()
    id_type = docs.schema[doc_id].dataType.simpleString()
    table = bitmap = None
    if seed_count * 8 > limit:
        bitmap = spark.sparkContext.broadcast(key_filter(grid.select("seed").distinct(), "seed"))
    else:
        table = spark.sparkContext.broadcast(np.sort(np.concatenate([np.asarray(r) for r in [grid.select("seed").distinct().toPandas()["seed"].to_numpy(np.int64)]])))

    def run(batches):
        wanted = None if table is None else table.value
        for batch in batches:
            for b in text_slices(batch, "text"):
                words, offsets = plain_words(b.column("text"))
                h = word_hashes(words)
                last = np.repeat(offsets[1:], np.diff(offsets))  # end of the document of each word
                first = np.repeat(offsets[:-1], np.diff(offsets))
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                for w in widths:
                    for m in seeds(h, w, allowed(w, window, tolerance)):
                        k = m.view(np.int64)
                        at = np.arange(len(k))
                        ok = at + w <= last[:len(k)]
                        if wanted is not None:
                            if not len(wanted):
                                continue
                            near = np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)
                            ok &= wanted[near] == k
                        else:
                            ok &= may_hold(bitmap.value, m)
                        at = at[ok]
                        for s in range(0, len(at), 1 << 16):
                            a = at[s:s + (1 << 16)]
                            view = np.lib.stride_tricks.sliding_window_view(h, w)[a].astype(np.uint64)
                            data = pa.Array.from_buffers(pa.binary(w * 8), len(a), [None, pa.py_buffer(np.ascontiguousarray(view).tobytes())]).cast(pa.binary())
                            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc[a])), pa.array(k[a]), pa.array((a - first[a]).astype(np.int32)), data], names=["doc_id", "seed", "word", "own"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hits = src.mapInArrow(run, f"doc_id {id_type}, seed long, word int, own binary").withColumnRenamed("seed", "d_seed")
    windows = stored(grid.select("seed", "width", "words").distinct(), "decon-windows")
    pairs = hits.join(windows, F.col("d_seed") == F.col("seed"))
    # words that agree, position by position, from 8-byte word hashes
    same = F.aggregate(F.sequence(F.lit(0), F.col("width") - 1), F.lit(0), lambda n, i: n + F.when(
        F.substring(F.col("own"), i * 8 + 1, F.lit(8)) == F.substring(F.col("words"), i * 8 + 1, F.lit(8)), 1).otherwise(0))
    limit_ = F.floor(F.lit(tolerance) * F.col("width") / F.lit(window))
    near = pairs.where((F.length("own") == F.length("words")) & (F.col("width") - same <= limit_))
    if not named:
        return near.select("doc_id", "word", "width").distinct()
    of = grid.select("words", "item_id").distinct()
    return near.select("doc_id", "word", "width", "words").distinct().join(of, "words").select("doc_id", "item_id", "word", "width").distinct()


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word): documents that overlap with test items."""
    found = overlaps(docs, items, **options)
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.min("word").cast("long").alias("first_word"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that overlap with no item; rows with one id or without an id are judged each by its own text."""
    text = options.pop("text", "text")
    rows = docs.select(row_key(doc_id, text).alias("doc_id"), F.col(text).alias("text"))
    bad = stored(overlaps(rows, items, named=False, **options).select("doc_id.id", "doc_id.mark").distinct(), "decon-bad")
    return without_rows(docs, bad, doc_id, text)
