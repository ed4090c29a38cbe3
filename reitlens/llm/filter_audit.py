"""Interaction audit of document filters by a Gray-code walk over their subsets.

Spark reduces the documents to cells: per part, how many documents fail exactly
the filters of a mask.  A walk over all subsets of filters in Gray-code order
toggles one filter at a time; each mask cell keeps how many active filters it
fails, and a cell whose counter leaves or reaches zero leaves or rejoins the
running survivors.  The survivors of all subsets (32 for five filters) are
stored, and every figure of every order of the filters is a difference of two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import doc_key, ship, sized, stored, text_slices

FILTERS = "ABCDE"
#: Filter A: fewest words. Filter B: least share of distinct words, in percent. Filter C: highest share of capitals, in percent.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = b"#$%&*|"
#: Bytes of a long text that are split into words at a time.
PIECE = 1 << 20
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
BLANKS = b" \t\n\x0b\f\r"
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes that end behind white space (or at the end), so no word is cut."""
    at = 0
    while len(raw) - at > size:
        end = max(raw.rfind(bytes([c]), at, at + size) for c in BLANKS) + 1
        if end <= at:
            end = min((e for e in (raw.find(bytes([c]), at + size) for c in BLANKS) if e >= 0), default=len(raw) - 1) + 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def failures(raw: bytes) -> int:
    """Bits 0 .. 3: whether a text fails the filters A, B, C, D."""
    words, distinct = 0, set()
    for piece in pieces(raw):
        found = piece.split()
        words += len(found)
        distinct.update(found)
    chars = len(raw.translate(None, _INNER))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    mask = int(words < FEWEST_WORDS)
    mask |= int(100 * len(distinct) < LEAST_DISTINCT * words) << 1
    mask |= int(100 * capitals > MOST_CAPITALS * chars) << 2
    return mask | int(len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


#: Bytes of UTF-8 that continue a code point.
_INNER = bytes(range(0x80, 0xC0))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic), a row per document: the bits of the filters that it fails and its labels.

    Equal texts are found by their SHA-256.  A document that several label rows
    name is good (toxic) if one of them says so.
    """
    ship(docs.sparkSession)
    src = docs.select(doc_key(doc_id).alias("id"), F.col(doc_id).cast("long").alias("label_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))

    def judge(batches):
        for batch in batches:
            for b in text_slices(batch, "text"):
                raw = pc.fill_null(b.column("text"), "").cast(pa.large_binary()).to_pylist()
                mask = np.fromiter(map(failures, raw), np.int32, len(raw))
                digest = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label_id"), b.column("part"), pa.array(mask), digest], names=["id", "label_id", "part", "mask", "digest"])

    rows = stored(src.mapInArrow(judge, "id long, label_id long, part string, mask int, digest binary"), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    repeats = F.when(F.col("first") < F.col("id"), 1 << 4).otherwise(0)
    joined = rows.join(sized(stored(first, "audit-first")), "digest", "left").join(marks, "label_id", "left")
    return joined.select("part", F.col("mask").bitwiseOR(repeats).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(masks: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, n, good, toxic): per part, arrays of 2 ** filters counts by mask."""
    small = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return small.groupBy("part").agg(*[F.array(*[_cell(c, m) for m in range(1 << filters)]).alias(c) for c in ("n", "good", "toxic")])


def _cell(count: str, mask: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("mask") == mask, F.col(count))), F.lit(0)).cast("long")


def gray_walk(count: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; ``count`` and the result have the mask (subset) as first axis."""
    size = len(count)
    failing = np.zeros(size, np.int64)  # active filters that the documents of a cell fail
    survivors = count.sum(axis=0)
    states = np.zeros_like(count)
    states[0] = survivors
    active = 0
    for step in range(1, size):
        bit = step & -step  # the bit in which neighbouring Gray codes differ
        active ^= bit
        hit = (np.arange(size) & bit) != 0
        before = failing == 0
        failing[hit] += 1 if active & bit else -1
        after = failing == 0
        survivors = survivors - count[before & ~after].sum(axis=0) + count[~before & after].sum(axis=0)
        states[active] = survivors
    return states


def order_figures(states: np.ndarray, filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Orders (as strings), and per order and step the figures, from the survivors of all subsets.

    ``states``: subset, figure (all, good, toxic), part.  The result has order, step, figure, part.
    """
    k = len(filters)
    every = (1 << k) - 1
    total = states[:, 0]
    shapley = []
    for f in range(k):
        others = [s for s in range(every + 1) if not s >> f & 1]
        shapley.append(sum(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * (total[s] - total[s | 1 << f]) for s in others))
    orders, out = [], []
    for order in permutations(range(k)):
        orders.append("".join(filters[f] for f in order))
        active, steps = 0, []
        for f in order:
            then = active | 1 << f
            removed = states[active] - states[then]
            fails = total[0] - total[1 << f]
            steps.append(np.stack([total[then], removed[0], fails - removed[0], total[every ^ 1 << f] - total[every], removed[1], removed[2], shapley[f]]))
            active = then
        out.append(np.stack(steps))
    return orders, np.stack(out)


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, ...): the figures of every step of every order, per part.

    ``masks`` has part, mask (bit i: fails ``filters[i]``), good and toxic (0 or
    1), a row per document.  All orders of the filters are listed, zeros
    included; a part without documents does not occur, so an empty table gives
    an empty result.  A task holds the cells of a batch of parts, never documents.
    """
    ship(masks.sparkSession)
    k = len(filters)

    def walk(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                n = b.num_rows
                count = np.stack([b.column(c).flatten().to_numpy().reshape(n, 1 << k).T for c in ("n", "good", "toxic")], axis=1)
                orders, figures = order_figures(gray_walk(count), filters)
                rows = len(orders) * k
                names = {"part": b.column("part").take(pa.array(np.repeat(np.arange(n), rows))),
                         "filter_order": pa.array(np.tile(np.repeat(orders, k), n).tolist(), pa.string()),
                         "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * len(orders)))}
                for j, name in enumerate(FIGURES):
                    names[name] = pa.array(np.ascontiguousarray(figures[:, :, j].reshape(rows, n).T).ravel())
                yield pa.RecordBatch.from_pydict(names)

    return cells(masks, k).mapInArrow(walk, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))


def audit_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``audit`` of the five filters A to E over ``docs``, by ``part`` (null: empty string).

    A: under 200 words. B: under half of the words are distinct. C: over 2 % of
    the code points are ``[A-Z]``. D: holds any ``[#$%&*|]``. E: some smaller id has the
    identical text, wherever that row stands and whether or not another filter
    removes it.  A null text is empty.  A null id is larger than any other and
    has no labels; rows with one id are no copies of each other.  Repeated rows
    count each.  Other columns are not read.
    """
    return audit(judged(docs, labels, doc_id, text, part))
