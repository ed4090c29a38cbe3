"""SimHash near-duplicates by a binary-trie self-join.

Documents become 64-bit fingerprints; equal fingerprints are one leaf.  The
distinct fingerprints are cut into blocks that agree on a run of bits, one of
budget + 1 runs (two fingerprints within the budget agree on one at least), and
crowded blocks are cut again along the bits that vary in them.  Each block is a binary
trie, joined with itself: pairs of trie nodes are walked together level by
level, the bits in which their paths differ are added up, and a pair over the
budget is dropped.  Surviving pairs of leaves are merged into stars at once
(their links connect the same leaves), so a crowded neighbourhood never turns
into all its pairs outside the walk.  Stars of all blocks are joined into
components by Spark.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import connected, release, row_key, ship, sized, stored, text_slices, without_rows

WORDS = 4
MAX_BITS = 4
#: Fingerprints a block may hold before it is cut along further bits; the higher bound holds from the third cut on, where few bits vary.
CROWDED = 1 << 9
DENSE = 1 << 12
#: Rows a task gathers before it walks their blocks, and node pairs it expands at a time.
HELD = 1 << 16
FRONT = 1 << 17


def fingerprints_of(texts: list[bytes | None], words: int = WORDS) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: majority bits over the XXH64 (seed 42) of its word shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for row, raw in enumerate(texts):
        toks = (raw or b"").lower().split()
        if not toks:
            continue
        joined = b" ".join(toks)
        if len(toks) <= words:
            out[row] = digest(joined, 42)
            continue
        size = np.fromiter(map(len, toks), np.int64, len(toks)) + 1
        stop = np.cumsum(size) - 1
        first = np.concatenate([[0], stop[:-1] + 1])
        lo, hi = first[:len(toks) - words + 1].tolist(), stop[words - 1:].tolist()
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(lo, hi)), np.uint64, len(lo))
        ones = np.zeros(64, np.int64)
        for s in range(0, len(h), 1 << 14):
            bits = np.unpackbits(h[s:s + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(ones * 2 > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the signed 64-bit pattern of each row's fingerprint (null or wordless text: 0)."""
    ship(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in text_slices(batch, "text"):
                col = b.column("text").cast(pa.large_binary()).to_pylist()
                fp = fingerprints_of(col, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def _stars(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` (smallest index per class) after also uniting the pairs a, b."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def walk(x: np.ndarray, starts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the blocks of ``x`` (each sorted and distinct, beginning at ``starts``): a spanning set of pairs at most ``budget`` bits apart.

    A node is a range of a sorted block; a pair of nodes at depth d splits on bit
    d into up to four, and is dropped once its differing bits pass the budget.
    """
    label = np.arange(len(x))
    stops = np.append(starts[1:], len(x))
    roots = np.stack([starts, stops, starts, stops, np.zeros_like(starts)], axis=1)
    stack = [(0, roots[stops - starts > 1])]
    while stack:
        d, front = stack.pop()
        if len(front) > FRONT:
            stack += [(d, front[i:i + FRONT]) for i in range(0, len(front), FRONT)]
            continue
        alo, ahi, blo, bhi, acc = front.T
        # pairs of single leaves are compared at once
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if d == 64:
            leaf[:] = True
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            near = (np.bitwise_count(x[i] ^ x[j]) <= budget) & (i != j)
            label = _stars(len(label), i[near], j[near], label)
            front = front[~leaf]
            if not len(front):
                continue
            alo, ahi, blo, bhi, acc = front.T
        bit = np.uint64(1) << np.uint64(63 - d)
        amid, bmid = _split(x, alo, ahi, bit), _split(x, blo, bhi, bit)
        parts = []
        for al, ah, bl, bh, more in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            ok = (al < ah) & (bl < bh) & (acc + more <= budget) & (al <= bl)  # each unordered pair of nodes once
            if ok.any():
                parts.append(np.stack([al[ok], ah[ok], bl[ok], bh[ok], acc[ok] + more], axis=1))
        if parts:
            stack.append((d + 1, np.concatenate(parts)))
    at = np.flatnonzero(label != np.arange(len(label)))
    return x[label[at]], x[at]


def _split(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First index in each sorted range [lo, hi) whose ``bit`` is set (vectorised bisection)."""
    lo, end = lo.copy(), hi.copy()
    while True:
        open_ = lo < end
        if not open_.any():
            return lo
        mid = (lo + end) >> 1
        set_ = (v[np.minimum(mid, len(v) - 1)] & bit) != 0
        end = np.where(open_ & set_, mid, end)
        lo = np.where(open_ & ~set_, mid + 1, lo)


def _children(mask: int, vary: int, budget: int) -> list[int]:
    """``mask`` with each of budget + 1 runs of the bits ``vary`` added: fingerprints that differ in at most ``budget`` of these bits agree on one of the runs."""
    free = [i for i in range(63, -1, -1) if vary >> i & 1]
    cuts = [len(free) * k // (budget + 1) for k in range(budget + 2)]
    return [_signed(mask | sum(1 << i for i in free[lo:hi])) for lo, hi in zip(cuts, cuts[1:])]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _linked(blocks: DataFrame, budget: int) -> DataFrame:
    """(a, b): links inside the blocks of (mask, value, fp); a task holds a few blocks at a time."""

    def pairs(m: np.ndarray, v: np.ndarray, fp: np.ndarray):
        block = np.concatenate([[0], np.cumsum((m[1:] != m[:-1]) | (v[1:] != v[:-1]))])
        order = np.lexsort((fp, block))
        a, b = walk(fp[order], np.flatnonzero(np.diff(block, prepend=-1)), budget)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        held: list[tuple] = []
        rows = 0
        for batch in batches:
            held.append(tuple(np.asarray(c) for c in batch.columns))
            rows += batch.num_rows
            if rows < HELD:
                continue
            m, v, fp = (np.concatenate(c) for c in zip(*held))
            inner = np.flatnonzero((m[1:] != m[:-1]) | (v[1:] != v[:-1]))
            if len(inner):  # the last block may go on in the next batch
                end = inner[-1] + 1
                yield pairs(m[:end], v[:end], fp[:end].view(np.uint64))
                m, v, fp = m[end:].copy(), v[end:].copy(), fp[end:].copy()
            held, rows = [(m, v, fp)], len(m)
        if rows:
            m, v, fp = (np.concatenate(c) for c in zip(*held))
            yield pairs(m, v, np.ascontiguousarray(fp).view(np.uint64))

    return blocks.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, "a long, b long")


def links(distinct_fp: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs at most ``budget`` bits apart.

    A block is the fingerprints that agree on a mask of bits, one mask per run of
    budget + 1 runs, so every linked pair meets in a block and each fingerprint
    stands in budget + 1 of them at every size.  Blocks over the limit, counted by
    Spark, are cut again in the same way along the bits that vary in them, until
    none is left; a block of n fingerprints has log2(n) such bits at least.
    """
    first = F.explode(F.array(*[F.lit(c).cast("long") for c in _children(0, (1 << 64) - 1, budget)]))
    keyed, level, found = distinct_fp.select(first.alias("mask"), "fp"), 0, []

    def cut(batches):
        for b in batches:
            rows = [(m, v, c) for m, v, x in zip(*(b.column(i).to_pylist() for i in range(3))) for c in _children(m % (1 << 64), x % (1 << 64), budget)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["mask", "value", "child"])

    while True:
        level += 1
        keyed = keyed.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        limit = CROWDED if level <= 2 else DENSE
        count = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("vary"))
        crowded = stored(count.where(F.col("n") > limit).select("mask", "value", "vary"), "simhash-crowded")
        if crowded.isEmpty():
            found.append(_linked(keyed, budget))
            return reduce(DataFrame.unionByName, found)
        found.append(stored(_linked(keyed.join(sized(crowded), ["mask", "value"], "left_anti"), budget), "simhash-part"))
        cuts = sized(stored(crowded.mapInArrow(cut, "mask long, value long, child long"), "simhash-cuts"))
        # different blocks may be cut to the same mask
        keyed = stored(keyed.join(cuts, ["mask", "value"]).select(F.col("child").alias("mask"), "fp").distinct(), "simhash-deeper")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, budget: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): every row's fingerprint and the smallest doc_id reachable over links.

    Null and empty texts have fingerprint 0 and are linked like any other.  A
    null doc_id is larger than any other; a class of null ids only has a null
    component_id.  Repeated rows and equal fingerprints share a class.  An empty
    table gives an empty result.
    """
    fps = stored(fingerprints(docs, doc_id, text, words), "simhash-fp")
    return fps.join(sized(_named(fps, budget)), "fp").select("doc_id", "fp", "component_id")


def _named(fps: DataFrame, budget: int) -> DataFrame:
    """(fp, component, component_id) for the fingerprints of (doc_id, fp): the class, and the smallest id in it."""
    leaves = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-leaves")
    found = stored(links(leaves.select("fp"), budget), "simhash-links")
    comp = stored(connected(found), "simhash-components") if not found.isEmpty() else None
    release(fps.sparkSession)
    if comp is None:
        named = leaves.select("fp", F.col("fp").alias("component"), F.col("first_id").alias("component_id"))
    else:
        in_class = leaves.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left")
        in_class = in_class.select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
        lowest = in_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = in_class.join(lowest, "component").select("fp", "component", "component_id")
    return stored(named, "simhash-named")


def hex_digits(fp):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, budget: int = MAX_BITS) -> DataFrame:
    """One row of each class: that with the smallest id; rows with a null id stay only in classes without any id.

    Where several rows of a class have that id (or none has an id), one of them
    stays (the smallest text, then the smallest other columns).  Rows with one id
    or without an id are told apart by their text.
    """
    rows = docs.select(row_key(doc_id, text).alias("doc_id"), F.col(text).alias("text"))
    fps = stored(fingerprints(rows, words=words).select("doc_id.id", "doc_id.mark", "fp"), "simhash-fp")
    named = _named(fps.select(F.col("id").alias("doc_id"), "fp"), budget)
    cls = stored(fps.join(sized(named), "fp").select("id", "mark", "component", "component_id"), "simhash-rows")
    first = F.col("id").eqNullSafe(F.col("component_id"))
    kept = without_rows(docs, stored(cls.where(~first).select("id", "mark").distinct(), "simhash-gone"), doc_id, text)
    several = stored(cls.where(first).groupBy("component").agg(F.count(F.lit(1)).alias("n__")).where("n__ > 1").select("component"), "simhash-several")
    if several.isEmpty():
        return kept
    again = stored(cls.where(first).join(sized(several), "component", "left_semi").select("id", "mark", "component").distinct(), "simhash-again")
    key = row_key(doc_id, text)
    of = again.select(F.col("id").alias("again_id__"), F.col("mark").alias("again_mark__"), F.col("component").alias("component__"))
    once = kept.join(sized(of), key["id"].eqNullSafe(F.col("again_id__")) & (key["mark"] == F.col("again_mark__")))
    one = once.groupBy("component__").agg(F.min(F.struct(text, *[c for c in docs.columns if c != text])).alias("r__"))
    return without_rows(kept, again, doc_id, text).unionByName(one.select(*[F.col(f"r__.{c}").alias(c) for c in docs.columns]))
