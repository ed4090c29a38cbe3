"""Substring deduplication of bytes by interval expansion on a Burrows-Wheeler transform.

1. Every window of 100 bytes picks the smallest hash of its 24-byte grams;
   neighbouring windows with one pick form a run.  Spark counts the runs of each
   pick; windows whose pick stands once in the corpus can't repeat.
2. Content-defined blocks of candidate windows are compared whole: a block that
   stands earlier settles all its windows.
3. The other candidate runs are sent, as bytes, to the shard of their pick, so
   equal windows meet.  A shard sorts its suffixes (by rank doubling, a little
   deeper than the minimum length), takes the Burrows-Wheeler transform, and
   extends intervals backwards breadth first: an interval of strings of length l
   that ends at an unset place sets the common prefix there to l.  Lengths only
   grow, so the expansion stops at the minimum length, and the places still
   unset separate no windows: what lies between set places is one repeated
   string.  All but its earliest window go.

Picks that stand very often would gather too much in one shard; their windows
are compared by hash through an aggregation instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import (BYTE_VALUES, Substrings, covered, doc_key, key_filter, discard, keyed, lookup_of, may_hold, release, runs, ship, sized, spans_of, stored,
                                 stretches, text_slices, with_spans)

MINIMUM = 100
GRAM = 40
#: A block ends before a gram whose hash has these many low bits zero.
BLOCK_BITS = 8
#: Bytes of runs a shard should hold, on average.
SHARD_BYTES = 2 << 20
#: Picks with more runs than this are compared by window hash.
OFTEN = 20_000
#: Symbols sorted and expanded at a time, few enough for a processor's cache; a shard is worked off by groups of picks.
PIECE = 128 << 10


class Bytes:
    """A slice of texts as bytes: window starts, the pick of each, and the runs of windows with one pick."""

    def __init__(self, text: pa.Array, width: int = MINIMUM, gram: int = GRAM):
        data = pc.fill_null(text, "").cast(pa.large_binary())
        size = np.asarray(pc.binary_length(data)).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        raw = b"".join(data.to_pylist())
        self.raw = raw
        value = np.frombuffer(raw, np.uint8)
        self.sub = Substrings(BYTE_VALUES[value])
        n = len(value)
        self.doc = np.repeat(np.arange(len(size)).astype(np.int32), size)
        last = np.repeat(self.offsets[1:], size)
        self.is_start = np.arange(n) + width <= last
        self.gram = gram
        self.hash = self.sub.every(gram)
        room = width - gram + 1  # grams of a window
        low = _sliding_min(self.hash, room)
        starts = np.flatnonzero(self.is_start[:len(low)])
        pick = low[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1) | (self.doc[starts[1:]] != self.doc[starts[:-1]])
        at = np.flatnonzero(new)
        to = np.append(at[1:], len(starts)) - 1 if len(at) else at
        self.first, self.last, self.pick = starts[at], starts[to], pick[at]  # run: windows first .. last
        self.width, self.room = width, room

    def twice(self, runs_: np.ndarray | None = None) -> np.ndarray:
        """Runs (all, or those numbered) in which the picked gram stands at two places at least."""
        first, last, pick = (x if runs_ is None else x[runs_] for x in (self.first, self.last, self.pick))
        out = np.zeros(len(first), bool)
        for s in range(0, len(first), 1 << 14):
            f, l, p = first[s:s + (1 << 14)], last[s:s + (1 << 14)], pick[s:s + (1 << 14)]
            span = np.arange(self.room)
            early = np.argmax(self.hash[f[:, None] + span] == p[:, None], axis=1) + f
            late = l + self.room - 1 - np.argmax(self.hash[(l + self.room - 1)[:, None] - span] == p[:, None], axis=1)
            out[s:s + (1 << 14)] = early != late
        return out

    def candidates(self, bitmap: np.ndarray) -> np.ndarray:
        """By byte: whether a window starts there whose pick may repeat."""
        ok = may_hold(bitmap, self.pick)
        edge = np.zeros(len(self.doc) + 1, np.int32)
        edge[self.first[ok]] += 1
        edge[self.last[ok] + 1] -= 1
        return np.cumsum(edge)[:-1] > 0

    def blocks(self, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, end, hash) of content-defined blocks, cut to the document's windows, that hold candidates only."""
        n = len(self.doc)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        cut = np.zeros(n, bool)
        cut[:len(self.hash)] = (self.hash & np.uint64((1 << BLOCK_BITS) - 1)) == 0
        cut[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        a = np.flatnonzero(cut)
        e = np.append(a[1:], n)
        e = np.minimum(e, np.maximum(self.offsets[1:][self.doc[a]] - self.width + 1, a))
        upto = np.concatenate([[0], np.cumsum(candidate)])
        ok = (e > a) & (upto[e] - upto[a] == e - a)
        a, e = a[ok], e[ok]
        return a, e, self.sub.of(a, e + self.width - 1)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (block-wise prefix and suffix minima)."""
    n = len(v) - width + 1
    if n <= 0:
        return np.zeros(0, v.dtype)
    pad = (-len(v)) % width
    full = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    pre = np.minimum.accumulate(full, axis=1).ravel()
    suf = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[:n], pre[width - 1:width - 1 + n])


#: Symbols that one sort key holds (9 bits each), and symbols up to which the places that differ are taken from the sorting rounds.
_PACKED, BEGIN = 7, 28


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``key`` and where a new value begins in it."""
    order = np.argsort(key)
    s = key[order]
    new = np.ones(len(key), bool)
    new[1:] = s[1:] != s[:-1]
    return order, new


def _order(text: np.ndarray, depth: int, begin: int = BEGIN) -> tuple[np.ndarray, np.ndarray, int]:
    """Rotations of ``text`` (values under 512) sorted by their first ``depth`` symbols at least, where the first d of them differ, and d.

    Rank doubling; after each round only the places whose rank is still shared
    are sorted again.  d is the last length of the rounds up to ``begin`` symbols.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    for j in range(min(_PACKED, depth)):
        key = (key << 9) | np.roll(text, -j)
    order, new = _sorted(key)
    first = new.copy()
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # place of the first of its equals
    have = known = min(_PACKED, depth)
    while have < depth:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        own = order[at]
        head = rank[own]
        follow = rank[(own + have) % n]
        part, fresh = _sorted(head * (n + 1) + follow)
        order[at] = own[part]  # places of one rank are next to each other, so the shared places keep their range
        new[at] = fresh
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        have *= 2
        if have <= min(begin, depth):
            first, known = new.copy(), have
    return order, first, known


def equal_windows(text: np.ndarray, minimum: int) -> np.ndarray:
    """A class number per rotation of ``text``: equal for those that share their first ``minimum`` symbols.

    The breadth-first expansion works on all intervals of one length at once and
    begins with those of the strings that the first sorting rounds tell apart:
    the sorting has them at hand, and below that length nearly every place is set.
    """
    n = len(text)
    order, first, begin = _order(text, minimum)
    bwt = text[order - 1]
    by_char = np.argsort(bwt.astype(np.int16), kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_char] = np.arange(n)
    is_set = np.ones(n + 1, bool)  # a common prefix below the length reached is known between place - 1 and place
    is_set[:n] = first
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], n)
    for _ in range(begin, minimum):
        size = hi - lo
        total = int(size.sum())
        own = np.repeat(np.arange(len(lo)), size)
        member = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        to = lf[member]
        # members of one interval and character stand side by side in ``to``
        at = np.argsort(to)
        to, own, char = to[at], own[at], bwt[member[at]]
        new = np.ones(total, bool)
        new[1:] = (own[1:] != own[:-1]) | (char[1:] != char[:-1])
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], total) - 1
        nlo, nhi = to[lead], to[last] + 1
        fresh = ~is_set[nhi]
        is_set[nhi[fresh]] = True
        lo, hi = nlo[fresh], nhi[fresh]
        if not len(lo):
            break
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(is_set[:n])
    return out


def _shard(doc, mark, pos, data, minimum):
    """Later windows of a shard's runs: (run, place in run) flags, flat over the runs' windows."""
    size = np.array([len(x) for x in data], np.int64)
    text = np.zeros(int(size.sum()) + len(data), np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    inside = np.ones(len(text), bool)
    inside[start + size] = False
    text[inside] = np.frombuffer(b"".join(data), np.uint8).astype(np.int64) + 1
    cls = equal_windows(text, minimum)
    count = size - minimum + 1
    run = np.repeat(np.arange(len(data)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    c, p = cls[start[run] + place], pos[run] + place
    where = np.unique(doc, return_inverse=True)[1][run] * (int(p.max()) + 1) + p  # orders places of all documents
    low = np.full(len(text) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, c, where)
    later = where > low[c]
    return run, p, later


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", minimum: int = MINIMUM) -> DataFrame:
    """(doc, mark, spans): stretches [start, end) of window starts (byte positions) that repeat an earlier window."""
    spark = docs.sparkSession
    ship(spark)
    src = keyed(docs, doc_id, text)

    def pick(batches):
        for batch in batches:
            for b in text_slices(batch, "text"):
                x = Bytes(b.column("text"), minimum)
                key, n = np.unique(x.pick, return_inverse=True)
                n = np.bincount(n, weights=1 + x.twice(), minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    counts = src.select("text").mapInArrow(pick, "key long, n long")
    shared = stored(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "bwt-keys")
    release(spark)
    passing = spark.sparkContext.broadcast(key_filter(shared, "key"))
    hot = spark.sparkContext.broadcast(lookup_of(shared.where(F.col("n") > OFTEN), "key"))

    def whole(batches):
        bitmap = passing.value
        for batch in batches:
            for b in text_slices(batch, "text"):
                x = Bytes(b.column("text"), minimum)
                a, e, key = x.blocks(x.candidates(bitmap))
                d = x.doc[a]
                ids, marks = (np.asarray(b.column(c))[d] for c in ("doc", "mark"))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(marks), pa.array(a - x.offsets[d]), pa.array(e - x.offsets[d])],
                                                 names=["block", "doc", "mark", "start", "end"])

    blocks = stored(src.mapInArrow(whole, "block long, doc long, mark long, start long, end long"), "bwt-blocks")
    place = F.struct("doc", "start")
    first = blocks.groupBy("block").agg(F.min(place).alias("low"), F.max(place).alias("top")).where("low < top").select("block", "low")
    settled = stored(stretches(blocks.join(first.hint("merge"), "block").where("low < struct(doc, start)").select("doc", "mark", "start", "end")), "bwt-settled")
    discard(blocks)
    release(spark)

    def rest(batches):
        bitmap, often = passing.value, hot.value
        for batch in batches:
            for b in text_slices(batch, "text"):
                x = Bytes(b.column("text"), minimum)
                ids, marks = np.asarray(b.column("doc")), np.asarray(b.column("mark"))
                open_ = x.candidates(bitmap)
                row, s, e = spans_of(b.column("settled"))
                done = covered(len(x.doc), x.offsets[row] + s, x.offsets[row] + e)
                # open windows by run
                todo = open_ & ~done
                number = np.zeros(len(x.doc), np.int64)
                ok = may_hold(bitmap, x.pick)
                f, l, p = x.first[ok], x.last[ok], x.pick[ok]
                number[f] = 1
                number = np.cumsum(number)
                s, t = _stretches(todo, number)
                if not len(s):
                    continue
                double = x.twice(np.flatnonzero(ok)[number[s] - 1])
                p = p[number[s] - 1].view(np.int64)
                d = x.doc[s]
                frequent = often.find(p) >= 0
                i = np.flatnonzero(~frequent)
                if len(i):
                    data = [x.raw[u:v + minimum - 1] for u, v in zip(s[i].tolist(), t[i].tolist())]
                    yield _rows(ids[d[i]], marks[d[i]], (s - x.offsets[d])[i], (t - x.offsets[d])[i], p[i], data, double[i])
                i = np.flatnonzero(frequent)
                if len(i):
                    n = (t - s)[i]
                    w = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s[i], n)
                    d = x.doc[w]
                    yield _rows(ids[d], marks[d], w - x.offsets[d], w - x.offsets[d] + 1, x.sub.of(w, w + minimum).view(np.int64), None)

    rows = stored(with_spans(src, settled, "settled").mapInArrow(rest, "doc long, mark long, start long, end long, key long, data binary, twice boolean"), "bwt-rows")
    passing.destroy()
    hot.destroy()
    spans = settled
    windows = rows.where("data is null")
    low = windows.groupBy("key").agg(F.min(F.struct("doc", "start")).alias("low"), F.max(F.struct("doc", "start")).alias("top")).where("low < top")
    spans = spans.unionByName(windows.join(low.hint("merge"), "key").where("low < struct(doc, start)").select("doc", "mark", "start", "end"))

    segments = rows.where("data is not null").select("doc", "mark", "start", "key", "data", "twice")
    total = segments.agg(F.sum(F.length("data"))).first()[0] or 0

    def expand(batches):
        held = []
        for batch in batches:
            held.append(batch)
        if not held or not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held)
        # a run that is alone with its pick, which stands in it once, repeats nothing
        _, group, many = np.unique(np.asarray(t.column("key").combine_chunks()), return_inverse=True, return_counts=True)
        t = t.filter(pa.array((many[group] > 1) | np.asarray(t.column("twice").combine_chunks())))
        if not t.num_rows:
            return
        doc, mark, pos, key = (np.asarray(t.column(c).combine_chunks()) for c in ("doc", "mark", "start", "key"))
        size = np.asarray(pc.binary_length(t.column("data").combine_chunks())).astype(np.int64)
        order = np.argsort(key, kind="stable")
        upto = np.cumsum(size[order])
        cut = np.flatnonzero(key[order][1:] != key[order][:-1]) + 1  # pieces end between picks
        piece, begin = [], 0
        for c in cut.tolist():
            if upto[c - 1] - (upto[begin - 1] if begin else 0) > PIECE:
                piece.append((begin, c))
                begin = c
        piece.append((begin, len(order)))
        for u, v in piece:
            i = order[u:v]
            data = t.column("data").take(pa.array(i)).to_pylist()
            run, at, later = _shard(doc[i], mark[i], pos[i], data, minimum)
            s, e = _stretches(later, run)
            if len(s):
                r = i[run[s]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(mark[r]), pa.array(at[s]), pa.array(at[e - 1] + 1)], names=["doc", "mark", "start", "end"])

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    spans = spans.unionByName(segments.repartition(int(shards), "key").mapInArrow(expand, "doc long, mark long, start long, end long"))
    spans = stored(stretches(spans).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "bwt-spans")
    discard(rows)
    release(spark)
    return spans


def _stretches(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True inside one value of ``group``."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(mask), bool)
    change[1:] = group[1:] != group[:-1]
    first = mask.copy()
    first[1:] &= ~mask[:-1] | change[1:]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | change[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _rows(doc, mark, start, end, key, data, twice=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(mark), pa.array(np.asarray(start, np.int64)), pa.array(np.asarray(end, np.int64)),
                                       pa.nulls(n, pa.int64()) if key is None else pa.array(key), pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary()), pa.nulls(n, pa.bool_()) if twice is None else pa.array(twice)],
                                      names=["doc", "mark", "start", "end", "key", "data", "twice"])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", minimum: int = MINIMUM) -> DataFrame:
    """Columns of ``docs`` without the text, plus n_bytes, n_removed, n_spans and kept (the remaining bytes).

    A byte goes if a string of ``minimum`` bytes that covers it also starts
    earlier (in a document with a smaller id, or earlier in the same document);
    all judged on the input.  Null and empty texts have no bytes; shorter texts
    lose none.  Ids are whole numbers, a null id is larger than any other.  Rows
    with one id are one document: the same place in two of them is no repeat.
    Columns of ``docs`` named like the results are replaced.  An empty table
    gives an empty result.
    """
    spans = repeated(docs, doc_id, text, minimum)
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    rest = [c for c in docs.columns if c != text and c not in names]
    src = docs.select(*rest, doc_key(doc_id).alias("doc__"), F.xxhash64(text).alias("mark__"), F.col(text).alias("text__"))
    spans = spans.select(F.col("doc").alias("s_doc__"), F.col("mark").alias("s_mark__"), F.col("spans").alias("spans__"))
    marked = src.join(sized(spans), (F.col("doc__") == F.col("s_doc__")) & (F.col("mark__") == F.col("s_mark__")), "left").select(*rest, "text__", "spans__")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*rest).schema.fields)
    schema = ", ".join(x for x in (fields, "n_bytes long, n_removed long, n_spans long, kept binary") if x)

    def cut(batches):
        for batch in batches:
            for b in text_slices(batch, "text__"):
                raw = pc.fill_null(b.column("text__"), "").cast(pa.large_binary()).to_pylist()
                n, lost, pieces, kept = [], [], [], []
                for x, spans_ in zip(raw, b.column("spans__")):
                    n.append(len(x))
                    if not spans_.is_valid:
                        lost.append(0)
                        pieces.append(0)
                        kept.append(x)
                        continue
                    v = spans_.values
                    s, e = np.asarray(v.field("start")), np.asarray(v.field("end")) - 1 + minimum
                    edge = np.zeros(len(x) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    lost.append(int(gone.sum()))
                    pieces.append(len(runs(gone)[0]))
                    kept.append(np.frombuffer(x, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(rest))], pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(pieces, pa.int64()), pa.array(kept, pa.binary())],
                                                 names=[*rest, *names])

    return marked.mapInArrow(cut, schema)
