"""Substring deduplication by recompression.

Words are named by 64-bit hashes.  A round names runs of equal symbols, then
pairs of a left and a right symbol (sides are a hash bit of the symbol and the
round); a name is a hash of what it stands for, so all tasks name equal things
equally without talking to each other.  Every symbol also carries its reach: the
stretch of words that decides that it is there.  Where two documents share a
stretch of words, they share every symbol whose reach lies inside it.

1. A symbol whose reach lies close around its first word marks the ``KEY`` words
   from there.  Every window of 13 words picks, of the marked stretches inside
   it, the one with the smallest hash (of all its stretches if none is marked);
   Spark counts in how many documents each picked stretch stands.  Only windows
   whose pick stands in two or more documents can repeat.
2. Stretches of such windows are compared by the symbols of a high round, each
   with the 12 words after it: a shared one with an earlier first document
   settles all its windows at once.
3. The remaining windows are compared one by one: earliest document per window
   by aggregation, joined back.

Windows are compared by 64-bit hashes of all 13 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import (Substrings, covered, discard, doc_key, key_filter, keyed, may_hold, mix, release, ship, sized, spans_of, split_words, stored,
                                 stretches, text_slices, with_spans, word_hashes)

WINDOW = 13
#: Words to a marked stretch, and words before it that the marking symbol's reach may take in.
KEY, BEFORE = 6, 2
#: Rounds whose reaches lie that close, and rounds until a symbol spans about ten words.
LOW_ROUNDS, HIGH_ROUNDS = 1, 4
_NONE = np.uint64((1 << 64) - 1)
_RUN, _SIDE, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Symbols:
    """Symbols of one round: name, words [start, end), reach [lo, hi) and document of each."""

    def __init__(self, name, start, end, lo, hi, doc, first, last):
        self.name, self.start, self.end, self.lo, self.hi, self.doc = name, start, end, lo, hi, doc
        self.first, self.last = first, last  # by document: its first word and the end of its last

    @classmethod
    def words(cls, h: np.ndarray, offsets: np.ndarray) -> "Symbols":
        at = np.arange(len(h))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        return cls(h, at, at + 1, at, at + 1, doc, offsets[:-1], offsets[1:])

    def _before(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """``value`` of the symbol before each of ``at``; at a document's start a word outside it."""
        prev = np.maximum(at - 1, 0)
        same = (at > 0) & (self.doc[prev] == self.doc[np.minimum(at, len(self.doc) - 1)])
        return np.where(same, value[prev], self.first[self.doc[at]] - 1)

    def _after(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        nxt = np.minimum(at + 1, len(self.doc) - 1)
        same = (at + 1 < len(self.doc)) & (self.doc[nxt] == self.doc[at])
        return np.where(same, value[nxt], self.last[self.doc[at]] + 1)

    def round(self, number: int) -> "Symbols":
        return self._name_runs()._name_pairs(number) if len(self.name) else self

    def _name_runs(self) -> "Symbols":
        n = len(self.name)
        new = np.ones(n, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(new)
        to = np.append(at[1:], n) - 1
        count = (to - at + 1).astype(np.uint64)
        name = np.where(count > 1, mix(self.name[at] + count * _RUN), self.name[at])
        return Symbols(name, self.start[at], self.end[to], self._before(at, self.lo), self._after(to, self.hi), self.doc[at], self.first, self.last)

    def _name_pairs(self, number: int) -> "Symbols":
        n = len(self.name)
        left = (mix(self.name + np.uint64(number * int(_SIDE) % (1 << 64))) & np.uint64(1)) == 0
        pair = np.zeros(n, bool)
        pair[:-1] = left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])
        second = np.zeros(n, bool)
        second[1:] = pair[:-1]
        every = np.arange(n)
        to = np.minimum(every + 1, n - 1)
        name = np.where(pair, mix(self.name * _PAIR + self.name[to]), self.name)
        end = np.where(pair, self.end[to], self.end)
        # a lone left symbol depends on what follows, a lone right one on what stands before
        hi = np.where(pair, self.hi[to], np.where(left, self._after(every, self.hi), self.hi))
        lo = np.where(left, self.lo, self._before(every, self.lo))
        keep = ~second
        return Symbols(name[keep], self.start[keep], end[keep], lo[keep], hi[keep], self.doc[keep], self.first, self.last)


class Parsed:
    """A slice of texts: word hashes, the low rounds, and the window starts with the key each window picks."""

    def __init__(self, text: pa.Array, width: int = WINDOW):
        self.words, self.offsets = split_words(text)
        self.h = word_hashes(self.words)
        self.sub = Substrings(self.h)
        self.word_doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        self.symbols = Symbols.words(self.h, self.offsets)
        for r in range(1, LOW_ROUNDS + 1):
            self.symbols = self.symbols.round(r)
        n = len(self.h)
        last = self.offsets[1:][self.word_doc]
        self.starts = np.flatnonzero(np.arange(n) + width <= last)
        self.doc = self.word_doc[self.starts]
        at = np.arange(max(n - KEY + 1, 0))
        stretch = np.full(n, _NONE)
        stretch[:len(at)] = self.sub.of(at, at + KEY)
        s = self.symbols
        near = (s.lo >= s.start - BEFORE) & (s.hi <= s.start + KEY)
        marked = np.full(n, _NONE)
        marked[s.start[near]] = stretch[s.start[near]]
        self.key = self._least(marked, BEFORE, width - KEY)
        none = self.key == _NONE
        if none.any():
            self.key[none] = self._least(stretch, 0, width - KEY)[none]

    def _least(self, value: np.ndarray, first: int, last: int) -> np.ndarray:
        """Smallest value at the places start + first .. start + last of every window."""
        n = len(value) - last
        low = value[first:first + n].copy() if n > 0 else np.zeros(0, np.uint64)
        for k in range(first + 1, last + 1):
            np.minimum(low, value[k:k + n], out=low)
        return low[self.starts]

    def high(self) -> Symbols:
        s = self.symbols
        for r in range(LOW_ROUNDS + 1, HIGH_ROUNDS + 1):
            s = s.round(r)
        return s

    def blocks(self, candidate: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, end, hash, document) of the high symbols all of whose windows are candidates."""
        s = self.high()
        flag = np.zeros(len(self.h) + 1, np.int64)
        flag[self.starts[candidate]] = 1
        upto = np.concatenate([[0], np.cumsum(flag)])
        limit = np.maximum(s.last[s.doc] - width + 1, s.first[s.doc]) if len(s.doc) else s.end
        end = np.minimum(s.end, limit)
        full = (end > s.start) & (upto[np.maximum(end, s.start)] - upto[s.start] == end - s.start)
        a, e = s.start[full], end[full]
        return a, e, self.sub.of(a, e + width - 1), s.doc[full]


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc, mark, spans): stretches [start, end) of window starts that repeat an earlier document, per document and text."""
    spark = docs.sparkSession
    ship(spark)
    src = keyed(docs, doc_id, text)

    def pick(batches):
        for batch in batches:
            for b in text_slices(batch, "text"):
                p = Parsed(b.column("text"), width)
                change = np.ones(len(p.key), bool)
                change[1:] = (p.key[1:] != p.key[:-1]) | (p.doc[1:] != p.doc[:-1])
                key, doc = p.key[change], p.doc[change].astype(np.uint64)
                once = np.unique(mix(key + doc * _RUN), return_index=True)[1]  # a key once per document
                key, n = np.unique(key[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], names=["key", "n"])

    counts = src.select("text").mapInArrow(pick, "key long, n int")
    shared = stored(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "recompress-keys")
    release(spark)
    passing = spark.sparkContext.broadcast(key_filter(shared, "key"))

    def high(batches):
        bitmap = passing.value
        for batch in batches:
            for b in text_slices(batch, "text"):
                p = Parsed(b.column("text"), width)
                a, e, block, doc = p.blocks(may_hold(bitmap, p.key), width)
                ids, marks = (np.asarray(b.column(c))[doc] for c in ("doc", "mark"))
                yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(ids), pa.array(marks), pa.array((a - p.offsets[doc]).astype(np.int32)),
                                                  pa.array((e - p.offsets[doc]).astype(np.int32))], names=["block", "doc", "mark", "start", "end"])

    blocks = stored(src.mapInArrow(high, "block long, doc long, mark long, start int, end int"), "recompress-blocks")
    first = blocks.groupBy("block").agg(F.min("doc").alias("low"), F.max("doc").alias("top")).where("low < top").select("block", "low")
    settled = stored(stretches(blocks.join(first.hint("merge"), "block").where("low < doc").select("doc", "mark", "start", "end")), "recompress-settled")
    discard(blocks)
    release(spark)

    def single(batches):
        bitmap = passing.value
        for batch in batches:
            for b in text_slices(batch, "text"):
                p = Parsed(b.column("text"), width)
                candidate = may_hold(bitmap, p.key)
                ids, marks = np.asarray(b.column("doc")), np.asarray(b.column("mark"))
                row, s, e = spans_of(b.column("settled"))
                done = covered(len(p.h), p.offsets[row] + s, p.offsets[row] + e)
                w = p.starts[candidate & ~done[p.starts]]
                wd = p.word_doc[w]
                at = (w - p.offsets[wd]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[wd]), pa.array(marks[wd]), pa.array(at), pa.array(at + np.int32(1)), pa.array(p.sub.of(w, w + width).view(np.int64))],
                                                 names=["doc", "mark", "start", "end", "key"])

    windows = stored(with_spans(src, settled, "settled").mapInArrow(single, "doc long, mark long, start int, end int, key long"), "recompress-rows")
    passing.destroy()
    low = windows.select("key", "doc").groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("top")).where("low < top").select("key", "low")
    later = windows.join(low.hint("merge"), "key").where("low < doc").select("doc", "mark", "start", "end")
    spans = stretches(settled.unionByName(later))
    spans = stored(spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "recompress-spans")
    discard(windows)
    release(spark)
    return spans


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Columns of ``docs`` without the text, plus n_words, n_removed and kept (the words that stay, joined by one space).

    A word goes if it lies in a window of ``width`` words that also starts in a
    document with a smaller id; all judged on the input.  Null and empty texts
    have no words; texts under ``width`` words lose none.  Ids are whole numbers,
    a null id is larger than any other.  Rows with one id are no copies of each
    other.  Columns of ``docs`` named like the results are replaced.  An empty
    table gives an empty result.
    """
    spans = repeated(docs, doc_id, text, width)
    names = ["n_words", "n_removed", "kept"]
    rest = [c for c in docs.columns if c != text and c not in names]
    src = docs.select(*rest, doc_key(doc_id).alias("doc__"), F.xxhash64(text).alias("mark__"), F.col(text).alias("text__"))
    spans = spans.select(F.col("doc").alias("s_doc__"), F.col("mark").alias("s_mark__"), F.col("spans").alias("spans__"))
    marked = src.join(sized(spans), (F.col("doc__") == F.col("s_doc__")) & (F.col("mark__") == F.col("s_mark__")), "left").select(*rest, "text__", "spans__")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*rest).schema.fields)
    schema = ", ".join(x for x in (fields, "n_words long, n_removed long, kept string") if x)

    def cut(batches):
        for batch in batches:
            for b in text_slices(batch, "text__"):
                words, offsets = split_words(b.column("text__"))
                gone = np.zeros(len(words) + 1, np.int64)
                for i, spans_ in enumerate(b.column("spans__")):
                    if spans_.is_valid:
                        v = spans_.values
                        s, e = np.asarray(v.field("start")), np.asarray(v.field("end"))
                        np.add.at(gone, offsets[i] + s, 1)
                        np.add.at(gone, np.minimum(offsets[i] + e - 1 + width, offsets[i + 1]), -1)
                gone = np.cumsum(gone)[:-1] > 0
                left = words.filter(pa.array(~gone))
                row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                lost = np.bincount(row[gone], minlength=b.num_rows).astype(np.int64)
                n = np.diff(offsets)
                ends = np.concatenate([[0], np.cumsum(n - lost)]).astype(np.int32)
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), left.cast(pa.string())), " ")
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(rest))], pa.array(n), pa.array(lost), kept.cast(pa.string())], names=[*rest, *names])

    return marked.mapInArrow(cut, schema)
