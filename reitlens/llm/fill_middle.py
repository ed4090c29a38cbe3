"""Fill-in-the-middle transformation over a Roaring-style set of token boundaries.

A text's tokens end at increasing byte offsets.  The offsets form a boundary
set: the high bits choose a container, which holds the low 16 bits as a sorted
array, as a bitmap, or as runs, whichever is smallest.  Containers carry the
cardinality of all before them, so the end of the c-th token is one search for
the container and one select inside it, and both cut offsets come from there.

Everything random is read off a hash of the document's id, so reruns and
retried tasks agree and no row depends on another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import ship, text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Share of texts that are transformed, and of these the share in suffix-prefix-middle form, in percent.
RATE, SPM_RATE, SEED = 50, 80, 42
#: A container spans this many offsets; an array holds this many at most, beyond it a bitmap is smaller.
SPAN_BITS, ARRAY_MOST = 16, 4096
_SPAN = 1 << SPAN_BITS
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class ArrayContainer:
    """Sorted low bits, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class BitmapContainer:
    """One bit per offset, 8 KB, and the cardinality before each 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(_SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, rank: int) -> int:
        word = int(np.searchsorted(self.before, rank, side="right")) - 1
        left = int(self.words[word])
        for _ in range(rank - int(self.before[word])):
            left &= left - 1  # clears the lowest set bit
        return word * 64 + (left & -left).bit_length() - 1


class RunContainer:
    """Starts of runs of neighbouring offsets, and the cardinality before each run."""

    def __init__(self, start: np.ndarray, length: np.ndarray):
        self.start = start.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.start[run]) + rank - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for sorted low bits: 4 bytes a run, 2 an array entry, 8 KB a bitmap."""
    new = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(new) < min(2 * len(low), _SPAN // 8):
        return RunContainer(low[new], np.diff(np.append(new, len(low))))
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """Sorted distinct offsets in containers by their high bits, with cumulative cardinalities."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> SPAN_BITS
        at = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[at]
        self.before = np.append(at, len(offsets))
        self.containers = [container(offsets[a:b] & (_SPAN - 1)) for a, b in zip(self.before[:-1], self.before[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        """The offset with ``rank`` smaller ones."""
        k = int(np.searchsorted(self.before, rank, side="right")) - 1
        return (int(self.high[k]) << SPAN_BITS) + self.containers[k].select(rank - int(self.before[k]))

    def cut(self, tokens: int) -> int:
        """The offset behind the first ``tokens`` tokens."""
        return self.select(tokens - 1) if tokens else 0


def token_ends(raw: bytes) -> np.ndarray:
    """Byte offsets behind the tokens: every word with the white space before it, and white space at the end by itself."""
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    last = ~blank
    last[:-1] &= blank[1:]
    ends = np.flatnonzero(last) + 1
    return np.append(ends, len(raw)) if len(raw) and blank[-1] else ends


def draws(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers: the first 8-digit groups of the hex SHA-256 of ``seed:doc_id`` (a null id: of ``seed:``)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def code_points(raw: bytes) -> int:
    return len(raw.translate(None, _INNER))


#: Bytes of UTF-8 that continue a code point.
_INNER = bytes(range(0x80, 0xC0))


def rearranged(raw: bytes, doc_id, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output) of one text."""
    known = BoundarySet(token_ends(raw))
    n = len(known)
    h1, h2, h3, h4 = draws(doc_id, seed)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not raw or h3 % 100 >= rate or any(x in raw for x in (p, s, m)):
        return n, "plain", None, None, raw
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = known.cut(a), known.cut(b)
    prefix, middle, suffix = raw[:i], raw[i:j], raw[j:]
    form, out = ("spm", (s, suffix, p, prefix)) if h4 % 100 < spm_rate else ("psm", (p, prefix, s, suffix))
    return n, form, code_points(prefix), code_points(middle), b"".join((*out, m, middle))


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """Columns of ``docs`` without the text, plus n_tokens, form, prefix_chars, middle_chars and output.

    A text is cut behind two token boundaries and written as prefix, suffix,
    middle (psm) or suffix, prefix, middle (spm) with marks between; a share of
    the texts, empty texts and texts that hold a mark themselves stay plain, with
    null lengths.  A null text is empty.  A null id draws as the empty id, rows of
    one id draw alike.  Any id is taken in its decimal (string) form.  Columns of
    ``docs`` named like the results are replaced.  An empty table gives an empty
    result.  One text is held at a time, whatever its length.
    """
    names = ["n_tokens", "form", "prefix_chars", "middle_chars", "output"]
    rest = [c for c in docs.columns if c != text and c not in names]
    src = docs.select(*rest, F.col(doc_id).cast("string").alias("id__"), F.col(text).alias("text__"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*rest).schema.fields)
    schema = ", ".join(x for x in (fields, "n_tokens long, form string, prefix_chars long, middle_chars long, output string") if x)
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for b in text_slices(batch, "text__"):
                raw = pc.fill_null(b.column("text__"), "").cast(pa.large_binary()).to_pylist()
                out = list(zip(*(rearranged(x, i, rate, spm_rate, seed) for x, i in zip(raw, b.column("id__").to_pylist()))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                cols = [pa.array(v, t) for v, t in zip(out, kinds)] + [pa.array(out[4], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(rest))], *cols], names=[*rest, *names])

    return src.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  Marks can't overlap what stands around them, so the first of each is the one set."""
    def parts(first: str, second: str):
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
