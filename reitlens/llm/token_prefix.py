"""Token counts by prefix dynamic programming over a BPE vocabulary.

For every prefix of a word the last token of its encoding is kept, and a
prefix's count is the count of what stands before that token plus one.  A
candidate token may follow the last token before it only if the vocabulary's
own merges leave the two side by side (checked once per pair of tokens), which
makes the counts those of the merge procedure itself.  The counts of all
prefixes of a text are stored, so that "how many tokens has this cut" and
"which cut fits this budget" are look-ups, without encoding again.

Prefixes are those of the normalised text with white space left out, since
white space is dropped by this kind of vocabulary.
"""

from __future__ import annotations

import gc
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import ship, split_words, text_slices

#: Text bytes handled at a time: the larger a slice, the fewer of its words are looked up again.
SLICE = 4 << 20
#: Distinct words whose counts a worker keeps; the store is emptied when full (it only saves time).
KEPT_WORDS = 800_000


# ---------------------------------------------------------------------------
# FIXED VALUES: the vocabulary file's own settings, for which ``parts_plain`` has short cuts
# ---------------------------------------------------------------------------
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class PrefixCounter:
    """Exact token counts of every prefix of a word for a word-end BPE vocabulary file (JSON text)."""

    def __init__(self, spec: str):
        import ahocorasick
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        model = json.loads(spec)
        self.end = model["model"]["end_of_word_suffix"] or ""
        vocab = model["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = [re.escape(t["content"]) for t in model["added_tokens"]]
        self.special_re = re.compile("|".join(self.special)) if self.special else None
        self.open, self.closed, self.longest = ahocorasick.Automaton(), {}, 1
        self.closed_tokens = set()
        for t in vocab:
            if self.end and t.endswith(self.end) and len(t) > len(self.end):
                self.closed[t[:-len(self.end)]] = t
                self.longest = max(self.longest, len(t) - len(self.end))
                self.closed_tokens.add(t)
            else:
                self.open.add_word(t, (t, len(t)))
        self.open.make_automaton()
        byte_map = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        spare = iter(range(256, 512))
        self.bytes_to_text = {b: b if b in set(byte_map) else next(spare) for b in range(256)}
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # of chunks, which hold no ASCII white space
        self.short_cut = model["normalizer"] == NORMALIZER and model["pre_tokenizer"]["pretokenizers"] == [SPLIT, BYTE_LEVEL]
        self.words: dict[str, bytes | list[int]] = {}
        self.totals: dict[str, int] = {}
        self.chunks: dict[str, tuple[int, int]] = {}
        self.pair = lru_cache(maxsize=1 << 20)(self._side_by_side)
        self.pieces = self._merge

    def _merge(self, parts: tuple[str, ...]) -> tuple[str, ...]:
        out = list(parts)
        while len(out) > 1:
            at, low = -1, None
            for i in range(len(out) - 1):
                r = self.rank.get((out[i], out[i + 1]))
                if r is not None and (low is None or r < low):
                    at, low = i, r
            if low is None:
                break
            a, b, j, new = out[at], out[at + 1], 0, []
            while j < len(out):
                if j + 1 < len(out) and out[j] == a and out[j + 1] == b:
                    new.append(a + b)
                    j += 2
                else:
                    new.append(out[j])
                    j += 1
            out = new
        return tuple(out)

    def _symbols(self, token: str) -> list[str]:
        if token in self.closed_tokens:
            body = list(token[:-len(self.end)])
            body[-1] += self.end
            return body
        return list(token)

    def _side_by_side(self, a: str, b: str) -> bool:
        """Whether the merges leave exactly the tokens a, b of their joined symbols ("" before the first token)."""
        if a == "":
            return self.pieces(tuple(self._symbols(b))) == (b,)
        return self.pieces(tuple(self._symbols(a) + self._symbols(b))) == (a, b)

    def chain(self, text: str) -> tuple[list, list[int]]:
        """Last token and token count of the encoding of every open prefix (the word goes on) of length 0, 1, .. ."""
        n = len(text)
        last, count = [""] + [None] * n, [0] * (n + 1)
        pair = self.pair
        done = -1
        for end, (token, size) in self.open.iter(text):  # for each end the longest match first
            if end == done:
                continue
            before = last[end + 1 - size]
            if before is not None and pair(before, token):
                done = end
                last[end + 1], count[end + 1] = token, count[end + 1 - size] + 1
        return last, count

    def closed_count(self, text: str, i: int, last: list, count: list[int]) -> int:
        """Tokens of the prefix of length ``i`` taken as a whole word."""
        closed = self.closed
        for j in range(max(0, i - self.longest), i):
            token = closed.get(text[j:i])
            if token is not None and last[j] is not None and self.pair(last[j], token):
                return count[j] + 1
        # a symbol outside the vocabulary, or a chain the pair test can't follow
        return len(self.pieces((*text[:i - 1], text[i - 1] + self.end)))

    def word(self, text: str) -> list[int]:
        """Token counts of the prefixes of length 0, 1, .. of a word given in the vocabulary's byte alphabet."""
        last, count = self.chain(text)
        return [0] + [self.closed_count(text, i, last, count) for i in range(1, len(text) + 1)]

    def total(self, text: str) -> int:
        """Token count of the whole word: the last prefix's."""
        got = self.totals.get(text)
        if got is None:
            got = self.closed_count(text, len(text), *self.chain(text))
            if len(self.totals) >= KEPT_WORDS:
                self.totals.clear()
            self.totals[text] = got
        return got

    def parts(self, chunk: str) -> list[tuple[int, str]]:
        """(characters, word in the byte alphabet) of the pre-tokens of a chunk; special strings have an empty word."""
        if self.special_re is not None and "<|" in chunk:
            out, at = [], 0
            for m in self.special_re.finditer(chunk):
                out += self.parts_plain(chunk[at:m.start()])
                out.append((m.end() - m.start(), ""))
                at = m.end()
            return out + self.parts_plain(chunk[at:])
        return self.parts_plain(chunk)

    def parts_plain(self, chunk: str) -> list[tuple[int, str]]:
        if not chunk:
            return []
        if self.short_cut and chunk.isascii():
            return [(len(w), w) for w in self.plain.findall(chunk.lower())]
        if self.short_cut and max(chunk) < "\u0250" and "\u0130" not in chunk and chunk.isalpha():  # Latin letters: one word, composed as it is
            return [(len(chunk), chunk.lower().encode().decode("latin-1").translate(self.bytes_to_text))]
        text = self.tok.normalizer.normalize_str(chunk)
        return [(b - a, w) for w, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, chunk: str) -> tuple[int, int]:
        """Tokens and (normalised) characters of a chunk without white space."""
        got = self.chunks.get(chunk)
        if got is None:
            parts = self.parts(chunk)
            got = sum(self.total(w) if w else 1 for _, w in parts), sum(n for n, _ in parts)
            if len(self.chunks) >= KEPT_WORDS:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def known(self, w: str):
        got = self.words.get(w)
        if got is None:
            got = self.word(w)
            if got[-1] < 256 and max(got) < 256:
                got = bytes(got)
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[w] = got
        return got

    def prefixes(self, chunk: str) -> list[int]:
        """Tokens of the prefixes of length 1, 2, .. characters of the normalised chunk (a special string counts when whole)."""
        out, total = [], 0
        for chars, w in self.parts(chunk):
            if not w:
                out += [total] * (chars - 1) + [total + 1]
                total += 1
                continue
            counts = self.known(w)
            if len(w) == chars:
                out += [total + c for c in counts[1:]]
            else:  # a character of several bytes ends where its last byte does
                ends, k = [], 0
                for c in self.as_text(w):
                    k += len(c.encode())
                    ends.append(k)
                out += [total + counts[e] for e in ends]
            total += counts[-1]
        return out

    def as_text(self, w: str) -> str:
        back = {chr(v): k for k, v in self.bytes_to_text.items()}
        return bytes(back[c] for c in w).decode("utf-8", "replace")


_COUNTERS: dict[int, PrefixCounter] = {}


def _counter(spec: str) -> PrefixCounter:
    key = hash(spec)
    if key not in _COUNTERS:
        _COUNTERS[key] = PrefixCounter(spec)
    return _COUNTERS[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def cut_within(word, upto: np.ndarray, chars: np.ndarray, budget: int, counter: PrefixCounter) -> int:
    """Characters of the longest prefix of a text that is within ``budget`` tokens, from stored prefix counts.

    ``upto[i]`` and ``chars[i]`` are the stored counts of the first i words,
    ``word(i)`` is the i-th word; the prefix ends inside the first word whose
    count is over the budget, or before it.
    """
    whole = int(np.searchsorted(upto, budget, side="right")) - 1
    if whole == len(upto) - 1:
        return int(chars[whole])
    inside = np.asarray(counter.prefixes(word(whole)))
    fits = np.flatnonzero(inside <= budget - int(upto[whole]))
    return int(chars[whole]) + (int(fits[-1]) + 1 if len(fits) else 0)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", store: bool = False, budgets: tuple[int, ...] = ()) -> DataFrame:
    """Columns of ``docs`` without the text, plus n_bytes, n_tokens and, with ``store``, prefix_tokens.

    ``budgets`` adds a column cut_<budget> each: characters of the longest prefix
    whose token count is within that budget, read off the prefix counts.

    ``vocabulary`` is the vocabulary file's JSON text (a few MB, shipped with the
    tasks).  ``prefix_tokens[i]`` is the number of tokens of the first i + 1
    characters of the normalised text without white space.  A null or empty text
    has 0 bytes and tokens and an empty list.  Every row is judged by itself, so
    repeated rows repeat; columns of ``docs`` named like the results are
    replaced.  The whole text is read, in slices of rows.
    """
    names = ["n_bytes", "n_tokens"] + [f"cut_{n}" for n in budgets] + (["prefix_tokens"] if store else [])
    rest = [c for c in docs.columns if c != text and c not in names]
    src = docs.select(*rest, F.col(text).alias("text__"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*rest).schema.fields)
    schema = ", ".join(x for x in (fields, "n_bytes long, n_tokens long" + "".join(f", cut_{n} long" for n in budgets) + (", prefix_tokens array<int>" if store else "")) if x)
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = _counter(spec.value)
        gc.freeze()  # the stores of words hold no cycles; collecting over them takes longer than counting
        gc.disable()
        for batch in batches:
            for b in text_slices(batch, "text__", SLICE):
                col = b.column("text__")
                words, offsets = split_words(col)
                enc = pc.dictionary_encode(words)
                distinct = enc.dictionary.to_pylist()
                both = np.fromiter((n for w in distinct for n in counter.count(w)), np.int64, 2 * len(distinct))
                per_word, sizes = both[::2], both[1::2]
                idx = np.asarray(enc.indices)
                sums = np.concatenate([[0], np.cumsum(per_word[idx])])
                chars = np.concatenate([[0], np.cumsum(sizes[idx])])
                cols = [b.column(i) for i in range(len(rest))]
                cols += [pa.array(np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])]
                for n in budgets:
                    cols.append(pa.array([cut_within(lambda i, s=s: distinct[idx[s + i]], sums[s:e + 1] - sums[s], chars[s:e + 1] - chars[s], n, counter) for s, e in zip(offsets[:-1], offsets[1:])], pa.int64()))
                if store:
                    lists = [counter.prefixes(w) for w in distinct]
                    out = []
                    for s, e in zip(offsets[:-1], offsets[1:]):
                        total, row = 0, []
                        for k in idx[s:e]:
                            row += [total + c for c in lists[k]]
                            total += int(per_word[k])
                        out.append(row)
                    cols.append(pa.array(out, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, *names])

    return src.mapInArrow(run, schema)


def tokens_upto(prefix_tokens, characters):
    """Column: tokens of the first ``characters`` characters, from the stored prefix counts."""
    n = F.least(F.lit(characters), F.size(prefix_tokens))
    return F.when(n > 0, F.element_at(prefix_tokens, n)).otherwise(0)


def longest_within(prefix_tokens, budget: int):
    """Column: characters of the longest prefix whose token count is within ``budget``."""
    return F.coalesce(F.array_max(F.transform(prefix_tokens, lambda c, i: F.when(c <= budget, i + 1))), F.lit(0))
