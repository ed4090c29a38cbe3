"""Quality rules with an n-gram perplexity from a modified Kneser-Ney model counted by Spark.

Symbols are characters (white space runs are one space, 16 bits each), grams of
four symbols are one long, so prefixes and suffixes are bit operations.  Spark
counts the grams of every language over all documents, then derives continuation
counts, discounts, back-off weights and interpolated probabilities by joins and
aggregations.  The model is scored from sorted arrays of hashed grams while its
size is within a limit, and by a join of each document's grams beyond it.

A document's perplexity is that of all its characters.  A document is rejected
if it breaks a base rule or if that perplexity lies outside its language's lower
or upper band; bands come from the median and the spread over all documents of
the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reitlens.llm.common import BROADCAST_BYTES, mix, release, row_key, ship, split_words, stored, text_slices, without_rows

ORDER = 4
MIN_WORDS = 50
MAX_REPEAT = 50
#: Bands: this many spreads (scaled median absolute deviations) below and above the language's median.
LOWER, UPPER = 3.25, 3.25
#: A spread counts as at least this much of log perplexity.
LEAST_SPREAD = 0.01
#: Characters whose worth of noise a short text's band is widened by.
SHORT_CHARS = 200.0
#: Log perplexity is kept in thousandths for the histogram that the bands are read from.
GRAIN = 1000
START = 2  # symbol before a text
_KEPT_GRAMS = 4_000_000


def symbols(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, row of each): START * 3 before each text, then its characters with white space runs as one space."""
    text = pc.fill_null(text, "")
    chars = np.asarray(pc.utf8_length(text)).astype(np.int64)
    raw = b"".join(text.cast(pa.large_binary()).to_pylist()).decode("utf-8", "replace").encode("utf-32-le")
    code = np.frombuffer(raw, np.uint32)
    row = np.repeat(np.arange(len(chars)), chars)
    code = np.where(code >= 0x10000, 0xE000 | (code & 0x3FF), code).astype(np.uint16)
    space = (code <= 32) & (code != START) | (code == 0xA0)
    code = np.where(space, 32, code).astype(np.uint16)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    code, row = code[keep], row[keep]
    n = np.bincount(row, minlength=len(chars))
    out = np.full(len(code) + (ORDER - 1) * len(chars), START, np.uint16)
    place = np.arange(len(code)) + (ORDER - 1) * (row + 1)
    out[place] = code
    return out, np.repeat(np.arange(len(chars)), n + ORDER - 1)


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row): one gram of ORDER symbols per character of each text."""
    s, row = symbols(text)
    if len(s) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(len(s) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        g = (g << np.uint64(16)) | s[i:len(s) - ORDER + 1 + i]
    ok = row[:len(g)] == row[ORDER - 1:]
    return g[ok], row[:len(g)][ok]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all of (lang, text), summed inside each task first."""
    ship(docs.sparkSession)

    def merged(parts):
        g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, inv = np.unique(g, return_inverse=True)
        return u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64)

    def out(held):
        for lang, parts in held.items():
            u, n = merged(parts)
            for s in range(0, len(u), 100_000):
                k = len(u[s:s + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(u[s:s + k].view(np.int64)), pa.array(n[s:s + k])], names=["lang", "gram", "n"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for b in text_slices(batch, "text"):
                g, row = grams(b.column("text"))
                enc = pc.dictionary_encode(b.column("lang"))
                codes = np.asarray(enc.indices.fill_null(0))
                names = enc.dictionary.to_pylist()
                of = codes[row]
                for k, lang in enumerate(names):
                    mine = g if len(names) == 1 else g[of == k]
                    if len(mine):
                        u, n = np.unique(mine, return_counts=True)
                        held.setdefault(lang, []).append((u, n))
                        size += len(u)
                if size > _KEPT_GRAMS:
                    held = {k: [merged(p)] for k, p in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > _KEPT_GRAMS // 2:
                        yield from out(held)
                        held, size = {}, 0
        yield from out(held)

    part = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(run, "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(order: int):
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def model_tables(counts: DataFrame) -> list[DataFrame]:
    """For order 1 .. ORDER: (lang, gram, logp, back): interpolated log probability, and the log back-off weight of the gram as a context.

    Orders below the highest count in how many different symbols' wake a gram
    stands.  A gram that is only ever a context has a null ``logp``.
    """
    raw = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        raw[k] = stored(raw[k + 1].select("lang", _suffix(k + 1).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "lm-raw")
    tables: list[DataFrame] = []
    lower = None
    for k in range(1, ORDER + 1):
        c = raw[k]
        few = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(i, y=y):
            d = F.lit(float(i)) - F.lit(float(i + 1)) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
            usable = (F.col("n1") > 0) & (F.col(f"n{i}") > 0)
            return F.coalesce(F.when(usable, F.greatest(F.least(d, F.lit(i - 0.05)), F.lit(0.05))), F.lit(0.5))
        d = c.groupBy("lang").agg(*few).select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        c = c.join(F.broadcast(d), "lang")  # one row per language
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = stored(c.select("lang", "gram", "n", cut.alias("cut"), F.shiftrightunsigned("gram", 16).alias("ctx")), "lm-cut")
        ctx = c.groupBy("lang", "ctx").agg(F.sum("n").cast("double").alias("total"), F.sum("cut").alias("mass"), F.count(F.lit(1)).alias("kinds"))
        ctx = ctx.withColumn("gamma", F.col("mass") / F.col("total"))
        p = c.join(ctx, ["lang", "ctx"])
        own = (F.col("n") - F.col("cut")) / F.col("total")
        if k == 1:
            prob = own + F.col("gamma") / (F.col("kinds") + 1)
            p = p.select("lang", "gram", prob.alias("p"))
            none = ctx.select("lang", F.lit(-1).cast("long").alias("gram"), (F.col("gamma") / (F.col("kinds") + 1)).alias("p"))  # any unseen symbol
            p = p.unionByName(none)
        else:
            low = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
            p = p.withColumn("suffix", _suffix(k)).join(low, ["lang", "suffix"])
            p = p.select("lang", "gram", (own + F.col("gamma") * F.col("low")).alias("p"))
            backs = ctx.select("lang", F.col("ctx").alias("gram"), F.log("gamma").alias("back"))
            tables[-1] = stored(tables[-1].join(backs, ["lang", "gram"], "full"), "lm-order")
        lower = stored(p, "lm-p")
        tables.append(lower.select("lang", "gram", F.log("p").alias("logp")))
        release(counts.sparkSession)
    tables[-1] = tables[-1].withColumn("back", F.lit(None).cast("double"))
    return tables


class HashArrays:
    """Sorted arrays of hashed grams per order for one language."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.unseen = -20.0
        self.orders = []
        for gram, logp, back in orders:
            lone = gram == np.uint64(0xFFFFFFFFFFFFFFFF)
            if lone.any():
                self.unseen = float(logp[lone][0])
            key = mix(gram)
            at = np.argsort(key)
            self.orders.append((key[at], logp[at].astype(np.float32), np.where(np.isnan(back), 0.0, back)[at].astype(np.float32)))

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted gram or -1."""
        if not len(keys):
            return np.full(len(wanted), -1)
        h = mix(wanted)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def logp(self, g: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each gram: of the longest known suffix, times the back-off weights before it."""
        out = np.zeros(len(g), np.float64)
        open_ = np.arange(len(g))
        for k in range(len(self.orders), 0, -1):
            keys, logp, _ = self.orders[k - 1]
            mine = g[open_] & np.uint64((1 << 16 * k) - 1)
            at = self.find(keys, mine)
            value = logp[at]
            hit = (at >= 0) & ~np.isnan(value)
            out[open_[hit]] += value[hit]
            open_, mine = open_[~hit], mine[~hit]
            if not len(open_):
                return out
            if k > 1:
                ckeys, _, back = self.orders[k - 2]
                c = self.find(ckeys, mine >> np.uint64(16))
                out[open_] += np.where(c >= 0, back[c], 0.0)
        out[open_] += self.unseen
        return out


def _load(tables: list[DataFrame]) -> dict[str, HashArrays]:
    """The model by language; read as Arrow columns, never as rows."""
    got: dict[str, list] = {}
    for k, t in enumerate(tables):
        cols = t.select("lang", "gram", "logp", "back").toArrow()
        if not cols.num_rows:
            continue
        lang = pc.dictionary_encode(cols["lang"].combine_chunks())
        code = np.asarray(lang.indices)
        gram = cols["gram"].to_numpy().view(np.uint64)
        logp, back = (pc.fill_null(cols[c], np.nan).to_numpy() for c in ("logp", "back"))
        for i, name in enumerate(lang.dictionary.to_pylist()):
            mine = code == i
            got.setdefault(name, [(np.zeros(0, np.uint64),) + (np.zeros(0),) * 2 for _ in tables])[k] = (gram[mine], logp[mine], back[mine])
    return {name: HashArrays(o) for name, o in got.items()}


def base_figures(b: pa.RecordBatch) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the texts of a slice."""
    text = pc.fill_null(b.column("text"), "")
    words, off = split_words(text)
    n = np.diff(off)
    chars = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words)).astype(np.int64))])
    syms = np.asarray(pc.count_substring_regex(text, pattern="[#*$%&|<>]")).astype(np.int64)
    dup = np.zeros(len(n), np.int64)
    for i, t in enumerate(text.to_pylist()):
        if "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    rep = np.zeros(len(n), np.int64)
    if len(words) >= 3:
        ids = mix(np.asarray(pc.dictionary_encode(words).indices).astype(np.uint64) + np.uint64(1))
        row = np.repeat(np.arange(len(n)), n)
        m = np.uint64(0x9E3779B97F4A7C15)
        h = mix(((ids[:-2] * m + ids[1:-1]) * m + ids[2:]) * m + row[:-2].astype(np.uint64))
        inside = np.flatnonzero(row[:-2] == row[2:])
        h = h[inside]
        order = np.argsort(h)
        s = h[order]
        eq = np.zeros(len(s) + 1, bool)
        eq[1:-1] = s[1:] == s[:-1]
        twice = inside[order[eq[1:] | eq[:-1]]]
        cover = np.zeros(len(words), bool)
        for i in range(3):
            cover[twice + i] = True
        rep = np.bincount(row[cover], minlength=len(n)).astype(np.int64)
    return [n.astype(np.int64), chars[off[1:]] - chars[off[:-1]], syms, dup, rep]


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, lang, the base figures, n_grams, cross): cross is the log perplexity of the text, over all its grams (null without characters)."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))
    tables = model_tables(stored(count_grams(src.select("lang", "text")), "lm-counts"))
    release(spark)
    entries = sum(t.count() for t in tables)
    id_type = src.schema["doc_id"].dataType.simpleString()
    figures = ", ".join(f"{c} long" for c in FIGURES)
    model = spark.sparkContext.broadcast(_load(tables)) if entries * 16 <= limit else None

    def by_arrays(batches):
        arrays = model.value
        for batch in batches:
            for b in text_slices(batch, "text"):
                g, row = grams(b.column("text"))
                langs = b.column("lang").to_pylist()
                n = np.bincount(row, minlength=len(langs))
                nll = np.zeros(len(g))
                of = np.array([hash(x) for x in langs])[row] if len(row) else row
                for x in set(langs):
                    mine = of == hash(x)
                    if mine.any():
                        nll[mine] = -arrays[x].logp(g[mine])
                value = np.bincount(row, weights=nll, minlength=len(langs)) / np.maximum(n, 1)
                cols = [b.column("doc_id"), b.column("lang"), *[pa.array(c) for c in base_figures(b)], pa.array(n.astype(np.int64)), pa.array(value, mask=n == 0)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", *FIGURES, "n_grams", "cross"])

    if model is not None:
        return src.mapInArrow(by_arrays, f"doc_id {id_type}, lang string, {figures}, n_grams long, cross double")

    def by_rows(batches):  # each document's grams with their counts; the key tells equal ids with different texts apart
        for batch in batches:
            for b in text_slices(batch, "text"):
                g, row = grams(b.column("text"))
                cols = base_figures(b)
                n = np.bincount(row, minlength=b.num_rows)
                ids, langs = b.column("doc_id"), b.column("lang")
                cut = np.concatenate([[0], np.cumsum(n)])
                lists = [g[x:y].view(np.int64) for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([ids, langs, *[pa.array(c) for c in cols], pa.array(n.astype(np.int64)), pa.array(lists, pa.list_(pa.int64()))],
                                                 names=["doc_id", "lang", *FIGURES, "n_grams", "gram"])

    rows = src.mapInArrow(by_rows, f"doc_id {id_type}, lang string, {figures}, n_grams long, gram array<long>")
    rows = stored(rows.withColumn("row", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id())), "lm-rows")
    each = rows.select("row", "lang", F.explode("gram").alias("gram")).groupBy("row", "lang", "gram").agg(F.count(F.lit(1)).alias("k"))
    cross = each.join(tables[-1], ["lang", "gram"]).groupBy("row").agg((-F.sum(F.col("k") * F.col("logp")) / F.sum("k")).alias("cross"))
    return rows.drop("gram").join(cross, "row", "left").select("doc_id", "lang", *FIGURES, "n_grams", "cross")


def bands(scores: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """(lang, middle, spread, low, high) of log perplexity, from a histogram in thousandths (some thousand bins a language)."""
    hist = scores.where("cross is not null and n_words >= " + str(MIN_WORDS)).groupBy("lang", F.round(F.col("cross") * GRAIN).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    hist = stored(hist, "lm-hist")

    def median(df, value):
        w = Window.partitionBy("lang")
        cum = df.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all_", F.sum("n").over(w))
        return cum.where(F.col("upto") * 2 >= F.col("all_")).groupBy("lang").agg(F.min(value).alias("m"))
    middle = median(hist, "bin").withColumnRenamed("m", "middle")
    off = hist.join(F.broadcast(middle), "lang").withColumn("off", F.abs(F.col("bin") - F.col("middle"))).groupBy("lang", "off").agg(F.sum("n").alias("n"))
    spread = median(off, "off").withColumnRenamed("m", "mad")
    s = F.greatest(F.col("mad") / GRAIN * 1.4826, F.lit(LEAST_SPREAD))
    return middle.join(spread, "lang").select("lang", (F.col("middle") / GRAIN).alias("middle"), s.alias("spread")).select(
        "lang", "middle", "spread", (F.col("middle") - lower * F.col("spread")).alias("low"), (F.col("middle") + upper * F.col("spread")).alias("high"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """(doc_id, the base figures, base_failed, log_perplexity, low, high, kept) for every row.

    A null text has no words and fails the base rules; a null language is a
    language of its own.  A language without any document of ``MIN_WORDS`` words
    has no band.  Bands are widened for short texts, whose averages scatter more:
    by the square root of 1 + SHORT_CHARS / characters.  Repeated rows are judged
    alike.  An empty table gives an empty result.
    """
    scores = stored(scored(docs, doc_id, text, lang), "lm-scores")
    band = stored(bands(scores, lower, upper), "lm-bands")
    wide = F.sqrt(1 + F.lit(SHORT_CHARS) / F.greatest(F.col("n_grams"), F.lit(1)))
    j = scores.join(F.broadcast(band), "lang", "left")  # one row per language
    low, high = F.col("middle") - (F.col("middle") - F.col("low")) * wide, F.col("middle") + (F.col("high") - F.col("middle")) * wide
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    j = j.withColumn("base_failed", failed).withColumn("low", low).withColumn("high", high)
    inside = F.coalesce((F.col("cross") >= F.col("low")) & (F.col("cross") <= F.col("high")), F.lit(True))
    return j.select("doc_id", *FIGURES, "base_failed", F.col("cross").alias("log_perplexity"), "low", "high", (~F.col("base_failed") & inside).alias("kept"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **bands_) -> DataFrame:
    """The rows of ``docs`` that are kept; rows with one id or without an id are judged each by its own text."""
    rows = docs.select(row_key(doc_id, text, lang).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    gone = judge(rows, **bands_).where("not kept").select("doc_id.id", "doc_id.mark").distinct()
    return without_rows(docs, stored(gone, "lm-gone"), doc_id, text, lang)
