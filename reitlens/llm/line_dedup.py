"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is its sequence of words.  A line goes if an earlier line (by document
id, then line number) is equal to it or, where both have at least ``SHORTEST``
words, can be made equal by one word inserted, deleted or replaced; lines are
judged on the input, so the earliest of every group stays.

Of two such lines one edit lies in the first or in the second half, so they
share a half: lines that share no half with any other line are set aside by one
aggregation of half hashes.  The others emit all their variants with one word
deleted as hashed keys.  Equal variants meet in a join with the earliest line of
each key (never all pairs of a key), the words of each meeting are compared, and
the later line of a verified pair goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import BROADCAST_BYTES, SPACES, data_bytes, release, sized, stored

#: One edit of five words leaves a similarity of 0.8.
SHORTEST = 5


def line_words(line: Column) -> Column:
    """Words of a line; a pattern is only needed where there is other white space than blanks."""
    return F.array_remove(F.when(line.rlike("[\\t\\n\\x0B\\f\\r]"), F.split(line, SPACES)).otherwise(F.split(line, " ")), "")


def has_word(line: Column) -> Column:
    return line.rlike("[^ \\t\\n\\x0B\\f\\r]")


def _halves(words: Column, n: Column, shortest: int) -> Column:
    """Hashes of the first and the last half for each length the shorter line of a pair may have: n and n - 1."""
    def of(length):
        head = F.floor(length / 2).cast("int")
        tail = (length - head).cast("int")
        return [F.xxhash64(F.lit(0), length, F.slice(words, F.lit(1), head)), F.xxhash64(F.lit(1), length, F.slice(words, n - tail + 1, tail))]
    return F.when(n > shortest, F.array(*of(n), *of(n - 1))).when(n == shortest, F.array(*of(n))).otherwise(F.array().cast("array<bigint>"))


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` plus ``mark__``: a hash of the text where several rows have the id (or none), else null; without it if no id is repeated."""
    ids = stored(docs.groupBy(F.col(doc_id).alias("r_id__")).agg(F.count(F.lit(1)).alias("n__")).where("n__ > 1"), "lines-ids")
    if ids.isEmpty():
        return docs
    return docs.join(sized(ids), F.col(doc_id).eqNullSafe(F.col("r_id__")), "left").withColumn("mark__", F.when(F.col("n__").isNotNull(), F.xxhash64(text))).drop("r_id__", "n__")


def _mark(docs: DataFrame) -> list[Column]:
    return [F.col("mark__").alias("mark")] if "mark__" in docs.columns else []


def line_table(docs: DataFrame, doc_id: str, text: str, shortest: int) -> DataFrame:
    """(place, a, b, n, halves): every line with a word; ``place`` orders lines, (a, b) is its 128-bit hash."""
    mark = _mark(docs)
    lines = docs.select(F.col(doc_id).alias("doc_id"), *mark, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    words = lines.where(has_word(F.col("line"))).select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *(["mark"] if mark else []), "line_no").alias("place"), line_words(F.col("line")).alias("words"))
    n = F.size("words")
    return words.select("place", F.xxhash64(F.lit(7), "words").alias("a"), F.xxhash64(F.lit(11), "words").alias("b"),
                                     n.alias("n"), _halves(F.col("words"), n, shortest).alias("halves"))


def _near_earlier(docs: DataFrame, distinct: DataFrame, doc_id: str, text: str, shortest: int) -> DataFrame | None:
    """(a, b) of distinct lines that have an earlier line within one edit."""
    halves = distinct.where(F.size("halves") > 0).select("a", "b", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("half")
    suspects = halves.join(shared, "half", "left_semi").select("a", "b").distinct()
    suspects = stored(distinct.join(suspects, ["a", "b"], "left_semi").select(F.col("first").alias("place"), "a", "b"), "lines-suspects")
    if suspects.isEmpty():
        return None
    mark = _mark(docs)
    # the words of the suspects, from the line where each stands first
    at = suspects.select(F.col("place.no_id").alias("s_no"), F.col("place.doc_id").alias("s_id"), *([F.col("place.mark").alias("s_mark")] if mark else []), F.col("place.line_no").alias("s_line"), "place", "a", "b")
    # only the documents that hold such a line are split again, while their ids can go to the tasks
    ids = at.select("s_id").distinct()
    held = docs.select(F.col(doc_id).alias("doc_id"), *mark, F.col(text).alias("text"))
    if data_bytes(ids) <= BROADCAST_BYTES:
        held = held.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("s_id")), "left_semi")
    lines = held.select("doc_id", *(["mark"] if mark else []), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    same = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("line_no") == F.col("s_line"))
    if mark:
        same &= F.col("mark").eqNullSafe(F.col("s_mark"))
    words = (lines.join(sized(at), same)
             .select("place", "a", "b", line_words(F.col("line")).alias("words")))
    words = words.where((F.xxhash64(F.lit(7), "words") == F.col("a")) & (F.xxhash64(F.lit(11), "words") == F.col("b")))
    words = stored(words.dropDuplicates(["a", "b"]).withColumn("n", F.size("words")), "lines-words")

    gap = F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("gap")  # -1: nothing deleted
    v = words.select("place", "a", "b", "n", "words", gap)
    key = F.when(F.col("gap") < 0, F.xxhash64(F.lit(3), "words")).otherwise(
        F.xxhash64(F.lit(3), F.slice("words", F.lit(1), F.greatest(F.col("gap"), F.lit(0))), F.slice("words", F.col("gap") + 2, F.col("n"))))
    v = stored(v.select("place", "a", "b", "n", "gap", key.alias("key")), "lines-variants")
    gone, whole = v.where("gap >= 0"), v.where("gap < 0")
    me = ["place", "a", "b", "gap"]
    low = F.min(F.struct("place", "a", "b", "gap")).alias("low")
    # one word replaced: the same gap in lines of one length; the earliest line of each key stands for all
    same_gap = gone.groupBy("key", "n", "gap").agg(low, F.count(F.lit(1)).alias("lines")).where("lines > 1")
    replaced = gone.join(same_gap.select("key", "n", "gap", "low"), ["key", "n", "gap"]).select(*me, "low")
    # one word more or less: a variant equal to a whole line
    whole_low = whole.select("key", F.col("n").alias("m"), F.struct("place", "a", "b", "gap").alias("low"))
    longer_later = gone.join(whole_low, (gone["key"] == whole_low["key"]) & (gone["n"] - 1 == whole_low["m"])).select(*[gone[c] for c in me], "low")
    least = gone.groupBy("key", (F.col("n") - 1).alias("n")).agg(low)
    shorter_later = whole.join(least, ["key", "n"]).select(*me, "low")
    pairs = replaced.unionByName(longer_later).unionByName(shorter_later).where("low.place < place")
    pairs = stored(pairs.distinct(), "lines-pairs")
    # verify: the words without the deleted ones are equal
    one = words.select("a", "b", F.col("words").alias("w"))
    other = words.select(F.col("a").alias("low_a"), F.col("b").alias("low_b"), F.col("words").alias("low_w"))
    p = pairs.select("a", "b", "gap", F.col("low.a").alias("low_a"), F.col("low.b").alias("low_b"), F.col("low.gap").alias("low_gap"))
    both = p.join(one, ["a", "b"]).join(other, ["low_a", "low_b"])

    def without(w, g):
        return F.when(F.col(g) < 0, F.col(w)).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(F.col(g), F.lit(0))), F.slice(w, F.greatest(F.col(g), F.lit(0)) + 2, F.size(w))))
    return both.where((without("w", "gap") == without("low_w", "low_gap")) & (F.size("w") >= shortest) & (F.size("low_w") >= shortest)).select("a", "b").distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, gone): numbers (from 0) of the lines that go, for documents that lose any.

    Null texts have no lines; lines without a word never go.  A null doc_id comes
    after all others.  Rows with one id or without an id are told apart by their
    text (then there is a column ``mark``, its hash, null where the id stands alone);
    rows that agree in both are one document: a line does not remove itself.  An
    empty table gives none.
    """
    return _removed(_marked(docs, doc_id, text), doc_id, text, shortest)


def _removed(docs: DataFrame, doc_id: str, text: str, shortest: int) -> DataFrame:
    lines = stored(line_table(docs, doc_id, text, shortest), "lines-all")
    distinct = stored(lines.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.first("halves").alias("halves")), "lines-distinct")
    near = _near_earlier(docs, distinct, doc_id, text, shortest)
    release(docs.sparkSession)
    act = distinct.select("a", "b", "first", "last")
    if near is not None:
        act = act.join(stored(near, "lines-near").withColumn("near", F.lit(True)), ["a", "b"], "left").where("near or first < last")
    else:
        act = act.where("first < last").withColumn("near", F.lit(False))
    act = stored(act.select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-act")
    gone = lines.select("place", "a", "b").join(sized(act), ["a", "b"]).where("near or first < place")
    # at most the lines of one document in a set
    return gone.groupBy(F.col("place.doc_id").alias("doc_id"), *([F.col("place.mark").alias("mark")] if _mark(docs) else [])).agg(F.collect_set("place.line_no").alias("gone"))


def kept_lines(text: Column, gone: Column) -> Column:
    """The text without the lines numbered in ``gone`` (null: as it is)."""
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n"))


def with_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` plus ``gone__``: the numbers of the lines to remove, null if none."""
    docs = _marked(docs, doc_id, text)
    gone = stored(_removed(docs, doc_id, text, shortest), "lines-gone").withColumnsRenamed({"doc_id": "g_id__", "mark": "g_mark__", "gone": "gone__"})
    same = F.col(doc_id).eqNullSafe(F.col("g_id__"))
    if "mark__" in docs.columns:
        same &= F.col("mark__").eqNullSafe(F.col("g_mark__"))
    return docs.join(sized(gone), same, "left").drop("g_id__", "g_mark__", "mark__")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with repeated lines removed from the text; documents that lose their last word are dropped."""
    marked = with_removed(docs, doc_id, text, shortest).withColumn("new__", kept_lines(F.col(text), F.col("gone__")))
    had = F.col("gone__").isNotNull() & (F.size(line_words(F.col("new__"))) == 0)
    cols = [F.col("new__").alias(c) if c == text else F.col(c) for c in docs.columns]
    return marked.where(~had).select(*cols)
