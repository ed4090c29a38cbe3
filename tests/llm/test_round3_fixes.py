"""Wider checks of earlier operators: token counts against the library, mixing at many sources, filters and blocks at every size."""

import random
import time

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reitlens.llm import common, decontaminate, entries, mixing, simhash_trie, token_prefix, wrapper_html
from tests.conftest import SF_SMALL


def vocabulary():
    import public_tokenizers

    return token_prefix.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_of_odd_texts_equal_the_library(spark):
    r = random.Random(4)
    letters = list("abcXYZ019 '\n\t\x0b\x1c\x1d\x1e\x1f\x85\xa0éßİ$#.,-") + ["'s", "'RE", " ", "​", "é", "日本", "<|endoftext|>", "ﬁ"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(6000)] + ["\x1c", "a\x1fb", "\x1d \x1e"]
    tok = Tokenizer.from_str(vocabulary())
    want = [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.n_tokens for x in token_prefix.token_counts(docs, vocabulary()).collect()}
    assert [i for i, n in enumerate(want) if got[i] != n] == []


def test_whole_documents_equal_the_library_and_cuts_follow_prefixes(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    tok = Tokenizer.from_str(vocabulary())
    rows = docs.collect()
    want = {r.doc_id: len(x.ids) for r, x in zip(rows, tok.encode_batch([r.text or "" for r in rows], add_special_tokens=False))}
    out = token_prefix.token_counts(docs, vocabulary(), store=True, budgets=(0, 7, 300, 2048))
    got = out.select("doc_id", "n_tokens", "cut_0", "cut_7", "cut_300", "cut_2048", *[token_prefix.longest_within(F.col("prefix_tokens"), n).alias(f"plain_{n}") for n in (0, 7, 300, 2048)]).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r[f"cut_{n}"] == r[f"plain_{n}"] for r in got for n in (0, 7, 300, 2048))
    assert any(r.cut_300 != r.cut_2048 for r in got)


def test_mixing_many_sources_on_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        sources = spark.range(2000).select(F.concat(F.lit("s"), F.col("id")).alias("source"), (F.col("id") % 50 + 1).alias("source_size"))
        got = mixing.source_targets(sources).collect()
        total = sum(r.source_size for r in got)
        assert len(got) == 2000 and abs(sum(r.target for r in got) - 1.5 * total) < 1e-6 * total
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_mixing_rows_without_an_id_meet_their_target(spark):
    r = random.Random(3)
    rows = [(None if s == "a" else 5 if s == "b" else i, f"{i} " + "w " * r.randint(1, 40), s) for s in "abc" for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.size * x.copies for x in mine) - mine[0].target) <= 41


def test_key_filter_has_no_false_negatives(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 200_000)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(5)
    bitmap = common.key_filter(df, "k")
    assert common.may_hold(bitmap, keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 100_000).view(np.uint64)
    assert common.may_hold(bitmap, other).mean() < 0.1


def test_recompression_takes_its_path_beyond_the_broadcast_limit(spark, monkeypatch):
    plain = sorted(map(tuple, entries.QUERIES["op6_substring_dedup"](spark, SF_SMALL).collect()))
    suffix = sorted(map(tuple, entries.QUERIES["op9_suffix_dedup"](spark, SF_SMALL).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common.sized, "__defaults__", (0,))
    assert sorted(map(tuple, entries.QUERIES["op6_substring_dedup"](spark, SF_SMALL).collect())) == plain
    assert sorted(map(tuple, entries.QUERIES["op9_suffix_dedup"](spark, SF_SMALL).collect())) == suffix


def test_html_of_a_megabyte_takes_time_in_proportion():
    k = 100_000
    pages = {"<b>" * k + "</i>" * k + "end": "end", "<ol>" + "<b>" * k + "<li>" * k + "end": "end", "<table>" + "<b>" * k + "<td></td>" * k + "end": "end",
             "<b>" * k + "<hr>" * k + "end": "end", "<article>" * k: "", "<div class=ad>" * k + "end": "", "<p>a</p>" + "<a =\"'>" * k: "a", "<" + "a" * (10 * k): ""}
    for page, want in pages.items():
        before = time.process_time()
        assert wrapper_html.main_text(page, set()) == want
        assert time.process_time() - before < 20, page[:20]


def test_simhash_crowded_blocks_are_cut_until_none_is_left(spark, monkeypatch):
    """A dense family beside random fingerprints: classes as by brute force, with the production limits and with small ones."""
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 600, dtype=np.uint64)
    near = [base[:80] ^ np.uint64(1 << int(r.integers(64))) ^ np.uint64(1 << int(r.integers(64))) for _ in range(3)]
    dense = (base[0] & ~np.uint64(0xFFFF)) | r.integers(0, 1 << 16, 700, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *near, dense]))
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    want = simhash_trie._stars(len(x), i, j, np.arange(len(x)))
    simhash_trie.ship(spark)
    table = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(4)
    for crowded, dense_limit in ((simhash_trie.CROWDED, simhash_trie.DENSE), (60, 120)):
        monkeypatch.setattr(simhash_trie, "CROWDED", crowded)
        monkeypatch.setattr(simhash_trie, "DENSE", dense_limit)
        got = simhash_trie.links(table).collect()
        ends = [np.searchsorted(x, np.array([p[k] for p in got], np.int64).view(np.uint64)) for k in (0, 1)]
        assert (simhash_trie._stars(len(x), *ends, np.arange(len(x))) == want).all()


def test_decontamination_equals_brute_force(spark):
    """Every window of every document against every window of every item; items of 3 to 30 words, some of them twice."""
    rnd = random.Random(7)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([3, 5, 6, 9, 12, 13, 14, 30])))) for i in range(24)]
    items += [(100 + i, text) for i, text in items[:6]] + [(200, None), (201, "")]
    docs = [(None, None), (-1, "")]
    for d in range(60):
        words = rnd.choices(vocab, k=rnd.randrange(20))
        for _, text in rnd.sample(items[:24], rnd.randrange(3)):
            copy = text.split()
            for at in rnd.sample(range(len(copy)), min(rnd.randrange(4), len(copy))):
                copy[at] = rnd.choice(vocab)
            words += copy + rnd.choices(vocab, k=rnd.randrange(5))
        docs.append((d, " ".join(words)))
    want = set()
    for i, item in items:
        x = (item or "").split()
        w = min(13, len(x))
        if w < decontaminate.SHORTEST:
            continue
        for d, text in docs:
            y = (text or "").split()
            for p in range(len(y) - w + 1):
                if any(sum(a != b for a, b in zip(x[k:k + w], y[p:p + w])) <= 2 * w // 13 for k in range(len(x) - w + 1)):
                    want.add((d, i, p, w))
    table, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 100
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        assert {tuple(r) for r in decontaminate.overlaps(table, tests, limit=limit).collect()} == want
    hit = {d for d, *_ in want}
    assert {r.doc_id for r in decontaminate.clean(table, tests, limit=0).collect()} == {d for d, _ in docs} - hit
