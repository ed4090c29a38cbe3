"""Corpus operators against brute force and on odd input: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reitlens.llm import bwt_dedup, decontaminate, entries, line_dedup, mixing, quality_lm, recompression, simhash_trie, token_prefix, url_rules, wrapper_html

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, kept string, spans string"


def some_docs(seed=3, n=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = text(40)
    rows = [(None, None), (1, ""), (2, " \n\t "), (3, "x" * 400), (4, "a b " * 120), (5, "one")]
    for i in range(6, n):
        t = text(r.randint(1, 80))
        if i % 3 == 0:
            t = t + "\n" + shared + "\n" + text(5)
        if i % 7 == 0:
            t = rows[-1][1] or t
        rows.append((i, t))
    rows += [rows[8], (n, text(3000))]
    return [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 4}" if i else None, "k", "s") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return (1 << 63) - 1 if i is None else i


def test_recompression_equals_brute_force(docs, none):
    rows = docs.collect()
    low = {}
    for r in rows:
        w = WORD.findall(r.text or "")
        for k in range(len(w) - 12):
            t = tuple(w[k:k + 13])
            low[t] = min(low.get(t, key(r.doc_id)), key(r.doc_id))
    want = []
    for r in rows:
        w = WORD.findall(r.text or "")
        gone = set()
        for k in range(len(w) - 12):
            if low[tuple(w[k:k + 13])] < key(r.doc_id):
                gone.update(range(k, k + 13))
        want.append((key(r.doc_id), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [(key(r.doc_id), r.n_words, r.n_removed, r.kept) for r in recompression.dedup(docs).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)
    assert recompression.dedup(none).count() == 0


def test_bwt_equals_brute_force(docs, none):
    rows = docs.collect()
    first = {}
    for r in sorted(rows, key=lambda r: key(r.doc_id)):
        x = (r.text or "").encode()
        for k in range(len(x) - 99):
            first.setdefault(x[k:k + 100], (key(r.doc_id), k))
    want = []
    for r in rows:
        x = (r.text or "").encode()
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 99):
            if first[x[k:k + 100]] < (key(r.doc_id), k):
                gone[k:k + 100] = True
        want.append((key(r.doc_id), len(x), int(gone.sum()), bytes(b for b, g in zip(x, gone) if not g)))
    got = [(key(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in bwt_dedup.dedup(docs).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)
    assert bwt_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_equals_naive_classes(seed):
    r = np.random.default_rng(seed)
    text = r.integers(1, 2 + seed, 800)
    text[200:400] = text[500:700]
    text[-1] = 0
    depth = [5, 7, 20, 60, 100, 13][seed]
    cls = bwt_dedup.equal_windows(text, depth)
    twice = np.concatenate([text, text])
    naive = [twice[i:i + depth].tobytes() for i in range(len(text))]
    assert len({(a, b) for a, b in zip(cls, naive)}) == len(set(naive)) == len(set(cls.tolist()))


def test_frequent_picks_go_by_window_hash(docs, monkeypatch):
    plain = sorted((key(r.doc_id), r.n_removed) for r in bwt_dedup.dedup(docs).collect())
    monkeypatch.setattr(bwt_dedup, "OFTEN", 1)
    assert sorted((key(r.doc_id), r.n_removed) for r in bwt_dedup.dedup(docs).collect()) == plain


def test_simhash_equals_brute_force(docs, none):
    rows = docs.collect()
    fp = {}
    for r in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        w = WORD.findall(w)
        s = [" ".join(w[i:i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fp[key(r.doc_id)] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if bin(fp[a] ^ fp[b]).count("1") <= 4 and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    got = simhash_trie.classes(docs).withColumn("hex", simhash_trie.hex_digits("fp")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.hex == f"{fp[key(r.doc_id)]:016x}" and key(r.component_id) == comp[key(r.doc_id)]
    assert simhash_trie.classes(none).count() == 0
    kept = simhash_trie.one_per_class(docs).collect()
    assert sorted(key(r.doc_id) for r in kept) == sorted(set(comp.values()))


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_trie_walk_finds_every_link(budget):
    r = np.random.default_rng(budget)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in r.choice(64, r.integers(1, 6), replace=False))) for b in base for _ in range(4)]
    x = np.unique(np.concatenate([base, np.array(near, np.uint64)]))

    def classes(pairs):
        c = {v: v for v in x.tolist()}
        moved = True
        while moved:
            moved = False
            for a, b in pairs:
                if c[a] != c[b]:
                    c[a] = c[b] = min(c[a], c[b])
                    moved = True
        return c
    a, b = simhash_trie.walk(x, np.array([0]), budget)
    want = [(int(p), int(q)) for i, p in enumerate(x) for q in x[i + 1:] if bin(int(p ^ q)).count("1") <= budget]
    assert classes(list(zip(a.tolist(), b.tolist()))) == classes(want)


def test_line_dedup_rules(spark, none):
    a = "the quick brown fox jumps over it"
    rows = [(1, f"{a}\nshort\n\nkept line"), (2, a.replace("quick", "slow")), (3, f"{a} now\nshort"), (4, "x\t" + a), (5, None), (6, ""), (7, "one two"), (7, "one two"), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {key(r.doc_id): sorted(r.gone) for r in line_dedup.removed_lines(docs).collect()}
    assert gone == {2: [0], 3: [0, 1], 4: [0], key(None): [0]}
    kept = sorted((key(r.doc_id), r.text) for r in line_dedup.dedup_lines(docs).collect() if r.text)
    assert kept == [(1, rows[0][1]), (7, "one two"), (7, "one two")]
    assert line_dedup.dedup_lines(none).count() == 0


def test_rows_without_an_id_are_documents_of_their_own(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("bdfglmnprstaeiou") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = [" ".join(r.choice(vocab) for _ in range(120)) for _ in range(8)]
    schema = "doc_id long, text string, lang string"
    df = lambda rows: spark.createDataFrame([(*x, "en") for x in rows], schema).repartition(3)
    # one row without an id repeats a document, two more and the rows of id 7 are different texts
    rows = [(1, text[0]), (None, text[0]), (None, text[1]), (None, text[2]), (7, text[3]), (7, text[4]), (None, text[2])]
    want = sorted([text[0], text[1], text[2], text[3], text[4]])
    assert sorted(x.text for x in simhash_trie.one_per_class(df(rows)).collect()) == want
    item = spark.createDataFrame([(0, text[5])], "item_id long, text string")
    got = decontaminate.clean(df([(None, text[5]), (None, text[6]), (7, text[5]), (7, text[3]), (8, text[4])]), item).collect()
    assert sorted(x.text for x in got) == sorted([text[6], text[3], text[4]])
    lines = [(1, "one line of words here\nmore of it stands below"), (None, "one line of words here\nown text of the first"), (None, "quite another beginning of text\nown text of another"), (7, "one line of words here\nfirst of them"), (7, "second of them begins\nand ends")]
    got = sorted(x.text for x in line_dedup.dedup_lines(df(lines)).collect())
    assert got == sorted(["one line of words here\nmore of it stands below", "own text of the first", lines[2][1], "first of them", lines[4][1]])
    junk = [(None, "x y " * 100), (7, "x y " * 100), (None, "few words")]
    got = sorted(x.text for x in quality_lm.keep(df([(None, text[0]), (7, text[1]), *junk, *[(i + 20, t) for i, t in enumerate(text)]])).collect())
    assert got == sorted([text[0], text[1], *text])


def test_token_prefixes_equal_the_library(spark, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    spec = token_prefix.read_vocabulary(P.path("word_bpe_49k.json"))
    tok = Tokenizer.from_str(spec)
    texts = [None, "", " \n", "Hello<|endoftext|>World's naïve café", "a b 日本語 123!!", "don't  we'll\tSTOP", "x" * 300, "é <|END"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_prefix.token_counts(docs, spec, store=True).withColumn("cut", token_prefix.longest_within("prefix_tokens", 2)).collect():
        t = texts[r.doc_id] or ""
        assert r.n_tokens == len(tok.encode(t, add_special_tokens=False).ids) and r.n_bytes == len(t.encode())
        assert (r.prefix_tokens[-1] if r.prefix_tokens else 0) == r.n_tokens and r.cut <= len(r.prefix_tokens)
    c = token_prefix.PrefixCounter(spec)
    for w in ("unbelievable", "naïveté", "we'll99", "thheouble"):
        norm = tok.normalizer.normalize_str(w)
        assert c.prefixes(w) == [len(tok.encode(norm[:i], add_special_tokens=False).ids) for i in range(1, len(norm) + 1)]
    assert token_prefix.token_counts(none.select("doc_id", "text"), spec).count() == 0


def test_mixing_comes_near_its_targets(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        taken, most = sum(r["size"] * r.copies for r in mine), max(r["size"] for r in mine)
        assert abs(taken - mine[0].target) <= 2 * most and mine[0].target <= 2 * mine[0].source_size + 1e-9
        assert all(0 <= r.copies <= 2 for r in mine)
    assert mixing.mix(docs).exceptAll(mixing.mix(docs)).count() == 0
    assert mixing.mix(none).count() == 0


def test_decontamination_tolerates_substitutions(spark, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    w = item.split()
    changed = " ".join(w[:4] + ["X"] + w[5:10] + ["Y"] + w[11:])
    worse = " ".join(x if i % 3 else "X" for i, x in enumerate(w))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, changed.upper() + "."), (3, worse), (4, None), (5, ""), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, None), (12, "too short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(1, 10), (2, 10), (None, 10)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, limit=0).collect()} == {(1, 10), (2, 10), (None, 10)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4, 5]
    assert decontaminate.leaks(none.select("doc_id", "text"), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["https://A.Example.org/en/12?x", "http://example.org/es/1", "http://org/x", "http://b.com/fr/1#t", "http://com/de/", "nonsense", None, "", "://", "http://notexample.org/es/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, url_rules.rules_frame(spark)).collect()}
    assert got[0] == ("a.example.org", "/en/12", "example.org/en/1", "block") and got[1][2:] == ("example.org/es/", "block")
    assert got[2][2:] == ("org/", "allow") and got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert all(got[i] == ("", "", None, "allow") for i in (5, 6, 7, 8)) and got[9][2:] == ("org/", "allow")


def test_html_main_text(spark):
    page = ('<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>m</ul></nav><div class="cookie-notice">c</div>'
            '<article><h1>Head &amp; %s</h1><p><b>One.<br><p>Two  three<aside>no</aside></p><ul><li>i<li>j</ul><section class="comments"><p>said</p></section></article><footer>f</footer>')
    plain = "<body><div>Same everywhere</div><div>%s text</div></body>"
    rows = [(1, "http://h/1", page % "a"), (2, "http://h/2", page % "b"), (3, "http://k/1", plain % "x"), (4, "http://k/2", plain % "y"), (5, None, None), (6, "http://h/3", ""), (7, "http://q/", "<p>a < b &lt; c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper_html.extract(df).collect()}
    assert got[1] == "Head & a\n\nOne.\n\nTwo three\n\ni\n\nj"
    assert got[3] == "x text" and got[4] == "y text" and got[5] == got[6] == "" and got[7] == "a < b < c"
    assert wrapper_html.extract(df.limit(0)).count() == 0


def test_html_template_is_judged_over_all_pages_of_a_host(spark):
    article = '<body class="post-%d"><article><h1>Head %d</h1><div><p>Send this to a friend</p></div><p>Text %d.</p>%s</article></body>'
    plain = "<body><div>Same everywhere</div><div>%s text</div></body>"
    rows = [(i, f"http://h/{i}", article % (i, i, i, "<p>Some share this.</p>" if i < 3 else "")) for i in range(6)]
    # the smallest and the largest id have another layout
    rows += [(10, "http://k/a", "<body><h2>Start</h2></body>"), (19, "http://k/z", "<body><h2>End</h2></body>")] + [(i, f"http://k/{i}", plain % i) for i in range(11, 16)]
    rows += [(20 + i, f"http://c/{i}", plain % "copy") for i in range(5)]
    got = {r.page_id: r.text for r in wrapper_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[0] == "Head 0\n\nText 0.\n\nSome share this." and got[5] == "Head 5\n\nText 5."
    assert got[10] == "Start" and got[19] == "End" and [got[i] for i in range(11, 16)] == [f"{i} text" for i in range(11, 16)]
    assert {got[20 + i] for i in range(5)} == {"Same everywhere\n\ncopy text"}


def test_html_class_words_do_not_drop_the_article(spark):
    pages = ['<article class="post comments"><p>Own text %d</p></article>', '<main class="no-sidebar"><p>Own text %d</p><div class="share-buttons">x</div></main>',
             '<div class="sidebar content"><article><p>Own text %d</p><section class="comments"><article>said</article></section></article></div>',
             '<div class="content right-sidebar"><p>Own text %d</p></div><div class="cookie-notice">c</div>',
             '<main><div class="widget"><article><p>Own text %d</p></article></div></main>',
             '<article><p>Own text %d</p></article><div class="related"><article>Teaser</article></div>']
    rows = [(i, f"http://h{i}/", f"<body>{p % i}</body>") for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in wrapper_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: t for i, t in got.items() if i != 1} == {i: f"Own text {i}" for i in range(6) if i != 1}
    assert got[1].startswith("Own text 1")


def test_quality_figures_and_join_path(docs, none):
    rows = {key(r.doc_id): r for r in quality_lm.judge(docs).collect()}
    for d in docs.collect():
        w, r = WORD.findall(d.text or ""), rows[key(d.doc_id)]
        lines = [x for x in (d.text or "").split("\n") if WORD.search(x)]
        tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        cover = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 2 * len(cover) > len(w)) and not (r.kept and r.base_failed)
    a = {(key(r.doc_id), None if r.cross is None else round(r.cross, 4)) for r in quality_lm.scored(docs).collect()}
    b = {(key(r.doc_id), None if r.cross is None else round(r.cross, 4)) for r in quality_lm.scored(docs, limit=0).collect()}
    assert a == b
    assert quality_lm.judge(none).count() == 0


def test_half_junk_and_short_junk_are_rejected(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice(c) for c in ("bdfglmnprst", "aeiou") * r.randint(1, 3)) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    noise = lambda k: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzäöü0123456789") for _ in range(r.randint(3, 7))) for _ in range(k))
    rows = [(i, prose(r.randint(100, 600)), "en") for i in range(300)]
    rows += [(1000, prose(400) + " " + noise(850), "en"), (1001, noise(60), "en"), (1002, prose(60), "en")]
    got = {r.doc_id: r for r in quality_lm.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(x.base_failed for x in got.values())
    assert not got[1000].kept and not got[1001].kept and got[1002].kept
    assert sum(got[i].kept for i in range(300)) >= 285


def test_model_is_a_distribution(spark, docs):
    counts = quality_lm.count_grams(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text"))
    model = quality_lm._load(quality_lm.model_tables(counts))["en"]
    grams = np.concatenate([quality_lm.grams(b)[0] for b in [__import__("pyarrow").array(["a b a c"])]])
    context = np.uint64(grams[-1]) & ~np.uint64(0xFFFF)
    known = model.orders[0][0]
    total = sum(np.exp(model.logp(np.array([context | np.uint64(c)]))[0]) for c in range(1, 400) if quality_lm.mix(np.array([c], np.uint64))[0] in known)
    assert 0.9 < total <= 1.001


def test_queries_have_names_and_sql():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES) == list(range(1, 14))
    assert set(entries.ORACLES) <= set(entries.QUERIES)
    assert hashlib.sha256(b"").hexdigest()
