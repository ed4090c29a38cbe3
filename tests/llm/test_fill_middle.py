"""Fill-in-the-middle: brute force, exact round trips and the boundary set's containers."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reitlens.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(i, text, rate=50, spm=80):
    w = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(w), "plain", None, None, text
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < spm:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts():
    r = random.Random(2)
    texts = [None, "", " ", "\n\n", "a", " a ", "a <P> b", "x<S>y", "<M>", "<", "P> <", "<S", "é ü ö\x1c z", "ab " * 70_000, "😀 " * 30_000, "n" * 200_000]
    for _ in range(150):
        texts.append("".join(r.choice(["a", "bc", " ", "\n", "<", ">", "P", "S>", "é", "\t "]) for _ in range(r.randint(0, 60))))
    return texts


@pytest.mark.parametrize("rate", [50, 100])
def test_transform_equals_brute_force(spark, rate):
    rows = list(enumerate(some_texts())) + [(None, "no id here at all"), (None, "nor here"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "own", 7) for i, t in rows], "doc_id long, text string, form string, other int").repartition(3)
    out = fill_middle.transform(docs, rate=rate)
    assert out.columns == ["doc_id", "other", "n_tokens", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *plain(i, t or "", rate), t or "") for i, t in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[5], x[6])
    assert sorted(((r.doc_id, r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.transform(docs.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300_000), unique=True, min_size=1, max_size=400), st.lists(st.tuples(st.integers(0, 200_000), st.integers(1, 9000)), max_size=4))
def test_boundary_set_selects_every_offset(points, stretches):
    offsets = np.unique(np.concatenate([np.array(points), *[np.arange(a, a + n) for a, n in stretches]]))
    known = fill_middle.BoundarySet(offsets)
    assert len(known) == len(offsets)
    for rank in {0, len(offsets) - 1, *range(0, len(offsets), max(len(offsets) // 50, 1))}:
        assert known.select(rank) == offsets[rank]


def test_containers_are_the_smallest():
    low = np.arange(0, 65536, 2)
    assert isinstance(fill_middle.container(low), fill_middle.BitmapContainer)
    assert isinstance(fill_middle.container(low[:1000]), fill_middle.ArrayContainer)
    assert isinstance(fill_middle.container(np.arange(100, 9000)), fill_middle.RunContainer)
    for c, want in ((fill_middle.container(low), low), (fill_middle.container(np.arange(100, 9000)), np.arange(100, 9000)), (fill_middle.container(low[:1000]), low[:1000])):
        assert [c.select(k) for k in range(len(want))] == want.tolist()


def test_token_ends_follow_the_pattern():
    for t in some_texts():
        raw = (t or "").encode()
        ends, at = [], 0
        for w in TOKEN.findall(t or ""):
            at += len(w.encode())
            ends.append(at)
        assert fill_middle.token_ends(raw).tolist() == ends
