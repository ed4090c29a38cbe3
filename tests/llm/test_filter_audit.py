"""Filter audit against a plain run of every order, on odd input and on empty tables."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from reitlens.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_docs(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ß", " ", "\x1c"]
    texts = [None, "", " \n", "One", "#", "A" * 300, " ".join(["same"] * 250), " ".join(vocab * 3)]
    for _ in range(60):
        t = " ".join(r.choice(vocab) for _ in range(r.choice([5, 150, 199, 200, 260])))
        texts += [t + r.choice(["", " $", " |", " ABCDEFGH" * r.randint(1, 3)])] * r.choice([1, 1, 2, 5])
    rows = [(i, t, r.choice(["s1", "s2", None])) for i, t in enumerate(texts)]
    rows += [rows[3], rows[20], (None, texts[20], "s1"), (None, texts[20], "s2"), (None, "alone", ""), (9000, texts[-1], "only")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, len(texts), 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (77777, 1, 1)]
    return rows, labels


def fails(rows):
    low = {}
    for i, t, _ in rows:
        low[t or ""] = min(low.get(t or "", 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        out.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                    "D": bool(re.search(r"[#$%&*|]", t)), "E": low[t] < ((1 << 63) - 1 if i is None else i)})
    return out


def plain(rows, labels):
    bad = fails(rows)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [k for k, row in enumerate(rows) if (row[2] or "") == part]
        removed_sum = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if bad[k][f]]
                failing = [k for k in mine if bad[k][f]]
                only = [k for k in failing if sum(bad[k].values()) == 1]
                left = [k for k in left if not bad[k][f]]
                removed_sum[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), len(only),
                                                   sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = removed_sum[v[6]]
    return out


def test_audit_equals_plain_runs(spark):
    rows, labels = some_docs()
    docs = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], "doc_id long, text string, source string, mask string, good int, digest binary").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit_documents(docs, marks).collect()}
    assert got == plain(rows, labels)
    assert all(sum(v[k] for v in got.values()) for k in range(7))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(none, marks).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    got = filter_audit.audit_documents(one, marks).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and {r.removed for r in got if r.filter_order[r.step - 1] == "A"} == {1}


@pytest.mark.parametrize("filters", [1, 3, 5, 7])
def test_gray_walk_holds_every_subset(filters):
    r = np.random.default_rng(filters)
    count = r.integers(0, 9, (1 << filters, 3, 4))
    states = filter_audit.gray_walk(count)
    for subset in range(1 << filters):
        assert (states[subset] == count[[m for m in range(1 << filters) if not m & subset]].sum(axis=0)).all()


def test_pieces_cut_no_word():
    r = random.Random(1)
    for _ in range(200):
        raw = "".join(r.choice("ab é\n\t") for _ in range(r.randint(0, 200))).encode()
        parts = list(filter_audit.pieces(raw, r.randint(1, 40)))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()
    long = ("word " * 500_000).encode()
    assert filter_audit.failures(long) == 2
