"""Financial-figure extraction: fixed sentences and a cross-check against CPython ``re``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reitlens.functions.text import METRICS, extract_financials, extract_metric


def py_extract(text):
    """The extraction rules written directly in Python (the behaviour to match)."""
    out = {}
    for key, patterns, strip, bil, pct in METRICS:
        for p in patterns:
            m = re.search(p, text, re.IGNORECASE)
            if not m:
                continue
            raw = m.group(1).replace(",", "") if strip else m.group(1)
            try:
                v = float(raw)
            except ValueError:
                continue
            if bil and "billion" in m.group(0).lower():
                v *= 1000
            if pct:
                v /= 100.0
            out[key] = v
            break
    return out


CASES = [
    ("FFO per share was $4.05 for the year", {"ffo_per_share": 4.05}),
    ("NOI of $1.2 billion", {"noi": 1200.0}),
    ("NOI was $850.5 million", {"noi": 850.5}),
    ("total revenue reached $2,345.6 million", {"total_revenue": 2345.6}),
    ("occupancy rate of 95.3%", {"occupancy_rate": 0.953}),
    ("dividend per share of $3.08", {"dividend_per_share": 3.08}),
    ("net debt to EBITDA of 5.2", {"debt_to_ebitda": 5.2}),
    # "4.05." is captured whole (greedy class), does not parse, and no later pattern matches
    ("FFO per share was $4.05.\nOccupancy: 97.1 %\nleased rate of 88%", {"occupancy_rate": 0.971}),
    ("", {}),
    ("nothing to see here", {}),
    ("FFO was $4.05. Later FFO reached $5.10 per share", {"ffo_per_share": 5.10}),
    ("revenue of ,", {}),
    # a no-break space is whitespace for \s, as in Python
    ("Total\u00a0revenue of $7,411 million. Occupancy:\u00a091.2 %", {"total_revenue": 7411.0,
                                                                      "occupancy_rate": 0.912}),
    ("Debt to EBITDA ratio 5.87\nThe debt level", {"debt_to_ebitda": 5.87}),
    ("Total\u00a0revenue of $1.5 billion\r\nFFO\u00a0of 2.25", {"total_revenue": 1500.0, "ffo_per_share": 2.25}),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_fixed_sentences(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(extract_financials(F.col("t")).alias("m")).first()["m"]
    assert got == pytest.approx(expected)
    assert got == pytest.approx(py_extract(text))


WORDS = ["FFO", "ffo", "funds from operations", "per share", "/share", "was", "of", ":", "$", "NOI",
         "net operating income", "total revenue", "revenue", "million", "billion", "occupancy", "rate",
         "leased", "percentage", "%", "dividend", "=", "debt", "to", "EBITDA", "ratio", "x", "Net", "the",
         "4.05", "4.05.", "1,234.5", ",", ".", "12", "0.5", "97.25", "3,100", "\n", "\r", "\u00a0", "\t"]


def random_text(rnd):
    parts = []
    for _ in range(rnd.randint(0, 40)):
        w = rnd.choice(WORDS)
        parts.append(w)
        parts.append(rnd.choice([" ", " ", "", "\u00a0", "\r\n", "  "]))
    return "".join(parts)


def test_random_texts_match_python(spark):
    rnd = random.Random(1234)
    texts = [random_text(rnd) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", extract_financials(F.col("t")).alias("m")).collect()}
    bad = [i for i, t in enumerate(texts) if got[i] != pytest.approx(py_extract(t))]
    assert bad == [], [texts[i] for i in bad[:3]]


def test_single_metric_column(spark):
    df = spark.createDataFrame([("Debt to EBITDA stood near 5.4x",)], "t string")
    assert df.select(extract_metric(F.col("t"), "debt_to_ebitda").alias("d")).first()["d"] == 5.4
