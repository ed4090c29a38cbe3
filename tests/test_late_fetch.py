"""Late fetch: the bitmap drops no chosen key, texts stay out of exchanges, failed downloads show."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from reitlens.operators import fetch
from tests.conftest import SF_SMALL


def explained(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def exchanged(plan: str) -> str:
    """Columns that go into the plan's exchanges."""
    return " ".join(re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan))


@pytest.mark.parametrize("limit", [0, fetch.KEY_BYTES])
def test_late_fetch_equals_a_join(spark, limit):
    source = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    chosen = spark.range(0, 6000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("more"))
    got = fetch.late_fetch(chosen, source, "k", [F.length("text").alias("n"), F.upper("text").alias("big")], limit)
    want = chosen.join(source, "k", "left").select("k", "more", F.length("text").alias("n"), F.upper("text").alias("big"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_bitmap_keeps_chosen_keys_and_few_others(spark):
    chosen = spark.range(0, 100_000, 50).select(F.concat(F.lit("key"), "id").alias("k"))
    source = spark.range(100_000).select(F.concat(F.lit("key"), "id").alias("k"))
    near = fetch.may_be_chosen(source, "k", *fetch.key_bitmap(chosen, "k", 2000))
    assert near.join(chosen, "k").count() == 2000 and near.count() < 2000 + 100_000 * 0.1


@pytest.mark.parametrize("limit", [0, fetch.KEY_BYTES])
def test_texts_are_not_exchanged(spark, monkeypatch, limit):
    monkeypatch.setattr(fetch.late_fetch, "__defaults__", (limit,))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = explained(E.queries()["ingest_filings"](spark, SF_SMALL))
        assert exchanged(plan) and not re.search(r"\btext#", exchanged(plan))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_failed_and_parsed_filings(spark):
    rows = E.queries()["ingest_filings"](spark, SF_SMALL).collect()
    assert {r.status for r in rows} == {"Parsed", "Failed"}
    assert all((r.file_size_bytes == 0) == (r.status == "Failed") == (r.error_message != "") for r in rows)


def test_filing_text_scan_opens_only_the_wanted_folders(spark):
    from reitlens.session import ensure_checkpoint_dir
    from reitlens.sources import filing_files as FT

    root = f"{ensure_checkpoint_dir(spark)}/texts-test"
    filings = spark.createDataFrame([(str(i), f"0-1-{i}", f"d{i}.htm", t) for i, t in enumerate(["a\nb\n", "c d", None, "", "e\r\nf"])],
                                    "cik string, accession_number string, primary_document string, text string")
    FT.land_texts(filings, root)
    every = FT.scan_filing_text(spark, root).collect()
    assert sorted((r.cik, r.accession, r.document, r.text) for r in every) == [
        ("0000000000", "010", "d0.htm", "a\nb\n"), ("0000000001", "011", "d1.htm", "c d"), ("0000000004", "014", "d4.htm", "e\r\nf")]
    wanted = FT.keyed(filings.where("cik in ('1', '2')")).select("cik", "accession", "document", F.lit(9).alias("own"))
    got = FT.scan_filing_text(spark, root, wanted)
    assert [(r.cik, r.text, r.own) for r in got.collect()] == [("0000000001", "c d", 9)]
    assert re.search(r"PartitionFilters: \[.*cik.*0000000001", explained(got))
