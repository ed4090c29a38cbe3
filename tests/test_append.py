"""Appends: by key and order, pruned to touched partitions, once per batch; views and streams over stored data."""

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from reitlens.session import ensure_checkpoint_dir
from reitlens.sinks import writers as W
from reitlens.streaming import landed_filings as ST
from tests.conftest import SF_SMALL
from tests.test_late_fetch import explained


def scratch(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/append-{uuid.uuid4().hex}"


SCHEMA = "day string, k int, v string"


def test_append_keeps_earlier_rows_and_repeats_add_nothing(spark):
    path = scratch(spark)
    first = spark.createDataFrame([("d1", 1, "b"), ("d1", 1, "a"), ("d2", 2, "x"), (None, 3, None)], SCHEMA)
    assert W.append_new(first, path, ["day"], ["day", "k"]) == 3
    assert W.append_new(first, path, ["day"], ["day", "k"]) == 0
    again = spark.createDataFrame([("d1", 1, "later"), ("d1", 9, "new"), (None, 3, "late"), (None, 4, "n")], SCHEMA)
    assert W.append_new(again, path, ["day"], ["day", "k"]) == 2
    got = sorted(((r.day, r.k, r.v) for r in spark.read.schema(SCHEMA).parquet(path).collect()), key=str)
    assert got == sorted([("d1", 1, "a"), ("d2", 2, "x"), (None, 3, None), ("d1", 9, "new"), (None, 4, "n")], key=str)


def test_order_decides_which_row_of_a_key_is_kept(spark):
    path = scratch(spark)
    rows = spark.createDataFrame([("d1", 1, "a"), ("d1", 1, "z"), ("d1", 1, "m")], SCHEMA)
    W.append_new(rows, path, ["day"], ["day", "k"], order=[F.when(F.col("v") == "m", 0).otherwise(1)])
    assert [r.v for r in spark.read.parquet(path).collect()] == ["m"]


def test_a_run_lost_before_its_manifest_adds_nothing(spark):
    path = scratch(spark)
    rows = spark.createDataFrame([("d1", i, "a") for i in range(5)], SCHEMA)
    assert W.append_new(rows, path, ["day"], ["day", "k"], batch="one") == 5
    assert W.append_new(rows, path, ["day"], ["day", "k"], batch="two") == 0
    assert W.append_new(rows.limit(0), path, ["day"], ["day", "k"]) == 0
    assert spark.read.parquet(path).count() == 5


@pytest.mark.parametrize("named", [500, 0])
def test_only_touched_partitions_are_compared(spark, monkeypatch, named):
    monkeypatch.setattr(W, "NAMED_PARTITIONS", named)
    path = scratch(spark)
    W.append_new(spark.range(40).select(F.concat(F.lit("d"), F.col("id") % 10).alias("day"), F.col("id").cast("int").alias("k"), F.lit("a").alias("v")), path, ["day"], ["day", "k"])
    batch = spark.createDataFrame([("d3", 100, "x"), ("d4", 4, "y")], SCHEMA)
    near = W.touched(spark.read.schema(SCHEMA).parquet(path), batch, ["day"])
    assert {r.day for r in near.collect()} == {"d3", "d4"}
    if named:
        assert "PartitionFilters: [day" in explained(near).replace("#", " ").replace("day IN", "day IN") or "PartitionFilters: [" in explained(near)
    assert W.append_new(batch, path, ["day"], ["day", "k"]) == 1


def test_stream_keeps_no_state_and_takes_late_filings(spark):
    root = scratch(spark)
    land, sink, ckpt = f"{root}/land", f"{root}/sink", f"{root}/ckpt"
    rows = [("O", "10-K", "2024-02-20", "a1"), ("O", "8-K", "2024-03-20", "a2"), ("O", "10-K", "2019-01-01", "late"), ("O", "10-K", "2024-02-20", "a1"), ("P", "8-K", None, "a4")]
    for i, part in enumerate((rows[:2], rows[1:4], rows[2:])):
        spark.createDataFrame(part, "ticker string, form string, file_date string, accession_no string").write.json(f"{land}/batch={i}")
        q = ST.run_available_now(ST.landed_filings_stream(spark, land), sink, ckpt)
        assert all(p.stateOperators == [] for p in q.recentProgress)
    got = sorted(r.accession for r in spark.read.parquet(sink).collect())
    assert got == ["a1", "a2", "a4", "late"]


def test_views_are_replaced_and_read_by_another_session(spark):
    root, name = scratch(spark), f"v_{uuid.uuid4().hex[:8]}"
    for n in (3, 5):
        W.sink_views(spark, {name: spark.range(n)}, root)
        assert spark.newSession().table(f"default.{name}").count() == n
    spark.sql(f"DROP VIEW default.{name}")
    W.restore_views(spark, root, [name])
    assert spark.newSession().table(f"default.{name}").count() == 5


def test_summary_has_a_row_per_error(spark):
    rows = E.queries()["ingest_summary"](spark, SF_SMALL).collect()
    errors = {r.error for r in rows}
    assert errors == {None, "API call frequency exceeded", "Invalid API call", "Corrupt payload"}
    total = next(r for r in rows if r.ticker == "__total__")
    assert total.records == sum(r.records for r in rows if r.ticker != "__total__")


@pytest.mark.parametrize("name", ["dq_reits", "dq_properties", "dq_metrics", "dq_filings", "dq_indicators"])
def test_every_quality_rule_meets_a_row(spark, name):
    import json

    from reitlens.operators import quality as DQ

    rules = {"dq_reits": DQ.reit_rules, "dq_properties": DQ.property_rules, "dq_metrics": DQ.metric_rules, "dq_filings": DQ.filing_rules, "dq_indicators": DQ.indicator_rules}[name]()
    said = [m for r in E.queries()[name](spark, "/root/testdata/sf0.01").select("dq_errors").where("dq_errors <> '[]'").collect() for m in json.loads(r.dq_errors)]
    kinds = {" ".join(m.split()[:2]) for m in said}
    assert len(kinds) == len(rules)
    assert E.queries()[name](spark, "/root/testdata/sf0.01").where("dq_errors = '[]'").count() > 0


@pytest.mark.parametrize("name", ["dividend_safety", "valuation"])
def test_missing_sides_are_errors(spark, name):
    rows = E.queries()[name](spark, SF_SMALL).collect()
    assert sorted(r.ticker for r in rows if r.error) == ["R4", "R9"] and len(rows) == 10


def test_momentum_is_scored_for_reits_with_prices(spark):
    rows = E.queries()["generate_signal"](spark, SF_SMALL).collect()
    assert sum(r.momentum_score != 50.0 for r in rows) > len(rows) / 2


def test_prompts_hold_context_and_short_form(spark):
    rows = E.queries()["render_prompt"](spark, SF_SMALL).collect()
    assert any("Additional Context:" in r.prompt for r in rows)
    assert any("$N/A" in r.short_prompt for r in rows) and any("$N/A" not in r.short_prompt for r in rows)


BARS = "ticker string, date string, close double"
LANDED = f"{BARS}, run_date string"


def bars_of(spark, tickers, close):
    return spark.createDataFrame([(t, f"2024-01-0{d}", close) for t in tickers for d in (1, 2)], BARS)


def landed_bars(spark, path):
    return sorted((r.ticker, r.run_date, r.date, r.close) for r in spark.read.schema(LANDED).json(path).collect())


def test_landed_prices_take_files_by_bytes_and_replace_their_keys_only(spark, monkeypatch):
    path = scratch(spark)
    tickers = [f"R{i}" for i in range(3 * W.BUCKETS)]
    for close in (1.0, 2.0):
        W.sink_raw_prices(bars_of(spark, tickers, close), path, F.lit("2024-06-28"))
    assert len(spark.read.schema(LANDED).json(path).inputFiles()) <= W.BUCKETS  # before: a folder and a file per ticker
    W.sink_raw_prices(bars_of(spark, tickers[:5], 3.0), path, F.lit("2024-06-28"))
    W.sink_raw_prices(bars_of(spark, tickers[:1], 4.0), path, F.lit("2024-07-28"))
    want = [(t, "2024-06-28", f"2024-01-0{d}", 3.0 if t in tickers[:5] else 2.0) for t in tickers for d in (1, 2)]
    want += [(tickers[0], "2024-07-28", f"2024-01-0{d}", 4.0) for d in (1, 2)]
    assert landed_bars(spark, path) == sorted(want)


def test_a_replacement_lost_before_the_old_files_go_is_mended_by_its_repetition(spark, monkeypatch):
    path = scratch(spark)
    monkeypatch.setattr(W, "BUCKETS", 2)
    W.sink_raw_prices(bars_of(spark, "abcdef", 1.0), path, F.lit("2024-06-28"))
    with monkeypatch.context() as lost:
        real = W._file_system
        lost.setattr(W, "_file_system", lambda s, p: real(s, p) if p == path else (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            W.sink_raw_prices(bars_of(spark, "ab", 2.0), path, F.lit("2024-06-28"))
    assert len(landed_bars(spark, path)) > 12
    W.sink_raw_prices(bars_of(spark, "ab", 2.0), path, F.lit("2024-06-28"))
    assert landed_bars(spark, path) == [(t, "2024-06-28", f"2024-01-0{d}", 2.0 if t in "ab" else 1.0) for t in "abcdef" for d in (1, 2)]


def test_landed_filings_take_files_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(W, "BUCKETS", 4)
    path, out = scratch(spark), scratch(spark)
    rows = spark.range(200).select(F.concat(F.lit("R"), "id").alias("ticker"), F.when(F.col("id") % 2 == 0, "10-K").otherwise("8-K").alias("form_type"),
                                   F.lit("2024-02-20").alias("filing_date"), F.concat(F.lit("a"), "id").alias("accession"))
    W.sink_raw_filings(rows.where("id < 150"), path)
    W.sink_raw_filings(rows, path)
    landed = spark.read.schema("filing_date string, accession string, ticker string, form_type string").json(path)
    assert len(landed.inputFiles()) <= 2 * 2 * W.BUCKETS  # before: a folder and a file per ticker and form
    assert sorted(tuple(r) for r in landed.select(*rows.columns).collect()) == sorted(tuple(r) for r in rows.collect())
    ST.run_available_now(ST.landed_filings_stream(spark, path), out, f"{out}-ckpt")
    assert {(r.ticker, r.form_type, r.accession) for r in spark.read.parquet(out).collect()} == {(r.ticker, r.form_type, r.accession) for r in rows.collect()}


def test_signals_of_all_writes_come_from_one_report(spark, monkeypatch):
    read = []
    real = W.sink_signals
    monkeypatch.setattr(W, "sink_signals", lambda rows, path: (read.append({f.rsplit("/", 1)[0] for f in rows.inputFiles()}), real(rows, path)))
    rows = E.queries()["sink_signals"](spark, SF_SMALL).collect()
    assert len(rows) == 2 * len({r.ticker for r in rows})
    assert len(read) == 4 and len(set().union(*read)) == 1 and "report-" in next(iter(read[0]))  # before: every write read the lake


def test_both_versions_of_the_views_come_from_one_computation(spark, monkeypatch):
    read = []
    real = W.sink_views
    monkeypatch.setattr(W, "sink_views", lambda s, views, root: (read.append({n: {f.rsplit("/", 1)[0] for f in df.inputFiles()} for n, df in views.items()}), real(s, views, root)))
    rows = E.queries()["sink_views"](spark, SF_SMALL).collect()
    assert len(rows) == 3 and all(r.n_rows > 1 for r in rows)
    assert len(read) == 2 and read[0] == read[1]
    assert all(len(places) == 1 and f"/{name}-" in next(iter(places)) for name, places in read[0].items())  # before: both versions read the lake


@pytest.mark.parametrize("name", ["dividend_safety", "valuation"])
def test_a_missing_side_is_an_error_of_the_operator(spark, name):
    from reitlens.operators import peers as PE
    from reitlens.sources import bind
    from reitlens.sources.tables import lake_for

    lake = lake_for(spark, SF_SMALL)
    rows = getattr(PE, name)(bind.reits(lake, listed_only=True), bind.financial_metrics(lake, reporting_only=True)).collect()
    assert sorted(r.ticker for r in rows if r.error) == ["R4", "R9"] and len(rows) == 10
