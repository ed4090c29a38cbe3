"""Peer comparison, benchmarks, dividend safety and valuation on a 5-REIT fixture."""

import pytest

from reitlens.operators import fundamentals as FU
from reitlens.operators import peers as PE

REITS = [("O", "Realty", "Retail", "Net Lease", 45e9, 5.8, 0.76, 4.05),
         ("SPG", "Simon", "Retail", "Mall", 55e9, 4.5, 0.68, 12.30),
         ("PLD", "Prologis", "Industrial", "Logistics", 120e9, 2.9, 0.58, 6.15),
         ("EQIX", "Equinix", "DataCenter", "Colocation", 80e9, 2.1, 0.48, 33.50),
         ("DLR", "Digital", "DataCenter", "Data Center", 48e9, 3.2, 0.60, 7.40)]
RSCHEMA = ("ticker string, name string, sector string, sub_sector string, market_cap double, "
           "dividend_yield double, payout_ratio double, latest_ffo_per_share double")
MSCHEMA = ("reit_ticker string, period string, fiscal_year int, quarter int, same_store_noi double, "
           "same_store_noi_growth double, ffo_per_share double, affo_per_share double, ffo_growth_yoy double, "
           "net_debt_to_ebitda double, interest_coverage double, weighted_avg_cap_rate double, "
           "dividend_per_share double, dividend_growth_yoy double")
METRICS = [("O", "2024Q3", 2024, 3, 800.0, 3.5, 1.05, 1.00, 5.0, 5.5, 4.2, 0.065, 0.77, 3.0),
           ("SPG", "2024Q3", 2024, 3, 1400.0, 4.2, 3.10, 2.90, 6.0, 5.8, 3.5, 0.06, 2.05, 5.0),
           ("PLD", "2024Q3", 2024, 3, 1500.0, 6.0, 1.55, 1.40, 9.0, 4.9, 6.0, 0.045, 0.96, 8.0),
           ("EQIX", "2024Q3", 2024, 3, 1100.0, 4.5, 8.60, 8.20, 7.0, 3.5, 7.0, 0.05, 4.26, 10.0),
           ("DLR", "2024Q3", 2024, 3, 600.0, 5.0, 1.85, 1.70, 4.0, 6.0, 3.0, 0.055, 1.22, 2.0),
           ("O", "2024Q2", 2024, 2, 790.0, 3.2, 1.04, 0.99, 4.5, 5.5, 4.2, 0.065, 0.77, 3.0)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(REITS, RSCHEMA), spark.createDataFrame(METRICS, MSCHEMA)


def test_latest_metric_newest_first(data):
    _, m = data
    got = {r["reit_ticker"]: r["period"] for r in FU.latest_metric(m).collect()}
    assert got["O"] == "2024Q3" and len(got) == 5


def test_peer_comparison(data):
    r, m = data
    got = {x["ticker"]: x.asDict() for x in PE.peer_comparison(r, m).collect()}
    eq = got["EQIX"]
    assert (eq["ffo_rank"], eq["noi_growth_rank"], eq["dividend_yield_rank"], eq["peer_count"]) == (1, 2, 2, 1)
    assert eq["ffo_vs_peers"] == round(8.60 - 1.85, 2)
    assert eq["avg_peer_leverage"] == 6.0
    pld = got["PLD"]  # alone in its sector
    assert (pld["peer_count"], pld["ffo_rank"], pld["ffo_vs_peers"]) == (0, 1, None)


def test_sector_benchmarks_latest_rows(data):
    r, m = data
    got = {x["sector"]: x.asDict() for x in PE.agg_sector_benchmarks(r, m).collect()}
    assert got["Retail"]["reit_count"] == 2
    assert got["Retail"]["avg_ffo"] == round((1.05 + 3.10) / 2, 2)
    assert got["DataCenter"]["avg_cap_rate"] == round((0.05 + 0.055) / 2, 4)


def test_dividend_safety(data):
    r, m = data
    got = {x["ticker"]: x.asDict() for x in PE.dividend_safety(r, m).collect()}
    o = got["O"]
    assert o["affo_payout_ratio"] == 0.77
    assert o["dividend_safety"] == "Moderate"
    assert o["ffo_growth_vs_div_growth"] == 2.0
    # payout 0.77 -> +10, spread 2.0 -> +5 (not > 2), growth 5.0 -> 0
    assert o["safety_score"] == 65.0 and o["risk_level"] == "Moderate"


def test_valuation_and_missing(spark, data):
    r, m = data
    extra = m.unionByName(spark.createDataFrame([("ZZZ", "2024Q3", 2024, 3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0,
                                                  1.0, 0.1, 1.0, 1.0)], MSCHEMA))
    got = {x["ticker"]: x.asDict() for x in PE.valuation(r, extra).collect()}
    o = got["O"]
    assert o["ffo_yield"] == round(5.8 / 0.76 * 100, 2)
    assert o["p_ffo"] == round(1 / (5.8 / 0.76), 2)
    assert o["avg_sector_yield"] == 4.5 and o["dividend_yield_vs_sector"] == 1.3
    assert o["ev_ebitda"] == round(45e9 / (800.0 * 1.15 * 1e6), 1)
    assert got["PLD"]["avg_sector_yield"] == 2.9  # alone: own yield
    assert got["ZZZ"]["error"] == "Insufficient data"


def test_sector_peers_point_query(spark, data):
    r, _ = data
    assert [x["peer_ticker"] for x in PE.sector_peers(r, [" eqix "]).collect()] == ["DLR"]


def test_join_latest_metric_keeps_reits_without_metrics(spark, data):
    r, m = data
    r2 = r.unionByName(spark.createDataFrame([("NEW", "n", "Office", "x", 1.0, 1.0, 0.5, 1.0)], RSCHEMA))
    got = {x["ticker"]: x["ffo_per_share"] for x in FU.join_latest_metric(r2, m.withColumn("total_revenue", m.same_store_noi)).collect()}
    assert got["NEW"] is None and got["O"] == 1.05
