"""Analysis prompt text per REIT (the narrative request sent to a language model).

Only the text is built here, as a column expression; calling a model is not
data work and stays outside the engine.  Numbers are formatted like Python's
format specs (``.1f``, ``.0f``, ``.2f``, ``.0%``); a section is left out when
its input (master row, latest metrics, context) is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reitlens.functions import scalars as S
from reitlens.functions.text import py_fixed, py_percent0, py_str
from reitlens.operators.fundamentals import latest_metric

# ---------------------------------------------------------------------------
# FIXED VALUES — prompt texts
# ---------------------------------------------------------------------------
SHORT_TAIL = "x\n\nProvide concise investment recommendation (2-3 paragraphs)."
PROMPT_TAIL = (
    "\nProvide a 2-3 paragraph investment analysis covering:\n"
    "1. Key strengths and the investment thesis\n"
    "2. Primary risks and concerns\n"
    "3. Actionable recommendation (Buy/Hold/Sell with rationale)\n"
    "Rate your confidence in this analysis (0-100%).\n"
)


#: Passages per REIT in the context, and characters of each.
PASSAGES, PASSAGE_CHARS = 3, 160
_MENTION = r"(?i)(?:ffo|funds from operations)[^\n]*"
_OUTSIDE = r"[^A-Za-z0-9 .,;:%$()-]+"


def filing_context(filings: DataFrame, passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> DataFrame:
    """(reit_ticker, context_json): the newest filings' passages on funds from operations, ``passages`` a REIT.

    A passage is cut to ``chars`` plain characters where the text is read.  The
    rank filter lets every task keep its ``passages`` newest per REIT before the
    shuffle, so a REIT with a third of all filings ships no more than others.
    """
    said = F.substr(F.regexp_replace(F.regexp_extract("text", _MENTION, 0), _OUTSIDE, " "), F.lit(1), F.lit(chars))
    found = filings.select("reit_ticker", "form_type", "filing_date", "accession_number", said.alias("said")).where(F.col("said") != "")
    newest = Window.partitionBy("reit_ticker").orderBy(F.col("filing_date").desc(), F.col("accession_number").desc())
    top = found.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= passages)
    line = F.concat(F.lit('    "'), F.col("form_type"), F.lit(" "), F.col("filing_date").cast("string"), F.lit(": "), F.col("said"), F.lit('"'))
    lists = top.groupBy("reit_ticker").agg(F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), ",\n")
    return lists.select("reit_ticker", F.concat(F.lit('{\n  "filings": [\n'), body, F.lit("\n  ]\n}")).alias("context_json"))


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def render_prompt(signals: DataFrame, reits: DataFrame, metrics: DataFrame,
                  context: DataFrame | None = None) -> DataFrame:
    """``signals`` (``scores.generate_signals``) → (reit_ticker, prompt, short_prompt).

    ``context``: optional (reit_ticker, context_json) with pre-rendered JSON text.
    """
    r = reits.select(F.col("ticker").alias("reit_ticker"), F.col("name").alias("_name"),
                     "sector", "sub_sector", "market_cap", "dividend_yield",
                     "latest_ffo_per_share", "payout_ratio", F.lit(True).alias("_has_r"))
    m = latest_metric(metrics).select(
        "reit_ticker", "fiscal_year", "quarter", "same_store_noi_growth", "ffo_growth_yoy",
        "net_debt_to_ebitda", "ffo_per_share", S.dividend_safety_model("dividend_per_share", "affo_per_share")
        .alias("_safety"), F.lit(True).alias("_has_m"))
    j = signals.join(r, "reit_ticker", "left").join(m, "reit_ticker", "left")
    if context is not None:
        j = j.join(context.select("reit_ticker", "context_json"), "reit_ticker", "left")
    else:
        j = j.withColumn("context_json", F.lit(None).cast("string"))
    nl = F.lit("\n")
    # FIXED VALUES — the labels of the sections below
    head = F.concat(
        F.lit("Analyze "), F.col("reit_ticker"), F.lit(" ("), F.coalesce("_name", F.lit("Unknown")),
        F.lit(") REIT:\n\nComposite Score: "), py_fixed(F.col("composite_score"), 1), F.lit("/100 ("),
        F.col("signal_rating"), F.lit(")\n- Fundamental: "), py_fixed(F.col("fundamental_score"), 0),
        F.lit("/100\n- Valuation: "), py_fixed(F.col("valuation_score"), 0),
        F.lit("/100\n- Momentum: "), py_fixed(F.col("momentum_score"), 0),
        F.lit("/100\n- Macro: "), py_fixed(F.col("macro_score"), 0),
        F.lit("/100\n- Sentiment: "), py_fixed(F.col("sentiment_score"), 0), F.lit("/100\n"))
    master = F.concat(
        F.lit("\nSector: "), F.col("sector"), F.lit(" ("), F.coalesce("sub_sector", F.lit("")),
        F.lit(")\nMarket Cap: $"), py_fixed(_z("market_cap") / F.lit(1e9), 1),
        F.lit("B\nDividend Yield: "), py_fixed(_z("dividend_yield"), 1),
        F.lit("%\nFFO/Share: $"), py_fixed(_z("latest_ffo_per_share"), 2),
        F.lit("\nPayout Ratio: "), py_percent0(_z("payout_ratio")), nl)
    metric = F.concat(
        F.lit("\nLatest Quarter: FY"), F.col("fiscal_year").cast("string"), F.lit(" Q"),
        F.col("quarter").cast("string"),
        F.lit("\nSame-Store NOI Growth: "), py_fixed(_z("same_store_noi_growth"), 1),
        F.lit("%\nFFO Growth YoY: "), py_fixed(_z("ffo_growth_yoy"), 1),
        F.lit("%\nDebt/EBITDA: "), py_fixed(_z("net_debt_to_ebitda"), 1),
        F.lit("x\nDividend Safety: "), F.col("_safety"), nl)
    ctx = F.concat(F.lit("\nAdditional Context:\n"), F.col("context_json"), nl)
    prompt = F.concat(
        head,
        F.when(F.col("_has_r"), master).otherwise(F.lit("")),
        F.when(F.col("_has_m"), metric).otherwise(F.lit("")),
        F.when(F.col("context_json").isNotNull(), ctx).otherwise(F.lit("")),
        F.lit(PROMPT_TAIL))
    short = F.concat(
        F.lit("Analyze REIT "), F.col("reit_ticker"), F.lit(" based on:\n- Composite Score: "), py_str(F.col("composite_score")),
        F.lit("\n- FFO/Share: $"), py_str(F.col("ffo_per_share")), F.lit("\n- NOI Growth: "), py_str(F.col("same_store_noi_growth")),
        F.lit("%\n- Dividend Yield: "), py_str(F.col("dividend_yield")), F.lit("%\n- Debt/EBITDA: "), py_str(F.col("net_debt_to_ebitda")),
        F.lit(SHORT_TAIL))
    return j.select("reit_ticker", prompt.alias("prompt"), short.alias("short_prompt"))
