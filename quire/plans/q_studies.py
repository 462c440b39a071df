"""Final tables of the composed case studies, as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.scalars import r6
from quire.plans import case_studies as cs
from quire.plans.catalog import register
from quire.plans.standins import INVESTMENTS_SQL

_INVESTMENT_SQL = f"""
WITH {INVESTMENTS_SQL},
chosen AS (SELECT round_type FROM investments GROUP BY 1 HAVING avg(amount) BETWEEN 20000 AND 60000
           ORDER BY avg(amount) DESC, round_type LIMIT 1),
typed AS (SELECT * FROM investments WHERE round_type = (SELECT round_type FROM chosen)),
win AS (SELECT * FROM typed WHERE amount BETWEEN 5000 AND 50000),
sectors AS (SELECT country, sector, count(*) AS n, sum(amount) AS total,
                   row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, sector) AS sector_rank FROM win GROUP BY 1, 2),
companies AS (SELECT w.country, s.sector_rank, w.sector, w.company, sum(w.amount) AS company_total,
                     row_number() OVER (PARTITION BY w.country, s.sector_rank ORDER BY sum(w.amount) DESC, w.company) AS rn
              FROM win w JOIN sectors s ON w.country = s.country AND w.sector = s.sector AND s.sector_rank <= 2
              GROUP BY 1, 2, 3, 4)"""


def _investment(spark, d):
    return cs.investment_study(spark, d, mean_lo=20000, mean_hi=60000)


@register("investment_study_countries", sql=_INVESTMENT_SQL + """
SELECT country, round(sum(amount), 2) AS total FROM typed GROUP BY country ORDER BY sum(amount) DESC, country LIMIT 9""")
def q_investment_countries(spark, d):
    """The nine countries with most funding of the chosen type."""
    return _investment(spark, d)["top_countries"].select("country", r6("total", 2).alias("total"))


@register("investment_study_companies", sql=_INVESTMENT_SQL + """
SELECT country, CAST(sector_rank AS BIGINT) AS sector_rank, sector, company, round(company_total, 2) AS company_total
FROM companies WHERE rn = 1""")
def q_investment_companies(spark, d):
    """The best funded company of every country's two leading sectors."""
    return _investment(spark, d)["top_companies"].select(
        "country", F.col("sector_rank").cast("long").alias("sector_rank"), "sector", "company",
        r6("company_total", 2).alias("company_total"))


@register("credit_scoring_study")
def q_credit_scoring(spark, d):
    """The chosen scorecard on the hold-out: evaluator's record and financial benefit in one row."""
    out = cs.credit_scoring_study(spark, d)
    record = out["evaluation"].first()
    return out["benefit"].withColumns({c: F.lit(record[c]) for c in ("cutoff", "accuracy", "sensitivity", "specificity")})


@register("credit_scoring_study_cutoffs")
def q_credit_scoring_cutoffs(spark, d):
    """Default rate, exposure and lost customers of the chosen scorecard at every cutoff."""
    return cs.credit_scoring_study(spark, d)["cutoffs"]


@register("forecasting_study")
def q_forecasting(spark, d):
    """Hold-out MAPE of the models for the two steadiest segments and both measures."""
    return cs.forecasting_study(spark, d)["mape"]


@register("digits_study")
def q_digits(spark, d):
    """Confusion of the machines for all class pairs, fitted on a sample and judged on every row."""
    return cs.digits_study(spark, d)["confusion"]
