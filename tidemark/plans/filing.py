"""How late and how regularly filers file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions.columns import next_weekday
from tidemark.operators import bitemporal as ops
from tidemark.operators import ranks
from tidemark.plans import tables as t
from tidemark.plans.registry import query
from tidemark.plans.marts import COMPANY, FILING, company
from tidemark.plans.marts import filing as filings
from tidemark.sources.store import stored


_PERIODIC = "form_type in ('10-K', '10-Q', '10-K/A', '10-Q/A') and filer_status is not null and filing_lag_days between 0 and 1095"
_MATCHED = f"""f as (select *, replace(form_type, '/A', '') as base_form from filing where {_PERIODIC}),
    hit as (select x.adsh, arg_max(o.adsh, (o.filed_date, -o.adsh::bigint)) as matched_adsh, max(o.filed_date) as matched_filed_date from f x join f o on o.cik = x.cik and o.base_form = x.base_form and o.period_end_date = x.period_end_date and not o.is_amendment
        and o.filed_date <= x.filed_date where x.is_amendment group by 1),
    matched as (select x.adsh, x.cik, x.form_type, x.base_form, x.filer_status, x.filed_date, matched_adsh, matched_filed_date, (x.filed_date - matched_filed_date)::int as gap_days from f x left join hit using (adsh) where x.is_amendment)"""


def reporting(spark, sf) -> DataFrame:
    """Periodic reports with a status and a plausible lag."""
    return filings(spark, sf).where(_PERIODIC).withColumn("base_form", F.replace("form_type", F.lit("/A"), F.lit("")))


@stored
def matched(spark, sf) -> DataFrame:
    """Each amendment beside the last original of its company, form and period filed on or before it."""
    rows = reporting(spark, sf)
    found = ops.latest_before(rows.where("is_amendment"), rows.where("not is_amendment"), ["cik", "base_form", "period_end_date"], "filed_date", "adsh", ["filed_date"])
    return found.select("adsh", "cik", "form_type", "base_form", "filer_status", "filed_date", "matched_adsh", "matched_filed_date", F.datediff("filed_date", "matched_filed_date").alias("gap_days"))


@query(f"with {t.SUB}, {FILING}, {_MATCHED} select * from matched")
def jn07_latest_original(spark, sf):
    return matched(spark, sf)


@query(f"""with {t.SUB}, {FILING}, {_MATCHED}, l as (select form_type, filer_status, any_value(filer_status_name) as filer_status_name, count(*) as filings, round(avg(filing_lag_days), 4) as mean_lag_days, {", ".join(f"round(quantile_cont(filing_lag_days, {q}), 4) as {n}_lag_days" for n, q in (("median", 0.5), ("p90", 0.9)))},
        min(filing_lag_days) as min_lag_days, max(filing_lag_days) as max_lag_days from f group by 1, 2),
    g as (select form_type, filer_status, count(*) as n_amendments, count(matched_adsh) as n_matched_to_original, round(quantile_cont(gap_days, 0.5), 4) as median_days_original_to_amendment, round(quantile_cont(gap_days, 0.9), 4) as p90_days_original_to_amendment,
        min(gap_days) as min_days_original_to_amendment, max(gap_days) as max_days_original_to_amendment from matched group by 1, 2),
    o as (select form_type, filer_status, count(*) as n_originals, count(*) filter (where was_later_amended) as n_flagged_later_amended, count(*) filter (where adsh in (select matched_adsh from matched where matched_adsh is not null)) as n_observed_amended from f where not is_amendment group by 1, 2)
    select *, replace(form_type, '/A', '') as base_form_type, form_type like '%/A' as is_amendment_form, round(100.0 * n_flagged_later_amended / n_originals, 4)::double as pct_flagged_later_amended, round(100.0 * n_observed_amended / n_originals, 4)::double as pct_observed_amended
    from l left join g using (form_type, filer_status) left join o using (form_type, filer_status)""")
def m24_lag_by_form(spark, sf):
    """Lags by form and status; how long originals stood before their amendments; and how often originals are amended."""
    keys, lag, gap, original = ["form_type", "filer_status"], F.col("filing_lag_days"), F.col("gap_days"), ~F.col("is_amendment")
    at = lambda c, q: F.round(F.percentile(c, q), 4)  # noqa: E731  of whole days, so few values
    pairs = matched(spark, sf)
    seen = pairs.where("matched_adsh is not null").select(F.col("matched_adsh").alias("adsh"), F.lit(1).alias("seen")).distinct()
    some = lambda c: F.when(F.count_if(original) > 0, c)  # noqa: E731  forms without originals have no such counts
    lags = reporting(spark, sf).join(seen, "adsh", "left").groupBy(*keys).agg(
        F.first("filer_status_name").alias("filer_status_name"), F.count("*").alias("filings"), F.round(F.avg(lag), 4).alias("mean_lag_days"), at(lag, 0.5).alias("median_lag_days"), at(lag, 0.9).alias("p90_lag_days"), F.min(lag).alias("min_lag_days"), F.max(lag).alias("max_lag_days"),
        F.nullif(F.count_if(original), F.lit(0)).alias("n_originals"), some(F.count_if(original & F.col("was_later_amended"))).alias("n_flagged_later_amended"), some(F.count(F.when(original, F.col("seen")))).alias("n_observed_amended"),
    )
    gaps = pairs.groupBy(*keys).agg(F.count("*").alias("n_amendments"), F.count("matched_adsh").alias("n_matched_to_original"), at(gap, 0.5).alias("median_days_original_to_amendment"), at(gap, 0.9).alias("p90_days_original_to_amendment"), F.min(gap).alias("min_days_original_to_amendment"), F.max(gap).alias("max_days_original_to_amendment"))
    share = lambda c: F.round(F.lit(100.0) * F.col(c) / F.col("n_originals"), 4)
    return lags.join(gaps, keys, "left").withColumns({"base_form_type": F.replace("form_type", F.lit("/A"), F.lit("")), "is_amendment_form": F.endswith("form_type", F.lit("/A")), "pct_flagged_later_amended": share("n_flagged_later_amended"), "pct_observed_amended": share("n_observed_amended")})


@query(f"""with {t.SUB}, q as (select form_type, filer_status, date_trunc('quarter', filed_date)::date as filed_quarter, count(*) as filings, avg(filing_lag_days) as mean, quantile_cont(filing_lag_days, 0.5) as median, quantile_cont(filing_lag_days, 0.9) as p90
    from sub where {_PERIODIC} group by 1, 2, 3), i as (select *, row_number() over (partition by form_type, filer_status order by filed_quarter) as idx from q),
    c as (select *, count(*) over p as n_in_series, avg(median) over k as trail, count(*) over k as available, lag(median, 4) over o as year_before, regr_slope(median, idx) over p as slope, regr_r2(median, idx) over p as r2, stddev_samp(median) over p as dev from i
        window p as (partition by form_type, filer_status), o as (partition by form_type, filer_status order by filed_quarter), k as (partition by form_type, filer_status order by filed_quarter rows between 4 preceding and 1 preceding))
    select form_type, filer_status, filed_quarter, idx::int as quarter_index, n_in_series as n_quarters_in_series, filings, round(mean, 4) as mean_lag_days, round(median, 4) as median_lag_days, round(p90, 4) as p90_lag_days, round(trail, 4) as trailing_mean_median_lag_days,
    round(median - trail, 4) as delta_vs_trailing_mean_days, round(year_before, 4) as median_lag_days_same_quarter_last_year, round(median - year_before, 4) as delta_vs_same_quarter_last_year, round(slope, 4) as slope_days_per_quarter, round(slope * 4, 4) as trend_days_per_year,
    round(r2, 4) as trend_r_squared, round(dev, 4) as series_stddev_days, available = 4 as has_full_trailing_window, case when r2 >= 0.5 and slope > 0 then 'slower' when r2 >= 0.5 and slope < 0 then 'faster' else 'no trend distinguishable from seasonality' end as trend_reading from c""")
def m25_lag_trend(spark, sf):
    """Median lags by quarter of filing, against the year before and a straight line through the whole series."""
    keys = ["form_type", "filer_status"]
    rows = reporting(spark, sf).withColumn("filed_quarter", F.trunc("filed_date", "quarter"))
    per = rows.groupBy(*keys, "filed_quarter").agg(F.count("*").alias("filings"), F.avg("filing_lag_days").alias("mean"), F.percentile("filing_lag_days", 0.5).alias("median"), F.percentile("filing_lag_days", 0.9).alias("p90"))
    line, series = Window.partitionBy(*keys).orderBy("filed_quarter"), Window.partitionBy(*keys)
    cycle = line.rowsBetween(-DEFAULT.season, -1)
    per = per.withColumn("quarter_index", F.row_number().over(line))
    per = per.withColumns({"trailing": F.avg("median").over(cycle), "year_before": F.lag("median", DEFAULT.season).over(line), "slope": F.regr_slope("median", "quarter_index").over(series), "r2": F.regr_r2("median", "quarter_index").over(series)})
    fits = F.col("r2") >= DEFAULT.fit_bar
    reading = F.when(fits & (F.col("slope") > 0), "slower").when(fits & (F.col("slope") < 0), "faster").otherwise("no trend distinguishable from seasonality")
    r = lambda c, n: F.round(c, 4).alias(n)
    median = F.col("median")
    return per.select(
        *keys, "filed_quarter", "quarter_index", F.count("*").over(series).alias("n_quarters_in_series"), "filings", r("mean", "mean_lag_days"), r("median", "median_lag_days"), r("p90", "p90_lag_days"), r("trailing", "trailing_mean_median_lag_days"),
        r(median - F.col("trailing"), "delta_vs_trailing_mean_days"), r("year_before", "median_lag_days_same_quarter_last_year"), r(median - F.col("year_before"), "delta_vs_same_quarter_last_year"), r("slope", "slope_days_per_quarter"), r(F.col("slope") * 4, "trend_days_per_year"),
        r("r2", "trend_r_squared"), r(F.stddev_samp("median").over(series), "series_stddev_days"), (F.count("*").over(cycle) == DEFAULT.season).alias("has_full_trailing_window"), reading.alias("trend_reading"),
    )


MARGINS = f"""
{t.SUB}, d as (select *, case when form_type = '10-K' then case filer_status when '1-LAF' then 60 when '2-ACC' then 75 else 90 end else case when filer_status in ('1-LAF', '2-ACC') then 40 else 45 end end as days
        from sub where form_type in ('10-K', '10-Q')),
    m as (select *, ((period_end_date + days::int) + case isodow(period_end_date + days::int) when 6 then 2 when 7 then 1 else 0 end - filed_date)::int as margin from d)"""


def margins(spark, sf) -> DataFrame:
    """Annual and quarterly reports with `margin`, the days from filing to the due date."""
    k = F.col("form_type") == "10-K"
    days = F.when(k, F.when(F.col("filer_status") == "1-LAF", 60).when(F.col("filer_status") == "2-ACC", 75).otherwise(90)).otherwise(F.when(F.col("filer_status").isin("1-LAF", "2-ACC"), 40).otherwise(45))
    return t.submissions(spark, sf).where(F.col("form_type").isin("10-K", "10-Q")).withColumn("margin", F.datediff(next_weekday(F.date_add("period_end_date", days)), "filed_date"))


_DEADLINE = f"""{COMPANY}, f as (select *, margin <= 1 as at_deadline, row_number() over (partition by cik order by filed_date, adsh) as seq from m),
    i as (select *, seq - row_number() over (partition by cik order by seq) as island from f where at_deadline),
    runs as (select cik, island, count(*) as n, min(period_end_date) as a, max(period_end_date) as b from i group by 1, 2),
    r as (select cik, count(*) as n_runs, max(n) as longest, first(a order by n desc, a) as run_a, first(b order by n desc, a) as run_b from runs group by 1),
    c as (select cik, count(*) as n_filings, count(*) filter (where form_type = '10-K') as n_annual_filings, count(*) filter (where at_deadline) as n_deadline_filings, count(*) filter (where margin < 0) as n_late_filings, min(period_end_date) as first_period, max(period_end_date) as last_period,
        quantile_cont(margin, 0.5) as median, min(margin) as min_margin_days, max(margin) as max_margin_days from f group by 1),
    st as (select cik, first(filer_status order by n desc, filer_status) as predominant_filer_status from (select cik, filer_status, count(*) as n from m where filer_status is not null group by 1, 2) group by 1),
    k as (select cik, ntile(10) over (order by median, n_deadline_filings / n_filings desc, cik)::int as margin_decile from c where n_filings >= 4),
    deadline as (select c.* exclude (median), company_name, sic_code, predominant_filer_status, round(median, 4) as median_margin_days, round(100.0 * n_deadline_filings / n_filings, 4)::double as pct_filings_at_deadline, round(100.0 * n_late_filings / n_filings, 4)::double as pct_filings_late,
        coalesce(n_runs, 0) as n_deadline_runs, coalesce(longest, 0) as longest_run_filings, run_a as longest_run_start_period, run_b as longest_run_end_period, margin_decile, n_filings >= 4 as is_rankable,
        case when n_deadline_filings = 0 then 'never_at_deadline' when n_deadline_filings = 1 then 'isolated' when longest >= 3 then 'habitual' when n_runs >= 3 then 'episodic' else 'intermittent' end as deadline_pattern
        from c left join r using (cik) left join st using (cik) left join k using (cik) left join (select cik, company_name, sic_code from company where is_current) using (cik))"""


def punctuality(spark, sf) -> DataFrame:
    """Companies with their filings, those at the deadline, runs of these and spread of margins; `deadline_pattern` tells them apart."""
    rows = margins(spark, sf).withColumn("at_deadline", F.col("margin") <= DEFAULT.deadline_margin)
    best = F.min_by(F.struct("run_length", "run_start", "run_end"), F.struct((-F.col("run_length")).alias("n"), "run_start")).alias("best")
    runs = ops.islands(rows, "cik", ["filed_date", "adsh"], "at_deadline", "period_end_date").groupBy("cik").agg(F.count("*").alias("n_runs"), best)
    margin = F.col("margin")
    status = F.expr("mode() within group (order by filer_status)").alias("predominant_filer_status")
    per = rows.groupBy("cik").agg(
        F.count("*").alias("n_filings"), F.count_if(F.col("form_type") == "10-K").alias("n_annual_filings"), F.count_if("at_deadline").alias("n_deadline_filings"), F.count_if(margin < 0).alias("n_late_filings"), F.min("period_end_date").alias("first_period"), F.max("period_end_date").alias("last_period"),
        F.percentile(margin, 0.5).alias("median"), F.min(margin).alias("min_margin_days"), F.max(margin).alias("max_margin_days"), status,
    )
    per = per.join(runs, "cik", "left").withColumns({"longest_run_filings": F.coalesce("best.run_length", F.lit(0)), "n_deadline_runs": F.coalesce("n_runs", F.lit(0))})
    n = F.col("n_deadline_filings")
    pattern = F.when(n == 0, "never_at_deadline").when(n == 1, "isolated").when(F.col("longest_run_filings") >= DEFAULT.run_length, "habitual").when(F.col("n_deadline_runs") >= 3, "episodic").otherwise("intermittent")
    return per.withColumn("deadline_pattern", pattern)


@query(f"with {MARGINS}, {_DEADLINE} select * from deadline")
def m26_deadline_filers(spark, sf):
    """Companies by how close to their due dates they file, and how steadily."""
    names = company(spark, sf).where("is_current").select("cik", "company_name", "sic_code")
    per = punctuality(spark, sf).join(names, "cik", "left").withColumns({"is_rankable": F.col("n_filings") >= DEFAULT.rank_floor, "rate": F.col("n_deadline_filings") / F.col("n_filings")})
    # ranked companies alone, so that others take no place
    per = ranks.tiles(per, ["is_rankable"], DEFAULT.buckets, "decile", F.col("median"), F.desc("rate"), F.col("cik"))
    decile = F.when(F.col("is_rankable"), F.col("decile"))
    return per.select(
        "cik", "company_name", "sic_code", "predominant_filer_status", "n_filings", "n_annual_filings", "first_period", "last_period", F.round("median", 4).alias("median_margin_days"), "min_margin_days", "max_margin_days", "n_deadline_filings", "n_late_filings",
        F.round(F.lit(100.0) * F.col("rate"), 4).alias("pct_filings_at_deadline"), F.round(F.lit(100.0) * F.col("n_late_filings") / F.col("n_filings"), 4).alias("pct_filings_late"), "n_deadline_runs", "longest_run_filings",
        F.col("best.run_start").alias("longest_run_start_period"), F.col("best.run_end").alias("longest_run_end_period"), decile.alias("margin_decile"), "is_rankable", "deadline_pattern",
    )
