"""Breakdowns of facts, rules and revisions: bands, key and scale sensitivity, samples, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FACT_KEY
from tidemark.operators import bitemporal as ops
from tidemark.plans import features, filing, quality, restated
from tidemark.plans import tables as t
from tidemark.plans.registry import ORACLES, query
from tidemark.plans.marts import _KEY, REPORTS, RESTATED, changes, restatements

#: Whole powers of ten between two values of a fact that speak of a changed scale.
_POWERS = (-3, -2, -1, 1, 2, 3)
#: How far a ratio may lie from a whole number to count as a split; a choice of this library.
_NEAR = 0.005


def _inner(name: str) -> str:
    """The SQL of another query as a derived table."""
    return f"({ORACLES[name]})"


@query(f"""with {t.NUM} select case when qtrs <= 80 then '41 to 80' when qtrs <= 200 then '81 to 200' else 'over 200' end as band, count(*) as n_facts, count(distinct adsh) as n_filings, count(distinct tag) as n_tags from num where qtrs > 40 group by 1""")
def d02_duration_bands(spark, sf):
    """Facts of implausible duration, by quarters."""
    q = F.col("qtrs")
    band = F.when(q <= 80, "41 to 80").when(q <= 200, "81 to 200").otherwise("over 200")
    return t.numeric(spark, sf).where(q > DEFAULT.longest_duration).groupBy(band.alias("band")).agg(F.count("*").alias("n_facts"), F.count_distinct("adsh").alias("n_filings"), F.count_distinct("tag").alias("n_tags"))


_GAPS = {"exact": "gap = 0", "to 0.1 %": "gap <= 0.001", "0.1 to 1 %": "gap <= 0.01", "1 to 10 %": "gap <= 0.1", "over 10 %": "true"}


@query(f"""select form, case when gap is null then 'open' {" ".join(f"when {c} then '{n}'" for n, c in _GAPS.items())} end as band, count(*) as n from
    (select 'total' as form, total_pct_gap as gap from {_inner("m11_balance_sheet_identity")} union all select 'components', component_pct_gap from {_inner("m11_balance_sheet_identity")}) group by 1, 2""")
def d03_gap_bands(spark, sf):
    """Balance gaps by size, against the reported total and against the components."""
    both = F.array(*(F.struct(F.lit(n).alias("form"), F.col(c).alias("gap")) for n, c in (("total", "total_pct_gap"), ("components", "component_pct_gap"))))
    band = F.when(F.col("gap").isNull(), "open")
    for name, test in _GAPS.items():
        band = band.when(F.expr(test), name)
    return quality.identity(spark, sf).select(F.inline(both)).groupBy("form", band.alias("band")).agg(F.count("*").alias("n"))


@query(f"""select coalesce(filer_status, 'none') as status, rules_failed, count(*) as n_filers, round(avg(avg(rules_failed)) over (partition by coalesce(filer_status, 'none')), 6) as unweighted_mean, (sum(count(*)) over (partition by coalesce(filer_status, 'none')))::bigint as n_of_status
    from {_inner("m13_filer_concentration")} group by 1, 2""")
def d04_rules_failed(spark, sf):
    """Companies by status and number of rules that they break."""
    status = Window.partitionBy("status")
    per = quality.m13_filer_concentration(spark, sf).groupBy(F.coalesce("filer_status", F.lit("none")).alias("status"), "rules_failed").agg(F.count("*").alias("n_filers"))
    return per.withColumns({"unweighted_mean": F.round(F.avg("rules_failed").over(status), 6), "n_of_status": F.sum("n_filers").over(status)})


@query(f"""with {t.FACT}, m as (select tag, taxonomy_version, count(distinct unit_of_measure) as n from fact group by 1, 2)
    select tag = 'T3' as is_custom, count(*) as n_tags, count(*) filter (where n > 1) as n_mixed from m group by 1""")
def d05_mixed_units(spark, sf):
    per = t.facts(spark, sf).groupBy("tag", "taxonomy_version").agg(F.count_distinct("unit_of_measure").alias("n"))
    return per.groupBy((F.col("tag") == "T3").alias("is_custom")).agg(F.count("*").alias("n_tags"), F.count_if(F.col("n") > 1).alias("n_mixed"))


_LISTS = {"without segments and coregistrant": [k for k in FACT_KEY if k not in ("segments", "coregistrant")], "without segments": [k for k in FACT_KEY if k != "segments"], "whole": FACT_KEY}


def _key_sql(name: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""select '{name}' as key_list, count(*) as n_revisable, count(*) filter (where v1 <> v2 and (v1 = 0 or abs(v2 - v1) >= 0.001 * abs(v1))) as n_restated from (select {k}, first(value order by filed_date) as v1, last(value order by filed_date) as v2
        from (select {k}, filed_date, last(value order by adsh, value) as value from fact where value is not null group by {k}, filed_date) group by {k} having count(*) > 1)"""


@query(f"with {t.FACT} " + " union all ".join(_key_sql(n, k) for n, k in _LISTS.items()))
def d06_key_sensitivity(spark, sf):
    """How many facts can be and are revised, by what counts as the same fact.

    The whole key is stored. The narrower ones come from one shuffle of the facts by the narrowest: the timelines without
    segments are grouped where they lie and merged into those without coregistrants.
    """
    narrowest, narrower, whole = _LISTS
    hits = lambda name: (F.count_if(F.size("line") > 1).alias(f"{name}_revisable"), F.count_if(ops.is_revised(DEFAULT.material)).alias(f"{name}_restated"))
    lines = ops.timelines(t.facts(spark, sf).repartition(*_LISTS[narrowest]), _LISTS[narrower], "filed_date", "value", "adsh")
    merged = ops.coarser_timelines(lines, _LISTS[narrowest], *hits("finer"))
    counts = merged.agg(F.sum("finer_revisable"), F.sum("finer_restated"), *hits("own")).toDF("a", "b", "c", "d")
    rows = counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("key_list"), F.coalesce(x, F.lit(0)).alias("n_revisable"), F.coalesce(y, F.lit(0)).alias("n_restated")) for n, x, y in ((narrower, "a", "b"), (narrowest, "c", "d"))))))
    return rows.unionByName(changes(spark, sf).agg(F.lit(whole).alias("key_list"), F.count("*").alias("n_revisable"), F.count_if("is_revised").alias("n_restated")))


def _power(k: int) -> str:
    return "first_reported_value <> 0 and " + (f"latest_reported_value = first_reported_value * {10**k}" if k > 0 else f"first_reported_value = latest_reported_value * {10**-k}")


@query(f"with {t.FACT}, {RESTATED} select " + ", ".join(f"count(*) filter (where {_power(k)}) as {'times' if k > 0 else 'by'}_{10 ** abs(k)}" for k in _POWERS) + " from restated")
def d12_scale_classes(spark, sf):
    """Revisions that only moved the decimal point."""
    return restatements(spark, sf).agg(*(F.count_if(F.expr(_power(k))).alias(f"{'times' if k > 0 else 'by'}_{10 ** abs(k)}") for k in _POWERS))


@query(f"""with {t.FACT}, {RESTATED} select count(*) as n_small, count(*) filter (where latest_reported_value % 1000 = 0 and first_reported_value % 1000 <> 0) as n_rounded, count(*) filter (where latest_reported_value % 1000 <> 0 and first_reported_value % 1000 = 0) as n_refined
    from restated where first_reported_value <> 0 and abs(absolute_revision) < 0.01 * abs(first_reported_value)""")
def d13_precision(spark, sf):
    """Revisions under 1 % that made a value a multiple of 1,000, against those that made it finer."""
    old, new = F.col("first_reported_value"), F.col("latest_reported_value")
    whole = lambda c: c % 1000 == 0
    small = restatements(spark, sf).where((old != 0) & (F.abs("absolute_revision") < F.lit("0.01").cast("decimal(3,2)") * F.abs(old)))
    return small.agg(F.count("*").alias("n_small"), F.count_if(whole(new) & ~whole(old)).alias("n_rounded"), F.count_if(~whole(new) & whole(old)).alias("n_refined"))


@query(f"""with {t.FACT}, {RESTATED}, r as (select unit_of_measure, case when latest_reported_value <> 0 then first_reported_value::double / latest_reported_value::double end as ratio from restated)
    select unit_of_measure, count(*) as n, count(*) filter (where ratio between 1.5 and 10000 and abs(ratio - round(ratio)) <= {_NEAR}) as n_near_whole,
    round(100.0 * count(*) filter (where ratio between 1.5 and 10000 and abs(ratio - round(ratio)) <= {_NEAR}) / count(*), 4)::double as pct from r group by 1""")
def d14_split_ratios(spark, sf):
    """Revisions that shrank a value by a nearly whole ratio, as share splits do, by unit."""
    new = F.nullif("latest_reported_value", F.lit(0)).cast("double")
    ratio = F.col("first_reported_value").cast("double") / new
    hit = F.count_if(F.col("ratio").between(1.5, 10000) & (F.abs(F.col("ratio") - F.round("ratio")) <= _NEAR))
    return restatements(spark, sf).withColumn("ratio", ratio).groupBy("unit_of_measure").agg(F.count("*").alias("n"), hit.alias("n_near_whole"), F.round(100.0 * hit / F.count("*"), 4).alias("pct"))


@query(f"""with {t.FACT}, {RESTATED} select cik, count(*) as n, round(quantile_cont(pct_revision, 0.5), 4) as median_revision, round(100.0 * count(*) filter (where absolute_revision > 0) / count(*), 4)::double as pct_upward
    from restated where unit_of_measure = 'shares' group by 1 order by n desc, cik limit 5""")
def d15_unit_concentration(spark, sf):
    """The five companies with most revisions in one unit."""
    per = restatements(spark, sf).where("unit_of_measure = 'shares'").groupBy("cik")
    return per.agg(F.count("*").alias("n"), F.round(F.percentile("pct_revision", 0.5), 4).alias("median_revision"), F.round(100.0 * F.count_if(F.col("absolute_revision") > 0) / F.count("*"), 4).alias("pct_upward")).orderBy(F.desc("n"), "cik").limit(5)


@query(f"""with {t.FACT}, {RESTATED}, pick as (select restatement_sk, {_KEY} from restated order by md5(restatement_sk), restatement_sk limit 20)
    select restatement_sk, r.filed_date, r.adsh, r.value from pick join reports r using ({_KEY})""")
def d16_sampled_sequences(spark, sf):
    """Twenty revisions drawn by a hash of their key, each with all its reports."""
    pick = restatements(spark, sf).select("restatement_sk", *FACT_KEY).orderBy(F.md5("restatement_sk"), "restatement_sk").limit(20)
    # the filings of at most twenty companies: the facts pass by them where they lie, and those of the twenty keys alone are grouped
    filings = t.submissions(spark, sf).select("adsh", "cik", "filed_date").join(F.broadcast(pick.select("cik")), "cik", "left_semi")
    rows = t.numeric(spark, sf).join(F.broadcast(filings), "adsh").join(F.broadcast(pick), FACT_KEY)
    return ops.reports(rows, ["restatement_sk"], "filed_date", "value", "adsh").select("restatement_sk", "filed_date", "adsh", "value")


@query(f"""with f as {_inner("m28_feature_pit")}, r as (select filed_date >= date '1997-01-01' as is_test, was_restated, sector_restatement_rate as rate from f where sector_prior_resolved_filings > 0),
    c as (select quantile_disc(rate, [0.2, 0.4, 0.6, 0.8]) as cuts from r)
    select is_test, (1 + (rate > cuts[1])::int + (rate > cuts[2])::int + (rate > cuts[3])::int + (rate > cuts[4])::int)::int as quintile, count(*) as n, round(100.0 * count(*) filter (where was_restated) / count(*), 4)::double as pct_restated
    from r cross join c group by 1, 2""")
def d22_quintile_rates(spark, sf):
    """Share restated by quintile of the sector's rate as known before, in training and test years."""
    rows = features.m28_feature_pit(spark, sf).where("sector_prior_resolved_filings > 0").select((F.col("filed_date") >= F.lit("1997-01-01").cast("date")).alias("is_test"), "was_restated", F.col("sector_restatement_rate").alias("rate"))
    cuts = rows.agg(*(F.expr(f"percentile_disc({k / 5}) within group (order by rate)").alias(f"c{k}") for k in range(1, 5)))
    quintile = sum(((F.col("rate") > F.col(f"c{k}")).cast("int") for k in range(1, 5)), F.lit(1))
    per = rows.crossJoin(F.broadcast(cuts)).groupBy("is_test", quintile.alias("quintile"))  # the cuts are one row
    return per.agg(F.count("*").alias("n"), F.round(100.0 * F.count_if("was_restated") / F.count("*"), 4).alias("pct_restated"))


@query(f"""select 'deadline' as kind, deadline_pattern as pattern, count(*) as n_filers, sum(n_filings)::bigint as n_items, sum(n_late_filings)::bigint as n_bad, max(longest_run_filings) as longest_run from {_inner('m26_deadline_filers')} group by 2
    union all select 'restatement', restatement_pattern, count(*), sum(n_reporting_periods)::bigint, sum(n_restated_periods)::bigint, max(longest_run_periods) from {_inner('m23_serial_restaters')} group by 2""")
def d24_patterns(spark, sf):
    """Companies by pattern: of filing at the deadline and of restating. Neither their names nor their deciles are made for it."""

    def per(rows: DataFrame, kind: str, pattern: str, items: str, bad: str, run: str) -> DataFrame:
        return rows.groupBy(F.lit(kind).alias("kind"), F.col(pattern).alias("pattern")).agg(F.count("*").alias("n_filers"), F.sum(items).alias("n_items"), F.sum(bad).alias("n_bad"), F.max(run).alias("longest_run"))

    late = per(filing.punctuality(spark, sf), "deadline", "deadline_pattern", "n_filings", "n_late_filings", "longest_run_filings")
    return late.unionByName(per(restated.restaters(spark, sf), "restatement", "restatement_pattern", "n_reporting_periods", "n_restated_periods", "longest_run_periods"))


@query(f"""select margin_decile as decile, count(*) as n_filers, round(avg(pct_filings_late), 4) as mean_pct_late, round(avg(median_margin_days), 4) as mean_median_margin from {_inner('m26_deadline_filers')} where margin_decile is not null group by 1""")
def d24b_margin_deciles(spark, sf):
    return filing.m26_deadline_filers(spark, sf).where("margin_decile is not null").groupBy(F.col("margin_decile").alias("decile")).agg(F.count("*").alias("n_filers"), F.round(F.avg("pct_filings_late"), 4).alias("mean_pct_late"), F.round(F.avg("median_margin_days"), 4).alias("mean_median_margin"))


@query(f"select size_band, pct_of_revisable_restated, pct_restated_consolidated, pct_restated_segment from {_inner('m19_by_filer_size')} where size_basis = 'assets_decile' and size_band <> 'unclassified'")
def ch01_decile_rates(spark, sf):
    """What a chart of the rates by decile of assets shows."""
    return restated.rates_by_decile(spark, sf)


@query(f"""with {t.FACT}, {REPORTS} select r.*, (select value from reports x where {' and '.join(f'x.{k} = r.{k}' for k in FACT_KEY)} order by filed_date limit 1) as first_value,
    (select value from reports x where {' and '.join(f'x.{k} = r.{k}' for k in FACT_KEY)} order by filed_date desc limit 1) as latest_value from reports r where filed_date >= date '1998-06-01'""")
def d26_first_latest(spark, sf):
    """Each late report beside the first and the latest of its fact: windows in place of a lookup for each row."""
    line = Window.partitionBy(*FACT_KEY).orderBy("filed_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ops.reports(t.facts(spark, sf), FACT_KEY, "filed_date", "value", "adsh")
    return rows.withColumns({"first_value": F.first("value").over(line), "latest_value": F.last("value").over(line)}).where("filed_date >= date '1998-06-01'")


@query(f"""with {t.FACT}, {RESTATED} select count(*) as n, sum(('0x' || left(md5(restatement_sk || '|' || revising_adsh || '|' || first_revision_filed_date), 12))::bigint)::decimal(38,0) as digest from restated""")
def d27_digest(spark, sf):
    """A digest of the revisions that no order of rows changes: the sum of a hash of each."""
    text = F.concat_ws("|", "restatement_sk", "revising_adsh", F.col("first_revision_filed_date").cast("string"))
    part = F.conv(F.left(F.md5(text), F.lit(12)), 16, 10).cast("decimal(20,0)")
    return restatements(spark, sf).agg(F.count("*").alias("n"), F.sum(part).cast("decimal(38,0)").alias("digest"))
