"""Data-quality models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.operators import bitemporal as ops
from tidemark.plans import tables as t
from tidemark.plans.registry import query


def balances(spark, sf) -> DataFrame:
    """Of each filing's balance sheets, whether assets equal the reported total, and liabilities with equity.

    Equity with minorities is preferred.
    """
    names = {t.ASSETS: "assets", t.LIABILITIES: "liabilities", t.TOTAL: "liabilities_and_equity", t.EQUITY: "own", t.EQUITY_WITH_MINORITIES: "whole"}
    rows = t.numeric(spark, sf).where(F.col("tag").isin(*names) & (F.col("qtrs") == 0) & (F.col("unit_of_measure") == "USD") & (F.col("coregistrant") == "") & (F.col("segments") == ""))
    wide = rows.groupBy("adsh", "period_end_date").pivot("tag", list(names)).agg(F.max("value")).where(F.col(t.ASSETS).isNotNull()).withColumnsRenamed(names)
    wide = wide.withColumn("equity", F.coalesce("whole", "own")).drop("whole", "own")
    gaps = {"total": F.col("assets") - F.col("liabilities_and_equity"), "component": F.col("assets") - F.col("liabilities") - F.col("equity")}
    share = lambda gap: F.round(F.abs(gap).cast("double") / F.nullif(F.abs("assets"), F.lit(0)).cast("double"), 6)
    return wide.select(
        "*",
        *(gap.cast("decimal(30,4)").alias(f"{n}_gap") for n, gap in gaps.items()),
        *(share(gap).alias(f"{n}_pct_gap") for n, gap in gaps.items()),
        F.col("liabilities_and_equity").isNotNull().alias("has_reported_total"),
        (F.col("liabilities").isNotNull() & F.col("equity").isNotNull()).alias("has_components"),
    )


def identity(spark, sf) -> DataFrame:
    """The balances with the filing and company that they are of."""
    filings = t.submissions(spark, sf).select("adsh", "cik", "company_name", "form_type", "filer_status", "filed_date")
    return balances(spark, sf).join(filings, "adsh")


IDENTITY = """ident as (
    with wide as (pivot (select adsh, period_end_date, tag, value from num where qtrs = 0 and unit_of_measure = 'USD' and coregistrant = '' and segments = '')
        on tag in ('T0', 'T1', 'T2', 'T4', 'T5') using max(value) group by adsh, period_end_date),
    named as (select adsh, period_end_date, T0 as assets, T1 as liabilities, T2 as liabilities_and_equity, ifnull(T5, T4) as equity from wide where T0 is not null)
    select named.*, cik, company_name, form_type, filer_status, filed_date, (assets - liabilities_and_equity)::decimal(30,4) as total_gap, assets - liabilities - equity as component_gap,
        round(abs((assets - liabilities_and_equity)::double) / nullif(abs(assets), 0)::double, 6) as total_pct_gap, round(abs((assets - liabilities - equity)::double) / nullif(abs(assets), 0)::double, 6) as component_pct_gap,
        liabilities_and_equity is not null as has_reported_total, liabilities is not null and equity is not null as has_components
    from named join sub using (adsh))"""


@query(f"with {t.SUB}, {t.NUM}, {IDENTITY} select * from ident")
def m11_balance_sheet_identity(spark, sf):
    return identity(spark, sf)


def _dictionary(spark, sf) -> DataFrame:
    return t.tags(spark, sf).select("tag", "taxonomy_version", "is_custom")


@query(f"""with {t.FACT}, {t.TAG} select filer_status, count(distinct cik) as n_companies, count(*) as n_facts, count(*) filter (where is_custom) as n_custom,
    round(100.0 * count(*) filter (where is_custom) / count(*), 4)::double as pct_custom from fact left join tags using (tag, taxonomy_version) group by 1""")
def m12_custom_tag_share(spark, sf):
    custom = F.count_if("is_custom")
    rows = t.facts(spark, sf).join(_dictionary(spark, sf), ["tag", "taxonomy_version"], "left")
    return rows.groupBy("filer_status").agg(F.count_distinct("cik").alias("n_companies"), F.count("*").alias("n_facts"), custom.alias("n_custom"), F.round(F.lit(100.0) * custom / F.count("*"), 4).alias("pct_custom"))


_GRAIN = ["adsh", "tag", "taxonomy_version", "coregistrant", "segments", "period_end_date", "qtrs", "unit_of_measure"]


def conflicts(spark, sf) -> DataFrame:
    """Facts that one filing reports several times with different values: filing, occurrences."""
    found = t.numeric(spark, sf).groupBy(*_GRAIN).agg(F.count("*").alias("occurrences"), F.count_distinct("value").alias("n")).where("occurrences > 1 and n > 1")
    return found.select("adsh", "occurrences")


CONFLICTS = f"conflicts as (select adsh, count(*) as occurrences from num group by {', '.join(_GRAIN)} having count(*) > 1 and count(distinct value) > 1)"
_FLAGS = ["flag_null_heavy", "flag_custom_heavy", "flag_bad_duration", "flag_conflicting_dupes", "flag_date_error", "flag_balance_violation"]


@query(f"""with {t.FACT}, {t.TAG}, {CONFLICTS}, {IDENTITY},
    filer as (select cik, arg_max(company_name, (filed_date, adsh)) as company_name, arg_max(coalesce(filer_status, '-'), (filed_date, adsh)) as filer_status from sub group by 1),
    f as (select cik, count(*) as facts, count(*) filter (where value is null) as nulls, count(*) filter (where qtrs not between 0 and 40) as bad_duration_facts, count(*) filter (where is_custom) as customs
        from fact left join tags using (tag, taxonomy_version) group by 1),
    flags as (select f.cik, company_name, nullif(filer_status, '-') as filer_status, facts, round(100.0 * nulls / facts, 4)::double as pct_null, round(100.0 * customs / facts, 4)::double as pct_custom, bad_duration_facts,
        nulls / facts > 2 * (select count(*) filter (where value is null) / count(*) from num) as flag_null_heavy, customs / facts > 0.2 as flag_custom_heavy, bad_duration_facts > 0 as flag_bad_duration,
        f.cik in (select cik from conflicts join sub using (adsh)) as flag_conflicting_dupes, f.cik in (select cik from sub where filed_date < period_end_date) as flag_date_error,
        f.cik in (select cik from ident where has_reported_total and total_pct_gap > 0.001) as flag_balance_violation from f join filer using (cik))
    select *, ({' + '.join(f'{x}::int' for x in _FLAGS)})::int as rules_failed from flags""")
def m13_filer_concentration(spark, sf):
    """Which companies break several independent rules; rates are held against twice the whole population's."""
    nulls = F.count_if(F.col("value").isNull())
    facts = t.facts(spark, sf).join(_dictionary(spark, sf), ["tag", "taxonomy_version"], "left")
    per = facts.groupBy("cik").agg(F.count("*").alias("facts"), nulls.alias("nulls"), F.count_if(~F.col("qtrs").between(0, DEFAULT.longest_duration)).alias("bad_duration_facts"), F.count_if("is_custom").alias("customs"))
    rate = t.numeric(spark, sf).agg((nulls / F.count("*")).alias("rate"))  # one row
    # what is found by filing meets the filings once, and both become companies in one grouping
    clash = conflicts(spark, sf).select("adsh", F.lit(True).alias("clash"), F.lit(False).alias("gap"))
    off = balances(spark, sf).where("has_reported_total and total_pct_gap > 0.001").select("adsh", F.lit(False).alias("clash"), F.lit(True).alias("gap"))
    found = clash.unionByName(off).groupBy("adsh").agg(F.bool_or("clash").alias("clash"), F.bool_or("gap").alias("gap"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    latest = F.max_by(F.struct("company_name", "filer_status"), F.struct("filed_date", "adsh")).alias("latest")
    flags = {"flag_date_error": F.col("filed_date") < F.col("period_end_date"), "flag_conflicting_dupes": F.col("clash"), "flag_balance_violation": F.col("gap")}
    filer = t.submissions(spark, sf).join(found, "adsh", "left").groupBy("cik").agg(latest, *(any_(c).alias(n) for n, c in flags.items()))
    rows = per.join(filer, "cik").crossJoin(F.broadcast(rate))
    rows = rows.withColumns({
        "pct_null": F.round(F.lit(100.0) * F.col("nulls") / F.col("facts"), 4), "pct_custom": F.round(F.lit(100.0) * F.col("customs") / F.col("facts"), 4),
        "flag_null_heavy": F.col("nulls") / F.col("facts") > 2 * F.col("rate"), "flag_custom_heavy": F.col("customs") / F.col("facts") > DEFAULT.custom_heavy,
        "flag_bad_duration": F.col("bad_duration_facts") > 0,
    })
    return rows.select("cik", "latest.company_name", "latest.filer_status", "facts", "pct_null", "pct_custom", "bad_duration_facts", *_FLAGS, sum((F.col(x).cast("int") for x in _FLAGS), F.lit(0)).alias("rules_failed"))


@query(f"""with {t.SUB} select form_type, filer_status, grouping(form_type) * 2 + grouping(filer_status) as level, count(*) as n_filings, round(avg(filing_lag_days), 4) as mean_lag,
    round(quantile_cont(filing_lag_days, 0.5), 4) as median_lag, round(quantile_cont(filing_lag_days, 0.9), 4) as p90_lag, min(filing_lag_days) as min_lag, max(filing_lag_days) as max_lag
    from sub where form_type in ('10-K', '10-Q', '10-K/A', '10-Q/A') and filing_lag_days between 0 and 1095 group by grouping sets ((form_type, filer_status), (form_type), ())""")
def m14_filing_lag_profile(spark, sf):
    rows = t.submissions(spark, sf).where(F.col("form_type").isin("10-K", "10-Q", "10-K/A", "10-Q/A") & F.col("filing_lag_days").between(0, 1095))
    lag = F.col("filing_lag_days")
    sets = [[F.col("form_type"), F.col("filer_status")], [F.col("form_type")], []]
    return rows.groupingSets(sets, "form_type", "filer_status").agg(
        (F.grouping("form_type").cast("long") * 2 + F.grouping("filer_status")).alias("level"), F.count("*").alias("n_filings"), F.round(F.avg(lag), 4).alias("mean_lag"), F.round(F.percentile(lag, 0.5), 4).alias("median_lag"), F.round(F.percentile(lag, 0.9), 4).alias("p90_lag"), F.min(lag).alias("min_lag"), F.max(lag).alias("max_lag")
    )


#: Rules of the scorecard: dimension and severity.
_RULES = {
    "null_value": ("completeness", "medium"),
    "filed_before_period": ("validity", "high"),
    "implausible_lag": ("timeliness", "medium"),
    "implausible_duration": ("validity", "high"),
    "conflicting_duplicate": ("consistency", "high"),
    "rejected_at_load": ("validity", "medium"),
}


@query(f"""with {t.SUB}, {t.NUM}, {t.REJECTS}, {CONFLICTS}, n as (select count(*) as facts, count(*) filter (where value is null) as a, count(*) filter (where qtrs > 40 or qtrs < 0) as d from num),
    f as (select count(*) as filings, count(*) filter (where filed_date < period_end_date) as b, count(*) filter (where filing_lag_days > 1095) as c from sub),
    e as (select coalesce(sum(occurrences), 0)::bigint as e from conflicts), j as (select coalesce(sum(rows_rejected), 0)::bigint as j from rejects),
    r(rule, affected, checked) as (select 'null_value', a, facts from n union all select 'filed_before_period', b, filings from f union all select 'implausible_lag', c, filings from f
        union all select 'implausible_duration', d, facts from n union all select 'conflicting_duplicate', e, facts from e, n union all select 'rejected_at_load', j, facts + j from j, n)
    select rule, dimension, severity, affected as rows_affected, checked as rows_checked, round(100.0 * affected / checked, 5)::double as pct,
        (row_number() over (order by case severity when 'high' then 1 when 'medium' then 2 else 3 end, affected desc, rule))::int as place
    from r join (values {", ".join(f"('{n}', '{d}', '{s}')" for n, (d, s) in _RULES.items())}) v(rule, dimension, severity) using (rule)""")
def m15_scorecard(spark, sf):
    """Rows that break each rule, worst severity first. Facts and filings are counted in one pass each."""
    facts = t.numeric(spark, sf).agg(F.count("*").alias("facts"), F.count_if(F.col("value").isNull()).alias("null_value"), F.count_if(~F.col("qtrs").between(0, DEFAULT.longest_duration)).alias("implausible_duration"))
    filings = t.submissions(spark, sf).agg(F.count("*").alias("filings"), F.count_if(F.col("filed_date") < F.col("period_end_date")).alias("filed_before_period"), F.count_if(F.col("filing_lag_days") > DEFAULT.longest_lag).alias("implausible_lag"))
    clash = conflicts(spark, sf).agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("conflicting_duplicate"))
    refused = t.rejects(spark, sf).agg(F.coalesce(F.sum("rows_rejected"), F.lit(0)).alias("rejected_at_load"))
    one = facts.crossJoin(F.broadcast(filings)).crossJoin(F.broadcast(clash)).crossJoin(F.broadcast(refused))  # single rows
    checked = {"filed_before_period": F.col("filings"), "implausible_lag": F.col("filings"), "rejected_at_load": F.col("facts") + F.col("rejected_at_load")}
    lines = [F.struct(F.lit(n).alias("rule"), F.lit(d).alias("dimension"), F.lit(s).alias("severity"), F.col(n).alias("rows_affected"), checked.get(n, F.col("facts")).alias("rows_checked")) for n, (d, s) in _RULES.items()]
    rows = one.select(F.inline(F.array(*lines))).withColumn("pct", F.round(F.lit(100.0) * F.col("rows_affected") / F.col("rows_checked"), 5))
    rank = t.case(F.col("severity"), {"high": 1, "medium": 2}, F.lit(3))
    # six rows
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(rank, F.desc("rows_affected"), "rule")))


@query(f"""with {t.NUM}, n as (select tag, unit_of_measure as u, count(*) as n, regexp_full_match(unit_of_measure, '[A-Z]{{3}}') as currency from num where value is not null group by 1, 2)
    select tag, count(*) as distinct_units, count(*) filter (where currency) as currency_units, count(*) filter (where not currency) as non_currency_units, sum(n)::bigint as total_facts,
    sum(n) filter (where not currency)::bigint as non_currency_facts, count(*) filter (where currency) > 1 and count(*) filter (where not currency) > 0 as has_suspect_unit_mix, string_agg(u, ', ' order by u) as units_used
    from n group by 1 having count(*) > 1""")
def m16_unit_inconsistency(spark, sf):
    per = t.numeric(spark, sf).where("value is not null").groupBy("tag", F.col("unit_of_measure").alias("u")).agg(F.count("*").alias("n"))
    currency = F.col("u").rlike(r"^[A-Z]{3}\z")
    counted = {"distinct_units": F.count("*"), "currency_units": F.count_if(currency), "non_currency_units": F.count_if(~currency), "total_facts": F.sum("n"), "non_currency_facts": F.sum(F.when(~currency, F.col("n"))), "units_used": F.array_join(F.sort_array(F.collect_set("u")), ", ")}
    suspect = (F.col("currency_units") > 1) & (F.col("non_currency_units") > 0)
    return per.groupBy("tag").agg(*(c.alias(n) for n, c in counted.items())).where("distinct_units > 1").withColumn("has_suspect_unit_mix", suspect)


@query(f"""with {t.FACT} select count(*) as row_count, (select count(*) from (select distinct adsh, tag, taxonomy_version, segments, period_end_date, qtrs, unit_of_measure from fact)) as distinct_keys,
    sum(value)::decimal(38,4) as value_sum, count(*) filter (where value is null) as null_values, max(filed_date) as max_date from fact""")
def fp01_fingerprint(spark, sf):
    return ops.fingerprint(t.facts(spark, sf), ["adsh", "tag", "taxonomy_version", "segments", "period_end_date", "qtrs", "unit_of_measure"], "value", "filed_date")


@query(f"""with {t.FACT} select date_trunc('month', filed_date)::date as month, count(*) as n_facts, count(distinct adsh) as n_filings, count(*) filter (where value is null) as n_null
    from fact where filed_date >= date '1997-03-01' and filed_date < date '1997-04-01' group by 1""")
def d25_month_of_facts(spark, sf):
    month = t.facts(spark, sf).where("filed_date >= date '1997-03-01' and filed_date < date '1997-04-01'")
    return month.groupBy(F.trunc("filed_date", "month").alias("month")).agg(F.count("*").alias("n_facts"), F.count_distinct("adsh").alias("n_filings"), F.count_if(F.col("value").isNull()).alias("n_null"))


@query(f"""with {t.SUB} select o.adsh from sub o where form_type = '10-K' order by md5(adsh) limit 20""")
def srt05_seeded_sample(spark, sf):
    return t.submissions(spark, sf).where("form_type = '10-K'").select("adsh").orderBy(F.md5("adsh")).limit(20)


@query(f"""with {t.SUB}, w as (select cik, adsh, filed_date, row_number() over (partition by cik order by filed_date desc, adsh) as rn from sub) select cik, adsh, filed_date from w where rn <= 2""")
def srt04_top_per_group(spark, sf):
    w = Window.partitionBy("cik").orderBy(F.desc("filed_date"), "adsh")
    return t.submissions(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("cik", "adsh", "filed_date")
