"""Analyses over the models: sensitivity, cohorts, deadlines, snapshot and drift of the figures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FACT_KEY
from tidemark.operators import bitemporal as ops
from tidemark.operators import evaluation
from tidemark.plans import tables as t
from tidemark.plans import quality
from tidemark.plans.registry import ORACLES, query
from tidemark.plans.features import SOURCES, base
from tidemark.plans.filing import MARGINS, margins
from tidemark.plans.marts import RESTATED, changes, restatements
from tidemark.sources import keyed
from tidemark.sources.store import folder

_SHARES = {"n_any": "0", "n_bp": "0.0001", "n_permille": "0.001", "n_percent": "0.01", "n_five_percent": "0.05"}
BAR = 0.05  # points that a rule's rate may move
_THEN = "1997-12-31"


@query(f"""with {t.FACT} select tag = 'T3' as is_custom, count(*) as n_facts, count(*) filter (where value is null) as n_null,
    round(100.0 * count(*) filter (where value is null) / count(*), 4)::double as pct_null from fact group by 1""")
def d01_null_rate(spark, sf):
    rows = t.facts(spark, sf).groupBy((F.col("tag") == "T3").alias("is_custom")).agg(F.count("*").alias("n_facts"), F.count_if(F.col("value").isNull()).alias("n_null"))
    return rows.withColumn("pct_null", F.round(100.0 * F.col("n_null") / F.col("n_facts"), 4))


@query(f"""with {t.FACT}, {RESTATED}, m as (select form_type as revising_form_type, count(*) as n, quantile_cont(days_to_first_revision, 0.5) as d from restated r join sub s on s.adsh = r.revising_adsh group by 1)
    select revising_form_type, n, round(100.0 * n / sum(n) over (), 4)::double as pct, round(d, 4)::double as median_days from m""")
def d07_revising_forms(spark, sf):
    forms = t.submissions(spark, sf).select(F.col("adsh").alias("revising_adsh"), F.col("form_type").alias("revising_form_type"))
    per = restatements(spark, sf).join(forms, "revising_adsh").groupBy("revising_form_type").agg(F.count("*").alias("n"), F.round(F.percentile("days_to_first_revision", 0.5), 4).alias("median_days"))
    # one row per form reaches the window
    return per.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query(f"with {t.FACT}, {RESTATED} select " + ", ".join(f"count(*) filter (where first_reported_value = 0 or abs(latest_reported_value - first_reported_value) >= {x} * abs(first_reported_value)) as {n}" for n, x in _SHARES.items()) + " from groups where latest_reported_value <> first_reported_value")
def d08_threshold_sweep(spark, sf):
    """Revisions that count as material under several thresholds, all in one pass."""
    found = ops.revisions(t.facts(spark, sf), FACT_KEY, "filed_date", "value", "adsh", "0")
    old, change = F.abs("first_reported_value"), F.abs("absolute_revision")
    return found.agg(*(F.count_if((old == 0) | (change >= F.lit(x).cast("decimal(5,4)") * old)).alias(n) for n, x in _SHARES.items()))


@query(f"""with {t.FACT}, {RESTATED}, c as (select year(first_filed_date)::int as first_year, count(*) as n_revisable from groups group by 1), r as (select year(first_filed_date)::int as first_year, count(*) as n from restated group by 1)
    select first_year, n_revisable, coalesce(n, 0) as n_restated, round(100.0 * coalesce(n, 0) / n_revisable, 4)::double as pct_restated from c left join r using (first_year)""")
def d09_first_year_cohorts(spark, sf):
    per = changes(spark, sf).groupBy(F.year("first_filed_date").alias("first_year")).agg(F.count("*").alias("n_revisable"), F.count_if("is_revised").alias("n_restated"))
    return per.withColumn("pct_restated", F.round(100.0 * F.col("n_restated") / F.col("n_revisable"), 4))


@query(f"""with {MARGINS} select form_type, margin, count(*) as n, margin between -case when form_type = '10-K' then 15 else 5 end and -1 as in_extension,
    round(100.0 * (sum(count(*)) filter (where margin < 0) over w) / (sum(count(*)) over w), 4)::double as pct_late_at_most,
    round(100.0 * coalesce(sum(count(*)) filter (where margin < -case when form_type = '10-K' then 15 else 5 end) over w, 0) / (sum(count(*)) over w), 4)::double as pct_late_at_least
    from m group by 1, 2 window w as (partition by form_type)""")
def d17_margin_histogram(spark, sf):
    """Filings by margin. Late ones inside the days of a notified extension may be in time, so a form's late share has two bounds."""
    extension = F.when(F.col("form_type") == "10-K", 15).otherwise(5)
    per = margins(spark, sf).groupBy("form_type", "margin").agg(F.count("*").alias("n"))
    form, n = Window.partitionBy("form_type"), F.col("n")
    share = lambda late: F.round(100.0 * F.sum(F.when(late, n).otherwise(0)).over(form) / F.sum(n).over(form), 4)
    return per.select("form_type", "margin", "n", F.col("margin").between(-extension, -1).alias("in_extension"), share(F.col("margin") < 0).alias("pct_late_at_most"), share(F.col("margin") < -extension).alias("pct_late_at_least"))


@query(f"with {MARGINS} select (filed_date + margin)::date as due_date, count(*) as n_late_by_one from m where margin = -1 group by 1 order by 2 desc, 1 limit 10")
def d18_late_by_one(spark, sf):
    """The ten due dates that most filings missed by a day."""
    late = margins(spark, sf).where("margin = -1").groupBy(F.date_add("filed_date", F.col("margin")).alias("due_date")).agg(F.count("*").alias("n_late_by_one"))
    return late.orderBy(F.desc("n_late_by_one"), "due_date").limit(10)


@query(f"""with {t.FACT}, {RESTATED}, e as (select distinct first_adsh as adsh from restated)
    select date_trunc('quarter', filed_date)::date as quarter, count(*) as n_filings, count(e.adsh) as n_ever_restated, round(100.0 * count(e.adsh) / count(*), 4)::double as pct from sub left join e using (adsh) group by 1""")
def d23_ever_restated(spark, sf):
    ever = restatements(spark, sf).select(F.col("first_adsh").alias("adsh"), F.lit(1).alias("hit")).distinct()
    per = t.submissions(spark, sf).join(ever, "adsh", "left").groupBy(F.trunc("filed_date", "quarter").alias("quarter")).agg(F.count("*").alias("n_filings"), F.count("hit").alias("n_ever_restated"))
    return per.withColumn("pct", F.round(100.0 * F.col("n_ever_restated") / F.col("n_filings"), 4))


_TOTALS = """(select count(*) from fact) as n_facts, (select count(*) from sub) as n_filings, (select max(filed_date) from sub) as vintage, count(*) as n_restatements,
    count(*) filter (where first_reported_value = 0) as zero_origin, count(*) filter (where abs(pct_revision) > 100) as extreme, count(*) filter (where latest_reported_value = -first_reported_value) as sign_flip,
    round(100.0 * count(*) filter (where absolute_revision < 0) / nullif(count(*), 0), 4)::double as pct_downward"""


def totals(spark, sf) -> DataFrame:
    """The data's vintage and size, and its revisions by class: one row."""
    filings = t.submissions(spark, sf).agg(F.count("*").alias("n_filings"), F.max("filed_date").alias("vintage"))
    facts = t.facts(spark, sf).agg(F.count("*").alias("n_facts"))
    old, new = F.col("first_reported_value"), F.col("latest_reported_value")
    n = F.count("*")
    found = restatements(spark, sf).agg(n.alias("n_restatements"), F.count_if(old == 0).alias("zero_origin"), F.count_if(F.abs("pct_revision") > 100).alias("extreme"), F.count_if(new == -old).alias("sign_flip"), F.round(100.0 * F.count_if(F.col("absolute_revision") < 0) / F.nullif(n, F.lit(0)), 4).alias("pct_downward"))
    return facts.crossJoin(F.broadcast(filings)).crossJoin(F.broadcast(found))  # each side is one row


@query(f"""with {t.FACT}, {RESTATED}, x as (select {_TOTALS} from restated) select x.*, rule, dimension, severity, rows_affected, rows_checked, pct from x, ({ORACLES["m15_scorecard"]})""")
def met01_snapshot(spark, sf):
    """The totals beside each rule of the scorecard."""
    return quality.m15_scorecard(spark, sf).drop("place").crossJoin(F.broadcast(totals(spark, sf)))  # one row of totals


_RULES = {"null_value": "value is null", "implausible_duration": "qtrs not between 0 and 40", "custom_tag": "tag = 'T3'", "filed_before_period": "filed_date < period_end_date"}


def _rates(facts: DataFrame) -> DataFrame:
    one = facts.agg(F.count("*").alias("n"), *(F.count_if(F.expr(c)).alias(n) for n, c in _RULES.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.round(100.0 * F.col(n) / F.col("n"), 4).alias("pct")) for n in _RULES))))


def _rates_sql(where: str) -> str:
    return " union all ".join(f"select '{n}' as rule, round(100.0 * count(*) filter (where {c}) / count(*), 4)::double as pct from fact {where}" for n, c in _RULES.items())


@query(f"""with {t.FACT}, b as ({_rates_sql(f"where filed_date <= date '{_THEN}'")} union all select 'retired_rule', 1.0), c as ({_rates_sql('')})
    select * from (select rule, b.pct as before, c.pct as after, case when c.rule is null then 'REMOVED' when b.rule is null then 'NEW' when abs(c.pct - b.pct) > {BAR} then 'DRIFT' end as status
        from b full outer join c using (rule)) where status is not null""")
def met02_drift(spark, sf):
    """Rates of the rules on facts as of a date, with a rule that is gone since, against now."""
    facts = t.facts(spark, sf)
    then = _rates(facts.where(F.col("filed_date") <= F.lit(_THEN).cast("date"))).unionByName(spark.range(1).select(F.lit("retired_rule").alias("rule"), F.lit(1.0).alias("pct")))
    return evaluation.drift(then, _rates(facts), "rule", "pct", BAR)


def record(spark, sf, path: str, scorecard: DataFrame | None = None) -> str:
    """Add the scorecard to the stored history at `path`, under the data's vintage; one of the same vintage is replaced whole.

    Gives the vintage. The history is kept by `sources.keyed`, so a lost run leaves it as it was.
    """
    rows = quality.m15_scorecard(spark, sf) if scorecard is None else scorecard
    last = t.submissions(spark, sf).agg(F.max("filed_date").alias("vintage_date"))
    rows = rows.crossJoin(F.broadcast(last)).withColumn("vintage", F.col("vintage_date").cast("string"))  # one row
    keyed.merge(rows, path, "vintage", "vintage_date")
    return str(last.first()[0])


def stored_drift(spark, path: str, current: DataFrame, before: str | None = None) -> DataFrame:
    """The current rules against a stored snapshot: that of vintage `before`, else the latest one."""
    history = keyed.read(spark, path)
    wanted = F.lit(before) if before else F.lit(history.agg(F.max("vintage")).first()[0])
    return evaluation.drift(history.where(F.col("vintage") == wanted), current, "rule", "pct", BAR)


@query(f"""with s as ({ORACLES["m15_scorecard"]}), b as (select case when place = 1 then 'retired_rule' else rule end as rule, case when place = 3 then pct + 1 else pct end as pct from s where place <> 2)
    select * from (select rule, b.pct as before, s.pct as after, case when s.rule is null then 'REMOVED' when b.rule is null then 'NEW' when abs(s.pct - b.pct) > {BAR} then 'DRIFT' end as status
        from b full outer join s using (rule)) where status is not null""")
def met02b_stored_drift(spark, sf):
    """The scorecard against a stored snapshot in which one rule had another name, one wasn't there and one was a point higher."""
    now = quality.m15_scorecard(spark, sf)
    old = now.where("place <> 2").withColumns({"rule": F.when(F.col("place") == 1, "retired_rule").otherwise(F.col("rule")), "pct": F.when(F.col("place") == 3, F.col("pct") + 1).otherwise(F.col("pct"))})
    path = f"{folder(spark)}/history-{uuid.uuid4().hex}"
    record(spark, sf, path, old)
    return stored_drift(spark, path, now)


def drifted(found: DataFrame) -> int:
    """Exit status for a comparison: 1 if anything moved, else 0."""
    return 0 if found.isEmpty() else 1


@query(f"""with {SOURCES}, s as (select filing_lag_days as score, count(*) filter (where was_restated) as pos, count(*) filter (where not was_restated) as neg from base where filing_lag_days is not null group by 1),
    w as (select pos, neg, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from s),
    a as (select sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg, sum(pos * (2 * below + neg))::double / nullif(2.0 * sum(pos) * sum(neg), 0)::double as area from w)
    select n_pos, n_neg, round(area, 6) as auc, round(greatest(area, 1 - area), 6) as mirrored_auc from a""")
def ml04_univariate_auc(spark, sf):
    """How well the filing lag alone ranks filings by whether they were restated within the horizon."""
    return evaluation.auc(base(spark, sf), "filing_lag_days", "was_restated")
