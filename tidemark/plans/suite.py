"""Assertions on the models as one report, and a drill-down into pairs of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FACT_KEY
from tidemark.operators import expectations as ex
from tidemark.plans import features, marts
from tidemark.plans import tables as t
from tidemark.plans.registry import query
from tidemark.plans.features import NAIVE, PIT, SOURCES
from tidemark.plans.marts import FACT_TABLE, FILING
from tidemark.sources.store import stored

#: Warn above, error above.
LEVELS = {
    "T-01 one current version": (0, 0), "T-02 facts keep the grain": (0, 0), "T-03 feature tables aligned": (0, 0), "T-04 filed before period": (0, 10**9), "T-05 implausible lag": (0, 10**9), "T-06 orphan facts": (0, 0), "T-07 overlapping versions": (0, 0), "T-09 implausible duration": (0, 10**9),
    "T-10 dates of revisions ordered": (0, 0), "T-11 fact keys repeat": (0, 200), "T-11 filing without company": (0, 0), "T-12 unknown status": (0, 0), "T-13 tag not in the dictionary": (0, 10**9), "T-14 filings repeat": (0, 0), "T-15 rate outside 0 to 1": (0, 0),
}


@stored
def facts(spark, sf):
    """Of the fact table what its assertions read; the key as its 16 bytes."""
    return marts.fact_table(spark, sf).select(F.unhex("fact_sk").alias("fact_sk"), "qtrs", F.col("tag_sk").isNull().alias("unknown_tag"))


def _sql(name: str, count: str) -> str:
    warn, error = LEVELS[name]
    return f"select '{name}' as name, ({count}) as failures, {warn} as w, {error} as e"


@query(f"""with {SOURCES}, {PIT}, {NAIVE}, {FILING}, ft as ({FACT_TABLE}), r as ({" union all ".join([
    _sql("T-01 one current version", "select count(*) from (select cik from company group by 1 having count(*) filter (where is_current) <> 1)"),
    _sql("T-02 facts keep the grain", "select abs((select count(*) from ft) - (select count(*) from num))"),
    _sql("T-03 feature tables aligned", "select count(*) from pit full outer join naive using (adsh) where pit.was_restated is distinct from naive.was_restated"),
    _sql("T-04 filed before period", "select count(*) from sub where filed_date < period_end_date"),
    _sql("T-05 implausible lag", "select count(*) from sub where filing_lag_days > 1095"),
    _sql("T-06 orphan facts", "select count(*) from num anti join sub using (adsh)"),
    _sql("T-07 overlapping versions", "select count(*) from company a join company b on a.cik = b.cik and a.company_sk <> b.company_sk and a.valid_from <= b.valid_to and b.valid_from <= a.valid_to where a.valid_from < b.valid_from"),
    _sql("T-09 implausible duration", "select count(*) from num where qtrs not between 0 and 40"),
    _sql("T-10 dates of revisions ordered", "select count(*) from restated where first_filed_date >= latest_filed_date"),
    _sql("T-11 fact keys repeat", "select count(*) from (select fact_sk from ft group by 1 having count(*) > 1)"),
    _sql("T-11 filing without company", "select count(*) from filing where cik is null"),
    _sql("T-12 unknown status", "select count(*) from filing where filer_status not in ('1-LAF', '2-ACC', '4-NON')"),
    _sql("T-13 tag not in the dictionary", "select count(*) from ft where tag_sk is null"),
    _sql("T-14 filings repeat", "select count(*) from (select adsh from filing group by 1 having count(*) > 1)"),
    _sql("T-15 rate outside 0 to 1", "select count(*) from pit where sector_restatement_rate not between 0 and 1"),
])}) select name, failures, case when failures > e then 'error' when failures > w then 'warn' else 'pass' end as severity from r""")
def t_quality_suite(spark, sf):
    """Every assertion with its failures and severity; rules on the rows of one table share one pass over it."""
    filings, company, pit, whole = marts.filing(spark, sf), marts.company(spark, sf), features.pit(spark, sf), facts(spark, sf)
    both = pit.select("adsh", F.col("was_restated").alias("a")).join(features.m29_feature_naive(spark, sf).select("adsh", F.col("was_restated").alias("b")), "adsh", "full_outer")
    staged = t.numeric(spark, sf).agg(F.count("*").alias("staged"))
    grain = whole.agg(F.count("*").alias("loaded")).crossJoin(F.broadcast(staged))  # single rows
    found = [
        ex.counted(company.groupBy("cik").agg(F.count_if("is_current").alias("n")).where("n <> 1"), "T-01 one current version"),
        grain.select(F.lit("T-02 facts keep the grain").alias("name"), F.abs(F.col("loaded") - F.col("staged")).alias("failures")),
        ex.row_checks(both, {"T-03 feature tables aligned": ~F.col("a").eqNullSafe(F.col("b"))}),
        ex.row_checks(filings, {"T-04 filed before period": F.col("filed_date") < F.col("period_end_date"), "T-05 implausible lag": F.col("filing_lag_days") > DEFAULT.longest_lag, "T-11 filing without company": F.col("cik").isNull(), "T-12 unknown status": ~F.col("filer_status").isin("1-LAF", "2-ACC", "4-NON")}),
        ex.counted(ex.relationship(t.numeric(spark, sf), "adsh", filings, "adsh"), "T-06 orphan facts"),
        ex.counted(ex.no_overlap(company, "cik"), "T-07 overlapping versions"),
        ex.row_checks(whole, {"T-09 implausible duration": ~F.col("qtrs").between(0, DEFAULT.longest_duration), "T-13 tag not in the dictionary": F.col("unknown_tag")}),
        ex.row_checks(marts.restatements(spark, sf), {"T-10 dates of revisions ordered": F.col("first_filed_date") >= F.col("latest_filed_date")}),
        ex.counted(ex.unique(whole, "fact_sk"), "T-11 fact keys repeat"),
        ex.counted(ex.unique(filings, "adsh"), "T-14 filings repeat"),
        ex.row_checks(pit, {"T-15 rate outside 0 to 1": ~F.col("sector_restatement_rate").between(0, 1)}),
    ]
    return ex.graded(found, LEVELS)


_SAME = " and ".join(f"b.{k} = a.{k}" for k in FACT_KEY)


@query(f"""with {t.FACT} select a.cik, count(*) as revision_pairs, count(distinct a.tag) as tags_revised, max(abs(b.value - a.value)) as largest_absolute_revision from fact a join fact b on {_SAME} and b.filed_date > a.filed_date and b.value is distinct from a.value
    where a.cik in (select cik from fact group by 1 order by count(*) desc, cik limit 20) group by 1""")
def jn18_revision_pairs(spark, sf):
    """All pairs of reports of one fact with different values, for the twenty companies with most facts."""
    rows = t.facts(spark, sf).select(*FACT_KEY, "filed_date", "value")
    most = rows.groupBy("cik").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cik").limit(20).select("cik")
    mine = rows.join(F.broadcast(most), "cik", "left_semi")  # twenty rows
    later = mine.withColumnsRenamed({"filed_date": "later_date", "value": "later"})
    pairs = mine.join(later, FACT_KEY).where((F.col("later_date") > F.col("filed_date")) & ~F.col("later").eqNullSafe(F.col("value")))
    return pairs.groupBy("cik").agg(F.count("*").alias("revision_pairs"), F.count_distinct("tag").alias("tags_revised"), F.max(F.abs(F.col("later") - F.col("value"))).alias("largest_absolute_revision"))
