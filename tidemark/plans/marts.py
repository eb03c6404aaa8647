"""Staged tables, dimensions, the fact table and the revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FACT_KEY
from tidemark.functions.columns import date_key, surrogate_key
from tidemark.operators import bitemporal as ops
from tidemark.plans import tables as t
from tidemark.plans.registry import query
from tidemark.sources import keyed
from tidemark.sources.store import folder, stored

_KEY = ", ".join(FACT_KEY)
_TRACKED = ["company_name", "sic_code", "fiscal_year_end_mmdd", "business_state"]
_GRAIN = ["adsh", "tag", "taxonomy_version", "coregistrant", "segments", "period_end_date", "qtrs", "unit_of_measure"]
STATUS_NAMES = {"1-LAF": "Large accelerated", "2-ACC": "Accelerated", "4-NON": "Non-accelerated"}


def published() -> Column:
    """Tags of published taxonomies: few entries of the dictionary, most facts. A filer's own ones have the filing as version."""
    return F.contains("taxonomy_version", F.lit("/"))


def sql_key(*names: str) -> str:
    return "md5(concat_ws('-', " + ", ".join(f"coalesce({n}::varchar, '_dbt_utils_surrogate_key_null_')" for n in names) + "))"


@query(f"with {t.SUB} select * from sub")
def m01_submissions(spark, sf):
    return t.submissions(spark, sf)


def _flags() -> dict[str, Column]:
    return {"is_instant": F.col("qtrs") == 0, "is_annual": F.col("qtrs") == 4, "has_segments": F.col("segments") != ""}


@query(f"with {t.NUM} select *, qtrs = 0 as is_instant, qtrs = 4 as is_annual, segments <> '' as has_segments from num")
def m02_numeric(spark, sf):
    return t.numeric(spark, sf).withColumns(_flags())


@query(f"with {t.PRE} select *, {t.statement_name_sql('statement_code')} as statement_name from pre")
def m03_presentation(spark, sf):
    return t.presentation(spark, sf).withColumn("statement_name", t.case(F.col("statement_code"), t.STATEMENTS))


@query(f"with {t.NUM}, {t.TAG} select * from tags")
def m04_tags(spark, sf):
    return t.tags(spark, sf)


@stored
def company(spark, sf) -> DataFrame:
    complete = sum((F.col(c).isNotNull().cast("int") for c in ("sic_code", "fiscal_year_end_mmdd", "business_state")), F.lit(0))
    versions = ops.scd2(t.dealt(t.submissions(spark, sf), sf, "orders", "cik"), "cik", "filed_date", _TRACKED, F.desc_nulls_last("period_end_date"), complete.desc(), F.asc("adsh"))
    return versions.select(surrogate_key("cik", "valid_from").alias("company_sk"), "*")


COMPANY = f"""
daily as (select * from (select *, row_number() over (partition by cik, filed_date order by period_end_date desc nulls last,
    (sic_code is not null)::int + (fiscal_year_end_mmdd is not null)::int + (business_state is not null)::int desc, adsh) as rn from sub) where rn = 1),
marked as (select *, row_number() over w = 1 {"".join(f" or {c} is distinct from lag({c}) over w" for c in _TRACKED)} as is_new
    from daily window w as (partition by cik order by filed_date)),
company as (select {sql_key("cik", "filed_date")} as company_sk, cik, {", ".join(_TRACKED)}, filed_date as valid_from,
    coalesce((lead(filed_date) over w - 1)::date, date '9999-12-31') as valid_to, (row_number() over w)::int as version_number, lead(filed_date) over w is null as is_current
    from marked where is_new window w as (partition by cik order by filed_date))"""


@query(f"with {t.SUB}, {COMPANY} select * from company")
def m06_company(spark, sf):
    return company(spark, sf)


FILING = f"""filing as (select {sql_key("adsh")} as filing_sk, adsh, cik, form_type, filer_status, case filer_status when '1-LAF' then 'Large accelerated'
    when '2-ACC' then 'Accelerated' when '4-NON' then 'Non-accelerated' else 'Not stated' end as filer_status_name, period_end_date, fiscal_year, fiscal_period, filed_date, filing_lag_days,
    is_amendment, was_later_amended from sub)"""


def filing(spark, sf) -> DataFrame:
    name = t.case(F.col("filer_status"), STATUS_NAMES, F.lit("Not stated"))
    return t.submissions(spark, sf).select(surrogate_key("adsh").alias("filing_sk"), "adsh", "cik", "form_type", "filer_status", name.alias("filer_status_name"), "period_end_date", "fiscal_year", "fiscal_period", "filed_date", "filing_lag_days", "is_amendment", "was_later_amended")


@query(f"with {t.SUB}, {FILING} select * from filing")
def m07_filing(spark, sf):
    return filing(spark, sf)


@query(f"""with {t.NUM}, {t.TAG}, {t.PRE}, n as (select tag, taxonomy_version, statement_code, count(*) as n from pre where statement_code is not null group by all),
    m as (select tag, taxonomy_version, first(statement_code order by n desc, statement_code) as statement_code, max(n) as placements from n group by 1, 2)
    select {sql_key("tag", "taxonomy_version")} as tag_sk, tags.*, statement_code, coalesce(placements, 0) as placements from tags left join m using (tag, taxonomy_version)""")
def m08_tag(spark, sf):
    """The dictionary with each tag's most frequent statement and how often it stands there."""
    key = ["tag", "taxonomy_version"]
    counted = t.presentation(spark, sf).where("statement_code is not null").groupBy(*key, "statement_code").agg(F.count("*").alias("n"))
    modal = counted.groupBy(*key).agg(F.min_by("statement_code", F.struct((-F.col("n")).alias("n"), "statement_code")).alias("statement_code"), F.max("n").alias("placements"))
    known = t.tags(spark, sf).join(modal, key, "left")
    return known.select(surrogate_key(*key).alias("tag_sk"), *key, "is_custom", "tag_label", "statement_code", F.coalesce("placements", F.lit(0)).alias("placements"))


def calendar(spark, sf) -> DataFrame:
    """Every day of the years in which something was filed."""
    d = F.col("date_day")
    ends = t.submissions(spark, sf).agg(F.min("filed_date").alias("a"), F.max("filed_date").alias("b"))  # one row
    days = ends.select(F.explode(F.sequence(F.trunc("a", "year"), F.date_sub(F.add_months(F.trunc("b", "year"), 12), 1))).alias("date_day"))
    return days.select(date_key(d).alias("date_sk"), d, F.year(d).alias("calendar_year"), F.quarter(d).alias("calendar_quarter"), F.month(d).alias("calendar_month"), F.weekofyear(d).alias("iso_week"), (F.weekday(d) + 1).alias("day_of_week"), (F.weekday(d) < 5).alias("is_weekday"), F.trunc(d, "month").alias("month_start_date"), F.last_day(d).alias("month_end_date"), (F.year(d) + (F.month(d) >= 7).cast("int")).alias("fiscal_year"))


@query(f"""with {t.SUB}, days as (select unnest(generate_series(date_trunc('year', min(filed_date)), date_trunc('year', max(filed_date)) + interval 1 year - interval 1 day, interval 1 day))::date as d from sub)
    select strftime(d, '%Y%m%d')::int as date_sk, d as date_day, year(d)::int as calendar_year, quarter(d)::int as calendar_quarter, month(d)::int as calendar_month,
    week(d)::int as iso_week, isodow(d)::int as day_of_week, isodow(d) < 6 as is_weekday, date_trunc('month', d)::date as month_start_date, last_day(d) as month_end_date,
    (year(d) + (month(d) >= 7)::int)::int as fiscal_year, (select count(*) from sub where filed_date = d) as filings from days""")
def m09_date(spark, sf):
    """The calendar, with how much was filed on each day."""
    filed = t.submissions(spark, sf).groupBy(F.col("filed_date").alias("date_day")).agg(F.count("*").alias("filings"))
    return calendar(spark, sf).join(filed, "date_day", "left").withColumn("filings", F.coalesce("filings", F.lit(0)))


def _located(spark, sf, since: str | None = None, until: str | None = None) -> DataFrame:
    """Facts with what the keys of their dimensions are made of, of filings between two dates.

    The company's version and the calendar are inner joins: a gap drops facts and an overlap doubles them, which the
    assertion on the grain then finds. Tags that the dictionary lacks keep their facts.
    """

    def between(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("filed_date") >= F.lit(since).cast("date")) if since else rows
        return rows.where(F.col("filed_date") <= F.lit(until).cast("date")) if until else rows

    filings = between(t.submissions(spark, sf).select("adsh", "cik", "filed_date"))
    days = calendar(spark, sf).select(F.col("date_day").alias("filed_date"))
    known = t.tags(spark, sf).select("tag", "taxonomy_version", F.lit(True).alias("is_known"))
    at = ops.valid_at(filings, company(spark, sf).select("cik", "valid_from", "valid_to"), "cik", "filed_date").drop("valid_to")
    at = at.join(F.broadcast(days), "filed_date")  # a row for each day
    rows = t.numeric(spark, sf)
    if since or until:  # most facts of other filings go before they are shuffled
        every = t.filed(spark, sf)
        rows = ops.perhaps_in(rows, F.col("adsh"), between(every).select("adsh"), every.count())
    # tags of published taxonomies are in very many facts and have few entries, a filer's own ones (their version is the filing) the reverse
    rows = ops.split_lookup(rows, known, ["tag", "taxonomy_version"], published(), t.parts(spark, sf, "lineitem"))
    return t.dealt(rows, sf, "lineitem", "adsh").join(at.hint("shuffle_hash"), "adsh")


def _fact_columns() -> list[str | Column]:
    """The fact table's columns, of located facts. Keys are made last, so no shuffle carries them."""
    tag_sk = F.when(F.col("is_known"), surrogate_key("tag", "taxonomy_version"))
    flags = (c.alias(n) for n, c in _flags().items())
    return [surrogate_key(*_GRAIN).alias("fact_sk"), surrogate_key("cik", "valid_from").alias("company_sk"), surrogate_key("adsh").alias("filing_sk"), tag_sk.alias("tag_sk"), date_key(F.col("filed_date")).alias("filed_date_sk"), "adsh", *FACT_KEY, "taxonomy_version", "filed_date", "value", "footnote", *flags]


def fact_table(spark, sf, since: str | None = None, until: str | None = None) -> DataFrame:
    """Facts with the keys of their dimensions, of filings between two dates."""
    return _located(spark, sf, since, until).select(*_fact_columns())


FACT_TABLE = f"""select {sql_key(*("f." + c for c in _GRAIN))} as fact_sk, company_sk,
    {sql_key("f.adsh")} as filing_sk, tag_sk, strftime(f.filed_date, '%Y%m%d')::int as filed_date_sk, f.adsh, f.cik, coregistrant, segments, f.tag, period_end_date, qtrs,
    unit_of_measure, f.taxonomy_version, f.filed_date, value, footnote, qtrs = 0 as is_instant, qtrs = 4 as is_annual, segments <> '' as has_segments
    from fact f join company c on c.cik = f.cik and f.filed_date between valid_from and valid_to
    left join (select tag, taxonomy_version, {sql_key("tag", "taxonomy_version")} as tag_sk from tags) p on p.tag = f.tag and p.taxonomy_version = f.taxonomy_version"""


@query(f"with {t.FACT}, {COMPANY}, {t.TAG} {FACT_TABLE}")
def m05_fact(spark, sf):
    return fact_table(spark, sf)


def update_facts(spark, sf: str, path: str) -> None:
    """Bring a written fact table up to date: facts filed since its own last date, less the look-back, replace their keys.

    Only the months of that window, and those that a replaced key lay in before, are read and written again; rows whose
    keys the source no longer has stay.
    """
    months = [m for m in keyed.current(spark, path).months if m != keyed.UNDATED]
    last = keyed.read(spark, path, since=max(months)).agg(F.max("filed_date")).first()[0] if months else None
    since = None if last is None else str(spark.sql(f"select date_sub(date '{last}', {DEFAULT.look_back_days})").first()[0])
    write_facts(spark, sf, path, since=since)


def write_facts(spark, sf: str, path: str, since: str | None = None, until: str | None = None) -> None:
    """Merge the facts of filings between two dates into a written fact table."""
    keyed.merge(_located(spark, sf, since, until), path, "fact_sk", "filed_date", near="adsh", columns=_fact_columns(), parts=t.parts(spark, sf, "lineitem"))


def merge_facts(batch: DataFrame, path: str, stream: str | None = None, number: int | None = None) -> bool:
    """Replace the facts of the batch's keys in a written fact table, whatever month they were filed in; the first batch makes it."""
    return keyed.merge(batch, path, "fact_sk", "filed_date", stream, number, near="adsh")


@query(f"with {t.FACT}, {COMPANY}, {t.TAG} {FACT_TABLE}")
def snk03_incremental_fact(spark, sf):
    """The fact table written up to a date, then brought up to date: as good as a full build."""
    path = f"{folder(spark)}/fact-{spark.sql('select uuid()').first()[0]}"
    write_facts(spark, sf, path, until="1998-06-30")
    update_facts(spark, sf, path)
    return keyed.read(spark, path)


def _changes(spark, sf, share: str = DEFAULT.material, key: list[str] = FACT_KEY) -> DataFrame:
    found = ops.revisable(t.dealt(t.facts(spark, sf), sf, "lineitem", *key), key, "filed_date", "value", "adsh", share)
    change = F.col("absolute_revision").cast("double") / F.nullif(F.abs("first_reported_value"), F.lit(0)).cast("double")
    return found.select(
        surrogate_key(*key).alias("restatement_sk"),
        "*",
        F.round(change, 6).alias("pct_revision"),
        F.datediff("first_revision_filed_date", "first_filed_date").alias("days_to_first_revision"),
        F.when(F.col("absolute_revision") > 0, "increase").otherwise("decrease").alias("revision_direction"),
    )


@stored
def changes(spark, sf) -> DataFrame:
    """Every fact that was reported on several dates, with `is_revised`: one pass over the facts serves all models."""
    return _changes(spark, sf)


def restatements(spark, sf, share: str = DEFAULT.material, key: list[str] = FACT_KEY) -> DataFrame:
    rows = changes(spark, sf) if (share, key) == (DEFAULT.material, FACT_KEY) else _changes(spark, sf, share, key)
    return rows.where("is_revised").drop("is_revised")


REPORTS = f"""
reports as (select {_KEY}, filed_date, last(value order by adsh, value) as value, last(adsh order by adsh, value) as adsh from fact where value is not null group by {_KEY}, filed_date)"""
RESTATED = f"""{REPORTS},
firsts as (select *, first_value(value) over w as v1, last_value(value) over w as v2, first_value(filed_date) over w as d1, last_value(filed_date) over w as d2,
    first_value(adsh) over w as a1, last_value(adsh) over w as a2 from reports window w as (partition by {_KEY} order by filed_date rows between unbounded preceding and unbounded following)),
rmarked as (select *, value <> v1 and (v1 = 0 or abs(value - v1) >= 0.001 * abs(v1)) as departs from firsts),
groups as (select {_KEY}, any_value(v1) as first_reported_value, any_value(d1) as first_filed_date, any_value(a1) as first_adsh, any_value(v2) as latest_reported_value,
    any_value(d2) as latest_filed_date, any_value(a2) as latest_adsh, count(*) as n_reports, count(distinct value) as n_distinct_values,
    min(filed_date) filter (where departs) as first_revision_filed_date, arg_min(adsh, filed_date) filter (where departs) as revising_adsh
    from rmarked group by {_KEY} having count(*) > 1),
restated as (select {sql_key(*FACT_KEY)} as restatement_sk, *, (latest_reported_value - first_reported_value) as absolute_revision,
    round((latest_reported_value - first_reported_value)::double / nullif(abs(first_reported_value), 0)::double, 6) as pct_revision,
    (first_revision_filed_date - first_filed_date)::int as days_to_first_revision, case when latest_reported_value > first_reported_value then 'increase' else 'decrease' end as revision_direction
    from groups where latest_reported_value <> first_reported_value and (first_reported_value = 0 or abs(latest_reported_value - first_reported_value) >= 0.001 * abs(first_reported_value)))"""


@query(f"with {t.FACT}, {RESTATED} select r.*, s.form_type as revising_form_type from restated r left join sub s on s.adsh = r.revising_adsh")
def m10_restatements(spark, sf):
    forms = t.submissions(spark, sf).select(F.col("adsh").alias("revising_adsh"), F.col("form_type").alias("revising_form_type"))
    return restatements(spark, sf).join(forms, "revising_adsh", "left")
