"""Feature tables that know only the past, and the twin that doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions.columns import major_group
from tidemark.operators import bitemporal as ops
from tidemark.plans import tables as t
from tidemark.plans.registry import query
from tidemark.plans.marts import COMPANY, RESTATED, company, published, restatements
from tidemark.sources.store import stored

_H = DEFAULT.horizon_days
_STATUS = {"is_large_accelerated_filer": "1-LAF", "is_accelerated_filer": "2-ACC", "is_non_accelerated_filer": "4-NON"}


def _group(version: str) -> str:
    return f"case when regexp_full_match({version}.sic_code, '[0-9]{{4}}') then left({version}.sic_code, 2) end"


PERIODIC = f"""
firstrev as (select first_adsh as adsh, min(first_revision_filed_date) as revision_first_seen_date from restated where segments = '' and coregistrant = '' group by 1),
mix as (select adsh, count(*) as n_facts, count(*) filter (where is_custom) as n_custom_facts from num left join tags using (tag, taxonomy_version) group by 1),
periodic as (select s.adsh, s.cik, s.form_type, s.filed_date, s.period_end_date, revision_first_seen_date, s.filing_lag_days, s.filer_status, {", ".join(f"coalesce(s.filer_status = '{v}', false) as {k}" for k, v in _STATUS.items())},
    n_facts, n_custom_facts, round(n_custom_facts / n_facts, 6) as custom_tag_share, {_group('c')} as sic_major_group_at_filing, {_group('now')} as sic_major_group_now
    from sub s join company c on c.cik = s.cik and s.filed_date between c.valid_from and c.valid_to join company now on now.cik = s.cik and now.is_current
    left join firstrev f on f.adsh = s.adsh left join mix m on m.adsh = s.adsh where s.form_type in ('10-K', '10-Q'))"""
BASE = f"""{PERIODIC},
base as (select *, coalesce(revision_first_seen_date <= filed_date + {_H}, false) as was_restated from periodic where filed_date + {_H} <= (select max(filed_date) from sub))"""
SOURCES = f"{t.FACT}, {t.TAG}, {COMPANY}, {RESTATED}, {BASE}"


@stored
def periodic(spark, sf) -> DataFrame:
    """Every annual and quarterly report with what is known of it: status, custom tags, sector then and now, first revision."""
    filings = t.submissions(spark, sf).where(F.col("form_type").isin("10-K", "10-Q")).select("adsh", "cik", "form_type", "filed_date", "period_end_date", "filing_lag_days", "filer_status")
    versions = company(spark, sf)
    filings = t.dealt(filings, sf, "orders", "cik")
    at = ops.valid_at(filings, versions.select("cik", major_group(F.col("sic_code")).alias("sic_major_group_at_filing"), "valid_from", "valid_to"), "cik", "filed_date").drop("valid_from", "valid_to")
    now = versions.where("is_current").select("cik", major_group(F.col("sic_code")).alias("sic_major_group_now"))
    seen = restatements(spark, sf).where("segments = '' and coregistrant = ''").groupBy(F.col("first_adsh").alias("adsh")).agg(F.min("first_revision_filed_date").alias("revision_first_seen_date"))
    known = ops.split_lookup(t.numeric(spark, sf).select("adsh", "tag", "taxonomy_version"), t.tags(spark, sf).select("tag", "taxonomy_version", "is_custom"), ["tag", "taxonomy_version"], published(), t.parts(spark, sf, "lineitem"))
    mix = known.groupBy("adsh").agg(F.count("*").alias("n_facts"), F.count_if("is_custom").alias("n_custom_facts"))
    rows = t.dealt(at.join(now, "cik"), sf, "orders", "adsh").join(seen, "adsh", "left").join(mix, "adsh", "left")
    status = {k: F.coalesce(F.col("filer_status") == v, F.lit(False)) for k, v in _STATUS.items()}
    return rows.withColumns({**status, "custom_tag_share": F.round(F.col("n_custom_facts") / F.col("n_facts"), 6)})


def labelled(rows: DataFrame, last: DataFrame, horizon) -> DataFrame:
    """Reports whose horizon had passed on the last date of the data, with `was_restated` within it. `last` has one row."""
    due = F.date_add("filed_date", horizon)
    return rows.crossJoin(F.broadcast(last)).where(due <= F.col("last")).drop("last").withColumn("was_restated", F.coalesce(F.col("revision_first_seen_date") <= due, F.lit(False)))


def last_filed(spark, sf) -> DataFrame:
    return t.submissions(spark, sf).agg(F.max("filed_date").alias("last"))


@stored
def base(spark, sf) -> DataFrame:
    return labelled(periodic(spark, sf), last_filed(spark, sf), F.lit(_H))


@query(f"with {SOURCES} select * from base")
def m27_feature_base(spark, sf):
    return base(spark, sf)


_FEATURES = ["adsh", "cik", "form_type", "filed_date", "period_end_date", "was_restated", "filing_lag_days", *_STATUS, "custom_tag_share"]
PIT = f"""pit as (select {", ".join(_FEATURES)}, prior_restatement_count, round(coalesce(case when sector is not null and sector_n > 0 then sector_hit / sector_n end, case when market_n > 0 then market_hit / market_n end, 0), 6) as sector_restatement_rate,
    sector as sic_major_group, case when sector is null then 0 else sector_n end as sector_prior_resolved_filings, market_n as market_prior_resolved_filings from (
    select b.*, sic_major_group_at_filing as sector, (select count(*) from base e where e.cik = b.cik and e.revision_first_seen_date < b.filed_date) as prior_restatement_count,
    (select count(*) from base e where e.sic_major_group_at_filing = b.sic_major_group_at_filing and e.filed_date + {_H} < b.filed_date) as sector_n,
    (select count(*) from base e where e.sic_major_group_at_filing = b.sic_major_group_at_filing and e.was_restated and e.filed_date + {_H} < b.filed_date) as sector_hit,
    (select count(*) from base e where e.filed_date + {_H} < b.filed_date) as market_n, (select count(*) from base e where e.was_restated and e.filed_date + {_H} < b.filed_date) as market_hit from base b))"""


def rate(hit: str, n: str):
    return F.when(F.col(n) > 0, F.col(hit) / F.col(n))


def point_in_time(rows: DataFrame, horizon: int = _H) -> DataFrame:
    """Features of each report as a reader knew them on the day of filing: counts of what strictly earlier days had brought.

    A sector without resolved reports, or none, falls back on the market's rate, and that on 0.
    """
    seen = rows.where("revision_first_seen_date is not null").select("cik", F.col("revision_first_seen_date").alias("filed_date"))
    out = ops.strictly_prior(rows, seen, "cik", "filed_date", {"prior_restatement_count": F.count("*")})
    resolved = rows.select(F.col("sic_major_group_at_filing").alias("sic_major_group"), F.date_add("filed_date", horizon).alias("filed_date"), "was_restated")
    counts = lambda name: {f"{name}_prior_resolved_filings": F.count("*"), f"{name}_hit": F.count_if("was_restated")}
    out = ops.strictly_prior(out.withColumnRenamed("sic_major_group_at_filing", "sic_major_group"), resolved, "sic_major_group", "filed_date", counts("sector"), few=True)
    # the market's history is one short series of days
    out = ops.strictly_prior(out.withColumn("market", F.lit("all")), resolved.withColumn("market", F.lit("all")), "market", "filed_date", counts("market"), few=True)
    value = F.coalesce(rate("sector_hit", "sector_prior_resolved_filings"), rate("market_hit", "market_prior_resolved_filings"), F.lit(0.0))
    return out.select(*_FEATURES, "prior_restatement_count", F.round(value, 6).alias("sector_restatement_rate"), "sic_major_group", "sector_prior_resolved_filings", "market_prior_resolved_filings")


def point_in_time_by(reports: DataFrame, last: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """`point_in_time` under several horizons, told by `horizon`: each counts its own reports by its own days. `last` has one row.

    A company's revisions are counted for all horizons at once, so reports are shuffled before they are multiplied; what
    sectors and the market had resolved is broadcast.
    """
    reports = reports.crossJoin(F.broadcast(last))
    due = lambda h: F.date_add("filed_date", h) <= F.col("last")
    seen = reports.where("revision_first_seen_date is not null").select("cik", F.col("revision_first_seen_date").alias("filed_date"), *(due(h).alias(f"_due_{h}") for h in horizons))
    reports = ops.strictly_prior(reports.drop("last"), seen, "cik", "filed_date", {f"_before_{h}": F.count_if(f"_due_{h}") for h in horizons})
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_before_{h}").alias("prior_restatement_count")) for h in horizons))
    rows = labelled(reports.select("*", F.inline(each)).drop(*(f"_before_{h}" for h in horizons)), last, F.col("horizon"))
    keyed = lambda c: F.when(F.col(c).isNotNull(), F.struct("horizon", c))  # noqa: E731  null keys have no history
    out = rows.withColumnRenamed("sic_major_group_at_filing", "sic_major_group").withColumns({"sector": keyed("sic_major_group"), "market": F.struct("horizon")})
    resolved = out.select("sector", "market", F.expr("date_add(filed_date, horizon)").alias("filed_date"), "was_restated")
    counts = lambda name: {f"{name}_prior_resolved_filings": F.count("*"), f"{name}_hit": F.count_if("was_restated")}
    for name in ("sector", "market"):
        out = ops.strictly_prior(out, resolved, name, "filed_date", counts(name), few=True)
    value = F.coalesce(rate("sector_hit", "sector_prior_resolved_filings"), rate("market_hit", "market_prior_resolved_filings"), F.lit(0.0))
    return out.select("horizon", *_FEATURES, "prior_restatement_count", F.round(value, 6).alias("sector_restatement_rate"), "sic_major_group", "sector_prior_resolved_filings", "market_prior_resolved_filings")


@stored
def pit(spark, sf) -> DataFrame:
    return point_in_time(base(spark, sf))


@query(f"with {SOURCES}, {PIT} select * from pit")
def m28_feature_pit(spark, sf):
    return pit(spark, sf)


NAIVE = f"""naive as (select {", ".join("b." + c for c in _FEATURES)}, n_revised as prior_restatement_count, round(coalesce(s.rate, m.rate), 6) as sector_restatement_rate, sic_major_group_now as sic_major_group, coalesce(s.n, 0) as sector_prior_resolved_filings, m.n as market_prior_resolved_filings
    from base b cross join (select count(*) as n, avg(was_restated::int) as rate from base) m left join (select sic_major_group_now as g, count(*) as n, avg(was_restated::int) as rate from base group by 1) s on s.g = sic_major_group_now
    join (select cik, count(revision_first_seen_date) as n_revised from base group by 1) r using (cik))"""


def knowing_all(rows: DataFrame) -> DataFrame:
    """The same features over the whole range, the future and the report itself too, by the sector of today: leaky on purpose."""
    hit = F.avg(F.col("was_restated").cast("int"))
    sector = rows.where("sic_major_group_now is not null").groupBy("sic_major_group_now").agg(F.count("*").alias("n"), hit.alias("rate"))
    market = rows.agg(F.count("*").alias("market_n"), hit.alias("market_rate"))  # one row
    own = rows.groupBy("cik").agg(F.count("revision_first_seen_date").alias("prior_restatement_count"))
    # at most a hundred two-digit sectors
    out = rows.crossJoin(F.broadcast(market)).join(F.broadcast(sector), "sic_major_group_now", "left").join(own, "cik")
    return out.select(*_FEATURES, "prior_restatement_count", F.round(F.coalesce("rate", "market_rate"), 6).alias("sector_restatement_rate"), F.col("sic_major_group_now").alias("sic_major_group"), F.coalesce("n", F.lit(0)).alias("sector_prior_resolved_filings"), F.col("market_n").alias("market_prior_resolved_filings"))


@query(f"with {SOURCES}, {NAIVE} select * from naive")
def m29_feature_naive(spark, sf):
    return knowing_all(base(spark, sf))


_HORIZONS = (90, 120, 180, 240, 270)


@query(f"""with {SOURCES}, h as (select unnest({list(_HORIZONS)})::int as horizon), x as (select horizon, filed_date, coalesce(revision_first_seen_date <= filed_date + horizon, false) as hit from periodic, h where filed_date + horizon <= (select max(filed_date) from sub))
    select horizon, count(*) as n_filings, count(*) filter (where filed_date >= date '1997-01-01') as n_test, max(filed_date) as last_filed_date, round(100.0 * count(*) filter (where hit and filed_date >= date '1997-01-01') / nullif(count(*) filter (where filed_date >= date '1997-01-01'), 0), 4)::double as pct_test_restated,
    count(*) filter (where hit) as n_restated from x group by 1""")
def d21_horizon_sweep(spark, sf):
    """Population and label rate by horizon, all horizons in one pass over the reports."""
    rows = periodic(spark, sf).withColumn("horizon", F.explode(F.array(*map(F.lit, _HORIZONS))))
    test = F.col("filed_date") >= F.lit("1997-01-01").cast("date")
    return labelled(rows, last_filed(spark, sf), F.col("horizon")).groupBy("horizon").agg(F.count("*").alias("n_filings"), F.count_if(test).alias("n_test"), F.max("filed_date").alias("last_filed_date"), F.round(F.lit(100.0) * F.count_if(test & F.col("was_restated")) / F.nullif(F.count_if(test), F.lit(0)), 4).alias("pct_test_restated"), F.count_if("was_restated").alias("n_restated"))


@query(f"""with {SOURCES}, {PIT}, q as (select distinct sic_major_group_at_filing as g, filed_date from base where sic_major_group_at_filing is not null),
    e as (select q.g, q.filed_date, count(base.adsh) as n from q left join base on base.sic_major_group_at_filing = q.g and base.filed_date + {_H} < q.filed_date group by all),
    k as (select q.cik, q.filed_date, count(base.adsh) as n from (select distinct cik, filed_date from base) q left join base on base.cik = q.cik and base.revision_first_seen_date < q.filed_date group by all)
    select count(*) as n_filings, count(*) filter (where sector_prior_resolved_filings is distinct from coalesce(e.n, 0)) as n_different, count(*) filter (where prior_restatement_count is distinct from k.n) as n_different_prior
    from pit left join e on e.g = pit.sic_major_group and e.filed_date = pit.filed_date left join k on k.cik = pit.cik and k.filed_date = pit.filed_date""")
def t08_pit_recomputed(spark, sf):
    """The features against a plain recomputation: each sector's resolved reports, and each company's revised ones, counted by range joins."""
    rows = base(spark, sf)
    points = rows.where("sic_major_group_at_filing is not null").select(F.col("sic_major_group_at_filing").alias("sic_major_group"), "filed_date").distinct()
    # sectors and days are few, whatever the number of reports
    past = rows.groupBy(F.col("sic_major_group_at_filing").alias("g"), F.date_add("filed_date", _H).alias("known")).agg(F.count("*").alias("resolved"))
    expected = points.join(F.broadcast(past), (F.col("g") == F.col("sic_major_group")) & (F.col("known") < F.col("filed_date")), "left").groupBy("sic_major_group", "filed_date").agg(F.sum("resolved").alias("n"))
    seen = rows.where("revision_first_seen_date is not null").select(F.col("cik").alias("c"), "revision_first_seen_date")
    before = rows.select("cik", "filed_date").distinct().join(seen, (F.col("c") == F.col("cik")) & (F.col("revision_first_seen_date") < F.col("filed_date")), "left")
    before = before.groupBy("cik", "filed_date").agg(F.count("c").alias("n_before"))
    both = pit(spark, sf).join(F.broadcast(expected), ["sic_major_group", "filed_date"], "left").join(before, ["cik", "filed_date"], "left")
    different = lambda c, n: F.count_if(~F.col(c).eqNullSafe(n))
    return both.agg(F.count("*").alias("n_filings"), different("sector_prior_resolved_filings", F.coalesce("n", F.lit(0))).alias("n_different"), different("prior_restatement_count", F.col("n_before")).alias("n_different_prior"))
