"""Companies ranked among their peers, as known on a date and as known at last."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions.columns import major_group
from tidemark.operators import bitemporal as ops
from tidemark.plans import tables as t
from tidemark.plans.registry import query
from tidemark.plans.marts import COMPANY, company
from tidemark.sources.store import stored

#: Label and date of the views; facts filed before the date are known.
VIEWS = {"point_in_time": "1999-06-30", "latest": "9999-12-31"}
#: Revenue tags by preference, and the tag of income.
REVENUE, INCOME = ("T0", "T1", "T2"), "T3"
#: The driver's tables have few companies a sector; the library's own least number is DEFAULT.least_peers.
LEAST = 2
_VALUES = {"revenue": "revenue", "net_income": "net income", "prior_year_revenue": "revenue of the year before"}


def _consolidated(spark, sf) -> DataFrame:
    return t.facts(spark, sf).where("value is not null and segments = '' and coregistrant = '' and unit_of_measure = 'USD' and qtrs = 4")


@stored
def metrics(spark, sf) -> DataFrame:
    """Margin and growth of each company's year, once for each view; the year is the last one that the earlier view has.

    Facts are read once and go to their company; all that follows stays there. `seen_revenues` has every revenue of the
    year that the view could know, picked or not.
    """
    known = {view: F.col("filed_date") < F.lit(date).cast("date") for view, date in VIEWS.items()}
    revenue = F.col("tag").isin(*REVENUE)
    facts = t.dealt(_consolidated(spark, sf).where(F.col("tag").isin(*REVENUE, INCOME)), sf, "lineitem", "cik")
    # of each tag, the last report that a view knows
    last = lambda seen: F.max(F.when(seen, F.struct("filed_date", "adsh", "value")))["value"]
    picks = facts.groupBy("cik", "period_end_date", "tag").agg(*(c for v, seen in known.items() for c in (last(seen).alias(v), F.collect_set(F.when(seen & revenue, F.col("value"))).alias(f"{v}_seen"))))
    priority = t.case(F.col("tag"), {tag: k for k, tag in enumerate(REVENUE)})
    first = lambda v: F.min_by(F.struct(F.col("tag").alias("revenue_tag"), F.col(v).alias("revenue")), F.when(revenue & F.col(v).isNotNull(), priority))
    sides = lambda v: (first(v).alias(v), F.max(F.when(F.col("tag") == INCOME, F.col(v))).alias(f"{v}_income"), F.flatten(F.collect_list(f"{v}_seen")).alias(f"{v}_seen"))
    years = picks.groupBy("cik", "period_end_date").agg(*(c for v in VIEWS for c in sides(v)))
    each = F.array(*(F.struct(F.lit(v).alias("view"), F.lit(date).cast("date").alias("as_of"), F.col(f"{v}.revenue_tag").alias("revenue_tag"), F.col(f"{v}.revenue").alias("revenue"), F.col(f"{v}_income").alias("net_income"), F.col(f"{v}_seen").alias("seen_revenues")) for v, date in VIEWS.items()))
    rows = years.select("cik", "period_end_date", F.inline(each)).where("revenue > 0 and period_end_date is not null").withColumn("_day", F.datediff("period_end_date", F.lit("1970-01-01").cast("date")))
    # years that end 350 to 380 days before; the nearest to a year, then the earliest
    before = F.collect_list(F.struct(F.col("_day").alias("day"), F.col("revenue").alias("prior"))).over(Window.partitionBy("cik", "view").orderBy("_day").rangeBetween(-380, -350))
    nearest = F.array_min(F.transform("_before", lambda x: F.struct(F.abs(F.col("_day") - x["day"] - 365).alias("off"), x["day"].alias("day"), x["prior"].alias("prior"))))["prior"]
    rows = rows.withColumn("_before", before).where("net_income is not null and size(_before) > 0").withColumn("prior_year_revenue", nearest)
    target = F.max(F.when(F.col("view") == "point_in_time", F.col("period_end_date"))).over(Window.partitionBy("cik"))
    rows = rows.withColumn("_target", target).where("period_end_date = _target").drop("_day", "_before", "_target")
    # the version that held on the view's own date
    on = reduce(or_, (F.lit(date).cast("date").between(F.col("valid_from"), F.col("valid_to")) for date in VIEWS.values()))
    sic = company(spark, sf).where(on).select("cik", "sic_code", major_group(F.col("sic_code")).alias("sic_major_group"), "valid_from", "valid_to").where("sic_major_group is not null")
    d = lambda c: F.col(c).cast("double")
    rows = ops.valid_at(rows, sic, "cik", "as_of").drop("as_of", "valid_from", "valid_to")
    return rows.withColumns({"net_margin": d("net_income") / d("revenue"), "revenue_growth": d("revenue") / d("prior_year_revenue") - 1})


def ranked(rows: DataFrame, least: int) -> DataFrame:
    """Percentile and quartile of margin and growth among a view's peers; 1 is the best quartile. Companies in both views only."""
    both = rows.groupBy("cik").agg(F.count_distinct("view").alias("n")).where("n = 2").select("cik")
    peers = Window.partitionBy("view", "sic_major_group")
    rows = rows.join(both, "cik").withColumn("n_peers", F.count("*").over(peers)).where(F.col("n_peers") >= least)
    for name, value in (("margin", "net_margin"), ("growth", "revenue_growth")):
        line = peers.orderBy(value, "cik")
        rows = rows.withColumns({f"{name}_percentile": F.percent_rank().over(peers.orderBy(value)), f"{name}_quartile": F.lit(DEFAULT.quartiles + 1) - F.ntile(DEFAULT.quartiles).over(line)})
    return rows


def comparables(spark, sf, least: int = DEFAULT.least_peers) -> DataFrame:
    rows = ranked(metrics(spark, sf), least)
    carried = ["sic_code", "sic_major_group", "n_peers", *_VALUES, "net_margin", "margin_percentile", "margin_quartile", "revenue_growth", "growth_percentile", "growth_quartile"]
    side = lambda view, short: rows.where(F.col("view") == view).select("cik", "period_end_date", *(F.col(c).alias(f"{short}_{c}") for c in carried))
    both = side("point_in_time", "pit").join(side("latest", "latest"), ["cik", "period_end_date"])
    differs = lambda c: ~F.col(f"pit_{c}").eqNullSafe(F.col(f"latest_{c}"))
    moved = lambda c: F.col(f"latest_{c}") - F.col(f"pit_{c}")
    own = differs("revenue") | differs("net_income") | differs("prior_year_revenue")
    out = both.withColumns({"sic_group_changed": differs("sic_major_group"), "own_values_changed": own})
    for n in ("margin", "growth"):
        out = out.withColumns({f"{n}_quartile_changed": differs(f"{n}_quartile"), f"{n}_quartile_shift": moved(f"{n}_quartile"), f"{n}_percentile_shift": F.round(moved(f"{n}_percentile"), 4)})
        out = out.withColumn(f"{n}_change_is_material", F.col(f"{n}_quartile_changed") & (F.abs(F.round(moved(f"{n}_percentile"), 9)) >= DEFAULT.percentile_shift))
    any_ = F.col("margin_quartile_changed") | F.col("growth_quartile_changed")
    reason = F.when(~any_, "unchanged").when(F.col("own_values_changed") & F.col("sic_group_changed"), "restated_and_reclassified").when(F.col("own_values_changed"), "own_values_restated").when(F.col("sic_group_changed"), "sic_reclassified").otherwise("peer_distribution_moved")
    out = out.withColumns({"any_quartile_changed": any_, "any_material_quartile_change": F.col("margin_change_is_material") | F.col("growth_change_is_material"), "change_attribution": reason})
    rounded: dict[str, Column] = {f"{v}_{c}": F.round(f"{v}_{c}", n) for v in ("pit", "latest") for c, n in (("net_margin", 6), ("revenue_growth", 6), ("margin_percentile", 4), ("growth_percentile", 4))}
    names = company(spark, sf).where("is_current").select("cik", "company_name")
    return out.withColumns(rounded).join(names, "cik", "left")


_SHIFT = {n: f"round(l.{n}_percentile - p.{n}_percentile, 9)" for n in ("margin", "growth")}
_VIEWS_SQL = ", ".join(f"('{k}', date '{v}')" for k, v in VIEWS.items())
PEERS = f"""v(view, as_of) as (values {_VIEWS_SQL}),
    k as (select * from (select *, row_number() over (partition by view, cik, tag, period_end_date order by filed_date desc, adsh desc, value desc) as rn from fact join v on filed_date < as_of
        where value is not null and segments = '' and coregistrant = '' and unit_of_measure = 'USD' and qtrs = 4) where rn = 1),
    r as (select view, cik, period_end_date, arg_min(tag, tag) as revenue_tag, arg_min(value, tag) as revenue from k where tag in ('T0', 'T1', 'T2') group by 1, 2, 3 having arg_min(value, tag) > 0),
    y as (select r.*, i.value as net_income, q.revenue as prior_year_revenue, row_number() over (partition by r.view, r.cik, r.period_end_date order by abs((r.period_end_date - q.period_end_date) - 365), q.period_end_date) as near
        from r join k i on i.tag = 'T3' and i.view = r.view and i.cik = r.cik and i.period_end_date = r.period_end_date join r q on q.view = r.view and q.cik = r.cik and r.period_end_date - q.period_end_date between 350 and 380),
    metric as (select y.* exclude (near), c.sic_code, left(c.sic_code, 2) as sic_major_group, net_income::double / revenue::double as net_margin, revenue::double / prior_year_revenue::double - 1 as revenue_growth
        from y join v using (view) join company c on c.cik = y.cik and v.as_of between valid_from and valid_to and regexp_full_match(c.sic_code, '[0-9]{{4}}')
        where near = 1 and (y.cik, y.period_end_date) in (select cik, max(period_end_date) from y where near = 1 and view = 'point_in_time' group by 1)),
    sized as (select *, count(*) over (partition by view, sic_major_group) as n_peers from metric where cik in (select cik from metric group by 1 having count(*) = 2)),
    rank as (select *, {", ".join(f"percent_rank() over (partition by view, sic_major_group order by {c}) as {n}_percentile, 5 - ntile(4) over (partition by view, sic_major_group order by {c}, cik) as {n}_quartile" for n, c in (("margin", "net_margin"), ("growth", "revenue_growth")))}
        from sized where n_peers >= {LEAST}),
    compared as (select cik, p.period_end_date, {", ".join(f"{a}.{c} as {n}_{c}" for a, n in (("p", "pit"), ("l", "latest")) for c in ("sic_code", "sic_major_group", "n_peers", *_VALUES))},
        {", ".join(f"round({a}.{c}, {d}) as {n}_{c}" for a, n in (("p", "pit"), ("l", "latest")) for c, d in (("net_margin", 6), ("revenue_growth", 6), ("margin_percentile", 4), ("growth_percentile", 4)))},
        {", ".join(f"{a}.{c}_quartile::int as {n}_{c}_quartile" for a, n in (("p", "pit"), ("l", "latest")) for c in ("margin", "growth"))},
        p.sic_major_group is distinct from l.sic_major_group as sic_group_changed, {" or ".join(f"p.{c} is distinct from l.{c}" for c in _VALUES)} as own_values_changed,
        {", ".join(f"p.{n}_quartile <> l.{n}_quartile as {n}_quartile_changed, (l.{n}_quartile - p.{n}_quartile)::int as {n}_quartile_shift, round(l.{n}_percentile - p.{n}_percentile, 4) as {n}_percentile_shift, p.{n}_quartile <> l.{n}_quartile and abs({_SHIFT[n]}) >= 0.05 as {n}_change_is_material" for n in ("margin", "growth"))}
        from (select * from rank where view = 'point_in_time') p join (select * from rank where view = 'latest') l using (cik)),
    peer as (select c.*, margin_quartile_changed or growth_quartile_changed as any_quartile_changed, margin_change_is_material or growth_change_is_material as any_material_quartile_change,
        case when not (margin_quartile_changed or growth_quartile_changed) then 'unchanged' when own_values_changed and sic_group_changed then 'restated_and_reclassified' when own_values_changed then 'own_values_restated' when sic_group_changed then 'sic_reclassified'
        else 'peer_distribution_moved' end as change_attribution, company_name from compared c left join (select cik, company_name from company where is_current) using (cik))"""


@query(f"with {t.FACT}, {COMPANY}, {PEERS} select * from peer")
def m30_peer_comparables(spark, sf):
    return comparables(spark, sf, LEAST)


@query(f"""with {t.FACT}, {COMPANY}, {PEERS} select 'margin' as measure, pit_margin_quartile as was, latest_margin_quartile as now, count(*) as n, count(*) filter (where margin_change_is_material) as n_material from peer group by 2, 3
    union all select 'growth', pit_growth_quartile, latest_growth_quartile, count(*), count(*) filter (where growth_change_is_material) from peer group by 2, 3""")
def d19_quartile_shifts(spark, sf):
    """Companies by quartile then and now."""
    both = F.array(*(F.struct(F.lit(n).alias("measure"), F.col(f"pit_{n}_quartile").alias("was"), F.col(f"latest_{n}_quartile").alias("now"), F.col(f"{n}_change_is_material").alias("material")) for n in ("margin", "growth")))
    return comparables(spark, sf, LEAST).select(F.inline(both)).groupBy("measure", "was", "now").agg(F.count("*").alias("n"), F.count_if("material").alias("n_material"))


@query(f"""with {t.FACT}, {COMPANY}, {PEERS} select change_attribution, count(*) as n_companies, count(*) filter (where any_material_quartile_change) as n_material, round(avg(abs(margin_percentile_shift)), 6) as mean_margin_shift from peer group by 1""")
def d19b_attribution(spark, sf):
    return comparables(spark, sf, LEAST).groupBy("change_attribution").agg(F.count("*").alias("n_companies"), F.count_if("any_material_quartile_change").alias("n_material"), F.round(F.avg(F.abs("margin_percentile_shift")), 6).alias("mean_margin_shift"))


_CLOSE = {n: f"abs(pit_{n} - latest_{n}) <= 0.001 * abs(latest_{n})" for n in _VALUES}


@query(f"""with {t.FACT}, {COMPANY}, {PEERS}, seen as (select cik, period_end_date, tag, value from fact where filed_date < date '{VIEWS["point_in_time"]}' and value is not null and segments = '' and coregistrant = '' and unit_of_measure = 'USD' and qtrs = 4)
    select count(*) as n_companies, count(*) filter (where own_values_changed) as n_changed, count(*) filter (where own_values_changed and {" and ".join(_CLOSE.values())}) as n_within_tolerance,
    count(*) filter (where abs(pit_revenue - latest_revenue) > 0.01 * abs(latest_revenue) and exists (select 1 from seen s where s.cik = peer.cik and s.period_end_date = peer.period_end_date and s.tag in ('T0', 'T1', 'T2') and abs(s.value - latest_revenue) <= 0.01 * abs(latest_revenue))) as n_transient_outliers from peer""")
def d20_peer_rechecks(spark, sf):
    """Changed values that agree within 0.1 %, and revenues that an earlier filing already had right when the view picked another."""
    rows = comparables(spark, sf, LEAST)
    seen = metrics(spark, sf).where("view = 'point_in_time'").select("cik", "seen_revenues")
    close = F.expr(" and ".join(_CLOSE.values()))
    off = F.expr("abs(pit_revenue - latest_revenue) > 0.01 * abs(latest_revenue)")
    right = F.exists("seen_revenues", lambda x: F.abs(x - F.col("latest_revenue")) <= F.lit("0.01").cast("decimal(3,2)") * F.abs("latest_revenue"))
    counts = (F.count("*").alias("n_companies"), F.count_if("own_values_changed").alias("n_changed"), F.count_if(F.col("own_values_changed") & close).alias("n_within_tolerance"), F.count_if(off & right).alias("n_transient_outliers"))
    return rows.join(seen, "cik").agg(*counts)
