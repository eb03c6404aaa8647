"""Who restates, what, by how much and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FACT_KEY
from tidemark.functions.columns import major_group
from tidemark.operators import bitemporal as ops
from tidemark.operators import ranks
from tidemark.plans import tables as t
from tidemark.plans.registry import query
from tidemark.plans.marts import _KEY, COMPANY, FILING, REPORTS, RESTATED, changes, company, filing, restatements
from tidemark.sources.store import stored

#: The divisions of the Standard Industrial Classification, by ranges of the four-digit code.
DIVISIONS = {
    "Agriculture, Forestry & Fishing": (100, 999),
    "Mining": (1000, 1499),
    "Construction": (1500, 1799),
    "Manufacturing": (2000, 3999),
    "Transport, Comms & Utilities": (4000, 4999),
    "Wholesale Trade": (5000, 5199),
    "Retail Trade": (5200, 5999),
    "Finance, Insurance & Real Estate": (6000, 6799),
    "Services": (7000, 8999),
    "Public Administration": (9100, 9729),
}
CHANGE = f"{RESTATED}, change as (select g.*, r.restatement_sk is not null as hit, r.pct_revision, r.revision_direction from groups g left join restated r using ({_KEY}))"


def sic_number(sic: Column) -> Column:
    return F.when(sic.rlike(r"^[0-9]{4}\z"), sic.cast("int"))


def division(sic: Column) -> Column:
    out = F.lit("Unclassified")
    for name, (low, high) in DIVISIONS.items():
        out = F.when(sic_number(sic).between(low, high), name).otherwise(out)
    return out


def pct(part: Column | str, whole: Column | str, digits: int = 4, scale: float = 100.0) -> Column:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.round(F.lit(scale) * as_column(part) / F.nullif(as_column(whole), F.lit(0)), digits)


def _pct(part: str, whole: str, digits: int = 4, scale: float = 100.0) -> str:
    return f"round({scale} * {part} / nullif({whole}, 0), {digits})::double"


_SECTOR = f"""sector as (select cik, valid_from, valid_to, sic_code, case when regexp_full_match(sic_code, '[0-9]{{4}}') then left(sic_code, 2) end as sic_major_group,
    case when not regexp_full_match(sic_code, '[0-9]{{4}}') then 'Unclassified' {" ".join(f"when sic_code::int between {a} and {b} then '{n}'" for n, (a, b) in DIVISIONS.items())} else 'Unclassified' end as sic_division from company)"""


def sectors(spark, sf) -> DataFrame:
    sic = F.col("sic_code")
    return company(spark, sf).select("cik", "valid_from", "valid_to", "sic_code", division(sic).alias("sic_division"), major_group(sic).alias("sic_major_group"))


@query(f"""with {t.FACT}, {COMPANY}, {CHANGE}, {_SECTOR},
    placed as (select c.*, sic_division, sic_major_group from change c left join sector s on s.cik = c.cik and c.first_filed_date between valid_from and valid_to),
    sets as (select sic_division, sic_major_group, grouping(sic_division, sic_major_group) as level, count(*) filter (where hit) as restatements, count(*) as revisable_groups, count(distinct cik) filter (where hit) as restating_companies,
        count(*) filter (where hit and revision_direction = 'decrease') as down, quantile_cont(abs(pct_revision), 0.5) as median from placed group by grouping sets ((sic_division, sic_major_group), (sic_division), ())),
    filings as (select sic_division, sic_major_group, grouping(sic_division, sic_major_group) as level, count(*) as filings, count(distinct f.cik) as companies from sub f left join sector s on s.cik = f.cik and f.filed_date between valid_from and valid_to
        group by grouping sets ((sic_division, sic_major_group), (sic_division), ()))
    select coalesce(a.sic_division, 'All sectors') as sic_division, a.sic_major_group, case a.level when 0 then 'major_group' when 1 then 'division' else 'grand_total' end as aggregation_level, restatements, revisable_groups, filings, companies, restating_companies,
    {_pct('restatements', 'revisable_groups')} as pct_of_revisable_restated, {_pct('restatements', 'filings', scale=1.0)} as restatements_per_filing, {_pct('restating_companies', 'companies')} as pct_companies_restating,
    {_pct('down', 'restatements')} as pct_restatements_downward, round(median, 4) as median_abs_pct_revision
    from sets a left join filings b on b.level = a.level and b.sic_division is not distinct from a.sic_division and b.sic_major_group is not distinct from a.sic_major_group where restatements > 0""")
def m17_by_sector(spark, sf):
    """Restatement rates by sector, as it was when each fact was first published; sectors, divisions and the total."""
    keys = ["sic_division", "sic_major_group"]
    sets = [keys, keys[:1], []]
    at = ops.valid_at(changes(spark, sf), sectors(spark, sf), "cik", "first_filed_date", "left")
    hit = F.col("is_revised")
    measures = {"restatements": F.count_if(hit), "revisable_groups": F.count("*"), "down": F.count_if(hit & (F.col("revision_direction") == "decrease"))}
    facts = ranks.grouped(at, sets, measures, {"median": (F.when(hit, F.abs("pct_revision")), 0.5)}, restatements(spark, sf), {"restating_companies": F.when(hit, F.col("cik"))})
    filings = ops.valid_at(t.submissions(spark, sf).select("cik", "filed_date"), sectors(spark, sf), "cik", "filed_date", "left")
    filings = ranks.grouped(filings, sets, {"filings": F.count("*")}, {}, filings, {"companies": F.col("cik")})
    f, g = facts.where("restatements > 0").alias("f"), filings.alias("g")
    same = (F.col("f.level") == F.col("g.level")) & F.col("f.sic_division").eqNullSafe(F.col("g.sic_division")) & F.col("f.sic_major_group").eqNullSafe(F.col("g.sic_major_group"))
    return f.join(g, same, "left").select(
        F.coalesce("f.sic_division", F.lit("All sectors")).alias("sic_division"),
        "f.sic_major_group",
        t.case(F.col("f.level"), {0: "major_group", 1: "division"}, F.lit("grand_total")).alias("aggregation_level"),
        *("restatements revisable_groups filings companies restating_companies".split()),
        pct("restatements", "revisable_groups").alias("pct_of_revisable_restated"),
        pct("restatements", "filings", scale=1.0).alias("restatements_per_filing"),
        pct("restating_companies", "companies").alias("pct_companies_restating"),
        pct("down", "restatements").alias("pct_restatements_downward"),
        F.round("median", 4).alias("median_abs_pct_revision"),
    )


@query(f"""with {t.FACT}, {t.PRE}, {t.TAG}, {CHANGE}, n as (select tag, statement_code, count(*) as n from pre where statement_code is not null group by 1, 2),
    d as (select tag, first(statement_code order by n desc, statement_code) as statement_code, count(*) as placements from n group by 1), custom as (select tag, bool_or(is_custom) as is_custom from tags group by 1),
    r as (select coalesce(statement_code, 'NP') as statement_code, c.*, placements, is_custom from change c left join d using (tag) left join custom using (tag)),
    s as (select statement_code, tag, grouping(statement_code, tag) as level, count(*) as revisable_groups, count(*) filter (where hit) as restatements, count(distinct cik) filter (where hit) as restating_companies, count(distinct tag) as distinct_tags,
        count(*) filter (where hit and revision_direction = 'decrease') as down, quantile_cont(abs(pct_revision), 0.5) as median, coalesce(bool_or(is_custom), false) as includes_custom_tag, coalesce(bool_or(placements > 1), false) as placement_is_ambiguous
        from r group by grouping sets ((statement_code, tag), (statement_code), ())),
    k as (select *, case when level = 0 then row_number() over (partition by level, statement_code order by restatements desc, tag) end as rank from s)
    select coalesce(statement_code, 'ALL') as statement_code, case when statement_code is null then 'All statements' when statement_code = 'NP' then 'Not presented' else {t.statement_name_sql('statement_code')} end as statement_name, tag,
    case level when 0 then 'tag' when 1 then 'statement' else 'grand_total' end as aggregation_level, rank::int as rank_within_statement, restatements, revisable_groups, restating_companies, distinct_tags,
    {_pct('restatements', 'revisable_groups')} as pct_of_revisable_restated, {_pct('down', 'restatements')} as pct_restatements_downward, round(median, 4) as median_abs_pct_revision, includes_custom_tag, placement_is_ambiguous
    from k where rank is null or rank <= 15""")
def m18_by_statement(spark, sf):
    """Restatement rates by the statement that a tag mostly stands in: all totals, and each statement's top tags."""
    counted = t.presentation(spark, sf).where("statement_code is not null").groupBy("tag", "statement_code").agg(F.count("*").alias("n"))
    modal = counted.groupBy("tag").agg(F.min_by("statement_code", F.struct((-F.col("n")).alias("n"), "statement_code")).alias("statement_code"), F.count("*").alias("placements"))
    custom = t.tags(spark, sf).groupBy("tag").agg(F.bool_or("is_custom").alias("is_custom"))
    rows = changes(spark, sf).join(modal, "tag", "left").join(custom, "tag", "left").withColumn("statement_code", F.coalesce("statement_code", F.lit("NP")))
    keys, hit = ["statement_code", "tag"], F.col("is_revised")
    measures = {
        "revisable_groups": F.count("*"),
        "restatements": F.count_if(hit),
        "down": F.count_if(hit & (F.col("revision_direction") == "decrease")),
        "includes_custom_tag": F.coalesce(F.bool_or("is_custom"), F.lit(False)),
        "placement_is_ambiguous": F.coalesce(F.bool_or(F.col("placements") > 1), F.lit(False)),
    }
    distinct = {"restating_companies": F.when(hit, F.col("cik")), "distinct_tags": F.col("tag")}
    totals = ranks.grouped(rows, [keys, keys[:1], []], measures, {"median": (F.when(hit, F.abs("pct_revision")), 0.5)}, restatements(spark, sf), distinct)
    detail, rest = totals.where("level = 0"), totals.where("level > 0").withColumn("rank", F.lit(None).cast("int"))
    detail = detail.withColumn("rank", F.row_number().over(Window.partitionBy("statement_code").orderBy(F.desc("restatements"), "tag"))).where(F.col("rank") <= DEFAULT.top_tags)
    name = t.case(F.col("statement_code"), {**t.STATEMENTS, "NP": "Not presented"}, F.lit("All statements"))
    return rest.unionByName(detail).select(
        F.coalesce("statement_code", F.lit("ALL")).alias("statement_code"),
        name.alias("statement_name"),
        "tag",
        t.case(F.col("level"), {0: "tag", 1: "statement"}, F.lit("grand_total")).alias("aggregation_level"),
        F.col("rank").alias("rank_within_statement"),
        *("restatements revisable_groups restating_companies distinct_tags".split()),
        pct("restatements", "revisable_groups").alias("pct_of_revisable_restated"),
        pct("down", "restatements").alias("pct_restatements_downward"),
        F.round("median", 4).alias("median_abs_pct_revision"),
        "includes_custom_tag",
        "placement_is_ambiguous",
    )


_SIZE = """size as (select cik, assets, ntile(10) over (order by assets, cik)::int as assets_decile from (select cik, value as assets, row_number() over (partition by cik order by period_end_date desc, filed_date, adsh desc, value desc) as rn from fact
        where tag = 'T0' and segments = '' and coregistrant = '' and unit_of_measure = 'USD' and value > 0) where rn = 1)"""
_PARTS = {"consolidated": "not is_segment", "segment": "is_segment", "financial": "financial", "non_financial": "not financial"}


def sizes(spark, sf) -> DataFrame:
    """Assets of each company's latest period, as first published, and their decile. One row for each company."""
    whole = t.facts(spark, sf).where((F.col("tag") == t.ASSETS) & (F.col("segments") == "") & (F.col("coregistrant") == "") & (F.col("unit_of_measure") == "USD") & (F.col("value") > 0))
    latest = ops.pick_one(whole, ["cik"], F.desc("period_end_date"), F.asc("filed_date"), F.desc("adsh"), F.desc("value")).select("cik", F.col("value").alias("assets"))
    return ranks.tiles(latest, [], DEFAULT.buckets, "assets_decile", F.col("assets"), F.col("cik"))


def placed(spark, sf, rows: DataFrame) -> DataFrame:
    """Revisable facts beside the version of their company that held at first, with whether they are of a segment or of a financial company."""
    sic = company(spark, sf).select("cik", "valid_from", "valid_to", F.coalesce(sic_number(F.col("sic_code")).between(*DEFAULT.financial), F.lit(False)).alias("financial"))
    return ops.valid_at(rows, sic, "cik", "first_filed_date", "left").withColumns({"is_segment": F.col("segments") != "", "has_version": F.col("financial").isNotNull()})


def part_counts(parts: dict[str, str]) -> dict[str, Column]:
    """Revisable and revised facts of some parts of `placed`; only facts whose company has a version count."""
    own = {n: F.col("has_version") & F.expr(c) for n, c in parts.items()}
    return {f"revisable_groups_{n}": F.count_if(p) for n, p in own.items()} | {f"restatements_{n}": F.count_if(p & F.col("is_revised")) for n, p in own.items()}


def rates_by_decile(spark, sf) -> DataFrame:
    """Restatement rates by decile of assets alone: of all facts, of consolidated ones and of segments."""
    rows = placed(spark, sf, changes(spark, sf).join(sizes(spark, sf).select("cik", "assets_decile"), "cik"))
    parts = {n: _PARTS[n] for n in ("consolidated", "segment")}
    counts = {"revisable_groups": F.count("*"), "restatements": F.count_if("is_revised")} | part_counts(parts)
    per = rows.groupBy(F.lpad(F.col("assets_decile").cast("string"), 2, "0").alias("size_band")).agg(*(c.alias(n) for n, c in counts.items()))
    return per.select("size_band", pct("restatements", "revisable_groups").alias("pct_of_revisable_restated"), *(pct(f"restatements_{n}", f"revisable_groups_{n}").alias(f"pct_restated_{n}") for n in parts))


@query(f"""with {t.FACT}, {COMPANY}, {FILING}, {CHANGE}, {_SIZE},
    placed as (select c.*, c.segments <> '' as is_segment, f.filer_status, f.filer_status_name, assets_decile,
        v.cik is not null and coalesce(regexp_full_match(sic_code, '[0-9]{{4}}') and try_cast(sic_code as int) between 6000 and 6799, false) as financial, v.cik is not null as has_version
        from change c left join filing f on f.adsh = c.first_adsh left join company v on v.cik = c.cik and c.first_filed_date between valid_from and valid_to left join size z on z.cik = c.cik),
    banded as (select 'filer_status' as size_basis, coalesce(filer_status, 'unknown') as size_band, case when filer_status is null then 'filer status not reported' else filer_status_name end as size_band_label, coalesce(left(filer_status, 1)::int, 99) as band_sort, null::int as decile, * from placed
        union all select 'assets_decile', coalesce(lpad(assets_decile::varchar, 2, '0'), 'unclassified'), case when assets_decile = 1 then 'decile 1 (smallest)' when assets_decile = 10 then 'decile 10 (largest)' when assets_decile is null then 'no consolidated USD assets reported' else 'decile ' || assets_decile end,
        coalesce(assets_decile, 99), assets_decile, * from placed),
    per as (select size_basis, size_band, min(size_band_label) as size_band_label, min(band_sort) as band_sort, min(decile) as decile, count(distinct cik) as companies, count(distinct cik) filter (where hit) as restating_companies, count(*) as revisable_groups, count(*) filter (where hit) as restatements,
        quantile_cont(abs(pct_revision), 0.5) as median, {", ".join(f"count(*) filter (where has_version and {c}) as revisable_groups_{n}, count(*) filter (where has_version and hit and {c}) as restatements_{n}" for n, c in _PARTS.items())} from banded group by 1, 2),
    bounds as (select assets_decile, min(assets)::double as min_total_assets, quantile_cont(assets::double, 0.5) as median_total_assets from size group by 1)
    select size_basis, size_band, size_band_label, band_sort, round(min_total_assets, 2) as min_total_assets, round(median_total_assets, 2) as median_total_assets, companies, restating_companies, {_pct('restating_companies', 'companies')} as pct_companies_restating, revisable_groups, restatements,
    {_pct('restatements', 'revisable_groups')} as pct_of_revisable_restated, round(median, 4) as median_abs_pct_revision,
    {", ".join(f"revisable_groups_{n}, restatements_{n}, {_pct(f'restatements_{n}', f'revisable_groups_{n}')} as pct_restated_{n}" for n in _PARTS)},
    {_pct('revisable_groups_segment', 'revisable_groups')} as pct_segment_level, {_pct('revisable_groups_financial', 'revisable_groups')} as pct_financial from per left join bounds on assets_decile = decile""")
def m19_by_filer_size(spark, sf):
    """Restatement rates by filer status and by decile of assets, with the mix of segments and of financial companies beside them."""
    filings = filing(spark, sf).select(F.col("adsh").alias("first_adsh"), "filer_status", "filer_status_name")
    size = sizes(spark, sf)
    at = placed(spark, sf, changes(spark, sf).join(filings, "first_adsh", "left")).join(size.drop("assets"), "cik", "left")
    status, decile = F.col("filer_status"), F.col("assets_decile")
    by_status = F.struct(F.lit("filer_status").alias("size_basis"), F.coalesce(status, F.lit("unknown")).alias("size_band"), F.when(status.isNull(), "filer status not reported").otherwise(F.col("filer_status_name")).alias("size_band_label"), F.coalesce(F.left(status, F.lit(1)).cast("int"), F.lit(99)).alias("band_sort"), F.lit(None).cast("int").alias("decile"))
    label = F.when(decile == 1, "decile 1 (smallest)").when(decile == DEFAULT.buckets, f"decile {DEFAULT.buckets} (largest)").when(decile.isNull(), "no consolidated USD assets reported").otherwise(F.concat(F.lit("decile "), decile))
    by_assets = F.struct(F.lit("assets_decile").alias("size_basis"), F.coalesce(F.lpad(decile.cast("string"), 2, "0"), F.lit("unclassified")).alias("size_band"), label.alias("size_band_label"), F.coalesce(decile, F.lit(99)).alias("band_sort"), decile.alias("decile"))
    banded = at.select("cik", "is_revised", "pct_revision", "is_segment", "financial", "has_version", F.inline(F.array(by_status, by_assets)))
    hit = F.col("is_revised")
    measures = {
        "size_band_label": F.min("size_band_label"), "band_sort": F.min("band_sort"), "decile": F.min("decile"),
        "revisable_groups": F.count("*"), "restatements": F.count_if(hit), **part_counts(_PARTS),
    }
    distinct = {"companies": F.col("cik"), "restating_companies": F.when(hit, F.col("cik"))}
    per = ranks.grouped(banded, [["size_basis", "size_band"]], measures, {"median": (F.when(hit, F.abs("pct_revision")), 0.5)}, restatements(spark, sf), distinct)
    bounds = ranks.grouped(size, [["assets_decile"]], {"least": F.min("assets")}, {"middle": (F.col("assets").cast("double"), 0.5)}, size)
    bounds = bounds.select(F.col("assets_decile").alias("decile"), F.round(F.col("least").cast("double"), 2).alias("min_total_assets"), F.round("middle", 2).alias("median_total_assets"))
    return per.join(bounds, "decile", "left").select(
        "size_basis", "size_band", "size_band_label", "band_sort", "min_total_assets", "median_total_assets", "companies", "restating_companies", pct("restating_companies", "companies").alias("pct_companies_restating"), "revisable_groups", "restatements",
        pct("restatements", "revisable_groups").alias("pct_of_revisable_restated"), F.round("median", 4).alias("median_abs_pct_revision"),
        *(c for n in _PARTS for c in (f"revisable_groups_{n}", f"restatements_{n}", pct(f"restatements_{n}", f"revisable_groups_{n}").alias(f"pct_restated_{n}"))),
        pct("revisable_groups_segment", "revisable_groups").alias("pct_segment_level"), pct("revisable_groups_financial", "revisable_groups").alias("pct_financial"),
    )


_DECADES = ("0.01", "0.1", "1", "10", "100", "1000")


@query(f"""with {t.FACT}, {RESTATED}, r as (select *, abs(absolute_revision) as a, abs(first_reported_value) as b from restated),
    bucketed as (select 'linear_5pt' as bucket_scale, revision_direction, least(floor(a * 20 / b) + 1, 21)::int as bucket_index from r where b > 0
        union all select 'log10_decade', revision_direction, (1 {"".join(f" + (a >= {d} * b)::int" for d in _DECADES)})::int from r where b > 0 union all select 'no_denominator', revision_direction, 1 from r where b = 0),
    counts as (select bucket_scale, coalesce(revision_direction, 'all') as revision_direction, bucket_index, count(*) as restatements from bucketed group by grouping sets ((bucket_scale, revision_direction, bucket_index), (bucket_scale, bucket_index))),
    p as (select coalesce(revision_direction, 'all') as revision_direction, {", ".join(f"round(quantile_cont(abs(pct_revision), {q / 100}), 4) as p{q}_abs_pct_revision" for q in (50, 75, 90, 99))}, round(quantile_cont(pct_revision, 0.5), 4) as median_signed_pct_revision
        from restated where pct_revision is not null group by grouping sets ((revision_direction), ()))
    select c.*, case bucket_scale when 'no_denominator' then 'first reported value was zero' when 'linear_5pt' then case when bucket_index > 20 then '>100%' else (bucket_index - 1) * 5 || '-' || bucket_index * 5 || '%' end
        else case when bucket_index > 6 then '>=100,000%' else '10^' || (bucket_index - 4) || ' to 10^' || (bucket_index - 3) end end as bucket_label, (sum(restatements) over w)::bigint as restatements_in_direction,
    round(100.0 * restatements / sum(restatements) over w, 4)::double as pct_of_direction, p.* exclude (revision_direction) from counts c left join p using (revision_direction) window w as (partition by bucket_scale, revision_direction)""")
def m20_magnitude_distribution(spark, sf):
    """How large revisions are: steps of 5 % and decades, by direction and together, with the percentiles of each direction.

    Buckets are told by comparing decimals, without a division or a logarithm.
    """
    rows = restatements(spark, sf).select("revision_direction", "pct_revision", F.abs("absolute_revision").alias("a"), F.abs("first_reported_value").alias("b"))
    some = F.col("b") > 0
    linear = F.least(F.floor(F.col("a") * 20 / F.nullif("b", F.lit(0))) + 1, F.lit(21)).cast("int")
    decade = sum(((F.col("a") >= F.lit(d).cast("decimal(10,2)") * F.col("b")).cast("int") for d in _DECADES), F.lit(1))
    scales = F.when(some, F.array(F.struct(F.lit("linear_5pt").alias("bucket_scale"), linear.alias("bucket_index")), F.struct(F.lit("log10_decade").alias("bucket_scale"), decade.alias("bucket_index")))).otherwise(F.array(F.struct(F.lit("no_denominator").alias("bucket_scale"), F.lit(1).alias("bucket_index"))))
    scale, direction, index = F.col("bucket_scale"), F.col("revision_direction"), F.col("bucket_index")
    counts = rows.select("revision_direction", F.inline(scales)).groupingSets([[scale, direction, index], [scale, index]], scale, direction, index).agg(F.count("*").alias("restatements")).withColumn("revision_direction", F.coalesce(direction, F.lit("all")))
    spread = {f"p{q}_abs_pct_revision": (F.abs("pct_revision"), q / 100) for q in (50, 75, 90, 99)} | {"median_signed_pct_revision": (F.col("pct_revision"), 0.5)}
    some = rows.where("pct_revision is not null")
    percentiles = ranks.grouped(some, [["revision_direction"], []], {}, spread, some).drop("level").withColumns({"revision_direction": F.coalesce(direction, F.lit("all"))} | {n: F.round(n, 4) for n in spread})
    whole = F.sum("restatements").over(Window.partitionBy("bucket_scale", "revision_direction"))  # a few dozen rows
    five = F.when(index > 20, ">100%").otherwise(F.concat((index - 1) * 5, F.lit("-"), index * 5, F.lit("%")))
    ten = F.when(index > 6, ">=100,000%").otherwise(F.concat(F.lit("10^"), index - 4, F.lit(" to 10^"), index - 3))
    label = F.when(scale == "no_denominator", "first reported value was zero").when(scale == "linear_5pt", five).otherwise(ten)
    return counts.join(percentiles, "revision_direction", "left").select("bucket_scale", "revision_direction", "bucket_index", "restatements", label.alias("bucket_label"), whole.alias("restatements_in_direction"), F.round(F.lit(100.0) * F.col("restatements") / whole, 4).alias("pct_of_direction"), *spread)


@query(f"""with {t.FACT}, {CHANGE}, q as (select 'revision_filed' as quarter_basis, date_trunc('quarter', first_revision_filed_date)::date as quarter_start_date, cik, revision_direction from change where hit
        union all select 'period_restated', date_trunc('quarter', period_end_date)::date, cik, revision_direction from change where hit),
    o as (select quarter_basis, quarter_start_date, count(*) as restatements, count(distinct cik) as restating_companies, count(*) filter (where revision_direction = 'decrease') as down from q group by 1, 2),
    d as (select 'revision_filed' as quarter_basis, date_trunc('quarter', filed_date)::date as quarter_start_date, count(*) as denominator from sub group by 2 union all select 'period_restated', date_trunc('quarter', period_end_date)::date, count(*) from change group by 2),
    spine as (select quarter_basis, unnest(generate_series(min(quarter_start_date), max(quarter_start_date), interval 3 months))::date as quarter_start_date from o group by 1),
    s as (select quarter_basis, quarter_start_date, coalesce(restatements, 0) as restatements, coalesce(restating_companies, 0) as restating_companies, coalesce(down, 0) as down, case when restatements is not null then denominator end as denominator,
        1000.0::double * coalesce(restatements, 0) / case when restatements is not null then denominator end as rate from spine left join o using (quarter_basis, quarter_start_date) left join d using (quarter_basis, quarter_start_date)),
    w as (select *, avg(restatements) over t as mean, avg(rate) over t as mean_rate, count(*) over t as n from s window t as (partition by quarter_basis order by quarter_start_date rows between 4 preceding and 1 preceding))
    select quarter_basis, case quarter_basis when 'revision_filed' then 'filings_published_in_quarter' else 'revisable_facts_for_period' end as denominator_kind, quarter_start_date, year(quarter_start_date)::int as calendar_year, quarter(quarter_start_date)::int as calendar_quarter,
    restatements, restating_companies, denominator, round(rate, 4) as restatements_per_1k, {_pct('down', 'restatements')} as pct_restatements_downward, round(mean, 4) as trailing_avg_restatements, round(mean_rate, 4) as trailing_avg_rate,
    round(restatements / nullif(mean, 0), 4) as count_vs_trailing, round(rate / nullif(mean_rate, 0), 4) as rate_vs_trailing, n = 4 as has_full_trailing_window from w""")
def m21_clustering(spark, sf):
    """Revisions by the quarter of their filing and by the quarter that they restate, each against its own denominator and the four quarters before."""
    rows, basis = changes(spark, sf), "quarter_basis"
    clocks = {"revision_filed": "first_revision_filed_date", "period_restated": "period_end_date"}
    both = F.array(*(F.struct(F.lit(n).alias(basis), F.trunc(c, "quarter").alias("quarter_start_date")) for n, c in clocks.items()))
    seen = rows.where("is_revised").select("cik", "revision_direction", F.inline(both)).groupBy(basis, "quarter_start_date")
    seen = seen.agg(F.count("*").alias("restatements"), F.count_distinct("cik").alias("restating_companies"), F.count_if(F.col("revision_direction") == "decrease").alias("down"))
    filed = t.submissions(spark, sf).groupBy(F.lit("revision_filed").alias(basis), F.trunc("filed_date", "quarter").alias("quarter_start_date")).agg(F.count("*").alias("denominator"))
    could = rows.groupBy(F.lit("period_restated").alias(basis), F.trunc("period_end_date", "quarter").alias("quarter_start_date")).agg(F.count("*").alias("denominator"))
    seen = seen.join(filed.unionByName(could), [basis, "quarter_start_date"], "left")
    dense = ops.dense_quarters(seen, [basis], "quarter_start_date").join(seen, [basis, "quarter_start_date"], "left")
    dense = dense.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("restatements", "restating_companies", "down")})
    dense = dense.withColumn("rate", F.lit(1000.0) * F.col("restatements") / F.col("denominator"))
    before = Window.partitionBy(basis).orderBy("quarter_start_date").rowsBetween(-DEFAULT.season, -1)
    mean, mean_rate = F.avg("restatements").over(before), F.avg("rate").over(before)
    kind = F.when(F.col(basis) == "revision_filed", "filings_published_in_quarter").otherwise("revisable_facts_for_period")
    return dense.select(
        basis, kind.alias("denominator_kind"), "quarter_start_date", F.year("quarter_start_date").alias("calendar_year"), F.quarter("quarter_start_date").alias("calendar_quarter"), "restatements", "restating_companies", "denominator",
        F.round("rate", 4).alias("restatements_per_1k"), pct("down", "restatements").alias("pct_restatements_downward"), F.round(mean, 4).alias("trailing_avg_restatements"), F.round(mean_rate, 4).alias("trailing_avg_rate"),
        F.round(F.col("restatements") / F.nullif(mean, F.lit(0.0)), 4).alias("count_vs_trailing"), F.round(F.col("rate") / F.nullif(mean_rate, F.lit(0.0)), 4).alias("rate_vs_trailing"), (F.count("*").over(before) == DEFAULT.season).alias("has_full_trailing_window"),
    )


_STEPS = f"""{REPORTS}, lagged as (select *, lag(value) over w as before, lag(adsh) over w as from_adsh, lag(filed_date) over w as from_date from reports window w as (partition by {_KEY} order by filed_date)),
    steps as (select *, row_number() over (partition by {_KEY} order by filed_date) as seq from lagged where value <> before and (before = 0 or abs(value - before) >= 0.001 * abs(before)))"""


@stored
def chains(spark, sf) -> DataFrame:
    return ops.chains(t.dealt(t.facts(spark, sf), sf, "lineitem", *FACT_KEY), FACT_KEY, "filed_date", "value", "adsh", DEFAULT.material)


@query(f"""with recursive {t.FACT}, {_STEPS},
    walk as (select {_KEY}, seq, before as first_value, value as latest_value, [from_adsh, adsh] as path from steps where seq = 1
        union all select w.cik, w.coregistrant, w.segments, w.tag, w.period_end_date, w.qtrs, w.unit_of_measure, s.seq, w.first_value, s.value, list_append(w.path, s.adsh)
        from walk w join steps s on s.seq = w.seq + 1 and {" and ".join(f"s.{k} = w.{k}" for k in FACT_KEY)})
    select {_KEY}, seq::int as chain_length, first_value, latest_value, array_to_string(path, '>') as path from (select *, max(seq) over (partition by {_KEY}) as most from walk) where seq = most""")
def m22_amendment_chains(spark, sf):
    return chains(spark, sf).select(*FACT_KEY, "chain_length", "first_value", "latest_value", F.array_join("path", ">").alias("path"))


_CHAINS = f"{_STEPS}, chain as (select {_KEY}, count(*)::int as chain_length, (max(filed_date) - min(from_date))::int as span from steps group by {_KEY})"


@query(f"""with {t.FACT}, {COMPANY}, {_CHAINS},
    per as (select cik, count(*) as chains, avg(span) as mean, quantile_cont(span, 0.5) as median, count(*) filter (where chain_length >= 3) as long_chains from chain group by 1)
    select 'chain_length_distribution' as result_scope, chain_length::varchar as result_key, null::varchar as company_name, count(*) as chains, count(distinct cik) as companies, round(avg(span), 4) as mean_chain_span_days, round(quantile_cont(span, 0.5), 4) as median_chain_span_days,
        null::bigint as long_chains, null::double as pct_chains_long from chain group by chain_length
    union all (select 'filer_concentration', per.cik::varchar, company_name, chains, 1, round(mean, 4), round(median, 4), long_chains, {_pct('long_chains', 'chains')} from per left join company c on c.cik = per.cik and is_current order by long_chains desc, chains desc, per.cik limit 25)""")
def m22b_chain_summary(spark, sf):
    """How long chains of revisions are, and the companies with most long ones."""
    rows = chains(spark, sf).withColumn("span", F.datediff("last_step_at", "first_step_from"))
    measures = [F.count("*").alias("chains"), F.count_distinct("cik").alias("companies"), F.round(F.avg("span"), 4).alias("mean_chain_span_days"), F.round(F.percentile("span", 0.5), 4).alias("median_chain_span_days")]
    lengths = rows.groupBy(F.col("chain_length").cast("string").alias("result_key")).agg(*measures).withColumns({"result_scope": F.lit("chain_length_distribution"), "company_name": F.lit(None).cast("string"), "long_chains": F.lit(None).cast("long"), "pct_chains_long": F.lit(None).cast("double")})
    filers = rows.groupBy("cik").agg(*measures, F.count_if(F.col("chain_length") >= DEFAULT.long_chain).alias("long_chains")).orderBy(F.desc("long_chains"), F.desc("chains"), "cik").limit(DEFAULT.top_filers)
    names = company(spark, sf).where("is_current").select("cik", "company_name")
    filers = filers.join(names, "cik", "left").withColumns({"result_scope": F.lit("filer_concentration"), "result_key": F.col("cik").cast("string"), "pct_chains_long": pct("long_chains", "chains")}).drop("cik")
    return lengths.unionByName(filers)


_RUNS = f"""q as (select distinct cik, date_trunc('quarter', filed_date)::date as quarter from sub),
    h as (select distinct cik, date_trunc('quarter', first_revision_filed_date)::date as quarter from restated),
    tl as (select q.cik, q.quarter, h.cik is not null as hit, row_number() over (partition by q.cik order by q.quarter) as seq from q left join h on h.cik = q.cik and h.quarter = q.quarter),
    isl as (select *, seq - row_number() over (partition by cik order by seq) as island from tl where hit),
    runs as (select cik, island, count(*) as run_length, min(quarter) as run_start, max(quarter) as run_end from isl group by 1, 2),
    best as (select cik, count(*) as n_runs, max(run_length) as longest, first(run_start order by run_length desc, run_start) as longest_start, first(run_end order by run_length desc, run_start) as longest_end from runs group by 1)"""


def restaters(spark, sf) -> DataFrame:
    """Companies with their reporting quarters, those that brought revisions, runs of these and totals; `restatement_pattern` tells them apart."""
    found = restatements(spark, sf)
    quarters = t.submissions(spark, sf).select("cik", F.trunc("filed_date", "quarter").alias("quarter")).distinct()
    hits = found.select("cik", F.trunc("first_revision_filed_date", "quarter").alias("quarter"), F.lit(True).alias("hit")).distinct()
    line = quarters.join(hits, ["cik", "quarter"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    best = F.min_by(F.struct("run_length", "run_start", "run_end"), F.struct((-F.col("run_length")).alias("n"), "run_start")).alias("best")
    runs = ops.islands(line, "cik", ["quarter"], "hit", "quarter").groupBy("cik").agg(F.count("*").alias("n_runs"), best)
    spans = line.groupBy("cik").agg(F.count("*").alias("n_reporting_periods"), F.count_if("hit").alias("n_restated_periods"), F.min("quarter").alias("first_reporting_quarter"), F.max("quarter").alias("last_reporting_quarter"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = spans.join(runs, "cik", "left").withColumns({"n_restatement_runs": zero("n_runs"), "longest_run_periods": zero("best.run_length")})
    n, longest = F.col("n_restated_periods"), F.col("longest_run_periods")
    pattern = F.when(n == 0, "none").when(n == 1, "isolated").when(longest >= DEFAULT.run_length, "sustained_run").when(F.col("n_restatement_runs") >= 3, "scattered").otherwise("intermittent")
    return whole.withColumn("restatement_pattern", pattern)


@query(f"""with {t.FACT}, {COMPANY}, {RESTATED}, {_RUNS}, s as (select cik, count(*) as n_reporting_periods, count(*) filter (where hit) as n_restated_periods, min(quarter) as first_reporting_quarter, max(quarter) as last_reporting_quarter from tl group by 1),
    x as (select cik, count(*) as total, count(*) filter (where revision_direction = 'decrease') as down, count(distinct tag) as tags, quantile_cont(abs(pct_revision), 0.5) as median from restated group by 1),
    a as (select s.*, company_name, sic_code, coalesce(total, 0) as total_restatements, coalesce(tags, 0) as distinct_tags_restated, down, median, coalesce(n_runs, 0) as n_restatement_runs, coalesce(longest, 0) as longest_run_periods, longest_start, longest_end,
        n_restated_periods / n_reporting_periods as rate from s left join best using (cik) left join x using (cik) left join (select * from company where is_current) c using (cik)),
    r as (select cik, ntile(10) over (order by rate, total_restatements, cik)::int as decile from a where n_reporting_periods >= 4)
    select cik, company_name, sic_code, n_reporting_periods, n_restated_periods, first_reporting_quarter, last_reporting_quarter, total_restatements, distinct_tags_restated, {_pct('n_restated_periods', 'n_reporting_periods')} as pct_periods_restated,
    {_pct('down', 'total_restatements')} as pct_restatements_downward, round(median, 4) as median_abs_pct_revision, n_restatement_runs, longest_run_periods, longest_start as longest_run_start_quarter, longest_end as longest_run_end_quarter, decile as restatement_rate_decile,
    n_reporting_periods >= 4 as is_rankable, case when n_restated_periods = 0 then 'none' when n_restated_periods = 1 then 'isolated' when longest_run_periods >= 3 then 'sustained_run' when n_restatement_runs >= 3 then 'scattered' else 'intermittent' end as restatement_pattern
    from a left join r using (cik)""")
def m23_serial_restaters(spark, sf):
    """Companies by how often and how steadily their reporting quarters bring revisions."""
    totals = restatements(spark, sf).groupBy("cik").agg(F.count("*").alias("total"), F.count_if(F.col("revision_direction") == "decrease").alias("down"), F.count_distinct("tag").alias("tags"), F.percentile(F.abs("pct_revision"), 0.5).alias("median"))
    names = company(spark, sf).where("is_current").select("cik", "company_name", "sic_code")
    whole = restaters(spark, sf).join(totals, "cik", "left").join(names, "cik", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = whole.withColumns({"total_restatements": zero("total"), "rate": F.col("n_restated_periods") / F.col("n_reporting_periods"), "is_rankable": F.col("n_reporting_periods") >= DEFAULT.rank_floor})
    # ranked companies alone, so that others take no place
    whole = ranks.tiles(whole, ["is_rankable"], DEFAULT.buckets, "decile", F.col("rate"), F.col("total_restatements"), F.col("cik"))
    decile = F.when(F.col("is_rankable"), F.col("decile"))
    return whole.select(
        "cik", "company_name", "sic_code", "n_reporting_periods", "n_restated_periods", "first_reporting_quarter", "last_reporting_quarter", "total_restatements", zero("tags").alias("distinct_tags_restated"),
        pct("n_restated_periods", "n_reporting_periods").alias("pct_periods_restated"), pct("down", "total_restatements").alias("pct_restatements_downward"), F.round("median", 4).alias("median_abs_pct_revision"), "n_restatement_runs", "longest_run_periods",
        F.col("best.run_start").alias("longest_run_start_quarter"), F.col("best.run_end").alias("longest_run_end_quarter"), decile.alias("restatement_rate_decile"), "is_rankable", "restatement_pattern",
    )


_ARTEFACTS = "first_reported_value = 0 or abs(absolute_revision) > 100 * abs(first_reported_value) or latest_reported_value = -first_reported_value"


@query(f"""with {t.FACT}, {RESTATED} select count(*) as n, count(*) filter (where first_reported_value = 0) as zero_origin, count(*) filter (where abs(absolute_revision) > 100 * abs(first_reported_value) and first_reported_value <> 0) as extreme,
    count(*) filter (where latest_reported_value = -first_reported_value) as sign_flip, count(*) filter (where absolute_revision < 0) as downward, count(*) filter (where {_ARTEFACTS}) as any_artefact,
    {_pct(f'count(*) filter (where absolute_revision < 0 and not ({_ARTEFACTS}))', f'count(*) filter (where not ({_ARTEFACTS}))')} as pct_downward_without from restated""")
def d11_artefact_classes(spark, sf):
    """Revisions that look like artefacts, by class and together, and the downward share without them."""
    old, new, change = F.col("first_reported_value"), F.col("latest_reported_value"), F.col("absolute_revision")
    any_ = F.expr(_ARTEFACTS)
    return restatements(spark, sf).agg(F.count("*").alias("n"), F.count_if(old == 0).alias("zero_origin"), F.count_if((F.abs(change) > 100 * F.abs(old)) & (old != 0)).alias("extreme"), F.count_if(new == -old).alias("sign_flip"), F.count_if(change < 0).alias("downward"), F.count_if(any_).alias("any_artefact"), pct(F.count_if((change < 0) & ~any_), F.count_if(~any_)).alias("pct_downward_without"))


@query(f"""with {t.FACT}, {_CHAINS}, d as (select chain_length, count(*) as n_chains from chain group by 1)
    select chain_length, n_chains, (select sum(n_chains) from d e where e.chain_length >= d.chain_length)::bigint as n_reaching, {_pct('(select sum(n_chains) from d e where e.chain_length > d.chain_length)', '(select sum(n_chains) from d e where e.chain_length >= d.chain_length)')} as pct_revised_again from d""")
def d10_chain_lengths(spark, sf):
    """Chains by length, and of those that reach a length the share revised again."""
    per = chains(spark, sf).groupBy("chain_length").agg(F.count("*").alias("n_chains"))
    longer = F.sum("n_chains").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("chain_length")).rowsBetween(Window.unboundedPreceding, -1))  # a row for each length
    reaching = F.coalesce(longer, F.lit(0)) + F.col("n_chains")
    return per.select("chain_length", "n_chains", reaching.alias("n_reaching"), pct(longer, reaching).alias("pct_revised_again"))
