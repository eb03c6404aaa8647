"""Raw text tables to typed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import blank_to_null, safe_numeric, yyyymmdd
from tidemark.operators.bitemporal import pick_one
from tidemark.plans.registry import query
from tidemark.plans.tables import STATEMENTS, case, table
from tidemark.sources.delimited import load


def _text(name: str) -> Column:
    return blank_to_null(F.col(name))


def _number(name: str, kind: str = "int") -> Column:
    """Blank is null; other text that is no number stops the job, since no rule says what it should become."""
    return F.nullif(F.col(name), F.lit("")).cast(kind)


def submissions(raw: DataFrame) -> DataFrame:
    """One row for each filing. Whether it is an amendment is read off the form as filed, before it is trimmed."""
    period, filed = yyyymmdd(F.col("period")), yyyymmdd(F.col("filed"))
    return raw.where("adsh is not null").select(
        "adsh", _number("cik", "long").alias("cik"), F.trim("name").alias("company_name"), _text("sic").alias("sic_code"), _text("countryba").alias("business_country"), _text("stprba").alias("business_state"), _text("countryinc").alias("incorporation_country"), _text("stprinc").alias("incorporation_state"),
        _text("former").alias("former_name"), _text("afs").alias("filer_status"), (F.col("wksi") == "1").alias("is_well_known_issuer"), _text("fye").alias("fiscal_year_end_mmdd"), F.upper(F.trim("form")).alias("form_type"), F.col("form").like("%/A").alias("is_amendment"), period.alias("period_end_date"),
        _number("fy").alias("fiscal_year"), _text("fp").alias("fiscal_period"), filed.alias("filed_date"), (F.col("prevrpt") == "1").alias("was_later_amended"), (F.col("detail") == "1").alias("has_footnote_detail"), _number("nciks").alias("n_ciks"), F.datediff(filed, period).alias("filing_lag_days"), "source_quarter",
    )


def numeric(raw: DataFrame) -> DataFrame:
    """One row for each reported number; values that are no plain numbers are null."""
    empty = lambda name: F.coalesce(_text(name), F.lit(""))
    return raw.where("adsh is not null and tag is not null").select(
        "adsh", F.trim("tag").alias("tag"), F.trim("version").alias("taxonomy_version"), empty("coreg").alias("coregistrant"), empty("segments").alias("segments"), yyyymmdd(F.col("ddate")).alias("period_end_date"), _number("qtrs").alias("qtrs"), F.trim("uom").alias("unit_of_measure"),
        safe_numeric(F.col("value")).alias("value"), _text("footnote").alias("footnote"), (F.col("qtrs") == "0").alias("is_instant"), (F.col("qtrs") == "4").alias("is_annual"), _text("segments").isNotNull().alias("has_segments"), "source_quarter",
    )


def presentation(raw: DataFrame) -> DataFrame:
    """One row for each line of a filing's statements."""
    code = F.upper(_text("stmt"))
    return raw.where("adsh is not null").select("adsh", _number("report").alias("report_number"), _number("line").alias("line_number"), code.alias("statement_code"), case(code, STATEMENTS).alias("statement_name"), (F.col("inpth") == "1").alias("is_parenthetical"), F.trim("tag").alias("tag"), F.trim("version").alias("taxonomy_version"), _text("plabel").alias("presentation_label"), "source_quarter")


def tags(raw: DataFrame) -> DataFrame:
    """The latest definition of each tag and version. Definitions of one quarter are told apart by all their columns."""
    rows = raw.where("tag is not null").select(F.trim("tag").alias("tag"), F.trim("version").alias("taxonomy_version"), (F.col("custom") == "1").alias("is_custom"), (F.col("abstract") == "1").alias("is_abstract"), _text("datatype").alias("data_type"), _text("iord").alias("instant_or_duration"), _text("crdr").alias("natural_balance"), _text("tlabel").alias("tag_label"), F.col("source_quarter").alias("last_seen_quarter"))
    rest = [c for c in rows.columns if c not in ("tag", "taxonomy_version", "last_seen_quarter")]
    return pick_one(rows, ["tag", "taxonomy_version"], F.desc("last_seen_quarter"), *(F.asc_nulls_last(c) for c in rest))


#: Members of a quarter and the functions that type them.
MEMBERS = {"sub": submissions, "num": numeric, "pre": presentation, "tag": tags}


def stage(spark: SparkSession, root: str, quarters: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All members of some quarters, read and typed, and the rejects of all."""
    staged, rejects = {}, None
    for member, typed in MEMBERS.items():
        raw, bad = load(spark, root, quarters, member)
        staged[member] = typed(raw)
        rejects = bad if rejects is None else rejects.unionByName(bad)
    return staged, rejects


def raw_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The driver's facts as text, as a quarter's file would have them; some values and dates are malformed."""
    x = table(spark, sf, "lineitem")
    value = F.when(F.col("l_partkey") % 17 == 0, F.format_string("1,%d", F.col("l_partkey"))).when(F.col("l_partkey") % 19 == 0, "-12.5e2").otherwise(F.col("l_extendedprice").cast("decimal(28,2)").cast("string"))
    date = F.when(F.col("l_suppkey") % 37 == 0, "20010231").otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    adsh = F.when(F.col("l_orderkey") % 211 != 0, F.col("l_orderkey").cast("string")).alias("adsh")
    return x.select(adsh, F.format_string(" T%d ", F.col("l_partkey") % 6).alias("tag"), F.lit("us-gaap/2001 ").alias("version"), F.lit(" ").alias("coreg"), F.when(F.col("l_returnflag") == "R", " Seg ").alias("segments"), date.alias("ddate"), F.when(F.col("l_linenumber") != 5, (F.col("l_linenumber") % 5).cast("string")).otherwise("").alias("qtrs"), F.lit("USD").alias("uom"), value.alias("value"), F.lit(" ").alias("footnote"), F.lit("2001q1").alias("source_quarter"))


@query("""select l_orderkey::varchar as adsh, 'T' || (l_partkey % 6) as tag, 'us-gaap/2001' as taxonomy_version, '' as coregistrant, case when l_returnflag = 'R' then 'Seg' else '' end as segments,
    case when l_suppkey % 37 <> 0 then l_shipdate::date end as period_end_date, case when l_linenumber <> 5 then (l_linenumber % 5)::int end as qtrs, 'USD' as unit_of_measure,
    case when l_partkey % 17 = 0 then null when l_partkey % 19 = 0 then -1250.0 else l_extendedprice::decimal(28,2) end::decimal(28,4) as value, null::varchar as footnote, coalesce(case when l_linenumber <> 5 then (l_linenumber % 5)::int end = 0, false) as is_instant,
    coalesce(case when l_linenumber <> 5 then (l_linenumber % 5)::int end = 4, false) as is_annual, l_returnflag = 'R' as has_segments, '2001q1' as source_quarter from lineitem where l_orderkey % 211 <> 0""")
def m02b_staged_numbers(spark, sf):
    """Facts from text: trimmed, guarded against values and dates that are none."""
    return numeric(raw_numbers(spark, sf))


def raw_filings(spark: SparkSession, sf: str) -> DataFrame:
    """The driver's orders as text rows of a filing table."""
    x, blank = table(spark, sf, "orders"), F.lit(" ")
    form = F.when(F.col("o_orderkey") % 3 == 0, " 10-k/A ").when(F.col("o_orderkey") % 3 == 1, "10-q/A").otherwise("8-K")
    period = F.when(F.col("o_custkey") % 7 != 0, F.date_format(F.date_sub(F.trunc("o_orderdate", "quarter"), 1), "yyyyMMdd"))
    text = {"adsh": F.col("o_orderkey").cast("string"), "cik": F.col("o_custkey").cast("string"), "name": F.format_string(" Company %d ", "o_custkey"), "sic": F.when(F.col("o_custkey") % 5 == 0, "6020").otherwise(blank), "afs": F.lit(" 1-LAF"), "wksi": F.when(F.col("o_custkey") % 2 == 0, (F.col("o_custkey") % 4 / 2).cast("int").cast("string")), "fye": F.lit("1231"), "form": form, "period": period, "fy": F.lit(""), "fp": F.lit("FY "), "filed": F.date_format("o_orderdate", "yyyyMMdd"), "prevrpt": F.lit("1"), "detail": F.lit("0"), "nciks": F.lit("1"), "source_quarter": F.lit("2001q1")}
    return x.select(*(text.get(n, blank).alias(n) for n in "adsh cik name sic countryba stprba countryinc stprinc former afs wksi fye form period fy fp filed prevrpt detail nciks source_quarter".split()))


@query("""select o_orderkey::varchar as adsh, o_custkey as cik, 'Company ' || o_custkey as company_name, case when o_custkey % 5 = 0 then '6020' end as sic_code, null::varchar as business_country, null::varchar as business_state, null::varchar as incorporation_country, null::varchar as incorporation_state,
    null::varchar as former_name, '1-LAF' as filer_status, case o_custkey % 4 when 0 then false when 2 then true end as is_well_known_issuer, '1231' as fiscal_year_end_mmdd, case o_orderkey % 3 when 0 then '10-K/A' when 1 then '10-Q/A' else '8-K' end as form_type, o_orderkey % 3 = 1 as is_amendment,
    case when o_custkey % 7 <> 0 then (date_trunc('quarter', o_orderdate)::date - 1)::date end as period_end_date, null::int as fiscal_year, 'FY' as fiscal_period, o_orderdate::date as filed_date, true as was_later_amended, false as has_footnote_detail, 1::int as n_ciks,
    case when o_custkey % 7 <> 0 then (o_orderdate::date - (date_trunc('quarter', o_orderdate)::date - 1))::int end as filing_lag_days, '2001q1' as source_quarter from orders""")
def m01b_staged_filings(spark, sf):
    """Filings from text: an amendment by the form as filed, so one with a space after it is none."""
    return submissions(raw_filings(spark, sf))


def raw_presentation(spark: SparkSession, sf: str) -> DataFrame:
    """The driver's parts as text lines of statements, some without a statement or a label."""
    x = table(spark, sf, "part")
    code = F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("p_size") % 8 + 1).cast("int"))
    text = {
        "adsh": F.when(F.col("p_partkey") % 101 != 0, (F.col("p_partkey") % 300).cast("string")), "report": F.when(F.col("p_partkey") % 13 != 0, (F.col("p_partkey") % 9).cast("string")).otherwise(""), "line": F.col("p_size").cast("string"), "stmt": F.when(F.col("p_size") % 9 != 0, F.concat(F.lit(" "), F.lower(code))).otherwise(" "),
        "inpth": F.when(F.col("p_size") % 7 == 0, "1").when(F.col("p_size") % 7 == 1, "0"), "tag": F.format_string("T%d ", F.col("p_partkey") % 5), "version": F.lit(" us-gaap/2001"), "plabel": F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit(" "), "p_name")).otherwise(" "), "source_quarter": F.lit("2001q1"),
    }
    return x.select(*(c.alias(n) for n, c in text.items()))


@query(f"""with p as (select *, case when p_size % 9 <> 0 then ['BS','IS','CF','EQ','CI','UN','CP','SI'][(p_size % 8 + 1)::int] end as code from part where p_partkey % 101 <> 0)
    select (p_partkey % 300)::varchar as adsh, case when p_partkey % 13 <> 0 then (p_partkey % 9)::int end as report_number, p_size::int as line_number, code as statement_code, case code {" ".join(f"when '{k}' then '{v}'" for k, v in STATEMENTS.items())} end as statement_name,
    case p_size % 7 when 0 then true when 1 then false end as is_parenthetical, 'T' || (p_partkey % 5) as tag, 'us-gaap/2001' as taxonomy_version, case when p_partkey % 4 <> 0 then trim(p_name) end as presentation_label, '2001q1' as source_quarter from p""")
def m03b_staged_presentation(spark, sf):
    """Lines of statements from text: report and line numbers, codes in capitals, blanks as nulls."""
    return presentation(raw_presentation(spark, sf))


def raw_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The driver's parts as text definitions of some hundred tags, each defined in several quarters, and more than once in one."""
    x = table(spark, sf, "part")
    k = F.col("p_partkey")
    text = {
        "tag": F.format_string(" Tag%d", k % 100), "version": F.when(k % 100 < 20, F.format_string("%010d", k % 100)).otherwise("us-gaap/2001 "), "custom": F.when(k % 100 < 20, "1").otherwise("0"), "abstract": F.when(k % 3 == 0, "1").otherwise("0"), "datatype": F.when(k % 3 != 0, " monetary").otherwise(" "),
        "iord": F.when(k % 2 == 0, "I").otherwise("D"), "crdr": F.when(k % 5 == 0, "C").otherwise(""), "tlabel": F.concat(F.lit(" "), "p_name"), "source_quarter": F.format_string("200%dq%d", F.col("p_size") % 3, F.col("p_size") % 4 + 1),
    }
    return x.select(*(c.alias(n) for n, c in text.items()))


@query("""with t as (select 'Tag' || (p_partkey % 100) as tag, case when p_partkey % 100 < 20 then lpad((p_partkey % 100)::varchar, 10, '0') else 'us-gaap/2001' end as taxonomy_version, p_partkey % 100 < 20 as is_custom, p_partkey % 3 = 0 as is_abstract,
    case when p_partkey % 3 <> 0 then 'monetary' end as data_type, case when p_partkey % 2 = 0 then 'I' else 'D' end as instant_or_duration, case when p_partkey % 5 = 0 then 'C' end as natural_balance, trim(p_name) as tag_label, '200' || (p_size % 3) || 'q' || (p_size % 4 + 1) as last_seen_quarter from part)
    select * from t qualify row_number() over (partition by tag, taxonomy_version order by last_seen_quarter desc, is_custom, is_abstract, data_type nulls last, instant_or_duration nulls last, natural_balance nulls last, tag_label nulls last) = 1""")
def m04b_staged_tags(spark, sf):
    """The latest definition of each tag and version, from text that defines them quarter by quarter."""
    return tags(raw_tags(spark, sf))
