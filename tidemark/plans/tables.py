"""The driver's tables in the shape of staged filings, facts, presentations and tags; once in DataFrames, once in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import size, source

_FORMS = {"1": "10-K", "2": "10-Q", "3": "10-K/A", "4": "10-Q/A", "5": "8-K"}
#: Tags of the mapped facts, by what they stand for.
ASSETS, LIABILITIES, TOTAL, CUSTOM, EQUITY, EQUITY_WITH_MINORITIES = "T0", "T1", "T2", "T3", "T4", "T5"
#: Bytes of a table's files, about a million facts, whose rows one task of a shuffle is given.
SHARE = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return source(spark, f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str) -> int | None:
    """So many partitions as the size of a table's files asks for; none if the session has them anyway."""
    n = -(-size(spark, f"{sf_dir}/{name}.parquet") // SHARE)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """Rows of a table by a hash of some columns. What a task sorts or holds doesn't grow with the table."""
    n = parts(rows.sparkSession, sf_dir, name)
    return rows.repartition(n, *keys) if n else rows.repartition(*keys)


def case(column: Column, values: dict, other: Column | None = None) -> Column:
    """Codes to labels."""
    out = F.lit(None) if other is None else other
    for k, v in reversed(values.items()):
        out = F.when(column == k, v).otherwise(out)
    return out


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    form = case(F.left("o_orderpriority", F.lit(1)), _FORMS)
    filed = F.to_date("o_orderdate")
    status = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "1-LAF").when(F.col("c_mktsegment") == "BUILDING", "2-ACC").when(F.col("c_mktsegment") != "MACHINERY", "4-NON")
    sic = F.when(F.col("c_nationkey") != 0, F.lpad((F.col("c_nationkey") * 400 + F.when(F.col("o_orderstatus") == "P", 100).otherwise(0)).cast("string"), 4, "0"))
    period = F.date_sub(F.trunc(filed, "quarter"), 1)
    return joined.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("adsh"),
        F.col("o_custkey").alias("cik"),
        F.concat_ws(" ", "c_name", "o_orderstatus").alias("company_name"),
        sic.alias("sic_code"),
        status.alias("filer_status"),
        F.when(F.col("o_orderkey") % 3 != 0, "1231").alias("fiscal_year_end_mmdd"),
        F.concat(F.lit("S"), F.col("o_orderkey") % 2).alias("business_state"),
        form.alias("form_type"),
        F.endswith(form, F.lit("/A")).alias("is_amendment"),
        period.alias("period_end_date"),
        F.year(period).alias("fiscal_year"),
        F.when(form == "10-K", "FY").otherwise(F.concat(F.lit("Q"), F.quarter(period))).alias("fiscal_period"),
        filed.alias("filed_date"),
        (F.col("o_orderkey") % 7 == 0).alias("was_later_amended"),
        F.datediff(filed, period).alias("filing_lag_days"),
    )


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filing's number and date, its company unseen."""
    return table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("adsh"), F.to_date("o_orderdate").alias("filed_date"))


def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    adsh = F.lpad(F.col("l_orderkey").cast("string"), 10, "0")
    year = F.year("l_shipdate")
    qtrs = F.when(F.col("l_partkey") % 101 == 0, 44).when(F.col("l_linenumber") % 2 == 0, 0).otherwise(4)
    return x.select(
        adsh.alias("adsh"),
        F.concat(F.lit("T"), F.col("l_partkey") % 6).alias("tag"),
        F.when(F.col("l_partkey") % 6 == 3, adsh).otherwise(F.concat(F.lit("us-gaap/"), year)).alias("taxonomy_version"),
        F.when(F.col("l_suppkey") % 23 == 0, "Sub").otherwise("").alias("coregistrant"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Seg="), "l_linestatus")).otherwise("").alias("segments"),
        F.make_date(year, F.lit(12), F.lit(31)).alias("period_end_date"),
        qtrs.alias("qtrs"),
        F.when(F.col("l_partkey") % 11 == 0, "shares").when(F.col("l_partkey") % 13 == 0, "EUR").otherwise("USD").alias("unit_of_measure"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice").cast("decimal(28,4)")).alias("value"),
        F.when(F.col("l_suppkey") % 50 == 0, F.concat(F.lit("note "), "l_linenumber")).alias("footnote"),
    )


STATEMENTS = {"BS": "balance sheet", "IS": "income statement", "CF": "cash flow", "EQ": "equity", "CI": "comprehensive income", "UN": "unclassified", "CP": "cover page", "SI": "supplementary information"}


def presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part")
    code = F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("p_size") % 8 + 1).cast("int"))
    return x.select(F.concat(F.lit("T"), F.col("p_partkey") % 5).alias("tag"), F.concat(F.lit("us-gaap/"), F.col("p_partkey") % 5 + 1995).alias("taxonomy_version"), F.when(F.col("p_size") % 9 != 0, code).alias("statement_code"), F.col("p_name").alias("presentation_label"), (F.col("p_size") % 7 == 0).alias("is_parenthetical"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary, one row for each tag and version; a tag that facts use may lack."""
    custom = F.col("tag") == CUSTOM
    used = numeric(spark, sf_dir).select("tag", "taxonomy_version").distinct().where("not (tag = 'T2' and taxonomy_version = 'us-gaap/1999')")
    return used.select("*", custom.alias("is_custom"), F.when(~custom, F.concat("tag", F.lit(" label"))).alias("tag_label"))


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that loading refused, by quarter and file."""
    return table(spark, sf_dir, "supplier").where("s_nationkey < 3").select(F.concat(F.lit("2001q"), F.col("s_suppkey") % 4 + 1).alias("source_quarter"), F.lit("num.txt").alias("source_file"), F.lit(10).alias("expected_columns"), (F.col("s_suppkey") % 5 + 1).alias("rows_rejected"))


SUB = """
sub as (select *, year(period_end_date)::int as fiscal_year, case when form_type = '10-K' then 'FY' else 'Q' || quarter(period_end_date) end as fiscal_period, (filed_date - period_end_date)::int as filing_lag_days from (
    select lpad(o_orderkey::varchar, 10, '0') as adsh, o_custkey as cik, c_name || ' ' || o_orderstatus as company_name,
    case when c_nationkey <> 0 then lpad((c_nationkey * 400 + case when o_orderstatus = 'P' then 100 else 0 end)::varchar, 4, '0') end as sic_code,
    case c_mktsegment when 'AUTOMOBILE' then '1-LAF' when 'BUILDING' then '2-ACC' when 'MACHINERY' then null else '4-NON' end as filer_status,
    case when o_orderkey % 3 <> 0 then '1231' end as fiscal_year_end_mmdd, 'S' || (o_orderkey % 2) as business_state,
    case left(o_orderpriority, 1) when '1' then '10-K' when '2' then '10-Q' when '3' then '10-K/A' when '4' then '10-Q/A' when '5' then '8-K' end as form_type,
    left(o_orderpriority, 1) in ('3', '4') as is_amendment,
    (date_trunc('quarter', o_orderdate)::date - 1)::date as period_end_date, o_orderdate::date as filed_date, o_orderkey % 7 = 0 as was_later_amended
    from orders join customer on o_custkey = c_custkey))"""

NUM = """
num as (select lpad(l_orderkey::varchar, 10, '0') as adsh, 'T' || (l_partkey % 6) as tag,
    case when l_partkey % 6 = 3 then lpad(l_orderkey::varchar, 10, '0') else 'us-gaap/' || year(l_shipdate) end as taxonomy_version,
    case when l_suppkey % 23 = 0 then 'Sub' else '' end as coregistrant, case when l_returnflag = 'R' then 'Seg=' || l_linestatus else '' end as segments,
    make_date(year(l_shipdate), 12, 31) as period_end_date, case when l_partkey % 101 = 0 then 44 when l_linenumber % 2 = 0 then 0 else 4 end as qtrs,
    case when l_partkey % 11 = 0 then 'shares' when l_partkey % 13 = 0 then 'EUR' else 'USD' end as unit_of_measure,
    case when l_linenumber <> 7 then l_extendedprice::decimal(28,4) end as value, case when l_suppkey % 50 = 0 then 'note ' || l_linenumber end as footnote from lineitem)"""

PRE = """
pre as (select 'T' || (p_partkey % 5) as tag, 'us-gaap/' || (p_partkey % 5 + 1995) as taxonomy_version,
    case when p_size % 9 <> 0 then ['BS','IS','CF','EQ','CI','UN','CP','SI'][(p_size % 8 + 1)::int] end as statement_code, p_name as presentation_label, p_size % 7 = 0 as is_parenthetical from part)"""

TAG = """
tags as (select distinct tag, taxonomy_version, tag = 'T3' as is_custom, case when tag <> 'T3' then tag || ' label' end as tag_label from num where not (tag = 'T2' and taxonomy_version = 'us-gaap/1999'))"""

REJECTS = "rejects as (select '2001q' || (s_suppkey % 4 + 1) as source_quarter, 'num.txt' as source_file, 10 as expected_columns, s_suppkey % 5 + 1 as rows_rejected from supplier where s_nationkey < 3)"

FACT = SUB + "," + NUM + ", fact as (select n.*, s.cik, s.filed_date, s.form_type, s.filer_status from num n join sub s using (adsh))"


def statement_name_sql(code: str) -> str:
    return f"case {code} " + " ".join(f"when '{k}' then '{v}'" for k, v in STATEMENTS.items()) + " end"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their filings. A task holds its share of the filings, and the facts pass by unsorted."""
    filings = submissions(spark, sf_dir).select("adsh", "cik", "filed_date", "form_type", "filer_status")
    return dealt(numeric(spark, sf_dir), sf_dir, "lineitem", "adsh").join(filings.hint("shuffle_hash"), "adsh")
