"""All models written as tables, and the published results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import analyses, catalog, quality, restated
from tidemark.sources import export

#: Results that are published as CSV and as JSON; each has few rows.
PUBLISHED = {
    "rst_by_sector": restated.m17_by_sector,
    "rst_by_statement": restated.m18_by_statement,
    "rst_by_filer_size": restated.m19_by_filer_size,
    "dq_custom_tag_share": quality.m12_custom_tag_share,
    "dq_scorecard": quality.m15_scorecard,
    "dq_filing_lag_profile": quality.m14_filing_lag_profile,
}


def build(spark: SparkSession, sf: str, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Write models as tables under `root`, each one rebuilt whole; all of them unless `names` are given."""
    out = {}
    for name in names or [n for n in catalog.QUERIES if n.startswith("m")]:
        catalog.QUERIES[name](spark, sf).write.mode("overwrite").parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def publish(spark: SparkSession, sf: str, root: str) -> None:
    """Write the published results as CSV and JSON lines, and the metrics as one document."""
    for name, model in PUBLISHED.items():
        result = model(spark, sf)
        export.write_csv(result, f"{root}/{name}.csv")
        export.write_json(result, f"{root}/{name}.json")
    document = export.metrics_document(analyses.totals(spark, sf), quality.m15_scorecard(spark, sf), analyses.BAR)
    document.coalesce(1).write.mode("overwrite").text(f"{root}/quality_metrics.json")
