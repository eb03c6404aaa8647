"""Models as tables, results as files."""

import glob
import json

from tidemark.plans import analyses, build


def test_build_and_publish(spark, small, tmp_path, monkeypatch):
    written = build.build(spark, small, str(tmp_path / "tables"), ["m06_company", "m15_scorecard"])
    before = written["m06_company"].count()
    again = build.build(spark, small, str(tmp_path / "tables"), ["m06_company"])
    assert written["m15_scorecard"].count() == 6 and again["m06_company"].count() == before > 0
    monkeypatch.setattr(build, "PUBLISHED", {k: build.PUBLISHED[k] for k in ("dq_scorecard", "dq_filing_lag_profile")})
    build.publish(spark, small, str(tmp_path / "results"))
    (csv,) = glob.glob(f"{tmp_path}/results/dq_scorecard.csv/*.csv")
    assert len(open(csv).read().splitlines()) == 7
    (document,) = glob.glob(f"{tmp_path}/results/quality_metrics.json/*.txt")
    found = json.loads(open(document).read())
    assert {r["rule"] for r in found["rules"]} == set(build.quality._RULES) and found["totals"]["n_filings"] == 1500 and found["tolerance"] == analyses.BAR
    drift = analyses.met02_drift(spark, small)
    assert analyses.drifted(drift) == 1 and analyses.drifted(drift.where("rule = 'none'")) == 0
