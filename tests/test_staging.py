"""Raw text members to typed tables."""

import datetime as dt
from decimal import Decimal

import pytest

from tidemark.plans import staging
from tidemark.sources import delimited

D = dt.date
SUB = "adsh\tcik\tname\tsic\tcountryba\tstprba\tcountryinc\tstprinc\tformer\tafs\twksi\tfye\tform\tperiod\tfy\tfp\tfiled\tprevrpt\tdetail\tnciks"
NUM = "adsh\ttag\tversion\tcoreg\tsegments\tddate\tqtrs\tuom\tvalue\tfootnote"
PRE = "adsh\treport\tline\tstmt\tinpth\ttag\tversion\tplabel"
TAG = "tag\tversion\tcustom\tabstract\tdatatype\tiord\tcrdr\ttlabel"


def write(root, quarter, member, *lines):
    (root / quarter).mkdir(exist_ok=True)
    (root / quarter / member).write_bytes("\r\n".join(lines).encode())


@pytest.fixture
def root(tmp_path):
    write(tmp_path, "2020q1", "SUB.txt", SUB, "a1\t7\t Acme \t 6020 \tUS\t\tUS\tDE\t\t1-LAF\t1\t1231\t10-k/A\t20191231\t2019\tFY\t20200215\t0\t1\t1", SUB, "", "a2\t8\tBeta\t\t\t\t\t\t\t\t0\t\t 10-q \t20230231\t\t\t20200301\t\t\t")
    write(tmp_path, "2020q1", "num.txt", NUM, "a1\t Cash \tus-gaap/2019\t\tSeg=X\t20191231\t0\tUSD\t1.5e3\tsee note", 'a1\tRevenue\tus-gaap/2019\t \t\t20191231\t4\tUSD\t1,000\t"quoted', "a1\ttoo\tfew", "a1\tCash\tus-gaap/2019\t\t\t20191231\t0\tUSD\t.5\t\tmore", "\tNoAdsh\tv\t\t\t20191231\t0\tUSD\t1\t")
    write(tmp_path, "2020q1", "pre.txt", PRE, "a1\t2\t1\t bs \t1\tCash\tus-gaap/2019\tCash and more", "a1\t2\t2\t\t0\tRevenue\tus-gaap/2019\t")
    write(tmp_path, "2020q1", "tag.txt", TAG, "Cash\tus-gaap/2019\t0\t0\tmonetary\tI\tD\tCash, old", "Own\ta1\t1\t0\t\t\t\t")
    write(tmp_path, "2020q2", "tag.txt", TAG + "\tnew", "Cash\tus-gaap/2019\t0\t0\tmonetary\tI\tD\tCash, new\tx")
    return tmp_path


def test_staging(spark, root):
    with pytest.warns(UserWarning, match="2020q2 has no sub.txt"):
        staged, rejects = staging.stage(spark, str(root), ["2020q1", "2020q2"])
    # a line like the header is data; text that is no number would stop the job
    raw, _ = delimited.load(spark, str(root), ["2020q1"], "sub")
    assert raw.count() == 3 and {r.source_quarter for r in raw.collect()} == {"2020q1"}
    subs = {r.adsh: r for r in staging.submissions(raw.where("adsh <> 'adsh'")).collect()}
    a1, a2 = subs["a1"], subs["a2"]
    assert (a1.cik, a1.company_name, a1.sic_code, a1.business_state, a1.form_type, a1.is_amendment, a1.filing_lag_days, a1.is_well_known_issuer, a1.was_later_amended) == (7, "Acme", "6020", None, "10-K/A", True, 46, True, False)
    assert (a2.form_type, a2.is_amendment, a2.period_end_date, a2.filing_lag_days, a2.fiscal_year, a2.has_footnote_detail) == ("10-Q", False, None, None, None, None)
    nums = sorted(staged["num"].collect(), key=lambda r: r.tag)
    assert [(r.tag, r.value, r.coregistrant, r.segments, r.footnote, r.is_instant, r.has_segments) for r in nums] == [("Cash", Decimal(1500), "", "Seg=X", "see note", True, True), ("Revenue", None, "", "", '"quoted', False, False)]
    assert [(r.statement_code, r.statement_name, r.is_parenthetical, r.line_number) for r in staged["pre"].orderBy("line_number").collect()] == [("BS", "balance sheet", True, 1), (None, None, False, 2)]
    assert {r.tag: (r.tag_label, r.is_custom, r.last_seen_quarter) for r in staged["tag"].collect()} == {"Cash": ("Cash, new", False, "2020q2"), "Own": (None, True, "2020q1")}
    assert [(r.source_quarter, r.source_file, r.expected_columns, r.rows_rejected) for r in rejects.collect()] == [("2020q1", "num.txt", 10, 2)]
    counts = {r.table: r.n for r in delimited.load_counts({"num": staged["num"], "pre": staged["pre"]}, rejects).collect()}
    assert counts == {"num": 2, "pre": 2, "rejected": 2}


def test_quarters_with_one_header_are_one_scan(spark, tmp_path):
    """Six quarters under two headers are two scans; columns that a header lacks are null, rejects stay by quarter."""
    for k, quarter in enumerate(delimited.quarters("2019q1", "2020q2")):
        write(tmp_path, quarter, "Tag.TXT" if k == 3 else "tag.txt", TAG + "\tnew" * (k % 2), "Cash\tv\t0\t0\tm\tI\tD\tlabel" + f"\tx{k}" * (k % 2), *["short"] * k)
    rows, rejects = delimited.load(spark, str(tmp_path), delimited.quarters("2019q1", "2020q2"), "tag")
    assert {r.source_quarter: r.new for r in rows.collect()} == {"2019q1": None, "2019q2": "x1", "2019q3": None, "2019q4": "x3", "2020q1": None, "2020q2": "x5"}
    assert {(r.source_quarter, r.expected_columns, r.rows_rejected) for r in rejects.collect()} == {("2019q2", 9, 1), ("2019q3", 8, 2), ("2019q4", 9, 3), ("2020q1", 8, 4), ("2020q2", 9, 5)}
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
