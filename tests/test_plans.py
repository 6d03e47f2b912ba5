"""Plans that have to fit in a driver, whatever the size of the tables."""

import pytest

from fathom.plans import issues  # noqa: F401  it registers its queries
from fathom.plans.catalog import QUERIES
from fathom.sources import work

DATA = "/root/testdata/sf0.001"


def leaves(df):
    """Readings of tables in a plan."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


@pytest.mark.parametrize("name", ["de08_five_detectors", "ag07_issue_summary"])
def test_detectors_run_one_by_one(spark, monkeypatch, name):
    read, inner = [], work.written
    monkeypatch.setattr(work, "written", lambda df, to: (read.append((to, leaves(df))), inner(df, to))[1])
    got = QUERIES[name](spark, DATA)
    read.append(("result", leaves(got)))
    # the names' meetings are the largest; all five detectors in one plan had 103
    assert max(n for _, n in read) <= 40, read
    assert {"filings", "matches", "overdue_annual_amendment", "vc_exemption_violation", "fund_type_mismatch", "missing_fund_in_adv", "exemption_mismatch"} <= {to for to, _ in read}
    # nothing reads the filings' own tables again once they are made
    assert read[0][0] == "filings" and dict(read)["result"] == 5
