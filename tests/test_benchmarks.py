"""Click-through benchmarks without a group or a row, recomputed in plain Python."""

import math

import pytest
from pyspark.sql import functions as F
from rankloom.functions.columns import CTR_CURVE
from rankloom.operators.benchmark import leave_group_out, leave_url_out
from rankloom.plans.pattern_reports import ctr_benchmark_row_out
from rankloom.sources.views import query_page

SF = "/root/testdata/sf0.001"


def targets(rows):
    urls = {}
    for r in rows:
        at = (max(1, min(10, math.floor(r.position + 0.5))), r.page.rstrip("/"))
        have = urls.setdefault(at, [0, 0])
        have[0] += r.clicks
        have[1] += r.impressions
    out, low = [], math.inf
    for bucket in range(1, 11):
        seen = [(c, i) for (b, _), (c, i) in urls.items() if b == bucket and i >= 30]
        rates = sorted(c / i for c, i in seen if c > 0)
        curve = CTR_CURVE[bucket - 1]
        site = rates[math.ceil(len(rates) * 0.75) - 1] if sum(i for _, i in seen) >= 1000 and len(seen) >= 5 and len(rates) >= 3 else None
        raw = curve if site is None else max(curve * 0.5, min(site, curve * 1.5))
        low = min(low, math.floor(raw * 10000 + 0.5) / 10000)
        out.append((bucket, low, site is not None))
    return out


def test_each_row_left_out(spark):
    rows = query_page(spark, SF).collect()
    got = {}
    for r in ctr_benchmark_row_out(spark, SF).collect():
        got.setdefault(r.grp, []).append((r.bucket, r.target, r.from_site))
    assert len(got) == len(rows)
    for i in range(0, len(rows), 7):
        want = targets(rows[:i] + rows[i + 1 :])
        have = sorted(got[f"{rows[i].query} @ {rows[i].page}"])
        assert [(b, s) for b, _, s in have] == [(b, s) for b, _, s in want]
        assert [t for _, t, _ in have] == pytest.approx([t for _, t, _ in want])


# --- rows worked out by hand: a bucket of five other pages, and one of too few ---------------------------------------------------------------

NINTH = [("peer", f"https://example.com/peer-{i}", clicks, 1000, 9.0) for i, clicks in enumerate([20, 18, 15, 12, 10])]
CANDIDATE = ("candidate", "https://example.com/candidate/", 0, 47_555, 8.8)
THIN = ("thin", "https://example.com/thin", 400, 500, 1.0)
COLUMNS = "query string, page string, clicks long, impressions long, position double"
FROM_SITE = 0.018  # the fourth of five rates in order; the curve alone says 0.015


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([CANDIDATE, *NINTH, THIN], COLUMNS)


def by_bucket(rows, **where):
    return {r.bucket: (pytest.approx(r.target), r.from_site) for r in rows if all(getattr(r, k) == v for k, v in where.items())}


def test_a_page_left_out(few):
    rows = leave_url_out(few).collect()
    got = by_bucket(rows, url_key="https://example.com/candidate")
    assert got[9] == (FROM_SITE, True)
    assert [got[b] for b in (1, 2, 8, 10)] == [(0.27, False), (0.15, False), (0.02, False), (0.012, False)]
    # four others are too few for a peer itself, and a page alone at its position has only the curve
    assert by_bucket(rows, url_key="https://example.com/peer-0")[9] == (0.015, True)  # the candidate's zero makes five pages; four rates are positive
    assert by_bucket(rows, url_key="https://example.com/thin")[1] == (0.27, False)
    with_zeros = by_bucket(leave_url_out(few, all_qualified=True).collect(), url_key="https://example.com/candidate")
    assert with_zeros[9] == (FROM_SITE, True) and with_zeros[1] == (0.27, False)


def test_a_group_left_out(spark, few):
    groups = spark.createDataFrame([("one", *CANDIDATE[:2]), ("two", "peer", "https://example.com/peer-0"), ("two", "peer", "https://example.com/peer-1"), ("three", *THIN[:2])], "grp string, query string, page string")
    rows = leave_group_out(few, groups).collect()
    assert by_bucket(rows, grp="one")[9] == (FROM_SITE, True) and by_bucket(rows, grp="one")[1] == (0.27, False)
    assert by_bucket(rows, grp="two")[9] == (0.015, False)  # four pages are left
    assert by_bucket(rows, grp="three")[1] == (0.27, False)
    assert by_bucket(rows, grp="three")[9] == (FROM_SITE, True)  # of five positive rates the fourth


def test_a_row_left_out(spark, few):
    rows = leave_group_out(few, few.select(F.concat_ws(" @ ", "query", "page").alias("grp"), "query", "page")).collect()
    assert by_bucket(rows, grp=f"candidate @ {CANDIDATE[1]}")[9] == (FROM_SITE, True)
    assert by_bucket(rows, grp=f"thin @ {THIN[1]}")[1] == (0.27, False)
    assert all(r.target <= 0.27 for r in rows)


def test_rates_are_kept_near_the_curve(spark):
    high = [("q", f"https://example.com/{i}", 900, 1000, 3.0) for i in range(6)]
    low = [("q", f"https://example.com/low-{i}", 1, 1000, 2.0) for i in range(6)]
    got = by_bucket(leave_url_out(spark.createDataFrame([*high, *low], COLUMNS)).collect(), url_key="https://example.com/0")
    assert got[2] == (0.075, True) and got[3] == (0.075, True)  # half of 0.15; 1.5 times 0.10 is over the target of the place before
