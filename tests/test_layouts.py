"""Plans of short series: rows are sorted once, before the indicators make them wide."""

import brute
from test_operators import CHUNKED, close, frame, rows

from sparkwick.operators import scan as S
from sparkwick.operators.indicators import INDICATORS, indicators
from sparkwick.sources.staging import stage


def test_short_series_are_sorted_once(spark):
    data = {"A": brute.walk(300, 1), "B": brute.walk(30, 2)}
    bars = stage(S.index_bars(frame(spark, data), CHUNKED, span_seconds=5 * 86400))
    got = indicators(bars, layout=S.fit_layout(bars)).select("symbol", "bar_idx", *INDICATORS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    want = indicators(bars, layout=CHUNKED).select("symbol", "bar_idx", *INDICATORS)
    close(rows(got, "symbol", "bar_idx"), rows(want, "symbol", "bar_idx"))
