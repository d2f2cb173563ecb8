"""Times that pandas can't hold as timestamps: assets of large ids are centuries away."""

from lodestone.operators import sessions as N
from tests.test_live_sessions import data, frame, run, sizes

YEARS_500 = 500 * 365.25 * 86_400


def test_streamed_sessions_after_2262(spark):
    rows = [(k, i, s and s + YEARS_500, lat, lon) for k, i, s, lat, lon in data(5) if k is not None]
    last = (1, 99_999, 1_800_000_000.0 + YEARS_500, None, None)  # lets the watermark pass all others, and waits itself
    late = (2, 99_998, rows[0][2] - 86_400, None, None)
    got, query = run(spark, [rows[:150], rows[150:], [last], [late]], "1 hour", close=False)
    assert sizes(got) == sizes(N.sessionize(frame(spark, rows)))
    assert sum(int(p["stateOperators"][0]["numRowsDroppedByWatermark"]) for p in query.recentProgress if p["stateOperators"]) == 1
