"""Ore and waste runs of many holes at once against one hole at a time."""

import random

import pytest

from stratalode.operators import holes


def plainly(rows, cutoff, min_length, dilution):
    """Thin waste between touching ore first, then the shortest ore run again and again."""

    def join(runs):
        out = []
        for f, t, ore, n, metal, known in runs:
            if out and out[-1][2] == ore and abs(out[-1][1] - f) < 1e-9:
                m = out[-1]
                out[-1] = [m[0], t, ore, m[3] + n, m[4] + metal, m[5] + known]
            else:
                out.append([f, t, ore, n, metal, known])
        return out

    r = join([[f, t, g is not None and g >= cutoff, t - f, (t - f) * (g or 0.0), t - f if g is not None else 0.0] for f, t, g in sorted(rows, key=lambda x: x[:2])])
    i = 1
    while i + 1 < len(r):
        if not r[i][2] and r[i - 1][2] and r[i + 1][2] and r[i][3] <= dilution + 1e-9 and r[i - 1][1] == r[i][0] and r[i][1] == r[i + 1][0]:
            r[i][2] = True
            r = join(r)
        else:
            i += 1
    while short := [(x[3], k) for k, x in enumerate(r) if x[2] and x[3] < min_length - 1e-9]:
        r[min(short)[1]][2] = False
        r = join(r)
    return [(f, t, ore, n, m / k if k else None) for f, t, ore, n, m, k in r]


@pytest.mark.parametrize("batch", [7, 10000])
def test_many_holes(spark, batch):
    r, rows = random.Random(3), []
    for h in range(120):
        at = 0.0
        for _ in range(r.choice([1, 2, 3, 9, 40])):
            at += r.choice([0, 0, 0, 0, 1])
            end = at + r.choice([1.0, 2.0, 5.0])
            rows.append((f"h{h}", at, end, r.choice([None, 0.0, 1.0, 4.0, 5.0])))
            at = end
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = holes.runs(spark.createDataFrame(rows, "HOLE_ID string, FROM double, TO double, au double").repartition(3), "au", 3.0, 4.0, 2.0)
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # a call a hole
        made = {}
        for x in got.orderBy("hole", "from").collect():
            made.setdefault(x.hole, []).append(tuple(x)[1:])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for h in {x[0] for x in rows}:
        want = plainly([x[1:] for x in rows if x[0] == h], 3.0, 4.0, 2.0)
        assert [x[:4] for x in made[h]] == [x[:4] for x in want]
        assert [x[4] for x in made[h]] == [None if x[4] is None else pytest.approx(x[4]) for x in want]
