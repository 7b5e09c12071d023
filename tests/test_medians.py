"""Exact medians against a sort, also through the way for giant groups; the
heatmap from partial states against the same metrics over its rows."""
import math
import random

from pyspark.sql import functions as F

from segmetrics.operators.aggregates import heatmap_metrics, price_stats_metrics
from segmetrics.operators import medians
from segmetrics.operators.cube import EVERY_TYPE, segment_cube
from segmetrics.operators.extras import SEGMENT_YEAR, finest_price_counts, line_mode, price_stats_cube, street_heatmap
from segmetrics.operators.medians import cube_medians, exact_median
from segmetrics.plans.build import HEAT_INPUT, heatmap_agg


def _order(x):
    return (math.isnan(x), x if not math.isnan(x) else 0.0)


def test_median_by_sorting(spark):
    rng = random.Random(2)
    odd = [float("nan"), float("inf"), -float("inf"), 0.0, 5.0, None]
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice(odd + [float(rng.randint(-9, 9))] * 6)) for _ in range(3000)]
    rows += [("one", 1, 7.0), ("nulls", 1, None), ("two", 1, 1.0), ("two", 1, 2.0)] + [("hot", 1, float(i // 3)) for i in range(5000)]
    counts = spark.createDataFrame(rows, "g string, h int, x double").groupBy("g", "h", "x").agg(F.count(F.lit(1)).alias("n")).cache()
    want = {}
    for g, h, x in rows:
        if x is not None:
            want.setdefault((g, h), []).append(x)
    want = {k: sorted(v, key=_order)[(len(v) + 1) // 2 - 1] for k, v in want.items()}
    for giant_rows in (1_000_000, 1000, 3, 0):
        got = exact_median(counts, ["g", "h"], "x", "m", giant_rows=giant_rows).collect()
        assert len(got) == len(want)
        for r in got:
            assert _order(r.m) == _order(want[r.g, r.h]), (giant_rows, r)


def test_heatmap_roll_up(spark):
    """Two dimensions more, null percentages, one group with nulls alone."""
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        gain = float(rng.randint(-50, 50))
        rows.append((gain, None if i % 5 == 0 or i < 40 else gain / 8, 1999 + (i >= 40), 2001 + i % 2, f"c{i % 2}", f"o{i % 5}", f"d{i % 3}",
                     f"h{i % 4}", f"t{i % 3}"))
    names = HEAT_INPUT
    types = ["double", "double", "int", "int"] + ["string"] * 5
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    got = heatmap_agg(df)
    want = segment_cube(df, heatmap_metrics(), by=["year_bought", "year_sold"])
    assert got.columns == want.columns
    digits = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(digits, got.collect()), key=str) == sorted(map(digits, want.collect()), key=str)


def test_states_are_expanded_not_sales(spark):
    """The grouping sets of the mergeable metrics read the states."""
    rows = [(float(i % 7), 1.0, 2000, 2001, "c", "o", "d", "h", "t") for i in range(500)]
    df = spark.createDataFrame(rows, "appreciation_pounds double, appreciation_pct double, year_bought int, year_sold int, "
                                     "county string, outcode string, district string, house_type string, tenure string")
    plan = heatmap_agg(df)._jdf.queryExecution().optimizedPlan().toString()
    expand = plan.index("Expand")
    assert "Aggregate" in plan[expand:] and "_ap_sum" in plan[expand:]


def test_price_stats_and_streets_are_exact(spark):
    """The rolled-up price view and the street grid against plain groupings
    of the rows and sorted values; null streets and null values among them."""
    rng = random.Random(9)
    rows = []
    for _ in range(1200):
        price, pounds = float(rng.randint(1, 40)), rng.choice([None, -5.0, 0.0, float(rng.randint(-9, 9))])
        rows.append((rng.choice(["c1", "c2"]), rng.choice(["o1", "o2"]), rng.choice(["d1", "d2"]), rng.choice(["flat", "other"]), "freehold",
                     2000 + rng.randint(0, 1), 2005, price, pounds, None if pounds is None else pounds / 4, rng.choice(["high", "low", None])))
    df = spark.createDataFrame(rows, "county string, outcode string, district string, house_type string, tenure string, year_bought int, "
                               "year_sold int, price double, appreciation_pounds double, appreciation_pct double, street string").cache()
    exact = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price)").alias("median_price")
    by = ["year_bought", "year_sold"]
    want = segment_cube(df, [m for m in price_stats_metrics() if "percentile" not in str(m)] + [exact], by=by)
    got = price_stats_cube(df).select(*want.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0

    streets = {}
    for r in rows:
        streets.setdefault((r[10], r[5], r[6]), []).append(r)
    found = street_heatmap(df).collect()
    assert len(found) == len(streets)
    for r in found:
        own = streets[r.street, r.year_bought, r.year_sold]
        pounds = sorted(x[8] for x in own if x[8] is not None)
        assert r.sale_count == len(own) and r.biggest_loser_pounds == pounds[0] and r.biggest_winner_pounds == pounds[-1]
        assert r.median_appreciation_pounds == pounds[(len(pounds) + 1) // 2 - 1]
        assert r.median_appreciation_pct == pounds[(len(pounds) + 1) // 2 - 1] / 4


def test_cube_medians_by_sorting(spark):
    """Medians of all groups of the cube from their middle buckets, odd values
    and counts among them, also where the bucket itself is walked by ranges."""
    rng = random.Random(4)
    odd = [float("nan"), float("inf"), -float("inf"), 0.0, -0.5, 1e-300, -1e300, 1000.0, 1000.5, 1001.0, None]
    rows = [(rng.choice(["c1", "c2"]), rng.choice(["o1", "o2", "o3"]), "d1", rng.choice(["h1", "h2"]), rng.choice(["t1", "t2"]), 2000 + rng.randint(0, 1),
             rng.choice(odd + [float(rng.randint(-2000, 2000))] * 8), rng.randint(1, 3)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "county string, outcode string, district string, house_type string, tenure string, year_sold int, x double, n int")
    want = {}
    for c, o, d, h, t, y, x, n in rows:
        for place in (("county", c), ("postcode", o), ("borough", d), (EVERY_TYPE, "all")):
            for hk in (h, "all"):
                for tk in (t, "all"):
                    if x is not None:
                        want.setdefault((y, *place, hk, tk), []).extend([x] * n)
    want = {k: sorted(v, key=_order)[(len(v) + 1) // 2 - 1] for k, v in want.items()}
    got = cube_medians(df, ["year_sold"], "x", "m", n="n")
    found = {tuple(r)[:-1]: r.m for r in got.collect()}
    assert {k: _order(v) for k, v in found.items()} == {k: _order(v) for k, v in want.items()}


def test_median_of_a_middle_part(spark):
    """Values below the part are counted, not held; giant parts, too."""
    rows = [("a", float(v), 1, 40, 200) for v in range(1000, 1100)]
    counts = spark.createDataFrame(rows, "g string, x double, n int, b long, t long")
    for giant_rows in (1_000_000, 10):
        assert exact_median(counts, ["g"], "x", "m", giant_rows=giant_rows, before="b", total="t").collect()[0].m == 1059.0


def test_cube_medians_expand_few_rows(spark):
    """The heatmap's values are not expanded to all 16 sets and grouped: the
    counts that are stored hold the middle buckets alone."""
    rows = [(float(i), 1.0, 2000, 2001, "c", "o", "d", "h", "t") for i in range(1, 20001)]
    df = spark.createDataFrame(rows, "appreciation_pounds double, appreciation_pct double, year_bought int, year_sold int, "
                                     "county string, outcode string, district string, house_type string, tenure string")
    written = []
    real = medians.stored
    medians.stored = lambda d, name: written.append((name, real(d, name))) or written[-1][1]
    try:
        heatmap_agg(df).count()
    finally:
        medians.stored = real
    assert [n for n, _ in written].count("median-counts") == 2
    assert sum(d.count() for n, d in written if n == "median-counts") < 20000


def test_modes_are_counted_where_a_price_lies(spark):
    """One exchange by year and price before the sets are added up."""
    rng = random.Random(3)
    rows = [(rng.choice(["c1", "c2"]), rng.choice(["o1", "o2"]), "d1", rng.choice(["h1", "h2"]), "t1", 2000 + rng.randint(0, 1), float(rng.randint(1, 30)))
            for _ in range(900)]
    df = spark.createDataFrame(rows, "county string, outcode string, district string, house_type string, tenure string, year_sold int, price double")
    got = {tuple(r[k] for k in SEGMENT_YEAR): (r.mode_price, r.sale_count) for r in line_mode(finest_price_counts(df)).collect()}
    want = {}
    for c, o, d, h, t, y, p in rows:
        for kind, value in (("county", c), ("postcode", o), ("borough", d)):
            for v in (value, "all"):
                for hk in (h, "all"):
                    for tk in (t, "all"):
                        want.setdefault((kind, v, hk, tk, "all", "all", y), []).append(p)
    assert got == {k: (min(set(v), key=lambda p: (-v.count(p), p)), len(v)) for k, v in want.items()}
    plan = line_mode(finest_price_counts(df))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate inline")]
    assert "price" not in "".join(x for x in above.splitlines() if "Exchange hashpartitioning" in x)
