"""Predecessor pairing against a brute-force sort, with a hot
property (many sales, many on one day, price ties)."""
import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from segmetrics.operators.repeat import _paired_whole, hot_properties, placed_with_predecessor, repeat_sales, with_predecessor
from segmetrics.plans.build import shared_sales


def make_sales(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # property 'hot' holds about a third of all rows
        prop = "hot" if i % 3 == 0 else f"p{rnd.randint(0, 60)}"
        day = dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 40))
        price = float(rnd.choice([100, 200, 200, 300, 0, 50]))
        rows.append((f"t{i:04d}", prop, price, day, day.year, "c", "o", "d", "flat", "freehold"))
    schema = ("transaction_id string, property_id string, price double, sale_date date, year_sold int, "
              "county string, outcode string, district string, house_type string, tenure string")
    return spark.createDataFrame(rows, schema), rows


def brute_force(rows):
    out = {}
    by_prop = {}
    for r in rows:
        by_prop.setdefault(r[1], []).append(r)
    for prop, rs in by_prop.items():
        rs.sort(key=lambda r: (r[3], r[2], r[0]))
        prev = None
        for r in rs:
            out[r[0]] = (prev[3], prev[2]) if prev else None
            prev = r
    return out


def test_predecessor_matches_sort(spark):
    df, rows = make_sales(spark)
    expect = brute_force(rows)
    for source in (df, shared_sales(df)):
        got = {r["transaction_id"]: (r["bought_date"], r["bought_price"]) if r["bought_date"] else None
               for r in with_predecessor(source).collect()}
        assert got == expect
    # hot properties in parts, some or all of them
    for hot_sales in (0, 15, 100):
        assert {r["_hot_id"] for r in hot_properties(df, hot_sales).collect()} == {
            p for p, n in Counter(r[1] for r in rows).items() if n > hot_sales}
        got = {r["transaction_id"]: (r["bought_date"], r["bought_price"]) if r["bought_date"] else None
               for r in with_predecessor(df, hot_sales).collect()}
        assert got == expect


def test_placed_pairs_match_sort(spark):
    """Dealt out by place: the same pairs, hot properties or not, several
    tasks to a place, properties, ids and prices missing, rows repeated."""
    df, rows = make_sales(spark)
    odd = [(None, "p1", 200.0), (None, "p1", 200.0), ("x", None, 100.0), ("y", None, 200.0), ("z", "hot", float("nan")), ("n", "hot", None)]
    day = dt.date(2000, 1, 15)
    df = df.unionByName(spark.createDataFrame([(t, p, x, day, 2000, "c", "o", "d", "flat", "freehold") for t, p, x in odd], df.schema))
    want = Counter(map(str, with_predecessor(df).collect()))
    placed = df.withColumn("place", F.pmod(F.xxhash64("property_id"), F.lit(4)))
    for hot_sales, parts in ((0, 3), (15, 1), (15, 3), (100, 3), (10_000, 1), (10_000, 3)):
        got = placed_with_predecessor(placed, "place", parts, hot_sales)
        assert Counter(map(str, got.drop("place").collect())) == want
    # what the pairing deals out and sorts is as the writer wants it
    out = got.sortWithinPartitions("place", "property_id")._jdf.queryExecution()
    plan = out.executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == plan.count("hashpartitioning(place") == plan.count("Sort [place") == 1


def test_infinite_and_nan_prices(spark):
    """Infinity and NaN sort after all other prices of a day."""
    day = dt.date(2001, 1, 1)
    prices = [float("nan"), float("inf"), 1e308, 5.0, 0.0, -3.0, float("-inf")]
    rows = [(f"t{i}", "p", x, day, 2001, "c", "o", "d", "flat", "freehold") for i, x in enumerate(prices)]
    schema = ("transaction_id string, property_id string, price double, sale_date date, year_sold int, "
              "county string, outcode string, district string, house_type string, tenure string")
    for hot_sales in (0, 100):
        got = {r["transaction_id"]: r["bought_price"] for r in with_predecessor(spark.createDataFrame(rows, schema), hot_sales).collect()}
        assert got == {"t6": None, "t5": float("-inf"), "t4": -3.0, "t3": 0.0, "t2": 5.0, "t1": 1e308, "t0": float("inf")}


def test_one_exchange_of_the_sales(spark):
    """Sales that no property is hot in are exchanged once, by property."""
    df, _ = make_sales(spark)
    plan = _paired_whole(shared_sales(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(property_id" in plan


def test_appreciation_and_repeat_filter(spark):
    df, rows = make_sales(spark)
    expect = brute_force(rows)
    rep = {r["transaction_id"]: r for r in repeat_sales(df).collect()}
    assert set(rep) == {k for k, v in expect.items() if v}
    for tid, r in rep.items():
        assert r["appreciation_pounds"] == r["price"] - r["bought_price"]
        if r["bought_price"] > 0:
            assert abs(r["appreciation_pct"] - (r["price"] - r["bought_price"]) / r["bought_price"] * 100) < 1e-9
        else:
            assert r["appreciation_pct"] is None
        assert r["year_bought"] == r["bought_date"].year


def test_null_transaction_id_orders_first(spark):
    d1, d2 = dt.date(2001, 1, 1), dt.date(2001, 2, 1)
    rows = [("a", "p", 100.0, d1), (None, "p", 200.0, d2), ("b", "p", 200.0, d2), ("c", "p", 150.0, d2)]
    full = [(t, p, x, d, d.year, "c", "o", "d", "flat", "freehold") for t, p, x, d in rows]
    schema = ("transaction_id string, property_id string, price double, sale_date date, year_sold int, "
              "county string, outcode string, district string, house_type string, tenure string")
    got = {(r["transaction_id"], r["price"]): (r["bought_date"], r["bought_price"])
           for r in with_predecessor(spark.createDataFrame(full, schema)).collect()}
    assert got[("a", 100.0)] == (None, None)
    assert got[("c", 150.0)] == (d1, 100.0)       # first sale of the day <- previous day's last
    assert got[(None, 200.0)] == (d2, 150.0)      # null id is first among the ties
    assert got[("b", 200.0)] == (d2, 200.0)
