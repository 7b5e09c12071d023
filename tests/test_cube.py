"""Fan-out, CUBE form = grouping-sets form = brute-force masks."""
import itertools
import random


from segmetrics.operators.aggregates import line_metrics
from segmetrics.operators.cube import affected_keys, location_fanout, segment_cube, segment_cube_gs
from segmetrics.plans import catalog


def sales(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = [(float(rnd.randint(1, 9) * 1000), 2000 + rnd.randint(0, 2), rnd.choice(["kent", "essex"]),
             rnd.choice(["e1", "e2", "n1"]), rnd.choice(["quarrow", "dover"]),
             rnd.choice(["flat", "detached"]), rnd.choice(["freehold", "leasehold"])) for _ in range(n)]
    schema = "price double, year_sold int, county string, outcode string, district string, house_type string, tenure string"
    return spark.createDataFrame(rows, schema), rows


def masks_brute_force(rows):
    acc = {}
    for price, year, county, outc, district, h, t in rows:
        for ltype, lval in (("county", county), ("postcode", outc), ("borough", district)):
            for ml, mh, mt in itertools.product([0, 1], repeat=3):
                key = (ltype, "all" if ml else lval, "all" if mh else h, "all" if mt else t, "all", "all", year)
                s, n = acc.get(key, (0.0, 0))
                acc[key] = (s + price, n + 1)
    return {k: (s / n, n) for k, (s, n) in acc.items()}


def as_dict(df):
    return {(r["location_type"], r["location_value"], r["house_type"], r["tenure"], r["size_band"],
             r["year_built_band"], r["year_sold"]): (r["avg_price"], r["sale_count"]) for r in df.collect()}


def test_cube_forms_equal_masks(spark):
    df, rows = sales(spark)
    expect = masks_brute_force(rows)
    a = as_dict(segment_cube(df, line_metrics(), by=["year_sold"]))
    b = as_dict(segment_cube_gs(df, line_metrics(), by=["year_sold"]))
    assert a == expect
    assert b == expect


def test_24_keys_per_sale(spark):
    df = spark.createDataFrame([(1.0, 2019, "c", "o", "d", "flat", "freehold")],
                               "price double, year_sold int, county string, outcode string, district string, "
                               "house_type string, tenure string")
    assert segment_cube_gs(df, line_metrics(), by=["year_sold"]).count() == 24
    assert location_fanout(df).count() == 3


def test_affected_keys(spark):
    seg = spark.createDataFrame([("county", "kent", "flat", "freehold", "all", "all")],
                                "location_type string, location_value string, house_type string, tenure string, "
                                "size_band string, year_built_band string")
    out = affected_keys(seg).collect()
    keys = {(r["affected_location_value"], r["affected_house_type"], r["affected_tenure"]) for r in out}
    assert len(out) == 8 and keys == set(itertools.product(["kent", "all"], ["flat", "all"], ["freehold", "all"]))


def test_cube_queries_expand_finest_states(spark, monkeypatch):
    """The sales are summed by locations, dimensions and year before the
    expansion, so that it grows with the groups and not with the sales."""
    df, rows = sales(spark)
    monkeypatch.setattr(catalog, "sales", lambda spark, sf: df)
    for name in ("segment_cube", "segment_cube_gs"):
        cube = catalog.QUERIES[name](spark, "")
        below = cube._jdf.queryExecution().optimizedPlan().toString().split("Expand")[1]
        assert "Aggregate" in below
        assert as_dict(cube) == masks_brute_force(rows)
