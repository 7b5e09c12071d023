"""Parsing, dropping bad rows, role resolution."""
import pytest

from pyspark.sql import functions as F

from segmetrics.functions import text as T
from segmetrics.functions.keys import property_id
from segmetrics.operators.clean import borough_predicate, clean_sales, rejected_sales
from segmetrics.plans import catalog
from segmetrics.plans.build import performance_from_sales
from segmetrics.sources.csv import read_raw_sales, resolve_roles
from tests.conftest import raw_rows


def sale(tid, price, date, **kw):
    base = {"transaction_id": tid, "price": price, "date_of_transfer": date, "postcode": "QX4 7ZZ",
            "property_type": "T", "duration": "L", "paon": "3", "street": "Mill Lane",
            "district": "Fenwick", "county": "North Vale", "record_status": "D"}
    base.update(kw)
    return base


def test_price_and_date_parsing(spark):
    rows = [
        sale("a", " 250000 ", "2019-06-15 00:00"),
        sale("b", "1e5", "2019-06-15"),
        sale("c", "1,000", "2019-06-15"),          # rejected price
        sale("d", "abc", "2019-06-15"),
        sale("e", "100", "2019-6-15 0"),           # rejected date
        sale("f", "100", " 2020-01-02T10:00"),     # first 10 chars after trim
        sale("g", None, "2019-06-15"),
        sale("h", "100", None),
        sale("i", "NaN", "2019-06-15"),            # NaN is not null: kept
    ]
    got = {r["transaction_id"]: r for r in clean_sales(raw_rows(spark, rows)).collect()}
    assert set(got) == {"a", "b", "f", "i"}
    assert got["a"]["price"] == 250000.0 and got["b"]["price"] == 100000.0
    assert str(got["f"]["sale_date"]) == "2020-01-02" and got["f"]["year_sold"] == 2020
    assert got["a"]["county"] == "north vale" and got["a"]["outcode"] == "qx4"
    assert got["a"]["house_type"] == "terraced" and got["a"]["tenure"] == "leasehold"
    assert got["a"]["property_id"] == "qx4 7zz|3||mill lane"
    why = {r["transaction_id"]: r["reason"] for r in rejected_sales(raw_rows(spark, rows)).collect()}
    assert why == {"c": "price", "d": "price", "e": "date", "g": "price", "h": "date"}


def test_borough_prefilter_and_deletes_kept(spark):
    rows = [sale("a", "1", "2019-01-01", district=" FENWICK "), sale("b", "1", "2019-01-01", district="Aldham")]
    out = clean_sales(raw_rows(spark, rows), borough_predicate("Fenwick")).collect()
    assert [r["transaction_id"] for r in out] == ["a"]   # record_status 'D' is not filtered


def test_csv_scan_positional_and_short_rows(spark, tmp_dir):
    path = f"{tmp_dir}/sales.csv"
    with open(path, "w") as f:
        f.write("s1,180000,2011-03-02 00:00,QX4 7ZZ,T,N,L,3,,Mill Lane,,Weirton,Fenwick,North Vale,A,A\n")
        f.write("s2,90000,2014-07-01 00:00,QX4 1AA\n")
    df = read_raw_sales(spark, path)
    rows = {r["transaction_id"]: r for r in df.collect()}
    assert rows["s1"]["county"] == "North Vale" and rows["s1"]["saon"] is None
    assert rows["s2"]["postcode"] == "QX4 1AA" and rows["s2"]["county"] is None


NAMED = ("sale_price string, transfer_date string, postcode_full string, property_type string,"
         " duration string, county string, district string, street_name string")


def test_resolve_roles_by_name(spark):
    df = spark.createDataFrame([("1", "2019-01-01", "Q1", "F", "L", "Vale", "Weir", "x")], NAMED)
    r = resolve_roles(df)
    assert r.columns[:3] == ["transaction_id", "price", "date"]
    row = r.collect()[0]
    assert row["price"] == "1" and row["date"] == "2019-01-01" and row["street"] == "x" and row["paon"] == ""


def test_resolve_roles_named_and_ambiguous(spark):
    df = spark.createDataFrame([("1", "2019-01-01", "Q1", "F", "L", "Vale", "Weir", "x", "9")], NAMED + ", list_price string")
    with pytest.raises(ValueError, match="price"):
        resolve_roles(df)
    assert resolve_roles(df, {"price": "list_price"}).first()["price"] == "9"
    with pytest.raises(ValueError, match="county"):
        resolve_roles(df.drop("county"), {"price": "list_price"})
    with pytest.raises(ValueError):
        resolve_roles(df, {"price": "no_such_column"})


def test_reserved_values_are_rejected(spark):
    rows = [sale("a", "100", "2011-01-01"), sale("b", "150", "2014-01-01", county=" ALL "), sale("c", "120", "2014-01-01"),
            sale("d", "1", "2014-01-01", postcode="all 1")]
    raw = raw_rows(spark, rows)
    assert {r["transaction_id"]: r["reason"] for r in rejected_sales(raw).collect()} == {"b": "reserved", "d": "reserved"}
    perf = performance_from_sales(clean_sales(raw)).collect()
    for r in perf:     # each year once, and the sale that reads 'all' nowhere
        assert [p["year_sold"] for p in r["line_graph"]] == ["2011", "2014"] and r["sale_count"] == 2


def test_reserved_value_report(spark):
    from segmetrics.operators.clean import reserved_value_report

    rows = [sale("a", "1", "2019-01-01", county=" ALL "),
            sale("b", "1", "2019-01-01", paon=None, saon=None, street=None),
            sale("c", "1", "2019-01-01")]
    r = reserved_value_report(clean_sales(raw_rows(spark, rows), keep_reserved=True)).collect()[0]
    assert (r["sales"], r["county_all"], r["tenure_all"], r["no_address"]) == (3, 1, 0, 1)


def test_cleaning_is_done_once_a_row(spark):
    """No filter repeats the cleaning of the columns that it reads."""
    plan = clean_sales(raw_rows(spark, [{"price": "1"}]))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Filter" in line or "Join" in line:
            assert "regexp_replace" not in line and "gettimestamp" not in line and "translate" not in line, line


def test_cleaned_parts_equal_the_plain_functions(spark):
    """Columns that are cleaned from a common spaced form, against each
    function by itself, on odd texts; dates of odd forms against the pattern."""
    odd = [None, "", " ", "#", "# a", "  A  b\t\tC ", " ", "x#y", " \t#\t ", "E1 2AB", "Å  İ", "all", "a b"]
    days = ["2019-06-15 00:00", " 1996-02-29", "1996-02-31 00:00", "1996-2-3", "0000-01-01", "9999-12-31", "", None, "2019-06-15x", "+2019-06-1",
            "2019-13-01", "2019/06/15", "12019-06-15"]
    rows = [{"transaction_id": f"{i}-{j}", "price": "7", "date_of_transfer": days[(i + j) % len(days)], "postcode": a, "county": b, "district": a,
             "paon": b, "saon": a, "street": b, "property_type": a, "duration": b} for i, a in enumerate(odd) for j, b in enumerate(odd)]
    raw = raw_rows(spark, rows)
    got = {r.transaction_id: r for r in clean_sales(raw, keep_reserved=True).withColumn("sale_date", F.col("sale_date").cast("string")).collect()}
    day = F.try_to_date(F.substring(F.trim(F.col("date_of_transfer")), 1, 10), "yyyy-MM-dd")
    want = raw.select("transaction_id", day.cast("string").alias("sale_date"), T.normalise("county").alias("county"), T.normalise("district").alias("district"),
                      T.outcode("postcode").alias("outcode"), T.house_type("property_type").alias("house_type"), T.tenure("duration").alias("tenure"),
                      property_id(*[F.col(c) for c in ("postcode", "paon", "saon", "street")]).alias("property_id")).where("sale_date IS NOT NULL").collect()
    assert len(got) == len(want) > 0
    for r in want:
        assert all(got[r.transaction_id][c] == r[c] for c in r.asDict()), (r, got[r.transaction_id])


def test_property_id_is_normalised_at_once(spark):
    """One pass over the joined parts, and one each for county and district;
    the table of blanks only for texts that aren't plain ASCII."""
    plan = clean_sales(raw_rows(spark, [{"price": "1"}]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3
    assert plan.count("RLIKE(") == 6 + 1  # six texts, and the form of the date


def test_streets_are_cleaned_with_the_sale(spark, monkeypatch):
    """The street queries take the street from the sale's own texts."""
    streets = ["Mill  Lane", " mill\tlane ", "#", " ", None, "É  x"]
    rows = [sale(f"s{i}", "10", "2019-06-15", street=x) for i, x in enumerate(streets)]
    monkeypatch.setattr(catalog, "raw", lambda spark, sf: raw_rows(spark, rows))
    lines = catalog.QUERIES["street_agg"](spark, "")
    # not stripped by itself
    assert "trim(street" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert {r["street"]: r["sale_count"] for r in lines.collect()} == {"mill lane": 2, "": 1, "unknown": 2, "é x": 1}
