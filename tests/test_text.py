"""Text cleaning against written-out results and
properties that hold for any text."""
import random

from pyspark.sql import functions as F

from segmetrics.functions.keys import lookup_part, property_id
from segmetrics.functions.text import WHITESPACE, house_type, normalise, normalise_or_empty, outcode, tenure
from segmetrics.schema import HOUSE_TYPES, TENURES


def test_whitespace_set_matches_python():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_normalise(spark):
    cases = {
        None: "unknown", "": "unknown", "   ": "unknown", "\t ": "unknown", "\x1c": "unknown",
        "  Mill   Lane ": "mill lane", "Upper\tWeir\nRow": "upper weir row", "No#5": "no5",
        "#": "", "# a": " a", "#  #": " ", "ÀBC déF": "àbc déf", "a\x1db": "a b",
    }
    assert column(spark, list(cases), normalise("v")) == list(cases.values())
    or_empty = {**cases, None: "", "": "unknown"}
    got = column(spark, list(or_empty), normalise_or_empty("v"))
    assert got[0] == "" and got[2:] == list(or_empty.values())[2:]


def test_house_type(spark):
    cases = {"D": "detached", "detached": "detached", " s ": "semi_detached", "T": "terraced", "\tf": "flat", "O": "other",
             "x": "other", "": "other", " ": "other", None: "other", "1d": "other"}
    assert column(spark, list(cases), house_type("v")) == list(cases.values())


def test_tenure(spark):
    cases = {"F": "freehold", "free": "freehold", " L": "leasehold", "lease": "leasehold", "U": "unknown", "": "unknown",
             None: "unknown", " ": "unknown"}
    assert column(spark, list(cases), tenure("v")) == list(cases.values())


def test_outcode(spark):
    cases = {"QX4 7ZZ": "qx4", " yb12\t9aa ": "yb12", "QX4": "qx4", "Q#X4 7ZZ": "qx4", "": "unknown", "  ": "unknown",
             None: "unknown", "#": "", "　W1 1A": "w1"}
    assert column(spark, list(cases), outcode("v")) == list(cases.values())


def test_property_id_and_lookup(spark):
    df = spark.createDataFrame([("QX4 7ZZ", "3", None, "Mill  Lane"), (" ", "", "", None)],
                               "pc string, paon string, saon string, street string")
    ids = [r[0] for r in df.select(property_id(F.col("pc"), F.col("paon"), F.col("saon"), F.col("street"))).collect()]
    assert ids == ["qx4 7zz|3||mill lane", "unknown|||"]
    assert column(spark, [None, "", "  ", " Flat ", "A#B"], lookup_part("v")) == ["all", "all", "", "flat", "a#b"]


def test_properties_of_any_text(spark):
    rnd = random.Random(11)
    alphabet = list("aAbZ9#-_ dstfoDSTFOlL") + ["\t", "\n", "\x0b", "\x1c", "\x1f", "\xa0", "　", "é", "Ö"]
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    n = column(spark, values, normalise("v"))
    assert column(spark, n, F.coalesce(F.nullif(normalise("v"), F.lit("unknown")), F.col("v"))) == [
        " ".join(x.split()) if x.strip() else x for x in n]                        # cleaning again only strips
    for v, x, o, h, t in zip(values, n, column(spark, values, outcode("v")), column(spark, values, house_type("v")),
                             column(spark, values, tenure("v"))):
        assert "#" not in x and "  " not in x and x == x.lower()
        assert not any(c in x for c in WHITESPACE if c != " ")
        assert (x == "unknown") == (v.strip() == "")
        assert " " not in o and o in (x, "unknown", "") or x.lstrip().startswith(o)
        assert h in {*HOUSE_TYPES.values(), "other"} and t in {*TENURES.values(), "unknown"}
        if not v.strip():
            assert (h, t, o) == ("other", "unknown", "unknown")
