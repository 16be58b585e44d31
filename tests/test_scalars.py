"""Scalar functions on hand-made rows; expected values follow from the formulas."""

import pytest
from pyspark.sql import functions as F

from normscope.functions import scalars as S
from normscope.spec import EventSpec, check_registration


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def parts(*pairs):
    return F.array(*[F.struct(F.lit(float(s)).alias("score"), F.lit(float(w)).alias("weight")) for s, w in pairs])


def test_number(spark):
    given = [" 12.5 ", "1,5", "-3e2", "1d", "NaN", "Infinity", "1_000", "", "x", None, "+.5", "7."]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").select("i", S.number(F.col("v")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [12.5, 1.5, -300.0, None, None, None, None, None, None, None, 0.5, 7.0]
    assert one(spark, S.number(F.lit(True), "boolean"), S.number(F.lit(3), "int")) == (None, 3.0)


def test_deviation_scores(spark):
    z = S.robust_z(F.lit(5000.0), F.lit(21.5), F.lit(1.4826), F.lit(False), F.lit(60))
    zero = S.robust_z(F.lit(0.0), F.lit(50.0), F.lit(0.5), F.lit(True), F.lit(20))
    thin = S.robust_z(F.lit(500.0), F.lit(50.0), F.lit(1.0), F.lit(True), F.lit(3))
    flat = S.robust_z(F.lit(9.0), F.lit(5.0), F.lit(0.0), F.lit(False), F.lit(50))
    got = one(spark, z, S.squash(z, 3.0), zero, thin, flat)
    assert got[0] == pytest.approx(3357.9522, abs=1e-3) and got[1] == pytest.approx(0.999107, abs=1e-6) and got[2:] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(("share", "n", "v", "expected"), [(0.0, 20, 1, 0.909091), (0.0, 100, 1, 0.980392), (0.0, 2000, 1, 0.999001), (1.0, 100, 1, 0.0), (0.01, 100, 5, 0.886792), (0.0, 0, 0, 0.0)])
def test_rarity(spark, share, n, v, expected):
    assert one(spark, S.rarity(F.lit(share), F.lit(n), F.lit(v)))[0] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(("scores", "expected"), [((0.62, 0.05, 0, 0, 0.02, 0), 0.62266), ((0.6, 0.6, 0.6), 0.72), ((0.8, 0.3), 0.83), ((0.9,), 0.9)])
def test_combine(spark, scores, expected):
    assert one(spark, S.combine(parts(*[(s, 1) for s in scores])))[0] == pytest.approx(expected, abs=1e-9)


def test_combine_of_nothing(spark):
    assert one(spark, S.combine(F.filter(parts((1, 1)), lambda r: r["score"] > 5)))[0] == 0.0


@pytest.mark.parametrize(("applicable", "firing", "expected"), [(6, 1, 0.75), (1, 0, 0.4083), (4, 2, 0.7333), (0, 0, 0.0)])
def test_confidence(spark, applicable, firing, expected):
    assert one(spark, S.confidence(F.lit(applicable), F.lit(firing)))[0] == pytest.approx(expected)


def test_severity(spark):
    assert one(spark, *[S.severity(F.lit(x)) for x in (85.0, 84.9, 70.0, 50.0, 49.9)]) == ("critical", "high", "high", "medium", "low")


def test_excess(spark):
    got = one(spark, S.excess_score(F.lit(5000.0), F.lit(108.1), F.lit(104.5)), S.excess_score(F.lit(100.0), F.lit(108.1), F.lit(104.5)))
    assert got[0] == pytest.approx(0.997868, abs=1e-6) and got[1] is None


def test_scopes(spark):
    df = spark.createDataFrame([("books", "SK"), (None, "a=b")], "c string, m string")
    keys = [tuple(r) for r in df.select(S.scope_key(["m", "c"]), S.scope_key([]), S.scope_key(["m"])).collect()]
    assert keys == [("c=books|m=SK", "*", "m=SK"), ("c=|m=a=b", "*", "m=a=b")]
    match = df.select(S.scope_match(S.scope_key(["m", "c"]))).collect()
    assert match[0][0] == {"c": "books", "m": "SK"} and match[1][0] == {"c": "", "m": "a=b"}
    assert one(spark, S.describe_scope(F.lit("*")), S.describe_scope(F.lit("a=1|b=2")), F.size(S.scope_match(F.lit("*")))) == ("all data", "a=1, b=2", 0)


def test_fingerprint(spark):
    def reasons(*pairs):
        return F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(f).alias("feature")) for d, f in pairs])

    a = S.fingerprint(F.lit("S"), F.lit("peer_group"), reasons(("peer_group", "refund_amount"), ("robust_deviation", "items")))
    b = S.fingerprint(F.lit("S"), F.lit("peer_group"), reasons(("robust_deviation", "x"), ("peer_group", "refund_amount")))
    c = S.fingerprint(F.lit("S"), F.lit("peer_group"), reasons(("robust_deviation", "x")))
    got = one(spark, a, b, c)
    assert got[0] == got[1] == "f74b979b0d2ec2574d92f3141657a28e" and got[2] != got[0]


def test_redaction(spark):
    text = "write to a.b@c.de or DE89370400440532013000, call +421 900 123 456 now"
    got = one(spark, S.redact(F.lit(text)), S.strip_code_fence(F.lit("```json\n{}\n```")), S.strip_code_fence(F.lit("  plain ")))
    assert got == ("write to [email] or [iban], call [phone] now", "{}", "plain")
    nested = spark.createDataFrame([({"k": ["x@y.zz"]},)], "v map<string,array<string>>")
    assert nested.select(S.redact_all(F.col("v"), nested.schema["v"].dataType)).first()[0] == {"k": ["[email]"]}


def test_times(spark):
    given = ["2026-05-01T10:00:00Z", "2026-05-01T12:00:00+02:00", "2026-05-01", "soon", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").select(F.unix_seconds(S.parsed_time(F.col("v"))).alias("s")).collect()
    assert [r["s"] for r in rows] == [1777629600, 1777629600, 1777593600, None, None]


def test_spec():
    spec = EventSpec(numeric=("a",), dimensions=("d",), weights={"peer_group": 0.5})
    assert EventSpec.from_dict(spec.as_dict()) == spec and spec.detector_weights["peer_group"] == 0.5
    with pytest.raises(ValueError):
        EventSpec()
    with pytest.raises(ValueError):
        check_registration(spec, ["events"])
