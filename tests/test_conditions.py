import itertools

from pyspark.sql import functions as F

from caseweave.functions import scalars
from caseweave.functions.conditions import CONJUNCTS, condition_holds, condition_text


def evaluate(spark, cases):
    df = spark.createDataFrame(
        [(i, attrs, conj) for i, (attrs, conj) in enumerate(cases)],
        f"i int, attrs map<string,string>, conj {CONJUNCTS}",
    )
    out = df.select("i", condition_holds(F.col("attrs"), F.col("conj")).alias("h"), condition_text(F.col("conj")).alias("t"))
    return {r.i: (r.h, r.t) for r in out.collect()}


def test_golden_fold(spark):
    conj = [("x", ">", "2"), ("c", "==", "u")]
    cases = [({"x": "5", "c": "u"}, conj), ({"c": "u"}, conj), ({"x": "1", "c": "u"}, conj), ({"x": "5"}, conj), ({"x": "1"}, conj)]
    got = evaluate(spark, cases)
    assert [got[i][0] for i in range(5)] == [True, True, False, True, False]
    assert got[0][1] == "x > 2 and c == 'u'"


def test_against_python(spark):
    values = [None, "1", "2.5", "abc", "True"]
    tests = [("x", "<=", "2"), ("x", ">", "2"), ("x", "==", "1.0"), ("x", "!=", "abc"), ("y", "==", "true"), ("y", "<=", "1")]

    def number(v):
        try:
            return float(v)
        except ValueError:
            return None

    def typed(v):
        return number(v) if number(v) is not None else (v.lower() == "true" if v.lower() in ("true", "false") else v)

    def same(a, b):
        return type(a) is type(b) and a == b

    def holds(attrs, conj):
        for attr, op, value in conj:
            if attr not in attrs:
                return True
            have, want = typed(attrs[attr]), typed(value)
            if op in ("<=", ">"):
                ok = isinstance(have, float) and isinstance(want, float) and ((have <= want) == (op == "<="))
            else:
                ok = same(have, want) == (op == "==")
            if not ok:
                return False
        return True

    cases = []
    for x, y in itertools.product(values, values):
        attrs = {k: v for k, v in (("x", x), ("y", y)) if v is not None}
        for n in (1, 2):
            cases += [(attrs, list(c)) for c in itertools.permutations(tests, n)]
    got = evaluate(spark, cases)
    assert {i: h for i, (h, _) in got.items()} == {i: holds(*c) for i, c in enumerate(cases)}


def test_text_quotes_texts_only(spark):
    got = evaluate(spark, [({}, [("a", "==", "it's"), ("b", "<=", "3.5")])])
    assert got[0] == (True, "a == 'it\\'s' and b <= 3.5")


def test_scalars(spark):
    df = spark.sql(
        "SELECT map('n', '1e2', 'b', 'TRUE', 's', 'x', 'q', 'nan', 'u', '1_0') AS m, timestamp'2024-03-05 06:07:08.123' AS t"
    )
    r = df.select(
        scalars.typed_attributes(F.col("m")).alias("m"),
        scalars.epoch_millis(F.col("t")).alias("ms"),
        scalars.clock_text(F.col("t")).alias("clock"),
        scalars.number_text(F.lit(3.0)).alias("a"), scalars.number_text(F.lit(12.345)).alias("b"),
        scalars.number_text(F.lit(2.5e7)).alias("c"),
        scalars.ratio3(F.lit(402), F.lit(800)).alias("r"), scalars.ratio3(F.lit(1), F.lit(0)).alias("z"),
        scalars.parse_timestamp(F.lit("2024-01-01T00:00:00+02:00")).alias("p"),
        scalars.parse_timestamp(F.lit("no time")).alias("bad"),
        scalars.payload(F.map_concat("m", F.create_map(F.lit("is_end_event"), F.lit("True")))).alias("pay"),
    ).head()
    assert (r.m["n"].num, r.m["b"].bool, r.m["s"].str, r.m["q"].str, r.m["u"].str) == (100.0, True, "x", "nan", "1_0")
    assert r.ms % 1000 == 123 and r.clock == "06:07:08 05-03-2024"
    assert (r.a, r.b[:4], r.c) == ("3.0", "12.3", "25000000.0")
    assert (r.r, r.z) == (0.502, 0.0)
    assert r.bad is None and r.p is not None
    assert "is_end_event" not in r.pay and "n" in r.pay
