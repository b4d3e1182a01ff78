import datetime as dt
import random

from pyspark.sql import functions as F

from loomwave.functions.keys import normal_key, reference_key
from loomwave.operators.references import Reference, orphan_references, orphan_report

T0 = dt.datetime(2020, 1, 1)
REF = [Reference("c", "name", "id", "at", "p", "key", "since", "until")]


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def run(spark, parents, children):
    p = spark.createDataFrame([(k, day(a), day(b), "x") for k, a, b in parents], "key string, since timestamp_ntz, until timestamp_ntz, ts string")
    c = spark.createDataFrame([(i, k, day(t), 1) for i, k, t in children], "id long, name string, at timestamp_ntz, kind int")
    return {(r["row_id"], r["status"]) for r in orphan_references({"p": p, "c": c}, REF).collect()}


def test_statuses(spark):
    parents = [("a01", 1, 5), ("A1", 8, None), ("b", 4, None), ("z", None, None), ("a01", 1, 5)]
    children = [(1, "a1", 1), (2, " A001 ", 5), (3, "a1", 9), (4, "b", 3), (5, "nope", 3), (6, None, 3), (7, "", 3), (8, " N/A ", 3), (9, "a1", None), (2, "A1", 5), (10, "a1", 0), (11, "z", 5)]
    assert run(spark, parents, children) == {(2, "deleted"), (4, "late"), (5, "missing"), (9, "undated"), (10, "late"), (11, "missing")}


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a", 1)]) == {(1, "missing")}
    assert run(spark, [("a", 1, None)], []) == set()


def test_hot_key_against_brute_force(spark):
    rng = random.Random(3)
    keys = ["hot"] * 5 + ["a", "b", "c"]
    parents = [(rng.choice(keys), a, a + rng.randint(1, 30) if rng.random() < 0.8 else None) for a in (rng.randint(0, 500) for _ in range(40))]
    children = [(i, rng.choice([*keys, "none"]), rng.randint(0, 600)) for i in range(3000)]
    expect = set()
    for i, k, t in children:
        own = [(a, b) for q, a, b in parents if q == k]
        if not any(a <= t and (b is None or b > t) for a, b in own):
            expect.add((i, "missing" if not own else "late" if all(a > t for a, _ in own) else "deleted"))
    assert run(spark, parents, children) == expect


def test_report_counts_months(spark):
    p = spark.createDataFrame([], "key string, since timestamp_ntz, until timestamp_ntz")
    c = spark.createDataFrame([(1, "a", day(1)), (2, "a", day(2)), (3, "a", day(40))], "id long, name string, at timestamp_ntz")
    got = {(r["month"], r["n_cases"]) for r in orphan_report(orphan_references({"p": p, "c": c}, REF)).collect()}
    assert got == {("2020-01", 2), ("2020-02", 1)}


def test_keys(spark):
    df = spark.createDataFrame([("./Ses-01\\X_0007.PNG ",), ("ses-1/x_7.png",), ("a00b0",), ("000",), (" ",), ("N/A",), (None,)], "k string")
    got = [tuple(r) for r in df.select(normal_key(F.col("k")), reference_key(F.col("k"))).collect()]
    assert got == [("ses-1/x_7.png",) * 2, ("ses-1/x_7.png",) * 2, ("a0b0",) * 2, ("0",) * 2, ("", None), ("n/a", None), (None, None)]


def test_keys_in_one_form(spark):
    from loomwave.functions.keys import normal_key, strip_blanks

    cases = {"  a00\t": "a0", "　x000": "x0", "000": "0", "a0b00c01": "a0b0c1", "./007/08\\009": "7/8/9", "é00é": "é0é", "": "", "  ": "", "00 0 01": "0 0 1", "a\xa0": "a", "A10": "a10", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["k"] for r in df.select("v", normal_key(F.col("v")).alias("k")).collect()} == cases
    assert [r[0] for r in df.where("v = '  a00\t'").select(strip_blanks(F.col("v"))).collect()] == ["a00"]
