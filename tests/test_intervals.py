import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwave.operators import intervals, sorted_scan


def brute(rows):
    gaps, periods = set(), set()
    for k in {r[0] for r in rows}:
        own = sorted((s, e) for g, s, e in rows if g == k and s is not None and e is not None and s < e)
        merged = []
        for s, e in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] += 1
            else:
                merged.append([s, e, 1])
        periods |= {(k, a, b, n) for a, b, n in merged}
        gaps |= {(k, a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return gaps, periods


def check(spark, rows):
    df = spark.createDataFrame(rows, "k string, s long, e long")
    gaps, periods = brute([r for r in rows if r[0] is not None])
    assert {tuple(r) for r in intervals.gaps(df, ["k"], "s", "e").collect()} == gaps
    assert {tuple(r) for r in intervals.periods(df, ["k"], "s", "e").collect()} == periods


def test_hot_key_spans_partitions(spark):
    rng = random.Random(1)
    rows = [("hot", s, s + rng.randint(1, 40)) for s in (rng.randint(0, 90_000) for _ in range(4000))]
    rows += [(f"k{i % 7}", i * 3, i * 3 + 2) for i in range(200)] + [("nest", 0, 1000), ("nest", 5, 6), ("nest", 990, 1001), ("nest", 1001, 1002)]
    check(spark, rows + rows[:50])


def test_one_interval_over_all_partitions(spark):
    check(spark, [("k", 0, 10**6)] + [("k", i, i + 1) for i in range(5, 3000, 2)] + [("k", 10**6 + 5, 10**6 + 6)])


def test_nulls_empty_and_useless(spark):
    check(spark, [(None, 1, 2), ("a", None, 2), ("a", 1, None), ("a", 5, 5), ("a", 7, 3)])
    check(spark, [])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.integers(0, 45)), max_size=40))
def test_against_brute_force(spark, rows):
    check(spark, rows)


def test_event_intervals_clean_up(spark):
    rows = [(1, " Go ", 1.0, 0.5), (1, "go", 1.5, 1.0), (1, "GO", 3.0, 0.1), (1, "go", float("nan"), 1.0), (1, "go", 2.0, -1.0), (1, None, 9.0, 1.0), (1, "go", None, 1.0), (1, "go", 9.0, float("inf")), (1, "go", 2.0, 0.0)]
    df = spark.createDataFrame([r + ("x",) for r in rows], "file_id long, trial_type string, onset double, duration double, gap_from string")
    got = intervals.gaps(intervals.event_intervals(df), ["file_id", "trial_type"], "from_ms", "to_ms").collect()
    assert [tuple(r) for r in got] == [(1, "go", 2500, 3000)]


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7919 % 1009,) for i in range(1009)], "x long")
    got = sorted(tuple(r) for r in sorted_scan.global_rank(df, ["x"], "r").collect())
    assert got == [(i, i) for i in range(1009)]


def test_carried_state_over_partitions(spark):
    """One key holds nine tenths of the rows; results equal a plain pass, and no task has more than twice its share."""
    rng = random.Random(4)
    keys = [None if rng.random() < 0.02 else 0 if rng.random() < 0.9 else rng.randrange(1, 20) for _ in range(3000)]
    rows = [(k, i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, t int, n int, name string")
    out = sorted_scan.carried(df, ["k"], ["t"], sums={"run": "n"}, lasts={"last": "name"}, previous={"before": "t"}, least={"low": "n"})
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) <= 2 * len(rows) / 4
    want = {}
    for k in set(keys):
        total, last, before, low = 0, None, None, None
        for _, t, n, name in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            total, last, low = total + (n or 0), name or last, n if low is None else low if n is None else min(low, n)
            want[t] = (total, last, before, low)
            before = t
    assert {r["t"]: (r["run"], r["last"], r["before"], r["low"]) for r in out.collect()} == want
    assert {r["t"]: (r["run"], r["last"], r["before"], r["low"]) for r in out.union(out).collect()} == want
    assert sorted_scan.carried(df.where("false"), ["k"], ["t"], sums={"run": "n"}).count() == 0
    alone = sorted_scan.carried(df, [], ["t"], sums={"run": "n"}).orderBy("t").collect()
    assert alone[-1]["run"] == sum(r[2] or 0 for r in rows)
