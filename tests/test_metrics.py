import hashlib
import random

from tablewright import catalogue
from tablewright.operators import metrics

SF = "/root/testdata/sf0.001"


def test_rows_are_numbered(spark):
    rows = spark.createDataFrame([(k * 7 % 501,) for k in range(501)], "k long").repartition(5)
    got = metrics.number_rows(rows, ["k"], "i", 16).collect()
    assert sorted(r.i for r in got) == list(range(501)) and sorted(r.k for r in got) == list(range(501))


def test_bootstrap_draws_from_all_rows(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(250)]
    means = metrics.bootstrap(spark.createDataFrame(list(enumerate(values)), "i long, v double"), "v", "i", 250, 40)
    draw = lambda b, i: int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:15], 16) % 250
    want = {b: sum(values[draw(b, i)] for i in range(250)) / 250 for b in range(40)}
    got = {r.replicate: r.mean for r in means.collect()}
    assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-9 for b in want)
    interval = metrics.bootstrap_interval(means).first()
    assert (round(interval.low, 9), round(interval.high, 9)) == tuple(round(sorted(want.values())[k], 9) for k in (1, 39))


def test_interval_of_all_orders(spark):
    f1 = [r.f1 for r in catalogue.QUERIES["bag_prf_by_doc"](spark, SF).collect()]
    (r,) = catalogue.QUERIES["bootstrap_interval"](spark, SF).collect()
    assert r.n == len(f1) > 100 and abs(100 * r.mean - sum(f1) / len(f1)) < 0.05 and r.low < r.mean < r.high
