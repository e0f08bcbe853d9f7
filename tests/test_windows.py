"""Windows over categories of any number, against lists that are cut by hand."""

import random

from pyspark.sql import functions as F

from marketgrain.operators import lifecycle


def test_windows_equal_slices(spark):
    rng, rows, lists = random.Random(9), [], {}
    for g in range(6):
        keys = sorted(rng.sample(range(1_000_000), rng.choice([1, 30, 59, 61, 400])))
        lists[g] = [(k, rng.randrange(2)) for k in keys]
        rows += [(g, k, v) for k, v in lists[g]]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g int, k long, saved int")
    for factor in (0, 7, 1_000):
        got = lifecycle.category_windows(frame, "g", "k", (F.col("g") * factor) % F.col("n"), bucket=5_000).collect()
        assert len(got) == 6
        for r in got:
            own, start = lists[r.g], r.g * factor % len(lists[r.g])
            assert (r.n, r.start) == (len(own), start)
            assert [(x.k, x.saved) for x in r.window] == own[start : start + lifecycle.WINDOW_CATEGORIES]


def test_a_cursor_behind_the_end_reads_nothing(spark):
    frame = spark.createDataFrame([(1, k, 1) for k in range(5)], "g int, k long, saved int")
    row = lifecycle.category_windows(frame, "g", "k", F.col("n") + 3).first()
    assert list(row.window) == [] and row.n == 5
