"""Hard negatives against brute force, with awkward rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, pivot string, dist string, uid string, is_anchor string, q string"


def brute(rows, every, low=80, full=100, k=5):
    rows = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, [math.floor(256 * x) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    rows = [r for r in rows if sum(x * x for x in r[1]) < 2**56]
    out = []
    for n, (a, v, lab) in enumerate(rows):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, m) for j, (i, w, m) in enumerate(rows) if j != n]
        for ps, p, m in sorted(s for s in scored if s[2] == lab)[:k]:
            fits = sorted((s, i) for s, i, m in scored if m != lab and low * -ps <= full * -s <= full * -ps)[:k]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fits)]
    return Counter(out)


def mined(spark, rows, every, **kw):
    df = spark.createDataFrame([(i, v, lab, *["clash"] * 5) for i, v, lab in rows], SCHEMA)
    df = df.filter(hn.finite(F.col("embedding")))
    label = F.col("label").cast("long")
    df = df.withColumns({"label": F.when(F.pmod("vec_id", F.lit(7)) == 0, (label + 1) % 10).otherwise(label), "q": hn.integer_vectors(F.col("embedding"))})
    return Counter(tuple(r) for r in hn.mine(df, F.col("vec_id") % every == 0, **kw).collect())


def vectors(rng, n, dim, labels):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [float(round(c + rng.gauss(0, 0.3), 2)) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("block,pivots", [(2048, 8), (12, 3)])
def test_equals_brute_force(spark, block, pivots):
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in vectors(random.Random(block), 400, 6, 4)]
    assert mined(spark, rows, 20, block=block, pivots=pivots) == brute(rows, 20)


def test_awkward_rows(spark):
    rng, nan, inf = random.Random(3), float("nan"), float("inf")
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)], rng.randrange(3)) for i in range(120)]
    rows += [(0, [1.0, 1.0, 1.0], 1), (0, [1.0, 1.0, 1.0], 1), (0, [2.0, 0.0, 0.0], 2)]  # repeated rows and ids
    rows += [(200 + i, [1.0, 1.0, 1.0], i % 2) for i in range(150)]  # one hot vector
    rows += [(None, [1.0, 1.0, 1.0], 1), (400, None, 1), (420, [1.0, None, 1.0], 1), (440, [nan, 1.0, 1.0], 1), (460, [inf, 1.0, 1.0], 1), (480, [1.0, 1.0, 1.0], None)]
    rows += [(500, [], 1), (520, [1.0], 2), (540, [0.0, 0.0, 0.0], 1), (560, [1e30, 1.0, 1.0], 1), (580, [1.0, 1.0, 1.0, 4.0], 0), (600, [-3.0, -3.0, -3.0], 0)]
    assert mined(spark, rows, 20, pivots=4, block=16) == brute(rows, 20)


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-(2**17), 2**17)) for _ in range(4)], rng.randrange(2)) for i in range(80)]
    assert mined(spark, rows, 4) == brute(rows, 4)


def test_empty_and_no_anchor(spark):
    assert mined(spark, [], 20) == Counter()
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 0)], 20) == Counter()
    assert mined(spark, [(20, [1.0], 0)], 20) == Counter()
