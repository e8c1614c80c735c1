"""Post-processing, generated sources and stream state on small tables."""

import math

import pandas as pd
import pytest

from basinflow.operators import post
from basinflow.streaming.flood import cells, closed_bands


class State:
    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_closed_bands():
    state = State()
    feed = lambda *rows: [tuple(r) for t in closed_bands(("k",), iter([pd.DataFrame(rows, columns=["rank", "energy"])]), state) for r in t.itertuples(index=False)]
    assert feed((1, 0.0), (2, 0.0), (3, 1.0)) == [("k", 0.0, 1, 2)] and state.value == (1.0, 3, 1)
    assert feed((5, 2.0), (4, 1.0)) == [("k", 1.0, 3, 2)]
    with pytest.raises(ValueError):
        feed((6, 1.5))
    assert feed((7, 2.0), (8, None)) == [("k", 2.0, 5, 2)]
    with pytest.raises(ValueError):
        feed((9, 3.0))


def test_cells(spark):
    rows = spark.createDataFrame([("a", "2024-01-07 05:00:00"), ("a", "2024-01-07 05:59:00"), ("b", "2024-01-08 00:00:00")], "event_type string, ts string").selectExpr("event_type", "cast(ts AS timestamp) AS ts")
    assert {tuple(r) for r in cells(rows).collect()} == {("a", 0, 5, 2), ("b", 1, 0, 1)}


def test_cross_rates(spark):
    minima = spark.createDataFrame([("1", 1, "..*"), ("1", 2, ".."), ("1", 3, "()")], "landscape_id string, lmin long, structure string")
    order = post.reordered(minima)
    assert {r["lmin"]: r["new_id"] for r in order.collect()} == {2: 1, 3: 2, 1: 3}
    rates = spark.createDataFrame([("1", 2, 1, 1.0), ("1", 1, 2, 1.0), ("1", 2, 3, 5.0)], "landscape_id string, i long, j long, rate double")
    got = {(r["i"], r["j"]): r["rate"] for r in post.cross_rates(rates, order, association=10.0, concentration=2.0, binding_energy=-1.0).collect()}
    assert got[1, 3] == 20.0 and got[1, 2] == 5.0 and math.isclose(got[3, 1], 10.0 * math.exp(1.0 / (0.00198717 * 310.15)))


def test_mapped_trees(spark):
    schema = "landscape_id string, lmin long, structure string"
    first = spark.createDataFrame([("1", 1, "((..))"), ("1", 2, "(....)")], schema)
    second = spark.createDataFrame([("1", 1, "(....)"), ("1", 2, "......")], schema)
    assert {(r["source"], r["target"], r["distance"], r["exact"]) for r in post.mapped_trees(first, second).collect()} == {(1, 1, 1, False), (2, 1, 0, True)}


def test_nearest_strings(spark):
    """Parts that agree find the nearest string, also where nothing near agrees; against all pairs."""
    import random

    from basinflow.functions import rna

    rng = random.Random(5)
    text = lambda: "".join(rng.choice("+-") for _ in range(12))
    a, b = [(str(k % 2), k, text()) for k in range(40)], [(str(k % 2), k, text()) for k in range(60)]
    a += [("2", 100, "+" * 12)]
    b += [("2", 100, "-" * 12), ("2", 101, "-" * 12)]
    schema = "landscape_id string, lmin long, structure string"
    got = {(r["landscape_id"], r["source"]): (r["target"], r["distance"], r["exact"]) for r in post.mapped_trees(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), rna.hamming, 1).collect()}
    want = {}
    for n, k, s in a:
        d, target = min((sum(x != y for x, y in zip(s, t)), j) for m, j, t in b if m == n)
        want[n, k] = (target, d, d == 0)
    assert got == want


def test_leaf_order_and_dense_rows(spark):
    tree = spark.createDataFrame([("1", 1, 0, 9.0), ("1", 2, 1, 3.0), ("1", 3, 2, 2.0), ("1", 4, 1, 1.0)], "landscape_id string, lmin long, father long, e_saddle double")
    assert [r["lmin"] for r in post.leaf_order(tree).orderBy("place").collect()] == [1, 4, 2, 3]
    rates = spark.createDataFrame([("1", 1, 2, 0.5)], "landscape_id string, i long, j long, rate double")
    assert post.incidence(rates, 3).first()["row"] == [0.0, 0.5, 0.0]
