"""The hardest look-alike of a cell against all of them."""

import math
import random

import pytest

from fidelis.operators import arms


@pytest.mark.parametrize("per_block, per_part", [(512, 100_000), (4, 10)])
def test_hardest_donors(spark, per_block, per_part):
    """Users with equal counts, users alone with theirs and users alone in their cell; users, not pairs, are made into rows."""
    rng = random.Random(6)
    people = {u: (rng.randrange(3) if u < 150 else 9, [rng.randrange(4) for _ in range(3)], [rng.randrange(3) for _ in range(3)]) for u in range(151)}
    counts = spark.createDataFrame([(u, c, h) for u, (_, c, h) in people.items()], "user_id long, c array<long>, h array<long>")
    cells = spark.createDataFrame([(u, x[0]) for u, x in people.items()], "user_id long, cell long")
    made = arms.hardest_donors(counts, cells, 3, per_block=per_block, per_part=per_part)
    got = {r["user_id"]: (r["own"], r["hardest"]) for r in made.collect()}
    loss = lambda h, c: -sum(n * math.log((x + 1) / (sum(c) + 3)) for n, x in zip(h, c, strict=True)) / sum(h)
    assert got.keys() == {u for u, (_, _, h) in people.items() if sum(h)}
    for u, (own, hardest) in got.items():
        cell, c, h = people[u]
        others = [loss(h, d) for v, (x, d, _) in people.items() if x == cell and v != u]
        assert own == pytest.approx(loss(h, c)) and (hardest == pytest.approx(min(others)) if others else hardest is None)


def test_hardest_donor_makes_no_pairs(spark, sf, monkeypatch):
    from fidelis.plans import judged, trial

    monkeypatch.setattr(trial, "cross_scores", None)
    assert trial.hardest_donor(spark, sf).count() and judged.matcher_differences(spark, sf).count()
