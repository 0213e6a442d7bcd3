"""The metric screen against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fidelis.operators import screen


def vectors(docs):
    counts = [Counter(re.findall(r"\w+", d.lower())) for d in docs]
    n, df = sum(bool(c) for c in counts), Counter(t for c in counts for t in c)
    out = []
    for c in counts:
        v = {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        out.append({t: x / norm for t, x in v.items()})
    return out


def cosine(a, b):
    return sum(x * b.get(t, 0) for t, x in a.items())


def card_by_hand(turns, budget):
    lines, used = [], 0
    for line in [x.strip() for t in turns for x in re.split(r"\r\n|\r|\n", t or "") if x.strip()]:
        if line in lines:
            continue
        used += len(line.split())
        if used > budget:
            break
        lines.append(line)
    return lines


def test_rows_and_maxima(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    say = lambda n: "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(n))
    turns = [(u, t, say(rng.randint(1, 4))) for u in range(12) for t in range(3)] + [(20, 0, None), (20, 1, " \n "), (21, 0, "w1 w1\r\nw2\n w1 w1 ")]
    records = [(u, t, say(2)) for u in [*range(12), 21] for t in (5, 6)] + [(3, 7, None), (3, 8, "?!"), (20, 5, "w1"), (4, 9, turns[12][2])]
    donors = [(u, (u + 1) % 12) for u in range(12)] + [(20, 1), (21, 20)]
    schema = "user long, turn int, text string"
    got = screen.screen_rows(spark.createDataFrame(turns, schema), spark.createDataFrame(records, schema), spark.createDataFrame(donors, "user long, donor long"), "user", ["turn"], "text", ["turn"], screen.word_terms("_text"), budget=14)
    cards = {u: card_by_hand([x for v, _, x in turns if v == u], 14) for u in {t[0] for t in turns}}
    assert cards[20] == [] and cards[21] == ["w1 w1", "w2"]
    asked = [(u, t, x or "", dict(donors)[u]) for u, t, x in records if cards[u] and cards[dict(donors)[u]]]
    people = sorted(u for u in cards if cards[u])
    lines = [(u, x) for u in people for x in cards[u]]
    lv = vectors([x for _, x in lines] + [a[2] for a in asked])
    cv = vectors(["\n".join(cards[u]) for u in people] + [a[2] for a in asked])
    want = {}
    for i, (u, t, _, d) in enumerate(asked):
        near = lambda o: max(cosine(lv[len(lines) + i], v) for (p, _), v in zip(lines, lv) if p == o)  # noqa: B023, E731
        whole = lambda o: cosine(cv[len(people) + i], cv[people.index(o)])  # noqa: B023, E731
        want[u, t] = (near(u), near(d), whole(u), whole(d))
    rows = {(r["user"], r["turn"]): (r["own_line"], r["donor_line"], r["own_card"], r["donor_card"]) for r in got.collect()}
    assert rows.keys() == want.keys() and len(rows) == 27
    for k, v in want.items():
        assert rows[k] == pytest.approx(v, abs=1e-9)
    assert rows[3, 7] == rows[3, 8] == (0, 0, 0, 0) and (20, 5) not in rows and (21, 5) not in rows


def test_choice(spark):
    rng = np.random.default_rng(8)
    rows = []
    for u in range(80):
        for _ in range(3):
            rows.append((u, float(0.30 + rng.normal() * 0.3), 0.1, float(0.2 + rng.normal() * 0.1), 0.1, float(rng.normal()), 0.0))
    df = spark.createDataFrame(rows, "user long, a double, b double, c double, d double, e double, f double")
    got = {r["metric"]: r for r in screen.choose_metric(df, "user", {"wide": ("a", "b"), "firm": ("c", "d"), "noise": ("e", "f")}, 4000).collect()}
    x = np.array(rows)
    for name, (p, q) in {"wide": (1, 2), "firm": (3, 4), "noise": (5, 6)}.items():
        people = (x[:, p] - x[:, q]).reshape(80, 3).mean(1)
        assert got[name]["n_users"] == 80 and got[name]["point"] == pytest.approx(people.mean())
        se = people.std() / math.sqrt(80)
        assert got[name]["se"] == pytest.approx(se, rel=0.08) and got[name]["low"] == pytest.approx(people.mean() - 1.96 * se, abs=0.25 * se) and got[name]["high"] == pytest.approx(people.mean() + 1.96 * se, abs=0.25 * se)
    assert [got[m]["passes"] for m in ("wide", "firm", "noise")] == [True, True, False]
    assert [m for m in got if got[m]["chosen"]] == ["firm"]
    same = spark.createDataFrame([(u, 1.0, 0.5, 0.0, 0.0) for u in range(5)], "user long, a double, b double, c double, d double")
    r = {x["metric"]: x for x in screen.choose_metric(same, "user", {"up": ("a", "b"), "flat": ("c", "d")}, 200).collect()}
    assert r["up"]["z"] == math.inf and r["up"]["chosen"] and r["flat"]["z"] == 0 and not r["flat"]["passes"] and not r["flat"]["chosen"]
    none = screen.choose_metric(same.withColumn("a", same["b"]), "user", {"flat": ("a", "b")}, 200).collect()
    assert [x["chosen"] for x in none] == [False]
