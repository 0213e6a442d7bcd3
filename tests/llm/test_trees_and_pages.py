"""Centroids, prefix trie and main text: contracts, brute force, odd rows, empty tables."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroids", "op12_prefix_trie"])
def test_sql(spark, name):
    from fidelis.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(cur.fetchall(), key=str)


# --- centroids ---


def by_hand(vectors, k=16, rounds=3, dims=64):
    """vec_id, cluster, distance in plain Python."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, z)), j) for j, z in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else z for j, z in enumerate(c)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str)


def test_centroids_odd_rows(spark):
    from fidelis.llm.centroids import cluster

    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.01, -0.0]) for _ in range(64)]) for i in range(60)]
    rows += [(100, rows[0][1])] * 3 + [(200 + i, rows[1][1]) for i in range(40)]
    rows += [(None, rows[2][1]), (7, None), (8, [0.1] * 63), (9, [0.1] * 65), (10, [None] + [0.1] * 63), (11, [float("nan")] + [0.0] * 63), (12, [float("inf")] + [0.0] * 63), (13, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, e int")
    got = cluster(df, block=16).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == by_hand(rows)
    assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
    few = cluster(df.filter("vec_id in (1, 2) or size(embedding) = 63")).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in few) == [(1, 0), (2, 0)]
    assert cluster(df.filter("embedding is null or size(embedding) < 64")).collect() == [] and cluster(df.filter("false")).columns[0] == "vec_id"
    with pytest.raises(Exception, match="beyond"):
        cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_hilbert_is_one_path():
    from fidelis.llm.centroids import hilbert

    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in hilbert(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_keep_the_nearest_and_prune():
    from fidelis.llm.centroids import candidates, nearest

    rng = np.random.default_rng(5)
    kept = []
    for spread in (1, 5, 30, 1 << 23):
        centers = rng.integers(-40, 40, (16, 64)) * max(1, spread // 30)
        for c in centers[:6]:
            x = c + rng.integers(-spread, spread + 1, (50, 64))
            can = candidates(x.min(0), x.max(0), centers)
            at, d = nearest(x, centers)
            assert set(at) <= set(can.tolist())
            assert (d == ((x - centers[at]) ** 2).sum(1)).all()
            at2, d2 = nearest(x, centers[can])
            assert (can[at2] == at).all() and (d2 == d).all()
            kept.append((spread, len(can)))
    assert all(n == 1 for s, n in kept if s == 1)
    twice = np.array([[1, 1], [1, 1], [5, 5]])
    assert candidates(np.array([0, 0]), np.array([2, 2]), twice).tolist() == [0]


def test_clustered_blocks_are_pruned(spark):
    from fidelis.llm.centroids import candidates, integers, ranges, zone_maps

    rng = np.random.default_rng(1)
    centers = rng.normal(size=(8, 64))
    rows = [(i, (centers[i % 8] + rng.normal(size=64) * 0.05).tolist()) for i in range(4000)]
    kept = integers(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 64, 64.0)
    blocks = zone_maps(kept, 64, 64, *ranges(kept, 64)).collect()
    whole = np.floor(centers * 64).astype(np.int64)
    used = [len(candidates(np.array(b["lo"]), np.array(b["hi"]), whole)) for b in blocks]
    assert sum(b["n"] for b in blocks) == 4000 and np.mean(used) < 2.5
    assert sum(map(sum, (b["sums"] for b in blocks))) == sum(map(sum, (r["e"] for r in kept.collect())))


# --- prefix trie ---

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def trie_by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    nodes, children = defaultdict(list), defaultdict(set)
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + v[h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
            if d:
                children[whole[c][: d - 1]].add(whole[c][:d])
    out = []

    def sums(key):
        below = [sums(k) for k in children[key]]
        words = len(WORD.findall(key[-1][1])) if key else 0
        leaves, saved = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(nodes[key]) - 1) * words
        ends = sorted(c for c in nodes[key] if whole[c] == key)
        out.append((min(nodes[key]), len(key), min(nodes[key[:-1]]) if key else None, len(nodes[key]), len(below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if nodes:
        sums(())
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_by_hand(spark, tmp_path):
    from fidelis.llm.prefix_trie import prefix_trie

    rng = random.Random(11)
    rows = []
    for c in [*range(-25, 90), 400, 5001, 5002]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d\te f", "ä ö"])))
    rows += [(7, None, "user", "first"), (8, 0, "user", "tied"), (8, 0, "user", "tied"), (8, 0, "user", "other"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(4)]
    rows += [(3000, t, "user", f"long {t % 7}") for t in range(700)] + [(3001, t, "user", f"long {t % 7}") for t in range(650)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, name string")
    want = trie_by_hand(rows)
    got = prefix_trie(df)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    # short ranges, many of them, and a tour that is spliced in rounds
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = prefix_trie(df.repartition(5), alone=10, per_task=40)
        assert sorted((tuple(r) for r in again.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert prefix_trie(df.filter("false")).collect() == [] and prefix_trie(df.filter("conv_id is null")).collect() == []


def test_ends_in_pieces(spark):
    from fidelis.llm.prefix_trie import ROOT, digests_of_ends

    ids = random.Random(2).sample(range(-5000, 5000), 3000)
    df = spark.createDataFrame([(bytearray(ROOT), 1, c, True) for c in ids] + [(bytearray(ROOT), 2, 5, True), (bytearray(ROOT), 1, 9999, False)], "name binary, depth long, conv long, ends boolean")
    got = {r["depth"]: r["ends_sha256"] for r in digests_of_ends(df, piece=7).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 2: hashlib.sha256(b"5").hexdigest()}


# --- main text ---

PROSE = "The cat and the dog sat on the mat with all of their friends, and it was not the first time that they had done so in the house."
MORE = "When the rain came they went into the hall, where it was warm, and they were there for the rest of the day and for most of the night."
PAGES = [
    (f"<article><h1>Title &amp; more</h1><p>{PROSE}<p>Short.</p><p>{MORE}</article><footer>&copy; x</footer>", f"Title & more\n{PROSE}\nShort.\n{MORE}"),
    (f"<body><div id=top class='site-header'><p>{PROSE}</div><div><h2>Head</h2>{PROSE}<br><br>{MORE}<br>tail</div><div class=sidebar>{PROSE}</div>", f"Head\n{PROSE}\n{MORE} tail"),
    (f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{PROSE}</p><p>Yes.</p><p>{MORE}</p><ul><li><a href=3>Three</a></ul>", f"{PROSE}\nYes.\n{MORE}"),
    (f"<script>var a = '<p>{PROSE}</p>';</script><style>p {{}}</style><!-- <p>{PROSE}</p> --><p>{PROSE} a &lt; b &#233;&nbsp; x</p><noscript>{PROSE}</noscript>", f"{PROSE} a < b é x"),
    (f"<main><p>{PROSE}</p><div class=ad>{MORE}</div><p>Ok.</p></main><section id=comments><article class=comment><p>{MORE}</p></article></section>", f"{PROSE}\nOk."),
    (f"<form id=all><nav>Go<p>{PROSE}</nav><article>{MORE}<form><label>{PROSE}</label><button>Send</button></form></article></form>", MORE),
    (f"<p>Viele Wörter ohne Ende</p><article><header><h1>T</h1><p>By me</p></header><p>{PROSE}</p><p hidden>{MORE}</p></article>", f"T\n{PROSE}"),
    ("<table><tr><td>alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi</table>", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
    ("<nav><a href=/>Home</a></nav>", ""),
    ("", ""),
    (None, ""),
    ("just words", "just words"),
    ("<", "<"),
    ('<p title="a > b">x<y</p', "x"),
]


def test_main_text(spark):
    from fidelis.llm.html_text import extract

    rows = [(i, page, "clash") for i, (page, _) in enumerate(PAGES)] + [(0, PAGES[0][0], None)]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == PAGES[r["row"]["page_id"]][1], PAGES[r["row"]["page_id"]][0]
    assert extract(spark.createDataFrame([], "html string")).collect() == []


def test_main_text_of_given_pages(spark):
    """Against the article elements of the pages, cut out by patterns."""
    from fidelis.llm.queries import QUERIES

    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    rows = QUERIES["op13_html_text"](spark, SF).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        inner = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]]["html"])[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_long_page():
    import time

    from fidelis.llm.html_text import main_text

    began = time.perf_counter()
    assert main_text(f"<article>{'<div><p>' * 3000}{PROSE}") == PROSE
    assert len(main_text("<article>" + f"<p>{PROSE}" * 20000).split("\n")) == 20000
    assert main_text("<p " * 20000 + "'" + "<p>" * 20000) == ""
    assert time.perf_counter() - began < 30
