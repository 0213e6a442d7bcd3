"""Archives: every compression and every cut gives the rows of the plain text."""

import gzip
import io
import random
import struct
import zlib

import pytest

from fidelis import cli
from fidelis.sources import archives, readers

zstandard = pytest.importorskip("zstandard")


def games(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        control = rng.choice(["180+0", "60+0", "600+5", "-", "180+2"])
        moves = " ".join(f"{k + 1}. e4 {{ [%clk 0:0{rng.randint(1, 5)}:{rng.randint(10, 59)}] }} e5 {{ [%clk 0:02:{rng.randint(10, 59)}] }}" for k in range(rng.randint(0, 12)))
        text = f'[Event "Rated {i}"]\n[White "p{i % 7}"]\n[Black "ü{i % 5}"]\n[Result "1-0"]\n[WhiteElo "15{i % 90:02}"]\n[UTCDate "2021.06.0{1 + i % 9}"]\n[UTCTime "0{i % 10}:10:00"]\n[TimeControl "{control}"]\n\n{moves} 1-0\n\n'
        out.append(text)
    return out


def frames(pieces, **kind):
    return b"".join(zstandard.ZstdCompressor(level=3, **kind).compress(p) for p in pieces)


def cuts(text, seed, size):
    rng, out, at = random.Random(seed), [], 0
    while at < len(text):
        n = rng.randint(1, 2 * size)
        out.append(text[at : at + n])
        at += n
    return out


def bgzf(pieces):
    out = b""
    for p in pieces:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(p) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(p), len(p))
    return out


def blocks(path, size, whole=False):
    """Records of all ranges, without Spark."""
    reader = archives.ArchiveReader({"path": str(path), "bytes": str(size), "whole": str(whole)})
    parts = reader.partitions()
    got = [[r for b in reader.read(p) for r in b.column("block").to_pylist()] for p in parts]
    return [r for g in got for r in g], sum(bool(g) for g in got)


@pytest.mark.parametrize("kind", ["plain", "zstd", "zstd checksum", "skippable", "bgzf", "gzip", "one frame"])
@pytest.mark.parametrize("size", [97, 700, 5000, 1 << 26])
def test_ranges(tmp_path, kind, size):
    want = games(60)
    text = "".join(want).encode()
    for seed in range(3):
        pieces = cuts(text, seed, 400)
        data = {
            "plain": lambda: text,
            "zstd": lambda: frames(pieces),  # noqa: B023
            "zstd checksum": lambda: frames(pieces, write_checksum=True, write_content_size=False),  # noqa: B023
            "skippable": lambda: b"".join(b"\x53\x2a\x4d\x18" + struct.pack("<I", 7) + b"\x28\xb5\x2f\xfdxyz" + frames([p]) for p in pieces),  # noqa: B023
            "bgzf": lambda: bgzf(pieces) + bgzf([b""]),  # noqa: B023
            "gzip": lambda: b"".join(gzip.compress(p) for p in pieces[:3]) + gzip.compress(b"".join(pieces[3:])),  # noqa: B023
            "one frame": lambda: frames([text]),
        }[kind]()
        path = tmp_path / f"{seed}.any"
        path.write_bytes(data)
        got, used = blocks(path, size)
        assert [g.strip() for g in got] == [w.strip() for w in want]
        if kind not in ("gzip", "one frame") and size < 1000:
            assert used > 3
        if kind in ("gzip", "one frame"):
            assert used == 1


def test_cut_exactly_at_records(tmp_path):
    want = games(20)
    for shift in (-2, -1, 0, 1, 7, 8, 9):
        text = "".join(want).encode()
        at, pieces = 0, []
        for w in want[:-1]:
            n = at + len(w.encode())
            pieces.append(text[at + (shift if at else 0) : n + shift])
            at = n
        pieces.append(text[at + shift :])
        path = tmp_path / f"{shift}.zst"
        path.write_bytes(frames(pieces))
        for size in (50, 300):
            assert [g.strip() for g in blocks(path, size)[0]] == [w.strip() for w in want]


def test_magic_inside_a_frame_is_no_start(tmp_path):
    """Stored (incompressible) data that holds the first bytes of a frame."""
    rng = random.Random(1)
    noise = "".join(chr(rng.choice([40, 181, 47, 253]) if rng.random() < 0.5 else rng.randint(1, 255)) for _ in range(2000)).encode("latin-1") + archives.ZSTD * 50
    raw = games(1)[0].encode() + noise + b"\n" + games(3, 5)[2].encode()
    path = tmp_path / "m.zst"
    path.write_bytes(zstandard.ZstdCompressor(level=-5).compress(raw))
    one, _ = blocks(path, 1 << 20)
    assert len(one) == 2 and blocks(path, 64)[0] == one


def test_broken_ends(tmp_path):
    want = games(30)
    text = "".join(want).encode()
    data = frames(cuts(text, 4, 600))
    short = tmp_path / "short.zst"
    short.write_bytes(data[:-40])
    got, _ = blocks(short, 300)
    assert [g.strip() for g in got[:-1]] == [w.strip() for w in want[: len(got) - 1]] and len(got) >= 28 and want[len(got) - 1].startswith(got[-1][:20])
    with pytest.raises(EOFError, match="ends early"):
        blocks(short, 300, whole=True)
    plain = tmp_path / "short.pgn"
    plain.write_bytes(text[:-25])
    got, _ = blocks(plain, 300)
    assert len(got) == 30 and got[-1] == want[-1][:-25]
    bad = tmp_path / "bad.zst"
    sound = frames(cuts(text, 4, 600), write_checksum=True)
    bad.write_bytes(sound[: len(sound) // 2] + bytes([sound[len(sound) // 2] ^ 255]) + sound[len(sound) // 2 + 1 :])
    with pytest.raises(zstandard.ZstdError):
        blocks(bad, 1 << 20)
    empty = tmp_path / "empty.pgn"
    empty.write_bytes(b"")
    assert blocks(empty, 100)[0] == []
    with pytest.raises(FileNotFoundError):
        blocks(tmp_path / "none.pgn", 100)


def test_source(spark, tmp_path):
    want = games(200)
    text = "".join(want).encode()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pgn.zst").write_bytes(frames(cuts(text, 1, 2000)))
    plain = tmp_path / "y.pgn"
    plain.write_bytes(text)
    df = archives.archive_games(spark, str(tmp_path / "a"), size="2k")
    assert df.rdd.getNumPartitions() > 3
    strip = lambda rows: sorted(r["block"].strip() for r in rows)
    assert strip(df.collect()) == strip(readers.pgn_games(spark, str(plain)).collect())
    columns = ["white", "black", "result", "white_elo", "speed", "base", "inc", "utc_start"]
    assert sorted(map(str, readers.game_headers(df.select("block")).select(*columns).collect())) == sorted(map(str, readers.game_headers(readers.pgn_games(spark, str(plain))).select(*columns).collect()))
    assert {(r["speed"], r["s"]) for r in readers.game_headers(df.select("block", "file").withColumnRenamed("file", "f")).selectExpr("speed", "speed s").collect()} == {(r["speed"],) * 2 for r in df.select("speed").distinct().collect()}
    few = archives.archive_games(spark, f"{tmp_path}/a/*.zst,{plain}", speed="blitz", players=["p3", "ü1"], size="4k").collect()
    assert few and all(r["speed"] == "blitz" and (r["White"] == "p3" or r["Black"] == "ü1") for r in few)
    assert len(few) == 2 * sum('"180+' in w and ('"p3"' in w or '"ü1"' in w) for w in want)


def test_filters_reach_the_reader(spark, tmp_path):
    path = tmp_path / "x.zst"
    path.write_bytes(frames(cuts("".join(games(100)).encode(), 1, 2000)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = archives.archive_games(spark, str(path)).filter("speed = 'blitz' and White in ('p1', 'p2') and length(block) > 10")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "length(block" in plan and "blitz" not in plan and "p1" not in plan  # Spark is left with what the reader cannot do
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert len(got) == len(archives.archive_games(spark, str(path)).filter("speed = 'blitz' and White in ('p1', 'p2')").collect()) > 0


def test_ingest_from_zstd(spark, tmp_path):
    lines = []
    for i in range(12):
        lines.append(f'[Event "x"]\n[White "ann"]\n[Black "bob{i}"]\n[Result "1-0"]\n[UTCDate "2021.06.{i + 1:02}"]\n[UTCTime "10:00:00"]\n[TimeControl "180+0"]\n\n1. e4 {{ [%clk 0:02:58] }} e5 {{ [%clk 0:02:57] }} 2. d4 {{ [%clk 0:02:50] }} 1-0\n\n')
    path = tmp_path / "g.pgn.zst"
    path.write_bytes(frames(cuts("".join(lines).encode(), 2, 300)))
    facts = cli.ingest(spark, str(path), str(tmp_path / "out"), min_games=5, min_sessions=3)
    assert facts["players"] == 1 and facts["decisions"] == 24
