"""Score files against NumPy's own reader."""

import numpy as np
import pytest

from fidelis.operators import readouts
from fidelis.sources import arrays


def save(path, n=57, options=4, seed=0, arms=("A0", "A4", "A4f"), packed=True, **more):
    rng = np.random.default_rng(seed)
    data = {
        "players": np.array([f"pläyer{rng.integers(0, 6)}" for _ in range(n)]),
        "t": np.arange(n, dtype=np.int32),
        "labels": rng.integers(0, options, n),
        "label_set": np.array([f"o{i}" for i in range(options)]),
        "option_token_lens": rng.integers(1, 5, options),
        **{f"logp_{a}": rng.normal(size=(n, options)).astype(np.float32) for a in arms},
        **more,
    }
    (np.savez_compressed if packed else np.savez)(path, **data)
    return data


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("per", [7, 1000])
def test_rows(spark, tmp_path, packed, per):
    files = {"a": save(tmp_path / "a.npz", packed=packed), "b": save(tmp_path / "b.npz", 20, 3, 1, ("A3",), packed, option_token_lens=np.ones((20, 3), dtype=np.int64), logp_A3=np.asfortranarray(np.arange(60.0).reshape(20, 3)))}
    df = arrays.option_arrays(spark, str(tmp_path), rows=per)
    if per == 7:
        assert df.rdd.getNumPartitions() == 9 + 3
    got = df.collect()
    assert len(got) == (57 + 20) * 4
    for r in got:
        d = files[r["cell"]]
        i = r["row"]
        assert (r["player"], r["t"], r["label_idx"], r["n_options"]) == (d["players"][i], d["t"][i], d["labels"][i], len(d["label_set"]))
        key = f"logp_{r['arm']}"
        assert r["logp"] == (d[key][i].astype(float).tolist() if key in d else None)
        assert r["token_lens"] == (d["option_token_lens"] if r["cell"] == "a" else d["option_token_lens"][i]).tolist()


def test_totals_from_files(spark, tmp_path):
    """The readout of options fed from a file."""
    d = save(tmp_path / "x.npz", 300, 3, 2, ("A0", "A4"))
    df = arrays.option_arrays(spark, str(tmp_path / "x.npz"), arms="A0,A3,A4").filter("logp is not null")
    got = {(r["player"], r["arm"], r["label"]): r for r in readouts.option_user_totals(df).collect()}
    for arm in ("A0", "A4"):
        z = d[f"logp_{arm}"].astype(float)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for u in set(d["players"]):
            mine = d["players"] == u
            for label in range(3):
                r = got[u, arm, label]
                assert (r["n"], r["hits"], r["n_label"]) == (mine.sum(), (z[mine].argmax(1) == d["labels"][mine]).sum(), (d["labels"][mine] == label).sum())
                assert r["p_sum"] == pytest.approx(p[mine, label].sum())
    gains = {r["metric"]: r["point"] for r in readouts.pooled_gains(readouts.option_user_totals(df), "A4", "A0", n_resamples=50).collect()}
    hits = [(d[f"logp_{a}"].argmax(1) == d["labels"]).mean() for a in ("A0", "A4")]
    assert gains["accuracy"] == pytest.approx(hits[1] - hits[0])


def test_broken_files(tmp_path):
    read = lambda p: [b for x in arrays.ArrayReader({"path": str(p)}).partitions() for b in arrays.ArrayReader({"path": str(p)}).read(x)]
    save(tmp_path / "short.npz", t=np.arange(56))
    with pytest.raises(ValueError, match="differ in length"):
        read(tmp_path / "short.npz")
    save(tmp_path / "far.npz", labels=np.full(57, 4))
    with pytest.raises(ValueError, match="beyond"):
        read(tmp_path / "far.npz")
    save(tmp_path / "pickled.npz", players=np.array(["a"] * 57, dtype=object))
    with pytest.raises(ValueError, match="pickled"):
        read(tmp_path / "pickled.npz")
    save(tmp_path / "none.npz", 0)
    assert read(tmp_path / "none.npz") == []
