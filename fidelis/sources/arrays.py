"""Per-option score files as a data source: spark.read.format("option_arrays").load(path).

A file is a NumPy archive (.npz, stored or deflated) with arrays of one length: players, t, labels (place of the true option), and for
each scored arm logp_<arm> of shape (rows, options); label_set names the options, option_token_lens counts their tokens (per option,
or per row and option). The driver reads only the directory and the headers of the members; a task reads a range of rows of every
member, in a stored file by seeking, in a deflated one by passing over what comes before.

One row per record and arm of option `arms` (A0,A3,A4,A4f); an arm that a file lacks gives a null logp. Columns: cell (name of the
file), row, player, t, label_idx, arm, logp, token_lens, n_options. Arrays of different lengths, labels beyond the options and arrays
of pickled objects are errors (pickles run code when they are read)."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fidelis.sources.archives import _system, files

SCHEMA = "cell string, row long, player string, t long, label_idx int, arm string, logp array<double>, token_lens array<long>, n_options int"
ARMS = "A0,A3,A4,A4f"
TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int32()]


class Members:
    """Arrays of one archive, by ranges of rows."""

    def __init__(self, path: str):
        system, inner = _system(path)
        self.path, self.zip = path, zipfile.ZipFile(system.open_input_file(inner))
        self.heads = {n[:-4]: self._head(n) for n in self.zip.namelist() if n.endswith(".npy")}

    def _head(self, name: str) -> tuple[tuple[int, ...], bool, np.dtype, int]:
        with self.zip.open(name) as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
            if kind.hasobject:
                raise ValueError(f"{self.path}: {name} holds pickled objects")
            return shape, fortran, kind, f.tell()

    def __contains__(self, name: str) -> bool:
        return name in self.heads

    def rows(self, name: str, a: int = 0, b: int | None = None) -> np.ndarray:
        shape, fortran, kind, start = self.heads[name]
        n = shape[0] if shape else 1
        b = n if b is None else b
        with self.zip.open(f"{name}.npy") as f:
            if fortran and len(shape) > 1:  # columns one after another: the whole is read
                f.read(start)
                return np.frombuffer(f.read(), kind).reshape(shape[::-1]).T[a:b]
            each = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
            f.seek(start + a * each)
            return np.frombuffer(f.read((b - a) * each), kind).reshape(b - a, *shape[1:])


class Rows(InputPartition):
    def __init__(self, path: str, a: int, b: int):
        self.path, self.a, self.b = path, a, b


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.per, self.arms = options.get("path", ""), int(options.get("rows", "100000")), options.get("arms", ARMS).split(",")

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path, _ in files(self.path):
            if path.endswith(".npz"):
                m = Members(path)
                n = m.heads["labels"][0][0]
                wrong = [k for k, h in m.heads.items() if (k in ("players", "t", "labels") or k.startswith("logp_")) and h[0][:1] != (n,)]
                if wrong:
                    raise ValueError(f"{path}: {', '.join(sorted(wrong))} and labels differ in length")
                parts += [Rows(path, a, min(n, a + self.per)) for a in range(0, n, self.per)]
        return parts or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        m = Members(part.path)
        cell = part.path.rsplit("/", 1)[-1][: -len(".npz")]
        options = m.heads["label_set"][0][0]
        step = max(1, 200_000 // max(1, options * len(self.arms)))
        for a in range(part.a, part.b, step):
            b = min(part.b, a + step)
            labels = m.rows("labels", a, b).astype(np.int64)
            if labels.size and (labels.min() < 0 or labels.max() >= options):
                raise ValueError(f"{part.path}: a label beyond its {options} options")
            players, t = [str(p) for p in m.rows("players", a, b)], m.rows("t", a, b).astype(np.int64).tolist()
            lens = [None] * (b - a)
            if "option_token_lens" in m:
                shape = m.heads["option_token_lens"][0]
                lens = m.rows("option_token_lens", a, b).astype(np.int64).tolist() if len(shape) > 1 else [m.rows("option_token_lens").astype(np.int64).tolist()] * (b - a)
            for arm in self.arms:
                logp = m.rows(f"logp_{arm}", a, b).astype(np.float64).tolist() if f"logp_{arm}" in m else [None] * (b - a)
                columns = [[cell] * (b - a), list(range(a, b)), players, t, labels.tolist(), [arm] * (b - a), logp, lens, [options] * (b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, TYPES)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class OptionArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "option_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


def option_arrays(spark: SparkSession, path: str, arms: str = ARMS, rows: int = 100_000) -> DataFrame:
    spark.dataSource.register(OptionArrays)
    return spark.read.format("option_arrays").option("arms", arms).option("rows", rows).load(path)
