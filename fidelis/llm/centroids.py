"""Exact integer clustering around centroids, with zone maps along a space-filling curve.

Vectors become integers floor(scale * x). They are put in the order of a Hilbert curve over all dimensions (dimensions of
the widest range first, four bits each), in ranges that a hash of the id splits further, so that any number of equal vectors
spreads over tasks. Each run of `block` neighbours becomes one row of a table in the shared folder: the vectors as bytes, and
its zone map: the smallest and largest value in each dimension, the count and the sums.

A round reads that table. What a block can hold follows from its box: a centroid stays a candidate if its least distance to
the box is not above the smallest of the largest distances, and if somewhere in the box it can be as near as the centroid of
that smallest one. A block with one candidate adds its sums as they are; in others every vector is compared with the block's
candidates, in integers, so bounds decide how much is compared and never what comes out. Sums leave a task as one row per
centroid. The driver holds centroids (`k` times the dimensions) and nothing that grows with the vectors.

Vectors are left out if null, of another length, or with a component that is null, NaN or infinite. Fewer kept vectors than k
give as many centroids as there are vectors; none give no rows. Repeated rows are vectors of their own; equal first hashes are
ordered by components. A null id is hashed as the empty text. A component beyond 2**27 after scaling is an error: its squares
would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import materialize, table

LARGEST = 1 << 27
BITS = 4
#: Below this size sums of squared differences of 64 components are exact in doubles.
SMALL = 1 << 22


def integers(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """id, e: kept vectors as integers."""
    v = F.col("_v")
    far = F.exists(v, lambda x: F.abs(x * scale) > LARGEST)
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    kept = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{vec_col}`"].cast("array<double>").alias("_v")).filter(F.coalesce(kept, F.lit(False)))
    return rows.select("id", F.when(far, F.raise_error(F.lit(f"a component beyond {LARGEST}"))).otherwise(whole).alias("e"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of the smallest hashes, in that order."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return [list(r["e"]) for r in rows.select(F.sha2(named, 256).alias("h"), "e").orderBy("h", "e").limit(k).collect()]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def ranges(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = None, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), dims)
                lo = x.min(0) if lo is None else np.minimum(lo, x.min(0))
                hi = x.max(0) if hi is None else np.maximum(hi, x.max(0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(lo), pa.array(hi)], names=["j", "lo", "hi"])

    found = rows.select("e").mapInArrow(run, "j int, lo long, hi long").groupBy("j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("j").collect()
    return np.array([r["lo"] for r in found], dtype=np.int64), np.array([r["hi"] for r in found], dtype=np.int64)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each row of cell numbers (0 to 2**bits - 1) on the Hilbert curve, as bytes whose order is the curve's.

    Works on all rows at once: each step undoes one reflection or exchange of axes, from the highest bit down."""
    x = x.astype(np.uint16).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint16(1 << level), np.uint16((1 << level) - 1)
        for i in range(n):
            turned = (x[:, i] & bit) != 0
            swap = np.where(turned, np.uint16(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    flip = np.zeros(len(x), dtype=np.uint16)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> np.uint16(level)) & 1, np.uint16((1 << level) - 1), np.uint16(0)).astype(np.uint16)
    x ^= flip[:, None]
    planes = [(x >> np.uint16(level)) & 1 for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def curve_key(lo: np.ndarray, hi: np.ndarray) -> Column:
    """Position of column e on the curve over the ranges lo to hi."""
    order = np.argsort(lo - hi, kind="stable")
    least, width = lo[order], np.maximum(hi - lo + 1, 1)[order]

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        cells = ((matrix(column, len(order))[:, order] - least) << BITS) // width
        return pa.array([k.tobytes() for k in hilbert(cells)], type=pa.binary())

    return run("e")


def zone_maps(rows: DataFrame, dims: int, block: int, lo: np.ndarray, hi: np.ndarray) -> DataFrame:
    """One row per block of neighbours on the curve: ids, vectors (int32 bytes), lo, hi, n, sums."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        schema = None

        def cut(t: pa.Table) -> pa.RecordBatch:
            x = matrix(t.column("e").combine_chunks(), dims)
            ids = t.column("id").combine_chunks()
            one = [pa.ListArray.from_arrays(pa.array([0, len(ids)], type=pa.int32()), ids), pa.array([x.astype("<i4").tobytes()], type=pa.binary())]
            one += [pa.array([list(map(int, y))], type=pa.list_(pa.int64())) for y in (x.min(0), x.max(0), x.sum(0))]
            return pa.RecordBatch.from_arrays([*one, pa.array([len(x)], type=pa.int64())], names=["ids", "vectors", "lo", "hi", "sums", "n"])

        for b in batches:
            schema = b.schema
            t = pa.Table.from_batches([b], schema)
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= block:
                yield cut(held.slice(0, block))
                held = held.slice(block)
        if held is not None and held.num_rows:
            yield cut(held)

    salt = F.xxhash64(F.col("id").cast("string"))
    dealt = rows.select("id", "e", curve_key(lo, hi).alias("key"), salt.alias("salt")).repartitionByRange("key", "salt").sortWithinPartitions("key", "salt")
    cells = dealt.select("id", "e").mapInArrow(run, f"ids array<{kind}>, vectors binary, lo array<long>, hi array<long>, sums array<long>, n long")
    return materialize(cells, "zone-maps")


def candidates(lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centroids that can be nearest (with ties to the smaller number) to a point of the box."""
    below, above = lo - c, c - hi
    gap = np.maximum(np.maximum(below, above), 0)
    least = (gap * gap).sum(1)
    reach = np.maximum(np.abs(below), np.abs(above))
    most = (reach * reach).sum(1)
    pivot = int(most.argmin())
    # distance to c less distance to the pivot is linear over the box: its least value takes one end in every dimension
    apart = c - c[pivot]
    ends = np.minimum(-2 * apart * lo, -2 * apart * hi).sum(1) + (c * c).sum(1) - (c[pivot] * c[pivot]).sum()
    number = np.arange(len(c))
    kept = (least <= most[pivot]) & ((ends < 0) | ((ends == 0) & (number < pivot)))
    kept[pivot] = True
    return number[kept]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of c nearest to each row of x (ties: the first), and the squared distance."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < SMALL and x.shape[1] <= 64:
        y, z = x.astype(np.float64), c.astype(np.float64)
        d = (y * y).sum(1)[:, None] - 2 * (y @ z.T) + (z * z).sum(1)
        d = d.astype(np.int64)
    else:
        d = np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _vectors(row: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(row, dtype="<i4").reshape(-1, dims).astype(np.int64)


def gathered(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The next centroids: floors of the means of what is nearest to each; a centroid without vectors stays."""
    c = np.array(centroids, dtype=np.int64)
    k, dims = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            for row, lo, hi, total, n in zip(b["vectors"], matrix(b["lo"], dims), matrix(b["hi"], dims), matrix(b["sums"], dims), b["n"].to_pylist(), strict=True):
                can = candidates(lo, hi, c)
                if len(can) == 1:
                    sums[can[0]] += total
                    counts[can[0]] += n
                    continue
                x = _vectors(row.as_py(), dims)
                at, _ = nearest(x, c[can])
                for i in np.unique(at):
                    sums[can[i]] += x[at == i].sum(0)
                    counts[can[i]] += int((at == i).sum())
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(counts[has]), pa.array([list(map(int, s)) for s in sums[has]], type=pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = blocks.select("vectors", "lo", "hi", "sums", "n").mapInArrow(run, "cluster int, n long, sums array<long>")
    added = parts.select("cluster", "n", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = [list(row) for row in centroids]
    for r in added:
        out[r["cluster"]][r["j"]] = r["s"] // r["n"]
    return out


def assigned(blocks: DataFrame, centroids: list[list[int]], id_kind: str) -> DataFrame:
    """id, cluster, distance of every vector."""
    c = np.array(centroids, dtype=np.int64)
    dims = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, row, lo, hi in zip(b["ids"], b["vectors"], matrix(b["lo"], dims), matrix(b["hi"], dims), strict=True):
                can = candidates(lo, hi, c)
                at, d = nearest(_vectors(row.as_py(), dims), c[can])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(can[at].astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

    return blocks.select("ids", "vectors", "lo", "hi").mapInArrow(run, f"id {id_kind}, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, block: int = 256) -> DataFrame:
    """Rows of assignments: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = integers(vectors, id_col, vec_col, dims, scale)
    kind = dict(rows.dtypes)["id"]
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).filter(F.lit(False))
    blocks = zone_maps(rows, dims, block, *ranges(rows, dims))
    for _ in range(rounds):
        centroids = gathered(blocks, centroids)
    out = materialize(assigned(blocks, centroids, kind), "assigned")
    inertia = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    per = F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))])
    said = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    return out.select(F.col("id").alias(id_col), "cluster", "distance", F.get(per, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(said, F.col("cluster")).alias("centroid_sha256"))


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256(concat('1:', CAST(vec_id AS VARCHAR))) AS h, e FROM v ORDER BY h, e LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT v.r, v.vec_id, v.e, c.c, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i} AS c)")
        steps.append(f"a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i}) GROUP BY c, j)")
            steps.append(f"c{i + 1} AS (SELECT c{i}.c, coalesce(m.e, c{i}.e) AS e FROM c{i} LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY j) AS e FROM s{i} GROUP BY c) AS m USING (c))")
    last = f"SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS c USING (c)"
    return f"WITH {', '.join(steps)} {last}"


OP11_SQL = _sql()
