"""Jaccard self-join of word shingles by chosen paths.

Texts with equal shingle sets form one class. Each class has 64 min-hashes, its tokens. A run splits
all classes on sampled tokens: a class goes to one bucket per sampled token, named by its value there.
Buckets of at most ``limit`` classes are compared by brute force; larger ones are split again on
tokens of their own, unless their mean similarity is high; those and what is still large at ``depth``
are compared in pairs of blocks of about 16 * ``limit`` classes, so nothing is left out. Runs are
repeated until a pair at the threshold is met with probability ``recall``. A pair is compared only in
the first bucket its two classes share. Pairs that the min-hashes support are then verified on the
shingles of the whole texts; only classes that have such a pair are read again.

Words are runs without ASCII white space, in lower case; a text of one to four words has one shingle.

Defined cases: null is the empty text; texts without words are one class; rows that repeat id and text
count as copies of each other; the class id is the smallest non-null id of the connected documents;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import id_keys, materialize, packed_row, table, text_of

TOKENS = 64
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(11)
_MUL = (_rng.integers(0, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_PLACE = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, r, np.uint64)])) for r in (_R, _R_INV)]
    return _POWERS


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first and last byte (in its lower-case text) of each word of the texts."""
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    begins = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(r) + 1 for r in raws])])
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([np.ones(1, np.int8), blank.astype(np.int8)]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    end = end[len(end) - len(start) :] if len(start) else end[:0]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        h = mix((sums[end] - sums[start]) * down[start])
    owner = np.searchsorted(begins, start, "right") - 1
    return h, owner, start - begins[owner], end - begins[owner]


def shingles(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Shingle hashes of each text, in order, repeated ones too."""
    h, owner, _, _ = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        if len(h) >= width:
            whole = mix(sum(h[k : len(h) - width + 1 + k] * _PLACE[k] for k in range(width)))
        else:
            whole = h[:0]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(whole[a : b - width + 1])
            elif b > a:
                out.append(mix(np.array([(h[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(whole[:0])
    return out


def in_parts(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters."""
    first, held, size = 0, [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hashes of each set of shingle hashes; of empty sets all ones."""
    out = np.full((len(sets), TOKENS), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        y = np.empty_like(x)
        for j in range(TOKENS):
            np.multiply(x, _MUL[j], out=y)
            y += _ADD[j]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[full, j] = np.minimum.reduceat(y, at)
    return out


def runs_needed(similarity: float, splits: int, depth: int, recall: float) -> int:
    """Runs after which a pair of this similarity has shared a bucket of every depth with probability ``recall``.

    A pair stays together in a bucket's child with the pair's similarity for each of ``splits`` tokens."""
    together = 1.0
    for _ in range(depth):
        together = 1 - (1 - similarity * together) ** splits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _x (hash of the text), _set (digest of the shingle set), _size, _sig of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in in_parts(b.column(2).to_pylist()):
                sets = [np.unique(s) for s in shingles(part)]
                sig = signatures(sets)
                rows = b.slice(first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                    ],
                    ["_id", "_x", "_set", "_size", "_sig"],
                )

    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_x"), text_of(text_col).alias("_t"))
    return slim.mapInArrow(run, f"_id {kind}, _x long, _set binary, _size int, _sig binary")


def _token(j) -> F.Column:
    """Value of token number j."""
    return F.substring(F.col("_sig"), j * 4 + 1, 4) if isinstance(j, int) else F.substr(F.col("_sig"), j * 4 + 1, F.lit(4))


def buckets(classes: DataFrame, similarity: float, splits: int, depth: int, recall: float, limit: int, density: float = 0.5) -> DataFrame:
    """_set, _node, _blocks (over 1: the bucket is compared in so many blocks) of all buckets to compare."""
    draw = np.random.default_rng(3)
    roots = [(r, int(j)) for r in range(runs_needed(similarity, splits, depth, recall)) for j in draw.choice(TOKENS, splits, replace=False)]
    level = classes.filter("_size > 0").select("_set", "_sig", F.explode(F.array(*[F.xxhash64(F.lit(r), F.lit(j), _token(j)) for r, j in roots])).alias("_node")).select("_set", "_node")
    blocks = F.when(F.col("_n") <= limit, 1).otherwise(F.ceil(F.col("_n") / (16 * limit))).cast("int").alias("_blocks")
    done = []
    for d in range(1, depth + 1):
        level = materialize(level, "path-level")
        sizes = level.groupBy("_node").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        some = level.join(sizes, "_node").select("_set", "_node", "_n")
        if d == depth:
            done.append(some.select("_set", "_node", blocks))
            break
        done.append(some.filter(F.col("_n") <= limit).select("_set", "_node", blocks))
        large = materialize(some.filter(F.col("_n") > limit), "path-large")
        if not large.limit(1).count():
            break
        # each large bucket draws tokens of its own; the second differs from the first
        one = F.pmod(F.xxhash64("_node", F.lit(1)), F.lit(TOKENS)).cast("int")
        step = F.pmod(F.xxhash64("_node", F.lit(2)), F.lit(TOKENS // splits - 1)).cast("int") + 1
        split = [F.pmod(one + step * k, F.lit(TOKENS)).cast("int") for k in range(splits)]
        children = large.join(classes.select("_set", "_sig"), "_set").select("_set", "_node", "_n", F.explode(F.array(*[F.xxhash64("_node", j, _token(j)) for j in split])).alias("_child"))
        children = materialize(children, "path-children")
        # the share of pairs that stay together is the mean similarity in a bucket: where it is high, splitting
        # only copies the pairs, and the bucket is compared as it is
        each = children.groupBy("_node", "_child").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
        dense = each.groupBy("_node").agg((F.sum(F.col("_c") * F.col("_c")) / (splits * F.first("_n") * F.first("_n"))).alias("_same")).filter(F.col("_same") >= density).select("_node")
        dense = materialize(dense, "path-dense")
        done.append(large.join(dense, "_node", "left_semi").select("_set", "_node", blocks))
        level = children.join(dense, "_node", "left_anti").select("_set", F.col("_child").alias("_node"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[pa.RecordBatch]:
    """Batches that do not part rows with equal first columns; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(i)[b.num_rows - 1] for i in range(keys)]
        same = np.ones(b.num_rows, bool)
        for i in range(keys):
            same &= b.column(i).to_numpy(zero_copy_only=False) == last[i].as_py()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            held.append(b.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        elif held and any(held[-1].column(i)[0].as_py() != last[i].as_py() for i in range(keys)):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def candidate_pairs(b: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a batch in the same bucket and pair of blocks with at least ``least`` equal tokens, in the first bucket they share.

    Columns: _node, _low, _high, _block, _set, _sig, _nodes."""
    node, low, high, block = (b.column(i).to_numpy() for i in range(4))
    sig = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint32).reshape(-1, TOKENS)
    names, nodes = b.column(4).to_pylist(), b.column(6)
    change = np.flatnonzero((np.diff(node) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
    begin = np.concatenate([[0], change])
    size = np.diff(np.concatenate([begin, [len(node)]]))
    lists: dict[int, set[int]] = {}

    def of(i: int) -> set[int]:
        if i not in lists:
            lists[i] = set(nodes[i].as_py())
        return lists[i]

    left, right = [], []
    for k in np.unique(size[size > 1]).tolist():
        a, c = np.triu_indices(k, 1)
        per = max(1, 100_000 // len(a))
        starts = begin[size == k]
        for i in range(0, len(starts), per):
            x = (starts[i : i + per, None] + a[None]).ravel()
            y = (starts[i : i + per, None] + c[None]).ravel()
            fits = (np.minimum(block[x], block[y]) == low[x]) & (np.maximum(block[x], block[y]) == high[x])
            x, y = x[fits], y[fits]
            for s in range(0, len(x), 100_000):
                u, v = x[s : s + 100_000], y[s : s + 100_000]
                near = (sig[u] == sig[v]).sum(1) >= least
                for p, q in zip(u[near].tolist(), v[near].tolist(), strict=True):
                    if names[p] != names[q] and min(of(p) & of(q)) == node[p]:
                        left.append(p)
                        right.append(q)
    return np.array(left, np.int64), np.array(right, np.int64)


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets have at least this Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    rows = np.unique(np.concatenate([left, right]))
    if len(left) > 4 * len(rows):
        # many pairs among few sets: products of 0/1 matrices over the shingles that two sets share
        place = np.full(len(sets), -1)
        place[rows] = np.arange(len(rows))
        every = np.concatenate([sets[i] for i in rows])
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        value, code, count = np.unique(every, return_inverse=True, return_counts=True)
        keep = count[code] > 1
        number = np.cumsum(count > 1) - 1
        code, owner = number[code[keep]], owner[keep]
        both = np.zeros((len(rows), len(rows)), np.float32)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for a in range(0, int((count > 1).sum()), 8192):
            i, j = np.searchsorted(code, (a, a + 8192))
            m = np.zeros((len(rows), 8192), np.float32)
            m[owner[i:j], code[i:j] - a] = 1
            both += m @ m.T
        inter = both[place[left], place[right]]
    else:
        inter = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(left, right, strict=True)], float)
    total = sizes[left] + sizes[right]
    return inter * (1 + similarity) >= similarity * total - 1e-6


def links(docs: DataFrame, similarity: float = 0.8, splits: int = 2, depth: int = 3, recall: float = 0.9999, limit: int = 64, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (_id, _x, _set), classes (_set, _n, _least), and linked classes (_set, _root, _links: documents linked to)."""
    rows = materialize(describe(docs, id_col, text_col), "ngram-rows")
    classes = rows.groupBy("_set").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"), F.min(F.struct("_id", "_x")).alias("_at"), F.first("_sig").alias("_sig"), F.first("_size").alias("_size"))
    classes = materialize(classes, "ngram-classes")
    found = materialize(buckets(classes, similarity, splits, depth, recall, limit), "ngram-buckets")
    lists = found.groupBy("_set").agg(F.sort_array(F.collect_set("_node")).alias("_nodes"))  # at most runs * splits ** depth
    known = materialize(lists.join(classes.select("_set", "_sig", "_n", "_at"), "_set"), "ngram-known")
    # a large bucket's blocks meet in pairs; small buckets are one block
    block = F.pmod(F.xxhash64("_set", "_node"), F.col("_blocks")).cast("int")
    dealt = found.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("_node", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_block", "_set")
    key = ["_node", "_low", "_high"]
    least = math.floor(TOKENS * similarity - 5 * math.sqrt(TOKENS * similarity * (1 - similarity)))

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches):
            left, right = candidate_pairs(b, least)
            yield b.take(pa.array(np.unique(np.concatenate([left, right])))).select(["_node", "_low", "_high", "_block", "_set"])

    first = dealt.join(known.select("_set", "_sig", "_nodes"), "_set").select(*key, "_block", "_set", "_sig", "_nodes").repartition(*key).sortWithinPartitions(*key)
    alive = materialize(first.mapInArrow(active, "_node long, _low int, _high int, _block int, _set binary"), "ngram-active")

    wanted = alive.select("_set").distinct().join(known, "_set").select("_set", "_sig", "_nodes", "_n", "_at")
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_x"), text_of(text_col).alias("_t"))
    texts = keyed.join(wanted, keyed["_id"].eqNullSafe(F.col("_at._id")) & (keyed["_x"] == F.col("_at._x"))).select("_set", "_sig", "_nodes", "_n", "_t")
    texts = texts.dropDuplicates(["_set"])  # rows that repeat id and text came along

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches):
            left, right = candidate_pairs(b, least)
            if not len(left):
                continue
            names, n = b.column(4).to_pylist(), b.column(7).to_numpy()
            used = np.unique(np.concatenate([left, right])).tolist()
            sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * b.num_rows
            for start, part in in_parts([b.column(8)[i].as_py() for i in used]):
                for k, s in enumerate(shingles(part)):
                    sets[used[start + k]] = np.unique(s)
            ok = np.zeros(len(left), bool)
            node = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            edges = np.flatnonzero((np.diff(node[left], axis=0) != 0).any(1)) + 1
            for part in np.split(np.arange(len(left)), edges):  # by bucket and blocks
                ok[part] = verified(sets, left[part], right[part], similarity)
            left, right = left[ok], right[ok]
            up = list(range(b.num_rows))

            def top(i: int, up: list[int] = up) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            count = np.zeros(b.num_rows, np.int64)
            np.add.at(count, left, n[right])
            np.add.at(count, right, n[left])
            for p, q in zip(left.tolist(), right.tolist(), strict=True):
                p, q = top(p), top(q)
                if p != q:
                    up[max(p, q)] = min(p, q)
            out = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in out], pa.binary()), pa.array([names[top(i)] for i in out.tolist()], pa.binary()), pa.array(count[out])], ["_set", "_root", "_links"])

    second = alive.join(texts, "_set").select(*key, "_block", "_set", "_sig", "_nodes", "_n", "_t").repartition(*key).sortWithinPartitions(*key)
    near = materialize(second.mapInArrow(compare, "_set binary, _root binary, _links long"), "ngram-links")
    return rows, classes, near


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """_v, _label of all ends of edges: the smallest end that is connected.

    Each round ties every end to its smallest neighbour or that one's, and contracts the edges to what was tied together, so there are fewer edges each time."""
    near = materialize(edges.select(F.col(a).alias("_v"), F.col(b).alias("_u")).filter("_v != _u").distinct(), "component-edges")
    labels = None
    while near.limit(1).count():
        both = near.unionByName(near.select(F.col("_u").alias("_v"), F.col("_v").alias("_u")))
        tie = materialize(both.groupBy("_v").agg(F.least(F.min("_u"), F.col("_v")).alias("_to")), "component-ties")
        jump = tie.select(F.col("_v").alias("_w"), F.col("_to").alias("_far"))
        tie = materialize(tie.join(jump, tie["_to"] == jump["_w"]).select("_v", F.col("_far").alias("_to")), "component-ties")
        if labels is None:
            labels = tie.withColumnRenamed("_to", "_label")
        else:
            on = tie.select(F.col("_v").alias("_label"), "_to")
            labels = materialize(labels.join(on, "_label", "left").select("_v", F.coalesce("_to", "_label").alias("_label")), "component-labels")
        one, two = tie.select("_v", F.col("_to").alias("_p")), tie.select(F.col("_v").alias("_u"), F.col("_to").alias("_q"))
        near = near.join(one, "_v").join(two, "_u").filter("_p != _q").select(F.least("_p", "_q").alias("_v"), F.greatest("_p", "_q").alias("_u")).distinct()
        near = materialize(near, "component-edges")
    return labels if labels is not None else near.select("_v", F.col("_u").alias("_label"))


def jaccard_join(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row per document: id, class_id (smallest id of its connected documents), n_links (other documents at least this similar, copies included), _x (hash of the text)."""
    rows, classes, near = links(docs, similarity, id_col=id_col, text_col=text_col, **how)
    # a class of a large bucket has a root in each pair of blocks: tie those roots to the smallest one
    least_root = near.select("_set", "_root", F.min("_root").over(Window.partitionBy("_set")).alias("_top"))
    edges = least_root.select("_set", "_top").union(least_root.select("_root", "_top")).distinct()
    labels = components(edges, "_set", "_top")
    linked = near.groupBy("_set").agg(F.sum("_links").alias("_links"))
    joined = classes.select("_set", "_n", "_least").join(linked, "_set", "left").join(labels.withColumnRenamed("_v", "_set"), "_set", "left")
    joined = materialize(joined.select("_set", "_n", "_least", F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_label", "_set").alias("_label")), "ngram-joined")
    least = joined.groupBy("_label").agg(F.min("_least").alias("class_id"))
    facts = materialize(joined.join(least, "_label").select("_set", "class_id", (F.col("_n") - 1 + F.col("_links")).alias("n_links")), "ngram-facts")
    return rows.select("_id", "_x", "_set").join(facts, "_set").select(F.col("_id").alias(id_col), "class_id", "n_links", "_x")


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("_x")


def one_of_each(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose group of connected documents has a smaller id, all columns as they were, whatever their names and types."""
    verdict = jaccard_join(docs, similarity, id_col, text_col).filter(~F.col(id_col).eqNullSafe(F.col("class_id")))
    lost = materialize(verdict.select(*id_keys(F.col(id_col), "_v"), F.col("_x").alias("_vx")).distinct(), "ngram-lost")
    rows = docs.select(packed_row(docs), *id_keys(docs[id_col], "_k"), F.xxhash64(text_of(docs[text_col])).alias("_kx"))
    return rows.join(lost, (F.col("_k1") == F.col("_v1")) & (F.col("_k2") == F.col("_v2")) & (F.col("_kx") == F.col("_vx")), "left_anti").select("_row.*")
