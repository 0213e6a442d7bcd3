"""Prefix trie of conversations by the Euler-tour technique.

Occurrences. The turns of a conversation are ordered by turn (null first; ties by a digest of role and text). A sequence of
turns is named by its depth and by the value of its turns' SHA-256 digests as digits to a fixed base modulo a 255-bit prime.
Such values compose: those of a prefix, of a suffix and of a spliced sequence follow from each other, so a conversation of any
length may lie in several ranges of one global sort, each of which is read as a stream, and a shared beginning is spliced in
by one join of conversations. The name of the parent follows from a turn's own name and digest.

Nodes are groups of equal names, pre-aggregated before the shuffle. A node is known by (smallest member, depth), which no
other node has. Siblings are linked in one global sort by parent, in ranges; a node with any number of children is spread.

Tour. Every node has an arc that enters and one that leaves it; each arc knows the next. List ranking in two levels: a task
that holds a range of nodes walks the pieces of the tour that lie within it; what remains are pieces with a successor
elsewhere. While there are more of them than `alone`, random mates are spliced together (a join of unique ids, a quarter of
the list each round); the rest is ranked by one task. Ranks carry sums of weights from each arc to the end of the tour (a leaf
counts 1, a node what it saves, leaving arcs nothing), so the sum over a subtree is the sum at its entering arc less that at
its leaving one.

Nulls: a null role or text is empty, rows without conv_id are left out. Repeated rows are turns of their own. An empty table
gives no rows. conv_ids are read as longs. Columns of other names are ignored. Names are equal for different sequences with a
probability of about depth / 2**255.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import WORD, materialize, partitions, table, text_of

PRIME = 2**255 - 19
BASE = int.from_bytes(hashlib.sha256(b"turns of a conversation").digest(), "big") % PRIME
BACK = pow(BASE, -1, PRIME)
ROOT = bytes(32)
#: Ids of members that are joined in one piece before they are hashed.
PIECE = 16384
_POWERS = [pow(BASE, i, PRIME) for i in range(512)]


def _power(n: int) -> int:
    return _POWERS[n] if n < len(_POWERS) else pow(BASE, n, PRIME)


def _value(b: bytes) -> int:
    return int.from_bytes(b, "big") % PRIME


def _name(x: int) -> bytes:
    return (x % PRIME).to_bytes(32, "big")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), name of own turns 0 to pos, digest, words: one row per turn."""
    role, text = text_of(conversations["role"]), text_of(conversations["text"])
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = conversations.select(conversations["conv_id"].cast("long").alias("conv"), conversations["turn"].alias("turn"), said.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).filter("conv is not null")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions and names within the range; the last row is marked and says which conversation came first."""
        first = conv = held = None
        pos, x = -1, 0
        for b in batches:
            rows = []
            for p, c, digest, words in zip(*(b[n].to_pylist() for n in ("p", "conv", "digest", "words")), strict=True):
                if conv != c or pos < 0:
                    conv, pos, x = c, -1, 0
                first = c if first is None else first
                pos, x = pos + 1, (x * BASE + _value(digest)) % PRIME
                if held:
                    rows.append(held)
                held = (p, c, pos, _name(x), digest, words, c == first, None)
            if rows:
                yield _batch(rows)
        if held:
            yield _batch([(*held[:7], first)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["p", "conv", "pos", "name", "digest", "words", "leads", "first"])

    order = ["conv", "turn", "digest"]
    slim = materialize(slim, "slim-turns")  # the sort reads its rows twice, texts are read once
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("p"), "conv", "digest", "words")
    rows = materialize(dealt.mapInArrow(scan, "p int, conv long, pos long, name binary, digest binary, words long, leads boolean, first long"), "turns")
    # what stands before each range of its first conversation: at most one row per range
    carries, conv, n, x = [(-1, True, 0, ROOT)], None, 0, 0
    for r in rows.filter("first is not null").select("p", "conv", "pos", "name", "first").orderBy("p").collect():
        if conv is not None and r["first"] == conv:
            carries.append((r["p"], True, n, _name(x)))
        if r["conv"] == r["first"] == conv:
            n, x = n + r["pos"] + 1, (x * _power(r["pos"] + 1) + _value(r["name"])) % PRIME
        else:
            conv, n, x = r["conv"], r["pos"] + 1, _value(r["name"])
    carry = rows.sparkSession.createDataFrame(carries, "p int, leads boolean, before long, carried binary")

    @F.arrow_udf("binary")
    def carried_on(carried: pa.Array, pos: pa.Array, name: pa.Array) -> pa.Array:
        return pa.array([n if c is None else _name(_value(c) * _power(i + 1) + _value(n)) for c, i, n in zip(carried.to_pylist(), pos.to_pylist(), name.to_pylist(), strict=True)], type=pa.binary())

    whole = rows.join(F.broadcast(carry), ["p", "leads"], "left")
    return whole.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), carried_on("carried", "pos", "name").alias("name"), "digest", "words")


def rebuilt(turns: DataFrame, shared: int = 20, most: int = 4) -> DataFrame:
    """conv, depth, name, parent, words, ends: every prefix of every rebuilt conversation, the empty one too.

    Conversation c takes the first h turns of c - c % shared, h = crc32(c) % most, then its own after its first h."""
    conv = F.col("conv")
    head = F.when(F.col("pos") < most - 1, F.struct("pos", "digest", "words"))
    own = turns.groupBy("conv").agg((F.max("pos") + 1).alias("n"), F.sort_array(F.collect_list(head)).alias("head"))
    own = own.select("conv", "n", "head", F.least(F.crc32(conv.cast("string").cast("binary")) % most, F.lit(most - 1)).cast("int").alias("h"), (conv - conv % shared).alias("from"))
    own = materialize(own, "conversations")
    base = own.filter(conv % shared == 0).select(conv.alias("from"), F.col("head").alias("given"))

    @F.arrow_udf("binary")
    def apart(head: pa.Array, given: pa.Array) -> pa.Array:
        """Name of what is given less the name of what it stands for; null where they are the same."""

        def total(digests: list | None) -> int:
            x = 0
            for d in digests or ():
                x = (x * BASE + _value(d)) % PRIME
            return x

        return pa.array([None if (d := (total(g) - total(o)) % PRIME) == 0 else _name(d) for o, g in zip(head.to_pylist(), given.to_pylist(), strict=True)], type=pa.binary())

    given = F.slice(F.coalesce("given", F.array().cast(dict(own.dtypes)["head"])), F.lit(1), F.col("h"))
    plans = own.join(base, "from", "left").select("conv", "n", "h", given.alias("given"), F.slice("head", F.lit(1), F.col("h")).alias("head"))
    plans = plans.select("conv", "n", "given", F.least("n", "h").alias("skip"), F.size("given").cast("long").alias("taken"), apart("head.digest", "given.digest").alias("apart"))
    plans = materialize(plans, "splices")

    @F.arrow_udf("struct<name: binary, parent: binary>")
    def spliced(name: pa.Array, digest: pa.Array, far: pa.Array, length: pa.Array) -> pa.Array:
        out = []
        for n, d, a, k in zip(name.to_pylist(), digest.to_pylist(), far.to_pylist(), length.to_pylist(), strict=True):
            x = _value(n) if a is None else (_value(n) + _value(a) * _power(k)) % PRIME
            out.append((_name(x), _name((x - _value(d)) * BACK)))
        return pa.StructArray.from_arrays([pa.array([o[0] for o in out], type=pa.binary()), pa.array([o[1] for o in out], type=pa.binary())], names=["name", "parent"])

    long = F.col("pos") + 1 - F.col("skip")
    late = turns.join(plans.select("conv", "n", "skip", "taken", "apart"), "conv").filter("pos >= skip")
    late = late.select("conv", (long + F.col("taken")).alias("depth"), spliced("name", "digest", "apart", long).alias("s"), "words", (F.col("pos") + 1 == F.col("n")).alias("ends"))
    late = late.select("conv", "depth", "s.name", "s.parent", "words", "ends")

    @F.arrow_udf("array<struct<name: binary, parent: binary>>")
    def prefixes(digests: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("name", pa.binary()), ("parent", pa.binary())]))
        out = []
        for row in digests.to_pylist():
            x, steps = 0, []
            for d in row:
                y = (x * BASE + _value(d)) % PRIME
                steps.append({"name": _name(y), "parent": _name(x)})
                x = y
            out.append(steps)
        return pa.array(out, type=kind)

    rest = F.col("n") > F.col("skip")
    early = plans.filter("taken > 0").select("conv", "taken", rest.alias("rest"), F.posexplode(F.arrays_zip(prefixes("given.digest").alias("names"), F.col("given.words").alias("words"))).alias("i", "g"))
    early = early.select("conv", (F.col("i") + 1).cast("long").alias("depth"), F.col("g.names.name").alias("name"), F.col("g.names.parent").alias("parent"), F.col("g.words").alias("words"), (~F.col("rest") & (F.col("i") + 1 == F.col("taken"))).alias("ends"))
    top = plans.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), (~rest & (F.col("taken") == 0)).alias("ends"))
    return late.unionByName(early).unionByName(top)


def digests_of_ends(steps: DataFrame, piece: int = PIECE) -> DataFrame:
    """name, depth, ends_sha256 of the ids, ascending, of the conversations that end there.

    Ids are joined in pieces by sorted ranges; then the pieces of a node go through one hash, in order, as a stream."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def cut() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], type=pa.binary()), pa.array([key[1]], type=pa.int64()), pa.array([ids[0]], type=pa.int64()), pa.array([",".join(map(str, ids))])], names=["name", "depth", "least", "ids"])

        for b in batches:
            for k in zip(b["name"].to_pylist(), b["depth"].to_pylist(), b["conv"].to_pylist(), strict=True):
                if ids and (key != k[:2] or len(ids) >= piece):
                    yield cut()
                    ids = []
                key = k[:2]
                ids.append(k[2])
        if ids:
            yield cut()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def done() -> tuple:
            return (*key, sha.hexdigest())

        for b in batches:
            rows = []
            for name, depth, ids in zip(b["name"].to_pylist(), b["depth"].to_pylist(), b["ids"], strict=True):
                if key == (name, depth):
                    sha.update(b",")
                else:
                    if key is not None:
                        rows.append(done())
                    key, sha = (name, depth), hashlib.sha256()
                sha.update(ids.as_buffer())
            if rows:
                yield _rows(rows)
        if key is not None:
            yield _rows([done()])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))], names=["name", "depth", "ends_sha256"])

    order = ["name", "depth", "conv"]
    ends = steps.filter("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = ends.mapInArrow(pieces, "name binary, depth long, least long, ids string")
    return cut.repartition("name", "depth").sortWithinPartitions("name", "depth", "least").select("name", "depth", "ids").mapInArrow(hashes, "name binary, depth long, ends_sha256 string")


def linked_siblings(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, following (conv_id of the next sibling, or null)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row learns the next one; the last row of the range is marked, the first row goes out once more."""
        held, first = None, None
        for b in batches:
            rows = []
            for r in zip(*(b[n].to_pylist() for n in ("p", "parent_conv_id", "depth", "conv_id")), strict=True):
                first = first or r
                if held:
                    rows.append((*held, r[3] if r[1:3] == held[1:3] else None, "in"))
                held = r
            if rows:
                yield _batch(rows)
        if held:
            yield _batch([(*held, None, "last"), (*first, None, "first")])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["p", "parent_conv_id", "depth", "conv_id", "following", "place"])

    order = ["parent_conv_id", "depth", "conv_id"]
    dealt = nodes.filter("depth > 0").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("p"), *order)
    rows = materialize(dealt.mapInArrow(link, "p int, parent_conv_id long, depth long, conv_id long, following long, place string"), "siblings")
    edges = {place: rows.filter(F.col("place") == place).orderBy("p").collect() for place in ("last", "first")}
    over = [(a["p"], b["conv_id"]) for a, b in zip(edges["last"], edges["first"][1:]) if (a["parent_conv_id"], a["depth"]) == (b["parent_conv_id"], b["depth"])]
    fix = rows.sparkSession.createDataFrame([(p, "last", c) for p, c in over] or [(-1, "last", 0)], "p int, place string, over long")
    return rows.filter("place != 'first'").join(F.broadcast(fix), ["p", "place"], "left").select("conv_id", "depth", "parent_conv_id", F.coalesce("following", "over").alias("following"))


_PIECES = "conv_id long, depth long, e_head string, e_leaves long, e_saved long, e_next string, x_head string, x_leaves long, x_saved long, x_next string"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks the pieces of the tour among the nodes of one range: for both arcs of each node the head of its piece, the sums
    from the arc to the end of the piece, and for heads what follows the piece ("" at the end of the tour)."""
    frames = list(batches)
    t = pd.concat(frames) if frames else pd.DataFrame()
    if not len(t):
        return
    conv, depth = t["conv_id"].tolist(), t["depth"].tolist()
    place = {key: i for i, key in enumerate(zip(conv, depth, strict=True))}
    n = len(conv)
    to, away = [-1] * (2 * n), [""] * (2 * n)  # arc 2i enters node i, arc 2i+1 leaves it
    targets = zip(*(t[c].astype("object").where(t[c].notna(), None).tolist() for c in ("first_child", "following", "parent_conv_id")), strict=True)
    for i, (child, following, parent) in enumerate(targets):
        goes = ((2 * i, (child, depth[i] + 1), 0) if child is not None else (2 * i, (conv[i], depth[i]), 1)), ((2 * i + 1, (following, depth[i]), 0) if following is not None else (2 * i + 1, (parent, depth[i] - 1), 1) if parent is not None else None)
        for go in goes:
            if go:
                arc, (c, d), leaves = go
                j = place.get((int(c), d))
                if j is None:
                    away[arc] = f"{int(c)}:{d}:{leaves}"
                else:
                    to[arc] = 2 * j + leaves
    led = np.zeros(2 * n, dtype=bool)
    led[[j for j in to if j >= 0]] = True
    head, after = [""] * (2 * n), [None] * (2 * n)
    leaves, saved = [0] * (2 * n), [0] * (2 * n)
    leaf, save = t["leaf"].tolist(), t["save"].tolist()
    for start in np.flatnonzero(~led).tolist():
        path = [start]
        while (j := to[path[-1]]) >= 0:
            path.append(j)
        name = f"{conv[start >> 1]}:{depth[start >> 1]}:{start & 1}"
        after[start] = away[path[-1]]
        a = b = 0
        for arc in reversed(path):
            if not arc & 1:
                a, b = a + leaf[arc >> 1], b + save[arc >> 1]
            head[arc], leaves[arc], saved[arc] = name, a, b
    out = {"conv_id": conv, "depth": depth}
    for c, k in (("e", 0), ("x", 1)):
        out |= {f"{c}_head": head[k::2], f"{c}_leaves": leaves[k::2], f"{c}_saved": saved[k::2], f"{c}_next": after[k::2]}
    yield pd.DataFrame(out)


def ranked(pieces: DataFrame, alone: int) -> DataFrame:
    """head, leaves, saved: sums of all pieces that follow each piece. pieces: head, next ("" at the end), leaves, saved."""
    spliced, current, round_no = [], materialize(pieces, "tour-0"), 0
    while current.count() > alone:
        round_no += 1
        coin = lambda c: F.xxhash64(F.lit(round_no), c) % 2 == 0  # noqa: B023, E731
        mates = current.filter(~coin(F.col("head"))).select(F.col("head").alias("mate"), *[F.col(c).alias(f"m_{c}") for c in ("next", "leaves", "saved")])
        leads = F.when(coin(F.col("head")), F.col("next"))
        pairs = materialize(current.join(mates, leads == F.col("mate"), "left"), f"pairs-{round_no}")
        spliced.append(pairs.filter("mate is not null").select("mate", F.col("head").alias("host"), "m_leaves", "m_saved"))
        both = lambda c: (F.col(c) + F.coalesce(f"m_{c}", F.lit(0))).alias(c)
        grown = pairs.select("head", F.coalesce("m_next", "next").alias("next"), both("leaves"), both("saved"))
        current = materialize(grown.join(spliced[-1].select(F.col("mate").alias("head")), "head", "left_anti"), f"tour-{round_no}")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        t = pd.concat(frames) if frames else pd.DataFrame()
        if not len(t):
            return
        rows = {h: (n, a, b) for h, n, a, b in zip(t["head"], t["next"], t["leaves"], t["saved"], strict=True)}
        at = (set(rows) - {n for n, _, _ in rows.values()}).pop()
        path = []
        while at:
            path.append(at)
            at = rows[at][0]
        out, a, b = [], 0, 0
        for h in reversed(path):
            out.append((h, a, b))
            a, b = a + rows[h][1], b + rows[h][2]
        yield pd.DataFrame(out, columns=["head", "leaves", "saved"])

    kind = "head string, leaves long, saved long"
    known = current.repartition(1).mapInPandas(rank, kind)
    for i, mates in reversed(list(enumerate(spliced))):
        known = materialize(known, f"known-{i}")
        # what follows a mate is what follows its host: the two were one piece
        late = mates.join(known, mates["host"] == known["head"]).select(mates["mate"].alias("head"), "leaves", "saved")
        # and what follows a host also holds its mate
        early = known.join(mates.select(F.col("host").alias("head"), "m_leaves", "m_saved"), "head", "left")
        known = early.select("head", *[(F.col(c) + F.coalesce(f"m_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]).unionByName(late)
    return known


def subtree_sums(nodes: DataFrame, alone: int, per_task: int) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens. nodes: conv_id, depth, parent_conv_id, first_child, following, leaf, save."""
    spark = nodes.sparkSession
    parts = max(partitions(spark), -(-nodes.count() // per_task))
    tour = materialize(nodes.repartitionByRange(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth").mapInPandas(_walk, _PIECES), "tour")
    heads = tour.select(F.explode(F.array(*[F.struct(F.col(f"{k}_head").alias("head"), F.col(f"{k}_next").alias("next"), F.col(f"{k}_leaves").alias("leaves"), F.col(f"{k}_saved").alias("saved")) for k in "ex"])).alias("s")).select("s.*").filter("next is not null")
    rest = materialize(ranked(heads, alone), "ranked")
    within = tour.filter("e_head = x_head").select("conv_id", "depth", (F.col("e_leaves") - F.col("x_leaves")).alias("n_leaves"), (F.col("e_saved") - F.col("x_saved")).alias("saved_tokens"))
    across = tour.filter("e_head != x_head")
    for k in "ex":
        across = across.join(rest.select(F.col("head").alias(f"{k}_head"), F.col("leaves").alias(f"{k}_l"), F.col("saved").alias(f"{k}_s")), f"{k}_head")
    across = across.select("conv_id", "depth", (F.col("e_leaves") + F.col("e_l") - F.col("x_leaves") - F.col("x_l")).alias("n_leaves"), (F.col("e_saved") + F.col("e_s") - F.col("x_saved") - F.col("x_s")).alias("saved_tokens"))
    return within.unionByName(across)


def prefix_trie(conversations: DataFrame, shared: int = 20, most: int = 4, alone: int = 1 << 16, per_task: int = 200_000) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    shared, most: the rule of shared beginnings; alone: pieces of the tour that one task ranks; per_task: nodes walked by one task."""
    steps = materialize(rebuilt(sorted_turns(conversations), shared, most), "prefixes")
    groups = steps.groupBy("name", "depth").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min("parent").alias("parent"))
    groups = materialize(groups, "nodes")
    above = groups.select(F.col("name").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    nodes = materialize(groups.withColumn("save", (F.col("n_convs") - 1) * F.col("words")).drop("words").join(above, ["parent", "depth"], "left").drop("parent"), "named-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.min("conv_id").alias("first_child"), F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, ["conv_id", "depth"], "left").join(linked_siblings(nodes).select("conv_id", "depth", "following"), ["conv_id", "depth"], "left")
    full = materialize(full.select("*", F.col("first_child").isNull().cast("long").alias("leaf")), "linked-nodes")
    sums = subtree_sums(full.select("conv_id", "depth", "parent_conv_id", "first_child", "following", "leaf", "save"), alone, per_task)
    out = full.join(sums, ["conv_id", "depth"]).join(digests_of_ends(steps), ["name", "depth"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, sha256(concat(CAST(length(role) AS VARCHAR), ':', role, text)) AS d, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
             row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(concat(CAST(length(role) AS VARCHAR), ':', role, text))) - 1 AS pos FROM t),
k AS (SELECT c, count(*) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                                      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h FROM t GROUP BY c),
r AS (SELECT k.c, o.pos, o.d, o.words FROM k JOIN o ON o.c = k.c - k.c % 20 AND o.pos < k.h
      UNION ALL SELECT k.c, o.pos, o.d, o.words FROM k JOIN o ON o.c = k.c AND o.pos >= k.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth, words, string_agg(d, '') OVER (PARTITION BY c ORDER BY pos) AS path FROM r
      UNION ALL SELECT c, 0, 0, '' FROM k),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends, min(c) OVER (PARTITION BY path) AS conv_id FROM s),
g AS (SELECT path, conv_id, depth, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM e GROUP BY path, conv_id, depth),
p AS (SELECT g.*, u.conv_id AS parent_conv_id FROM g LEFT JOIN e AS u ON u.c = g.conv_id AND u.depth = g.depth - 1),
b AS (SELECT p.*, coalesce(q.n, 0) AS n_children FROM p LEFT JOIN (SELECT parent_conv_id AS c, depth - 1 AS d, count(*) AS n FROM p WHERE depth > 0 GROUP BY 1, 2) AS q ON q.c = p.conv_id AND q.d = p.depth),
x AS (SELECT e.conv_id, e.depth, CAST(sum((b.n_children = 0)::BIGINT) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens
      FROM b JOIN e ON e.c = b.conv_id AND e.depth <= b.depth GROUP BY 1, 2)
SELECT b.conv_id, b.depth, b.parent_conv_id, b.n_convs, b.n_children, x.n_leaves, x.saved_tokens, b.ends_sha256 FROM b JOIN x ON x.conv_id = b.conv_id AND x.depth = b.depth
"""
