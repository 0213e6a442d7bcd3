"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over 16 bytes cuts each text where the hash's low bits are zero, so equal passages
give equal chunks wherever they stand. Chunks that occur more than once in the corpus are encoded
once, by the document that holds their first occurrence, and handed to all documents that share
them; a document encodes its other chunks itself. Joins are then repaired: around each join the text
between two places that are token boundaries in any context is encoded again, and widened until what
stood there on both sides agrees with what it replaces.

The vocabulary is read as ranks; ids equal those of the tokenizer file of the same vocabulary,
special tokens included, which are recognised in texts as that file's library does.

Defined cases: null is the empty text, which has no ids; repeated ids and rows are encoded row by row;
texts without white space are repaired over their whole length; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import materialize, table, text_of

#: A chunk ends where the low bits of the rolling hash are zero: 1024 bytes on average, 128 at least.
BITS, LEAST = 10, 128
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Special tokens of the vocabulary file.
SPECIAL = {"<|endoftext|>": 50256}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """The encoder of ordinary text and the bytes of each id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    names = [b""] * (max(*ranks.values(), *SPECIAL.values()) + 1)
    for k, v in ranks.items():
        names[v] = k
    for k, v in SPECIAL.items():
        names[v] = k.encode()
    return encoding.encode_ordinary, names


def cut(raw: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes, at character starts."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(raw, np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8):  # the hash of 16 bytes from two hashes of half as many
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    at = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    at = at[(at < n)]
    at = at[(b[np.minimum(at, n - 1)] & 0xC0) != 0x80]
    out, last = [], 0
    for i in at.tolist():
        if i - last >= LEAST:
            out.append(i)
            last = i
    out.append(n)
    return out


def segments(text: str) -> list[tuple[str, bool]]:
    """The text between special tokens, and those tokens."""
    out = [(text, False)]
    for name in SPECIAL:
        if name in text:
            out = [(p, special or i % 2 == 1) for part, special in out for i, p in enumerate([part] if special else _between(part, name))]
    return [x for x in out if x[0]]


def _between(text: str, name: str) -> list[str]:
    parts = text.split(name)
    out = [parts[0]]
    for p in parts[1:]:
        out += [name, p]
    return out


def chunks(text: str) -> list[tuple[str, bool]]:
    """All chunks of a text in order; True: a special token."""
    out = []
    for part, special in segments(text):
        if special:
            out.append((part, True))
            continue
        raw, a = part.encode(), 0
        for b in cut(raw):
            out.append((raw[a:b].decode(), False))
            a = b
    return out


def digest(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode(), digest_size=16).digest()


def _left(text: str, low: int, high: int) -> int:
    """The last place after low and before high where white space follows something else: there a token ends in any context. low: none."""
    while (i := max(text.rfind(" ", low + 1, high), text.rfind("\n", low + 1, high))) > low:
        if not text[i - 1].isspace():
            return i
        high = i
    return low


def _right(text: str, low: int, high: int) -> int:
    """The first such place after low and before high; high: none."""
    i = low
    while True:
        a, b = text.find(" ", i + 1, high), text.find("\n", i + 1, high)
        i = min(x for x in (a, b, high) if x >= 0)
        if i == high or not text[i - 1].isspace():
            return i


def stitch(parts: list[str], ids_of: Callable[[int], list[int]], encode: Callable[[str], list[int]]) -> list[int]:
    """The ids of the joined parts from the ids of each: exactly those of encoding the joined text at once."""
    if len(parts) == 1:
        return ids_of(0)
    text = "".join(parts)
    done: list[int] = []
    # the open region starts at a certain boundary and has its own ids, right but for what follows its end
    start, end, ids = 0, len(parts[0]), list(ids_of(0))
    for k in range(1, len(parts)):
        b, c = end, end + len(parts[k])
        own = ids_of(k)
        if text[b] in " \n" and not text[b - 1].isspace():
            done += ids
            start, end, ids = b, c, list(own)
            continue
        p = _left(text, start, b)
        tail = encode(text[p:b])
        if p > start and ids[len(ids) - len(tail) :] == tail:
            del ids[len(ids) - len(tail) :]
            done += ids
        else:
            p = start
        q = _right(text, b, c)
        head = encode(text[b:q])
        if q < c and own[: len(head)] == head:
            done += encode(text[p:q])
            start, end, ids = q, c, own[len(head) :]
        else:  # widen over the whole part and go on to the next join
            start, end, ids = p, c, encode(text[p:c])
    return done + ids


def encode_text(text: str, shared: dict[int, list[int]], encode: Callable[[str], list[int]]) -> list[int]:
    """Ids of a text; shared: ids of some of its chunks by their number."""
    out: list[int] = []
    run: list[tuple[int, str]] = []

    def close() -> None:
        if run:
            out.extend(stitch([c for _, c in run], lambda i: shared[run[i][0]] if run[i][0] in shared else encode(run[i][1]), encode))
            run.clear()

    for k, (chunk, special) in enumerate(chunks(text)):
        if special:
            close()
            out.append(SPECIAL[chunk])
        else:
            run.append((k, chunk))
    close()
    return out


def decode_ids(ids: list[int], names: list[bytes]) -> str:
    return b"".join(map(names.__getitem__, ids)).decode("utf-8", "replace")


def packed(names: list[bytes]) -> str:
    """Type in which ids travel: two bytes where the vocabulary allows."""
    return "<u2" if len(names) <= 1 << 16 else "<u4"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _k1, _k2, _t: equal keys only for rows with equal ids and texts (up to a 64-bit hash)."""
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_k1"), F.xxhash64(text_of(text_col)).alias("_k2"), text_of(text_col).alias("_t"))


def encode_corpus(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids also ids (array<int>)."""
    path = path or default_ranks()
    kind = dict(docs.dtypes)[id_col]
    rows = _keyed(docs, id_col, text_col)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[None if s else digest(c) for c, s in chunks(t)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], ["_k1", "_k2", "_h"])

    held = materialize(rows.select("_k1", "_k2", "_t").mapInArrow(cuts, "_k1 string, _k2 long, _h array<binary>"), "bpe-chunks")
    placed = held.select("_k1", "_k2", F.posexplode("_h").alias("_at", "_h")).filter("_h is not null")
    # chunks that occur again, and where they occur first; partial sums come before the shuffle
    again = placed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_k1", "_k2", "_at")).alias("_first")).filter("_n > 1")
    again = materialize(again.select("_h", "_first"), "bpe-shared")
    owners = again.groupBy(F.col("_first._k1").alias("_k1"), F.col("_first._k2").alias("_k2")).agg(F.collect_list(F.struct(F.col("_first._at").alias("_at"), "_h")).alias("_list"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = codec(path)
        kind = packed(known)
        for b in batches:
            names, ids = [], []
            for t, wanted in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if wanted:
                    parts = chunks(t)
                    for x in wanted:
                        names.append(x["_h"])
                        ids.append(np.array(encode(parts[x["_at"]][0]), kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["_h", "_ids"])

    # rows that repeat id and text meet the same list: one of them is enough. The columns are those of the join
    # below, so that Spark deals out the texts once for both
    owned = rows.join(owners, ["_k1", "_k2"], "left").select("_id", "_t", "_list")
    book = owned.mapInArrow(learn, "_h binary, _ids binary").groupBy("_h").agg(F.first("_ids").alias("_ids"))
    # each document's shared chunks once, however often the row is repeated
    uses = placed.join(book, "_h").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("_at", "_ids")).alias("_list"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, names = codec(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b, out = whole.slice(i, 256), []
                for t, uses in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    shared = {x["_at"]: np.frombuffer(x["_ids"], packed(names)).tolist() for x in uses or ()}
                    ids = encode_text(t, shared, encode)
                    row = [len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decode_ids(ids, names).encode()).hexdigest()]
                    out.append([*row, ids] if with_ids else row)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 3 + with_ids]
                columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    ready = rows.join(uses, ["_k1", "_k2"], "left").select("_id", "_t", "_list")
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return ready.mapInArrow(finish, schema).withColumnRenamed("_id", id_col)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
