"""Toxicity of texts after noisy-channel deobfuscation.

Spans that look disguised (digits or signs among letters, single characters with separators,
characters repeated three times and more) become lattices: each character may stand for itself,
for the letters it is used for, or for nothing. Viterbi decoding under a character trigram model of
the whole corpus restores the likeliest letters. Words and word beginnings of the restored text are
weighed by how often they occur in toxic and other labelled documents; a logistic curve over the two
strongest, fitted on folds that did not set the weights, gives the score.

The character model sums counts over every document. Labels are read from at most ``most_labelled``
rows in expectation, drawn by a hash of the id (a documented bound); everything else covers all rows.

Defined cases: null and empty texts get the score of a text without evidence; without toxic labels
every score is 0, without others 1; texts of any length are scored whole; repeated ids are scored
row by row; a label row that is null is ignored; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.llm.common import materialize, packed_row, remainder, table, text_of

# What signs and digits stand for in disguised words.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = " .-_*'"
#: Nats for a substitution, for a dropped repetition, for a kept one beyond two, for a dropped sign.
SUBSTITUTE, DROP, KEEP, LOSE = 0.7, 0.3, 3.0, 3.0
_WORDS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[0-9@$!|+€]+")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*][^\W_@$]){3,}(?!\S)")
#: Character classes: 0 anything but a letter, a to z, and 37 classes of other letters.
CLASSES = 64


def char_class(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 37 if c.isalpha() else 0


_CLASS = np.array([char_class(chr(i)) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x3000)], np.uint8)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n: trigrams of character classes over all whole texts, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    points = np.frombuffer(f"\n{t.lower()}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
                    c = _CLASS[np.where(points < len(_CLASS), points, 0)].astype(np.int32)
                    if len(c) > 2:
                        total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs (nats) of a class after two classes, from all texts. At most CLASSES ** 3 rows reach the driver."""
    got = trigram_counts(docs, text_col).toPandas()
    n = np.zeros(CLASSES**3)
    n[got["gram"]] = got["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    two, one = n.sum(0), n.sum((0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
    p3 = (n + 4 * p2[None]) / (n.sum(2, keepdims=True) + 4)
    return -np.log(p3).astype(np.float32)


def restore(span: str, costs: np.ndarray) -> str:
    """The likeliest letters of a disguised span; a blank where it keeps a break."""
    arcs: list[tuple[tuple[str, float], ...]] = []
    run, last = 0, ""
    for c in span:
        run, last = (run + 1 if c == last else 1), c
        if c.isalpha():
            arcs.append(((c, 0.0),) if run == 1 else ((c, 0.0 if run == 2 else KEEP), ("", DROP)))
        elif c in STANDS_FOR:
            more = tuple((x, SUBSTITUTE) for x in STANDS_FOR[c])
            arcs.append((*more, ("", LOSE)) if run == 1 else (*more, ("", DROP)))
        elif c in SEPARATORS:
            arcs.append((("", 0.0), (" ", SUBSTITUTE)))
        else:
            arcs.append(((" ", 0.0),))
    # state: the last two letters; links hold (letter, link before)
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in arcs:
        fresh: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, link) in states.items():
            for out, price in options:
                if out:
                    k = char_class(out)
                    key, value, path = (b, k), cost + price + float(costs[a, b, k]), (out, link)
                else:
                    key, value, path = (a, b), cost + price, link
                if key not in fresh or value < fresh[key][0]:
                    fresh[key] = (value, path)
        states = fresh
    best = min(states.items(), key=lambda s: (s[1][0] + float(costs[s[0][0], s[0][1], 0]), s[0]))[1][1]
    out = []
    while best is not None:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out))


class Restorer:
    """Words of a text, disguised spans restored. Restored spans are remembered."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs, self.memo = costs, {}

    def span(self, span: str) -> list[str]:
        if span not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[span] = _WORDS.findall(restore(span, self.costs))
        return self.memo[span]

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out = set(_WORDS.findall(low))
        end = 0
        for at in sorted({*_signs(low), *_repeats(low)}):
            if at < end:
                continue
            a = b = at
            while a and not low[a - 1].isspace():
                a -= 1
            while b < len(low) and not low[b].isspace():
                b += 1
            end = b
            out.update(self.span(low[a:b].strip(".,;:!?\"'()")))
        for m in _SPACED.finditer(low):
            out.update(self.span(m[0]))
        return out


def _signs(low: str) -> list[int]:
    """Places of digits and signs between letters, before two letters that begin a word, or singly after two that end one."""
    out = []
    for m in _SIGNS.finditer(low):
        a, b = m.span()
        before, after = low[a - 1 : a], low[b : b + 1]
        if after.isalpha():
            if before.isalpha() or "!" not in m[0] and not before.strip() and low[b : b + 2].isalpha() and b + 2 <= len(low):
                out.append(a)
        elif not after.strip() and b - a == 1 and m[0] != "!" and a > 1 and low[a - 2 : a].isalpha():
            out.append(a)
    return out


def _repeats(low: str) -> list[int]:
    """Places of letters that follow two of their kind."""
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = points[1:] == points[:-1]
    return [i for i in np.flatnonzero(same[1:] & same[:-1]).tolist() if low[i].isalpha()]


def features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 6 letters."""
    return [f"={word}", *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


class Evidence(dict):
    """Strongest log odds of a word's features, remembered."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        get = self.weights.get
        self[word] = v = max((get(f, 0.0) for f in features(word)), default=0.0)
        return v


def strongest(words: set[str], evidence: Evidence) -> tuple[float, float]:
    """The two strongest log odds among the words."""
    top = sorted(map(evidence.__getitem__, words))[-2:] if words else []
    return (top[-1] if top else 0.0, top[0] if len(top) > 1 else 0.0)


def _weights(toxic: np.ndarray, other: np.ndarray, base: float, held: float = 8.0) -> np.ndarray:
    """Log odds over the base rate of documents with a feature; ``held`` documents of the base rate are added."""
    p = (toxic + held * base) / (toxic + other + held)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.maximum(0.0, np.log(p / (1 - p)) - np.log(base / (1 - base)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    b = np.zeros(x.shape[1])
    hold = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - y) + hold @ b
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + hold, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 30_000, least: int = 3) -> dict:
    """Model from all texts of docs (characters) and at most ``most_labelled`` expected rows of labels (doc_id, toxic)."""
    spark = docs.sparkSession
    costs = char_model(docs)
    chosen = labels.filter("toxic in (0, 1) and doc_id is not null").filter(remainder() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = chosen.count()
    if n > most_labelled:  # a bounded sample by hash
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1_000_000)) < int(1_000_000 * most_labelled / n))
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(restorer.words(t)) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], ["toxic", "fold", "words"])

    # the ids of a bounded sample: at most most_labelled rows of 16 bytes, give or take chance
    labelled = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "fold", "text")
    sample = materialize(labelled.mapInArrow(words, "toxic int, fold int, words array<string>"), "toxic-sample")

    def counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = (Counter(), Counter())
            for b in batches:
                for fold, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = {f for w in ws for f in features(w)}
                    held[fold].update(found if wanted is None else found & wanted)
            for fold, c in enumerate(held):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([fold] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["feature", "fold", "n"])

        return rows.select("fold", "words").mapInArrow(run, "feature string, fold int, n long").groupBy("feature").agg(*[F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])

    # features of at least `least` toxic documents of the sample, then their counts in its other documents
    toxic = counted(sample.filter("toxic = 1"), None).filter(F.col("n0") + F.col("n1") >= least).toPandas()
    other = counted(sample.filter("toxic = 0"), set(toxic["feature"])).toPandas().rename(columns={"n0": "m0", "n1": "m1"})
    both = toxic.merge(other, on="feature", how="left").fillna(0)
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("toxic", "fold").count().collect()}
    count = {y: sum(v for (t, _), v in sizes.items() if t == y) for y in (0, 1)}
    if not count[0] or not count[1]:
        return {"costs": costs, "weights": {}, "curve": np.array([0.0, 0.0, -30.0 if not count[1] else 30.0])}
    base = count[1] / (count[0] + count[1])
    table_of = lambda w: {f: float(x) for f, x in zip(both["feature"], w, strict=True) if x > 0.5}
    # each fold is judged by the weights of the other one
    others = [table_of(_weights(both[f"n{1 - k}"].to_numpy(), both[f"m{1 - k}"].to_numpy(), base)) for k in (0, 1)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = [Evidence(w) for w in others]
        for b in batches:
            top = [strongest(set(ws), evidence[fold]) for fold, ws in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in top], pa.float64()), pa.array([x[1] for x in top], pa.float64())], ["toxic", "a", "b"])

    seen = sample.mapInArrow(judged, "toxic int, a double, b double").groupBy("toxic", F.round("a", 2).alias("a"), F.round("b", 2).alias("b")).count().toPandas()
    x = np.repeat(seen[["a", "b"]].to_numpy(), seen["count"], axis=0)
    y = np.repeat(seen["toxic"].to_numpy(), seen["count"])
    return {"costs": costs, "weights": table_of(_weights((both["n0"] + both["n1"]).to_numpy(), (both["m0"] + both["m1"]).to_numpy(), base)), "curve": _logistic(x, y)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """id and score (0 to 1) of every whole text; with keep_columns instead _row, a struct of all columns of docs, and score."""
    curve = model["curve"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, evidence = Restorer(model["costs"]), Evidence(model["weights"])
        for b in batches:
            top = np.array([strongest(restorer.words(t), evidence) if t else (0.0, 0.0) for t in b.column(1).to_pylist()]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(top @ curve[:2] + curve[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], [b.schema.names[0], "score"])

    first = packed_row(docs) if keep_columns else docs[id_col].alias("_id")
    slim = docs.select(first, docs[text_col].cast("string").alias("_text"))
    scored = slim.mapInArrow(run, T.StructType([slim.schema.fields[0], T.StructField("score", T.DoubleType())]))
    return scored if keep_columns else scored.withColumnRenamed("_id", id_col)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (remainder() == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those that score at least threshold, all columns as they were, whatever their names and types."""
    return score(docs, fit(docs, labels), keep_columns=True).filter(F.col("score") < threshold).select("_row.*")
