"""Language ID by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary, all of its pieces of letters whatever their length. Each
language has a probability per piece; the probability of a word is the sum over all its segmentations into
pieces, found by a forward recursion, and a text's words (runs of letters) are independent. Expectation
maximisation over the counts of all training words fits the probabilities until the training words gain less
than ``GAIN`` in log likelihood: the counts are gathered from every training document, the expected piece
counts are summed by Spark, and only pieces x languages numbers reach the driver.

Defined cases: null texts and texts without a letter give ``und`` with score 0; so do all texts if
there is nothing to learn from; words of any length are scored whole; more than ``most_langs`` languages are an
error, which bounds the numbers above (pieces x 200, about 50 MB); ties go to the language that sorts first;
null ids fall in the fold of the empty text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import materialize, remainder, table

#: Scale per character that keeps sums near 1, steps after which they are scaled anew, and added counts.
SCALE, STEPS, ADDED = 12.0, 32, 0.05
#: Share of the log likelihood that a round has to gain, and rounds at most.
GAIN, ROUNDS = 0.01, 8
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. Numbers such as one half are word characters but no letters."""
    out = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, out)):
        return out
    return [p for w in out for p in "".join(c if c.isalpha() else " " for c in w).split()]


class Pieces:
    """Piece numbers by rolling hash of code points. Number 0 stands for any character that is no piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        names = sorted(x for x in names if all(c == "▁" or c.isalpha() for c in x))
        self.longest = max(map(len, names), default=1)
        self.size = len(names) + 1
        keys = np.array([self.key(x) for x in names], np.uint64)
        ids = np.arange(1, self.size, dtype=np.int32)
        self.tables, shift = [], np.uint64(44)
        while len(keys):  # what collides goes to a further table
            slots = ((keys * np.uint64(2 * len(self.tables) + 3)) >> shift).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            held, number = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int32)
            held[slots[first]], number[slots[first]] = keys[first], ids[first]
            self.tables.append((np.uint64(2 * len(self.tables) + 3), held, number))
            keys, ids = np.delete(keys, first), np.delete(ids, first)

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
        return h

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(hashes.shape, np.int32)
        for salt, held, number in self.tables:
            slot = ((hashes * salt) >> np.uint64(44)).astype(np.int64)
            out += np.where(held[slot] == hashes, number[slot], 0)
        return out

    def spans(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Words by length: length with the word mark, rows of words, and by piece length the piece numbers at each start (-1: none)."""
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            points = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n)
            points = np.concatenate([np.full((len(rows), 1), ord("▁"), np.uint32), points], 1).astype(np.uint64) + np.uint64(1)
            h, out = np.zeros((len(rows), n + 2), np.uint64), []
            for m in range(1, min(n + 1, self.longest) + 1):
                h = (h[:, : n + 2 - m] + points[:, m - 1 :]) * _BASE
                got = self.numbers(h)
                if m > 1:
                    got[got == 0] = -1
                out.append(got)
            yield int(n + 1), rows, out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(n: int, spans: list[np.ndarray], probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations of words of n characters, words x languages, and the logs they are to be multiplied by, per word.

    probs: pieces x languages, a last row of zeros. The last sums alone are held, in a ring."""
    ring = len(spans) + 1
    alpha = np.zeros((ring, len(spans[0]), probs.shape[1]))
    alpha[0] = 1
    logs = np.full(len(spans[0]), -n * np.log(SCALE))
    for j in range(1, n + 1):
        now = np.zeros(alpha.shape[1:])
        for m in range(1, min(j, len(spans)) + 1):
            now += alpha[(j - m) % ring] * probs[spans[m - 1][:, j - m]] * SCALE**m
        alpha[j % ring] = now
        if j % STEPS == 0:
            top = np.maximum(alpha.max((0, 2)), 1e-290)
            alpha /= top[None, :, None]
            logs += np.log(top)
    return alpha[n % ring], logs


def log_probs(words: list[str], path: str, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(words), probs.shape[1] if probs.ndim > 1 else 1))
    for n, rows, spans in pieces(path).spans(words):
        for i in range(0, len(rows), 20000):
            sums, logs = forward(n, [s[i : i + 20000] for s in spans], probs)
            out[rows[i : i + 20000]] = np.log(np.maximum(sums, 1e-290)) + logs[:, None]
    return out


def expected_counts(words: list[str], langs: np.ndarray, counts: np.ndarray, path: str, probs: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected uses of each piece in each language under the present probabilities (forward and backward sums), and the words' log likelihood."""
    size, width = probs.shape
    out, likelihood = np.zeros(size * width), 0.0
    for n, rows, spans in pieces(path).spans(words):
        per = max(1, 400_000 // n)
        for i in range(0, len(rows), per):
            row, part = rows[i : i + per], [s[i : i + per] for s in spans]
            lang = langs[row]
            p = [probs[s, lang[:, None]] * SCALE ** (m + 1) for m, s in enumerate(part)]
            # sums up to and from each place, each divided by its scale; the scales' logs add up
            alpha, beta = np.zeros((n + 1, len(row))), np.zeros((n + 1, len(row)))
            up, down = np.zeros((n + 1, len(row))), np.zeros((n + 1, len(row)))
            alpha[0] = beta[n] = 1
            for sums, logs, ends in ((alpha, up, False), (beta, down, True)):
                for j in range(1, n + 1):
                    k = n - j if ends else j
                    reach = range(1, min(j, len(part)) + 1)
                    sums[k] = sum(sums[k + m] * p[m - 1][:, k] if ends else sums[k - m] * p[m - 1][:, k - m] for m in reach)
                    before = k + 1 if ends else k - 1
                    logs[k] = logs[before]
                    if j % STEPS == 0:
                        top = np.maximum(sums[k], 1e-290)
                        logs[k] += np.log(top)
                        near = slice(k, min(n, k + len(part)) + 1) if ends else slice(max(0, k - len(part)), k + 1)
                        sums[near] /= top
                        logs[near] = logs[k]
            whole = np.maximum(alpha[n], 1e-290)
            likelihood += float((counts[row] * (np.log(whole) + up[n] - n * np.log(SCALE))).sum())
            for m, s in enumerate(part):
                shift = np.exp(np.minimum(up[: n - m] + down[m + 1 :] - up[n], 600.0))
                use = (alpha[: n - m] * beta[m + 1 :] * shift / whole * counts[row]).T * p[m]
                at = (s.astype(np.int64) * width + lang[:, None]).ravel()
                use = use.ravel()
                live = use > 0
                out += np.bincount(at[live], use[live], minlength=len(out))
    return out.reshape(size, width), likelihood


def _normal(counts: np.ndarray) -> np.ndarray:
    """Probabilities with added counts, and a row of zeros for index -1."""
    probs = (counts + ADDED) / (counts.sum(0) + ADDED * len(counts))
    probs[-1] = 0
    return probs


def word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """lang (number), word, n over all rows of docs (text, lang)."""
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {i: Counter() for i in range(len(langs))}

        def flush() -> Iterator[pa.RecordBatch]:
            for i, c in held.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), i, np.int32)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
                    c.clear()

        for b in batches:
            for i in range(b.num_rows):
                held[number[b.column(1)[i].as_py()]].update(words_of(b.column(0)[i].as_py()))
                if sum(map(len, held.values())) > 400_000:
                    yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(run, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, path: str, rounds: int = ROUNDS, gain: float = GAIN, most_langs: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages and probabilities (pieces x languages and a row of zeros) from all rows of train (text, lang)."""
    train = train.filter("lang is not null and text is not null").select("text", "lang")
    langs = sorted(r[0] for r in train.select("lang").distinct().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not langs:
        return [], np.zeros((1, 0))
    counts = materialize(word_counts(train, langs), "langid-words")
    size, width = pieces(path).size, len(langs)
    probs, before = _normal(np.ones((size + 1, width))), None
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], probs: np.ndarray = probs) -> Iterator[pa.RecordBatch]:
            total, likelihood = np.zeros(probs.shape), 0.0
            for b in batches:
                uses, more = expected_counts(b.column(1).to_pylist(), b.column(0).to_numpy(), b.column(2).to_numpy().astype(float), path, probs)
                total, likelihood = total + uses, likelihood + more
            piece, lang = np.nonzero(total)
            # piece -1 stands for the log likelihood
            yield pa.RecordBatch.from_arrays([pa.array([*piece.tolist(), -1], pa.int32()), pa.array([*lang.tolist(), 0], pa.int32()), pa.array([*total[piece, lang].tolist(), likelihood], pa.float64())], ["piece", "lang", "n"])

        sums = counts.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        likelihood = float(sums.loc[sums["piece"] < 0, "n"].sum())
        sums = sums[sums["piece"] >= 0]
        fresh = np.zeros((size + 1, width))
        fresh[sums["piece"], sums["lang"]] = sums["n"]
        probs = _normal(fresh)
        if before is not None and likelihood - before < gain * abs(before):
            break
        before = likelihood
    return langs, probs


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (posterior of lang_pred under equal priors) of every row."""
    langs, probs = model
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        known = np.zeros((0, len(langs)))
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                lists = [words_of(t) if t else [] for t in b.column(1).to_pylist()]
                if len(seen) > 300_000:
                    seen, known = {}, known[:0]
                fresh = {w for ws in lists for w in ws if w not in seen}
                if fresh and langs:
                    fresh = list(fresh)
                    known = np.concatenate([known, log_probs(fresh, path, probs)])
                    seen.update(zip(fresh, range(len(seen), len(seen) + len(fresh)), strict=True))
                pred, score = [], []
                for ws in lists:
                    if not ws or not langs:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    s = known[[seen[w] for w in ws]].sum(0)
                    k = int(s.argmax())
                    pred.append(langs[k])
                    score.append(float(1 / np.exp(s - s[k]).sum()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = default_vocabulary()
    model = fit(docs.filter(remainder() != 2), path)
    return predict(docs, model, path).select("doc_id", (remainder() == 2).alias("held_out"), "lang_pred", "score")
