"""Toxicity by a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of `ORDER` symbols, the product of
their weights, decay ** (stretch they take up); a stretch is at most `SPAN` symbols long.
So inserted characters and spaced-out letters still match, at a discount. Symbols are
the letters without case, a mark for one or more other characters (so words have
beginnings and ends), and digits that stand for letters.

Landmarks are the words that most tell toxic from other training documents. In their
span (Nyström) a linear support vector machine learns from windows of labelled texts:
the windows most like a landmark, of toxic and of clean documents. Because the kernel is
linear in the weights of subsequences, the trained machine is one weight per
subsequence, and a text is scored in a single pass: the value of every window, and from
the highest value and the number of positive windows the text's score.

The sample learnt from is bounded (`SAMPLE` documents of each label) and stays on the
executors; windows reach the driver as their kernel values with the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlens.llm.common import cut, held_out
from idlens.llm.svm import train_logistic, train_svm

SAMPLE = 2000
LANDMARKS = 96
ORDER = 4
SPAN = 7
DECAY = 0.7
WINDOW = 16  # symbols
PIECE = 1 << 19  # symbols of text worked on at a time
THRESHOLD = 0.7
PRIOR = 0.4  # share of toxic texts that scores are set for

MARK = 27
PATTERNS = [(0, *p) for p in combinations(range(1, SPAN), ORDER - 1)]
#: Digits often put for a letter.
SAME = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


def symbol_table() -> np.ndarray:
    """Code point below 0x3000 -> 1 to 26 (a to z), MARK, or 28 to 31 (further letters)."""
    table = np.full(0x3000, MARK, np.uint8)
    for c in range(0x3000):
        if "a" <= chr(c) <= "z":
            table[c] = c - 96
        elif chr(c).isalpha():
            table[c] = 28 + c % 4
    for digit, letter in SAME.items():
        table[ord(digit)] = ord(letter) - 96
    return table


TABLE = symbol_table()


def symbols(text: str) -> np.ndarray:
    """The text as symbols, runs of marks as one, a mark at both ends."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    out = np.where(points < len(TABLE), TABLE[np.minimum(points, len(TABLE) - 1)], 28 + (points % 4).astype(np.uint8)).astype(np.uint8)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != MARK) | (out[:-1] != MARK)
    return out[keep]


def subsequences(s: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For each pattern of places its weight and the codes that begin at each symbol
    (0 symbols after the end make no known subsequence)."""
    padded = np.concatenate([s, np.zeros(SPAN, np.uint8)]).astype(np.uint32)
    n = len(s)
    for _, b, c, d in PATTERNS:
        code = (padded[:n] << 15) | (padded[b:b + n] << 10) | (padded[c:c + n] << 5) | padded[d:d + n]
        yield DECAY ** (d + 1), code


def profile(text: str) -> dict[int, float]:
    """Subsequence -> weight, normalised to length 1."""
    found: dict[int, float] = {}
    for weight, codes in subsequences(symbols(text)):
        for code in codes.tolist():
            if code & 31:  # complete
                found[code] = found.get(code, 0.0) + weight
    norm = np.sqrt(sum(v * v for v in found.values())) or 1.0
    return {k: v / norm for k, v in found.items()}


def places(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each symbol the sum of its subsequences' weights in `weights`."""
    out = np.zeros(len(s), np.float32)
    for weight, codes in subsequences(s):
        out += np.float32(weight) * weights[codes]
    return out


def windows(values: np.ndarray) -> np.ndarray:
    """Sums over WINDOW symbols, one for each window's beginning."""
    if len(values) <= WINDOW:
        return np.array([values.sum()], np.float64)
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[WINDOW:] - total[:-WINDOW]


@dataclass
class Model:
    landmarks: list[str]
    codes: np.ndarray  # the subsequences of the landmarks
    values: np.ndarray  # and their weights
    bias: float
    final: np.ndarray | None = None  # of the features below

    @cached_property
    def weights(self) -> np.ndarray:
        """One weight per subsequence code; laid out where it is used, not sent there."""
        out = np.zeros(32 ** ORDER, np.float32)
        out[self.codes] = self.values
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "weights"}

    def window_values(self, text: str) -> Iterator[np.ndarray]:
        s = symbols(text)
        for at in range(0, max(1, len(s) - WINDOW + 1), PIECE):  # long texts in overlapping pieces
            own = s[at:at + PIECE + WINDOW - 1]
            yield windows(places(s[at:at + PIECE + WINDOW - 1 + SPAN], self.weights)[:len(own)]) + self.bias

    def features(self, text: str) -> np.ndarray:
        """Highest window value, positive windows (in windows' lengths, log), their share."""
        top, positive, n = -np.inf, 0, 0
        for values in self.window_values(text):
            top, positive, n = max(top, float(values.max())), positive + int((values > 0).sum()), n + len(values)
        return np.array([np.clip(top, -3, 5), np.log1p(positive / WINDOW), np.sqrt(positive / n)])

    def score(self, text: str | None) -> float:
        if self.final is None or not text:
            return 0.0
        x = float(self.features(text) @ self.final[:-1] + self.final[-1])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class Landmarks:
    """Kernel values of windows with the landmarks, and the Nyström map."""

    def __init__(self, words: list[str]):
        self.words = words
        self.profiles = [profile(w) for w in words]
        self.codes = np.array(sorted({c for p in self.profiles for c in p}), np.int64)
        at = {c: i for i, c in enumerate(self.codes.tolist())}
        self.table = np.zeros((len(self.codes), len(words)), np.float32)
        for j, p in enumerate(self.profiles):
            for c, v in p.items():
                self.table[at[c], j] = v
        gram = self.table.T.astype(np.float64) @ self.table
        value, vector = np.linalg.eigh(gram)
        self.root = (vector / np.sqrt(np.maximum(value, 0.05))) @ vector.T  # ridge on the small ones

    def kernel(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words))
        for weight, codes in subsequences(s):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            out += weight * self.table[at[self.codes[at] == codes]].sum(0)
        return out

    def model(self, alpha: np.ndarray, bias: float) -> Model:
        """The machine as a weight per subsequence: the landmarks' weights times alpha."""
        return Model(self.words, self.codes, self.table @ alpha.astype(np.float32), bias)


def top_windows(model: Model, marks: Landmarks, text: str, most: int, seed: int) -> np.ndarray:
    """Kernel values of the text's `most` highest windows that don't overlap, and of one
    other; a row each, the other one last."""
    s = symbols(text)
    values = windows(places(s, model.weights))
    other = int(np.random.default_rng(seed).integers(len(values)))
    rows = []
    for _ in range(most):
        at = int(values.argmax())
        if values[at] == -np.inf:
            break
        rows.append(marks.kernel(s[at:at + WINDOW]))
        values[max(0, at - WINDOW + 1):at + WINDOW] = -np.inf
    return np.array([*rows, marks.kernel(s[other:other + WINDOW])])


def sample_documents(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """text, toxic, n of about `sample` labelled documents of each label, none held out;
    and the labels' numbers in all. A document with different labels counts as toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    chance = F.when(F.col("toxic") == 1, F.lit(sample / max(1, counts.get(1, 0)))).otherwise(F.lit(sample / max(1, counts.get(0, 0))))
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(13)), 11) / F.lit(float(1 << 53)) < chance)
    # about 2 * sample ids
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id").select("text", "toxic"), counts


def telling_words(rows: DataFrame, most: int) -> list[str]:
    """Words in more of the toxic than of the clean sample documents, by the gain in
    log likelihood; and a few words frequent in clean ones."""
    ws = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,24}"), F.lit(0)))
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return []
    df = rows.select("toxic", F.explode(ws).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    gain = F.col("bad") * F.log(((F.col("bad") + 0.5) / bad) / ((F.col("good") + 0.5) / good))
    found = [r[0] for r in df.where("bad >= 2").orderBy(gain.desc(), "word").limit(most - most // 6).collect()]
    usual = [r[0] for r in df.orderBy(F.desc("good"), "word").limit(most // 6).collect()]
    return found + [w for w in usual if w not in found]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Trains on the labelled documents that are not held out. Without documents of both
    labels the model scores everything 0."""
    blank = Model([], np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
    rows, _ = sample_documents(docs, labels, sample)
    rows = cut(rows)
    words = telling_words(rows, landmarks)
    if not words:
        return blank
    marks = Landmarks(words)
    start = np.array([1.0] * (landmarks - landmarks // 6) + [0.0] * landmarks)[:len(words)]
    model = marks.model(marks.root @ marks.root @ start, 0.0)

    def gather(make, schema: str) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [(y, make(t)) for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([y for y, _ in made], pa.int32()), pa.array([x.astype(np.float64).tobytes() for _, x in made], pa.binary())], names=["y", "x"])

        got = sorted(zip(*rows.mapInArrow(run, schema).toArrow().to_pydict().values()))
        return np.array([y for y, _ in got]), [np.frombuffer(x, np.float64) for _, x in got]

    for _ in range(2):  # the second time windows are chosen by what the first has learnt
        labels_of, found = gather(lambda t, m=model: top_windows(m, marks, t, 3, len(t)) if t else np.zeros((0, len(words))), "y int, x binary")
        x, y = [], []
        for label, row in zip(labels_of, found):
            for k, window in enumerate(part := row.reshape(-1, len(words))):
                if label == 0 or k < len(part) - 1:
                    x.append(window)
                    y.append(1.0 if label else -1.0)
        x, y = np.array(x) @ marks.root, np.array(y)
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
        w, bias = train_svm(x, y, cost=1.0, weight=share)
        model = marks.model(marks.root @ w, bias)
    labels_of, features = gather(lambda t, m=model: m.features(t or ""), "y int, x binary")
    n = np.bincount(labels_of, minlength=2)
    model.final = train_logistic(np.array(features), labels_of, np.where(labels_of == 1, PRIOR / max(1, n[1]), (1 - PRIOR) / max(1, n[0])) * len(labels_of))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every document, from its whole text alone. Null and empty
    texts score 0. Repeated rows give rows each; other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(map(model.score, batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
