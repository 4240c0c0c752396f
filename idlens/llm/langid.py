"""Language identification: the family first, then the language within it.

A text is the mean of its hashed character n-grams (1 to 4 UTF-8 bytes of the lower-cased
letters, other characters count as one blank). One-versus-one linear support vector
machines decide between families, and between the languages of the family chosen.

The machines learn from a bounded sample: at most `SAMPLE` labelled documents, shared
evenly among the languages and chosen by a hash of the id. Executors turn them into
vectors of fixed length; only these are gathered. Prediction reads whole texts, in
pieces of bounded size, in the task that read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlens.llm.common import held_out
from idlens.llm.svm import train_svm

SAMPLE = 2000
BITS = 13
SIZE = 1 << BITS
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 20  # bytes of text worked on at a time
UNKNOWN = "und"

#: ISO 639-1 codes by family; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo fy lb af yi",
    "romance": "fr es it pt ro ca gl oc la rm",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi bn mr gu pa ur ne si",
    "semitic": "ar he mt am",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text))


def plain(text: str) -> bytes:
    """Lower-cased letters, anything else as one blank, a blank at both ends."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" "


def buckets(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n, the bucket of the n-gram that begins at each place."""
    code = np.zeros(len(buf), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(buf) < n:
            return
        code = (code[:len(buf) - n + 1] << np.uint32(8)) | buf[n - 1:]
        if n in ORDERS:
            mixed = (code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
            yield n, (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def vector(text: str) -> np.ndarray:
    """Mean of the n-grams of each order, as float32 of length SIZE."""
    buf, out = np.frombuffer(plain(text), np.uint8), np.zeros(SIZE)
    reach = max(ORDERS) - 1
    for at in range(0, len(buf), PIECE):
        for n, idx in buckets(buf[at:at + PIECE + reach]):
            out += np.bincount(idx[:PIECE], minlength=SIZE) / max(1, len(buf) - n + 1)
    return out.astype(np.float32)


@dataclass
class Model:
    """One column of weights for each pair of families or of languages in a family."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # ('' or family, positive, negative)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[str]) -> np.ndarray:
        """Decision values of each text for each pair; texts are taken in pieces of PIECE bytes."""
        out = np.zeros((len(texts), len(self.pairs)))
        reach = max(ORDERS) - 1
        held: list[tuple[int, np.ndarray, int, int]] = []  # text, bytes, places that count, length of the whole

        def work() -> None:
            buf = np.concatenate([h[1] for h in held])
            first = np.cumsum([0] + [len(h[1]) for h in held[:-1]])
            for n, idx in buckets(buf):
                values = self.weights[idx]
                for (i, part, count, whole), at in zip(held, first):
                    upto = at + min(count, len(part) - n + 1)
                    if upto > at:
                        out[i] += values[at:upto].sum(0, dtype=np.float64) / (whole - n + 1)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            buf = np.frombuffer(plain(text), np.uint8)
            for at in range(0, len(buf), PIECE):
                part = buf[at:at + PIECE + reach]
                if size + len(part) > PIECE and held:
                    work()
                    size = 0
                held.append((i, part, PIECE, len(buf)))
                size += len(part)
        if held:
            work()
        return out + self.bias

    def best(self, group: str, names: list[str], row: np.ndarray) -> tuple[str, float]:
        """Most wins, then most summed margin, then order of names; sureness 0 to 1."""
        if len(names) == 1:
            return names[0], 1.0
        wins, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        least = dict.fromkeys(names, np.inf)
        for (of, yes, no), value in zip(self.pairs, row):
            if of == group and yes in wins:
                wins[yes if value >= 0 else no] += 1
                for name, v in ((yes, value), (no, -value)):
                    total[name] += v
                    least[name] = min(least[name], v)
        top = max(names, key=lambda x: (wins[x], total[x]))
        return top, float(1 / (1 + np.exp(-np.clip(3 * least[top], -30, 30))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.families else []
        out = [(UNKNOWN, 0.0)] * len(texts)
        for i, row in zip(known, self.margins([texts[i] for i in known])):
            family, sure = self.best("", self.families, row)
            name, sure2 = self.best(family, self.languages[family], row)
            out[i] = (name, sure * sure2)
        return out


def train(vectors: np.ndarray, langs: list[str]) -> Model:
    """`vectors` may be of float16; one pair's rows at a time are widened."""
    model = Model()
    if not langs:
        return model
    for lang in sorted(set(langs)):
        model.languages.setdefault(FAMILY.get(lang, lang), []).append(lang)
    model.families = sorted(model.languages)
    of = np.array(langs)
    family = np.array([FAMILY.get(x, x) for x in langs])
    scale = (1 / np.sqrt(vectors.mean(0, dtype=np.float64) + 1e-4)).astype(np.float32)  # frequent n-grams vary more; even them out
    pairs = [("", a, b, family) for a, b in combinations(model.families, 2)]
    pairs += [(f, a, b, of) for f, names in model.languages.items() for a, b in combinations(names, 2)]
    columns, bias = [], []
    for group, a, b, labels in pairs:
        rows = np.flatnonzero((labels == a) | (labels == b))
        y = np.where(labels[rows] == a, 1.0, -1.0)
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
        x = np.empty((len(rows), vectors.shape[1]), np.float32)
        for i, row in enumerate(rows):
            np.multiply(vectors[row], scale, out=x[i])
        w, c = train_svm(x, y, cost=10.0, weight=share)
        del x
        columns.append(w * scale)
        bias.append(c)
    model.pairs = [p[:3] for p in pairs]
    model.weights = np.stack(columns, 1).astype(np.float32) if columns else model.weights
    model.bias = np.array(bias)
    return model


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that are not held out; at most about `sample`
    of them, evenly from each language. Texts without a letter teach nothing."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not counts:
        return Model()
    share = sample / len(counts)
    chance = F.coalesce(*[F.when(F.col("lang") == name, F.lit(share / n)) for name, n in counts.items()], F.lit(0.0))
    drawn = labelled.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11) / F.lit(float(1 << 53)) < chance).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(g, t) for g, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if t and has_letter(t)]
            yield pa.RecordBatch.from_arrays([
                pa.array([g for g, _ in rows], pa.string()),
                pa.array([vector(t).astype(np.float16).tobytes() for _, t in rows], pa.binary())], names=["lang", "vector"])

    rows = drawn.mapInArrow(run, "lang string, vector binary").toArrow()
    rows = sorted(zip(rows.column("lang").to_pylist(), rows.column("vector").to_pylist()))  # whatever task was first
    return train(np.frombuffer(b"".join(v for _, v in rows), np.float16).reshape(-1, SIZE), [g for g, _ in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document, from its text alone. Null texts and
    texts without a letter are 'und' with score 0, and so is everything for an untrained
    model. Repeated rows give rows each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that have a language: null texts and those
    without a letter go. A text in a language that was not learnt, or code, keeps the
    learned label nearest to it and stays. Decided where the rows lie, without a join;
    repeated rows stay, an empty table gives an empty one."""
    columns = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column(columns.index("text")).to_pylist())
            yield batch.filter(pa.array([f[0] != UNKNOWN for f in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
