"""Token ids of whole documents in wavelet matrix files, one per shard.

Documents are range-partitioned and sorted by doc_id; a task encodes them in order and
closes a shard when it holds `SHARD_TOKENS` ids. A shard is one compressed file image
(see `wavelet`) with its documents' ids and first places. Images are written with
Spark's writer, a row each, to the folder the cluster shares, so any store Spark can
write to will do; `export` puts one into a plain file.

Encoding by words: a tokenizer that drops white space gives a text the ids of its
white-space separated pieces one after another. Arrow splits the texts of a batch and
numbers their different pieces; pieces not met before are encoded and remembered, and
numpy gathers the ids by number. That this holds for a tokenizer is tested on
construction.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idlens.llm.wavelet import WaveletMatrix, build
from idlens.session import scratch_path

END = 1
SHARD_TOKENS = 1 << 21
TEXTS = 2000  # encoded at a time
REMEMBERED = 800_000  # pieces; more begin anew
ODD = re.compile("[\x1c-\x1f\u03a3]")
#: White space beyond ASCII.
WIDE_BLANKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ENDED = r"([a-z0-9])([!-/:-@\[-`{-~]+)([\t-\r ]|$)"
SHARDS = "shard bigint, n_docs bigint, n_tokens bigint, image binary"


class Encoder:
    """Encodes texts with a tokenizer file, without special tokens of its own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.whole = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.bits = max(1, max(self.whole.get_vocab_size() - 1, END).bit_length())
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.normal = self.whole.normalizer
        self.bare = Tokenizer.from_file(path)  # for pieces, which are normalised already
        if self.normal is not None:
            self.bare.normalizer = normalizers.Sequence([])
        self._forget()
        probe = "Ab  cd.\n'S é x1 É. <| b"
        self.by_words = self.normal is not None and self._word_ids([self._normal(probe)])[0].tolist() == self._ids(probe).tolist()

    def _forget(self) -> None:
        """An empty store: `known` gives a piece its number, `starts` and `sizes` its ids in `store`."""
        self.known: dict[str, int] = {}
        self.store = np.zeros(1 << 16, self.kind)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.filled = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind)

    def _normal(self, text: str) -> str | None:
        """The normalised text, its pieces parted by ASCII white space. None for a text that holds a
        special string before or after normalising: the tokenizer knows the former only,
        pieces the latter."""
        # the normaliser composes, makes white space blanks and lower-cases; Python does the
        # same but for final sigma and the separators 1C to 1F
        if text.isascii():
            normal = self.normal.normalize_str(text) if ODD.search(text) else text.lower()
        elif unicodedata.is_normalized("NFC", text) and not ODD.search(text):
            normal = WIDE_BLANKS.sub(" ", text.lower())
        else:
            normal = self.normal.normalize_str(text)
        return None if any(s in text or s in normal for s in self.special) else normal

    def _keep(self, pieces: list[str], ids: list[list[int]]) -> None:
        at, sizes = len(self.known), np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while at + len(pieces) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.filled + total > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        self.store[self.filled:self.filled + total] = np.fromiter(chain.from_iterable(ids), self.kind, total)
        self.starts[at:at + len(pieces)] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[at:at + len(pieces)] = sizes
        self.known.update(zip(pieces, range(at, at + len(pieces))))
        self.filled += total

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of different pieces; those not known yet are encoded."""
        new = [p for p in pieces if p not in self.known]
        for lo in range(0, len(new), 10_000):
            some = new[lo:lo + 10_000]
            self._keep(some, [e.ids for e in self.bare.encode_batch_fast(some, add_special_tokens=False)])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _word_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Arrow splits the texts and numbers their different pieces; the ids are gathered by number."""
        if len(self.known) > REMEMBERED:
            self._forget()
        # marks after a letter or digit are encoded apart, which halves the number of pieces
        parted = pc.replace_substring_regex(pa.array(texts, pa.large_string()), ENDED, r"\1 \2\3")
        split = pc.ascii_split_whitespace(parted)
        codes = split.flatten().dictionary_encode()
        numbers = self._numbers(codes.dictionary.to_pylist())[codes.indices.to_numpy()] if len(codes) else np.zeros(0, np.int64)
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.store[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [ids[lo:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        normal = [self._normal(t) if self.by_words else None for t in texts]
        found = iter(self._word_ids([t for t in normal if t is not None]))
        return [self._ids(t) if n is None else next(found) for t, n in zip(texts, normal)]


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer and worker process. Functions travel to the workers by
    value, so what outlives a task is kept in a module made for it."""
    kept = sys.modules.setdefault("idlens_worker_encoders", ModuleType("idlens_worker_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def shard_image(docs: list[tuple[int | None, np.ndarray]], bits: int) -> bytes:
    """The file of documents (doc_id, ids with the end id)."""
    ids = np.array([d or 0 for d, _ in docs], np.int64)
    null = np.packbits([d is None for d, _ in docs])
    lengths = np.array([len(x) for _, x in docs], np.int64)
    meta = np.int64(len(docs)).tobytes() + ids.tobytes() + lengths.tobytes() + null.tobytes()
    return build(np.concatenate([x for _, x in docs]), bits, meta)


def shard_documents(matrix: WaveletMatrix) -> tuple[list[int | None], np.ndarray]:
    """The documents' ids and lengths, from a file's meta bytes."""
    n = int(np.frombuffer(matrix.meta[:8], np.int64)[0])
    ids, lengths = np.frombuffer(matrix.meta[8:8 + 16 * n], np.int64).reshape(2, n)
    null = np.unpackbits(np.frombuffer(matrix.meta[8 + 16 * n:], np.uint8), count=n)
    return [None if x else int(d) for d, x in zip(ids, null)], lengths


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes SHARDS to a folder: the documents in ascending doc_id order, null first,
    repeated ids by text. Null texts are empty: their end id alone. `tokenizer` is the
    path of a tokenizer file on the executors. A text larger than a shard is a shard of
    its own. Other columns are not read."""
    order = ["doc_id", "text"]
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text")).select(*order, F.spark_partition_id().alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size, made, task = encoder(tokenizer), [], 0, 0, 0

        def close() -> pa.RecordBatch:
            image = shard_image(held, coder.bits)
            return pa.RecordBatch.from_arrays([
                pa.array([(task << 32) + made]), pa.array([len(held)]), pa.array([size]), pa.array([image], pa.binary())],
                names=["shard", "n_docs", "n_tokens", "image"])

        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                task = part.column("task")[0].as_py()
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text").to_pylist())):
                    held.append((doc_id, np.append(ids, coder.kind(end))))
                    size += len(ids) + 1
                    if size >= shard_tokens:
                        yield close()
                        held, size, made = [], 0, made + 1
        if held:
            yield close()

    rows.mapInArrow(run, SHARDS).write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # ids before each shard: sums of 1024 shards first, so that no task sees all of them
    sizes = shards.select("shard", "n_tokens", F.shiftright("shard", 32).alias("_range"))
    ranges = sizes.groupBy("_range").agg(F.sum("n_tokens").alias("_n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(earlier(Window.orderBy("_range"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("_range").orderBy("shard"))), F.lit(0))
    starts = sizes.withColumn("_inside", inside).join(ranges, "_range").select("shard", (F.col("_before") + F.col("_inside")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, image in zip(batch.column("shard").to_pylist(), batch.column("image")):
                matrix = WaveletMatrix(image.as_py())
                names, lengths = shard_documents(matrix)
                ids, ends = matrix.ids().astype("<u4"), np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array(ends - lengths), pa.array(lengths),
                    pa.array([zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64())],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = shards.select("shard", "image").mapInArrow(run, "shard bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export(spark: SparkSession, path: str, shard: int, file: str) -> None:
    """Puts one shard's image into a local file, for `WaveletMatrix`."""
    with open(file, "wb") as out:
        out.write(spark.read.schema(SHARDS).parquet(path).where(F.col("shard") == shard).first()["image"])


def encode_documents(docs: DataFrame, tokenizer: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the documents' files to the shared folder and reads them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end, shard_tokens)
    return read_documents(docs.sparkSession, path)
