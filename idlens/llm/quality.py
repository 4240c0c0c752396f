"""Quality rules: compression bands on top of word, symbol and repetition counts.

A text is compressed whole and in fixed chunks with zstandard. Repetitive text shrinks
too well, noise and encoded data too little; what is usual depends on the length, so
each band holds for texts up to a length in UTF-8 bytes, and on the script. Chunks catch a repetitive or
incompressible stretch inside a text that looks usual as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

LEVEL = 3
CHUNK = 4096
#: (texts up to this many bytes, lowest and highest ratio of size to compressed size), for texts
#: of mostly one-byte letters: below lie encoded data and noise, above text that says the same
#: again and again. From 512 bytes on the highest ratio is what 98 % of 5,467 manuals, package
#: texts and licences of that length stay below.
BANDS = (
    (128, 0.2, 2.0), (192, 0.9, 2.1), (256, 1.05, 2.15), (384, 1.15, 2.2), (512, 1.2, 2.2), (768, 1.25, 2.25),
    (1024, 1.35, 2.25), (1536, 1.45, 2.35), (2048, 1.5, 2.6), (3072, 1.65, 2.9), (4096, 1.75, 2.95), (6144, 1.85, 3.05),
    (8192, 1.9, 3.5), (16384, 1.95, 3.55), (32768, 2.0, 3.75), (131072, 2.0, 4.4), (1 << 62, 2.0, 5.5),
)
CHUNK_BAND = (1.7, 2.95)
#: The same for scripts of two to four bytes a letter: alphabets shrink more, as the letters
#: share their first bytes, Chinese characters less.
WIDE_BANDS = (
    (128, 0.2, 3.0), (192, 0.8, 3.15), (256, 0.9, 3.3), (384, 1.0, 3.4), (512, 1.0, 3.4), (768, 1.15, 3.4),
    (1024, 1.15, 3.5), (1536, 1.25, 3.7), (2048, 1.25, 3.9), (3072, 1.3, 4.35), (4096, 1.3, 4.45), (6144, 1.3, 4.6),
    (8192, 1.3, 5.25), (16384, 1.3, 5.35), (32768, 1.3, 5.6), (131072, 1.3, 6.6), (1 << 62, 1.3, 8.3),
)
WIDE_CHUNK_BAND = (1.3, 4.45)
#: From this share of bytes in letters of several bytes on, a text or chunk is of such a script.
WIDE = 0.25
#: A text goes when more than this share of its chunks lies outside CHUNK_BAND.
BAD_CHUNKS = 0.5
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated three-word windows
SYMBOLS = b"#*$%&|<>"
RESULT = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, kept boolean, reason string")


def repeated_words(ws: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(ws)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, n)
    size = len(known)
    pairs = ids[:-1] * size + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, at, times = np.unique(pairs[:-1] * np.int64(size) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[at] > 1)
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[starts + i] = True
    return int(hit.sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def wide(raw: bytes) -> bool:
    """Whether the letters are mostly of several bytes."""
    return bool((np.frombuffer(raw, np.uint8) >= 0x80).sum() >= WIDE * len(raw))


class Rules:
    """The counts and the verdict for one text; holds the compressor of a task."""

    def __init__(self, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, bad_chunks: float = BAD_CHUNKS,
                 wide_bands=WIDE_BANDS, wide_chunk_band=WIDE_CHUNK_BAND):
        # by script: one-byte letters, letters of several bytes
        self.bands, self.chunk_bands = (bands, wide_bands), (chunk_band, wide_chunk_band)
        self.chunk, self.bad_chunks = chunk, bad_chunks
        self.pack = zstandard.ZstdCompressor(level=LEVEL)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.pack.compress(raw))

    def bands_of(self, raw: bytes) -> tuple[float, int, int, str]:
        """ratio, chunks, chunks outside their band, and why the text goes ('' if it stays)."""
        if not raw:
            return 0.0, 0, 0, "empty"
        whole = self.ratio(raw)
        low, high = next((lo, hi) for upto, lo, hi in self.bands[wide(raw)] if len(raw) <= upto)
        # the last chunk is the last of full length, so that a tail is judged as well
        parts = [raw[i:i + self.chunk] for i in range(0, len(raw) - self.chunk + 1, self.chunk)]
        if parts and len(raw) % self.chunk:
            parts.append(raw[-self.chunk:])
        bad = 0
        for part in parts:
            least, most = self.chunk_bands[wide(part)]
            bad += not least <= self.ratio(part) <= most
        why = "incompressible" if whole < low else "repetitive" if whole > high else "chunks" if bad > self.bad_chunks * len(parts) else ""
        return whole, len(parts), bad, why

    def judge(self, text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        ws = raw.split()  # bytes split at \x20 and \x09-\x0D only
        n = len(ws)
        joined = b"".join(ws)
        # code points: bytes that do not continue one
        chars = n and int(((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80).sum())
        symbols = len(joined) - len(joined.translate(None, SYMBOLS))
        again = repeated_words(ws)
        failed = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
        whole, parts, bad, why = self.bands_of(raw)
        reason = "base" if failed else why
        return n, chars, symbols, duplicate_lines(raw), again, failed, whole, parts, bad, not reason, reason


def quality(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, bad_chunks: float = BAD_CHUNKS,
            wide_bands=WIDE_BANDS, wide_chunk_band=WIDE_CHUNK_BAND) -> DataFrame:
    """doc_id and RESULT for every document: the counts, the ratios and kept.

    Null counts as empty and is not kept; repeated rows give rows each; other columns
    are not read. Each text is worked on alone, in the task that read it.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(c.split()[0], {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]]) for c in RESULT.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(bands, chunk, chunk_band, bad_chunks, wide_bands, wide_chunk_band)
        for batch in batches:
            found = list(zip(*map(rules.judge, batch.column("text").to_pylist()))) or [()] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(x, f.type) for x, f in zip(found, list(schema)[1:])]], schema=schema)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, {RESULT}")
