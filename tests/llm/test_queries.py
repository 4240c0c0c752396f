"""The registered queries without SQL, run as registered and held against brute force."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
import zstandard

from idlens.llm import quality
from idlens.llm.queries import QUERIES, tokenizer_path
from tests.llm.conftest import awkward_rows

PLAIN = re.compile("[^\x20\x09-\x0d]+")
NEAR = " ".join(f"near{i * i % 211}" for i in range(400))


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The smallest given tables, with awkward rows and near copies among the documents."""
    path = tmp_path_factory.mktemp("tables")
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(100_000 + r[0] if r[0] is not None else None, *r[1:5]) for r in awkward_rows()]
    more += [(200_000 + i, NEAR + f" tail{i}" * (i % 2), "en", "copies", 1) for i in range(6)]
    rows = given.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    rows.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def texts(folder):
    """(doc_id, text) as read by another engine."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet/*.parquet'").fetchall()


def ask(spark, folder, name):
    df = QUERIES[name](spark, folder)
    return df.columns, df.collect()


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def test_language_query(spark, folder, texts):
    columns, rows = ask(spark, folder, "op1_language_id")
    assert columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts)
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet/*.parquet' WHERE doc_id < 100000").fetchall())
    letters = {d for d, t in texts if any(map(str.isalpha, t or ""))}
    for r in rows:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1
        assert r.doc_id is None or (r.lang_pred == "und") == (r.doc_id not in letters)
    unseen = [r for r in rows if r.held_out and r.doc_id in lang]
    assert sum(r.lang_pred == lang[r.doc_id] for r in unseen) >= 0.95 * len(unseen) > 40


def test_token_query(spark, folder, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    columns, rows = ask(spark, folder, "op4_token_ids")
    assert columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want, start = [], 0
    for doc_id, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)


def test_shard_query(spark, folder, texts):
    columns, rows = ask(spark, folder, "op7_shards")
    assert set(columns) >= {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    longest = max(r.size for r in rows)
    assert sorted(size) == list(range(8)) and max(size.values()) - min(size.values()) <= longest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_duplicate_query(spark, folder, texts):
    def fingerprint(text):
        ws = PLAIN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        hs = [xxhash.xxh64(" ".join(ws[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(ws) - 3))] if ws else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    columns, rows = ask(spark, folder, "op8_simhash")
    assert columns == ["doc_id", "fingerprint", "component_id"]
    fps = [(d, fingerprint(t)) for d, t in texts]
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((d, f"{fp:016x}") for d, fp in fps)
    kinds = sorted({fp for _, fp in fps})
    group = {fp: fp for fp in kinds}
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {fp: new if g == old else g for fp, g in group.items()}
    least = {}
    for d, fp in fps:
        if d is not None:
            least[group[fp]] = min(d, least.get(group[fp], d))
    got = {(r.doc_id, r.component_id) for r in rows if r.doc_id is not None}
    assert got == {(d, least[group[fp]]) for d, fp in fps if d is not None}
    assert len({c for d, c in got if d >= 200_000}) < 6


def test_quality_query(spark, folder, texts):
    """Counts by regular expressions, the verdict from the stated bands, step by step."""
    pack = zstandard.ZstdCompressor(level=3)

    def ratio(raw):
        return len(raw) / len(pack.compress(raw))

    def wide(raw):
        return 4 * sum(b > 127 for b in raw) >= len(raw)

    def judged(text):
        text = text or ""
        ws, raw = PLAIN.findall(text), text.encode()
        triples = Counter(zip(ws, ws[1:], ws[2:]))
        again = {i + k for i, t in enumerate(zip(ws, ws[1:], ws[2:])) if triples[t] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if PLAIN.search(x)]
        failed = len(ws) < 50 or 100 * len(again) > 50 * len(ws)
        good = bool(raw)
        if good:
            bands = quality.WIDE_BANDS if wide(raw) else quality.BANDS
            _, low, high = [b for b in bands if len(raw) <= b[0]][0]
            chunks = [raw[i:i + 4096] for i in range(0, len(raw), 4096)] if len(raw) >= 4096 else []
            if chunks and len(chunks[-1]) < 4096:
                chunks[-1] = raw[-4096:]
            bad = 0
            for c in chunks:
                low_c, high_c = quality.WIDE_CHUNK_BAND if wide(c) else quality.CHUNK_BAND
                bad += ratio(c) < low_c or ratio(c) > high_c
            good = low <= ratio(raw) <= high and 2 * bad <= len(chunks)
        return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed, good and not failed)

    columns, rows = ask(spark, folder, "op9_quality")
    assert columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert Counter(map(tuple, rows)) == Counter((d, *judged(t)) for d, t in texts)
    assert {r.kept for r in rows} == {True, False}


def test_toxicity_query(spark, folder, texts):
    columns, rows = ask(spark, folder, "op10_toxicity")
    assert columns == ["doc_id", "held_out", "score", "predicted"]
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts)
    for r in rows:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    by_text = defaultdict(set)
    id_text = Counter(d for d, _ in texts)
    text = {d: t for d, t in texts if d is not None and id_text[d] == 1}
    for r in rows:
        if r.doc_id in text:
            by_text[text[r.doc_id] or ""].add(round(r.score, 9))
    assert all(len(scores) == 1 for scores in by_text.values())  # the text alone decides
