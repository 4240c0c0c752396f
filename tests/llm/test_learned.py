"""Classifiers, chat, tokens, quality and near-duplicates against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from pydoc_data.topics import topics

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from idlens.llm import chat, langid, quality, simhash, tokens, toxicity
from idlens.llm.common import cut
from idlens.llm.queries import tokenizer_path
from idlens.llm.wavelet import WaveletMatrix, build
from tests.llm.conftest import awkward_rows

RUSSIAN = (
    "Все люди рождаются свободными и равными в своём достоинстве и правах.",
    "Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.",
    "Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах.",
    "Никто не должен подвергаться пыткам или жестоким, бесчеловечным или унижающим его достоинство обращению и наказанию.",
    "Каждый человек, где бы он ни находился, имеет право на признание его правосубъектности.",
)
PLAIN = re.compile("[^\x20\x09-\x0d]+")


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_id(spark, documents, awkward, nothing):
    model = langid.learn(documents)
    truth = {r.doc_id: r.lang for r in documents.collect() if held(r.doc_id)}
    got = {r.doc_id: r for r in langid.identify(documents, model).collect()}
    assert np.mean([got[d].lang_pred == lang for d, lang in truth.items()]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    rows = langid.identify(awkward, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in awkward_rows())
    text = {r[0]: r[1] for r in awkward_rows()}
    assert {r.doc_id for r in rows if r.lang_pred == "und" and r.doc_id is not None} == {d for d, t in text.items() if d is not None and not any(map(str.isalpha, t or ""))}
    assert langid.identify(nothing, model).count() == 0
    blank = langid.learn(nothing)
    assert {(r.lang_pred, r.score) for r in langid.identify(awkward, blank).collect()} == {("und", 0.0)}
    assert langid.keep_identified(awkward, model).columns == awkward.columns


def test_language_id_reads_whole_texts_in_pieces(documents, monkeypatch):
    model = langid.learn(documents)
    texts = [r.text for r in documents.orderBy("doc_id").limit(30).collect()]
    whole = model.margins(texts)
    monkeypatch.setattr(langid, "PIECE", 97)
    assert np.allclose(model.margins(texts), whole, atol=1e-5)
    assert np.allclose(langid.vector(texts[0]).sum(), len(langid.ORDERS), atol=1e-3)


def test_toxicity(spark, documents, awkward, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs.join(labels, "doc_id", "left_semi"), model).join(labels, "doc_id").where(~F.col("toxic").isNull()).collect()
    rows = [r for r in rows if held(r.doc_id)]
    good = np.sort([r.score for r in rows if r.toxic == 0])
    assert np.mean([np.searchsorted(good, r.score) / len(good) for r in rows if r.toxic == 1]) > 0.85
    assert np.mean(good >= toxicity.THRESHOLD) < 0.03
    plain = docs.where("doc_id = 1").first().text
    low, gapped, spaced = (model.score(plain + x) for x in ("", " you idxiot", " you i d i o t"))
    assert low < gapped and low < spaced and model.score(plain + " you idiot, you moron") > 0.9
    assert model.score(None) == model.score("") == 0.0
    assert Counter(r.doc_id for r in toxicity.score(awkward, model).collect()) == Counter(r[0] for r in awkward_rows())
    assert toxicity.score(nothing, model).count() == 0
    assert {r.score for r in toxicity.score(awkward, toxicity.learn(nothing, labels)).collect()} == {0.0}


def test_subsequence_weights():
    """The compiled weights give the kernel of a window with a landmark, place by place."""
    marks = toxicity.Landmarks(["abcd", "moron"])
    for text in ("abcd", "a-bxcd", "zzmoroonzz"):
        s = toxicity.symbols(text)
        want = []
        for p in marks.profiles:
            total = 0.0
            for places in __import__("itertools").combinations(range(len(s)), toxicity.ORDER):
                if places[-1] - places[0] < toxicity.SPAN:
                    code = sum(int(s[i]) << 5 * (toxicity.ORDER - 1 - k) for k, i in enumerate(places))
                    total += toxicity.DECAY ** (places[-1] - places[0] + 1) * p.get(code, 0.0)
            want.append(total)
        assert np.allclose(marks.kernel(s), want, rtol=1e-5)
        for j in range(2):
            assert np.isclose(toxicity.places(s, marks.model(np.eye(2)[j], 0.0).weights).sum(), want[j], rtol=1e-4)


def test_chat_round_trip(spark, rnd):
    rows = []
    for k in [*range(25), None]:
        for _ in range(rnd.randrange(1, 9)):
            text = "".join(rnd.choice(["<", "|", "\\", "\n", "im_start|>", "<|im_end|>\n", "é", "x", "assistant"]) for _ in range(rnd.randrange(12)))
            rows.append((k, rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["user", "assistant", "a\nb", "<|\\", None, "\\n"]), rnd.choice([text, text, None]), "extra"))
    rows += [rows[0], (99, 0, "assistant", "y" * 300_000, "extra")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = defaultdict(list)
    for c, turn, role, text, _ in rows:
        by[c].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    want = {}
    for c, turns in by.items():
        turns.sort()
        learned = "".join(t[5] for t in turns if t[3] == "assistant")
        want[c] = (len(turns), sha("".join(f"{t[3]}\n{t[5]}\n" for t in turns)), len(learned), sha(learned))
    for size in (4096, 3):
        parts = chat.format_chat(frame, batch_rows=size)
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(parts).collect()} == want
        assert all(r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == r.n_turns for r in parts.collect())
    assert chat.read_back(chat.format_chat(frame.limit(0))).count() == 0


def test_wavelet_matrix(rnd):
    for n, top in ((0, 4), (1, 1), (600, 3), (5000, 500)):
        ids = np.array([rnd.randrange(top) for _ in range(n)], np.uint16)
        matrix = WaveletMatrix(build(ids, 9, b"meta"))
        assert matrix.meta == b"meta" and (matrix.ids() == ids).all()
        assert all(matrix.access(i) == ids[i] for i in range(0, n, 41))
        for symbol in (0, 1, 7, 499, 511, 9999):
            places = np.flatnonzero(ids == symbol).tolist()
            assert matrix.occurrences(symbol) == places
            assert matrix.count(symbol, n // 3, n // 2) == sum(n // 3 <= p < n // 2 for p in places)
        with pytest.raises(IndexError):
            matrix.access(n)
    with pytest.raises(ValueError):
        WaveletMatrix(b"something else")


def test_tokens(spark, awkward, nothing, rnd, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    whole = Tokenizer.from_file(path)
    coder = tokens.Encoder(path)
    assert coder.by_words
    alphabet = "aBé'sΣςİ.,!# \n\x1c\x85123ßÄ́ﬁ中<|_"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(1500)] + ["x<|endoftext|> Y", "it's 'S", "dogs' ... a.b, c)."]
    assert [x.tolist() for x in coder.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    rows = tokens.encode_documents(awkward, path, shard_tokens=500).collect()
    at = 0
    order = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    want = Counter()
    for doc_id, text, *_ in order:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)
    assert tokens.encode_documents(nothing, path).count() == 0
    folder = str(tmp_path / "shards")
    tokens.write_tokens(awkward, path, folder)
    shard = spark.read.schema(tokens.SHARDS).parquet(folder).orderBy("shard").first()
    tokens.export(spark, folder, shard.shard, str(tmp_path / "one.wm"))
    assert WaveletMatrix((tmp_path / "one.wm").read_bytes()).n == shard.n_tokens


def test_tokens_of_marks_in_other_case():
    """An end mark in capitals is text to the tokenizer, and forges no control token."""
    coder = tokens.Encoder(tokenizer_path())
    texts = ["<|EndOfText|>abc", "<|ENDOFTEXT|><|ENDOFTEXT|>", "a <|StartOfText|> é", "<|endoftext|>\u0338 b", "plain\x1cÉ text"]
    assert [x.tolist() for x in coder.encode(texts)] == [coder.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.encode(texts[:1])[0].tolist() == [27, 347, 40786, 4160, 91, 285, 5334]


def fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = PLAIN.findall(ws)
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, awkward, nothing, rnd):
    rows = {(r.doc_id, r.fp & (1 << 64) - 1) for r in simhash.fingerprints(awkward).collect()}
    assert rows == {(r[0], fingerprint(r[1])) for r in awkward_rows()}
    assert simhash.near_duplicates(awkward).count() == len(awkward_rows())
    assert simhash.near_duplicates(nothing).count() == 0
    base = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(90)}" for _ in range(300)) for _ in range(6)]
    docs = []
    for i in range(150):
        ws = rnd.choice(base).split()
        for _ in range(rnd.randrange(4)):
            ws[rnd.randrange(len(ws))] = f"E{rnd.randrange(9)}"
        docs.append((1000 - i, " ".join(ws)))
    fps = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(d for (d, _), x in zip(docs, group) if x == g) for g in set(group)}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {d: least[g] for (d, _), g in zip(docs, group)}
    kept = simhash.keep_one(spark.createDataFrame([*docs, docs[0], (None, None)], "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())


def test_keep_one_of_rows_that_share_an_id(spark, rnd):
    """Unrelated texts of one id all stay; a near copy goes although its id stays elsewhere."""
    a, b, c = (" ".join(f"{x}{rnd.randrange(90)}" for _ in range(300)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (3, c), (5, c), (9, a)]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id bigint, text string").repartition(3))
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (5, b), (3, c)])


def test_long_posting_lists_are_split(rnd, monkeypatch):
    """A long list gives the same groups by bit fields as all at once."""
    fps = np.array(sorted({rnd.randrange(1 << 8) << 20 | 1 << 40 | rnd.randrange(1 << 10) for _ in range(300)}), np.uint64)
    free = [8 * b + i for b in (0, 1, 2, 3) for i in range(8)]

    def groups():
        forest = simhash.Forest(len(fps))
        simhash.connect(fps, np.arange(len(fps)), free, forest)
        return [forest.root(i) for i in range(len(fps))]

    whole = groups()
    monkeypatch.setattr(simhash, "SMALL", 5)
    assert groups() == whole


def test_quality(awkward, nothing, documents):
    def brute(text):
        ws = PLAIN.findall(text or "")
        triples = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
        hit = {i + k for i in range(len(ws) - 2) if triples[tuple(ws[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if PLAIN.search(x)]
        return (len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
                len(ws) < 50 or 100 * len(hit) > 50 * len(ws))

    for frame in (awkward, documents):
        text = defaultdict(list)
        for r in frame.select("doc_id", "text").collect():
            text[r.doc_id].append(r.text)
        rows = quality.quality(frame).collect()
        assert Counter((r.doc_id, *r[1:7]) for r in rows) == Counter((d, *brute(t)) for d, ts in text.items() for t in ts)
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality.quality(nothing).count() == 0
    rules = quality.Rules()
    prose = documents.orderBy("doc_id").first().text
    noise = np.random.default_rng(1).bytes(3000).hex()
    assert rules.judge(prose)[-2] and rules.judge((prose[:200] + "\n") * 30)[-1] == "base"
    assert rules.judge(" ".join(noise[i:i + 9] for i in range(0, 6000, 9)))[-1] == "incompressible"


def test_quality_keeps_real_prose():
    """Licences, the language's own manual and a text in letters of two bytes stay; one sentence again and again, and noise, go."""
    rules = quality.Rules()
    prose = {f.name: f.read_text("utf-8") for f in Path("/usr/share/common-licenses").glob("*")}
    prose |= {k: t for k, t in topics.items() if len(t) > 3000 and "+----" not in t}  # no tables
    prose["wide"] = "\n".join(RUSSIAN)
    assert {k: why for k, t in prose.items() if (why := rules.bands_of(t.encode())[-1])} == {}
    for line in ("All rights to this are ours, and no one may copy item {} of it. ", RUSSIAN[0] + " {}. "):
        assert rules.bands_of("".join(line.format(i) for i in range(200)).encode())[-1] == "repetitive"
    noise = base64.b64encode(np.random.default_rng(3).bytes(9000)).decode()
    for n in (300, 900, 3000, 12_000):
        assert rules.bands_of(" ".join(noise[i:i + 9] for i in range(0, n, 9)).encode())[-1] == "incompressible"


def test_quality_bands_reject_what_the_word_rules_keep(rnd):
    """Template lines with other numbers, encoded data in words, and a noise tail: no repeated words, but out of the bands."""
    rules = quality.Rules()
    lines = "\n".join(f"Order {rnd.randrange(10 ** 6)} shipped to {rnd.choice('ABCDEFGH')} on {rnd.randrange(28)}.{rnd.randrange(12)} weight {rnd.randrange(999)} kg" for _ in range(60))
    data = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(6000))
    for text, why in ((lines, "repetitive"), (data, "incompressible")):
        verdict = rules.judge(text)
        assert not verdict[5] and not verdict[-2] and verdict[-1] == why
    prose = Path("/usr/share/common-licenses/GPL-3").read_text()
    noise = base64.b64encode(np.random.default_rng(3).bytes(3000)).decode()
    parts, bad = rules.bands_of((prose[:4096] + noise[:3000]).encode())[1:3]
    assert (parts, bad) == (2, 1)  # the tail is a chunk as well


def test_posting_lists_bring_every_close_pair_together(spark, rnd):
    """35 lists a fingerprint; two within 4 bits share one, though the most frequent byte keys none."""
    fps = {rnd.randrange(1 << 64) & ~(0xFF << 16) for _ in range(60)} | {rnd.randrange(1 << 16) << 48 for _ in range(40)}
    fps |= {f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 5))) for f in list(fps)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    lists = defaultdict(set)
    for r in simhash.posting_lists(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect():
        lists[r.fp].add((r.list, r.key))
    assert all(len(x) == 35 for x in lists.values()) and len(lists) == len(fps)
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert len(close) > 90 and all(lists[a] & lists[b] for a, b in close)


def test_pipeline(spark, documents):
    sf_dir = "/root/testdata/sf0.01"
    docs, before = documents, None
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        sizes[name] = docs.count()
        if name != "token_ids":
            assert docs.columns == documents.columns
        if name == "near_duplicates":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
            assert {r.doc_id for r in docs.collect()} == set(groups.values())
        if name == "decontamination":
            from idlens.llm import decontam
            hit = {r.doc_id for r in decontam.decontaminate(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r.n_hit}
            assert hit and {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - hit
        if name == "mixing":
            from idlens.llm import mixing
            want = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken}
            got = Counter()
            for r in docs.collect():
                got[r.doc_id] += len(PLAIN.findall(r.text))
            assert got == want
    assert sizes["language_id"] > 0.95 * documents.count() and sizes["near_duplicates"] < sizes["language_id"]
    assert sizes["token_ids"] == sizes["mixing"]


def test_pipeline_stages_on_awkward_and_empty_tables(spark, awkward, nothing, documents):
    """Null ids and texts, repeated rows, further columns: each stage does what its docstring says."""
    stages = dict(corpus_pipeline.STAGES)
    sf_dir = "/root/testdata/sf0.01"
    for name, stage in stages.items():
        assert stage(spark, nothing, sf_dir).count() == 0, name
    rows = awkward.select(*documents.columns).collect()
    known = stages["language_id"](spark, awkward.unionByName(documents, allowMissingColumns=True), sf_dir)
    texts = Counter(r.text for r in known.collect())
    assert None not in texts and "" not in texts and " \n\t " not in texts and texts["same text of some words here"] == 4
    kept = stages["near_duplicates"](spark, awkward, sf_dir).collect()
    assert Counter(r.text for r in kept if r.doc_id is None) == Counter(r.text for r in rows if r.doc_id is None)
    assert sum(r.text == "same text of some words here" for r in kept) == 1 and sum(not (r.text or "").strip() for r in kept if r.doc_id is not None) == 1
    assert Counter(map(str, stages["decontamination"](spark, awkward, sf_dir).collect())) == Counter(map(str, rows))
    mixed = stages["mixing"](spark, awkward, sf_dir).collect()
    whole = {r.text for r in rows if r.text}
    assert mixed and all(any(t.startswith(r.text) for t in whole) for r in mixed)  # a cut text is the beginning of its document
    assert stages["token_ids"](spark, awkward, sf_dir).count() == len(rows)
