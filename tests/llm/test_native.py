"""Mixing, sharding, decontamination and line dedup against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest

from idlens.llm import decontam, linededup, mixing, sharding
from idlens.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import awkward_rows
from tests.oracle_compare import compare, connect

WORD = re.compile("[^\x20\x09-\x0d]+")


def n_words(text):
    return len(WORD.findall(text or ""))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    ok, _, note = compare(spark, connect(sf_dir), SimpleNamespace(run=QUERIES[name], sql=ORACLES[name]), sf_dir)
    assert ok, note


def test_native_plans_hold_no_python(spark, sf_dir):
    for name in ("op3_mix_sources", "op5_decontaminate", "op6_line_dedup", "op7_shards"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan), name


def highest_quotients(targets, house, most):
    """One seat after the other to the highest target / (2 * seats + 1)."""
    seats = dict.fromkeys(targets, 0)
    for _ in range(house):
        open_ = [s for s in targets if targets[s] > 0 and seats[s] < most[s]]
        seats[max(open_, key=lambda s: (targets[s] / (2 * seats[s] + 1), -list(targets).index(s)))] += 1
    return seats


def test_quotas_by_shard(spark, rnd):
    sizes = {f"s{i:02}": rnd.randrange(1, 4000) for i in range(11)} | {"zero": 0, None: 333}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    targets = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    # shared again round by round
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        level = left / sum(w for s, w in weight.items() if s not in stopped)
        over = {s for s in sizes if s not in stopped and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        stopped |= over
    assert targets == pytest.approx({s: 3 * sizes[s] if s in stopped else level * weight[s] for s in sizes})
    targets = {s: targets[s] for s in sizes}
    rows = mixing.sainte_lague(spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "source string, source_size bigint, target double"), 16, 4).collect()
    most = {s: 3 * sizes[s] // 16 for s in sizes}
    for shard in range(4):
        want = highest_quotients(targets, total // 16 * (shard + 1) // 4, most)
        assert {r.source: r.upto for r in rows if r.shard == shard} == want
    assert all(r.quota >= 0 for r in rows)


def test_mix(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == len(awkward_rows()) and mixing.mix(nothing).count() == 0
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], n_words(r[1])) for r in awkward_rows())
    assert all(0 <= r.taken <= 3 * r.size and sum(r.shard_taken) == r.taken for r in rows)
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(taken - target) <= 4 * len(by) for taken, target in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(awkward).collect()))


def test_shards(spark, awkward, nothing, rnd):
    assert sharding.shard_documents(nothing).count() == 0
    rows = sharding.shard_documents(awkward).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in awkward_rows())
    # a third of all rows are copies of one text
    docs = [(i, "the hot text " * 5 if i % 3 == 0 else " ".join(str(rnd.random()) for _ in range(rnd.randrange(1, 9)))) for i in range(4000)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(8)) and max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(text, items):
    low = lambda t: ITEM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    ws, hit, met = low(text), set(), set()
    for item, t in items:
        own = low(t)
        for win in {tuple(own[i:i + 10]) for i in range(max(1, len(own) - 9))} if own else ():
            for p in range(len(ws) - len(win) + 1):
                if tuple(ws[p:p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    met.add(str(item))
    return len(ws), len(hit), sorted(met)


def test_decontaminate(spark, awkward, nothing, rnd):
    word = lambda: rnd.choice("ab ba ca da éa Ab x1".split())
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 2, 4, 9, 10, 11, 14])))) for i in range(12)] + [(90, None), (91, "--"), (None, "same text")]
    docs = [(i, " ".join(rnd.choice([word(), items[rnd.randrange(12)][1]]) for _ in range(rnd.randrange(40)))) for i in range(40)]
    docs += [docs[3], docs[3], (None, docs[5][1]), (None, None), (77, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (50_000, 7):
        got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), bench, block=block).collect()
        want = Counter()
        for d, t in docs:
            n, h, m = brute_hits(t, items)
            want[d, n, h, tuple(x for x in m if x != "None")] += 1
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == want
    assert decontam.decontaminate(nothing, bench).count() == 0
    none = decontam.decontaminate(awkward, bench.limit(0)).collect()
    assert len(none) == len(awkward_rows()) and not any(r.n_hit for r in none)
    kept = decontam.clean_documents(awkward, spark.createDataFrame([(1, "Same text, of some words.")], "item_id bigint, text string"))
    assert kept.columns == awkward.columns and kept.count() == len(awkward_rows()) - 4


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def test_line_dedup(spark, awkward, nothing, rnd):
    def edit(s):
        i, c = rnd.randrange(len(s) + 1), rnd.choice("abé")
        return rnd.choice([s[:i] + c + s[i:], s[:i] + s[i + 1:], s[:i] + c + s[i + 1:]])

    base = ["".join(rnd.choice("abcé ") for _ in range(rnd.randrange(10, 40))) for _ in range(20)]
    rows = []
    for d in range(70):
        lines = [rnd.choice(base) for _ in range(rnd.randrange(5))]
        rows.append((d, "\n".join(edit(s) if rnd.random() < 0.6 else s for s in lines)))
    rows += [(None, None), (80, ""), (81, "abcdefghij\nabcdefghij \n\nabcdefghi"), (81, "abcdefghij\nabcdefghij \n\nabcdefghi"), (82, base[0] * 900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before, want = [], {}
    for d, text in sorted(dict.fromkeys(r for r in rows if r[1])):
        for i, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if len(line) >= 10:
                if line in before:
                    want[d, i] = "exact"
                elif any(one_edit(line, x) for x in before):
                    want[d, i] = "near"
                before.append(line)
    assert {(r.doc_id, r.line_no): r.kind for r in linededup.dropped_lines(docs).collect()} == want
    out = linededup.dedup_lines(docs).collect()
    left = lambda d, t: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want) if t is not None else None
    assert Counter((r.doc_id, r.text) for r in out) == Counter((d, left(d, t)) for d, t in rows)
    assert linededup.dedup_lines(nothing).count() == 0
    done = linededup.dedup_lines(awkward)
    assert done.count() == len(awkward_rows()) and set(awkward.columns) <= set(done.columns)


def test_near_side_of_a_large_table(spark, monkeypatch, rnd):
    """The join that moves the texts finds the same lines."""
    docs = spark.createDataFrame([(1, "the first long line"), (2, "the first lung line"), (3, "another line here"), (4, "another line here!")], "doc_id bigint, text string")
    small = sorted(map(tuple, linededup.dropped_lines(docs).collect()))
    monkeypatch.setattr(linededup, "AT_HAND", 0)
    assert sorted(map(tuple, linededup.dropped_lines(docs).collect())) == small and len(small) == 2


@pytest.mark.parametrize("doc_id", [None, 5])
def test_shards_split_a_group_without_ids_of_its_own(spark, doc_id):
    """A third of all rows are one text under a null, or one repeated, id: shards stay equal."""
    docs = [(doc_id, "the same words again and again " * 3)] * 2000 + [(100 + i, f"text {i} " * 12) for i in range(4000)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
    assert len(rows) == 6000 and sum(r.doc_id == doc_id for r in rows) == 2000
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(x - mean) < 0.05 * mean for x in sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in rows if r.doc_id == doc_id}) > 1
