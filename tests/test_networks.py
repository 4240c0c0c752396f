"""Identity groups, face search, registry over time, zone repair and timed streams on small fixtures."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idlens.operators.asof import as_of
from idlens.operators.faces import index_shape, nearest, search_faces, usable
from idlens.operators.groups import connected, identity_groups, record_tokens
from idlens.operators.mrz_repair import LOOK_ALIKES, repair_zones
from idlens.operators.skew import join_to_one
from idlens.session import scratch_path
from idlens.streaming import jobs
from idlens.streaming.pairing import pair_sides, rocksdb_state

# --- groups ------------------------------------------------------------------------------


def plain_groups(users, ties):
    up = {u: u for u in users}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for user, token in ties:
        if user is None or token is None:
            continue
        a, b = root(user), root(first.setdefault(token, user))
        up[max(a, b)] = min(a, b)
    roots = {u: root(u) for u in users}
    return {u: (r, sum(x == r for x in roots.values())) for u, r in roots.items()}


def test_identity_groups_equal_union_find_with_a_hot_token(spark):
    rng = random.Random(3)
    users = list(range(1, 400))
    ties = [(u, "hot") for u in users if u % 3 == 0]  # a third of all under one number
    ties += [(rng.choice(users), f"t{rng.randrange(260)}") for _ in range(330)]
    ties += [(5, None), (None, "t1"), (5, "t1"), (5, "t1")]
    chain = [(1000 + i, f"c{(i + d) // 2}") for i in range(64) for d in (0, 1)]  # a path of 64 users
    users += [1000 + i for i in range(64)]
    frame = spark.createDataFrame(ties + chain, "user_id bigint, token string").repartition(3)
    got = identity_groups(spark.createDataFrame([(u,) for u in users], "id bigint"), frame).collect()
    assert {r.user_id: (r.group_id, r.group_size) for r in got} == plain_groups(users, ties + chain)
    assert len(got) == len(users)


def test_groups_through_pairs_and_nothing(spark):
    users = spark.createDataFrame([(i,) for i in range(5)], "id bigint")
    none = spark.createDataFrame([], "user_id bigint, token string")
    faces = spark.createDataFrame([(3, 1), (1, 3), (4, None), (2, 2)], "a bigint, b bigint")
    got = {r.user_id: (r.group_id, r.group_size) for r in identity_groups(users, none, faces).collect()}
    assert got == {0: (0, 1), 1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}
    assert connected(faces.limit(0)).collect() == []


def test_record_tokens(spark):
    rows = [(1, "visa", "v-1 2", " A  b ", "01/01/2000"), (2, "visa", "V12", "a B", None), (3, None, "V12", None, "x"), (4, "visa", "", "", "x")]
    got = record_tokens(spark.createDataFrame(rows, "user_id bigint, doc_type string, id_number string, name string, dob string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.user_id, set()).add(r.token.replace(chr(31), "|"))
    assert by == {1: {"id|visa|V12", "person|a b|01/01/2000"}, 2: {"id|visa|V12"}}


def test_join_to_one_loses_nothing_and_broadcasts_hot_keys_only(spark):
    big = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)] + [(None, -1), (77777, -2)], "k bigint, v bigint")
    one = big.where("k <> 77777").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = join_to_one(big, one, "k", "n").collect()
    assert len(got) == 3000 and {(r.k, r.top) for r in got if r.k == 0} == {(0, 2999)}


# --- faces --------------------------------------------------------------------------------


def test_face_search_recall_and_no_all_pairs(spark):
    rng = np.random.default_rng(9)
    stored = rng.normal(size=(6000, 48))
    stored[3000:5000] = stored[2999]  # a third are copies of one vector
    near = stored[:600] + 0.25 * rng.normal(size=(600, 48))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(stored)], "vec_id bigint, embedding array<float>").repartition(4)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(near)] + [(900, stored[4000].tolist())], "probe_id bigint, embedding array<float>")
    got = {r.probe_id: r for r in search_faces(p, v, recall=0.95).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit(near) @ unit(stored).T * 100
    exact = scores.argmax(1)
    matched = [i for i in range(600) if scores[i].max() > 90]
    recall = sum(got[i].vec_id == exact[i] for i in matched) / len(matched)
    assert len(matched) > 500 and recall >= 0.9
    for i in matched:
        if got[i].vec_id == exact[i]:
            assert got[i].match_score == pytest.approx(scores[i].max(), abs=1e-3) and got[i].matched
    assert got[900].vec_id == 2999 and got[900].match_score == pytest.approx(100)  # the smallest id of equal vectors


def test_face_search_index_grows_slowly():
    assert index_shape(2, 0.9, 0.9) == (1, 2)
    (bits, tables), (more_bits, more_tables) = index_shape(10 ** 5, 0.9, 0.95), index_shape(10 ** 7, 0.9, 0.95)
    assert more_bits == bits + 7 and more_tables < 4 * tables


@pytest.mark.parametrize("tasks, block", [(1, 1 << 27), (6, 1 << 27), (6, 2000)])
def test_face_search_scores_buckets_in_place(spark, tasks, block):
    rng = np.random.default_rng(3)
    n, dims, bits, tables = 300, 8, 3, 2
    stored = rng.normal(size=(n, dims))
    stored[1], stored[3] = stored[0] * 4, stored[2] * 1e-120  # the same direction; too small to score in advance
    near = np.concatenate([stored[:60] + 0.2 * rng.normal(size=(60, dims)), rng.normal(size=(20, dims))])
    ids = [i // 2 if i >= 40 else 100 + i for i in range(80)]  # from 40 on two different rows a probe
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(stored)], "vec_id bigint, embedding array<double>").repartition(3)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, near)] + [(ids[0], near[0].tolist())] * 2 + [(999, None)], "probe_id bigint, embedding array<double>")
    found = nearest(v, usable(p, "probe_id"), dims, bits, tables, 5, tasks, block)
    planes = np.random.default_rng(5).normal(size=(dims, tables * bits))
    side = lambda x: (x @ planes > 0).reshape(-1, tables, bits)
    meet = (side(near)[:, None] == side(stored)[None]).all(3).any(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit(near) @ unit(stored).T
    want = {}
    for probe in set(ids):
        rows = [i for i, x in enumerate(ids) if x == probe]
        best, first = max((scores[i][j], -j) for j in np.flatnonzero(meet[rows].any(0)) for i in rows if j != 3)
        want[probe] = {int(j) for j in np.flatnonzero(meet[rows].any(0)) if j != 3 and max(scores[i][j] for i in rows) >= best - 1e-9}
    got = {}
    for r in found.collect():
        got.setdefault(r.probe_id, []).append((r.near, r.vec_id))
    for probe, some in got.items():
        top = max((s for s, _ in some if s < np.inf), default=-np.inf)
        assert {j for s, j in some if top - 1e-9 <= s < np.inf} == want[probe]
    assert set(got) == set(want) and all(j == 3 for some in got.values() for s, j in some if s == np.inf)
    assert found.count() < (6 if block > 2000 else 20) * len(ids)  # all pairs of a bucket travelled before, some 5,000 here
    assert (meet.sum()) > 30 * len(ids)


def test_face_search_on_odd_vectors(spark):
    v = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [-1.0, 2.0])],
                              "vec_id bigint, embedding array<double>")
    p = spark.createDataFrame([(1, [2.0, 2.0]), (1, [2.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "probe_id bigint, embedding array<double>")
    got = {r.probe_id: (r.vec_id, r.matched) for r in search_faces(p, v).collect()}
    assert got == {1: (6, True), 2: (None, False), 3: (None, False), 4: (None, False)}
    assert [tuple(r) for r in search_faces(p.limit(1), v.limit(0)).collect()] == [(1, None, None, False)]


# --- as of -----------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_as_of_is_the_plain_rule_with_a_hot_key(spark, parts):
    rng = random.Random(8)
    key = lambda: "hot" if rng.random() < 0.4 else rng.choice([*"abcdef", None])
    versions = [(key(), rng.choice([None, *range(60)]), i) for i in range(300)]
    events = [(i, key(), rng.choice([None, *range(70)])) for i in range(900)] + [(5000, "hot", 3)] * 3
    v = spark.createDataFrame(versions, "k string, since int, n int").repartition(3)
    e = spark.createDataFrame(events, "e int, k string, at int").repartition(3)
    got = as_of(e, v, ["k"], "at", "since", parts=parts).collect()

    def plain(k, at):
        fit = [(s, n) for kk, s, n in versions if k is not None and at is not None and kk == k and s is not None and s <= at]
        return max(fit) if fit else None

    assert len(got) == len(events)
    assert sorted(((r.e, (r.version.since, r.version.n) if r.version else None) for r in got), key=str) == sorted(
        ((i, plain(k, at)) for i, k, at in events), key=str)


def test_as_of_with_nothing(spark):
    v = spark.createDataFrame([], "k string, since int, n int")
    e = spark.createDataFrame([(1, "a", 2)], "e int, k string, at int")
    assert [(r.e, r.version) for r in as_of(e, v, ["k"], "at", "since").collect()] == [(1, None)]
    assert as_of(e.limit(0), v, ["k"], "at", "since").collect() == []


# --- zone repair --------------------------------------------------------------------------------

VALUE = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
OTHER = {a: b for pair in LOOK_ALIKES for a, b in (pair, pair[::-1])}
TO_DIGIT = dict(LOOK_ALIKES)


def icao(text):
    return str(sum(VALUE.get(c, 0) * (7, 3, 1)[i % 3] for i, c in enumerate(text)) % 10)


def right_zone(rng):
    number = "".join(rng.choice("ABIOS0123456789") for _ in range(rng.randrange(6, 10))).ljust(9, "<")
    dob, expiry = (f"{rng.randrange(100):02d}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}" for _ in range(2))
    optional = rng.choice(["<" * 14, "12AB".ljust(14, "<")])
    a, b, c = number + icao(number), dob + icao(dob), expiry + icao(expiry)
    d = optional + (rng.choice(["<", "0"]) if set(optional) == {"<"} else icao(optional))
    return a + "IND" + b + "M" + c + d + icao(a + b + c + d)


def checks(z):
    digit = lambda s, n, e=False: icao(z[s:s + n]) == z[s + n] or e and z[s + n] == "<" and set(z[s:s + n]) == {"<"}
    return len(z) == 44 and digit(0, 9) and digit(13, 6) and digit(21, 6) and digit(28, 14, True) and icao(z[:10] + z[13:20] + z[21:43]) == z[43]


def plain_repair(z):
    """Every reading of every field."""
    if checks(z):
        return z, 0, "valid"
    made, changes = z[43:].translate(str.maketrans(TO_DIGIT)), int(z[43] in TO_DIGIT)
    parts = []
    for start, n, kind in ((0, 9, "mixed"), (13, 6, "digits"), (21, 6, "digits"), (28, 14, "mixed")):
        data, digit = z[start:start + n], TO_DIGIT.get(z[start + n], z[start + n])
        if start == 28 and z[start:start + n + 1] == "<" * 15:
            parts.append(z[start:start + n + 1])
            continue
        options = [{c, OTHER.get(c, c)} if kind == "mixed" else {TO_DIGIT.get(c, c)} for c in data]
        fit = {}
        for reading in map("".join, itertools.product(*options)):
            if icao(reading) == digit and (kind == "mixed" or set(reading) <= set("0123456789<")):
                fit.setdefault(sum(a != b for a, b in zip(reading, data)), []).append(reading)
        if not fit or len(fit[min(fit)]) > 1:
            return z, 0, "unrepaired"
        parts.append(fit[min(fit)][0] + digit)
        changes += min(fit) + (digit != z[start + n])
    whole = parts[0] + z[10:13] + parts[1] + z[20] + parts[2] + parts[3] + made
    return (whole, changes, "repaired") if checks(whole) else (z, 0, "unrepaired")


def test_zone_repair_is_brute_force_and_recovers_planted_errors(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        z = right_zone(rng)
        at = [p for p in range(44) if z[p] in OTHER and p not in (10, 11, 12, 20)]
        misread = list(z)
        for p in rng.sample(at, min(len(at), i % 4)):
            misread[p] = OTHER[z[p]]
        if i % 10 == 9:
            misread[rng.randrange(44)] = rng.choice("7Q<")
        rows.append((i, z, "".join(misread)))
    got = {r.i: r for r in repair_zones(spark.createDataFrame(rows, "i int, z string, line2 string")).collect()}
    for i, _, misread in rows:
        assert (got[i].repair.line, got[i].repair.changes, got[i].repair.state) == plain_repair(misread), misread
    one = [i for i, z, m in rows if i % 4 == 1 and i % 10 != 9 and z != m]
    assert sum(got[i].repair.line == got[i].z for i in one) > 0.85 * len(one)


def test_zone_repair_of_short_empty_and_missing_lines(spark):
    got = repair_zones(spark.createDataFrame([("",), ("A1",), (None,), ("<" * 44,)], "line2 string")).collect()
    assert [tuple(r.repair) if r.repair else None for r in got][:3] == [("", 0, "unrepaired"), ("A1", 0, "unrepaired"), None]


# --- streams -------------------------------------------------------------------------------------


def minutes(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


CAPTURES = "session_id bigint, capture_id string, seq bigint, side string, captured_at timestamp"


def test_pairs_leave_at_once_and_lone_sides_after_the_gap(spark):
    slices = [
        [(1, "a", 1, "front", minutes(0)), (2, "b", 2, "front", minutes(0)), (4, "x", 9, "single", minutes(0))],
        [(1, "c", 3, "back", minutes(10)), (3, "d", 4, "back", minutes(300))],  # the pair of 1 came over two batches
        [(2, "e", 5, "back", minutes(310)), (3, "f", 6, "back", minutes(310)), (3, "g", 7, "front", minutes(320)), (1, "late", 8, "front", minutes(1))],
        [(-1, "z", 99, "front", minutes(10_000))],
    ]
    frames = [{"captures": spark.createDataFrame(s, CAPTURES)} for s in slices]
    seen = []
    path = scratch_path(spark, "pairs")
    with rocksdb_state(spark):
        for some in frames:
            some["captures"].write.mode("append").parquet(f"{path}/captures")
            out = pair_sides(jobs.read_stream(spark, f"{path}/captures", some["captures"].schema))
            jobs.run_to_files(out, f"{path}/out", f"{path}/state")
            seen.append({(r.session_id, r.front_capture, r.back_capture, r.state) for r in spark.read.schema(out.schema).parquet(f"{path}/out").collect()})
        held = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "waiting").load()
        left = [r.key.session_id for r in held.collect()]
    assert seen[0] == set()
    assert seen[1] == {(1, "a", "c", "pair"), (2, "b", None, "alone")}  # the second batch moves the watermark past 2's gap
    assert seen[2] == seen[1] | {(3, None, "d", "alone"), (3, "g", "f", "pair")}
    assert seen[3] == seen[2] | {(2, None, "e", "alone")}
    assert left == [-1]  # nothing waits but the row that closed the stream


def test_repeats_within_the_delay_go_and_later_ones_come_out(spark):
    schema = "k string, captured_at timestamp"
    slices = [[("a", minutes(0)), ("a", minutes(5)), ("clock", minutes(200))], [("a", minutes(300)), ("b", minutes(301)), ("a", minutes(302))]]
    out = jobs.fed(spark, [{"s": spark.createDataFrame(s, schema)} for s in slices], lambda s: jobs.drop_duplicates(s["s"], ["k"]).select("k"), "repeats")
    assert sorted(r.k for r in out.collect()) == ["a", "a", "b", "clock"]


def test_text_and_payload_streams_report_each_text_once(spark):
    struct = spark.createDataFrame([(("A", "1", None, None, None),)], "f struct<name:string,dob:string,aadhaar_number:string,dl_number:string,passport_number:string>").schema["f"].dataType.simpleString()
    texts = [(i, ("Asha Rao", "01/01/1990", None, None, None), minutes(i * 100)) for i in range(6)]
    good = 'name="Asha Rao" dob="01/01/1990"'
    codes = {0: minutes(5), 1: minutes(109), 2: minutes(230), 3: minutes(300)}  # 2 is outside the interval, 3 arrives late
    t = lambda ids: spark.createDataFrame([r for r in texts if r[0] in ids], f"doc_id bigint, fields {struct}, read_at timestamp")
    c = lambda ids: spark.createDataFrame([(i, good, codes[i]) for i in ids], "doc_id bigint, payload string, decoded_at timestamp")
    end = spark.createDataFrame([(-1, texts[0][1], minutes(99_999))], f"doc_id bigint, fields {struct}, read_at timestamp")
    end_code = spark.createDataFrame([(-1, good, minutes(99_999))], "doc_id bigint, payload string, decoded_at timestamp")
    slices = [{"t": t({0, 1, 2}), "c": c([0])}, {"t": t({3, 4, 5}), "c": c([1, 2]).unionByName(end_code.withColumn("decoded_at", F.lit(minutes(600))))}, {"t": end, "c": end_code}, {"t": end.limit(0), "c": c([3])}]
    out = jobs.fed(spark, slices, lambda s: jobs.cross_check_streams(s["t"], s["c"], ["doc_id"]).select("doc_id", "qr_check.qr_detected"), "apart")
    assert sorted((r.doc_id, r.qr_detected) for r in out.where("doc_id >= 0").collect()) == [(0, True), (1, True), (2, False), (3, False), (4, False), (5, False)]


def test_pairing_reads_and_writes_its_state_once_a_batch(spark):
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    stream, calls = MagicMock(), []
    pair_sides(stream)
    made = stream.withWatermark().where().select().groupBy().transformWithState.call_args.kwargs["statefulProcessor"]
    kept = {}

    class State:
        def exists(self):
            return "v" in kept

        def get(self):
            return kept["v"]

        def update(self, v):
            calls.append("update")
            kept["v"] = v

        def clear(self):
            calls.append("clear")
            kept.clear()

    timers = set()
    handle = SimpleNamespace(getValueState=lambda *_: State(), registerTimer=lambda t: (calls.append("timer"), timers.add(t)), deleteTimer=lambda t: (calls.append("delete"), timers.remove(t)))
    made.init(handle)
    gap = 30 * 60 * 1000
    row = lambda i, side, ms: SimpleNamespace(capture_id=f"c{i}", side=side, ms=ms, seq=i)
    first = list(made.handleInputRows((7,), iter([row(i, "front", i) for i in range(100)][::-1]), None))
    assert [r.front_capture for r in first] == [f"c{i}" for i in range(99)] and {r.state for r in first} == {"alone"}
    assert kept["v"] == ("c99", "front", 99) and timers == {99 + gap} and calls == ["update", "timer"]  # four a row before
    assert [tuple(r) for r in made.handleInputRows((7,), iter([row(200, "back", 99 + gap)]), None)] == [(7, "c99", "c200", 99, "pair")]
    assert not kept and not timers and calls[2:] == ["delete", "clear"]
    assert list(made.handleInputRows((7,), iter([row(300, "back", 5)]), None)) == [] and timers == {5 + gap}
