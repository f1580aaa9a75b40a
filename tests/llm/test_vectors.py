"""Clusters and neighbours against brute force."""

import glob
import time

import numpy as np
import pytest

from simlode.llm import clusters as C
from simlode.llm import neighbours as N
from simlode.session import shared_root
from simlode.sources import files

DIM = 64


def data(seed=0, groups=12, single=60):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = r.standard_normal(DIM)
        centre /= np.linalg.norm(centre)
        for _ in range(r.integers(2, 30)):
            rows.append((centre + 0.04 * r.standard_normal(DIM)) * r.uniform(0.01, 100))
    rows += [r.standard_normal(DIM) for _ in range(single)]
    rows += [rows[0]] * 7 + [rows[-1]] * 5 + [rows[3] * 2]
    order = r.permutation(len(rows))
    return [(int(i + 1), [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(order)]


BAD = [(9001, None), (9002, [0.0] * DIM), (9003, [1.0] * 63), (9004, [float("nan")] + [1.0] * 63), (9005, [float("inf")] * DIM), (None, [1.0] * DIM), (9006, []), (9007, [None] + [1.0] * 63), (9008, [1.0] * 65)]
SCHEMA = "request_no long, vector array<float>, n string, v int, density string"


def table(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1, "y") for a, b in rows], SCHEMA)


def cosines(rows):
    x = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def true_clusters(rows):
    near = cosines(rows) >= C.SIMILAR
    sets = [tuple(np.flatnonzero(x)) for x in near]
    return {(rows[min(s)][0], rows[i][0]) for i, s in enumerate(sets) if len(s) >= C.SMALLEST and all(sets[j] == s for j in s)}


def test_clusters_match_brute_force(spark):
    rows = data()
    got = C.clustered(table(spark, rows + BAD), components=(2, 4, 8)).collect()
    truth = true_clusters(rows)
    assert {(r.first_no, r.member_no) for r in got} == truth and len(got) == len(truth)
    shown = {r.first_no: r for r in C.described(C.clustered(table(spark, rows))).collect()}
    for first, r in shown.items():
        members = {m for f, m in truth if f == first}
        assert r["size"] == len(members) and len(r.typical) == 3 and set(r.typical) <= members


def test_clusters_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 40)
    monkeypatch.setattr(C, "HOT_RECORDS", 3)
    rows = data(3)
    t = table(spark, rows)
    assert {(r.first_no, r.member_no) for r in C.clustered(t, components=(2,)).collect()} == true_clusters(rows)
    assert {(r.first_no, r.member_no) for r in C.clustered(t, exact=True).collect()} == true_clusters(rows)


def test_lots_hold_every_cell_once(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 10)
    homes, asked = {0: 95, 1: 3, 2: 40}, {0: 200, 1: 60, 3: 7, 2: 10}
    got = list(C.lots(homes, asked, 50))
    cells = [c for lot in got for c in lot]
    assert sorted(cells) == [(p, h, q) for p in range(3) for h in range(-(-homes[p] // 10)) for q in range(-(-asked[p] // 10))]
    assert len(got) > 50 and max(map(len, got)) <= 5 and list(C.lots(homes, asked, 1)) == [[c] for c in cells]
    assert len(list(C.lots(homes, asked, 10**6))) == 1 and list(C.lots({}, {}, 10)) == []


def test_clusters_leave_no_copies_on_disk(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 40)
    monkeypatch.setattr(C, "LOT_ROWS", 1)
    rows = data(3)
    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    shared_root(spark)
    shared = lambda: set(files.children(spark, shared_root(spark)))
    # The files of every query are gone before the next that writes much, and at the end.
    old, kept, settle, left = shuffled(), shared(), C.settle, []

    def watched(*args, **kw):
        for _ in range(50):  # files are deleted in the background
            if not shuffled() - old:
                break
            time.sleep(0.1)
        left.append(len(shuffled() - old))
        return settle(*args, **kw)

    monkeypatch.setattr(C, "settle", watched)
    members = C.clustered(table(spark, rows), components=(2,))
    assert left == [0] * len(left) and len(left) > 4  # several lots
    assert {x.split("-")[0] for x in shared() - kept} == {"sets"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert {(r.first_no, r.member_no) for r in members.collect()} == true_clusters(rows)


def test_numbers_of_components():
    assert C.numbers_of_components(0) == (4, 8, 16) and C.numbers_of_components(88_000) == (128, 256, 512)
    assert C.numbers_of_components(10**9)[-1] == C.MOST_COMPONENTS


def test_chain_is_no_cluster(spark):
    base, side = np.eye(DIM)[0], np.eye(DIM)[1]
    rows = [(i, [float(x) for x in np.cos(0.2 * i) * base + np.sin(0.2 * i) * side]) for i in range(1, 8)]
    assert C.clustered(table(spark, rows)).collect() == []


def test_all_equal_and_empty(spark):
    rows = [(i, [1.0] * DIM) for i in range(1, 200)]
    got = C.clustered(table(spark, rows)).collect()
    assert {(r.first_no, r.member_no) for r in got} == {(1, i) for i in range(1, 200)}
    signs = [(i, [x * (-1.0 if i % 2 else 1.0) if x == 0 else x for x in [0.0, 1.0] * 32]) for i in range(1, 9)]
    assert len(C.clustered(table(spark, signs)).collect()) == 8 and C.distinct_vectors(table(spark, signs), "request_no", "vector", DIM).count() == 1
    assert C.clustered(table(spark, rows[:4])).collect() == []
    assert C.clustered(table(spark, [])).collect() == [] and C.clustered(table(spark, BAD)).collect() == []


def requests(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "query_id string, vector array<float>, top_k int, k string")


def true_neighbours(rows, asked):
    out = set()
    for q, v, k in asked:
        x = np.array([np.array(w, np.float32).astype(float) for _, w in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = np.array(v, np.float32).astype(float)
        c = np.round(x @ (y / np.linalg.norm(y)), N.PLACES)
        for i in sorted(range(len(rows)), key=lambda i: (-c[i], rows[i][0]))[: 5 if k is None else k]:
            if c[i] >= N.FLOOR:
                out.add((q, rows[i][0]))
    return out


def test_neighbours_match_brute_force(spark):
    rows = data(1)
    asked = [(f"q{i}", rows[i][1], k) for i, k in enumerate([None, 1, 3, 5, 10, 50, 1000] * 8)]
    refused = [("z0", rows[0][1], 0), ("z1", rows[0][1], -1), ("z2", None, 5), ("z3", [0.0] * DIM, 5), ("z4", [1.0], 5)]
    got = N.most_similar(table(spark, rows + BAD), requests(spark, asked + asked[:3] + refused)).collect()
    found = {(r.query_id, r.request_no) for r in got}
    truth = true_neighbours(rows, asked)
    assert found <= truth and len(found) >= 0.99 * len(truth) and len(found) == len(got)
    assert {(r.query_id, r.place) for r in got if r.place == 1} == {(q, 1) for q, _ in truth}


def test_neighbours_ties_go_to_the_smaller_number(spark):
    rows = [(i, [1.0] + [0.0] * 63) for i in range(50, 0, -1)]
    got = N.most_similar(table(spark, rows), requests(spark, [("a", [2.0] + [0.0] * 63, 3), (None, [1.0] + [0.0] * 63, 1)])).collect()
    assert sorted((r.query_id or "", r.place, r.request_no) for r in got) == [("", 1, 1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3)]


@pytest.mark.parametrize("empty", ["rows", "queries", "both"])
def test_neighbours_of_nothing(spark, empty):
    rows = [] if empty != "queries" else data(1)[:5]
    asked = [] if empty != "rows" else [("a", [1.0] * DIM, 5)]
    assert N.most_similar(table(spark, rows), requests(spark, asked)).collect() == []


def crowd(seed=2, groups=60, each=20):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, DIM))
    rows = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), each, axis=0) + 0.045 * r.standard_normal((groups * each, DIM))
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def pairs(df):
    return {(r.query_id, r.request_no) for r in df.collect()}


def test_neighbours_in_split_keys_and_exactly(spark, monkeypatch):
    rows = crowd() + [(10_000 + i, [1.0] + [0.0] * 63) for i in range(300)]
    asked = [(f"q{i}", v, 20) for i, v in rows[::20]]
    truth = true_neighbours(rows, asked)
    t, a = table(spark, rows), requests(spark, asked)
    assert pairs(N.most_similar(t, a, exact=True)) == truth
    whole = pairs(N.most_similar(t, a))
    assert whole <= truth and len(whole) >= 0.99 * len(truth)
    assert pairs(N.most_similar(t, a, row_block=50, query_block=7)) == whole
    monkeypatch.setattr(N, "BROADCAST_COMPONENTS", DIM * 10)
    assert pairs(N.most_similar(t, a)) == whole


def test_windows_hold_little_and_miss_little():
    r = np.random.default_rng(5)
    x = r.standard_normal((4000, DIM))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((4000, DIM))
    y -= (x * y).sum(1, keepdims=True) * x
    y = N.FLOOR * x + np.sqrt(1 - N.FLOOR**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    inside = lambda q, v: (N.windows(q) == N.keys(v)[:, :, None]).any((1, 2))
    assert inside(x, y).mean() >= 0.99  # at the very floor
    assert inside(x, np.roll(x, 1, axis=0)).mean() <= 0.02


@pytest.mark.parametrize("dimension", [1, 2, 3, 8, 100])
def test_neighbours_of_other_dimensions(spark, dimension):
    r = np.random.default_rng(dimension)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(dimension)]) for i in range(200)]
    asked = [(f"q{i}", [x * 3 for x in rows[i][1]], 8) for i in range(0, 200, 5)]
    got = pairs(N.most_similar(table(spark, rows), requests(spark, asked), dimension=dimension))
    truth = true_neighbours(rows, asked)
    assert len(got & truth) >= 0.97 * len(truth) and len(got) <= len(truth)
