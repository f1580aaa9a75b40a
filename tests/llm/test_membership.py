import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simlode.llm import membership as M
from simlode.session import settle

SCHEMA = "request_no long, id string, n string, h string, k string"
STORED = "id string, part int, first int"


def run(spark, rows, stored):
    r = spark.createDataFrame([(i, k, "x", "y", "z") for i, k in rows], SCHEMA)
    s = spark.createDataFrame([(k, 1, 2) for k in stored], STORED)
    flagged = M.seen_before(r, s, "request_no", "id")
    checked = M.confirmed(r, s, flagged, "request_no", "id")
    return {x.n for x in flagged.collect()}, {x.n for x in checked.where("right").collect()}, M.audit(r, "id", flagged, checked).first()


def brute(rows, stored):
    seen, out = {k for k in stored if k}, set()
    for n, k in sorted(rows):
        if k:
            if k in seen:
                out.add(n)
            seen.add(k)
    return out


CASES = {
    "plain": ([(1, "a"), (2, "b"), (3, "a"), (4, "c")], ["c", "c", None, ""]),
    "nulls and empties": ([(1, None), (2, None), (3, ""), (4, "")], [None, ""]),
    "hot key": ([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], ["k0"]),
    "case and accents": ([(1, "é"), (2, "e"), (3, "É"), (4, "é"), (5, "é ")], ["e"]),
    "very long": ([(1, "x" * 100_000), (2, "x" * 100_000), (3, "x" * 99_999)], []),
    "empty stream": ([], ["a"]),
    "empty store": ([(5, "a"), (2, "a")], []),
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    rows, stored = CASES[case]
    flagged, found, report = run(spark, rows, stored)
    assert found == brute(rows, stored)
    assert found <= flagged
    assert report.asked == sum(bool(k) for _, k in rows) and report.wrong == len(flagged) - len(found)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=400), st.integers(1, 64))
def test_filter_has_no_false_negatives_and_deletes(keys, expected):
    f = M.CuckooFilter(expected)
    h = np.array(keys, np.int64)
    f.add(h)
    assert len(f) == len(h)
    assert f.contains(h).all() if len(h) else True
    for x in keys[::2]:
        assert f.remove(x)
    left = np.array(keys[1::2], np.int64)
    assert len(f) == len(left)
    assert f.contains(left).all() if len(left) else True


def test_filter_grows_and_rarely_errs():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 60_000, dtype=np.int64))
    f = M.CuckooFilter(1000)
    for part in np.array_split(keys, 20):
        f.add(part)
    assert len(f.tables) > 1 and f.contains(keys).all()
    other = rng.integers(-(2**63), 2**63 - 1, 50_000, dtype=np.int64)
    assert f.contains(other[~np.isin(other, keys)]).mean() < 0.003
    assert f.bytes < 8 * len(keys)


def test_remove_of_absent_key():
    assert not M.CuckooFilter().remove(12)


def test_removal_loses_no_other_key():
    rng = np.random.default_rng(3)
    keys = rng.permutation(np.unique(rng.integers(-(2**63), 2**63 - 1, 200_000, dtype=np.int64)))
    f = M.CuckooFilter(2000)
    known = np.zeros(len(keys), bool)
    for at in range(0, len(keys), 10_000):
        part = slice(at, at + 10_000)
        known[part] = M.answer_part(keys[part], np.arange(len(keys))[part], f)
    f.add(keys[known])  # wrongly taken for seen
    assert known.sum() > 10 and f.contains(keys).all() and len(f) == len(keys)
    gone = keys[rng.permutation(len(keys))[:20_000]]
    for h in gone.tolist():
        assert f.remove(h)
    left = keys[~np.isin(keys, gone)]
    assert f.contains(left).all() and len(f) == len(left) and f.contains(gone).mean() < 0.01
    assert len(f.dropped) and len(f.dropped) < 0.01 * len(gone)
    again = M.CuckooFilter.unpacked(f.packed())
    assert again.contains(left).all() and len(again) == len(left)
    again.add(gone)
    assert again.contains(keys).all() and len(again) == len(keys)


def test_kept_tables(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame([(i, k, "x", "y", "z") for i, k in rows], SCHEMA)
    numbers = lambda df: {r.n for r in df.collect()}
    store = M.KeyTables(spark, f"{tmp_path}/keys", parts=3)
    store.add(spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",)], "id string"), "id")
    first = frame([(1, "a"), (2, "c"), (3, "c"), (4, None), (None, "a")] + [(i, f"k{i}") for i in range(10, 300)])
    assert numbers(store.seen(first, "request_no", "id")) == {1, 3}
    # Another session of the same store; it reads no earlier key.
    store = M.KeyTables(spark, f"{tmp_path}/keys")
    assert store.parts == 3 and store.manifest()["version"] == 2
    second = frame([(1001, "c"), (1002, "d"), (1003, "k10"), (1004, "k9999"), (1005, "b")])
    assert numbers(store.seen(second, "request_no", "id")) == {1001, 1003, 1005}
    store.remove(spark.createDataFrame([("c",), ("c",), ("k10",), ("never",)], "id string"), "id")
    third = frame([(2001, "c"), (2002, "k10"), (2003, "k11"), (2004, "d"), (2005, "a")])
    assert numbers(store.seen(third, "request_no", "id")) == {2003, 2004, 2005}
    one = M.KeyTables(spark, f"{tmp_path}/keys").manifest()
    store.add(spark.createDataFrame([("one more",)], "id string"), "id")
    assert sum(one["files"][p] != f for p, f in store.manifest()["files"].items()) == 1  # only the touched partition
    store.vacuum()
    assert numbers(store.seen(frame([(3001, "one more"), (3002, "k12"), (3003, "k10"), (3004, "new")]), "request_no", "id")) == {3001, 3002, 3003}


def test_wrong_answers_are_absorbed_and_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M.CuckooFilter, "parts", staticmethod(lambda h: ((np.asarray(h, np.int64) & 0xFF).astype(np.int64), (np.abs(np.asarray(h, np.int64) >> 48) % 31 + 1).astype(np.uint16))))
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    f = M.CuckooFilter(100)
    wrong = M.answer_part(hashes, np.arange(3000), f, step=200)
    f.add(hashes[wrong])
    for h in hashes[::3].tolist():
        f.remove(h)
    left = np.delete(hashes, np.s_[::3])
    assert wrong.sum() > 100 and f.contains(left).all()
    rows = spark.createDataFrame([(i, f"k{i}", "x", "y", "z") for i in range(500)], SCHEMA)
    store = M.KeyTables(spark, f"{tmp_path}/keys", parts=2)
    flagged = settle(store.seen(rows, "request_no", "id"))
    checked = M.confirmed(rows, spark.createDataFrame([], STORED), flagged.unionByName(spark.createDataFrame([(7,), (8,)], "n long")), "request_no", "id")
    assert {r.n for r in checked.where("NOT right").collect()} >= {7, 8}
    before = store.manifest()["version"]
    store.absorb(rows, "request_no", "id", checked)
    assert store.manifest()["version"] == before + 1
