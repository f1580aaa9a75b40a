"""Deduplication and the change table against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from simlode.operators.change_table import ChangeTable
from simlode.operators.redelivery import keep_first, later_copies, unseen
from simlode.session import work_path
from simlode.sources import files

LINE = "seq long, shard string, id string, ts double, o0 string, f int, k0 string"


def lines(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], LINE)


def random_lines(n, seed=0):
    r = random.Random(seed)
    return [(i, r.choice(["a", "b", None]), r.choice(["x", "y", "", None]), r.choice([1.0, 2.0, None, float("nan")])) for i in range(n)]


def brute_first(rows):
    seen, keep = set(), []
    for seq, shard, key, ts in sorted(rows):
        k = (shard, key, "nan" if ts != ts else ts)
        if ts is None or k not in seen:
            keep.append(seq)
        seen.add(k)
    return keep


@pytest.mark.parametrize("n", [0, 1, 300])
def test_one_copy_of_each_stays(spark, n):
    rows = random_lines(n)
    df = lines(spark, rows)
    kept = keep_first(df, ["shard", "id", "ts"], ["seq"], ["ts"])
    assert kept.columns == df.columns
    assert sorted(r.seq for r in kept.collect()) == brute_first(rows)
    assert sorted(r.seq for r in later_copies(df, ["shard", "id", "ts"], ["seq"], ["ts"]).collect()) == sorted({r[0] for r in rows} - set(brute_first(rows)))


def test_a_third_of_all_rows_is_one_message(spark):
    rows = [(i, "a", "hot" if i % 3 == 0 else f"k{i}", 1.0) for i in range(3000)]
    got = later_copies(lines(spark, rows), ["shard", "id", "ts"], ["seq"], ["ts"]).count()
    assert got == 999


def test_new_batch_against_stored(spark):
    rows = random_lines(300, 1)
    old, new = rows[:200], rows[200:]
    got = unseen(lines(spark, new), lines(spark, old), ["shard", "id", "ts"], ["seq"], ["ts"])
    assert sorted(r.seq for r in got.collect()) == [s for s in brute_first(rows) if s >= 200]


def changes(spark, rows):
    return spark.createDataFrame(rows, "grp string, key string, kind string, ts double, seq long, v int")


def brute_state(rows):
    good = [r for r in rows if r[3] is not None and r[3] == r[3] and r[2] in ("put", "del", "clear") and (r[2] == "clear" or r[1] is not None)]
    state = {}
    first = {}
    for g, k, kind, ts, seq, v in good:
        key = (g, None if kind == "clear" else k, kind == "clear", ts)
        if key not in first or seq < first[key][4]:
            first[key] = (g, k, kind, ts, seq, v)
    # Of one time, puts and deletes come before or after a clear by their sequence.
    for g, k, kind, ts, seq, v in sorted(first.values(), key=lambda r: (r[3], r[4])):
        if kind == "clear":
            state = {x: y for x, y in state.items() if x[0] != g}
        elif kind == "put":
            state[g, k] = (seq, v)
        else:
            state.pop((g, k), None)
    return {(g, k, s, v) for (g, k), (s, v) in state.items()}


CHANGE = st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", "z", None]), st.sampled_from(["put", "put", "del", "clear", "noop", None]), st.sampled_from([1.0, 2.0, 3.0, 4.0, None, float("nan")]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(CHANGE, max_size=25), st.integers(1, 3), st.randoms(use_true_random=False))
def test_any_order_and_repeats_give_one_state(spark, given_rows, batches, rng):
    rows = [(*r, i, i * 10) for i, r in enumerate(given_rows)]
    sent = rows + rows[::3]
    rng.shuffle(sent)
    table = ChangeTable(spark, work_path(spark, "t"), 3, T.StructType([T.StructField("v", T.IntegerType())]))
    for b in range(batches):
        table.apply(changes(spark, sent[b::batches]))
    assert {(r.grp, r.key, r.seq, r.v) for r in table.rows().collect()} == brute_state(rows)


def test_versions_touched_buckets_and_vacuum(spark):
    path = work_path(spark, "t")
    schema = T.StructType([T.StructField("v", T.IntegerType())])
    table = ChangeTable(spark, path, 8, schema)
    assert table.version() == 0 and table.rows().collect() == []
    table.apply(changes(spark, [("g", f"k{i}", "put", 1.0, i, i) for i in range(40)]))
    before = table.manifest()["files"]
    table.apply(changes(spark, [("g", "k1", "del", 2.0, 100, None)]))
    after = table.manifest()["files"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert table.rows().count() == 39 and table.rows(1).count() == 40
    assert ChangeTable(spark, path, 99, schema).buckets == 8
    table.vacuum()
    assert table.rows().count() == 39 and [x for x in files.children(spark, f"{path}/manifests")] == ["0000000002.json"]
    with pytest.raises(FileExistsError):
        files.commit_json(spark, f"{path}/manifests/0000000002.json", {})


def test_reserved_payload_names(spark):
    with pytest.raises(ValueError):
        ChangeTable(spark, work_path(spark, "t"), 2, T.StructType([T.StructField("ts", T.IntegerType())]))


def test_buckets_grow_with_the_table(spark):
    store = ChangeTable(spark, work_path(spark, "grow"), 2, rows_a_bucket=10)
    rows = []
    for batch in range(6):
        rows += [("g", f"k{(batch * 17 + i) % 70}", "put" if i % 5 else "del", float(batch), batch * 100 + i) for i in range(25)]
        store.apply(spark.createDataFrame(rows[-25:], "grp string, key string, kind string, ts double, seq long"))
    want = {k: s for _, k, kind, _, s in rows if kind == "put"}
    last = {k: (kind, s) for _, k, kind, _, s in rows}
    assert {r.key: r.seq for r in store.rows().collect()} == {k: s for k, (kind, s) in last.items() if kind == "put"} and want
    assert store.buckets >= 8 and ChangeTable(spark, store.path).buckets == store.buckets
    store.vacuum()
    assert store.rows().count() == sum(kind == "put" for kind, _ in last.values())
