"""Packing against a plain best-fit, and its invariants."""

import math
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm.packing import RoomTree, best_fit, pack


def plain_best_fit(sizes, capacity):
    used, out = [], []
    for s in sizes:
        fits = [(capacity - u, i) for i, u in enumerate(used) if capacity - u >= s]
        i = min(fits)[1] if fits else len(used)
        if not fits:
            used.append(0)
        used[i] += s
        out.append(i)
    return used, out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70), st.data())
def test_rooms_match_a_plain_best_fit(capacity, data):
    sizes = sorted(data.draw(st.lists(st.integers(0, capacity), max_size=60)), reverse=True)
    got = best_fit(sizes, capacity)
    used = defaultdict(int)
    for (box, place, start), s in zip(got, sizes, strict=True):
        assert start == used[box]
        used[box] += s
        assert used[box] <= capacity
    assert sorted(used.values()) == sorted(plain_best_fit(sizes, capacity)[0])


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(0, 40), max_size=30), st.integers(0, 40))
def test_tree_finds_the_least_sufficient_room(capacity, rooms, size):
    tree = RoomTree(capacity)
    rooms = [r for r in rooms if r <= capacity]
    for r in rooms:
        tree.add(r, 1)
    size = min(size, capacity)
    assert tree.least(size) == min((r for r in rooms if r >= size), default=-1)


def test_pack(spark):
    sizes = [0, None, 1, 5, 10, 10, 11, 25, 20, 3, 3, 7]
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)] + [(None, 4, "x"), (3, 5, "twice")], "id bigint, size bigint, shard string")
    out = pack(df, 10, shard_rows=5).collect()
    total, boxes = defaultdict(int), defaultdict(list)
    for r in out:
        total[r.id] += r.size
        boxes[r.container].append((r.place, r.start, r.size))
        assert r.piece == 0 or (sizes[r.id] or 0) > 10
    assert total == {**{i: s or 0 for i, s in enumerate(sizes)}, None: 4, 3: 10}
    for items in boxes.values():
        items.sort()
        assert [p for p, _, _ in items] == list(range(len(items)))
        at = 0
        for _, start, size in items:
            assert start == at
            at += size
        assert at <= 10
    assert {(r.piece, r.size) for r in out if r.id == 7} == {(0, 10), (1, 10), (2, 5)}
    assert {(r.piece, r.size) for r in out if r.id == 8} == {(0, 10), (1, 10)}


def test_little_room_is_left(spark):
    import random

    rng = random.Random(1)
    sizes = [min(5000, int(rng.lognormvariate(6, 1))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint")
    boxes = pack(df, 2048, shard_rows=2000).select("container").distinct().count()
    assert boxes <= math.ceil(sum(sizes) / 2048) * 1.01 + 4


def test_empty_and_bad_input(spark):
    df = spark.createDataFrame([], "id bigint, size bigint")
    assert pack(df, 10).collect() == []
    with pytest.raises(ValueError):
        pack(df, 0)
    with pytest.raises(Exception, match="negative size"):
        pack(spark.createDataFrame([(1, -1)], "id bigint, size bigint"), 10).collect()
