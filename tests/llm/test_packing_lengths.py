"""Lengths of bins by the load that they would reach."""

import random

from gridloom.llm import packing


def cost(lengths):
    return sum(packing.open_cost(x, 1) for x in lengths)


def test_larger_lengths_are_opened_where_they_fill_better():
    sizes = [300] * 2000
    where, load, length = packing.joint_fit(sizes)
    assert length.count(1024) == 666 and sum(load) == sum(sizes)
    assert cost(length) < 0.7 * cost(packing.best_fit(sizes)[2])


def test_bins_below_their_plan_are_downsized():
    lengths = (8, 16, 32, 64, 128)
    _, load, opened = packing.planned_fit([84, 33, 2, 5, 1, 38, 22, 4, 5, 41, 9, 15, 58, 8], lengths)
    final = packing.downsized(load, lengths)
    assert sum(final) < sum(opened) and all(a <= b for a, b in zip(load, final))


def test_a_packing_is_whole_and_never_dearer():
    for seed in range(30):
        rng = random.Random(seed)
        kinds = [rng.randrange(1, 4097) for _ in range(rng.randrange(1, 6))]
        sizes = [rng.choice(kinds) for _ in range(200)]
        where, load, length = packing.joint_fit(sizes)
        held = [0] * len(load)
        for x, b in zip(sizes, where):
            held[b] += x
        assert held == load and all(a <= b for a, b in zip(load, length))
        assert cost(length) <= cost(packing.best_fit(sizes)[2])


def test_final_downsizing_lowers_the_cost():
    rng = random.Random(7)
    shrunk = 0
    for _ in range(20):
        sizes = [rng.randrange(600, 4097) for _ in range(60)]
        for k in range(len(packing.LENGTHS)):
            _, load, length = packing.best_fit(sizes, packing.LENGTHS[k:])
            final = packing.downsized(load)
            shrunk += sum(a < b for a, b in zip(final, length))
            assert cost(packing.joint_fit(sizes)[2]) <= cost(final) <= cost(length)
    assert shrunk > 10


def test_each_single_length_is_dearer():
    rng = random.Random(3)
    sizes = [rng.choice([150, 300, 700, 1300]) for _ in range(500)]
    joint = packing.joint_fit(sizes)[2]
    assert len(set(joint)) > 1
    for k, length in enumerate(packing.LENGTHS):
        if length >= max(sizes):
            load = packing.best_fit(sizes, packing.LENGTHS[k : k + 1])[1]
            assert cost(joint) < cost([length] * len(load))


def test_packing_is_the_same_however_the_rows_are_split(spark):
    rows = [(i, "w " * (i % 50 * 7)) for i in range(300)] + [(7, "same words here")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, packing.pack(df.repartition(n), block_rows=100).collect())) for n in (1, 6))
    assert one == many and len({r[4] for r in one if r[0] == 7}) > 2  # equal rows are in several blocks
