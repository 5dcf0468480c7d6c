"""planned_fit against a plain version, and the packing again of the emptiest bins."""

import random
from collections import Counter

import pytest
from gridloom.llm import packing


def plain_planned_fit(sizes, lengths):
    free, planned = Counter(sizes), Counter()
    where, load, length = [0] * len(sizes), [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        (planned if planned[size] else free)[size] -= 1
        fits = [b for b in range(len(load)) if length[b] - load[b] >= size]
        if fits:
            b = min(fits, key=lambda b: (length[b] - load[b], b))
        else:
            plans = {}
            for x in sorted(lengths):
                if x >= size:
                    room, plan = x - size, Counter()
                    for s in sorted(free, reverse=True):
                        if free[s] > 0 and s <= room:
                            plan[s] = min(free[s], room // s)
                            room -= s * plan[s]
                    plans[x] = plan
            best = min(plans, key=lambda x: (packing.open_cost(x, size + sum(s * n for s, n in plans[x].items())), -x))
            free -= plans[best]
            planned += plans[best]
            b = len(load)
            load.append(0)
            length.append(best)
        where[i] = b
        load[b] += size
    return where, load, length


@pytest.mark.parametrize("seed", range(12))
def test_planned_fit_equals_a_plain_version(seed):
    rng = random.Random(seed)
    lengths = (16, 32, 64) if seed % 2 else packing.LENGTHS
    sizes = [rng.randrange(1, rng.choice([lengths[0], lengths[-1]]) + 1) for _ in range(rng.choice([1, 40, 150]))]
    assert packing.planned_fit(sizes, lengths) == plain_planned_fit(sizes, lengths)


def test_packing_again_never_costs_more_and_mostly_less():
    rng, less, shrunk = random.Random(1), 0, 0
    for _ in range(40):
        sizes = [rng.randrange(1, rng.choice([600, 1500, 4097])) for _ in range(300)]
        first = min(packing.total_cost(packing.downsized(t[1])) for t in packing.tries(sizes, packing.LENGTHS))
        where, load, final, opened = packing.opened_and_final(sizes)
        assert [sum(s for s, b in zip(sizes, where) if b == k) for k in range(len(load))] == load and all(n <= f <= o for n, f, o in zip(load, final, opened))
        cost = packing.total_cost(final)
        assert cost <= first + 1e-9
        less += cost < first - 1e-9
        shrunk += sum(f < o for f, o in zip(final, opened))
    assert less > 15 and shrunk > 0
