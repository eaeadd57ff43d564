import random

import numpy as np
import pytest

from dependra.llm import simhash


def parts(pairs, nodes):
    """The connected parts of ``nodes``, as a set of sets."""
    of = {x: {x} for x in nodes}
    for x, y in pairs:
        if of[x] is not of[y]:
            of[x] |= of[y]
            for z in of[y]:
                of[z] = of[x]
    return {frozenset(v) for v in of.values()}


def brute(a, b, bits):
    return parts([(x, y) for x in a for y in b if (x ^ y).bit_count() <= bits], {*a, *b})


def test_partners_reached_before_are_joined():
    # x1 meets y1 alone, x2 meets y1 and y2
    a, b = [0b0, 0b1110], [0b11, 0b111111110]
    got = simhash.bridges(np.array(a), np.array(b), 5)
    assert parts(got, {*a, *b}) == brute(a, b, 5) and len(brute(a, b, 5)) == 1


@pytest.mark.parametrize("seed", range(40))
def test_bridges_span_what_brute_force_connects(seed):
    rng = random.Random(seed)
    pool, f = [], rng.getrandbits(63)
    for _ in range(60):
        pool.append(f)
        for bit in rng.sample(range(63), rng.choice([2, 3, 4, 5])):
            f ^= 1 << bit
        f = rng.choice([f, rng.choice(pool)])
    pool = list(dict.fromkeys(pool))
    rng.shuffle(pool)
    a, b = pool[: len(pool) // 2], pool[len(pool) // 2 :]
    got = simhash.bridges(np.array(a, np.int64), np.array(b, np.int64), 4)
    assert all((x ^ y).bit_count() <= 4 and x in a and y in b for x, y in got)
    assert len(got) < len(pool)
    assert parts(got, pool) == brute(a, b, 4)
