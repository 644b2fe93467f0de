"""The gate of a channel takes many posts in few steps, with the decisions of the sequential gate (F26)."""

import random
from collections import deque

import numpy as np
import pytest

from beaconry.streaming import jobs


def one_by_one(posts, per_hour, per_day, times=()):
    times, out = list(times), []
    for second, paused in posts:
        hour, day = sum(second - t < jobs.HOUR for t in times), sum(t // jobs.DAY == second // jobs.DAY for t in times)
        out.append("blocked" if paused else "held" if hour >= per_hour or day >= per_day else "ready")
        if out[-1] == "ready":
            times.append(second)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_gate_decides_as_one_by_one(seed):
    rng = random.Random(seed)
    per_hour, per_day = rng.choice([(4, 30), (1, 1), (3, 2), (50, 30), (0, 5), (5, 0), (2, 100)])
    start, spread = rng.randrange(10**9), rng.choice([50, 5_000, 90_000, 400_000])
    posts = sorted((start + rng.randrange(spread), rng.random() < rng.choice([0.02, 0.9])) for _ in range(rng.choice([0, 1, 30, 900])))
    gate, times, got = jobs.ChannelGate(per_hour, per_day), deque(), []
    cuts = sorted(rng.randrange(len(posts) + 1) for _ in range(3))
    for low, high in zip([0, *cuts], [*cuts, len(posts)]):
        part = posts[low:high]
        got += gate.decide(np.array([s for s, _ in part], dtype="int64"), np.array([p for _, p in part], dtype=bool), times)
    assert got == one_by_one(posts, per_hour, per_day)


@pytest.mark.parametrize("seed", range(20))
def test_posts_that_come_late_count_what_was_released_after_them(seed):
    rng = random.Random(seed)
    base = 1_700_000_000 // jobs.DAY * jobs.DAY + rng.choice([0, 1_800, 40_000])
    carried = sorted(base + rng.randrange(3_000) for _ in range(6))
    posts = sorted((base - 1_500 + rng.randrange(5_000), False) for _ in range(60))
    got = jobs.ChannelGate(4, 9).decide(np.array([s for s, _ in posts]), np.zeros(60, dtype=bool), deque(carried))
    assert got == one_by_one(posts, 4, 9, carried)


def test_a_crowd_of_posts_takes_few_steps(monkeypatch):
    gate, looks = jobs.ChannelGate(4, 30), []
    plain = gate.free_from
    monkeypatch.setattr(gate, "free_from", lambda *a: looks.append(1) or plain(*a))
    seconds = np.sort(np.arange(200_000) % (3 * jobs.DAY))
    states = gate.decide(seconds, np.zeros(len(seconds), dtype=bool), deque())
    assert states.count("ready") == 90 and len(looks) < 400
