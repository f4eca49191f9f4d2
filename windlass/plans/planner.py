"""Plans of experiments: budgets, path assignment, slots. Inputs are a few rows, so these are driver-side functions."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass
class Split:
    train_end: int
    train_injections: int
    test_injections: int


def split_budget(length: int, train_share: float, physical: Sequence[tuple[int, int]], attack_length: int, attack_share: float) -> Split:
    """Training ends before the first physical attack; what attacks already take of the test part isn't injected."""
    end = int(min([train_share * length, *(s for s, _ in physical)]))
    taken = sum(e - s for s, e in physical)
    test = max(0.0, attack_share * (length - end) - taken)
    return Split(end, int(attack_share * end // attack_length), int(test // attack_length))


def assign_paths(paths: Sequence[tuple], counts: Sequence[int]) -> list[list[tuple]]:
    """Paths for experiments of so many injections: equal shares of each path, the path with most left first."""
    total = sum(counts)
    each = total // len(paths) if paths else 0
    left = {p: each for p in paths}
    out = []
    for n in counts:
        own = []
        for _ in range(n):
            p = max(left, key=lambda x: (left[x], -list(left).index(x)), default=None)
            if p is None or left[p] <= 0:
                break
            left[p] -= 1
            own.append(p)
        out.append(own)
    return out


def first_free_slots(labels: Sequence[int], count: int, length: int, start: int, end: int, seed: int = 0) -> list[tuple[int, int]]:
    """count free runs of length windows between start and end, after random gaps, scanning forward."""
    taken, out, at, rng = list(labels), [], start, random.Random(seed)
    for k in range(count):
        room = end - at - (count - k) * length
        at += rng.randint(0, max(0, room // (count - k)))
        while at + length <= end and any(taken[at:at + length]):
            at += 1
        if at + length > end:
            break
        taken[at:at + length] = [1] * length
        out.append((at, at + length))
        at += length
    return out


def scaled(slots: Sequence[tuple[int, int]], coarse: int, fine: int) -> list[tuple[int, int]]:
    """Slots of a coarse granularity in windows of a finer one."""
    k = coarse / fine
    return [(int(s * k), int(e * k)) for s, e in slots]


def span(values: Sequence, gran: int, start: int, end: int, slack: int) -> tuple[list, int, int]:
    """The values around a period, and its first and last window within them."""
    lo, hi = (start - slack) // gran, (end + slack) // gran
    return list(values[lo:hi + 1]), lo, hi
