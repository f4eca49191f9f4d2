"""The stateful fold without a stream: a state that counts what it holds."""

import json
import random
from types import SimpleNamespace

import pandas as pd

from windlass.streaming.identity import named, unnamed
from windlass.streaming.ordered import FIRST, InOrder


class _Map(dict):
    most = 0

    def updateValue(self, key, value):
        self[key] = value
        self.most = max(self.most, len(json.loads(value[0])))

    def getValue(self, key):
        return self[key]

    removeKey = dict.__delitem__


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Handle:
    def __init__(self):
        self.maps, self.timers = _Map(), []
        self.getMapState = lambda *_: self.maps
        self.getValueState = lambda *_: _Value()
        self.listTimers = lambda: list(self.timers)
        self.registerTimer, self.deleteTimer = self.timers.append, self.timers.remove


def _batch(processor, handle, rows, watermark, size=10):
    """The outputs of a micro-batch: its rows, then the timer that the watermark has reached."""
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
    frames = (pd.DataFrame([("g", at, text) for at, text in rows[i:i + size]]) for i in range(0, len(rows), size))
    out = [r for f in processor.handleInputRows(("g",), frames, times) for r in f["_row"]]
    for t in [t for t in handle.timers if t <= watermark]:
        out += [r for f in processor.handleExpiredTimer(("g",), times, None) for r in f["_row"]]
        handle.timers.remove(t)
    return out


def test_rows_wait_in_small_blocks_and_come_in_order():
    """No stored value has all waiting rows of a group."""
    rng = random.Random(3)
    rows = [(rng.randrange(0, 900_000), f"{rng.randrange(50):02d}") for _ in range(600)]
    sizes = []

    def fold(state, part):
        sizes.append(len(part))
        return (state or 0) + len(part), [f"{at} {text}" for at, text in part]

    processor, handle = InOrder(fold, run=64, block=7), _Handle()
    processor.init(handle)
    got, seen, mark = [], [], 0
    for k in range(6):
        new = [r for r in rows[100 * k:100 * k + 100] if r[0] > mark * 1000]
        seen += new
        mark = 100 * k
        got += _batch(processor, handle, new, mark)
        assert len(handle.timers) <= 1
    got += _batch(processor, handle, [], 1000)
    assert got == [f"{at} {text}" for at, text in sorted(seen)]
    assert handle.maps.most <= 7 and not handle.maps and processor._held(processor.state) == len(seen)


def test_keys_of_a_bucket_are_named_in_one_call():
    """Many keys share a group's state and timer; versions of a probe's own time don't count, probes without a time have none."""
    processor, handle = InOrder(named, unnamed, run=20, block=4), _Handle()
    processor.init(handle)
    rows = [(1000 * t, f'{kind}{{"k":{k}}}\t{kind}{k}@{t}') for k in range(30) for kind, t in (("v", 1), ("v", 5), ("p", 5), ("p", 6), ("p", 1), ("v", 5))]
    rows += [(FIRST + 1, 'v{"k":31}\tever'), (FIRST, 'p{"k":31}\tnever'), (9000, 'p{"k":31}\tp31')]
    random.Random(1).shuffle(rows)
    got = _batch(processor, handle, rows, 5)
    assert len(handle.timers) == 1
    got += _batch(processor, handle, [], 9)
    want = [x for k in range(30) for x in (f"p{k}@1", f"p{k}@5\tv{k}@1", f"p{k}@6\tv{k}@5")]
    assert sorted(got) == sorted([*want, "never", "p31\tever"])
