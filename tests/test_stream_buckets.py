"""Annotations of many keys in one state: versions go by key, calls of the state don't."""

import pandas as pd

from tidebar.streaming import stateful


class State:
    calls = 0

    def __init__(self):
        self.rows = []

    def __getattribute__(self, name):
        if name in ("get", "put", "appendList", "update", "clear", "exists"):
            State.calls += 1
        return object.__getattribute__(self, name)

    def get(self):
        return iter(list(self.rows)) if isinstance(self.rows, list) else self.rows

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows = self.rows + list(rows)

    def update(self, row):
        self.rows = row

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []


class Handle:
    def getListState(self, name, schema):
        return State()

    getValueState = getListState

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_many_keys_of_a_bucket():
    p = stateful.Versions()
    p.init(Handle())
    rows = [{"changed_at": 1_000 + t, "change_no": t, "operation": "DELETE" if t == 2 else "UPDATE", "human_decision": f"d{t}", "confidence": None, "note": None, "annotation_key": f"k{k}"} for t in (3, 0, 2, 1) for k in range(500)]
    State.calls = 0
    assert list(p.handleInputRows((0,), iter([pd.DataFrame(rows)]), Watermark(0))) == []
    out = []
    for at in (1_001, 2_000):
        out += list(p.handleExpiredTimer((0,), Watermark(at), None))
    assert State.calls < 60
    got = pd.concat(out)
    for _, own in got.groupby("annotation_key"):
        assert own["revision_no"].tolist() == [1, 2, 3, 4]
        assert own["annotation_version"].tolist() == [1, 2, 2, 3]
        assert own["previous_payload"].tolist()[1:] == [f'{{"human_decision":"d{t}"}}' for t in range(3)]
    assert got["annotation_key"].nunique() == 500
