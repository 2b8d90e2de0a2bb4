"""Folded action logs against a plain walk over random ones."""

import random

import pytest

from tidebar.operators import actionlog

SCHEMA = "trade_id string, changed_at long, change_no long, operation string, event_id string, k int"


def plain(rows):
    out = {}
    for trade, _, _, op, event, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
        state, entry, exit_, ok, bad = out.get(trade, ("NONE", None, None, 0, 0))
        to = dict(zip(actionlog.STATES, actionlog.MOVES[op], strict=True))[state] if op in actionlog.MOVES else None
        if to is None:
            out[trade] = (state, entry, exit_, ok, bad + 1)
            continue
        if to == "NONE":
            entry = exit_ = None
        elif to == "OPEN":
            entry, exit_ = (event if state == "NONE" else entry), None
        else:
            exit_ = event
        out[trade] = (to, entry, exit_, ok + 1, bad)
    return {(t, *v) for t, v in out.items()}


@pytest.mark.parametrize("size", [3, 4096])
def test_random_logs(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(("a", "b", "c", "hot", "hot", "hot", None)), i // 3, i, rng.choice((*actionlog.MOVES, "close", "OTHER")).upper(), f"e{i}", 0) for i in range(700)]
    shuffled = rng.sample(rows, len(rows))
    got = actionlog.folded_trades(spark.createDataFrame(shuffled, SCHEMA).repartition(5), size=size)
    assert {tuple(r) for r in got.collect()} == plain(rows)


def test_edges(spark):
    assert actionlog.folded_trades(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("t", 1, 1, "OPEN", "o", 0), ("t", 2, 2, "CLOSE", "c", 0), ("t", 3, 3, "UNDO_CLOSE", "c", 0), ("t", 4, 4, "REDO_CLOSE", "c", 0), ("u", 1, 5, None, None, 0), ("v", 1, 6, "OPEN", "o2", 0), ("v", 1, 7, "UNDO_OPEN", "o2", 0)]
    got = {tuple(r) for r in actionlog.folded_trades(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("t", "CLOSED", "o", "c", 4, 0), ("u", "NONE", None, None, 0, 1), ("v", "NONE", None, None, 2, 0)}
