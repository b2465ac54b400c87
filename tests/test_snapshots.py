"""Change events, against a brute-force comparison of neighbouring snapshots."""

import datetime as dt
import random

from tarnstone.operators import snapshots

SCHEMA = "snapshot_no int, delivered_at timestamp_ntz, asset_id string, current_revision_id string, source_hash string, markdown string, extra string"


def brute(rows):
    import re

    state = {}
    for no, at, asset, rev, digest, text, _ in rows:
        if no is None or asset is None:
            continue
        clean = None if text is None else re.sub(r"[^\S\n]+(?=\n)", "", text).rstrip()
        digest = None if digest is None else digest.lower().removeprefix("sha256:")
        old = state.get((no, asset))
        if old is None or at > old[0]:
            state[no, asset] = (at, (rev, digest, clean))
    numbers = sorted({no for no, _ in state})
    out = set()
    for a, b in zip(numbers, numbers[1:]):
        was = {k: v[1] for (n, k), v in state.items() if n == a}
        now = {k: v[1] for (n, k), v in state.items() if n == b}
        out |= {(k, b, "added") for k in now.keys() - was.keys()} | {(k, b, "removed") for k in was.keys() - now.keys()}
        out |= {(k, b, "changed") for k in now.keys() & was.keys() if now[k] != was[k]}
    return out


def test_against_brute_force(spark):
    random.seed(1)
    rows, clock = [], dt.datetime(2024, 1, 1)
    for no in (1, 2, 5, 6, 9):
        for asset in [f"a{i}" for i in range(30)]:
            for _ in range(random.choice((0, 1, 1, 1, 2))):
                clock += dt.timedelta(minutes=1)
                row = (no, clock, asset, random.choice(("r1", "r1", "r2", None)), random.choice(("AB", "sha256:ab", "ab", None)), random.choice(("x\n", "x \r\n", "x", "y", None, "")), "e")
                rows += [row] * random.choice((1, 1, 2))
    random.shuffle(rows)
    got = {tuple(r) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_empty_and_nulls(spark):
    assert snapshots.snapshot_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, None, "r", "h", "t", ""), (None, at, "a", "r", "h", "t", ""), (2, at, "a", "r", "h", "t", ""), (1, None, "b", "r", "h", "t", "")]
    got = {tuple(r) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", 2, "added"), ("b", 2, "removed")}
