"""Negatives from pools of types: what is held is gathered for the sample's keys alone, and the entity drawn is the one that counting finds."""

import pytest

from tripleguard.functions.draws import draw_below
from tripleguard.operators import scan
from tripleguard.sources import negatives


@pytest.mark.parametrize("long", [2000, 3])
def test_only_asked_keys_are_held(spark, monkeypatch, long):
    monkeypatch.setattr(scan, "LONG", long)
    facts = [(h, r, t) for h in range(12) for r in range(2) for t in range(20, 30) if (h * 7 + t * 3 + r) % 4 < 2]
    known = spark.createDataFrame(facts, "h long, r long, t long")
    rows = [(i, *facts[at]) for i, at in enumerate((0, 5, 11, 40, 41, 77))]
    written, old = [], negatives.materialised
    monkeypatch.setattr(negatives, "materialised", lambda df: written.append(old(df)) or written[-1])
    sample = spark.createDataFrame(rows, "pos long, h long, r long, t long")
    got = {r["pos"]: r for r in negatives.type_pool_negatives(sample, known, "1").collect()}

    asked = {("h", r, t) for _, _, r, t in rows} | {("t", r, h) for _, h, r, _ in rows}
    held = [x for df in written if {"side", "r", "other"} <= set(df.columns) and {"u", "_e"} & set(df.columns) for x in df.select("side", "r", "other").collect()]
    assert held and {tuple(x) for x in held} <= asked

    total = lambda pos, n: spark.range(1).select(draw_below(n, "1", "corruptible", pos)).first()[0]
    for pos, h, r, t in rows:
        heads = [e for e in sorted({f[0] for f in facts if f[1] == r}) if (e, r, t) not in set(facts)]
        tails = [e for e in sorted({f[2] for f in facts if f[1] == r}) if (h, r, e) not in set(facts)]
        x = total(pos, len(heads) + len(tails))
        want = ("h", heads[x], r, t) if x < len(heads) else ("t", h, r, tails[x - len(heads)])
        assert tuple(got[pos])[1:] == want
