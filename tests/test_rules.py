import random

import pytest

from ambulo.operators import rules as W


def stride(start, end, foot="left", **more):
    return {"start": start, "end": end, "lr_label": foot, **more}


def row(*starts, feet="LR"):
    return [stride(s, s + 100, {"L": "left", "R": "right", "-": None}[feet[i % len(feet)]]) for i, s in enumerate(starts)]


def spans(strides, **rules):
    return [(s, last) for _, s, last, _, _, _ in W.walk(strides, rules, 100)]


def test_breaks_and_trimming():
    strides = row(0, 100, 200, 300, 1000, 1100, 1200)
    assert spans(strides, b=W.MaxBreak(3)) == [(0, 3), (4, 6)]
    assert spans(strides, b=W.MaxBreak(3, trim="last")) == [(0, 2), (4, 5)]
    assert spans(strides, b=W.MaxBreak(3, trim="last", end_is_break=False)) == [(0, 2), (4, 6)]
    assert spans(strides, b=W.MaxBreak(3, trim="per_foot")) == [(0, 1), (4, 4)]
    same = row(0, 100, 200, 300, feet="LLL")
    assert spans(same, b=W.MaxBreak(3, trim="per_foot")) == [(0, 2)]
    assert spans(row(0, 100, feet="LR"), b=W.MaxBreak(3, trim="per_foot")) == [(0, 0)]
    assert spans(row(0, 400), b=W.MaxBreak(3)) == [(0, 1)]
    assert W.walk([], {"b": W.MaxBreak(3)}, 100) == []
    with pytest.raises(ValueError):
        W.MaxBreak(-1)
    with pytest.raises(ValueError):
        W.MaxBreak(1, trim="first")


def test_strides_without_rules_are_one_bout():
    assert [w[1:] for w in W.walk(row(0, 5000), {}, 100)] == [(0, 1, 2, W.END_OF_LIST, None)]


def test_numbers_of_strides():
    strides = row(0, 100, 200, 300, 400)
    assert W.MinStrides(5).accepts(strides, 100) and not W.MinStrides(6).accepts(strides, 100)
    assert W.MinStrides(left=3).accepts(strides, 100) and not W.MinStrides(left=4, right=1).accepts(strides, 100)
    assert W.MinStrides(right=2).accepts(strides, 100) and not W.MinStrides().accepts(strides, 100)
    assert not W.MinStrides(right=0).accepts(row(0, feet="L"), 100)


def test_a_rule_may_delay_the_start_and_the_latest_one_counts(spark):
    class After(W.Rule):
        def __init__(self, n):
            self.n = n

        def step(self, strides, first, start, at, sampling_rate_hz):
            return W.Move(start=first + self.n) if at == first else W.Move()

    found = W.walk(row(0, 100, 200, 300, 1000, 1100), {"one": After(1), "two": After(2), "b": W.MaxBreak(3)}, 100)
    assert [(f, s, last, why, delay) for f, s, last, _, why, delay in found] == [(0, 2, 3, "b", "two"), (4, 6, 5, "b", "two")]
    rows = [(1, i, s["start"], s["end"], s["lr_label"], 7) for i, s in enumerate(row(0, 100, 200, 300, 1000, 1100))]
    table = spark.createDataFrame(rows, "rec long, s_id long, start long, end long, lr_label string, wb_id int")
    out = {r.s_id: (r.pre_bout, r.wb_id, r.end_rule, r.exclude_rule) for r in W.assemble_by_rules(table, ["rec"], {"one": After(1), "two": After(2), "b": W.MaxBreak(3)}, 100).collect()}
    assert out[0] == out[1] == (None, None, None, "two")
    assert out[2] == out[3] == (0, 0, "b", None)
    assert out[4] == out[5] == (1, None, "b", "two")


def test_summary_of_a_bout():
    strides = [stride(0, 10, speed=1.0), stride(10, 20, speed=2.0)]
    mean = lambda rows, fs: sum(r["speed"] for r in rows) / len(rows)
    assert W.Summary(mean, 1.0, 1.5).accepts(strides, 100) and not W.Summary(mean, 1.5, 2).accepts(strides, 100)
    assert W.Summary(mean, 1.5, 2, (True, False)).accepts(strides, 100) and not W.Summary(mean, upper=1.5, inclusive=(True, False)).accepts(strides, 100)


def test_alternating_feet_split_bouts():
    assert spans(row(0, 100, 200, 300, feet="LRRL"), f=W.Alternating()) == [(0, 1), (2, 3)]
    assert spans(row(0, 100, 200, feet="L-L"), f=W.Alternating()) == [(0, 2)]


def test_every_search_moves_on():
    rng = random.Random(0)
    for _ in range(50):
        at, starts = 0, []
        for _ in range(rng.randint(0, 30)):
            starts.append(at)
            at += rng.choice([100, 150, 500])
        found = W.walk(row(*starts, feet=rng.choice(["LR", "LLR", "L-R"])), {"b": W.MaxBreak(rng.choice([0, 3]), trim=rng.choice([None, "last", "per_foot"])), "f": W.Alternating()}, 100)
        assert [f[0] for f in found] == ([0] + [f[3] for f in found[:-1]] if found else [])
