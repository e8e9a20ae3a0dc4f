"""No side of a join that grows by explode or by collect_list is broadcast, however small its files are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark.llm import neardup, negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def broadcast_sides(df):
    """What stands below each BroadcastExchange of a plan, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [next((i for i, c in enumerate(s) if c.isalpha()), 0) for s in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables that the two operators write."""
    seen = []
    for module in (neardup, negatives):
        for name in ("stored", "stored_at"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda df, at, f=getattr(module, name): (seen.append(df), f(df, at))[1])
    return seen


def rows(spark):
    x = np.random.default_rng(1).normal(0, 1, (80, 16))
    x[20:40] = x[3]
    x[41] = x[40] + 1e-3
    return spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], SCHEMA)


def test_neardup_broadcasts_no_exploded_side(spark, plans):
    out = neardup.near_duplicates(rows(spark))
    sides = [s for df in [*plans, out] for s in broadcast_sides(df)]
    assert plans and not [s for s in sides if "Generate" in s or "collect_list" in s]
    got = {r.vec_id: r.n_links for r in out.collect()}
    assert got[40] == 0 and got[20] == 9 and got[39] == got[3] == 10


def test_negatives_broadcast_no_packed_anchors(spark, plans):
    out, _ = negatives.mine(rows(spark), F.col("vec_id") % 7 == 0)
    sides = [s for df in [*plans, out] for s in broadcast_sides(df)]
    assert plans and not [s for s in sides if "Generate" in s or "collect_list" in s]
    assert out.count()


def test_codes_of_many_members_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)
    members = spark.createDataFrame([(i, 1, 1, [5 if i < 10 else 100 + i], b"x") for i in range(14)],
                                    "uid long, n long, label int, codes array<bigint>, vec binary")
    met = [(sorted(m.uid for m in r.a), sorted(m.uid for m in r.b), r.same) for r in neardup._met(members, 0, 0).collect()]
    of = {tuple(a) for a, _, same in met if same}
    assert sorted(u for b in of for u in b) == list(range(10)) and len(of) > 1      # a code of its own meets nothing
    assert len(met) == len(of) * (len(of) + 1) // 2
