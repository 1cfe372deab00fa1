"""Near-duplicate embeddings in many packs: against brute force, and without a shuffle of packs."""

from __future__ import annotations

import numpy as np
import pytest

from docloom.llm import common, embedding_dups


def brute(rows):
    """{id: (n_links, component)} of rows (id, vector)."""
    ids, u = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    labels = ids.copy()
    while True:
        new = np.minimum(labels, np.where(linked, labels[None], ids.max()).min(1))
        if (new == labels).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(1), labels, strict=True)}
        labels = new


@pytest.mark.parametrize(("width", "kind"), [(16, "float"), (16, "double"), (5, "float"), (2, "double")])
def test_packs_meet_without_a_shuffle(spark, monkeypatch, width, kind):
    r, real, plans = np.random.default_rng(width), common.written, {}
    base = r.standard_normal((30, width))
    x = base[r.integers(0, 30, 260)] + 0.14 * r.standard_normal((260, width))
    x = np.concatenate([x, x[:20], -x[:3], 2 * x[5:9]]).astype(np.float32).astype(float)
    rows = [(7 * i, v.tolist()) for i, v in enumerate(x)]

    def seen(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *more)

    monkeypatch.setattr(common, "written", seen)
    monkeypatch.setattr(embedding_dups, "PACK", 16)
    monkeypatch.setattr(embedding_dups, "GROUP_BYTES", 4096, raising=False)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in embedding_dups.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert "Exchange" not in plans["vector-links"]
