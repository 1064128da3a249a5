"""Small hand-made memories tables and plain-Python models of the operators."""

from datetime import datetime

import numpy as np

from factloom import schema as S

NOW = datetime(2024, 6, 1, 12)
PAST, FUTURE = datetime(2024, 1, 1), datetime(2025, 1, 1)


def memories(spark, rows):
    """Rows as dicts of the columns that matter; ids count up from 1."""
    full = []
    for i, r in enumerate(rows):
        text = r.get("text", f"fact {i + 1}")
        base = {"id": i + 1, "user_id": "u", "text": text, "normalized_text": " ".join(text.lower().split()),
                "embedding": None, "tags": [], "importance": 0.5, "created_at": PAST, "updated_at": PAST,
                "metadata": "{}", "record_version": 1}
        base.update(r)
        full.append(tuple(base.get(f.name) for f in S.MEMORIES.fields))
    return spark.createDataFrame(full, S.MEMORIES)


def unit(v):
    v = np.asarray(v, dtype=np.float32).astype(float)
    n = np.linalg.norm(v)
    return v / n if n else v


def score(a, b):
    return round(float(unit(a) @ unit(b)), 9)


def active(r):
    return r.get("deleted_at") is None and (r.get("expires_at") is None or r["expires_at"] > NOW)


def blends(seed, n, centres=6, dim=8, noise=0.12):
    """Vectors around a few centres, so that many pairs score near 0.9."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [[float(x) for x in c[rng.integers(centres)] + rng.normal(size=dim) * noise * rng.integers(0, 4)]
            for _ in range(n)]
