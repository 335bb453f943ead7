"""Walks over the nearest neighbours among all vectors."""

import hashlib

import numpy as np

from partita.plans.extra_queries import neighbour_walks


def test_walks_visit_the_nearest_of_all_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    at = {int(i): n for n, i in enumerate(ids)}

    def nearest(node):
        d = np.round(np.sqrt(((x - x[at[node]]) ** 2).sum(axis=1)), 9)
        return [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != node][:3]

    want = set()
    for start in (int(i) for i in ids if i % 20 == 0):
        node = start
        want.add((start, 0, node))
        for i in range(6):
            node = nearest(node)[int(hashlib.md5(f"{start}|{i}|2".encode()).hexdigest()[:8], 16) % 3]
            want.add((start, i + 1, node))
    got = [tuple(r) for r in neighbour_walks(spark, sf).select("start", "step", "node").collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(n % 20 for _, _, n in got)
