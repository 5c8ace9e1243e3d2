"""The neighbour graph against all pairs."""

import numpy as np
import pytest

from riskweave.llm import neighbour_graph

SCHEMA = "vec_id long, embedding array<float>, key string, comp string, copies int, least int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)


def plain(rows, threshold=0.95):
    """{position: (vec_id, n_links, component_id, kept)} by all pairs."""
    whole = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    linked, n_links = {k: k for k in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)
    x = np.array([rows[k][1] for k in whole] or [[1.0]], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))

    def root(k):
        while linked[k] != k:
            k = linked[k]
        return k

    for p, q in np.argwhere(np.triu(x @ x.T >= threshold, 1)[: len(whole)]):
        p, q = whole[p], whole[q]
        n_links[p] += 1
        n_links[q] += 1
        linked[max(root(p), root(q))] = min(root(p), root(q))
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[root(k)] = min(i, names.get(root(k), i))
    return sorted(((i, n_links[k], names.get(root(k)), i == names.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def families(seed, sizes, width=24, noise=0.04):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.standard_normal(width)
        out += list(centre / np.linalg.norm(centre) + noise * rng.standard_normal((size, width)))
    order = rng.permutation(len(out))
    return [out[k].astype(np.float32).tolist() for k in order]


def test_groups_and_counts_equal_all_pairs(spark):
    base = families(1, [1] * 300 + [2] * 60 + [5] * 10 + [40, 90])
    rows = [(3 * k + 7, v) for k, v in enumerate(base)]
    rows += [(10_000 + k, base[11]) for k in range(200)]  # a third of all rows are copies
    rows += [(k, [2.5 * c for c in base[k]]) for k in range(3)]
    rows += [(20_000, None), (20_001, []), (20_002, [0.0] * 24), (20_003, [None] * 24), (20_004, [float("nan")] * 24), (20_005, [float("inf")] * 24), (None, base[11]), (None, None), (7, base[0])]
    got, graph = neighbour_graph.near_duplicates(vectors(spark, rows).repartition(3), block=32)
    assert sorted((tuple(r) for r in got.collect()), key=str) == [r if r[0] is not None or r[2] is not None else (None, r[1], None, True) for r in plain(rows)]
    assert graph.recall == 1.0 and graph.passes >= 2


def test_two_dense_families_that_touch(spark):
    """All near points of a member are of its own family; the other family is found in a later pass."""
    rng = np.random.default_rng(4)
    a = np.zeros(16)
    a[0] = 1.0
    b = a.copy()
    b[1] = 0.28  # 15.6 degrees off: about the threshold
    base = np.concatenate([c + 0.004 * rng.standard_normal((60, 16)) for c in (a, b)]).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(base + families(2, [1] * 50, 16))]
    got, _ = neighbour_graph.near_duplicates(vectors(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 0.0])], [(5, [1.0, 0.0]), (4, [2.0, 0.0]), (3, [0.0, 1.0])]])
def test_small_tables(spark, tmp_path, rows):
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = neighbour_graph.op11_near_dedup(spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_other_widths_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0])]
    got, _ = neighbour_graph.near_duplicates(vectors(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
