import math

import numpy as np

from fillsight.llm import topk


def expected(rows, every=20, k=20):
    ok = [
        (i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out, asked = [], {(i, tuple(v)) for i, v in ok if i % every == 0}
    for q, v in asked:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [0.5, 0.25]), (20, [0.5, -0.25]), (20, [0.5, -0.25]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None),
        (4, [None, 1.0]), (5, [inf, 1.0]), (6, [nan, 1.0]), (None, [9.0, 9.0]), (7, []), (8, [0.0, 0.0]), (9, [-0.001, 2.0, 5.0]), (40, [0.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, "x", "x") for r in rows], "vec_id bigint, embedding array<double>, label int, score string, v string")
    assert sorted(map(tuple, topk.search_embeddings(frame).collect())) == expected(rows)
    assert topk.search_embeddings(frame.limit(0)).collect() == []


def test_embeddings_in_many_groups_match_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 40)
    monkeypatch.setattr(topk, "FIRST_ROWS", 30)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert sorted(map(tuple, topk.search_embeddings(frame).collect())) == expected(rows)


def test_pruned_search_equals_all_products():
    r = np.random.default_rng(3)
    for scale in (1, 40):  # many ties, and clear leaders in a decaying spectrum
        x = np.floor(r.normal(size=(3_000, 24)) * scale * np.geomspace(1, 0.05, 24)).astype(np.int64)
        ids = r.integers(0, 2_500, 3_000)
        turn = np.linalg.svd(x.astype(float), full_matrices=True)[2].T
        q = r.choice(3_000, 60, replace=False)
        row, col, score = topk.search(ids[q], x[q], ids, x, turn, 20, 256)
        for i in range(60):
            all_ = sorted((-int(x[q[i]] @ x[j]), int(ids[j])) for j in range(3_000) if ids[j] != ids[q[i]])[:20]
            assert [(-int(s), int(ids[c])) for c, s in zip(col[row == i], score[row == i])] == all_


def test_query_on_many_rows_of_a_chunk_keeps_all_foreign_candidates():
    r = np.random.default_rng(5)
    for times in (2, 5, 30):
        x = r.integers(-40, 40, (100, 8))
        ids = np.arange(1, 101)
        x[:times], ids[:times] = x[0] * 3, 20  # the query's own rows score highest
        x[-times:], ids[-times:] = x[0], 20  # and stand in more than one chunk
        for chunk in (100, 50, 25):
            row, col, score = topk.search(ids[:1], x[:1], ids, x, np.eye(8), 20, chunk)
            every = sorted((-int(x[0] @ x[j]), int(ids[j])) for j in range(100) if ids[j] != 20)[:20]
            assert [(-int(s), int(ids[c])) for c, s in zip(col, score)] == every


def long_tailed(spark, n=2_000, seed=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 8)) * r.lognormal(0, 1.2, (n, 1))
    return spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>, label int")


def test_later_ranges_get_only_queries_above_the_bound(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 200)
    monkeypatch.setattr(topk, "FIRST_ROWS", 100)
    frame = long_tailed(spark)
    sent, scored = [], topk._score_range

    def watched(candidates, asked, n, *rest):
        got = asked.collect()
        sent.append((n, len(got)))
        top = candidates.agg(topk.F.max("l")).first()[0]
        assert all(r.floor is None or math.sqrt(r.l * top) * (1 + 1e-9) + 1 >= r.floor for r in got)
        return scored(candidates, asked, n, *rest)

    monkeypatch.setattr(topk, "_score_range", watched)
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert sorted(map(tuple, topk.search_embeddings(frame).collect())) == expected(rows)
    sizes = [n for n, _ in sent]
    assert sizes == sorted(sizes) and len(sizes) >= 2 and sum(sizes) < 2_000  # the short vectors are never scored
    assert sent[0][1] == 100 and sent[-1][1] < 50


def test_equal_lengths_make_one_range(spark, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_ROWS", 10)
    rows = [(i, [1.0 if j == i % 4 else 0.0 for j in range(4)]) for i in range(200)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, label int")
    assert sorted(map(tuple, topk.search_embeddings(frame).collect())) == expected(rows)
