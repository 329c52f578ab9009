import hashlib
import math

import pytest

from fillsight.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd over Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(r[1]) for r in kept), default=0)
    width = -(-longest // parts)
    clamp = lambda x: max(-codes.LIMIT, min(codes.LIMIT, math.floor(4096 * x)))
    vectors = [[clamp(x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, vectors[i]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(vectors[i], p) for i in first] for p in range(parts)]

    def assign():
        out = []
        for v in vectors:
            out.append([min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(book[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(book[p])):
                own = [cut(v, p) for v, a in zip(vectors, found) if a[p][1] == k]
                if own:
                    book[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found, labels = assign(), {}
    for r, a in zip(kept, found):
        labels[r[2]] = labels.get(r[2], 0) + sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), labels[r[2]], digest) for r, a in zip(kept, found)), key=repr)


def result(frame):
    return sorted(map(tuple, codes.compress_embeddings(frame).collect()), key=repr)


@pytest.mark.parametrize("label_rows", [1_000, 3])
def test_table_matches_plain_lloyd(spark, sf, monkeypatch, label_rows):
    monkeypatch.setattr(codes, "LABEL_ROWS", label_rows)
    monkeypatch.setattr(codes, "BUCKET_MEMBERS", 200)
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").where("vec_id < 220")
    rows = [tuple(r) for r in frame.collect()]
    # a third of all rows are one vector
    rows += [(1_000 + i, rows[5][1], 3) for i in range(110)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (1, [0.25] * 8, None), (2, None, 1), (3, [None] + [1.0] * 7, 1), (4, [inf] * 8, 1),
        (5, [nan] * 8, 1), (None, [9.0] * 8, None), (7, [], 2), (8, [-0.0001] * 3, 2), (9, [3e38, -3e38] + [0.0] * 6, 2), (10, [0.1] * 17, 2),
    ]
    rows += [(20 + i, [i / 64, 1 - i / 64] * 4, i % 3) for i in range(30)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", code string, pos int, row int")
    assert result(frame) == expected(rows)
    assert result(frame.where("vec_id in (1, 7)")) == expected([r for r in rows if r[0] in (1, 7)])  # fewer rows than entries
    assert result(frame.where("vec_id = 2")) == [] and result(frame.limit(0)) == []


def test_residents_that_stay_are_not_exchanged(spark, sf):
    """Sums leave a task as one row per position and entry; the plan of a round deals movers only."""
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    members = codes._Members(spark, 8, 8, "int")
    vectors = codes.materialize(codes.quantized(frame).selectExpr("*", "monotonically_increasing_id() AS row"))
    first = codes._vectors(vectors.orderBy("vec_id").limit(16).select("v").toArrow().column("v").combine_chunks(), 64)
    book = first.reshape(16, 8, 8).transpose(1, 0, 2).copy()
    members.write(members.deal(codes._place(vectors, members, book, 8)))
    book = members.update(book)
    found = members.assigned(book)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    moved, everyone = found.where("new <> entry").count(), found.count()
    assert 0 < moved < everyone == 8 * vectors.count()
    before = {(r["row"], r["pos"]): r["new"] for r in found.collect()}
    members.migrate(book)
    after = members.frame().collect()
    assert {(r["row"], r["pos"]): r["entry"] for r in after} == before and len(after) == everyone
    members.drop(members.name, members.path)
