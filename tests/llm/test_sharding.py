import hashlib
from collections import Counter

from fillsight.llm import sharding


def bits(doc, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    return bin(int("1" + hashlib.md5(f"{'' if doc is None else doc}|{inner}".encode()).hexdigest(), 16))[3:]


def expected(rows, limit):
    """Shortest prefix whose rows fit; None for rows that no bit divides."""
    keyed = [(d, t, bits(d, t), len((t or "").encode())) for d, t in rows]
    over = {b for b in {k[2] for k in keyed} if sum(k[3] for k in keyed if k[2] == b) > limit}
    sums = Counter()
    for _, _, b, n in keyed:
        if b not in over:
            for depth in range(129):
                sums[b[:depth]] += n
    out = []
    for d, t, b, n in keyed:
        shard = None if b in over else next(b[:k] for k in range(129) if sums[b[:k]] <= limit)
        out.append((d, n, shard, None if shard is None else sums[shard]))
    return sorted(out, key=repr)


def test_directory_matches_brute_force(docs, edge_rows):
    rows = edge_rows + [(100 + i, f"text {i} " * (i % 50)) for i in range(400)]
    for limit in (3_000, 40_000, 10**9):
        got = sharding.shard(docs(rows, extra=True), limit).collect()
        plain = sorted(((r.doc_id, r.n_bytes, None if r.overflow else r.shard, None if r.overflow else r.shard_bytes) for r in got), key=repr)
        assert plain == expected(rows, limit)
        assert all(r.depth == len(r.shard) for r in got if not r.overflow)
        assert all(r.shard_bytes <= limit or r.n_bytes == r.shard_bytes for r in got)


def test_equal_rows_get_pages_within_the_limit(docs):
    rows = [(1, "same " * 20)] * 57 + [(2, "x" * 5_000)]
    got = sharding.shard(docs(rows), 1_000).collect()
    pages = Counter(r.shard for r in got if r.doc_id == 1)
    assert len(got) == 58 and all(r.overflow for r in got) and max(pages.values()) <= 10
    assert all(r.shard_bytes == 100 * pages[r.shard] for r in got if r.doc_id == 1)


def test_empty_table(docs):
    assert sharding.shard(docs([])).collect() == []
