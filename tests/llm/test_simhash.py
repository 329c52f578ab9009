import re

import xxhash

from fillsight.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                comp[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", ids.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_edges_match_brute_force(docs, edge_rows):
    got = simhash.classes(docs(edge_rows, extra=True)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(edge_rows)


def test_documents_match_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = simhash.classes(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_empty_table(docs):
    assert simhash.classes(docs([])).collect() == []
    assert simhash.keep_one(docs([])).collect() == []


def test_bk_tree_and_divided_shards(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ (1 << r.randrange(12)) ^ (1 << r.randrange(12)) for b in base for _ in range(30)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    # shards of at most 8 values: the deeper levels are used, and no pair within the radius is lost
    shards = {}
    for row in simhash.shards(frame, 2, 8).collect():
        shards.setdefault(row.path, set()).add(row.fp)
    assert max(map(len, shards.values())) <= 8
    together = {(a, b) for s in shards.values() for a in s for b in s}
    pairs = [(signed[i], signed[j]) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    assert pairs and all(p in together for p in pairs)


def test_one_row_of_each_group_stays(docs, edge_rows):
    frame = docs(edge_rows, extra=True)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    groups = {}
    for row in expected(edge_rows):
        groups.setdefault((row[2], row[1] if row[2] is None else None), row)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got))
    long = edge_rows[4][1]
    assert got.count((5, long)) == 1
    assert sum(t is None or not t.split() for _, t in got) == 1  # all empty texts share the zero fingerprint


def test_kept_rows_keep_all_their_columns(spark):
    rows = [(1, "a b c d", "x", 5), (2, "a b c d", "y", 6), (3, "other words here now", None, 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _simhash_key string, row int")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
