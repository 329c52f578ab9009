import hashlib

import numpy as np

from fillsight.llm import suffix


def expected(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for s in range(len(b) - 49):
            if d is not None:
                first[b[s : s + 50]] = min(first.get(b[s : s + 50], d), d)
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 49):
            if d is not None and first[b[s : s + 50]] < d:
                gone[s : s + 50] = True
        gone = gone[:-1]
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(frame, rows):
    assert sorted(map(tuple, suffix.remove_repeats(frame).collect()), key=repr) == expected(rows)


def test_edges_match_brute_force(docs, edge_rows):
    check(docs(edge_rows, extra=True), edge_rows)


def test_documents_match_brute_force(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    check(frame, [tuple(r) for r in frame.select("doc_id", "text").collect()])


def test_random_overlaps_over_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 1_500)
    r = np.random.default_rng(4)
    source = "".join(r.choice(list("ab é"), 4_000))
    rows = []
    for i in range(120):
        parts = [source[a : a + int(r.integers(20, 160))] for a in r.integers(0, 3_900, 4)]
        rows.append((int(r.integers(0, 60)), "".join(parts)))
    check(docs(rows), rows)


def test_periodic_texts(docs):
    rows = [(i, "ab" * n) for i, n in enumerate([20, 24, 25, 26, 400, 60])] + [(9, "a" * 49), (10, "a" * 50), (11, "a" * 200), (12, "ba" * 90)]
    check(docs(rows), rows)


def test_suffix_rank_orders_by_fifty_bytes():
    r = np.random.default_rng(1)
    slots = r.integers(97, 99, (40, suffix.SLOT)).astype(np.uint8)
    slots[20:] = slots[:20]
    rank = suffix.suffix_rank(slots)
    flat = [(slots[i, j : j + 50].tobytes(), rank[i, j]) for i in range(40) for j in range(suffix.SPAN + 1)]
    flat.sort()
    for (a, x), (b, y) in zip(flat, flat[1:]):
        assert (x == y) if a == b else (x < y)


def test_cut_texts_keep_all_columns(docs, edge_rows):
    frame = docs(edge_rows, extra=True)
    cut = suffix.drop_repeats(frame)
    assert cut.columns == frame.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=repr)
    long = edge_rows[4][1]
    assert len(got) == len(edge_rows)
    assert got.count((5, long, len(long))) == 2
    assert (6, " tail", 5) in got or any(d == 6 and t is not None and len(t) < 60 for d, t, _ in got)
    assert (2, None, None) in got and (3, "", 0) in got


def test_empty_table(docs):
    assert suffix.remove_repeats(docs([])).collect() == []


def _phrase_rows(n):
    """A phrase of 30 bytes in every document, and a longer one in some, between different surroundings."""
    r = np.random.default_rng(6)
    phrase, longer = "All rights are reserved by us.", "This line stands in a good many of the documents as it is."
    rows = []
    for i in range(n):
        a, b, c = ("".join(r.choice(list("abcdé "), 40)) for _ in range(3))
        rows.append((i % (n - 5) if i % 9 else None, a + phrase + b + (longer + c if i % 3 else phrase * 2)))
    return rows + [(n + 1, rows[1][1]), (n + 2, rows[2][1][20:])]


def test_frequent_phrases_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 1_500)
    for hot in (0, 20):  # all shared anchors window by window, or the frequent ones only
        monkeypatch.setattr(suffix, "HOT", hot)
        rows = _phrase_rows(150)
        check(docs(rows), rows)


def test_frequent_phrase_is_no_single_bucket():
    import pyarrow as pa

    rows = [(d, t) for d, t in _phrase_rows(600) if d is not None]
    buckets, blocks = 64, []
    for k in range(4):
        part = rows[k::4]
        blocks.append(pa.table({"block": [k] * len(part), "_id": [d for d, _ in part], "text": [t for _, t in part]}))
    keys = pa.concat_tables([suffix._send_keys(buckets)(b) for b in blocks])
    flags = pa.concat_tables([suffix._find_shared(50)(keys.filter(pa.compute.equal(keys["bucket"], b))) for b in set(keys["bucket"].to_pylist())])
    size = np.zeros(buckets, int)
    for k, b in enumerate(blocks):
        parts = suffix._send_segments(buckets)(b, flags.filter(pa.compute.equal(flags["block"], k)))
        np.add.at(size, parts["bucket"].to_numpy(), parts["n"].to_numpy())
    assert size.max() < 3 * size.mean()


def test_rows_without_an_id_fill_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 60)
    rows = [(None, f"row number {i:05d}") for i in range(2_000)]
    salted = spark.createDataFrame(rows, "_id bigint, text string").selectExpr("*", "xxhash64(text) % 64 AS _salt")
    placed, _ = suffix._blocks(salted)
    assert placed.select("block").distinct().count() > 300


def test_previous_factors_match_all_pairs():
    r = np.random.default_rng(8)
    for n in (0, 1, 2, 60, 61):
        text = r.integers(0, 2, (n, 30))
        doc = r.integers(0, 12, n)
        order = np.lexsort([*text.T[::-1]]) if n else np.zeros(0, int)
        text, doc = text[order], doc[order]
        share = lambda a, b: int(np.argmax(np.r_[a != b, True]))
        gap = np.array([0, *(share(text[i - 1], text[i]) for i in range(1, n))][:n], np.int64)
        want = [max((share(text[i], text[j]) for j in range(n) if doc[j] < doc[i]), default=0) for i in range(n)]
        assert suffix.previous_factors(doc, gap).tolist() == want
    falling = np.arange(5_000)[::-1].copy()  # every entry is smaller than all before it
    assert suffix.previous_factors(falling, np.full(5_000, 50)).tolist() == [50] * 4_999 + [0]


def test_phrase_with_other_surroundings_in_every_document(docs, monkeypatch):
    """A phrase shorter than a window whose surroundings differ, and a passage in some of them."""
    r = np.random.default_rng(6)
    word = lambda: "".join(r.choice(list("abcdefgh"), 9))
    passage = " ".join(word() for _ in range(12))
    rows = [(i, f"{word()} {word()} the phrase of thirty-one bytes {word()} {word()}" + (passage if i % 5 == 0 else "")) for i in range(200)]
    for hot in (10_000, 20):
        monkeypatch.setattr(suffix, "HOT", hot)
        check(docs(rows), rows)
