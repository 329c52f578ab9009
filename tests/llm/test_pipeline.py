import corpus_pipeline
from fillsight.llm import quality
from tests.llm import test_decontam, test_simhash


def test_stages_and_columns(spark, docs, edge_rows):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    frame = docs(edge_rows, extra=True)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, frame, "/root/testdata/sf0.001").columns == frame.columns


def test_run_matches_brute_force(spark, sf):
    """Every stage after the classifier, whose own decisions are taken as they are, by plain Python."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from fillsight.llm import bpe

    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.classify(documents, labels).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if r.doc_id in good]
    first = {d: c for d, _, c in test_simhash.expected(rows)}
    rows = [(d, t) for d, t in rows if first[d] == d]
    gone = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for d, b in sorted(data):
        for s in range(len(b) - 49):
            seen.setdefault(b[s : s + 50], d)
    for d, b in data:
        keep = bytearray(b"\1" * len(b))
        for s in range(len(b) - 49):
            if seen[b[s : s + 50]] < d:
                keep[s : s + 50] = bytes(50)
        gone[d] = bytes(c for c, k in zip(b, keep) if k).decode("utf-8", "ignore")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(d, gone[d]) for d, _ in rows]
    clean = {r[0] for r in test_decontam.expected(rows, items) if not r[5]}
    vocab = bpe.vocabulary(corpus_pipeline.rank_file())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    want = []
    for d, t in rows:
        if d in clean:
            ids = plain.encode_ordinary(t)
            want.append((d, ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert 0 < len(got) < len(good)


def test_registered_beside_the_other_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
