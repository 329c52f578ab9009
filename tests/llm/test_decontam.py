import hashlib
import re

from fillsight.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in windows}:
            for s in range(len(w) - n + 1):
                g = tuple(w[s : s + n])
                if g in windows:
                    hit |= set(range(s, s + n))
                    found |= {str(i) for i in windows[g] if i is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (20, "Short ITEM"), (3, None), (4, ""), (5, "..."),
    (100, "one two three four five six seven eight nine ten"), (None, "no id here at all"), (20, "short item"), (6, "a a a a a a a a a a a a"),
]
TEXT = "One, two; three four five six seven eight nine ten eleven twelve!"


def rows():
    return [
        (1, TEXT), (2, TEXT.replace("six", "sIx")), (3, "x " + TEXT + " short item " + TEXT), (4, "short. item"), (4, "item short"),
        (5, None), (6, ""), (None, "no id here at all"), (None, "nothing"), (7, "one two three four five six seven eight nine"),
        (8, "a " * 30), (9, "ÉCOLE short ITEM été"), (10, "y " * 3_000 + TEXT), (1, TEXT),
    ]


def test_edges_match_brute_force(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontam.report(docs(rows(), extra=True), items).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows(), ITEMS)


def test_shuffled_terms_give_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontam.report(docs(rows()), items).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows(), ITEMS)


def test_documents_match_brute_force(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    pairs = [tuple(r) for r in d.select("doc_id", "text").collect()]
    want = expected(pairs, [tuple(r) for r in b.select("item_id", "text").collect()])
    assert sorted(map(tuple, decontam.report(d, b).collect()), key=repr) == want
    assert any(r[5] for r in want)


def test_empty_tables_and_drop(spark, docs):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.report(docs([]), items).collect() == []
    assert not any(r.contaminated for r in decontam.report(docs(rows()), items).collect())
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    frame = docs(rows(), extra=True)
    kept = decontam.drop_contaminated(frame, items)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in expected(rows(), ITEMS) if not r[5]), key=repr)


def test_proximity(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gamma")], "item_id bigint, text string")
    frame = docs([(1, "alpha x x beta"), (2, "Beta alpha"), (3, "alpha"), (4, "gamma x beta"), (5, None)])
    near = lambda slop: {tuple(r) for r in decontam.proximity(frame, items, slop).collect()}
    assert near(0) == {(2, 1)}
    assert near(1) == {(2, 1), (4, 2)}
    assert near(2) == {(2, 1), (4, 2), (1, 1)}


def test_no_python_in_the_plan(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    plan = decontam.report(docs(rows()), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rows_without_an_id_share_no_candidates(spark, docs):
    items = spark.createDataFrame(ITEMS[:1], "item_id bigint, text string")
    frame = docs([(None, "x " * i + TEXT) for i in range(40)] + [(7, "y " * i + TEXT) for i in range(40)])
    keyed = frame.withColumn("key", decontam._key())
    near = decontam.candidates(keyed.select("key", "text"), decontam.windows(items))
    sizes = [r["count"] for r in near.groupBy("key").count().collect()]
    assert len(sizes) == 80 and max(sizes) == 3
