from collections import Counter
import zlib

from fillsight.llm import langid


def brute_profile(text):
    """Grams of one letter, of two signs with a letter, and of three around a letter."""
    signs = [" "] + [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text] + [" "]
    grams = Counter(c for c in signs if c != " ")
    grams.update(a + b for a, b in zip(signs, signs[1:]) if a + b != "  ")
    grams.update(a + b + c for a, b, c in zip(signs, signs[1:], signs[2:]) if b != " ")

    def code(g):
        out = 0
        for c in g:
            out = (out << 21) | (1 if c == " " else ord(c))
        return out

    ranked = sorted(((-n, [0] * (3 - len(g)) + [1 if c == " " else ord(c) for c in g], g) for g, n in grams.items()))
    return [code(g) for _, _, g in ranked[: langid.PROFILE]]


def profiles_of(texts):
    out = {}
    for a, _, (doc, rank, gram) in langid.text_profiles(texts):
        for d, r, g in zip(doc.tolist(), rank.tolist(), gram.tolist()):
            out.setdefault(a + d, []).append(g)
            assert len(out[a + d]) == r + 1
    return [out.get(i, []) for i in range(len(texts))]


TEXTS = ["Hello hello world", "", "12 !?", "x", "Ünïcödé İstanbul ǅ 中文字 𝒳y", "a\0b a\tb", "Zz " * 50]


def test_profiles_match_brute_force(spark, sf, monkeypatch):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    want = [brute_profile(t) for t in texts]
    assert profiles_of(texts) == want
    monkeypatch.setattr(langid, "CHUNK_CHARS", 300)  # texts counted in parts, cut at white space
    assert profiles_of(texts) == want


def test_held_out_accuracy(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(frame).collect()}
    known = {r.doc_id: r.lang for r in frame.select("doc_id", "lang").collect()}
    held = [d for d in known if zlib.crc32(str(d).encode()) % 4 == 2]
    assert held and all(got[d].held_out for d in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[d].lang_pred == known[d] for d in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(docs, edge_rows):
    rows = [(d, t, "de" if i % 2 else None) for i, (d, t) in enumerate(edge_rows)]
    got = langid.identify(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    by_text = {(r.doc_id, r.lang_pred) for r in got}
    assert {(2, "und"), (3, "und"), (4, "und"), (None, "und")} <= by_text
    assert all(r.lang_pred in ("de", "und") and (r.lang_pred != "und" or r.score == 0) for r in got)
    assert langid.identify(docs([])).collect() == []
    assert {r.lang_pred for r in langid.identify(docs([(1, "no language is known")])).collect()} == {"und"}
