import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from fillsight.llm import bpe

FILE = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(FILE)


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def random_texts(n, seed=1):
    r = random.Random(seed)
    signs = list("abctsmdrevl''''  \n\t12٣é中𝒳😀!?#_\x1c\x85 　ABС") + ["'re", "'ll", "'ve", "  ", "don't", "   \n", "<|endoftext|>"]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_pieces_and_ids_equal_the_public_encoder(vocab, reference):
    texts = random_texts(3_000) + ["", "a" * 3_000, "aab" * 999, " " * 999, "'" * 300, "é" * 999]
    got = {}
    for i, ids in bpe.encode_texts(vocab, texts):
        got.setdefault(i, []).extend(ids)
    assert [got.get(i, []) for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_safely(vocab, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 200)
    texts = [" ".join(random_texts(200, 2)), "word " * 400, "x" * 1_000, "a  b" * 300]
    got = {}
    for i, ids in bpe.encode_texts(vocab, texts):
        got.setdefault(i, []).extend(ids)
    assert [got[i] for i in range(4)] == [reference.encode_ordinary(t) for t in texts]


def test_prefix_table_under_appends_and_edits(vocab, reference):
    r = random.Random(5)
    letters = "thenationing" * 6
    table = bpe.PrefixTable(vocab)
    for _ in range(12):
        table.append("".join(r.choice(letters) for _ in range(r.randint(1, 30))).encode())
        for end in (len(table.data), len(table.data) // 2):
            assert table.tokens(end) == reference._encode_single_piece(table.data[:end])
    for _ in range(60):
        a = r.randrange(len(table.data))
        b = min(len(table.data), a + r.randint(0, 5))
        table.edit(a, b, "".join(r.choice(letters) for _ in range(r.randint(0, 6))).encode())
        fresh = bpe.PrefixTable(vocab, table.data)
        assert table.last == fresh.last
    assert vocab.decode(table.tokens()) == table.data


def test_an_edit_recomputes_near_it_only(vocab):
    vocab_longest, vocab.longest = vocab.longest, 20
    try:
        table = bpe.PrefixTable(vocab, b"thenationing" * 500)
        assert table.edit(3_000, 3_001, b"zz") < 400
    finally:
        vocab.longest = vocab_longest


def test_query_columns(docs, edge_rows, vocab, reference):
    want = []
    for d, t in edge_rows:
        ids = reference.encode_ordinary(t or "")
        text = hashlib.sha256((t or "").encode()).hexdigest()
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text))
    frame = docs(edge_rows, extra=True)
    assert sorted(map(tuple, bpe.digests(frame, FILE).collect()), key=repr) == sorted(want, key=repr)
    made = bpe.tokenized(frame, FILE)
    assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in made.collect()), key=repr) == sorted(want, key=repr)
    back = bpe.decoded(made, FILE).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((d, t or "") for d, t in edge_rows), key=repr)
    assert bpe.digests(docs([]), FILE).collect() == []


def test_long_texts_of_any_script_are_cut(vocab, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 500)
    r = random.Random(4)
    scripts = ["абвгдеж", "αβγδε", "中文字，。", "אבגד", "한국어 ", "don't we'll "]
    texts = ["".join(r.choice(s) for _ in range(3_000)) if " " in s or "，" in s else " ".join("".join(r.choice(s) for _ in range(r.randint(1, 9))) for _ in range(600)) for s in scripts]
    for t in texts:
        parts = list(bpe._segments(t))
        assert "".join(parts) == t and len(parts) > 3 and max(map(len, parts)) < 700
    got = {}
    for i, ids in bpe.encode_texts(vocab, texts):
        got.setdefault(i, []).extend(ids)
    assert [got[i] for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]
