"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that its encoding ends in, and
an encoding is right when each pair of neighbours in it is compatible, that is when merging
the bytes of both would give back the same two tokens. So a table with the last token of
each prefix holds the encodings of all prefixes: text appended later only adds entries, and
after an edit the table is the old one again as soon as a full token length of entries agrees.

Pieces are found for whole chunks of text with array operations on character classes, each
different piece is encoded once per worker (a bounded memory that only saves time), and in
sorted order, so that a piece starts from the table of the prefix it shares with the last.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fillsight.llm.common import map_texts

CHUNK_CHARS = 500_000
MEMORY_PIECES = 150_000
# The pattern of the public encoder, a fixed value; ``piece_bounds`` finds its matches by array operations.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _SPACE = 1, 2, 3
# where a run of letters of any script ends a piece ends, and the pattern never looks back
_SAFE_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})")


def load_ranks(path: str) -> bytes:
    """The rank file as it is: one line per token, base64 bytes and rank."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Tokens by rank, how each is merged, and which neighbours are compatible."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.longest = max(map(len, ranks), default=1)
        # when a token is merged: single bytes are there from the start
        self.time = [-1 if len(t) == 1 else i for i, t in enumerate(self.tokens)]
        self.halves: list[tuple[int, int] | None] = [None] * size
        self._pairs: dict[int, bool] = {}
        self._size = size
        reachable = []
        for i, token in enumerate(self.tokens):
            if len(token) == 1:
                reachable.append(token)
            for j in range(1, len(token)):
                a, b = ranks.get(token[:j], size), ranks.get(token[j:], size)
                if a < i and b < i and (self.halves[a] or self.time[a] < 0) and (self.halves[b] or self.time[b] < 0):
                    if self.compatible(a, b, i):
                        self.halves[i] = (a, b)
                        reachable.append(token)
                        break
        # every ending of a token, and the token if the ending is one
        self.endings: dict[bytes, int] = {}
        for token in reachable:
            for j in range(1, len(token)):
                self.endings.setdefault(token[j:], -1)
        for token in reachable:
            self.endings[token] = ranks[token]

    def compatible(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether no merge joins the end of ``a`` with the start of ``b`` (of merges before ``limit``).

        Goes back in time: the later of the two merges is undone, which uncovers the pieces
        that stood at the seam before it; a merge of these two would have come first if its
        rank is below the merges that used them up. Of equal ranks the left one comes first.
        """
        ranks, tokens, time, halves = self.ranks, self.tokens, self.time, self.halves
        end_a = end_b = self._size if limit is None else limit
        if limit is not None:
            end_b -= 1
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < end_a and joined <= end_b:
                return False
            if time[a] > time[b]:
                end_a, a = time[a], halves[a][1]
            elif time[b] >= 0:
                end_b, b = time[b], halves[b][0]
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        key = a * self._size + b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 400_000:
                self._pairs.clear()
            known = self._pairs[key] = self.compatible(a, b)
        return known

    def extend(self, last: list[int], data: bytes, upto: int | None = None) -> None:
        """Add to ``last`` (entry i: last token of the first i bytes) the entries that ``data`` still lacks."""
        endings, tokens, pairs, size = self.endings, self.tokens, self._pairs, self._size
        for end in range(len(last), (len(data) if upto is None else upto) + 1):
            start = end - 1
            while True:
                token = endings.get(data[start:end])
                if token is None:
                    raise ValueError(f"no token for byte {data[end - 1]}")
                if token >= 0:
                    if start == 0:
                        break
                    known = pairs.get(last[start] * size + token)
                    if known is None:
                        known = self.follows(last[start], token)
                    if known:
                        break
                start -= 1
            last.append(token)

    def read(self, last: list[int], end: int) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        out = []
        while end > 0:
            token = last[end]
            out.append(token)
            end -= len(self.tokens[token])
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(last, piece)
        return self.read(last, len(piece))

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Encodings of sorted pieces; each keeps the table of the prefix it shares with the one before."""
        before, last = b"", [-1]
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                yield (whole,)
                continue
            n, same = min(len(before), len(piece)), 0
            if before[:n] == piece[:n]:
                same = n
            else:
                while before[same] == piece[same]:
                    same += 1
            del last[same + 1 :]
            self.extend(last, piece)
            before = piece
            yield tuple(self.read(last, len(piece)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The encodings of all prefixes of one byte string, under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.last, self.data)

    def tokens(self, end: int | None = None) -> list[int]:
        return self.vocabulary.read(self.last, len(self.data) if end is None else end)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start..stop; returns how many entries were computed again."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        agree, end = 0, start
        while end < len(self.data):
            end += 1
            self.vocabulary.extend(self.last, self.data, end)
            back = end - shift
            agree = agree + 1 if back > stop and old[back] == self.last[end] else 0
            # an entry depends on as many entries before it as the longest token has bytes
            if agree >= self.vocabulary.longest:
                self.last += old[back + 1 :]
                break
        return end - start


_tables: dict = {}


def vocabulary(rank_file: bytes) -> Vocabulary:
    """The vocabulary of a rank file, built once per process."""
    key = hashlib.sha256(rank_file).digest()
    if key not in _tables:
        _tables.clear()
        _tables[key] = Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)})
    return _tables[key]


def _classes() -> np.ndarray:
    if "classes" not in _state:
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end()))
                table[a:b] = kind
        _state["classes"] = table
    return _state["classes"]


_state: dict = {}


def piece_bounds(text: str, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of ``text`` begin; ``starts`` are the beginnings of the documents in it.

    Same pieces as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    kind = _classes()[code]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    run = change | first
    space = kind == _SPACE
    blank = code == 32
    begin = np.zeros(n + 1, bool)
    begin[:n] = run[:n]
    # a word, number or symbol run takes one blank before it
    glued = np.zeros(n, bool)
    glued[1:] = run[1:n] & ~space[1:] & blank[:-1] & ~first[1:n]
    begin[:n] &= ~glued
    # the last space of a run before something else stands alone or is that blank
    tail = np.zeros(n, bool)
    tail[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    begin[:n] |= tail
    quote = np.flatnonzero((code == 39) & begin[:n] & run[:n] & run[1:])
    if len(quote):
        padded = np.concatenate([code, np.zeros(3, np.uint32)])
        inside1 = ~first[np.minimum(quote + 1, n)]
        inside2 = inside1 & ~first[np.minimum(quote + 2, n)]
        a, b = padded[quote + 1], padded[quote + 2]
        one = inside1 & np.isin(a, [ord(c) for c in "stmd"])
        two = inside2 & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for q, width in ((quote[one], 2), (quote[two], 3)):
            begin[q + 1] = False
            begin[q + width] = True
    begin[n] = False
    return np.flatnonzero(begin)


def _segments(text: str) -> Iterator[str]:
    """A text in pieces of about a chunk, cut only where the pattern cuts too."""
    start = 0
    while len(text) - start > CHUNK_CHARS:
        cut = _SAFE_CUT.search(text, start + CHUNK_CHARS)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_texts(vocab: Vocabulary, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(index of the text, token ids) in order; a very long text comes in several parts."""
    memory = _state.setdefault("memory", {})
    if _state.get("vocab") is not vocab:
        memory.clear()
        _state["vocab"] = vocab
    group: list[tuple[int, str]] = []
    size = 0

    def flush():
        joined = "".join(s for _, s in group)
        starts = np.cumsum([0] + [len(s) for _, s in group])
        bounds = piece_bounds(joined, starts[:-1][np.diff(starts) > 0])
        edges = [*bounds.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(edges, edges[1:])]
        if len(memory) > MEMORY_PIECES:
            memory.clear()
        new = sorted({p: None for p in pieces if p not in memory})
        for piece, ids in zip(new, vocab.encode_sorted([p.encode("utf-8", "surrogatepass") for p in new])):
            memory[piece] = ids
        place = np.searchsorted(bounds, starts).tolist()
        for k, (i, _) in enumerate(group):
            yield i, list(chain.from_iterable(map(memory.__getitem__, pieces[place[k] : place[k + 1]])))

    for i, text in enumerate(texts):
        for segment in _segments(text):
            group.append((i, segment))
            size += len(segment)
            if size >= CHUNK_CHARS:
                yield from flush()
                group, size = [], 0
    if group:
        yield from flush()


def _digests(vocab: Vocabulary, column: pa.Array) -> dict[str, pa.Array]:
    if "names" not in _state or len(_state["names"]) < len(vocab.tokens):
        _state["names"] = [str(i) for i in range(len(vocab.tokens))]
    names = _state["names"]
    texts = [t or "" for t in column.to_pylist()]
    count = [0] * len(texts)
    ids_hash = [hashlib.sha256() for _ in texts]
    text_hash = [hashlib.sha256() for _ in texts]
    for i, ids in encode_texts(vocab, texts):
        if ids:
            ids_hash[i].update(((" " if count[i] else "") + " ".join(map(names.__getitem__, ids))).encode())
            text_hash[i].update(vocab.decode(ids))
            count[i] += len(ids)
    return {
        "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array([h.hexdigest() for h in ids_hash]),
        "decoded_sha256": pa.array([h.hexdigest() for h in text_hash]),
    }


def digests(docs: DataFrame, rank_file: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``.

    NULL and empty texts have no tokens. Columns beside doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)  # under 1 MB, whatever the corpus
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, lambda b: _digests(vocabulary(shared.value), b.column("text")), schema, ["doc_id"])


def tokenized(docs: DataFrame, rank_file: bytes) -> DataFrame:
    """doc_id, token_ids and the digest columns for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batch):
        vocab, texts = vocabulary(shared.value), [t or "" for t in batch.column("text").to_pylist()]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for i, ids in encode_texts(vocab, texts):
            parts[i].append(np.array(ids, np.int32))
        flat = [np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
        values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        ids_hash = [hashlib.sha256(" ".join(map(str, f.tolist())).encode()).hexdigest() for f in flat]
        text_hash = [hashlib.sha256(vocab.decode(f.tolist())).hexdigest() for f in flat]
        return {
            "token_ids": lists, "n_tokens": pa.array(np.diff(offsets).astype(np.int64)), "ids_sha256": pa.array(ids_hash),
            "decoded_sha256": pa.array(text_hash),
        }

    schema = "token_ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, run, schema, ["doc_id"])


def decoded(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """doc_id and the text of its token_ids; NULL ids give NULL."""
    shared = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batch):
        vocab = vocabulary(shared.value)
        texts = [None if i is None else vocab.decode(i).decode("utf-8", "replace") for i in batch.column("token_ids").to_pylist()]
        return {"text": pa.array(texts, pa.string())}

    return map_texts(encoded, run, "text string", ["doc_id"], "token_ids")
