"""Removal of repeated byte strings with suffix order and longest previous factors.

A byte goes when some string of ``LENGTH`` bytes that covers it also starts in a document
with a smaller id. All strings of the corpus cannot meet in one suffix array, so they are
dealt first:

1. In every window of ``LENGTH`` bytes the 26-byte substring with the smallest hash is its
   anchor. Equal windows have equal anchors at the same offset, so windows are dealt by
   anchor, and consecutive windows with one anchor travel as one short segment.
2. Anchors go out as bare keys first, once per block of documents; only those found in two
   documents or more have their segments sent, again once per block and different segment,
   with the smallest id that holds it.
3. In a bucket the windows of an anchor are put in suffix order (to ``LENGTH`` bytes, by rank
   doubling), with what each shares with the one before it. The previous and the next smaller
   document in that order give the longest previous factor of every window, and a window
   goes where it reaches ``LENGTH``.
4. Blocks get one bit per window of their segments, and cut their texts.

An anchor on more than ``HOT`` places may have a different segment in every document, as a
phrase of 26 to 49 bytes brings its surroundings along. Its windows are therefore dealt one
by one, once per block with the smallest document of the block, by a 128-bit digest of their
bytes, which also is their place in the order; the longest previous factors follow as above.

What one task holds is a block of documents or a bucket of anchors and digests; both are
numbered from the total size of the texts. In a bucket an anchor has at most ``HOT`` segments
and a window of a more frequent anchor one row per block, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from fillsight.llm.common import row_chunks, text_buffer

LENGTH = 50
GRAM = 26
SPAN = LENGTH - GRAM  # an anchor may stand 0..SPAN bytes into its window
SLOT = LENGTH + SPAN  # a segment, aligned at its anchor
ALL = (1 << (SPAN + 1)) - 1  # every window of a segment
# Text per block of documents, and per bucket of anchors.
BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 4_000_000
# Places of an anchor up to which its segments meet in one bucket; a block reports counts above FEW.
HOT = 10_000
FEW = 3
_PIECE = 50_000  # frequent anchors of a block, and windows, that are handled at once

_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_LANES = np.random.default_rng(11).integers(1, 2**63, (2, 10), np.uint64) | np.uint64(1)
_POSITION = np.uint64((1 << 22) - 1)
_MAX, _MIN = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _gram_hash(x: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, from hashes of doubled lengths."""
    def join(a, b, length, right):
        n = min(len(a), len(b) - length)
        return a[:n] * np.uint64(pow(_BASE, right, 1 << 64)) + b[length : length + n]

    h1 = _TABLE[x]
    h2 = join(h1, h1, 1, 1)
    h4 = join(h2, h2, 2, 2)
    h8 = join(h4, h4, 4, 4)
    h16 = join(h8, h8, 8, 8)
    h24 = join(h16, h8, 16, 8)
    return _mix(join(h24, h2, 24, 2))


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, row ends) of byte ranges; a long row comes in pieces that overlap by one window."""
    step = 500_000
    for a, b in row_chunks(offsets, step):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a == 1 and hi - lo > step:
            for s in range(lo, hi - LENGTH + 1, step):
                e = min(s + step + LENGTH - 1, hi)
                yield s, e, np.array([e - s])
        else:
            yield lo, hi, offsets[a + 1 : b + 1] - lo


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, first window, last window, hash) of every run of windows with one anchor."""
    out = [[], [], [], []]
    for lo, hi, ends in _pieces(offsets):
        x = flat[lo:hi]
        if len(x) < LENGTH:
            continue
        g = _gram_hash(x)
        order = (g & ~_POSITION) | np.arange(len(g), dtype=np.uint64)
        width, smallest = 1, order
        while width * 2 <= SPAN + 1:
            smallest = np.minimum(smallest[:-width], smallest[width:])
            width *= 2
        rest = SPAN + 1 - width
        smallest = np.minimum(smallest[: len(smallest) - rest], smallest[rest:])
        valid = np.ones(len(smallest) + LENGTH, bool)
        tails = (ends[:, None] - np.arange(1, LENGTH)).ravel()
        valid[tails[tails >= 0]] = False
        starts = np.flatnonzero(valid[: len(smallest)])
        if not len(starts):
            continue
        at = (smallest[starts] & _POSITION).astype(np.int64)
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[new[1:], len(at)] - 1
        for store, values in zip(out, (at[new] + lo, starts[new] + lo, starts[last] + lo, g[at[new]])):
            store.append(values)
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds))


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return ((g & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _short(g: np.ndarray) -> np.ndarray:
    """32 bits beside the bucket: enough to leave out nearly all anchors of one document only."""
    return ((g >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _texts(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block in an order of their own values, their text and their ids."""
    group = group.combine_chunks().sort_by([("_id", "ascending"), ("text", "ascending")])
    flat, offsets = text_buffer(group.column("text"))
    ids = group.column("_id")
    return group, flat, offsets, ids.to_numpy(zero_copy_only=False) if ids.null_count == 0 else ids.fill_null(_MIN).to_numpy()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of a sorted column."""
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cut, [*cut[1:], len(bucket)]):
        yield int(bucket[a]), int(a), int(b)


def _block_keys(flat, offsets, ids, buckets):
    """Distinct (bucket, short key) of a block in order, and each anchor's place among them."""
    at, lo, hi, g = anchors(flat, offsets)
    both = (_bucket(g, buckets).astype(np.uint64) << np.uint64(32)) | _short(g).astype(np.uint64)
    keys, place = np.unique(both, return_inverse=True)
    row = np.searchsorted(offsets, at, side="right") - 1
    return at, lo, hi, g, row, keys, place


_KEYS = "block bigint, bucket bigint, keys binary, many binary, often binary"
_FLAGS = "block bigint, bucket bigint, flags binary, hot binary"
_PARTS = "block bigint, bucket bigint, n bigint, key binary, shape binary, doc binary, slots binary, windows binary"
_ANSWERS = "block bigint, bucket bigint, masks binary, bits binary"


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind, count: int) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), kind)


def _rows(columns: dict[str, list], like: str) -> pa.Table:
    types = {p.split()[0]: pa.int64() if p.split()[1] == "bigint" else pa.binary() for p in like.split(", ")}
    return pa.table({n: pa.array(columns.get(n, []), t) for n, t in types.items()})


def _send_keys(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        _, flat, offsets, ids = _texts(group)
        *_, row, keys, place = _block_keys(flat, offsets, ids, buckets)
        low, high = np.full(len(keys), _MAX), np.full(len(keys), _MIN)
        np.minimum.at(low, place, ids[row])
        np.maximum.at(high, place, ids[row])
        count = np.bincount(place, minlength=len(keys))
        out = {n: [] for n in ("block", "bucket", "keys", "many", "often")}
        for bucket, a, b in _by_bucket((keys >> np.uint64(32)).astype(np.int64)):
            out["block"].append(block)
            out["bucket"].append(bucket)
            out["keys"].append((keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            out["many"].append(np.packbits(low[a:b] != high[a:b]).tobytes())
            often = np.flatnonzero(count[a:b] > FEW)
            out["often"].append(np.stack([often, count[a:b][often]], 1).astype(np.uint32).tobytes())
        return _rows(out, _KEYS)

    return run


def _find_shared(hot: int):
    def run(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in group.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for k, m in zip(keys, group.column("many").to_pylist())]
        every = np.sort(np.concatenate([*keys, *[k[m] for k, m in zip(keys, many)]]))  # counted twice if in two documents
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        found = []
        places = np.zeros(len(shared), np.int64)  # of each shared key, or somewhat more
        for k, often in zip(keys, group.column("often").to_pylist()):
            place = np.minimum(np.searchsorted(shared, k), max(len(shared) - 1, 0))
            known = shared[place] == k if len(shared) else np.zeros(len(k), bool)
            count = np.full(len(k), FEW)
            index, number = np.frombuffer(often, np.uint32).reshape(-1, 2).T
            count[index] = number
            places[place[known]] += count[known]
            found.append((place, known))
        flags, single = [], []
        for place, known in found:
            frequent = known.copy()
            frequent[known] = places[place[known]] > hot
            flags.append(np.packbits(known & ~frequent).tobytes())
            single.append(np.flatnonzero(frequent).astype(np.uint32).tobytes())
        return _rows({"block": group.column("block").to_pylist(), "bucket": group.column("bucket").to_pylist(), "flags": flags, "hot": single}, _FLAGS)

    return run


def _same(slots: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representative, place): equal segments share a place; unequal ones never do."""
    lanes = np.zeros((len(slots), 80), np.uint8)
    lanes[:, :SLOT] = slots
    lanes[:, SLOT : SLOT + 2] = shape
    words = lanes.view(np.uint64)
    key = np.zeros(len(slots), np.uint64)
    for j in range(10):
        w = words[:, j] * _LANES[0, j]
        key += (w ^ (w >> np.uint64(32))) * _LANES[1, j]
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    odd = np.flatnonzero((words != words[first[place]]).any(1))  # equal hashes of unequal segments
    place[odd] = len(first) + np.arange(len(odd))
    first = np.r_[first, odd]
    order = np.argsort(first)  # in order of appearance
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    return first[order], rank[place]


@dataclass
class _Bucket:
    """Shared anchors of a block in one bucket, and their different segments."""

    bucket: int
    row: np.ndarray
    start: np.ndarray  # first window of each anchor
    key: np.ndarray
    shape: np.ndarray
    slots: np.ndarray
    first: np.ndarray  # anchor that stands for each different segment
    entry: np.ndarray  # segment of each anchor


def _shared_anchors(flat, offsets, ids, flags: dict[int, tuple[bytes, bytes]], buckets: int) -> list[tuple[np.ndarray, ...]]:
    """(position, first window, last window, hash, row) of the shared anchors: the rarer ones and the frequent ones."""
    at, lo, hi, g, row, keys, place = _block_keys(flat, offsets, ids, buckets)
    shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for bucket, a, b in _by_bucket((keys >> np.uint64(32)).astype(np.int64)):
        bits, single = flags[bucket]
        shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        hot[a + np.frombuffer(single, np.uint32).astype(np.int64)] = True
    return [tuple(x[use] for x in (at, lo, hi, g, row)) for use in (np.flatnonzero(shared[place]), np.flatnonzero(hot[place]))]


def _views(flat: np.ndarray) -> np.ndarray:
    padded = np.concatenate([np.zeros(SPAN, np.uint8), flat, np.zeros(SLOT, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, SLOT)


def _slots(views: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments aligned at their anchors, zero outside of their windows, and their shapes."""
    slots, column = views[at].copy(), np.arange(-SPAN, LENGTH)
    before = (at - lo)[:, None]
    width = (hi - lo + LENGTH)[:, None]
    slots[(column < -before) | (column >= width - before)] = 0
    return slots, np.stack([at - lo, hi - lo + 1], 1).astype(np.uint8)


def _segments(flat, anchors, buckets: int) -> Iterator[_Bucket]:
    use = np.argsort(_bucket(anchors[3], buckets), kind="stable")
    at, lo, hi, g, row = [x[use] for x in anchors]
    views = _views(flat)
    for bucket, a, b in _by_bucket(_bucket(g, buckets)):
        slots, shape = _slots(views, at[a:b], lo[a:b], hi[a:b])
        first, entry = _same(slots, shape)
        yield _Bucket(bucket, row[a:b], lo[a:b], _short(g[a:b]), shape, slots, first, entry)


@dataclass
class _Windows:
    """Different windows of the frequent anchors of a block, in order of bucket and digest."""

    bucket: np.ndarray
    digest: np.ndarray  # two words each
    doc: np.ndarray  # smallest document of the block
    pieces: list[tuple[np.ndarray, ...]]  # row, first window and segment of each anchor; windows, and their places, of each segment


def _digests(slots: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Two words for each window of the segments."""
    n = shape[:, 1].astype(np.int64)
    start = np.arange(len(slots)) * SLOT + SPAN - shape[:, 0]
    begin = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    view, digest = slots.tobytes(), xxhash.xxh3_128_digest
    parts = [b"".join([digest(view[b : b + LENGTH]) for b in begin[i : i + _PIECE].tolist()]) for i in range(0, len(begin), _PIECE)]
    return np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)


def _windows(flat, anchors, source: np.ndarray, buckets: int) -> _Windows:
    use = np.argsort(anchors[3], kind="stable")  # equal segments come together
    views, pieces, digests, docs = _views(flat), [], [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
    for i in range(0, len(use), _PIECE):
        at, lo, hi, _, row = [x[use[i : i + _PIECE]] for x in anchors]
        slots, shape = _slots(views, at, lo, hi)
        first, entry = _same(slots, shape)
        doc = np.full(len(first), _MAX)
        np.minimum.at(doc, entry, source[row])
        n = shape[first, 1].astype(np.int64)
        digests.append(_digests(slots[first], shape[first]))
        docs.append(np.repeat(doc, n))
        pieces.append((row, lo, entry, n))
    digest, doc = np.concatenate(digests), np.concatenate(docs)
    bucket = (digest[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, digest[:, 1], digest[:, 0], bucket))
    new = np.ones(len(order), bool)
    new[1:] = (digest[order[1:]] != digest[order[:-1]]).any(1)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    ends = np.cumsum([len(d) for d in docs[1:]], dtype=np.int64)
    one = order[new]
    return _Windows(bucket[one], digest[one], doc[one], [(*p, q) for p, q in zip(pieces, np.split(place, ends[:-1]))])


def _send_segments(buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return _rows({}, _PARTS)
        block = docs.column("block")[0].as_py()
        _, flat, offsets, ids = _texts(docs)
        source = np.where(ids == _MIN, _MAX, ids)  # rows without an id are nobody's source
        flags = {r["bucket"]: (r["flags"], r["hot"]) for r in replies.to_pylist()}
        rare, frequent = _shared_anchors(flat, offsets, ids, flags, buckets)
        out = {n: [] for n in ("block", "bucket", "n", "key", "shape", "doc", "slots", "windows")}
        for s in _segments(flat, rare, buckets):
            doc = np.full(len(s.first), _MAX)
            np.minimum.at(doc, s.entry, source[s.row])
            out["block"].append(block)
            out["bucket"].append(s.bucket)
            out["n"].append(len(doc))
            for name, value in (("key", s.key[s.first]), ("shape", s.shape[s.first]), ("doc", doc), ("slots", s.slots[s.first])):
                out[name].append(_pack(value))
            out["windows"].append(None)
        w = _windows(flat, frequent, source, buckets)
        for bucket, a, b in _by_bucket(w.bucket):
            row = {"block": block, "bucket": bucket, "n": b - a, "doc": _pack(w.doc[a:b]), "windows": w.digest[a:b].tobytes()}
            for name, values in out.items():
                values.append(row.get(name))
        return _rows(out, _PARTS)

    return run


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64).reshape(values.shape)


def suffix_rank(slots: np.ndarray) -> np.ndarray:
    """Rank in suffix order, to LENGTH bytes, of the first SPAN + 1 positions of each slot."""
    n = len(slots)
    word = np.zeros((n, SLOT - 7), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | slots[:, k : k + SLOT - 7].astype(np.uint64)
    rank, depth = _dense(word), 8
    while depth * 2 <= LENGTH:
        rank = _dense((rank[:, : rank.shape[1] - depth] << np.uint64(32)) | rank[:, depth:])
        depth *= 2
    rest = LENGTH - depth
    return _dense((rank[:, : SPAN + 1] << np.uint64(32)) | rank[:, rest : rest + SPAN + 1])


def common_prefix(slots: np.ndarray, seg: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Bytes (up to LENGTH) that each window shares with the one before it; 0 for the first."""
    out, views = np.zeros(len(seg), np.int64), np.lib.stride_tricks.sliding_window_view(slots, LENGTH, 1)
    for i in range(1, len(seg), _PIECE):
        j = min(i + _PIECE, len(seg))
        differ = views[seg[i:j], col[i:j]] != views[seg[i - 1 : j - 1], col[i - 1 : j - 1]]
        out[i:j] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    return out


def _to_smaller(doc: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Longest prefix shared with the last entry before each that has a smaller document; 0 without one.

    ``gap`` is what an entry shares with the one before it. Every entry points back over entries
    with documents that are not smaller; pointers jump along pointers until all rest on a
    smaller document, and the least gap on the way is what is shared.
    """
    n = len(doc)
    docs = np.concatenate([[_MIN], doc])  # a sentinel before the first
    back, shared = np.arange(n + 1) - 1, np.concatenate([[0], gap])
    back[0] = 0
    if n:
        shared[1] = 0
    move = np.flatnonzero(docs[back] >= docs)
    move = move[back[move] > 0]
    while len(move):
        at = back[move]
        shared[move] = np.minimum(shared[move], shared[at])
        back[move] = back[at]
        move = move[(back[move] > 0) & (docs[back[move]] >= docs[move])]
    shared[back == 0] = 0
    return shared[1:]


def previous_factors(doc: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, the suffixes being in suffix order.

    An earlier match lies at the nearest smaller document before or after it in that order
    (the previous and the next smaller value): all others share no more.
    """
    after = np.concatenate([[0], gap[:0:-1]])[: len(doc)]  # the gaps of the reversed order
    return np.maximum(_to_smaller(doc, gap), _to_smaller(doc[::-1], after)[::-1])


def covered(slots: np.ndarray, shape: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bit mask per segment: its windows whose longest previous factor reaches LENGTH."""
    rank = suffix_rank(slots)
    column = np.arange(SPAN + 1)
    start = SPAN - shape[:, :1].astype(np.int64)
    inside = (column >= start) & (column < start + shape[:, 1:].astype(np.int64))
    seg, col = np.nonzero(inside)
    order = np.lexsort((doc[seg], rank[seg, col]))
    seg, col = seg[order], col[order]
    gone = previous_factors(doc[seg], common_prefix(slots, seg, col)) >= LENGTH
    out = np.zeros(len(slots), np.uint32)
    np.bitwise_or.at(out, seg[gone], np.uint32(1) << (col - start[seg, 0])[gone].astype(np.uint32))
    return out


def _answer(group: pa.Table) -> pa.Table:
    single = group.column("windows").is_valid()
    parts = [(_answer_windows, group.filter(single)), (_answer_segments, group.filter(pc.invert(single)))]
    return pa.concat_tables([fn(part) for fn, part in parts if part.num_rows])


def _answer_windows(group: pa.Table) -> pa.Table:
    """One bit per window: its longest previous factor reaches LENGTH. Equal digests stand for equal windows."""
    sizes = group.column("n").to_pylist()
    digest = np.concatenate([np.frombuffer(w, np.uint64) for w in group.column("windows").to_pylist()]).reshape(-1, 2)
    doc = np.concatenate([_unpack(d, np.int64, n) for d, n in zip(group.column("doc").to_pylist(), sizes)])
    order = np.lexsort((doc, digest[:, 1], digest[:, 0]))
    gap = np.zeros(len(order), np.int64)
    gap[1:] = np.where((digest[order[1:]] == digest[order[:-1]]).all(1), LENGTH, 0)
    gone = np.empty(len(order), bool)
    gone[order] = previous_factors(doc[order], gap) >= LENGTH
    bits = [np.packbits(g).tobytes() for g in np.split(gone, np.cumsum(sizes)[:-1])]
    return _rows({"block": group.column("block").to_pylist(), "bucket": group.column("bucket").to_pylist(), "masks": [None] * len(sizes), "bits": bits}, _ANSWERS)


def _answer_segments(group: pa.Table) -> pa.Table:
    sizes = group.column("n").to_pylist()

    def column(name, kind, width=1):
        parts = [_unpack(x, kind, n * width) for x, n in zip(group.column(name).to_pylist(), sizes)]
        return np.concatenate(parts).reshape(-1, width) if width > 1 else np.concatenate(parts)

    # other anchors may have the same short key: their segments are compared, and differ
    key, doc, shape, slots = column("key", np.uint32), column("doc", np.int64), column("shape", np.uint8, 2), column("slots", np.uint8, SLOT)
    first, place = _same(slots, shape)
    smallest = np.full(len(first), _MAX)
    np.minimum.at(smallest, place, doc)
    # the windows of an anchor with one segment occur once: their suffix order is trivial
    _, kind, count = np.unique(key[first], return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[kind] > 1)
    masks = np.zeros(len(first), np.uint32)
    if len(mixed):
        mixed = mixed[np.argsort(kind[mixed], kind="stable")]
        bounds = np.flatnonzero(np.r_[True, kind[mixed][1:] != kind[mixed][:-1]])
        for lo, hi in _spans(bounds, len(mixed)):
            part = mixed[lo:hi]
            masks[part] = covered(slots[first[part]], shape[first[part]], smallest[part])
    # an equal segment in a smaller document covers all windows
    answer = np.where(doc > smallest[place], ALL, masks[place]).astype(np.uint32)
    return _rows({
        "block": group.column("block").to_pylist(), "bucket": group.column("bucket").to_pylist(),
        "masks": [_pack(m) for m in np.split(answer, np.cumsum(sizes)[:-1])], "bits": [None] * len(sizes),
    }, _ANSWERS)


def _spans(bounds: np.ndarray, n: int, limit: int = 20_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups with about ``limit`` members; a larger group is a range of its own."""
    lo = 0
    for b in [*bounds[1:].tolist(), n]:
        if b - lo >= limit or b == n:
            yield lo, b
            lo = b


def _cut(columns: list[str], texts: bool, buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs, flat, offsets, ids = _texts(docs)
        depth = np.zeros(len(flat) + 1, np.int32)
        flags, answers, singles = {}, {}, {}
        for r in replies.to_pylist():
            if r["flags"] is not None:
                flags[r["bucket"]] = r["flags"], r["hot"]
            elif r["masks"] is None:
                singles[r["bucket"]] = r["bits"]
            else:
                answers[r["bucket"]] = r["masks"]
        source = np.where(ids == _MIN, _MAX, ids)
        rare, frequent = _shared_anchors(flat, offsets, ids, flags, buckets) if answers or singles else (None, None)
        column = np.arange(SPAN + 1, dtype=np.uint32)
        for s in _segments(flat, rare, buckets) if answers else ():
            masks = _unpack(answers[s.bucket], np.uint32, len(s.first))
            doc = np.full(len(s.first), _MAX)
            np.minimum.at(doc, s.entry, source[s.row])
            # later documents of this block that hold the segment lose all its windows
            mask = np.where(ids[s.row] > doc[s.entry], ALL, masks[s.entry]).astype(np.uint32)
            mask[ids[s.row] == _MIN] = 0
            gone = ((mask[:, None] >> column) & np.uint32(1)).astype(bool) & (column < s.shape[:, 1:])
            anchor, offset = np.nonzero(gone)
            np.add.at(depth, s.start[anchor] + offset, 1)
            np.add.at(depth, s.start[anchor] + offset + LENGTH, -1)
        if singles:
            w = _windows(flat, frequent, source, buckets)
            bits = np.zeros(len(w.doc), bool)
            for bucket, a, b in _by_bucket(w.bucket):
                bits[a:b] = np.unpackbits(np.frombuffer(singles[bucket], np.uint8), count=b - a)
            for row, start, entry, n, place in w.pieces:
                base, n = (np.cumsum(n) - n)[entry], n[entry]
                before, each = np.cumsum(n) - n, np.arange(int(n.sum()))
                window, at = np.repeat(start - before, n) + each, place[np.repeat(base - before, n) + each]
                own = ids[np.repeat(row, n)]
                gone = (bits[at] | (own > w.doc[at])) & (own != _MIN)
                np.add.at(depth, window[gone], 1)
                np.add.at(depth, window[gone] + LENGTH, -1)
        removed = np.cumsum(depth[:-1], dtype=np.int32) > 0
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        starts = offsets[:-1][np.diff(offsets) > 0]
        begins[starts] = removed[starts]
        where, runs = np.flatnonzero(removed), np.flatnonzero(begins)
        n_removed, n_spans = np.diff(np.searchsorted(where, offsets)), np.diff(np.searchsorted(runs, offsets))
        kept = [flat[a:b][~removed[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        out = {c: docs.column(c) for c in columns}
        if texts:
            was_null = docs.column("text").is_null().to_pylist()
            left = [None if z else k.decode("utf-8", "ignore") for k, z in zip(kept, was_null)]
            out |= {"text": pa.array(left, pa.string())}
        else:
            out |= {
                "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            }
        return pa.table(out)

    return run


def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with its block, and the number of buckets: both follow the size of the texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    # one id may be on many rows: their texts spread them over the blocks
    block = F.pmod(F.xxhash64("_id", "text"), F.lit(n))
    return docs.withColumn("block", block), total // BUCKET_BYTES + 1


def _remove(docs: DataFrame, columns: list[str], texts: bool, schema: str) -> DataFrame:
    """``docs`` has _id and text beside ``columns``."""
    placed, buckets = _blocks(docs)
    # the same exchange of texts serves all three visits of a block
    keys = placed.groupBy("block").applyInArrow(_send_keys(buckets), _KEYS)
    flags = keys.groupBy("bucket").applyInArrow(_find_shared(HOT), _FLAGS)
    parts = placed.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_send_segments(buckets), _PARTS)
    answers = parts.groupBy("bucket").applyInArrow(_answer, _ANSWERS)
    replies = flags.unionByName(answers, allowMissingColumns=True)
    return placed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_cut(columns, texts, buckets), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    NULL and empty texts have no bytes. Rows that share an id do not remove each other's
    bytes; a row without an id removes nothing and loses nothing. Columns beside doc_id and
    text are not read.
    """
    base = docs.select(F.col("doc_id"), F.col("doc_id").cast("bigint").alias("_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return _remove(base, ["doc_id"], False, schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``, all columns, with the repeated bytes cut out of its text.

    A character that loses some of its bytes goes whole; ``n_chars`` follows the new text.
    """
    others = [c for c in docs.columns if c != "text"]
    safe = {c: f"_c{i}" for i, c in enumerate(others)}
    base = docs.select(*[F.col(f"`{c}`").alias(s) for c, s in safe.items()], F.col("doc_id").cast("bigint").alias("_id"), "text")
    schema = ", ".join([f"{safe[c]} {docs.schema[c].dataType.simpleString()}" for c in others] + ["text string"])
    cut = _remove(base, list(safe.values()), True, schema)
    named = cut.select(*[F.col("text" if c == "text" else safe[c]).alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        named = named.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return named
