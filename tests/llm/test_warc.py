import base64
import gzip
import hashlib
import io

import pytest

from fillsight.llm import warc
from fillsight.session import materialize

SCHEMA = "page_id bigint, url string, html string, archive string, sha1 string, data string, n string"
BIG = "".join(f"<p>{i * 7919 % 10007}</p>" for i in range(40_000))
ROWS = [
    (1, "http://a/ü b\r\nX: y", "<p>hé</p>"), (2, None, None), (3, "u", ""), (4, "u", BIG), (5, "u", "<p>hé</p>"), (5, "v", "<p>hé</p>"),
    (None, "u", "<p>hé</p>"), (None, None, "alone"), (None, None, "alone"), (6, "u", "WARC/1.1\r\n\r\n\r\n\r\n"), (7, "u", BIG), (-8, "u", "x"),
]


def expected(rows):
    groups = {}
    for page, _, html in rows:
        if page is not None:
            groups[html or ""] = max(page, groups.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = groups.get(html or "")
        other = last if last is not None and page != last else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if other is None else "revisit", other))
    return sorted(out, key=repr)


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def test_round_trip_of_edges(pages, monkeypatch):
    got = warc.round_trip(pages(ROWS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS)


def test_pages_match_brute_force(spark, sf):
    frame = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in frame.select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=repr) == expected(rows)


def test_chunks_and_incremental_digests(pages):
    chunks = warc.write_archives(warc.plan_records(pages([(1, "u", BIG)]))).collect()
    own = sorted((r for r in chunks), key=lambda r: r.chunk)
    assert len(own) > 2 and [r.chunk for r in own] == list(range(len(own)))
    assert own[-1].sha1 == hashlib.sha1(BIG.encode()).hexdigest() and own[0].sha1 != own[-1].sha1
    data = gzip.GzipFile(fileobj=io.BytesIO(b"".join(bytes(r.data) for r in own))).read()
    head, _, rest = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and rest.endswith(BIG.encode() + b"\r\n\r\n")


def test_reader_takes_any_cuts_and_finds_damage(pages):
    chunks = warc.write_archives(warc.plan_records(pages(ROWS))).collect()
    by = {}
    for r in sorted(chunks, key=lambda r: (r.archive, r.position, r.chunk)):
        by.setdefault(r.archive, []).append(bytes(r.data))
    found = []
    for parts in by.values():
        whole = b"".join(parts)
        reader = warc.RecordReader()
        for i in range(0, len(whole), 7):
            reader.feed(whole[i : i + 7])
        found += reader.found
    assert sorted(found, key=repr) == expected(ROWS)
    with pytest.raises(ValueError):
        reader = warc.RecordReader()
        reader.feed(gzip.compress(gzip.decompress(whole) + b"!"))


def test_archives_roll_over(pages, monkeypatch):
    table = materialize(warc.write_archives(warc.plan_records(pages(ROWS))))
    assert table.select("archive").distinct().count() >= 1
    assert warc.round_trip(pages([])).collect() == []


def test_long_equal_bytes_never_inflate_beyond_a_chunk(pages):
    """50 MB of one byte compress to almost nothing."""
    chunks = warc.write_archives(warc.plan_records(pages([(1, "u", "a" * 50_000_000), (2, "u", "b")])))
    reader, plain = warc.RecordReader(), 0
    for r in sorted(chunks.collect(), key=lambda r: (r.archive, r.position, r.chunk)):
        reader.feed_row(r.record_id, r.chunk, bytes(r.data), r.sha1)
        plain += 1
    assert plain >= 50_000_000 // warc.CHUNK_BYTES and reader.most <= warc.CHUNK_BYTES
    assert [(f[0], f[1]) for f in reader.found] == [(1, 50_000_000), (2, 1)]


def test_damaged_and_missing_chunks_are_found(pages):
    rows = sorted(warc.write_archives(warc.plan_records(pages([(1, "u", BIG)]))).collect(), key=lambda r: r.chunk)
    assert len(rows) > 3

    def read(rows):
        reader = warc.RecordReader()
        for r in rows:
            reader.feed_row(*r)
        return reader.found

    plain = [(r.record_id, r.chunk, bytes(r.data), r.sha1) for r in rows]
    assert len(read(plain)) == 1
    middle = plain[2]
    flipped = bytes([*middle[2][:40], middle[2][40] ^ 1, *middle[2][41:]])
    for bad in (
        [*plain[:2], (*middle[:2], flipped, middle[3]), *plain[3:]], plain[:2] + plain[3:], [plain[0], plain[2], plain[1], *plain[3:]],
        [*plain[:2], (*middle[:3], plain[1][3]), *plain[3:]],
    ):
        with pytest.raises(ValueError):
            read(bad)
