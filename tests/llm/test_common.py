import numpy as np
import pyarrow as pa

from fillsight.llm import common


def test_text_buffer_of_slices_nulls_and_nothing():
    column = pa.array(["drop", "ä", None, "", "xyz", "drop"]).slice(1, 4)
    flat, offsets = common.text_buffer(column)
    assert flat.tobytes() == "äxyz".encode() and offsets.tolist() == [0, 2, 2, 2, 5]
    flat, offsets = common.text_buffer(pa.array([], pa.string()))
    assert len(flat) == 0 and offsets.tolist() == [0]
    flat, offsets = common.text_buffer(pa.array([None, None], pa.string()))
    assert len(flat) == 0 and offsets.tolist() == [0, 0, 0]


def test_row_chunks_cover_all_rows_once():
    offsets = np.array([0, 0, 5, 5, 105, 110, 110])
    for limit in (1, 7, 100, 1_000):
        chunks = list(common.row_chunks(offsets, limit))
        assert [a for a, _ in chunks] == [0, *[b for _, b in chunks[:-1]]] and chunks[-1][1] == 6
        assert all(offsets[b] - offsets[a] <= limit or b - a == 1 for a, b in chunks)
    assert list(common.row_chunks(np.zeros(1, np.int64))) == []


def test_word_spans_stop_at_row_ends():
    flat, offsets = common.text_buffer(pa.array(["ab c", "", "d", " ef"]))
    starts, ends, before = common.word_spans(flat != 32, offsets)
    assert [flat[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["ab", "c", "d", "ef"]
    assert before.tolist() == [0, 2, 2, 3, 4]


def test_equal_spans_have_equal_hashes():
    flat, _ = common.text_buffer(pa.array(["the cat the cap"]))
    h = common.span_hash(flat, np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15]))
    assert h[0] == h[2] and len(set(h.tolist())) == 3
