"""Landed JSON documents whose fields are missing, broken or of another type."""

import json

from fillsight.sources import documents as SD
from tests.conftest import rows


def docs(spark, bodies):
    return spark.createDataFrame([(k, b if isinstance(b, str) or b is None else json.dumps(b)) for k, b in bodies.items()], "key string, body string")


def test_market_documents_survive_changed_types(spark, tmp_path):
    bodies = {
        "a": {"slug": "a", "outcomes": '["Yes", "No"]', "clobTokenIds": ["1" * 77, "2"], "startDate": "2024-01-05", "closed": "true",
              "closedTime": "2024-02-01 00:00:00+00", "outcomePrices": ["0.25", 0.75], "volume": {"usd": "12.5"}},
        "b": {"slug": "b", "outcomes": "Solo", "clobTokenIds": '["9"]', "acceptingOrdersTimestamp": "2024-01-05T00:00:00Z", "startDate": None,
              "closed": False, "outcomePrices": None, "volume": 7},
        "c": {"slug": 3, "outcomes": ["Yes", "No"], "clobTokenIds": ["x", "y"], "startDate": "2024-01-05T01:00:00+0100", "closed": 0, "volume": {"usd": []}},
        "no slug": {"outcomes": []}, "text": "no json {", "null": "null", "list": "[1]",
    }
    for k, b in bodies.items():
        (tmp_path / f"market_{k}.json").write_text(b if isinstance(b, str) else json.dumps(b, indent=1))
    landed = SD.read_documents(spark, f"{tmp_path}/market_*.json", r"market_([^/]+)\.json$")
    m = SD.market_documents(landed, 99)
    got = {r.slug: r for r in m.collect()}
    start = 1_704_412_800
    assert {k: (r.start_ts, r.end_ts, r.closed, r.outcome_prices) for k, r in got.items()} == {
        "a": (start, 1_706_745_600, True, [0.25, 0.75]), "b": (start, 99, False, []), "3": (start, 99, False, [])}
    assert got["a"].token_ids == ["1" * 77, "2"] and got["b"].outcomes == ["Solo"] and got["b"].no_token_id is None
    assert rows(SD.facet(m, "volume.usd", "double", "usd")) == [("3", None), ("a", 12.5), ("b", None)]
    assert {r.key.replace("%20", " ") for r in SD.broken_documents(landed, "slug").collect()} == {"no slug", "text", "null", "list"}


def test_wallet_documents(spark):
    d = SD.deposit_documents(docs(spark, {
        "0xA": {"from": "0xF", "timestamp": "17", "tx_hash": "h"}, "0xB": {}, "0xC": {"from": 5, "timestamp": "soon"}, "0xD": None, "0xE": "oops"}))
    assert rows(d.drop("raw")) == sorted([
        (17, "0xf", "h", "0xa"), (None, None, None, "0xb"), (None, "5", None, "0xc"), (None, None, None, "0xd"), (None, None, None, "0xe")], key=repr)
    t = SD.transfer_documents(docs(spark, {
        "F1": {"transfers": [{"to": "0xA", "ts": 3}, {"to": "0xB", "ts": "4"}, {"ts": 5}], "hit_cap": "true"}, "F2": {"transfers": []}, "F3": {},
        "F4": {"transfers": "none"}}))
    assert rows(t) == sorted([
        ("f1", True, "0xa", 3), ("f1", True, "0xb", 4), ("f1", True, None, 5), ("f2", False, None, None), ("f3", False, None, None),
        ("f4", False, None, None)], key=repr)
