"""Content identifiers, event blocks and signatures."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentloom.functions import codec, signature


@pytest.mark.parametrize("data,cid", [("alpha", "QmXxC4gWwta8M211tpZ4r3kQE7jRKEeKd2qzXRBrPd67zo"), ("beta", "QmenKX7Tzsr7mBJXRWdh8sFauKXiMxgFKwfzkKS5Tgghnz"), ("this-is-missing", "QmfQ56CDTgEgWpjD2UV96uhjsyHRPyjLZxDHsB1krqmP7u")])
def test_block_identifiers(data, cid):
    assert codec.block_cid(data.encode()) == cid
    assert codec.unbase58(cid) == codec.multihash(cid)


def test_event_identifiers():
    block = codec.encode_event(0, "U1")
    assert block.hex() == "a362747300647065657262553164747970656a706565725f6164646564"
    assert codec.event_cid(block) == "bafyreignspsct2ws4p2fm34rar7rdeto7gzg7xtbc6vksmzsuj3fbe6ld4"
    prev = None
    for peer, cid in (("peerA1", "bafyreibjvlfwi7zpjdijwpwjo5noatimkqj7wensgxyaexcr2zkm3er3au"), ("peerA2", "bafyreicanlagcmgmtgph7dfegzy6wlw6auh3gdxk3ogc4m6f3sozb2l27i"), ("peerA3", "bafyreianqpnhco4t2pilzqahznz4e6qpymh5nnqir7zjks5mw2ouoxbwqi")):
        prev = codec.event_cid(codec.encode_event(0, peer, prev))
        assert prev == cid
    assert codec.multihash(prev)[:2] == codec.SHA256_PREFIX


@settings(max_examples=80, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.text(max_size=40), st.one_of(st.none(), st.text(min_size=1, max_size=60)))
def test_events_round_trip(ts, peer, prev):
    assert codec.decode_event(codec.encode_event(ts, peer, prev)) == ("peer_added", ts, peer, prev)


def test_tolerant_decode():
    assert codec.decode_event(codec.cbor({"type": "x", "more": {"a": "b"}, "ts": "late"})) == ("x", 0, "", None)
    for bad in (None, b"", b"\xa1", codec.cbor("text"), codec.encode_event(1, "p")[:-1], b"\xff", b"\xa1\x61a\x5f"):
        assert codec.decode_event(bad) is None
    for bad in (None, "", "Qm", "Qm" + "0" * 44, "bafy", "b!!", "not-a-cid"):
        assert codec.multihash(bad) is None


def test_columns(spark):
    rows = spark.createDataFrame([(1, "p1", None), (2, "p2", "x")], "ts long, peer string, prev string")
    block = codec.event_block_column(F.col("ts"), F.col("peer"), F.col("prev"))
    found = rows.select("ts", codec.decode_event_column(block).alias("e"), codec.event_cid_column(block).alias("cid")).select("ts", "e.*", "cid").collect()
    assert [tuple(r)[1:5] for r in found] == [("peer_added", 1, "p1", None), ("peer_added", 2, "p2", "x")]
    bad = spark.createDataFrame([(None,), (b"\xff",)], "b binary").select(codec.decode_event_column(F.col("b")).alias("e")).select("e.*").collect()
    assert all(r.type is None and r.ts is None for r in bad)


def test_signatures():
    """The second test of RFC 8032, 7.1."""
    key = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    sig = bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")
    assert signature.verify(key, b"\x72", sig)
    assert not signature.verify(key, b"\x73", sig) and not signature.verify(key, b"\x72", sig[:-1] + b"\x01") and not signature.verify(key[:-1], b"\x72", sig)
    token = base64.b64encode(sig).decode()
    assert signature.token_ok(token, b"\x72", [bytes(32), key]) and not signature.token_ok(token, b"\x72", []) and not signature.token_ok("?", b"\x72", [key]) and not signature.token_ok(None, b"\x72", [key])


def test_signature_column(spark):
    key = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    token = base64.b64encode(bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")).decode()
    rows = spark.createDataFrame([(token, b"\x72"), (token, b"x"), ("", b"\x72")], "t string, p binary")
    assert [r[0] for r in rows.select(signature.token_ok_column(F.col("t"), F.col("p"), [key])).collect()] == [True, False, False]
