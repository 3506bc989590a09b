"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


EVENT = _struct(("cid", _S), ("type", _S), ("ts", _L), ("peer", _S), ("prev", _S))
PEER = _struct(("peer_id", _S), ("addrs", T.ArrayType(_S)), ("services", _L), ("last_seen_unix", _L), ("last_tried_unix", _L), ("last_succ_unix", _L), ("failure_count", _L), ("source", _S), ("score", T.DoubleType()), ("expire_at_unix", _L))
#: Unsigned 64-bit numbers of messages need a decimal; unsigned_bits() turns them into the bit pattern of a long.
VERSION = _struct(("nonce", T.DecimalType(20, 0)), ("services", T.DecimalType(20, 0)), ("agent", _S), ("start_height", _L), ("timestamp", _L), ("state_head", _S), ("state_height", _L), ("auth_scheme", _S), ("auth_proof", _S), ("want_peerlist", _B), ("listen_addrs", T.ArrayType(_S)), ("peers", T.ArrayType(_S)))
RESTORE = _struct(("ok", _L), ("failed", _L), ("bytes", _L))
METRICS = ("dials_attempted", "dials_succeeded", "dials_failed", "peers_pruned", "gossip_learned", "restores_started", "restores_ok", "restores_failed", "restore_bytes")
