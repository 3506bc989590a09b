"""Ed25519 verification, from RFC 8032, for tokens over peer ids."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
BASE_Y = 4 * pow(5, P - 2, P) % P


def _x(y: int, sign: int) -> int | None:
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * pow(2, (P - 1) // 4, P) % P
    if (x * x - square) % P or (x == 0 and sign):
        return None
    return P - x if x & 1 != sign else x


def _point(data: bytes) -> tuple[int, int, int, int] | None:
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    if y >= P or (x := _x(y, sign)) is None:
        return None
    return x, y, 1, x * y % P


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p):
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    h = int.from_bytes(hashlib.sha512(signature[:32] + key + message).digest(), "little") % ORDER
    left, right = _times(s, (_x(BASE_Y, 0), BASE_Y, 1, _x(BASE_Y, 0) * BASE_Y % P)), _add(r, _times(h, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def token_ok(token: str | None, peer: bytes, keys: list[bytes]) -> bool:
    """Whether a base64 token is any key's signature of the raw peer id."""
    try:
        raw = base64.b64decode(token or "", validate=True)
    except ValueError:
        return False
    return any(verify(k, peer, raw) for k in keys)


def token_ok_column(token: Column, peer: Column, keys: list[bytes]) -> Column:
    return F.pandas_udf(lambda t, p: t.combine(p, lambda a, b: token_ok(a, bytes(b or b""), keys)), "boolean")(token, peer)
