"""Secret scans with structural confirmation.

Pattern matches (assignments of long values, access key ids, hex runs) are
reported as they are. Further candidates - signed tokens, base64 and hex runs -
are decoded and reported only if what they hold parses: a token header that
names its algorithm, or a key encoding whose nested lengths add up (DER of
PKCS#1, PKCS#8, SEC 1 and SubjectPublicKeyInfo keys, or the OpenSSH format).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "token", "private_key", "public_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: How the base64 of a key begins: a DER sequence of a length, an SSH type or the OpenSSH magic.
HEAD = re.compile(r"M[A-P](?=[A-Za-z0-9+/_-]{2})|AAAA[A-D]|b3BlbnNzaC1rZXktdjEA")
#: A line of base64 to the dashes of PEM, and what stands between lines: a line end, also an escaped one, and indentation.
LINE = re.compile(r"(?:[A-Za-z0-9+/_]++|-(?!----))++")
LINE_END = re.compile(r"[\x20\t]*+(?:\r?\n|(?:\\++r)?\\++n)[\x20\t]*+")
#: In PEM on one line also blanks.
LINE_END_OR_BLANK = re.compile(rf"{LINE_END.pattern}|\x20+")
IN_BASE64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
#: How many strings an SSH public key has.
SSH_STRINGS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")

#: Object identifiers of key algorithms, as DER holds them: rsaEncryption, ecPublicKey, X25519 to Ed448, dsa.
KEY_OIDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b656e", "2b656f", "2b6570", "2b6571", "2a8648ce380401"))


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at a place, if its length is well formed and fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80 or n > 1 and size < 1 << 8 * (n - 1):
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """What a constructed value holds, if its parts fill it to the byte."""
    out = []
    while at < end:
        if (x := der(data, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


def key_kind(data: bytes) -> str | None:
    """private_key or public_key, if all of data is one encoded key."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for k in range(4):  # cipher, key derivation, its options, then the number of keys
            if k == 3 and at + 4 <= len(data):
                return "private_key" if ssh_strings(data, at + 4, 1 + int.from_bytes(data[at : at + 4], "big")) else None
            if at + 4 > len(data) or (at := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
                return None
        return None
    if re.match(rb"\0\0\0.(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-)", data, re.S):
        return "public_key" if ssh_strings(data, 0, None) else None
    top = der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or not (items := der_items(data, top[1], top[2])):
        return None
    tags = [x[0] for x in items]
    value = lambda k: data[items[k][1] : items[k][2]]
    algorithm = lambda k: bool(inner := der_items(data, items[k][1], items[k][2])) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]] in KEY_OIDS
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and value(0) in (b"\0", b"\1"):
        return "private_key"  # PKCS#1
    if tags[:3] == [0x02, 0x30, 0x04] and value(0) in (b"\0", b"\1") and algorithm(1):
        return "private_key"  # PKCS#8
    if tags[:2] == [0x02, 0x04] and value(0) == b"\1" and 16 <= len(value(1)) <= 66 and all(x in (0xA0, 0xA1) for x in tags[2:]):
        return "private_key"  # SEC 1
    if tags == [0x30, 0x03] and algorithm(0):
        return "public_key"
    if tags == [0x02, 0x02] and len(value(0)) >= 64 and 1 <= len(value(1)) <= 8:
        return "public_key"  # PKCS#1
    return None


def ssh_strings(data: bytes, at: int, count: int | None) -> bool:
    """Whether length-prefixed strings, count of them if given, fill data from a place to its end."""
    seen = 0
    while at < len(data):
        if at + 4 > len(data) or (at := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
            return False
        seen += 1
    return seen == count if count is not None else seen >= 2


def key_size(data: bytes) -> int | None:
    """How many bytes the key has that begins in data; if data is too short to tell, how many are needed to read on."""
    if data[:1] == b"0":
        n = data[1] & 0x7F if data[1] & 0x80 else 0
        return 2 + data[1] if data[1] < 0x80 else 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 else None
    if data[:6] == b"openss":
        at, left, keys = 15, 3, True
    elif data[:3] == b"\0\0\0":
        if len(data) < 4 + data[3]:
            return 4 + data[3]
        if (left := SSH_STRINGS.get(data[4 : 4 + data[3]])) is None:
            return None
        at, keys = 0, False
    else:
        return None
    while left:
        if at + 4 > len(data):
            return at + 4
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        left -= 1
        if keys and not left:
            if at + 4 > len(data):
                return at + 4
            left, at, keys = 1 + int.from_bytes(data[at : at + 4], "big"), at + 4, False
    return at


def key_at(text: str, start: int) -> tuple[str, int] | None:
    """Kind and end of the key whose base64 begins at a place, with its padding; its own lengths say where it ends.

    Lines are joined over line ends, escaped ones too, and any indentation. An
    SSH key of another type ends with its run.
    """
    between = LINE_END_OR_BLANK if text[max(0, start - 40) : start].rstrip(" ").endswith("-----") else LINE_END
    lines, chars, need, at = [], 0, 8, start
    while True:
        while chars < need and (m := LINE.match(text, at)):
            lines.append(m[0])
            chars += len(m[0])
            end, at = m.end(), (gap.end() if (gap := between.match(text, m.end())) else len(text))
        if chars < need and need < 1 << 62:
            return None
        if (data := unbase64(body[: len(body) - (len(body) % 4 == 1)] if (body := "".join(lines)) else "")) is None:
            return None
        size = key_size(data) if need < 1 << 62 else len(data)
        if size is None and data[:3] == b"\0\0\0" and re.match(rb"ssh-|ecdsa-", data[4:]):
            need = 1 << 62
        elif size is None:
            return None
        elif size > len(data):
            need = max(chars + 1, -(-size * 4 // 3))
        elif kind := key_kind(data[:size]):
            end -= chars - min(chars, -(-size * 4 // 3))
            return kind, end + len(re.match("={0,2}", text[end : end + 2])[0])
        else:
            return None


def unbase64(text: str) -> bytes | None:
    text = text.replace("\r", "").replace("\n", "").rstrip("=").translate({45: 43, 95: 47})
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token(text: str) -> bool:
    """Whether the first part of a dotted token is a JSON header with an algorithm, and the second decodes too."""
    header, payload, _ = text.split(".")
    try:
        head = json.loads((unbase64(header) or b"").decode())
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and unbase64(payload) is not None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("token", m.start(), m.end()) for m in TOKEN.finditer(text) if is_token(m[0])]
    free = 0
    for m in HEAD.finditer(text):
        a = m.start()
        if a >= free and (not a or text[a - 1] not in IN_BASE64 or text[a - 5 : a] == "-----" or text[a - 2 : a] in ("\\n", "\\r", "\\t")) and (found := key_at(text, a)):
            free = found[1]
            out.append((found[0], a, free))
    if max(map(len, text.split()), default=0) >= 40:
        for m in HEX_KEY.finditer(text):
            if kind := key_kind(bytes.fromhex(m[0])):
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and confirmed spans, in code points; none in a null text."""
    return (base_spans(text), confirmed_spans(text)) if text else ([], [])


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            base, more = find_secrets(text.as_py())
            n = [sum(k == x for x, _, _ in base) for k in KINDS[:3]]
            every = sorted(base + more, key=lambda s: (s[1], s[2]))
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), [{"kind": k, "start": a, "end": b} for k, a, b in every]))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [_FOUND]
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): counts, the digest of the base spans, all spans, and spans as structs.

    A null or empty text has no spans (and the digest of the empty string). Texts
    of any length are read whole, in time that grows with their length. Rows with
    equal ids each give a row, an empty table none. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {RESULT}")


def redact(text: str) -> str:
    """The text with each secret replaced by [SECRET]; overlapping spans are replaced as one."""
    base, more = find_secrets(text)
    out, at = [], 0
    for _, a, b in sorted(base + more, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    """redact() of a column; null stays null."""
    return F.pandas_udf(lambda texts: texts.map(redact, na_action="ignore"), "string")(text)
