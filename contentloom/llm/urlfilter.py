"""URL filters on a sorted digest array.

Rules and blocked hosts are stored as one array of 64-bit xxhash keys, sorted,
with the full strings beside it. The driver writes the array to a file and
hands it to the executors with addFile(); workers memory-map it, probe all
candidates of a batch by one vectorised binary search, and compare the stored
strings, so that two strings with one digest are told apart. Hosts may come from
a table; its size is checked before it is handed out.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hosts blocked, with their subdomains, where no rule fits.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

#: Rules and hosts handed out may have so many bytes, of which executors map a file; the driver holds them once.
MOST_BYTES = 512 << 20

ENTRY = np.dtype([("key", "<u8"), ("at", "<u8"), ("size", "<u4"), ("verdict", "u1")])


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for a null and without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    rest = rest[: min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.encode().lower().decode(), path


def write_array(entries: Iterable[tuple[str, str]], folder: str) -> str:
    """(verdict, string) pairs as a file: count, sorted entries, strings. The name tells the content."""
    rows = sorted({(xxhash.xxh64_intdigest(text.encode()), text.encode(), verdict == "block") for verdict, text in entries})
    table = np.zeros(len(rows), ENTRY)
    table["key"] = np.fromiter((key for key, _, _ in rows), np.uint64, len(rows))
    table["size"] = [len(text) for _, text, _ in rows]
    table["at"] = np.cumsum(table["size"], dtype=np.uint64) - table["size"]
    table["verdict"] = [block for *_, block in rows]
    data = np.uint64(len(rows)).tobytes() + table.tobytes() + b"".join(text for _, text, _ in rows)
    path = os.path.join(folder, f"urls-{hashlib.sha256(data).hexdigest()[:16]}.bin")
    with open(path, "wb") as f:
        f.write(data)
    return path


class DigestArray:
    def __init__(self, path: str):
        self.bytes = np.memmap(path, np.uint8, "r")
        n = int(self.bytes[:8].view("<u8")[0])
        self.table = self.bytes[8 : 8 + n * ENTRY.itemsize].view(ENTRY)
        self.keys = self.table["key"]
        self.strings = self.bytes[8 + n * ENTRY.itemsize :]

    def probe(self, texts: list[bytes]) -> np.ndarray:
        """For each string the index of its entry, or -1."""
        keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(texts), -1)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else []
        for k in hit:
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == keys[k]:
                row = self.table[i]
                if self.strings[row["at"] : row["at"] + row["size"]].tobytes() == texts[k]:
                    found[k] = i
                    break
                i += 1
        return found


def suffixes(host: str, longest: int) -> list[str]:
    """The host and the domains above it, of at most so many characters."""
    tail = host[-longest - 1 :]
    parts = tail.split(".")
    out = [tail] if host and len(host) <= longest else []
    return out + [".".join(parts[k:]) for k in range(1, len(parts))]


def listed_hosts(blocked: DataFrame | Iterable[str]) -> list[str]:
    """Distinct hosts, A-Z lower-cased, of a table (host) or of strings; nulls and empty ones say nothing."""
    if isinstance(blocked, DataFrame):
        hosts = blocked.select(F.col("host").cast("string").alias("host")).where("host IS NOT NULL").distinct()
        if (size := hosts.agg(F.sum(F.octet_length("host") + ENTRY.itemsize)).first()[0] or 0) > MOST_BYTES:
            raise ValueError(f"the hosts are {size} bytes, more than {MOST_BYTES}: filter by parts of them")
        blocked = hosts.toArrow()["host"].to_pylist()
    return sorted({h.encode().lower().decode() for h in blocked if h})


def filter_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED_HOSTS, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict for every row of pages (key, url); blocked holds hosts, or is a table (host).

    The longest rule that fits decides; without one the url is blocked if its
    host or a domain above it is in blocked, else allowed. A null url and one
    without :// have an empty host and path, fit no rule and are allowed.
    Urls of any length are read whole. Repeated rows each give a row, an empty
    table none; other columns are not read.
    """
    spark = pages.sparkSession
    blocked = listed_hosts(blocked)
    # a rule's stored string is host + path, a blocked host's ends in a blank, which no rule has before its path
    entries = [(verdict, host + path) for verdict, host, path in rules] + [("block", f"{host} ") for host in blocked]
    folder = os.path.join(SparkFiles.getRootDirectory(), "arrays")  # the driver's own, which Spark removes; executors fetch the file from the driver
    os.makedirs(folder, exist_ok=True)
    path = write_array(entries, folder)
    longest = max((len(h) for h in [*blocked, *(h for _, h, _ in rules)]), default=0)
    name, lengths = os.path.basename(path), sorted({len(p) for _, _, p in rules})
    if not os.path.exists(SparkFiles.get(name)):  # the same content may have been handed out already
        spark.sparkContext.addFile(path)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            texts: list[bytes] = []
            owner: list[int] = []
            for i, (host, path) in enumerate(split):
                for domain in suffixes(host, longest):
                    some = [domain + path[:n] for n in lengths if n <= len(path)] + [f"{domain} "]
                    texts += [x.encode() for x in some]
                    owner += [i] * len(some)
            best: list[bytes | None] = [None] * len(split)
            verdict = ["allow"] * len(split)
            found = array.probe(texts)
            for k in np.flatnonzero(found >= 0):
                i, text = owner[k], texts[k]
                listed = text.endswith(b" ") and b"/" not in text
                if listed and best[i] is None:
                    verdict[i] = "block"
                elif not listed and (best[i] is None or len(text) > len(best[i])):
                    best[i], verdict[i] = text, "block" if array.table["verdict"][found[k]] else "allow"
            rule = [b and b.decode() for b in best]
            columns = [batch.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "host", "path", "rule", "verdict"])

    return pages.select(key, "url").mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")


_LISTED = " OR ".join(f"s.host = '{h}' OR ends_with(s.host, '.{h}')" for h in BLOCKED_HOSTS)
ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '/(.|\\n|\\r)*$', 0) AS path FROM cut),
rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES)}),
fits AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN {_LISTED} THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id
"""
