"""Column expressions: scores, versions, addresses and bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_VERSION = (0, 1, 0)


def whole(x: Column) -> Column:
    """A quotient without its fraction, towards zero."""
    return x.cast("long")


def peer_score(now: Column, want: int = 0, services="services", succ="last_succ_unix", seen="last_seen_unix", fails="failure_count") -> Column:
    """100 for a wanted service; up to 50 and 20 for how recent success and sight are (0 means never; a future time has no ceiling); -5 a failure."""
    wanted = F.when(F.col(services).bitwiseAND(F.lit(want)) != 0, 100).otherwise(0) if want else F.lit(0)
    success = F.when(F.col(succ) > 0, F.greatest(F.lit(0), 50 - whole((now - F.col(succ)) / 60))).otherwise(0)
    sight = F.when(F.col(seen) > 0, F.greatest(F.lit(0), 20 - whole((now - F.col(seen)) / 600))).otherwise(0)
    return (wanted + success + sight - 5 * F.col(fails)).cast("double")


def backoff(fails: Column, most: int = 300) -> Column:
    """Seconds to wait: one more for each failure."""
    return F.least(1 + fails, F.lit(most))


def stale(now: Column, stale_s: int, max_fail: int, fails="failure_count", seen="last_seen_unix", expire="expire_at_unix") -> Column:
    return (F.col(fails) >= max_fail) | ((F.col(seen) != 0) & (F.col(seen) < now - stale_s)) | expired(now, expire)


def expired(now: Column, expire="expire_at_unix") -> Column:
    return (F.col(expire) != 0) & (F.col(expire) <= now)


def version_numbers(agent: Column) -> Column:
    """Three numbers of the part behind the last slash (of all of it, if the slash ends it); what isn't a number counts 0."""
    tail = F.when(agent.endswith("/"), agent).otherwise(F.substring_index(agent, "/", -1))
    parts = F.split(tail, r"\.", 3)
    number = lambda k: F.coalesce(F.when(F.get(parts, F.lit(k)).rlike(r"^[+-]?[0-9]+$"), F.get(parts, F.lit(k)).try_cast("long")), F.lit(0).cast("long"))
    return F.array(*[number(k) for k in range(3)])


def version_ok(agent: Column, least: tuple[int, int, int] = MIN_VERSION) -> Column:
    return F.coalesce(version_numbers(agent) >= F.array(*[F.lit(n).cast("long") for n in least]), F.lit(False))


def services_ok(services: Column, allow: int) -> Column:
    """No service beyond those allowed; 0 allows all. Masks are bit patterns of longs."""
    return F.lit(True) if not allow else services.bitwiseAND(F.lit(~allow)) == 0


def unsigned_bits(x: Column) -> Column:
    """An unsigned 64-bit number (decimal) as the long of the same bits."""
    return F.when(x >= F.lit("9223372036854775808").cast("decimal(20,0)"), x - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x).cast("long")


def ip4(addr: Column) -> Column:
    return F.regexp_extract(addr, r"/ip4/([^/]+)", 1)


def rewrite_ip4(addr: Column, ip: str) -> Column:
    """The first /ip4/ component renamed; an address without one stays."""
    return F.concat(F.regexp_extract(addr, r"^(.*?)(/ip4/[^/]*|$)", 1), F.when(addr.contains("/ip4/"), F.lit(f"/ip4/{ip}")).otherwise(""), F.regexp_extract(addr, r"^.*?/ip4/[^/]*(.*)$", 1))


def is_public_ip4(ip: Column) -> Column:
    """Four numbers up to 255 that are not loopback, private, link-local or unspecified."""
    parts = F.split(ip, r"\.")
    a, b = (F.get(parts, F.lit(k)).try_cast("int") for k in (0, 1))
    whole_ip = ip.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")
    closed = (a == 127) | (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (a == 0)
    return F.coalesce(whole_ip & ~closed, F.lit(False))


def escape_key(key: Column) -> Column:
    return F.replace(key, F.lit("/"), F.lit("_"))


def unescape_key(key: Column) -> Column:
    """Not the inverse where the key had an underscore."""
    return F.replace(key, F.lit("_"), F.lit("/"))


def parse_height(text: Column) -> Column:
    """The whole number that a text begins with, after blanks; 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


def peer_address(addr: Column, peer: Column) -> Column:
    return F.concat(addr, F.lit("/p2p/"), peer)


def split_peer_address(text: Column) -> tuple[Column, Column]:
    """Address and peer of addr/p2p/peer; both empty if it isn't one."""
    form = r"^(/.+)/p2p/([^/]+)$"
    return F.regexp_extract(text, form, 1), F.regexp_extract(text, form, 2)


def limit_or(value: str | int | None, default: int, most: int) -> int:
    """A requested page size, or the default if it is no number from 1 to most."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return default
    return n if 1 <= n <= most else default
