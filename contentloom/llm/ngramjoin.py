"""N-gram Jaccard join of documents: exact links, by a prefix-tree join.

A document's set holds the hashes of its distinct 5-word shingles. Documents
with equal sets form a class, of which one stands for all. Two classes link
when 100 * intersection >= 75 * union, so a set of n has at most n // 4 members
outside of any set it links with. From this follow, losing no link:

1. Of each set the 40 % with the smallest hashes are dealt out by hash. A set of
   whose members there more than n // 4 occur in no other set is out.
2. What remains is joined first with one centre for each of a few min-hashes
   (the member with the fewest unshared shingles), and links are verified. This
   ties large groups of near copies together without all their pairs.
3. All sets are ordered globally (rare shingles first, by a sketch of counts of
   fixed size, then by hash). Two sets that link share a member among the first
   n // 4 + 1 of each. Each member of such a prefix brings the next ones with
   it, up to DEPTH, and these paths are stored in tries by their first member. A
   search starts at the nodes of a member, counts the overlap on its way down,
   and leaves a subtree as soon as the overlap so far and what remains of either
   set cannot reach what linked sets need, or if all of it is in the searcher's
   group already. Two sets whose members before the first one are equal have
   met there. Bitmaps of the whole sets leave out what
   they can prove to be too far apart. Until the last round, in which all
   candidates are verified, a set's nearest one is, as most groups that link are
   tied by it and need no further comparison.

Shingles are compared as 64-bit hashes; equal sets by 128 bits and their size.
Classes that may link are numbered, and known by their number from then on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, give_back, release, small, trimmed
from .components import components
from .textkernel import U64, mix, shingle_sets

SHINGLE = 5
CENTRES = 3
#: Tokens of one hash range at the first dealing; entries of one group of tries, and how many groups there are at least.
RANGE_TOKENS = 1 << 19
GROUP_ENTRIES = 1 << 16
LEAST_GROUPS = 64
#: Tokens that a task settles at once.
HELD_TOKENS = 1 << 18
#: A token with more entries is dealt in pairs of blocks of about this size.
BLOCK = 1 << 11
#: Members of a path of a trie; deeper ones would only prune more.
DEPTH = 8
SKETCH = 1 << 20
#: Up to so many rows (24 bytes each) the ids of remaining documents are broadcast.
BROADCAST_ROWS = 500_000

SALT = U64(0x5851F42D4C957F2D)


def linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= 75 * (n + m - common)


def need(n, m):
    """The least intersection of linked sets of n and m members: ceil(3 (n + m) / 7)."""
    return (3 * (n + m) + 6) // 7


def dealt(n: int) -> int:
    return min(n, n // 4 + max(1, (3 * n + 19) // 20))


def signature(members: np.ndarray) -> tuple[int, int]:
    one, two = mix(members).sum(dtype=U64), mix(members ^ SALT).sum(dtype=U64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        s = np.zeros((batch.num_rows, 2), np.int64)
        for k, members in shingle_sets(batch.column(1), SHINGLE):
            n[k], s[k] = len(members), signature(members)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())], names=["doc_id", "n", "s1", "s2"])


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _ranges(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mix(tokens) >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)


def _shared(tokens: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, tag) pairs, sorted, and whether another tag (or the mark 0) has the token as well."""
    order = np.lexsort((tags, tokens))
    tokens, tags = tokens[order], tags[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (tags[1:] != tags[:-1])
    tokens, tags = tokens[new], tags[new]
    _, at, count = np.unique(tokens, return_index=True, return_counts=True)
    marked = tags[at] == 0
    for_each = np.repeat((count > 1) | marked, count)
    return tokens, tags, for_each


def _packed(keys: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """(key, the columns' values of that key as bytes) for each key."""
    order = np.argsort(keys, kind="stable")
    cuts = [*np.flatnonzero(np.diff(keys[order], prepend=-1)), len(order)]
    return [(int(keys[order[a]]), *(_blob(x[order[a:b]]) for x in columns)) for a, b in pairwise(cuts)]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(3)], names=names)


def _dealing(bits: int) -> Callable:
    """Rows (r, tokens, tags) by hash range; what is shared inside of a batch is settled here (tag 0), so a common token is one entry a batch.

    What is settled goes to the ranges from 1 << bits on, which are of sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts, tags):
            tokens, tags, shared = _shared(np.concatenate(parts), np.repeat(np.array(tags, np.int64), [len(p) for p in parts]))
            marks = np.unique(tokens[shared])
            credited, credit = np.unique(tags[shared], return_counts=True)
            tokens, tags = np.concatenate([tokens[~shared], marks]), np.concatenate([tags[~shared], np.zeros(len(marks), np.int64)])
            rows = _packed(_ranges(tokens, bits), tokens, tags)
            return _batch(rows + _packed((1 << bits) + _ranges(credited.view(U64), bits), credit.astype(U64), credited), ["r", "tokens", "tags"])

        parts, tags, held = [], [], 0
        for batch in batches:
            for _, members in shingle_sets(batch.column(1), SHINGLE):
                if n := len(members):
                    parts.append(members[: dealt(n)])
                    tags.append(signature(members)[0])
                    held += len(parts[-1])
                    if held >= HELD_TOKENS:
                        yield out(parts, tags)
                        parts, tags, held = [], [], 0
        if parts:
            yield out(parts, tags)

    return run


def _credits(bits: int) -> Callable:
    """Of one range: how many members of each set another set has as well, packed by ranges of sets."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = np.concatenate([np.frombuffer(x, U64) for x in table["tokens"].to_pylist()])
        tags = np.concatenate([np.frombuffer(x, np.int64) for x in table["tags"].to_pylist()])
        if key[0].as_py() >= 1 << bits:
            credited, at = np.unique(tags, return_inverse=True)
            credit = np.bincount(at, first.astype(np.float64)).astype(np.int64)
        else:
            _, tags, shared = _shared(first, tags)
            credited, credit = np.unique(tags[shared & (tags != 0)], return_counts=True)
        rows = _packed(_ranges(credited.view(U64), bits), credited, credit.astype(np.int32))
        del first, tags
        give_back()
        return pa.Table.from_batches([_batch(rows, ["b", "sets", "credit"])])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Of one range of sets: the credit of each."""
    sets = np.concatenate([np.frombuffer(x, np.int64) for x in table["sets"].to_pylist()])
    credit = np.concatenate([np.frombuffer(x, np.int32) for x in table["credit"].to_pylist()])
    sets, at = np.unique(sets, return_inverse=True)
    return pa.table({"s1": sets, "credit": np.bincount(at, credit).astype(np.int64)})


SETS = "cid long, n long, ratio double, members binary, mins array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, text, s1, s2, ratio -> the sets of those rows that have the signature."""
    salts = [mix(np.array([k + 1], U64))[0] for k in range(CENTRES)]
    for batch in batches:
        rows = []
        cid, s1, s2, ratio = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
        for k, members in shingle_sets(batch.column(1), SHINGLE):
            if len(members) and signature(members) == (s1[k], s2[k]):
                mins = [int((mix(members ^ salt).min()).astype(np.int64)) for salt in salts]
                rows.append((cid[k], len(members), ratio[k], _blob(members), mins))
                if len(rows) >= 500:
                    yield _rows(rows)
                    rows = []
        if rows:
            yield _rows(rows)


def _rows(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["cid", "n", "ratio", "members", "mins"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, their members -> the pairs that link."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        good = []
        for k in range(batch.num_rows):
            x, y = np.frombuffer(left[k].as_buffer(), U64), np.frombuffer(right[k].as_buffer(), U64)
            if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                good.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], names=["a", "b"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets."""
    one = sets.select(F.col("cid").alias("a"), F.col("members").alias("left"))
    two = sets.select(F.col("cid").alias("b"), F.col("members").alias("right"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "left", "right").mapInArrow(trimmed(_verify), "a long, b long").distinct()


def _sketch_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of token hashes, in 16 slices, without zeros."""
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for x in batch.column(0):
            np.add.at(counts, (np.frombuffer(x.as_buffer(), U64) % U64(SKETCH)).astype(np.int64), 1)
    step = SKETCH // 16
    for k in range(16):
        at = np.flatnonzero(counts[k * step : (k + 1) * step])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_blob(at.astype(np.int32))], pa.binary()), pa.array([_blob(counts[k * step + at])], pa.binary())], names=["k", "at", "counts"])


def _sketch_sum(table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH // 16, np.int64)
    for at, counts in zip(table["at"].to_pylist(), table["counts"].to_pylist(), strict=True):
        total[np.frombuffer(at, np.int32)] += np.frombuffer(counts, np.int64)
    return pa.table({"k": pa.array([table["k"][0].as_py()], pa.int64()), "total": pa.array([_blob(np.minimum(total, 2**31 - 1).astype(np.int32))], pa.binary())})


def sketch(sets: DataFrame) -> np.ndarray:
    """SKETCH counters of hashed shingles: 4 MB, however large the corpus."""
    parts = sets.select("members").mapInArrow(trimmed(_sketch_part), "k long, at binary, counts binary")
    out = np.zeros(SKETCH, np.int32)
    for row in parts.groupBy("k").applyInArrow(_sketch_sum, "k long, total binary").collect():  # 16 rows at most
        out[row["k"] * (SKETCH // 16) : (row["k"] + 1) * (SKETCH // 16)] = np.frombuffer(row["total"], np.int32)
    return out


ENTRIES = "token long, before long, after binary, pos int, cid long"


def _prefixes(counts) -> Callable:
    """cid, members -> an entry for each of the first n // 4 + 1 members in the global order that may be shared.

    token has the quarter power of two of the member's count in its high bits
    and its hash below, so tokens are ordered as the members are. before is the
    token before it (-1 for none), after the next ones of the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            parts, after = [], []
            for k, x in enumerate(batch.column(1)):
                members = np.frombuffer(x.as_buffer(), U64)
                count = table[(members % U64(SKETCH)).astype(np.int64)]
                rank = np.floor(4 * np.log2(np.maximum(count, 1))).astype(np.int64)
                tokens = np.where(count > 1, (rank + 1) << 56, 0) | (members >> U64(8)).astype(np.int64)
                tokens = np.sort(tokens)[: len(members) // 4 + 1]
                at = np.flatnonzero(tokens >= 1 << 56)
                if len(at):
                    tokens = tokens[at]
                    blob = _blob(tokens)
                    after += [blob[8 * j : 8 * (j + DEPTH - 1)] for j in range(1, len(at) + 1)]
                    parts.append((tokens, np.concatenate([[-1], tokens[:-1]]), at.astype(np.int32), np.full(len(at), k)))
            if parts:
                token, before, pos, owner = (np.concatenate([p[j] for p in parts]) for j in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(before), pa.array(after, pa.binary()), pa.array(pos), batch.column(0).take(pa.array(owner))], names=["token", "before", "after", "pos", "cid"])

    return run


def bitmap(members: np.ndarray) -> np.ndarray:
    """Parities of the members by the low bits of their hashes, at least four bits for each member."""
    bits = 1 << min(16, max(8, (4 * len(members) - 1).bit_length()))
    at, n = np.unique(mix(members) & U64(bits - 1), return_counts=True)
    odd = at[n % 2 == 1].astype(np.int64)
    out = np.zeros(bits, np.uint8)
    out[odd] = 1
    return np.packbits(out, bitorder="little").view(U64)


def folded(bitmaps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows) as they would be with fewer bits."""
    while bitmaps.shape[1] > width:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [_blob(bitmap(np.frombuffer(x.as_buffer(), U64))) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["cid", "n", "bitmap"])


class Node:
    __slots__ = ("children", "component", "ends", "hi", "lo", "rest")

    def __init__(self, component):
        self.children, self.ends, self.component = None, [], component
        self.lo, self.hi, self.rest = 1 << 62, 0, 0


class Trie:
    """Paths with the same first token, in the global order, by the token before; each node knows, of the sets below, sizes, the most that can follow it, and the component if there is only one."""

    def __init__(self):
        self.tops: dict[int, Node] = {}

    def add(self, item: int, before: int, path: list[int], place: int, n: int, component: int) -> None:
        """place is that of the path's first token in the set of n."""
        level, key = self.tops, before
        for depth in range(len(path)):
            if depth:
                if node.children is None:  # noqa: F821
                    node.children = {}
                level, key = node.children, path[depth]
            if (node := level.get(key)) is None:
                node = level[key] = Node(component)
            node.lo, node.hi, node.rest = min(node.lo, n), max(node.hi, n), max(node.rest, n - place - depth - 1)
            if node.component != component:
                node.component = None
        node.ends.append(item)

    def search(self, before: int, path: list[int], place: int, n: int, component: int) -> Iterator[int]:
        """Sets of other components, unless the tokens that follow prove that they cannot link.

        That holds for sets that share no earlier token; others have met there,
        as those surely have whose tokens before are equal.
        """
        least, most = -(-3 * n // 4), 4 * n // 3
        stack = [(path[0], top, 0, 0) for key, top in self.tops.items() if key != before or key < 0]
        while stack:
            token, node, k, overlap = stack.pop()
            if node.component == component or node.hi < least or node.lo > most:
                continue
            while k < len(path) and path[k] < token:
                k += 1
            if k < len(path):  # else the token may be among those that the path does not tell
                if path[k] == token:
                    k, overlap = k + 1, overlap + 1
                if overlap + min(n - place - k, node.rest) < need(n, max(node.lo, least)):
                    continue
            yield from node.ends
            if node.children:
                stack.extend((t, child, k, overlap) for t, child in node.children.items())


class Bitmaps:
    """Bounds for many sets at once: each member that only one of two sets has changes one bit, so they differ in at least as many members as bits."""

    def __init__(self, maps: list[bytes]):
        self.rows: dict[int, tuple[list[int], np.ndarray]] = {}
        self.own = [np.frombuffer(m, U64) for m in maps]
        self.place = np.zeros(len(maps), np.int64)
        self.width = np.array([len(m) for m in self.own], np.int64)
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.stack([self.own[k] for k in at])

    def differ(self, i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), np.int64)
        for w in np.unique(self.width[others]).tolist():
            at = np.flatnonzero(self.width[others] == w)
            least = min(w, int(self.width[i]))
            there = folded(self.rows[w][self.place[others[at]]], least)
            out[at] = np.bitwise_count(there ^ folded(self.own[i][None, :], least)).sum(1)
        return out


def _tries(nearest: bool) -> Callable:
    """Entries (ENTRIES, component, side) and sets (cid, n, bitmap) of one group -> candidate pairs (a, b, apart).

    side 0: all with all; otherwise blocks 1 and 2 of a common token, each with
    the other. nearest leaves only the nearest candidate of a set. One token's
    trie is held at a time.
    """

    def run(entries: pa.Table, sets: pa.Table) -> pa.Table:
        ids, at = np.unique(sets["cid"].to_numpy(), return_index=True)
        n, maps = sets["n"].to_numpy()[at], Bitmaps(sets["bitmap"].take(pa.array(at)).to_pylist())
        entries = entries.sort_by("token")
        token, before, pos, component, side = (entries[c].to_numpy() for c in ("token", "before", "pos", "component", "side"))
        item, after = np.searchsorted(ids, entries["cid"].to_numpy()), entries["after"]
        components_ = np.zeros(len(ids), np.int64)
        components_[item] = component
        least: dict[int, tuple[int, int]] = {}
        every = [np.zeros((3, 0), np.int64)]
        for x, y in pairwise([*np.flatnonzero(np.diff(token, prepend=-1)), len(token)]):
            rows = [
                (i, (b, [t, *np.frombuffer(more, np.int64).tolist()], p, size, c), s)
                for i, b, t, more, p, size, c, s in zip(*(z[x:y].tolist() for z in (item, before, token)), after[x:y].to_pylist(), *(z.tolist() for z in (pos[x:y], n[item[x:y]], component[x:y], side[x:y])), strict=True)
            ]
            trie = Trie()
            for i, path, s in rows:
                if s < 2:
                    trie.add(i, *path)
            for i, path, s in rows:
                if s == 1 or not (met := list(trie.search(*path))):
                    continue
                met, size = np.array(met), n[i]
                met = met[components_[met] != components_[i]]
                if s == 0 and not nearest:
                    met = met[met > i]
                met = met[4 * np.minimum(n[met], size) >= 3 * np.maximum(n[met], size)]
                if not len(met):
                    continue
                apart = maps.differ(i, met)
                good = apart <= n[met] + size - 2 * need(n[met], size)
                met, apart = met[good], apart[good]
                if not nearest:
                    every.append(np.stack([np.full(len(met), i), met, apart]))
                elif len(met):
                    least[i] = min(least.get(i, (1 << 62, 0)), min(zip(apart.tolist(), met.tolist(), strict=True)))
        if nearest:
            every.append(np.array([(i, j, far) for i, (far, j) in least.items()], np.int64).reshape(-1, 3).T)
        found = np.unique(np.concatenate(every, axis=1), axis=1)
        give_back()
        return pa.table({"a": ids[found[0]], "b": ids[found[1]], "apart": found[2]})

    return run


def candidates(entries: DataFrame, bitmaps: DataFrame, labels: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) of sets of different components (labels: node, component) that share a member of their prefixes and may link.

    With nearest only the nearest of each set, by bitmap. The sets of a common
    token are dealt in blocks; those of its largest component need not meet each
    other, so their blocks meet only those of the others.
    """
    known = entries.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    tokens = known.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("before").alias("first"), F.max("before").alias("last"), F.count("*").alias("entries"))
    tokens = tokens.where("least <> most AND (first <> last OR first < 0)")  # where all have the same token before, all have met there
    tokens = checkpoint(tokens.select(F.col("token").alias("t"), "entries"))
    total = tokens.agg(F.sum("entries")).first()[0] or 0
    groups = max(LEAST_GROUPS, total // GROUP_ENTRIES)
    columns = ["token", "before", "after", "pos", "cid", "component"]
    rare = known.join(tokens.where(F.col("entries") <= BLOCK), F.col("token") == F.col("t"))
    dealt = rare.select(*columns, F.pmod(F.xxhash64("token"), F.lit(groups)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    common = tokens.where(F.col("entries") > BLOCK)
    if not common.isEmpty():
        often = checkpoint(known.join(small(common), F.col("token") == F.col("t")).select(*columns, "entries"))
        largest = often.groupBy("token", "component", "entries").agg(F.count("*").alias("n")).groupBy("token", "entries").agg(F.max(F.struct("n", "component")).alias("c"))
        largest = checkpoint(largest.select(F.col("token").alias("t"), F.col("c.component").alias("large"), F.ceil((F.col("entries") - F.col("c.n")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("c.n") / BLOCK).cast("int").alias("blocks")))
        often = often.join(small(largest), F.col("token") == F.col("t"))
        inside = F.col("component") == F.col("large")
        spread = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
        often = often.withColumn("own", F.when(inside, F.col("others") + spread("blocks")).otherwise(spread("others")))
        often = often.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("blocks")) - 1)))
        i, j = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(i == j, 0).when(F.col("own") == i, 1).otherwise(2)
        dealt = dealt.unionByName(often.select(*columns, F.col("token").alias("g"), (i + 1).alias("i"), (j + 1).alias("j"), side.alias("side")))
    dealt = checkpoint(dealt)
    there = dealt.select(F.col("g").alias("tg"), F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("cid").alias("ts")).distinct()
    there = there.join(bitmaps, F.col("ts") == F.col("cid")).select("tg", "ti", "tj", "cid", "n", "bitmap")
    found = dealt.groupBy("g", "i", "j").cogroup(there.groupBy("tg", "ti", "tj")).applyInArrow(_tries(nearest), "a long, b long, apart long")
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tied(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after more links (a, b): only what the links tie is worked out anew."""
    ends = links
    for end in ("a", "b"):
        label = labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        ends = ends.join(label, end, "left")
    new = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    new = checkpoint(new.select(F.col("node").alias("old"), F.col("component").alias("new")))
    moved = labels.join(small(new), F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    first = new.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return checkpoint(moved.unionByName(first))


def ngram_join(docs: DataFrame, centres: int = CENTRES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach. A null or empty text
    has no shingles and links with nothing: its component is its own id. A
    null doc_id takes no part in links and has a null component. Rows that
    repeat an id with another text each have their own set. Texts of any length
    are read whole; one is a set of 8 bytes a word in a task. doc_id is a whole
    number, given back as long. An empty table gives an empty result. Other
    columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = checkpoint(docs.mapInArrow(trimmed(_signatures), "doc_id long, n long, s1 long, s2 long"))
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    classes = checkpoint(signed.where(~alone).groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    total = signed.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(total * 2 // 5 // RANGE_TOKENS).bit_length())
    credits = docs.where("doc_id IS NOT NULL").mapInArrow(trimmed(_dealing(bits)), "r long, tokens binary, tags binary")
    credits = credits.groupBy("r").applyInArrow(_credits(bits), "b long, sets binary, credit binary").groupBy("b").applyInArrow(_totals, "s1 long, credit long")
    out_of = F.least("n", F.floor(F.col("n") / 4) + F.greatest(F.lit(1), F.floor((3 * F.col("n") + 19) / 20))) - F.col("credit")
    left = classes.join(credits, "s1").where(out_of <= F.floor(F.col("n") / 4))
    left = checkpoint(left.select("rep", "s1", "s2", "n", (F.greatest(out_of, F.lit(0)) / F.col("n")).alias("ratio"), F.monotonically_increasing_id().alias("cid")))
    ids = small(left.select("rep", "s1", "s2", "ratio", "cid"), BROADCAST_ROWS)
    sets = docs.join(ids, docs["doc_id"] == ids["rep"]).select("cid", "text", "s1", "s2", "ratio")
    sets = checkpoint(sets.mapInArrow(trimmed(_sets), SETS))
    if not sets.groupBy("cid").count().where("count > 1").isEmpty():  # repeated rows
        sets = checkpoint(sets.dropDuplicates(["cid"]))

    keyed = sets.select("cid", "n", "ratio", F.posexplode("mins").alias("k", "low")).where(F.col("k") < centres)
    found = keyed.groupBy("k", "low").agg(F.min(F.struct("ratio", "cid", "n")).alias("c"), F.count("*").alias("sets"))
    found = checkpoint(found.where("sets > 1").select("k", "low", "c"))  # a table of its own: Spark can split a large group of the other side
    near = keyed.join(found, ["k", "low"]).where((F.col("cid") != F.col("c.cid")) & (4 * F.least("n", "c.n") >= 3 * F.greatest("n", "c.n")))
    links = checkpoint(verify(near.select(F.col("c.cid").alias("a"), F.col("cid").alias("b")).distinct(), sets))
    labels = checkpoint(components(links))
    counts = docs.sparkSession.sparkContext.broadcast(sketch(sets))
    entries = checkpoint(sets.select("cid", "members").mapInArrow(trimmed(_prefixes(counts)), ENTRIES))
    bitmaps = checkpoint(sets.select("cid", "n", "members").mapInArrow(trimmed(_bitmaps), "cid long, n long, bitmap binary"))
    nearest = True  # a set meets only its nearest one as long as most of these link; the last round leaves out nothing
    while (met := (pairs := checkpoint(candidates(entries, bitmaps, labels, nearest))).count()):
        links = checkpoint(verify(pairs, sets))
        labels = tied(labels, links)
        release(docs.sparkSession)
        if not nearest:
            break
        nearest = 2 * links.count() >= met

    linked_sets = checkpoint(left.join(labels, F.col("cid") == F.col("node")).select("s1", "s2", "n", "rep", "component"))
    least = checkpoint(linked_sets.groupBy("component").agg(F.min("rep").alias("component_id")))
    linked_sets = linked_sets.join(least, "component").select("s1", "s2", "n", "component_id")
    classes = classes.join(linked_sets, ["s1", "s2", "n"], "left").select("s1", "s2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    joined = signed.where(~alone).join(checkpoint(classes), ["s1", "s2", "n"])  # a table of its own, as above
    none = signed.where(alone).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return joined.select(*columns).unionByName(none.select(*columns))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x),
least_reached AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_reached ON x = d.doc_id
"""
