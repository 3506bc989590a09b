"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Words are runs of letters, marks and digits, in lower case. A window's
fingerprint is the 64-bit SimHash of its words. Windows come in powers of two:
an item of L words gives all its windows of the largest power up to L, of half
of it from 16 words on (and at 8), and of 16 words if it is longer still; documents give
their windows of these sizes at every word. An item that stands unchanged in a
document has windows at distance 0. A changed one of similarity 0.75 or more has
an unchanged run as long as one of the windows: every place where words were
changed, put in or left out costs at least four shingles on either side, of
which a seventh may be lost, so that runs of 16 words remain between them.

Fingerprints are cut into RADIUS + 1 blocks. Two that differ in at most RADIUS
bits agree on a block, so tables of the items' blocks give every document
window within the radius of an item window. Each such pair of windows fixes
where the item would stand; around it the span is looked for whose shingles
are most of all the item's, of any length, and there the exact weighted
similarity of the 5-word shingles decides: the sum of the lesser counts over
the sum of the greater.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .textkernel import ALNUM, U64, pieces, shingles, spaced, word_hashes, words

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 2
#: First bit and number of bits of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Bytes of item texts that one broadcast index may hold; more items go in several passes.
INDEX_BYTES = 4 << 20


#: The largest window; longer items have windows of this size.
MOST_WORDS = 1 << 14
#: A byte's bits as the lowest bits of eight bytes, and what collects them again in the highest byte.
SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], U64)
EACH, COLLECT = U64(0x0101010101010101), U64(0x0102040810204080)


def window_sizes(n: int) -> list[int]:
    if not n:
        return []
    top = min(1 << (n.bit_length() - 1), MOST_WORDS)
    return sorted({top, top // 2, min(16, top // 2)}, reverse=True) if n >= 16 or n == 8 else [top]


def fingerprints(hashes: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the SimHash of the window that starts at each word (across texts too): the bits that more than half of its words have.

    Eight counters share a 64-bit number. Differences of its running sums are
    the counts of a window, whatever ran over in between; those of windows up
    to 127 words fit, others are counted one bit at a time.
    """
    out = {w: np.zeros(max(0, len(hashes) - w + 1), U64) for w in sizes}
    short, long = [w for w in sizes if w < 128], [w for w in sizes if w >= 128]
    sums = np.zeros(len(hashes) + 1, U64)
    for k in range(8):
        byte = (hashes >> U64(8 * k)).astype(np.uint8)
        if short:
            np.cumsum(SPREAD[byte], out=sums[1:])
        for w in short:
            count = sums[w:] - sums[:-w]
            count += EACH * U64(127 - w // 2)  # its highest bit tells whether a count is more than half
            count >>= U64(7)
            count &= EACH
            count *= COLLECT
            count >>= U64(56)
            count <<= U64(8 * k)
            out[w] |= count
        for bit in range(8 if long else 0):
            np.cumsum((byte >> np.uint8(bit)) & np.uint8(1), dtype=U64, out=sums[1:])
            for w in long:
                out[w] |= (sums[w:] - sums[:-w] > U64(w // 2)).astype(U64) << U64(8 * k + bit)
    return out


def lowered(column: pa.Array) -> pa.Array:
    """Texts in lower case and spaced(), code point by code point, so places stay the same."""
    return spaced(pc.utf8_lower(column))


def similarity(one: Counter, two: Counter) -> float:
    least = sum(min(n, two[s]) for s, n in one.items() if s in two)
    return least / ((one.total() + two.total() - least) or 1)


def least_before(values: np.ndarray, reach: int) -> np.ndarray:
    """Of each value the least among itself and up to reach ones before it, from running minima of blocks."""
    width = reach + 1
    rows = np.pad(values, (reach, -(len(values) + reach) % width), constant_values=np.iinfo(np.int64).max).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(values)], ahead[reach : reach + len(values)])


class Index:
    """Items (id, text) with their fingerprints by window size; built on the driver and broadcast."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.lengths, self.bags = [], []
        prints: dict[int, list] = {}
        for k, (_, text) in enumerate(items):
            _, data, offsets = next(pieces(lowered(pa.array([text]))))
            start, end, bounds = words(data, offsets, ALNUM)
            hashes = word_hashes(data, start, end)
            self.lengths.append(len(hashes))
            self.bags.append(Counter(shingles(hashes, bounds, SHINGLE)[0].tolist()))
            for w, found in fingerprints(hashes, window_sizes(len(hashes))).items():
                prints.setdefault(w, []).append((found, np.full(len(found), k, np.int32), np.arange(len(found), dtype=np.int32)))
        self.windows = {w: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for w, parts in prints.items()}
        self.tables = None

    def open(self) -> Index:
        """Makes the block tables, once in each worker."""
        if self.tables is None:
            self.tables = {}
            for w, (found, _, _) in self.windows.items():
                rows = []
                for first, bits in BLOCKS:
                    values = (found >> U64(first)) & U64((1 << bits) - 1)
                    order = np.argsort(values, kind="stable")
                    there = np.zeros(1 << bits, bool)
                    there[values] = True
                    rows.append((there, values[order].astype(np.uint32), order.astype(np.int32)))
                self.tables[w] = rows
        return self

    def near(self, w: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of prints and of item windows that differ in at most RADIUS bits."""
        found, places, theirs = self.windows[w][0], [], []
        for (first, bits), (there, values, order) in zip(BLOCKS, self.tables[w], strict=True):
            block = (prints >> U64(first)) & U64((1 << bits) - 1)
            at = np.flatnonzero(there[block])
            if not len(at):
                continue
            asked = block[at].astype(np.uint32)
            a, b = np.searchsorted(values, asked, "left"), np.searchsorted(values, asked, "right")
            count = b - a
            mine = np.repeat(at, count)
            other = order[np.repeat(a - (np.cumsum(count) - count), count) + np.arange(len(mine))]
            good = np.bitwise_count(prints[mine] ^ found[other]) <= RADIUS
            places.append(mine[good])
            theirs.append(other[good])
        return (np.concatenate(places), np.concatenate(theirs)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def best(self, item: int, hashes: np.ndarray, starts: list[int]) -> tuple[float, int, int]:
        """The similarity with an item of the span of a text's words, around those where it might start, that speaks most for it, and the span.

        A similarity of 3/4 means 7 shared - 3 own >= 3 of the item's. So each
        shingle of the text counts 4 if the item has it, else -3, and the run
        with the greatest sum decides. Of a shingle that the text repeats, only
        as many within a span's length count as the item has.
        """
        length, bag = self.lengths[item], self.bags[item]
        if length < SHINGLE:
            (own,) = bag
            for a in starts:
                if 0 <= a <= len(hashes) - length and shingles(hashes[a : a + length], np.array([0, length]), SHINGLE)[0][0] == own:
                    return 1.0, a, a + length
            return 0.0, 0, 0
        most = (length - SHINGLE + 1) * 4 // 3 + SHINGLE  # words of a span that can reach the similarity
        around: list[list[int]] = []  # places that overlap are searched together
        for a in starts:
            low, high = max(0, a + length - most), min(len(hashes), a + most)
            if around and low <= around[-1][1]:
                around[-1][1] = high
            else:
                around.append([low, high])
        top = (0.0, 0, 0)
        for low, high in around:
            if high - low < SHINGLE:
                continue
            found = shingles(hashes[low:high], np.array([0, high - low]), SHINGLE)[0].tolist()
            seen: dict[int, deque] = {}
            score = np.full(len(found) + 1, -3, np.int64)
            score[0] = 0
            for at, s in enumerate(found):
                if count := bag.get(s):
                    last = seen.setdefault(s, deque(maxlen=count))
                    if len(last) < count or last[0] < at - most:
                        last.append(at)
                        score[at + 1] = 4
            sums = np.cumsum(score)
            behind = int(np.argmax(sums - least_before(sums, most)))
            before = max(0, behind - most) + int(np.argmin(sums[max(0, behind - most) : behind + 1]))
            if behind > before and (s := similarity(Counter(found[before:behind]), bag)) > top[0]:
                top = (s, low + before, low + behind + SHINGLE - 1)
        return top

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(index of the text, item, similarity, start, end in code points) for the best place of each item in each text."""
        self.open()
        for first, data, offsets in pieces(lowered(column)):
            start, end, bounds = words(data, offsets, ALNUM)
            hashes = word_hashes(data, start, end)
            asked = [np.zeros((2, 0), np.int64)]  # text and item as one number, and the item's first word in the text
            sizes = [w for w in self.windows if w <= len(hashes)]
            for w, prints in fingerprints(hashes, sizes).items():
                mine, other = self.near(w, prints)
                text = np.searchsorted(bounds, mine, "right") - 1
                inside = mine + w <= bounds[text + 1]
                _, item, offset = self.windows[w]
                asked.append(np.stack([text * len(self.ids) + item[other], mine - bounds[text] - offset[other]])[:, inside])
            who, place = np.concatenate(asked, axis=1)
            order = np.lexsort((place, who))
            who, place = who[order], place[order]
            new = (np.diff(who, prepend=-1) != 0) | (np.diff(place, prepend=0) != 0)
            who, place = who[new], place[new]
            cuts = np.flatnonzero(np.diff(who, prepend=-1))
            for x, y in pairwise([*cuts, len(who)]):
                t, i = divmod(int(who[x]), len(self.ids))
                s, a, b = self.best(i, hashes[bounds[t] : bounds[t + 1]], place[x:y].tolist())
                if s >= SIMILARITY:
                    at, behind = start[bounds[t] + a], end[bounds[t] + b - 1]
                    before = len(data[offsets[t] : at].tobytes().decode())
                    yield first + t, i, s, before, before + len(data[at:behind].tobytes().decode())


def indexes(benchmark: DataFrame) -> list:
    """Broadcast indexes of the items (item_id, text), each of a bounded size; texts without a word are left out."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = -(-size // INDEX_BYTES) or 1
    out = []
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about INDEX_BYTES
        out.append(spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in rows])))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start, end (code points) for every item that a text of docs (doc_id, text) holds.

    Null and empty texts and items hold nothing; an item of fewer than five
    words has one shingle, its whole sequence, and is found where the text has
    these words in a row. Texts of any length are read whole. Repeated rows each
    give their rows, ties go to the first place, an empty table gives none. Other
    columns are not read; documents without a leak give no row.
    """
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    found = None
    for index in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(index.value.hits(batch.column(1)))
                ids = [index.value.ids[h[1]] for h in hits]
                columns = [batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), ids, *([h[k] for h in hits] for k in (2, 3, 4))]
                types = [None, pa.int32() if item_type == "int" else pa.int64() if item_type == "bigint" else pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "similarity", "start", "end"])

        part = docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {id_type}, item_id {item_type}, similarity double, start long, end long")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item."""
    for index in indexes(benchmark):
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], index=index, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in index.value.hits(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
