"""N-gram join, embeddings and mixing against brute force."""

import math
import random
import re
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contentloom.llm import components, embedjoin, mixing, ngramjoin, textkernel

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_join(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    ids, links = sorted(sets), []
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                links.append((i, j))
    return {(i, len(sets[i]), c) for i, c in least_reachable(ids, links).items()}


def corpus(seed, groups, most=60):
    """Groups of near copies at every distance, copies, shared passages and short texts."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = text(30), []
    for g in range(groups):
        base = text(r.randint(1, most)) if g % 3 else [*text(r.randint(5, 25)), *passage, *text(r.randint(0, 25))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                k = r.randrange(len(copy) + 1)
                if r.random() < 0.5 and k < len(copy):
                    copy[k] = r.choice(vocabulary)
                else:
                    copy[k:k] = [r.choice(vocabulary)]
            rows.append(" ".join(copy) if r.random() < 0.8 else "\n".join(copy).upper())
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,groups", [(1, 60), (2, 120)])
def test_ngram_join_equals_brute_force(spark, seed, groups):
    rows = corpus(seed, groups)
    found = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {tuple(r) for r in found} == brute_join(rows)
    assert len(found) == len(rows)


def test_ngram_join_without_centres_and_with_small_blocks(spark, monkeypatch):
    """The tries alone find all links, also when common tokens are dealt in blocks."""
    rows = corpus(3, 60)
    monkeypatch.setattr(ngramjoin, "BLOCK", 3)
    monkeypatch.setattr(ngramjoin, "GROUP_ENTRIES", 50)
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", -1)
    found = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), centres=0).collect()
    assert {tuple(r) for r in found} == brute_join(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tries_alone_meet_all_links_and_prune(seed):
    """Every link is met by the trie without bitmaps and centres, and paths cut what only shares a member."""
    rows = corpus(seed, 150)
    sets = {}
    for k, members in textkernel.shingle_sets(pa.array([t for _, t in rows]), 5):
        sets.setdefault(members.tobytes(), k)
    sets = {k: np.frombuffer(m, np.uint64) for m, k in sets.items() if m}
    sketch = np.zeros(ngramjoin.SKETCH, np.int32)
    for m in sets.values():
        np.add.at(sketch, (m % np.uint64(ngramjoin.SKETCH)).astype(np.int64), 1)
    batch = pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array([m.tobytes() for m in sets.values()])], names=["cid", "members"])
    (entries,) = ngramjoin._prefixes(types.SimpleNamespace(value=sketch))([batch])
    table = pa.Table.from_batches([entries])
    table = table.append_column("component", table["cid"]).append_column("side", pa.array([0] * len(table)))
    blank = pa.table({"cid": list(sets), "n": [len(m) for m in sets.values()], "bitmap": [bytes(8)] * len(sets)})
    met = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in ngramjoin._tries(False)(table, blank).to_pylist()}
    ids = sorted(sets)
    links = {(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if ngramjoin.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert len(links) > 50 and links <= met
    by_token = {}
    for token, cid in zip(table["token"].to_pylist(), table["cid"].to_pylist(), strict=True):
        by_token.setdefault(token, set()).add(cid)
    shared = {(i, j) for owners in by_token.values() for i in owners for j in owners if i < j and 4 * min(len(sets[i]), len(sets[j])) >= 3 * max(len(sets[i]), len(sets[j]))}
    assert len(met) < 0.8 * len(shared)


def test_ngram_join_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "x" * 50_000), (7, "x" * 50_000), (None, "a b"), (8, "a b"), (8, "a b"), (9, "é b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("s1", F.lit(0)).withColumn("rep", F.lit(1))
    found = sorted(map(tuple, ngramjoin.ngram_join(docs).collect()), key=str)
    assert found == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (None, 1, None), (8, 1, 4), (8, 1, 4), (9, 1, 9)], key=str)
    assert ngramjoin.ngram_join(docs.limit(0)).collect() == []


def test_labels_after_more_links(spark):
    r = random.Random(6)
    links = [(r.randrange(90), r.randrange(90)) for _ in range(60)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    labels = ngramjoin.tied(components.components(frame(links[:30])), frame(links[30:]))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, components.components(frame(links)).collect()))


def test_components(spark):
    r = random.Random(5)
    assert components.components(spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")).collect() == []
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 180)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    found = {row[0]: row[1] for row in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {i for link in links for i in link if link[0] != link[1]}
    want = least_reachable(sorted(ids), links)
    assert found == {i: c for i, c in want.items() if i in found} and ids == set(found)


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 24))
    rows = []
    for k in range(400):
        x = base[k % 60] + r.standard_normal(24) * (0.02 + 0.25 * (k % 7) / 7)
        rows.append((k, [float(v) for v in np.float32(x)], int(k % 3) if k % 11 else None))
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(4)] + [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [None] * 24, 1), (2004, [], 1), (None, rows[5][1], rows[5][2]), (2005, [1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("copies", F.lit("clash"))
    found = {x[0]: tuple(x)[1:] for x in embedjoin.near_embeddings(frame.repartition(3)).collect()}
    good = {}
    for i, x, label in rows:
        if i is not None and x and label is not None and None not in x and np.isfinite(x).all() and any(x):
            v = np.asarray(x, np.float64)
            good[i] = (v / math.sqrt(v @ v), label)
    ids, links = sorted(good), []
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.98:
                links.append((i, j))
    assert len(links) > 300
    n = dict.fromkeys(found, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    recall = sum(found[i][0] for i in ids) / (2 * len(links))
    assert 0.99 <= recall <= 1
    assert len(found) == len(rows)
    if recall == 1:
        root = least_reachable(ids, links)
        assert all(found[i] == (n[i], root[i], root[i] == i) for i in ids)
    assert all(found[i] == (0, i, True) for i in (2000, 2001, 2002, 2003, 2004))
    assert found[None] == (0, None, False)
    assert embedjoin.near_embeddings(frame.limit(0)).collect() == []


def test_embeddings_of_odd_labels_and_repeated_ids(spark):
    one, two = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, one, 1.2), (2, one, 1.4), (3, one, 1.2), (4, two, 1.2), (4, one, 1.4), (4, two, 1.2)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label double")
    found = sorted(map(tuple, embedjoin.near_embeddings(frame).collect()))
    assert found == sorted([(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 2, False), (4, 1, 4, True)])
    names = frame.withColumn("label", F.concat(F.lit("l"), F.col("label")))
    assert sorted(map(tuple, embedjoin.near_embeddings(names).collect())) == found


def test_blocks_of_a_cell_find_what_one_block_does(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.standard_normal((150, 16))
    rows = [(k, [float(v) for v in base[k % 150] + r.standard_normal(16) * 0.08], 1) for k in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    one = {tuple(x) for x in embedjoin.near_embeddings(frame).collect()}
    monkeypatch.setattr(embedjoin, "BLOCK", 40)
    assert {tuple(x) for x in embedjoin.near_embeddings(frame).collect()} == one


def test_tables_of_cells_find_each_pair_once():
    """The whole path of a large label, in one process: recall, and no pair twice."""
    r = np.random.default_rng(7)
    base = embedjoin.unit(list(r.standard_normal((1500, 24))))
    pairs = [(x, embedjoin.unit([x + r.standard_normal(24) * 0.19 / math.sqrt(24)])[0]) for x in base]
    rows = [x for pair in pairs for x in pair]
    table = pa.table({"label": ["l"] * len(rows), "vec": range(len(rows)), "embedding": [x.tolist() for x in rows], "copies": [1] * len(rows), "rows": [10**6] * len(rows)})
    cells = pa.Table.from_batches(embedjoin._cells(table.to_batches()))
    axes, count = embedjoin.tables(10**6)
    assert len(cells) == count * len(rows) and count <= 20 and embedjoin.tables(10**9)[1] <= 64 and embedjoin.tables(100) == (0, 1)
    groups = {}
    for k, cell in enumerate(cells["cell"].to_pylist()):
        groups.setdefault(cell, []).append(k)
    links = np.zeros(len(rows), np.int64)
    for cell, at in groups.items():
        found = embedjoin._pairs((pa.scalar("l"), pa.scalar(cell)), cells.take(at).append_column("side", pa.array([0] * len(at))))
        links[found["vec"].to_numpy()] += found["links"].to_numpy()
    x = np.stack(rows)
    want = ((x @ x.T) >= embedjoin.COSINE).sum(1) - 1
    assert want.sum() > 1000 and (links <= want).all() and links.sum() >= 0.99 * want.sum()


def filled(sizes, weights, share):
    """Water filling: what passes a limit is shared again."""
    total, target, capped = share * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        level = left / sum(weights[s] for s in free) if free else 0
        target = {s: 2.0 * sizes[s] if s in capped else level * weights[s] for s in sizes}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    r = random.Random(1)
    sources = ["b", "a", "é", None, "z", "empty"]
    rows = [(k, " ".join(["w"] * r.randint(0, 40)) if k % 17 else None, sources[min(int(r.expovariate(0.8)), 4)]) for k in range(700)] + [(900, None, "empty"), (901, "", "empty")]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bucket", F.lit("clash"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 700, 3)] + [(3, None), (None, 1)], "doc_id long, quality int")
    found = mixing.mix(docs, labels).collect()
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(7), labels).collect()))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5)
    by_id = {k: s for k, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for x in found:
        s = by_id[x.doc_id]
        assert x.source_size == sizes[s] and x.target == pytest.approx(target[s]) and 0 <= x.taken <= 2 * x["size"]
        taken[s] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    for s in sizes:  # epochs before parts: at most one document of a source is cut
        epochs = int(target[s] + 0.5) // sizes[s] if sizes[s] else 0
        cut = [x for x in found if by_id[x.doc_id] == s and x["size"] and x.taken not in (epochs * x["size"], (epochs + 1) * x["size"])]
        assert len(cut) <= 1
    assert mixing.mix(docs.limit(0), labels).collect() == []
