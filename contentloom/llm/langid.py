"""Language identification of texts, also of mixed ones.

A model is learned from labelled texts: for every language the log frequencies
of hashed byte n-grams of words, and the scripts it is written in. A text's
words get a score for every language whose scripts they have; Viterbi with a
penalty for each switch labels spans of the text. The language with the most
letters in its spans is the text's. Letters of scripts that no language has,
and those of words of mostly unseen n-grams, are no language's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .textkernel import pieces, words

#: Documents that a model is learned from are a fixed sample of about so many for each language, by a hash of doc_id.
SAMPLE_ROWS = 2000
#: A model has the languages with the most labelled documents, so many at most: about 65,000 numbers each come to the driver and to every worker.
MOST_LANGUAGES = 200
BITS = 16
SWITCH = 12.0
#: What one n-gram can speak for or against a language at most.
FLOOR = -6.0
#: A model with fewer n-grams has seen too little for a missing one to mean anything.
ENOUGH = 1000
UND = "und"

#: Bytes of words: ASCII letters and all of a multi-byte character (lowered() leaves only those of letters and marks).
LETTERS = np.array([chr(i).isalpha() and i < 128 or i >= 128 for i in range(256)])
#: First code points of runs of one script: Latin 0, Greek 1, Cyrillic 2, Armenian and Hebrew 3, Arabic and the like 4, Indic and South-East Asian 5, Georgian and Ethiopic 6, Hangul 7, Han and kana 8, others 9.
RUNS = (
    (0x41, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x600, 4), (0x900, 5), (0x10A0, 6), (0x1100, 7), (0x1200, 6), (0x13A0, 9), (0x1700, 5), (0x1800, 9), (0x1900, 5), (0x1C80, 2), (0x1C90, 6), (0x1CC0, 5), (0x1D00, 0), (0x1D26, 1), (0x1D2B, 2), (0x1D2C, 0), (0x1E00, 0), (0x1F00, 1), (0x2000, 9),
    (0x2C00, 9), (0x2C60, 0), (0x2C80, 9), (0x2D00, 6), (0x2DE0, 2), (0x2E00, 9), (0x2E80, 8), (0x3130, 7), (0x3190, 8), (0xA000, 9), (0xA640, 2), (0xA6A0, 9), (0xA720, 0), (0xA800, 5), (0xA960, 7), (0xA980, 5), (0xAB00, 6), (0xAB30, 0), (0xAB70, 9), (0xABC0, 5), (0xAC00, 7), (0xD800, 9),
    (0xF900, 8), (0xFB00, 0), (0xFB13, 3), (0xFB50, 4), (0xFE00, 9), (0xFE70, 4), (0xFF00, 0), (0xFF66, 8), (0xFFA0, 7), (0xFFE0, 9), (0x1B000, 8), (0x1B300, 9), (0x1E900, 9), (0x1EE00, 4), (0x1F000, 9), (0x20000, 8),
)
SCRIPTS = 10
_FIRST, _SCRIPT = np.array([0, *(a for a, _ in RUNS)]), np.array([9, *(x for _, x in RUNS)], np.uint8)
#: How many bits of a character its first byte holds, by that byte.
_LEAD = np.array([0x7F if b < 0x80 else 0x1F if b < 0xE0 else 0x0F if b < 0xF0 else 0x07 for b in range(256)], np.int64)


def scripts_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The scripts of the characters whose first bytes stand at those places."""
    first = data[at]
    code = first & _LEAD[first]
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = first >= least
        code[more] = (code[more] << 6) | (data[at[more] + k] & 0x3F)
    return _SCRIPT[np.searchsorted(_FIRST, code, "right") - 1]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # [n-gram, language], less the best language's score of that n-gram
    scripts: np.ndarray  # [script, language]: whether the language has it
    seen: np.ndarray  # [n-gram]: whether a learned text has it; all true if they have fewer than ENOUGH


@lru_cache(1 << 16)
def _in_words(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


def normal(text: str) -> str:
    """In lower case, with a blank for each character beyond ASCII that is neither a letter nor a mark."""
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not _in_words(c):
                text = text.replace(c, " ")
    return text


def lowered(column: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else normal(t) for x in column], pa.large_string())


def ngrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (of 3 bytes with the word's borders, and whole words) and the index of their words."""
    lens = end - start
    owner = np.repeat(np.arange(len(start)), lens)
    at = np.repeat(start - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    first, last = at == start[owner], at + 1 == end[owner]
    here = data[at].astype(np.uint32)
    before = np.where(first, 1, data[np.maximum(at - 1, 0)]).astype(np.uint32)
    behind = np.where(last, 2, data[np.minimum(at + 1, len(data) - 1)]).astype(np.uint32)
    gram = (before << np.uint32(16)) | (here << np.uint32(8)) | behind
    return ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), owner


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from the texts of docs (doc_id, text, lang) with a lang.

    At most about rows documents of each language are read, whole. They are
    chosen by a hash of doc_id, so runs agree. Only counts come to the driver:
    2**BITS for each of MOST_LANGUAGES at most.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    part = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("count"))
    part = counts.select(F.col("lang").alias("l"), part.alias("part"))
    chosen = known.join(F.broadcast(part), F.col("lang") == F.col("l"))  # MOST_LANGUAGES rows
    dice = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = chosen.where(dice < F.col("part")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, data, offsets in pieces(lowered(batch.column(1))):
                start, end, bounds = words(data, offsets, LETTERS)
                if not len(start):
                    continue
                gram, owner = ngrams(data, start, end)
                script = scripts_at(data, start)
                for d in range(len(bounds) - 1):
                    own = total.setdefault(langs[first + d], np.zeros((1 << BITS) + SCRIPTS, np.int64))
                    a, b = np.searchsorted(owner, [bounds[d], bounds[d + 1]])
                    np.add.at(own, gram[a:b], 1)
                    np.add.at(own, (1 << BITS) + script[bounds[d] : bounds[d + 1]].astype(np.int64), 1)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "gram", "n"])

    found = chosen.mapInArrow(trimmed(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    table = np.zeros(((1 << BITS) + SCRIPTS, len(languages)))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        table[own["gram"].to_numpy(np.int64), k] = own["n"].to_numpy(float)
    grams, scripts = table[: 1 << BITS], table[1 << BITS :]
    scores = np.zeros_like(grams)
    if languages:
        scores = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * (1 << BITS)))
        scores = np.maximum(scores - scores.max(1, keepdims=True), FLOOR)
    seen = grams.any(1)
    return Model(languages, scores.astype(np.float32), scripts > 0.001 * scripts.sum(0) if languages else scripts > 0, seen | (seen.sum() < ENOUGH))


def viterbi(scores: np.ndarray) -> np.ndarray:
    """The best label of each word; the first language wins ties."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int32)
    now = scores[0].tolist()
    rows = scores.tolist()
    for i in range(1, n):
        top = max(now)
        best = now.index(top)
        top -= SWITCH
        row = rows[i]
        for s in range(k):
            if now[s] < top:
                back[i, s] = best
                now[s] = top + row[s]
            else:
                back[i, s] = s
                now[s] += row[s]
    path = np.zeros(n, np.int64)
    path[-1] = int(np.argmax(now))
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def labelled(scores: np.ndarray) -> np.ndarray:
    """viterbi(), without its loop where one language is surely best throughout.

    Against the language with the greatest sum a path gains what its runs of
    other languages gain, less a penalty for each switch. A block of r runs
    beside or between words of that language costs r penalties at least, so it
    loses if no run gains more than one. A block over the whole text costs
    r - 1: it loses if, besides, what a run from the first word and one to the
    last gain is together no more than one.
    """
    best = int(np.argmax(scores.sum(0, dtype=np.float64)))
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    before = np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]])
    run = float((gain - np.minimum.accumulate(before, axis=0)).max())
    ends = float(gain.max()) + float((gain[-1] - before).max())
    if max(run, ends) < SWITCH - 1e-6:
        return np.full(len(scores), best)
    return viterbi(scores)


def word_scores(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the words for each language, and whether half of their n-grams at least were seen in any."""
    gram, owner = ngrams(data, start, end)
    first = np.searchsorted(owner, np.arange(len(start)))
    seen = 2 * np.add.reduceat(model.seen[gram].astype(np.int64), first) >= end - start
    scores = np.add.reduceat(model.scores[gram], first, axis=0)
    # a word speaks for or against a language by no more than a few n-grams
    scores = np.maximum(scores, 2 * FLOOR)
    allowed = model.scripts[scripts_at(data, start)]
    none = ~allowed.any(1)
    allowed[none] = True
    scores[none] = 0
    return np.where(allowed, scores, 4 * FLOOR), seen


def letters(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many letters (with marks) each word has, and how many of them are of a script that a language has."""
    at = np.flatnonzero(((data & 0xC0) != 0x80) & LETTERS[data])
    ours = model.scripts.any(1)[scripts_at(data, at)]
    a, b = np.searchsorted(at, start), np.searchsorted(at, end)
    sums = np.concatenate([[0], np.cumsum(ours)])
    return b - a, sums[b] - sums[a]


def predict(model: Model, column: pa.Array) -> Iterator[tuple[int, str, float, list, float]]:
    """(index of the text, language, its share of the letters, spans as (language, first word, word behind), all languages' share)."""
    for first, data, offsets in pieces(lowered(column)):
        start, end, bounds = words(data, offsets, LETTERS)
        scores = None
        if len(start) and model.languages:
            scores, seen = word_scores(model, data, start, end)
            size, known = letters(model, data, start, end)
            known = np.where(seen, known, 0)
        for d in range(len(offsets) - 1):
            a, b = bounds[d], bounds[d + 1]
            if scores is None or not known[a:b].any():
                yield first + d, UND, 0.0, [], 0.0
                continue
            path = labelled(scores[a:b])
            share = np.bincount(path, weights=known[a:b], minlength=len(model.languages)) / size[a:b].sum()
            top = int(np.argmax(share))
            cuts = np.flatnonzero(np.diff(path, prepend=-1))
            spans = [(model.languages[path[x]], int(x), int(y)) for x, y in zip(cuts, [*cuts[1:], b - a], strict=True)]
            yield first + d, model.languages[top], float(share[top]), spans, float(share.sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans for every row of docs (doc_id, text).

    lang_pred is und, with score 0, for a null text, one without a letter, one
    whose letters are all no language's, and if the model has no language. Ties
    go to the language first by code point. Texts of any length are read whole.
    Repeated rows each give a row, an empty table none; other columns are not
    read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("behind", pa.int64())]))
        for batch in batches:
            found = list(predict(model, batch.column(1)))
            spans = [[{"lang": lang, "first": a, "behind": b} for lang, a, b in f[3]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array(spans, span)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,first:long,behind:long>>")


def fold(doc_id: Column) -> Column:
    """0 for the documents that are held out: crc32 of doc_id as text, mod 5."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def with_language(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out, for all of docs."""
    model = learn(docs.where(fold(F.col("doc_id")) != 0), rows)
    found = identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, of whose letters at least so many are of known languages, be it of one or of several."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.where(fold(F.col("doc_id")) != 0)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [lang != UND and share >= least for _, lang, _, _, share in predict(model.value, batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)

