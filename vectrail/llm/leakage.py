"""Problem 7: passages of held-out items inside training texts (latent semantic retrieval).

Texts are read as words the way a reader sees them. A passage is a stretch of a text in which words of the items follow each
other without a gap of more than `gap` other words, without gaps only as neighbours that are neighbours in an item too; texts
without such a stretch cannot contain a run of item words, so nothing is lost by going on with the passages alone. Windows of
the passages and of the items form a TF-IDF matrix whose right singular vectors come from a distributed randomised SVD: two
passes over the written windows, each adding up a words x sketch matrix. Items with a window whose cosine with one of the
passage's windows is high in the latent space are the passage's candidates; each is then checked exactly: the longest common
run of words, the longest common subsequence, and the share of the item's telling words (numbers and rare words: what an answer
rests on) that the passage has.

The items are read by every task; they come in blocks of at most ITEM_CHARS characters, each block with a pass of its own, so
that a block's words (some 700,000 different ones at the very most) and their latent rows fit a broadcast.
Null and empty texts contain nothing; repeated items and documents give repeated matches that come out once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.bagminhash import mix
from vectrail.session import materialize, spread

ITEM_CHARS = 4_000_000
WIDE = 48  # words of a passage's window where gaps are allowed
NARROW, STRIDE = 24, 12  # words of an item's window, and of a passage's without gaps, and from one to the next
TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|<!--.*?-->", re.DOTALL)
#: Tags inside of which a word may go on.
INLINE = frozenset("a abbr b big code del em font i ins kbd mark q s small span strike strong sub sup tt u var wbr".split())
BREAK = re.compile(r"(?<=[^\W\d_])[-\u00ad\u2010\u2011][ \t\r]*\n[ \t\r]*(?=[^\W\d_])")
HIDDEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe00-\ufe0f\u0300-\u036f]")
EMPHASIS = re.compile(r"(?<=\w)(?:\*\*|~~)(?=\w)")
WORD = re.compile("[^\\W_]+(?:\x02[^\\W_]+)*")


def reader_words(text: str | None, known: dict[str, int] | None = None) -> list[str]:
    """Words as a reader sees them: no mark-up, entities, invisible characters, case, or compatibility and decomposed forms.
    A word hyphenated at a line end is put together, unless only its parts are `known`."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(lambda m: "" if (m[1] or "").lower() in INLINE else " ", text)
    if "\n" in text:
        text = BREAK.sub("\x02", text)
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "**" in text or "~~" in text:
        text = EMPHASIS.sub("", text)
    found = WORD.findall(text.lower())
    if "\x02" not in text:
        return found
    out: list[str] = []
    for w in found:
        if "\x02" in w:
            whole, parts = w.replace("\x02", ""), w.split("\x02")
            out += parts if known is not None and whole not in known and all(p in known for p in parts) else [whole]
        else:
            out.append(w)
    return out


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) of equal words in a and b, in order; a word below 0 equals none."""
    at = np.flatnonzero(np.isin(a, b) & (a >= 0))
    found = [np.nonzero(a[at[s : s + 4096], None] == b[None]) for s in range(0, max(1, len(at)), 4096)]
    return np.concatenate([at[s * 4096 + i] for s, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def longest_run(a: np.ndarray, b: np.ndarray, places: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Words of the longest common run: consecutive places on a diagonal."""
    i, j = places or common(a, b)
    if not len(i):
        return 0
    key = np.sort((j - i) * (2 * len(a) + 2) + i)
    starts = np.flatnonzero(np.r_[True, np.diff(key) != 1, True])
    return int(np.diff(starts).max())


def longest_subsequence(a: np.ndarray, b: np.ndarray, places: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Words of the longest common subsequence: the longest chain of places that rises in both, or where places are many, a
    row at a time, as the maximum may run along the row."""
    i, j = places or common(a, b)
    if len(i) <= 64 * min(len(a), len(b)):
        ends: list[int] = []
        for y in j[np.lexsort((-j, i))].tolist():
            at = bisect_left(ends, y)
            ends[at : at + 1] = [y]
        return len(ends)
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        step = row.copy()
        step[1:] = np.maximum(row[1:], np.where((b == x) & (x >= 0), row[:-1] + 1, 0))
        row = np.maximum.accumulate(step)
    return int(row[-1])


def cut(words: np.ndarray, size: int) -> list[np.ndarray]:
    """Windows of up to `size` words that overlap by half; a run of half a window lies in one whole."""
    step = size // 2
    return [words[s : s + size] for s in range(0, max(1, len(words) - step), step)]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of n consecutive words."""
    size = max(0, len(words) - n + 1)
    key = np.zeros(size, np.uint64)
    for i in range(n):
        key = mix(key ^ words[i : i + size].astype(np.uint64))
    return key


def neighbours(coded: list[np.ndarray], words: int) -> np.ndarray:
    """The pairs of words that follow each other in an item, as sorted numbers."""
    return np.unique(np.concatenate([np.empty(0, np.int64), *(c[:-1].astype(np.int64) * words + c[1:] for c in coded)]))


def stretches(w: np.ndarray, least: int, gap: int, pairs: np.ndarray, words: int) -> list[np.ndarray]:
    """The passages of a text given as word numbers, other words being -1."""
    at = np.flatnonzero(w >= 0)
    if len(at) < least:
        return []
    apart = np.diff(at) > gap + 1
    if not gap:
        key = w[at[:-1]].astype(np.int64) * words + w[at[1:]]
        place = np.searchsorted(pairs, key)
        place[place == len(pairs)] = 0
        apart |= pairs[place] != key if len(pairs) else True
    ends = np.flatnonzero(apart) + 1
    return [w[at[a] : at[b - 1] + 1] for a, b in zip(np.r_[0, ends], np.r_[ends, len(at)], strict=True) if b - a >= least]


def passages(docs: DataFrame, id_col: str, text_col: str, known: dict[str, int], pairs: np.ndarray, least: int, gap: int) -> DataFrame:
    """(doc_id, words): each stretch with at least `least` item words; other words are -1. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast((known, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, pairs = shared.value
        for batch in batches:
            ids, out = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = reader_words(value.as_py(), look)
                if len(words) >= least:
                    found = stretches(np.fromiter((look.get(x, -1) for x in words), np.int32, len(words)), least, gap, pairs, len(look))
                    ids += [key] * len(found)
                    out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "words"])

    picked = spread(docs.select(F.col(id_col).cast("bigint"), text_col).where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)))
    return picked.mapInArrow(run, "doc_id bigint, words array<int>")


def windows_of(table: DataFrame, size: int) -> DataFrame:
    """(words) of whole stretches, in windows that overlap by half. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for batch in batches:
            for row in _rows(batch):
                out += cut(row, size)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["words"])
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["words"])

    return table.select("words").mapInArrow(run, "words array<int>")


class _Weights:
    """Rows of word numbers as TF-IDF weights of unit length."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def project(self, rows: list[np.ndarray], basis: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        out, sparse = np.zeros((len(rows), basis.shape[1])), []
        for i, r in enumerate(rows):
            words, n = np.unique(r[r >= 0], return_counts=True)
            w = (1 + np.log(n)) * self.idf[words]
            w = w / max(1e-12, np.sqrt((w * w).sum()))
            sparse.append((words, w))
            out[i] = w @ basis[words]
        return out, sparse


def _rows(batch: pa.RecordBatch, name: str = "words") -> list[np.ndarray]:
    column = batch.column(name)
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def gram_times(table: DataFrame, items: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis of the TF-IDF matrix A of the passages' and items' windows. Tasks add up a words x columns matrix; its rows are
    summed by word in a shuffle, and the words x columns sum, whose size the block of items bounds, goes to the driver as Arrow."""
    shared = table.sparkSession.sparkContext.broadcast((idf, basis.astype(np.float32)))
    columns = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = shared.value
        total, weights = np.zeros(basis.shape), _Weights(idf)
        for batch in batches:
            y, sparse = weights.project(_rows(batch), basis)
            for row, (words, w) in zip(y, sparse, strict=True):
                total[words] += w[:, None] * row
        at = np.flatnonzero(total.any(1))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(at) + 1) * columns, columns, np.int32)), pa.array(total[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), rows], ["word", "row"])

    parts = table.select("words").mapInArrow(run, "word int, row array<double>")
    added = parts.groupBy("word").agg(F.array(*(F.sum(F.col("row")[i]) for i in range(columns))).alias("row")).toArrow()
    out = np.zeros(basis.shape)
    if added.num_rows:
        out[added.column("word").to_numpy()] = added.column("row").combine_chunks().flatten().to_numpy().reshape(-1, columns)
    y, sparse = _Weights(idf).project(items, basis)
    for row, (words, w) in zip(y, sparse, strict=True):
        out[words] += w[:, None] * row
    return out


def right_singular(table: DataFrame, items: list[np.ndarray], idf: np.ndarray, rank: int, spare: int = 8) -> np.ndarray:
    """The leading right singular vectors (words x rank) by a randomised sketch and one power step."""
    size = min(len(idf), rank + spare)
    sketch = np.random.default_rng(3).normal(size=(len(idf), size))
    q, _ = np.linalg.qr(gram_times(table, items, idf, sketch))
    small = q.T @ gram_times(table, items, idf, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(values)[::-1][:rank]]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, gap: int = 0, rank: int = 96, cosine: float = 0.3, told: float = 0.5) -> DataFrame:
    """(doc_id, item_id, similarity, run, lcs, answer): the best figures of each document and item that the latent search
    brings together and that share a run of `least` words, or, if `gap` is above 0, of all it brings together: similarity is
    the latent cosine of windows, run and lcs count words and answer is a share, those of a whole passage. Candidates have a
    similarity of `cosine` or, where gaps are allowed, an answer of at least `told`."""
    spark = docs.sparkSession
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = int(chars // ITEM_CHARS) + 1
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select(F.col("item_id").cast("bigint"), "text")
        part = _leaks_of_block(docs, [(r["item_id"], r["text"]) for r in block.collect()], id_col, text_col, least, gap, rank, cosine, told)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


SCHEMA = "doc_id bigint, item_id bigint, similarity double, run int, lcs int, answer double"


class _Items:
    """What the tasks know of a block of items: their words, windows in the latent space, telling words, and hashed runs."""

    def __init__(self, coded: dict[int, np.ndarray], words: int, least: int, gap: int):
        self.coded, self.names, self.least, self.gap = coded, np.array(list(coded)), least, gap
        parts = [cut(w, NARROW) for w in coded.values()]
        self.windows = [x for p in parts for x in p]
        self.first = np.cumsum([0, *map(len, parts)])[:-1]
        own = Counter(w for c in coded.values() for w in set(c.tolist()))
        self.telling = {item: np.array([w for w in np.unique(c) if own[int(w)] <= max(1, len(coded) // 100)], np.int32) for item, c in coded.items()}
        runs = [grams(w, least) for w in coded.values()] if not gap else []
        gram = np.concatenate([np.empty(0, np.uint64), *runs])
        holder = np.repeat(np.arange(len(runs)), [len(h) for h in runs]).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.holder = gram[order], holder[order]

    def place(self, idf: np.ndarray, basis: np.ndarray) -> None:
        self.weights, self.basis = _Weights(idf), basis.astype(np.float32)
        self.latent = self.project(self.windows)

    def project(self, rows: list[np.ndarray]) -> np.ndarray:
        y, _ = self.weights.project(rows, self.basis)
        return (y / np.maximum(1e-12, np.linalg.norm(y, axis=1))[:, None]).astype(np.float32)

    def closest(self, words: np.ndarray) -> np.ndarray:
        """The cosine of each item's nearest window with the nearest window of the words."""
        near, parts = np.full(len(self.windows), -1.0, np.float32), cut(words, WIDE if self.gap else NARROW)
        for start in range(0, len(parts), 256):
            near = np.maximum(near, (self.latent @ self.project(parts[start : start + 256]).T).max(1))
        return np.maximum.reduceat(near, self.first)

    def sharing(self, words: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Those of the wanted items (places, sorted) that have a run of `least` words in common with the words."""
        here = np.unique(grams(words, self.least))
        low, high = np.searchsorted(self.gram, here), np.searchsorted(self.gram, here, "right")
        hits = [self.holder[x:y] for x, y in zip(low[high > low], high[high > low], strict=True)]
        return np.intersect1d(np.concatenate(hits), wanted) if hits else np.empty(0, np.int64)


def _leaks_of_block(docs, rows, id_col, text_col, least, gap, rank, cosine, told):
    spark = docs.sparkSession
    texts = {}
    for item, text in rows:
        if item is not None and text:
            texts[item] = reader_words(text)
    known = {w: i for i, w in enumerate(sorted({w for ws in texts.values() for w in ws}))}
    if not known:
        return spark.createDataFrame([], SCHEMA)
    block = _Items({item: np.array([known[w] for w in ws], np.int32) for item, ws in texts.items() if ws}, len(known), least, gap)
    found = materialize(passages(docs, id_col, text_col, known, neighbours(list(block.coded.values()), len(known)), least, gap), "leak-passages")
    pieces = materialize(windows_of(found, WIDE if gap else NARROW), "leak-windows")
    counts = pieces.select(F.explode(F.array_distinct("words")).alias("word")).where("word >= 0").groupBy("word").agg(F.count("*").alias("n")).toArrow()
    df = np.ones(len(known))
    if counts.num_rows:
        df[counts.column("word").to_numpy()] += counts.column("n").to_numpy()
    for w in block.windows:
        df[np.unique(w)] += 1
    idf = np.log(1 + (pieces.count() + len(block.windows)) / df)
    block.place(idf, right_singular(pieces, block.windows, idf, min(rank, len(known))))
    shared = spark.sparkContext.broadcast(block)  # bounded by ITEM_CHARS

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        tellers: dict[int, list[int]] = {}
        for i, t in enumerate(block.telling.values()) if gap else ():
            for word in t.tolist():
                tellers.setdefault(word, []).append(i)
        sizes = [len(t) for t in block.telling.values()]
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            for doc, r in zip(batch.column("doc_id").to_pylist(), _rows(batch), strict=True):
                has = np.unique(r)
                top = block.closest(r)
                wanted = np.flatnonzero(top >= cosine)
                if gap:
                    told_of = Counter(i for word in has.tolist() for i in tellers.get(word, ()))
                    wanted = np.union1d(wanted, [i for i, n in told_of.items() if n >= told * sizes[i]]).astype(np.int64)
                else:
                    wanted = block.sharing(r, wanted)
                for i in wanted.tolist():
                    item = int(block.names[i])
                    w, t = block.coded[item], block.telling[item]
                    places = common(r, w)
                    run = longest_run(r, w, places)
                    if gap or run >= least:
                        share = float(np.isin(t, has).mean()) if len(t) else 0.0
                        out.append((doc, item, float(top[i]), run, longest_subsequence(r, w, places), share))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "similarity", "run", "lcs", "answer"])

    hits = spread(found).mapInArrow(check, SCHEMA)
    return hits.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("similarity", "run", "lcs", "answer")))
