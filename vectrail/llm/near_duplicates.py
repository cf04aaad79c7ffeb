"""Problem 1: records that are edited, extended or rearranged versions of others.

Records become weighted feature sets: word shingles with their counts (or as plain sets), or the signed coordinates of a
normalised embedding. Records with equal features are one class, represented by the smallest id, so groups of copies of any
size cost one record. BagMinHash signatures of the representatives are cut into bands; representatives that share a band
are candidates and are verified exactly. Bands shared by very many different representatives are cut into blocks that are
compared pairwise on their own, so that no task sees the whole; nothing is dropped.

Null, empty and short texts have no shingles and are in no pair; unusable vectors likewise. An id with several
different texts is alike to whatever one of them is alike to. Pairs of records (`expanded`) come out in full for classes of up
to EXPAND copies; of larger ones, whose pairs would be quadratic in any share of the rows, each member is paired with the
representative, which stands for all in pairs with other classes. `class_rows` says for each record which class it is in, how
large that is, and how many classes it is alike to: with it, the pairs of any class follow exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm import bagminhash
from vectrail.llm.components import components
from vectrail.llm.records import tokens
from vectrail.session import materialize, spread, tasks_for

EXPAND = 2000  # copies of a class that are paired with each other
BLOCK = 2000  # representatives compared with each other by one task
CHUNK = 256  # records whose signatures are drawn at once
UNIT = 1 / 16  # the first cell of an embedding's weights
U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Word to 64-bit hash, computed once."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[str], k: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 40-bit hashes of k consecutive words, and how often each occurs."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, U), np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    with np.errstate(over="ignore"):
        key = h[:n].copy()
        for i in range(1, k):
            key = (key * _A ^ (key >> U(29))) + h[i : i + n] * _B
    return np.unique(bagminhash.mix(key) & U(0xFFFFFFFFFF), return_counts=True)


def _digest(feature: np.ndarray, count: np.ndarray) -> tuple[int, int]:
    """128 bits of a weighted set."""
    x = xxhash.xxh3_128_intdigest(feature.tobytes() + count.astype(np.int64).tobytes())
    return (x >> 64) - 2**63, (x & (2**64 - 1)) - 2**63


def pack(feature: np.ndarray, count: np.ndarray | None) -> tuple[bytes, bytes | None]:
    """Features as 5 bytes each and counts as 4."""
    return feature.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), None if count is None else count.astype("<u4").tobytes()


def unpack(feature: bytes) -> np.ndarray:
    wide = np.zeros((len(feature) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(feature, np.uint8).reshape(-1, 5)
    return wide.view("<u8")[:, 0]


def text_features(docs: DataFrame, id_col: str, text_col: str, k: int, least: int, counted: bool) -> DataFrame:
    """(rec_id, features, counts) of texts with at least `least` distinct shingles, packed; counts are null for plain sets.
    Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids, fs, cs = [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f, c = shingles(tokens(value.as_py()), k, hashes)
                if len(f) >= max(1, least):
                    packed = pack(f, c if counted else None)
                    ids.append(key)
                    fs.append(packed[0])
                    cs.append(packed[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fs, pa.binary()), pa.array(cs, pa.binary())], ["rec_id", "features", "counts"])
            if len(hashes) > 500_000:
                hashes.clear()

    picked = docs.select(F.col(id_col).cast("bigint"), text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return picked.mapInArrow(run, "rec_id bigint, features binary, counts binary")


def text_sketches(docs: DataFrame, id_col: str, text_col: str, k: int, least: int, counted: bool, n_bands: int, rows: int) -> DataFrame:
    """(rec_id, h1, h2, bands, coarse): the digest of the features, the bands of the signature, and a byte of each of its
    components. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids, digests, keys, low = [], [], [], []
            values = batch.column(1)
            names = batch.column(0).to_pylist()
            for start in range(0, len(names), CHUNK):
                fs, cs = [], []
                for i in range(start, min(start + CHUNK, len(names))):
                    f, c = shingles(tokens(values[i].as_py()), k, hashes)
                    if len(f) >= max(1, least):
                        c = c if counted else np.ones_like(c)
                        ids.append(names[i])
                        digests.append(_digest(f, c))
                        fs.append(f)
                        cs.append(c)
                if fs:
                    record = np.repeat(np.arange(len(fs)), [len(f) for f in fs])
                    s = bagminhash.signatures(record, np.concatenate(fs), np.concatenate(cs).astype(np.float64), len(fs), n_bands * rows)
                    keys.extend(bagminhash.bands(s, rows))
                    low.extend(x.tobytes() for x in s.astype(np.uint8))
            if len(hashes) > 500_000:
                hashes.clear()
            yield _sketch_batch(ids, digests, keys, (pa.array(low, pa.binary()),))

    picked = spread(docs.select(F.col(id_col).cast("bigint"), text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()))
    return picked.mapInArrow(run, "rec_id bigint, h1 bigint, h2 bigint, bands array<bigint>, coarse binary")


def _sketch_batch(ids, digests, keys, extra=()):
    columns = [pa.array(ids, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, *extra], ["rec_id", "h1", "h2", "bands", "coarse"][: 4 + len(extra)])


def rotation(size: int, kept: int) -> np.ndarray:
    """The first `kept` columns of a fixed random rotation."""
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(size, size)))
    return q[:, :kept].astype(np.float32)


STEP = 0.75 / 127  # of the coarse coordinates


def vector_sketches(vectors: DataFrame, n_bands: int, rows: int, kept: int = 40) -> DataFrame:
    """(rec_id, h1, h2, bands, coarse) of (rec_id, embedding) rows. Normalised vectors are rotated at random, so that sparse
    and peaked ones have coordinates like any other's and the overlap of the weights follows from the cosine alone; coarse:
    `kept` of the rotated coordinates in 8 bits each, from which a lower bound of the distance follows. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            turn = rotation(x.shape[1], x.shape[1]) if turn is None else turn
            digests = [_digest(row, np.empty(0)) for row in x + 0.0]
            x /= np.linalg.norm(x, axis=1)[:, None]
            x = x @ turn
            coarse = np.clip(np.rint(x[:, :kept] / STEP), -127, 127).astype(np.int8)
            keys = []
            for start in range(0, len(x), CHUNK):
                part = x[start : start + CHUNK]
                record, axis = np.nonzero(part)
                value = part[record, axis]
                feature = bagminhash.mix((2 * axis + (value > 0)).astype(U))
                s = bagminhash.signatures(record, feature, np.abs(value), len(part), n_bands * rows, UNIT)
                keys.extend(bagminhash.bands(s, rows))
            yield _sketch_batch(batch.column(0).to_pylist(), digests, keys, (pa.array([c.tobytes() for c in coarse], pa.binary()),))

    return vectors.select("rec_id", "embedding").mapInArrow(run, "rec_id bigint, h1 bigint, h2 bigint, bands array<bigint>, coarse binary")


def classes(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (rep, bands[, coarse]), one for each distinct weighted set, and (rec_id, rep, n) of all records in
    classes of two or more. Digests alone are grouped; the sketches stay where they are but for a join with the ids of the
    members that don't represent their class. Classes of 1000 records or more are at most a thousandth of the records and are
    broadcast when members look up theirs; each other class has fewer than 1000 rows."""
    kept = [c for c in ("bands", "coarse") if c in sketches.columns]
    who = sketches.select("rec_id", "h1", "h2")
    several = who.groupBy("h1", "h2").agg(F.min("rec_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    several = materialize(several, "nd-classes")
    big = several.where("n >= 1000")
    big_count = big.count()
    members = who.join(several.where("n < 1000"), ["h1", "h2"])
    if big_count:
        members = members.unionByName(who.join(F.broadcast(big) if big_count <= 100_000 else big, ["h1", "h2"]))
    members = materialize(members.select("rec_id", "h1", "h2", "rep", "n").distinct(), "nd-members")
    others = materialize(members.where("rec_id <> rep").select("rec_id", "h1", "h2"), "nd-others")
    return sketches.join(others, ["rec_id", "h1", "h2"], "left_anti").select(F.col("rec_id").alias("rep"), *kept), members.select("rec_id", "rep", "n")


def _pairs_in_runs(most: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of neighbours with equal keys in sorted rows; with `most`, only those whose coarse squared distance may be within
    it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = held.column("key").to_numpy()
            ends = np.flatnonzero(key != key[-1]) if len(key) else key
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from emit(held)

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, rep = rows.column("key").to_numpy(), rows.column("rep").to_numpy()
        x = None
        if most is not None:
            x = np.frombuffer(b"".join(rows.column("coarse").to_pylist()), np.int8).reshape(len(key), -1).astype(np.float32) * np.float32(STEP)
            bound = (most**0.5 + STEP * x.shape[1] ** 0.5) ** 2
        seen_a, seen_b, gap = [], [], 1
        at = np.flatnonzero(key[1:] == key[:-1])
        while len(at):
            a, b = at, at + gap
            if x is not None:
                near = np.concatenate([((x[a[i : i + 50_000]] - x[b[i : i + 50_000]]) ** 2).sum(1) for i in range(0, len(a), 50_000)]) <= bound
                a, b = a[near], b[near]
            seen_a.append(np.minimum(rep[a], rep[b]))
            seen_b.append(np.maximum(rep[a], rep[b]))
            gap += 1
            at = at[at + gap < len(key)]
            at = at[key[at] == key[at + gap]]
        if seen_a:
            pairs = np.unique(np.stack([np.concatenate(seen_a), np.concatenate(seen_b)], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id_a", "id_b"])

    return run


def candidates(reps: DataFrame, most: float | None = None) -> DataFrame:
    """Distinct (id_a, id_b) of representatives that share a band; `most` bounds the squared distance by the coarse
    coordinates where there are some."""
    spark = reps.sparkSession
    coarse = ["coarse"] if most is not None else []
    rows = reps.select("rep", *coarse, F.explode("bands").alias("key"))
    hot = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "nd-hot")
    parts = tasks_for(spark)
    if hot.limit(1).count():
        # n/BLOCK hot keys at most: joined, not broadcast by force
        sized = rows.join(hot, "key", "left")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        split = (
            sized.where("n is not null")
            .withColumn("_own", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("key", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")))
        )
        rows = sized.where("n is null").select("rep", *coarse, "key").unionByName(split.select("rep", *coarse, "key"))
    sorted_rows = rows.repartition(parts, "key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(_pairs_in_runs(most), "id_a bigint, id_b bigint").distinct()


def screened(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in a share of the components that a similarity of `least` falls short of by four
    standard deviations at most (3 in 100,000 fall short of that)."""
    side = lambda end: reps.select(F.col("rep").alias(f"id_{end}"), F.col("coarse").alias(end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a", "b"))
                enough = (x == y).mean(1) >= least - 4 * (least * (1 - least) / x.shape[1]) ** 0.5
                at = pa.array(np.flatnonzero(enough))
                yield pa.RecordBatch.from_arrays([batch.column("id_a").take(at), batch.column("id_b").take(at)], ["id_a", "id_b"])

    joined = pairs.join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", "a", "b")
    return joined.mapInArrow(run, "id_a bigint, id_b bigint").distinct()


def verified_texts(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, counted: bool, least: float) -> DataFrame:
    """(id_a, id_b, similarity) of the pairs whose weighted Jaccard similarity of shingles is at least `least`, exactly."""
    wanted = materialize(pairs.select(F.explode(F.array("id_a", "id_b")).alias(id_col)).distinct(), "nd-wanted")
    sets = materialize(text_features(docs.join(wanted, id_col, "left_semi"), id_col, text_col, k, 1, counted), "nd-sets")
    left = sets.select(F.col("rec_id").alias("id_a"), F.col("features").alias("fa"), F.col("counts").alias("ca"))
    right = sets.select(F.col("rec_id").alias("id_b"), F.col("features").alias("fb"), F.col("counts").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, score = [], []
            sides = [batch.column(c).to_pylist() for c in ("fa", "ca", "fb", "cb")]
            for i, (fa, ca, fb, cb) in enumerate(zip(*sides, strict=True)):
                x, y = unpack(fa), unpack(fb)
                _, ix, iy = np.intersect1d(x, y, True, True)
                if counted:
                    cx, cy = np.frombuffer(ca, "<u4").astype(np.int64), np.frombuffer(cb, "<u4").astype(np.int64)
                    both, total = int(np.minimum(cx[ix], cy[iy]).sum()), int(cx.sum() + cy.sum())
                else:
                    both, total = len(ix), len(x) + len(y)
                s = both / max(1, total - both)
                if s >= least:
                    keep.append(i)
                    score.append(s)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id_a").take(at), batch.column("id_b").take(at), pa.array(score, pa.float64())], ["id_a", "id_b", "similarity"])

    joined = pairs.join(left, "id_a").join(right, "id_b")
    return joined.select("id_a", "id_b", "fa", "ca", "fb", "cb").mapInArrow(run, "id_a bigint, id_b bigint, similarity double")


def verified_vectors(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b, similarity) of the pairs with a cosine of at least `least`, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) for c in ("x", "y"))
            s = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            at = pa.array(np.flatnonzero(s >= least))
            yield pa.RecordBatch.from_arrays([batch.column("id_a").take(at), batch.column("id_b").take(at), pa.array(s).take(at)], ["id_a", "id_b", "similarity"])

    wanted = materialize(pairs.select(F.explode(F.array("id_a", "id_b")).alias("rec_id")).distinct(), "nd-wanted")
    vectors = vectors.join(wanted, "rec_id", "left_semi")
    left = vectors.select(F.col("rec_id").alias("id_a"), F.col("embedding").alias("x"))
    right = vectors.select(F.col("rec_id").alias("id_b"), F.col("embedding").alias("y"))
    return pairs.join(left, "id_a").join(right, "id_b").select("id_a", "id_b", "x", "y").mapInArrow(run, "id_a bigint, id_b bigint, similarity double")


def expanded(pairs: DataFrame, members: DataFrame, most: int = EXPAND) -> DataFrame:
    """(id_a, id_b) between records, from pairs of representatives and the members of their classes (see the module)."""
    few = members.where(F.col("n") <= most)
    stand = few.select("rep", F.col("rec_id").alias("member"))
    out = pairs.select("id_a", "id_b")
    for side in ("id_a", "id_b"):
        out = out.join(stand.withColumnRenamed("rep", side), side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    x, y = few.select("rep", F.col("rec_id").alias("id_a")), few.select("rep", F.col("rec_id").alias("id_b"))
    inside = x.join(y, "rep").where("id_a < id_b").select("id_a", "id_b")
    star = members.where((F.col("n") > most) & (F.col("rec_id") != F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("rec_id").alias("id_b"))
    out = out.select("id_a", "id_b").unionByName(inside).unionByName(star)
    return out.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a < id_b").distinct()


def class_rows(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(rec_id, class_id, class_size, links) of every record that has a copy or is alike to another: the smallest id of its
    class, the records in it, and the other classes it is alike to. One row per record and class: linear in the records."""
    links = pairs.select(F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    copies = members.select("rec_id", F.col("rep").alias("class_id"), F.col("n").alias("class_size"))
    reps = copies.where("rec_id = class_id").select("class_id")
    single = links.join(reps, "class_id", "left_anti").select(F.col("class_id").alias("rec_id"), "class_id", F.lit(1).cast("bigint").alias("class_size"), "links")
    sizes = links.join(reps, "class_id", "left_semi")
    return copies.join(sizes, "class_id", "left").select("rec_id", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links")).unionByName(single)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, least: int = 1, counted: bool = True, n_bands: int = 20, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """Verified pairs of representatives (id_a, id_b, similarity), and the members (rec_id, rep, n) of classes of equal texts.
    A pair at the similarity s shares a band with the probability 1 - (1 - s^rows)^n_bands: 0.9996 for the defaults."""
    sketches = materialize(text_sketches(docs, id_col, text_col, k, least, counted, n_bands, rows), "nd-sketches")
    reps, members = classes(sketches)
    pairs = materialize(screened(candidates(reps), reps, similarity), "nd-candidates")
    return verified_texts(pairs, docs, id_col, text_col, k, counted, similarity), members


def similar_vectors(vectors: DataFrame, cosine: float = 0.98, n_bands: int = 24, rows: int = 6) -> tuple[DataFrame, DataFrame]:
    """The same for (rec_id, embedding) rows with finite embeddings of one length that aren't all zero, one per rec_id.
    Unit vectors at the cosine c are at most sqrt(2 - 2c) apart, which bounds the candidates' coarse distance."""
    vectors = materialize(vectors, "nd-vectors")
    sketches = materialize(vector_sketches(spread(vectors), n_bands, rows), "nd-sketches")
    reps, members = classes(sketches)
    pairs = materialize(candidates(reps, 2 - 2 * cosine), "nd-candidates")
    return verified_vectors(pairs, vectors, cosine), members


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, group_id, links): one row for each record with an id, its group's smallest id and the number of other classes
    its own is linked to. Records alike to none, also those without shingles, form groups of their own."""
    pairs, members = similar_texts(docs, id_col, text_col, **how)
    pairs = materialize(pairs.select("id_a", "id_b"), "nd-links")
    links = pairs.select(F.explode(F.array("id_a", "id_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    labels = components(pairs).withColumnRenamed("id", "rep")
    of_rep = labels.join(links, "rep")
    everyone = docs.select(F.col(id_col).cast("bigint").alias("rec_id")).where("rec_id is not null").distinct()
    placed = everyone.join(members.select("rec_id", "rep"), "rec_id", "left").withColumn("rep", F.coalesce("rep", "rec_id")).join(of_rep, "rep", "left")
    of_row = placed.select("rec_id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return of_row.groupBy(F.col("rec_id").alias(id_col)).agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))
