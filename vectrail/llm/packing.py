"""Problem 6: filling containers of a fixed capacity (harmonic packing).

An item of size s in (capacity/(j+1), capacity/j] is of class j; a bin of class j takes exactly j of them. Items of more
than the capacity are cut into full bins and a rest that is packed like any item. Bins whose items leave room for items of a
smaller class get some of those before the rest of that class is packed (`top_up`), matched by rank. Ranks are counted per
class and bucket and shifted by the counts of the buckets before, so no task sees a whole class; a class may hold any share
of the items.

Null or non-positive sizes need no container and give no rows; repeated ids are items of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.session import materialize, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are split before the merges of a byte-level vocabulary (the pattern published with GPT-2).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS_PER_BUCKET = 50_000


def token_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(item_id, size): tokens of each whole text under a byte-level BPE vocabulary; null and empty texts have none. The
    vocabulary is a file of ranks (base64 token, rank) that the driver reads and broadcasts, some megabytes. Narrow."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], ["item_id", "size"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, "item_id bigint, size bigint")


def ranked(items: DataFrame, key: str, rank: str, buckets: int) -> DataFrame:
    """Number the rows of each key from 0, in parallel: local numbers in hash buckets plus the counts of earlier buckets.
    The counts are at most keys x buckets rows."""
    placed = items.withColumn("_bucket", F.pmod(F.xxhash64("item_id", "part"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = Window.partitionBy(key, "_bucket").orderBy("item_id", "part", "size")
    numbered = placed.withColumn("_local", F.row_number().over(local) - 1)
    return numbered.join(shift, [key, "_bucket"]).withColumn(rank, F.col("_local") + F.col("_shift")).drop("_bucket", "_local", "_shift")


def size_class(size: str, capacity: int):
    """How many items of this size a bin is given: capacity // size, above 16 rounded down to 16 steps an octave, so that
    there are few classes and a bin is filled to 16/17 x j/(j+1) at least."""
    j = F.floor(F.lit(capacity) / F.col(size))
    step = F.pow(F.lit(2), F.greatest(F.lit(0), F.floor(F.log2(j)) - 4)).cast("long")
    return (F.floor(j / step) * step).cast("int")


def harmonic_pack(sizes: DataFrame, capacity: int, top_up: int = 3, passes: int = 2) -> DataFrame:
    """(item_id, part, size, bin_id, kind) of (item_id, size) rows. kind: `cut` for full bins of an item above the capacity,
    `class` for bins of one class, `top` for an item placed in the room that a bin of class 1..top_up leaves; a bin is given
    one such item in each of the passes at most.
    Every row with a positive size comes out once, or once per part if it exceeds the capacity."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = sizes.sparkSession
    parts = (
        sizes.where(F.col("size") > 0)
        .select("item_id", F.col("size").alias("_whole"), F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int"))).alias("part"))
        .select("item_id", "part", F.least(F.lit(capacity).cast("long"), F.col("_whole") - F.col("part") * capacity).alias("size"), (F.col("_whole") > capacity).alias("_cut"))
    )
    parts = materialize(parts.withColumn("class", size_class("size", capacity)), "pack-parts")
    full = parts.where(F.col("_cut") & (F.col("size") == capacity))
    rest = parts.where(~(F.col("_cut") & (F.col("size") == capacity))).drop("_cut")
    buckets = max(1, parts.count() // ROWS_PER_BUCKET + 1)
    grid = sorted({int(r[0]) for r in rest.select("class").distinct().collect()})  # at most 16 an octave of the capacity
    done = [full.select("item_id", "part", "size", F.concat(F.lit("cut-"), "item_id", F.lit("-"), "part").alias("bin_id"), F.lit("cut").alias("kind"))]
    for j in [c for c in grid if c <= top_up]:
        own = ranked(rest.where(F.col("class") == j), "class", "_rank", buckets).withColumn("bin_id", F.concat_ws("-", F.lit("h"), "class", F.floor(F.col("_rank") / j).cast("string")))
        own = materialize(own.select("item_id", "part", "size", "bin_id"), "pack-own")
        smaller = [c for c in grid if c > j]
        done.append(own.select("item_id", "part", "size", "bin_id", F.lit("class").alias("kind")))
        if not smaller:
            rest = rest.limit(0)
            break
        room = own.groupBy("bin_id").agg((F.lit(capacity) - F.sum("size")).alias("_room")).where("_room > 0")
        fitting = F.coalesce(*(F.when(F.lit(capacity) / c <= F.col("_room"), F.lit(c)) for c in smaller))
        rest = rest.where(F.col("class") > j)
        for _ in range(passes):
            room = materialize(room, "pack-room")
            open_bins = room.select(F.xxhash64("bin_id").alias("item_id"), F.lit(0).alias("part"), F.col("_room").alias("size"), "bin_id", fitting.alias("class")).where("class is not null")
            slots = ranked(open_bins, "class", "_rank", buckets).select("class", "_rank", "bin_id")
            matched = ranked(rest, "class", "_rank", buckets).join(slots, ["class", "_rank"], "left").drop("_rank")
            matched = materialize(matched, "pack-matched")
            placed = matched.where("bin_id is not null")
            done.append(placed.select("item_id", "part", "size", "bin_id", F.lit("top").alias("kind")))
            rest = matched.where("bin_id is null").drop("bin_id")
            taken = placed.groupBy("bin_id").agg(F.sum("size").alias("_taken"))
            room = room.join(taken, "bin_id", "left").select("bin_id", (F.col("_room") - F.coalesce("_taken", F.lit(0))).alias("_room")).where("_room > 0")
    own = ranked(rest.where(F.col("class") > top_up), "class", "_rank", buckets).withColumn("bin_id", F.concat_ws("-", F.lit("h"), "class", F.floor(F.col("_rank") / F.col("class")).cast("string")))
    out = own.select("item_id", "part", "size", "bin_id", F.lit("class").alias("kind"))
    for d in done:  # written tables, but for the last
        out = out.unionByName(d)
    return out if grid else spark.createDataFrame([], out.schema)


def packed_texts(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, top_up: int = 3) -> DataFrame:
    """harmonic_pack over the token sizes of texts; the sizes are written once, as counting tokens is the costly part."""
    return harmonic_pack(materialize(token_sizes(docs, id_col, text_col, vocabulary, pattern), "token-sizes"), capacity, top_up)
