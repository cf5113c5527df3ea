"""Near-duplicate texts by MinHash, with Bayesian pruning of candidates and exact verification.

1. Texts with the same set of five-word shingles form one class; everything after works on classes, so copies of
   one text cost one row however many there are.
2. Candidates agree in at least one band of MinHash values (48 bands of 4: a pair of similarity 0.6 is
   missed with probability 0.0013, one of 0.65 with 0.00008).
3. Candidates are compared on 2-bit MinHash values, 64 at a time, while they are joined: with a uniform prior of the
   similarity, a pair is dropped as soon as the posterior probability of reaching the threshold is below the tolerance. The bits are
   packed into longs, so this is a handful of bit operations inside generated code.
4. The rest is verified exactly on the shingle sets.

Buckets of any size are complete: a bucket with more than `block` classes is joined in blocks of `block` rows
against all, spread over tasks by a salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.words import flat_lists, mix, shingles, windows, word_hashes
from lodestack.session import Scratch, ship_package

WIDTH = 5
BANDS, ROWS = 48, 4
HASHES = BANDS * ROWS
STAGES = HASHES // 64
PLANES = [f"p{i}" for i in range(2 * STAGES)]
#: Tokens hashed at once in a Python worker.
CHUNK = 1 << 18


def signatures(values: np.ndarray, offsets: np.ndarray, seed: int = 1) -> np.ndarray:
    """MinHash values (lists x HASHES, 32 bits) of lists of 64-bit shingles; lists mustn't be empty."""
    factors = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)
    out = np.empty((len(offsets) - 1, HASHES), dtype=np.uint32)
    for i, factor in enumerate(factors):
        hashed = ((values * factor) >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(hashed, offsets[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (lists x BANDS); the band is part of the key."""
    keys = np.repeat(mix(np.arange(BANDS, dtype=np.uint64))[None, :], len(signature), axis=0)
    by_band = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + by_band[:, :, i])
    return keys.view(np.int64)


def bit_planes(signature: np.ndarray) -> np.ndarray:
    """Two bits of each MinHash value, packed: columns (low, high) of each 64 values."""
    mixed = mix(signature.astype(np.uint64))
    out = np.empty((len(signature), 2 * STAGES), dtype=np.uint64)
    for stage in range(STAGES):
        part = mixed[:, stage * 64:(stage + 1) * 64]
        for bit in range(2):
            bits = ((part >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
            out[:, 2 * stage + bit] = np.packbits(bits, axis=1).view(np.uint64).ravel()
    return out.view(np.int64)


def most_mismatches(threshold: float, tolerance: float) -> list[int]:
    """For 64, 128, ... compared values: the most mismatches with which the posterior probability of a similarity of
    at least `threshold` isn't below `tolerance`, under a uniform prior. Two values of 2 bits agree with
    probability s + (1 - s) / 4 at similarity s."""
    s = np.linspace(0, 1, 2001)
    agree = s + (1 - s) / 4
    limits = []
    for stage in range(1, STAGES + 1):
        n = 64 * stage
        limit = 0
        for bad in range(n + 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                log = (n - bad) * np.log(agree) + (bad * np.log(1 - agree) if bad else 0)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                limit = bad
        limits.append(limit)
    return limits


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = flat_lists(batch.column(1))
        low = 0
        while low < len(offsets) - 1:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
            yield from _feature_rows(batch.column(0).slice(low, high - low), values, offsets[low:high + 1])
            low = high


def _feature_rows(ids: pa.Array, values: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    values, offsets = values[offsets[0]:offsets[-1]], offsets - offsets[0]
    starts, owner = windows(values, offsets, WIDTH)
    if not len(starts):
        return
    hashed = shingles(values, starts, WIDTH)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    first = np.ones(len(hashed), bool)
    first[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    hashed, owner = hashed[first], owner[first]
    kept, counts = np.unique(owner, return_counts=True)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    signature = signatures(hashed, bounds)
    classes = [hashlib.blake2b(hashed[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds, bounds[1:])]
    planes = bit_planes(signature)
    yield pa.RecordBatch.from_arrays(
        [ids.take(pa.array(kept)), pa.array(classes, pa.binary()), pa.array(counts.astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(signature).ravel())),
         *[pa.array(np.ascontiguousarray(planes[:, i])) for i in range(2 * STAGES)],
         pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashed.view(np.int64)))],
        ["id", "class", "n", "bands", *PLANES, "shingles"],
    )


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5, block: int = 2000
) -> tuple[DataFrame, DataFrame]:
    """Classes and links of docs (id, text): members (id, class), one row per text of at least five words; links (class_a,
    class_b, similarity) of all pairs of classes, class_a < class_b, with a Jaccard similarity of their five-word
    shingles of at least `threshold`. Members of one class have similarity 1.

    Defined cases: null, empty and shorter texts are in no class; rows with null id are ignored; repeated ids stay
    repeated members; an empty table gives empty results.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "near")
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, class binary, n int, bands array<bigint>, {', '.join(f'{p} bigint' for p in PLANES)}, shingles array<bigint>"
    rows = docs.where(F.col("id").isNotNull()).select("id", word_hashes(F.col("text")).alias("h"))
    features = scratch.cut(rows.where(F.size("h") >= WIDTH).mapInArrow(_features, schema), "features")
    members = features.select("id", "class")
    classes = scratch.cut(
        features.select("class", "id", "n", "bands", *PLANES).groupBy("class").agg(
            F.min("id").alias("first_id"), *[F.any_value(c).alias(c) for c in ["n", "bands", *PLANES]]
        ), "classes",
    )
    postings = classes.select(F.explode("bands").alias("key"), "class")
    shared = postings.groupBy("key").count().where("count > 1")
    bucketed = postings.join(shared, "key").join(classes.select("class", "n", *PLANES), "class")
    bucketed = scratch.cut(
        bucketed.withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count"), "buckets"
    )
    left = bucketed.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    right = bucketed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bad, conditions = None, [F.col("l.class") < F.col("r.class")]
    # sizes alone bound the similarity
    conditions.append(F.least("l.n", "r.n") >= F.lit(threshold) * F.greatest("l.n", "r.n"))
    for stage, limit in enumerate(most_mismatches(threshold, tolerance)):
        differ = F.bit_count(
            F.col(f"l.p{2 * stage}").bitwiseXOR(F.col(f"r.p{2 * stage}"))
            .bitwiseOR(F.col(f"l.p{2 * stage + 1}").bitwiseXOR(F.col(f"r.p{2 * stage + 1}")))
        )
        bad = differ if bad is None else bad + differ
        conditions.append(bad <= limit)
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt"))
    for condition in conditions:
        on = on & condition
    pairs = scratch.cut(
        left.alias("l").join(right.alias("r"), on)
        .select(F.col("l.class").alias("class_a"), F.col("r.class").alias("class_b")).distinct(), "pairs",
    )
    scratch.drop(bucketed)
    needed = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    firsts = needed.join(classes, "class").select("class", F.col("first_id").alias("id"))
    sets = scratch.cut(
        features.select("id", "class", "n", "shingles").join(firsts, ["id", "class"], "left_semi")
        .dropDuplicates(["class"]).select("class", "n", "shingles"), "sets",
    )
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    links = pairs
    for side in ("a", "b"):
        links = links.join(sets.select(*[F.col(c).alias(f"{c}_{side}") for c in sets.columns]), f"class_{side}")
    links = links.withColumn("common", common).select(
        "class_a", "class_b",
        (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("similarity"),
        (F.col("common") >= F.lit(threshold) * (F.col("n_a") + F.col("n_b") - F.col("common")) - 1e-9).alias("enough"),
    ).where("enough").drop("enough")
    return members, scratch.cut(links, "links")


def expand_pairs(members: DataFrame, links: DataFrame, block: int = 2000) -> DataFrame:
    """All pairs (id_a, id_b, similarity), id_a < id_b, of members of one class or of two linked classes.

    The members of a class lie in blocks of about `block`, drawn by a hash of the id; each block is a join key of its own, so
    the pairs of a class with very many members are made by many tasks."""
    blocks = F.ceil(F.col("count") / block).cast("int")
    sizes = members.groupBy("class").count().select("class", "count", blocks.alias("blocks"))
    placed = members.join(sizes, "class").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    several = placed.where("count > 1")
    within = several.alias("a").join(several.withColumn("salt", every).alias("b"), ["class", "salt"]).where(F.col("a.id") < F.col("b.id")).select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.lit(1.0).alias("similarity")
    )
    between = links
    for side in ("a", "b"):
        spread = sizes.select(F.col("class").alias(f"class_{side}"), every.alias("salt"))
        member = placed.select(F.col("class").alias(f"class_{side}"), "salt", F.col("id").alias(f"{side}_id"))
        between = between.join(spread, f"class_{side}").join(member, [f"class_{side}", "salt"]).drop("salt")
    between = between.select(
        F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), "similarity"
    )
    return within.unionByName(between)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, group_id, links): the connected group of each member and the number of classes its class is
    linked to; group_id is the smallest class of the group.

    Every round takes the smallest label among a class and its neighbours and then the label of that label, so
    long chains shrink by a factor each round; labels are written after each round."""
    scratch = Scratch(members.sparkSession, "groups")
    both = scratch.cut(
        links.select("class_a", "class_b").union(links.select("class_b", "class_a")).toDF("class", "other"), "edges"
    )
    degree = both.groupBy("class").agg(F.count("*").alias("links"))
    labels = scratch.cut(degree.select("class", F.col("class").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        lowest = both.join(labels.select(F.col("class").alias("other"), "label"), "other").groupBy("class").agg(
            F.min("label").alias("lowest")
        )
        step = labels.drop("moved").join(lowest, "class").select(
            "class", F.col("label").alias("before"), F.least("label", "lowest").alias("label")
        )
        step = scratch.cut(step, "step")
        jump = step.select(F.col("class").alias("label"), F.col("label").alias("further"))
        after = scratch.cut(
            step.join(jump, "label").select("class", F.col("further").alias("label"), (F.col("further") != F.col("before")).alias("moved")),
            "labels",
        )
        scratch.drop(labels, step)
        labels = after
    return (
        members.join(labels.drop("moved"), "class", "left").join(degree, "class", "left")
        .select("id", "class", F.coalesce("label", "class").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    )
