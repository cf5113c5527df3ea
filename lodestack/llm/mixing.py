"""Mixing sources to target shares of tokens, by entropy balancing.

Each text gets a rate, the expected number of copies. Among all rates with the wanted tokens per source and at most
max_repeats, the balanced ones are nearest to "every text once" in relative entropy: rate = min(max_repeats,
exp(lambda * length)), with one multiplier per source and the length in units of the source's mean. The multipliers
solve the convex dual by Newton's method: every iteration is one distributed aggregation to two sums per source
(the tokens at these rates and their derivative), and the driver keeps a bracket, so that steps that leave it are halved into it.
Rates are then rounded to whole copies by a hash of the text, and a shift per source, found by three more
aggregations, makes the rounded tokens meet the target.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.session import Scratch, ship_package

#: A file of the public tokenizers, by its name there; or any path.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: More sources than this are refused: their targets are collected to the driver.
MOST_SOURCES = 10_000
GRID = 16


def source_name(source: Column) -> Column:
    """One spelling per source: trimmed, lower case, spaces and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def _encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """rows (doc_id, source, text) as (doc_id, source, text_key, tokens), the text replaced by its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64())],
                ["doc_id", "source", "text_key", "tokens"],
            )

    keyed = rows.select("doc_id", "source", F.unhex(F.md5("text")).alias("text_key"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {id_type}, source string, text_key binary, tokens bigint")


def _by_source(values: dict[str, float]) -> Column:
    """The value of a row's source, from a literal map (one entry per source)."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("source"))


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY,
    iterations: int = 60, tolerance: float = 1e-6,
) -> tuple[DataFrame, DataFrame]:
    """Copies (doc_id, source, tokens, copies) of docs (doc_id, text, source) so that each source of targets (source,
    target_share, max_repeats) has its share of all tokens, and the report (source, target_share, wanted_share, texts,
    available_tokens, used_tokens, actual_share, most_copies, balanced). balanced: the rates met the source's goal before rounding,
    within `tolerance` and `iterations`.

    total_tokens: the size wanted; null: the largest for which no source must repeat a text beyond its max_repeats.
    If a given total can't be reached by a source, it gives all it may, and the report shows the gap.

    Defined cases: sources are compared by source_name; sources without a target, and texts of null source, aren't
    used; targets without any text get share 0, and wanted_share spreads the rest over the others in proportion.
    Equal texts are one text: it belongs to the source of its smallest doc_id and is used at most max_repeats
    times in all. Null and empty texts have no tokens and aren't used; rows with null doc_id are ignored. Targets
    that repeat a source are added up, with the smallest max_repeats; null or negative shares count as 0.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "mix")
    wanted = targets.select(
        source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"),
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"),
    ).where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))
    rows = wanted.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
    share = {r["source"]: float(r["share"]) for r in rows}
    cap = {r["source"]: int(r["cap"]) for r in rows}
    known = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").where(
        F.col("doc_id").isNotNull() & F.col("source").isin(list(share)) & (F.length("text") > 0)
    )
    counted = count_tokens(known, vocabulary)
    texts = scratch.cut(
        counted.groupBy("text_key").agg(
            F.min(F.struct("doc_id", "source")).alias("first"), F.max("tokens").alias("tokens")
        ).select("first.doc_id", "first.source", "text_key", "tokens"), "texts",
    )
    stats = {
        r["source"]: r for r in texts.groupBy("source").agg(
            F.count("*").alias("texts"), F.sum("tokens").alias("tokens")
        ).collect()
    }
    live = {s: share[s] for s in share if s in stats and share[s] > 0 and cap[s] > 0}
    scale = sum(live.values())
    live = {s: v / scale for s, v in live.items()}
    most = {s: float(stats[s]["tokens"] * cap[s]) for s in live}
    total = float(total_tokens) if total_tokens is not None else min((most[s] / live[s] for s in live), default=0.0)
    goal = {s: min(live[s] * total, most[s]) for s in live}
    mean = {s: stats[s]["tokens"] / stats[s]["texts"] for s in live}
    used = texts.where(F.col("source").isin(list(live)))
    rate, met = _balance(used, goal, mean, {s: cap[s] for s in live}, most, iterations, tolerance) if live else (F.lit(0.0), set())
    copies = _rounded(used, rate, goal, mean, cap, live) if live else F.lit(0)
    chosen = used.select("doc_id", "source", "tokens", copies.cast("bigint").alias("copies")).where("copies > 0")
    taken = {
        r["source"]: r for r in chosen.groupBy("source").agg(
            F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most")
        ).collect()
    }
    everything = sum(r["used"] for r in taken.values()) or 1
    report = [
        (s, share[s], live.get(s, 0.0), int(stats[s]["texts"]) if s in stats else 0, int(stats[s]["tokens"]) if s in stats else 0,
         int(taken[s]["used"]) if s in taken else 0, taken[s]["used"] / everything if s in taken else 0.0,
         int(taken[s]["most"]) if s in taken else 0, s in met)
        for s in sorted(share)
    ]
    return chosen, spark.createDataFrame(report, (
        "source string, target_share double, wanted_share double, texts bigint, available_tokens bigint, "
        "used_tokens bigint, actual_share double, most_copies bigint, balanced boolean"
    ))


def _rate(multiplier: dict[str, float], mean: dict[str, float], cap: dict[str, int]) -> Column:
    """min(max_repeats, exp(lambda * length)); the exponent is cut where it can't matter."""
    exponent = _by_source({s: multiplier[s] / mean[s] for s in multiplier}) * F.col("tokens")
    limit = _by_source({s: float(c) for s, c in cap.items()})
    return F.least(F.exp(F.least(exponent, F.lit(50.0))), limit)


def _balance(texts: DataFrame, goal, mean, cap, most, iterations: int, tolerance: float) -> tuple[Column, set[str]]:
    """The rates that give each source its goal of tokens, by distributed Newton iterations on the dual, and the sources whose
    goal they meet."""
    at = {s: 0.0 for s in goal}
    low, high = {s: -60.0 for s in goal}, {s: 60.0 for s in goal}
    done: set[str] = set()
    full = {s for s in goal if goal[s] >= most[s] * (1 - 1e-9)}  # everything as often as allowed: no finite multiplier
    for s in full:
        at[s], _ = 1e6, done.add(s)
    for _ in range(iterations):
        if len(done) == len(goal):
            break
        rate = _rate(at, mean, cap)
        limit = _by_source({s: float(c) for s, c in cap.items()})
        length = F.col("tokens") / _by_source(mean)
        sums = texts.groupBy("source").agg(
            F.sum(rate * F.col("tokens")).alias("value"),
            F.sum(F.when(rate < limit, rate * F.col("tokens") * length).otherwise(0.0)).alias("slope"),
        ).collect()
        for s, value, slope in sums:
            if s in done:
                continue
            error = value - goal[s]
            if abs(error) <= tolerance * goal[s]:
                done.add(s)
                continue
            low[s], high[s] = (low[s], at[s]) if error > 0 else (at[s], high[s])
            step = at[s] - error / slope if slope > 0 else math.inf
            at[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return _rate(at, mean, cap), done


def _rounded(texts: DataFrame, rate: Column, goal, mean, cap, live) -> Column:
    """Whole copies: floor(rate + u + shift) with u uniform by a hash of the text, within 0 and max_repeats. The shift
    of a source is narrowed on a grid until the copies' tokens meet the goal as nearly as they can. Only texts up
    to the mean length are shifted: a long one that flips would miss the goal by its whole length."""
    uniform = (F.pmod(F.xxhash64("text_key"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    limit = _by_source({s: float(cap[s]) for s in live})

    def copies(shift: Column) -> Column:
        shift = F.when(F.col("tokens") <= _by_source(mean), shift).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.floor(rate + uniform + shift).cast("double"), limit))

    low, high = {s: -1.0 for s in live}, {s: 1.0 for s in live}
    best: dict[str, tuple[float, float]] = {s: (math.inf, 0.0) for s in live}
    for _ in range(4):
        points = {s: [low[s] + (high[s] - low[s]) * i / GRID for i in range(GRID + 1)] for s in live}
        sums = texts.groupBy("source").agg(*[
            F.sum(copies(_by_source({s: points[s][i] for s in live})) * F.col("tokens")).alias(f"g{i}") for i in range(GRID + 1)
        ]).collect()
        for row in sums:
            s, values = row[0], [row[i + 1] for i in range(GRID + 1)]
            for point, value in zip(points[s], values):
                best[s] = min(best[s], (abs(value - goal[s]), point))
            below = max((i for i, v in enumerate(values) if v <= goal[s]), default=0)
            low[s], high[s] = points[s][below], points[s][min(below + 1, GRID)]
    return copies(_by_source({s: best[s][1] for s in live}))
