"""Full-text search: phrases of whole tokens, and BM25 ranking over two fields.

InvertedIndex keeps postings in buckets of tokens, so a search reads those of its own tokens and no document. The functions
beside it answer the same without an index, from a scan."""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import scalars
from lodestack.session import Scratch, Versions, delete_folder

K1, B = 1.2, 0.75


def phrase_matches(docs: DataFrame, phrase: str) -> DataFrame:
    """Documents (path, content) that contain the phrase as consecutive whole tokens, without case or diacritics."""
    joined = F.concat(F.lit(" "), F.regexp_replace(scalars.fold(F.col("content")), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.trim(F.regexp_replace(scalars.fold(F.lit(phrase)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return docs.where(joined.contains(wanted)).select("path")


def postings(docs: DataFrame, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """(path, field, token, positions): the inverted index; positions count from 0."""
    parts = None
    for field in fields:
        rows = docs.select("path", F.lit(field).alias("field"), F.posexplode(scalars.search_tokens(F.col(field))).alias("position", "token"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("path", "field", "token").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def bm25(docs: DataFrame, query: str, fields: dict[str, Column], key: str, limit: int = 50) -> DataFrame:
    """(key, score) of the `limit` best documents. A term's weight in a field is
    ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)); a
    document's score sums over terms and fields. Ties go by key. Null fields are empty."""
    terms = sorted(set(_query_tokens(query)))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    counted = docs.select(key, *[
        column
        for i, value in enumerate(fields.values())
        for column in _counts(scalars.search_tokens(F.coalesce(value, F.lit(""))), i, terms)
    ])
    cells = [(i, j) for i in range(len(fields)) for j in range(len(terms))]
    # one row of numbers, which become literals of the second scan
    stats = counted.agg(
        F.count("*").alias("n"), *[F.avg(f"length{i}").alias(f"mean{i}") for i in range(len(fields))],
        *[F.count(F.when(F.col(f"tf{i}_{j}") > 0, 1)).alias(f"df{i}_{j}") for i, j in cells],
    ).first()
    if not stats["n"]:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    weights = []
    for i, j in cells:
        tf, df = F.col(f"tf{i}_{j}"), stats[f"df{i}_{j}"]
        idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        norm = tf + K1 * (1 - B + B * F.col(f"length{i}") / F.lit(stats[f"mean{i}"] or 1.0))
        weights.append(F.when(tf > 0, F.lit(idf) * tf * (K1 + 1) / norm).otherwise(0.0))
    found = counted.where(reduce(lambda a, b: a | b, [F.col(f"tf{i}_{j}") > 0 for i, j in cells]))
    scored = found.select(key, reduce(add, weights).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 6)), key).limit(limit)


def folded_tokens(text: Column) -> Column:
    """The whole tokens of a text without case or diacritics, in order."""
    return F.filter(F.split(scalars.fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fold_query(spark: SparkSession, phrase: str) -> list[str]:
    return spark.range(1).select(folded_tokens(F.lit(phrase))).first()[0]


class InvertedIndex:
    """Postings of documents (key, one column of tokens for each field), kept under one folder and added to by batches.

    A document that is put in again, or removed, leaves its old postings in place; its key and batch are noted as dead, and searches
    leave them out. Postings lie in buckets by token, documents in buckets by key. Numbers of documents and of tokens are kept
    with each batch in a manifest that is renamed into place, so readers see whole batches. After `compact_every` batches
    the live rows are written anew."""

    def __init__(self, spark: SparkSession, folder: str, fields: tuple[str, ...], buckets: int = 16, compact_every: int = 16):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every
        self.versions = Versions(spark, f"{self.folder}/manifest")
        self.version, text = self.versions.newest()
        self.state: dict = json.loads(text) if text else {
            "fields": list(fields), "buckets": buckets, "batches": 0, "documents": 0, "tokens": [0] * len(fields), "postings": [], "docs": [], "dead": [], "stale": [],
        }

    @property
    def fields(self) -> list[str]:
        return self.state["fields"]

    def _schema(self, kind: str) -> str:
        key = "key string, batch int"
        return {
            "postings": f"{key}, field string, token string, length int, positions array<int>, bucket int",
            "docs": f"{key}, " + ", ".join(f"n{i} int" for i in range(len(self.fields))) + ", bucket int", "dead": key,
        }[kind]

    def _read(self, kind: str) -> DataFrame:
        parts = [self.spark.read.schema(self._schema(kind)).parquet(p) for p in self.state[kind]]
        if not parts:
            return self.spark.createDataFrame([], self._schema(kind))
        return reduce(DataFrame.unionByName, parts)

    def _write(self, kind: str, rows: DataFrame) -> str:
        path = f"{self.folder}/data/{self.state['batches']:06d}-{kind}-{uuid.uuid4().hex[:8]}"
        columns = [c.strip().split(" ")[0] for c in self._schema(kind).split(", ")]
        rows = rows.select(*columns)
        (rows.repartition("bucket").write.partitionBy("bucket") if "bucket" in columns else rows.write).parquet(path)
        return path

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.state["buckets"])).cast("int").alias("bucket")

    def _totals(self, docs: DataFrame) -> list[int]:
        row = docs.agg(F.count("*"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(self.fields))]).first()
        return [int(x) for x in row]

    def _live_docs(self) -> DataFrame:
        return self._read("docs").join(self._read("dead"), ["key", "batch"], "left_anti")

    def _retire(self, keys: DataFrame, state: dict) -> None:
        """Note the live rows of keys as dead, and take them out of the totals."""
        if not state["docs"]:
            return
        gone = self._live_docs().join(keys.select("key", self._bucket("key")).distinct(), ["bucket", "key"], "left_semi")
        path = self._write("dead", gone)
        state["dead"] = [*state["dead"], path]
        count, *tokens = self._totals(self._read("docs").join(self.spark.read.schema(self._schema("dead")).parquet(path), ["key", "batch"], "left_semi"))
        state["documents"] -= count
        state["tokens"] = [a - b for a, b in zip(state["tokens"], tokens)]

    def _commit(self, state: dict) -> None:
        state["batches"] += 1
        self.versions.publish(self.version + 1, json.dumps(state))
        self.version, self.state = self.version + 1, state
        if state["batches"] % self.compact_every == 0 and len(state["docs"]) > 1:
            self.compact()

    def upsert(self, docs: DataFrame) -> None:
        """Put documents in, in place of those with the same key. Null keys are ignored; null fields are empty; of repeated keys in
        one batch one row is taken."""
        state, scratch = dict(self.state), Scratch(self.spark, "index")
        empty = F.array().cast("array<string>")
        rows = docs.where(F.col("key").isNotNull()).select("key", *[F.coalesce(f, empty).alias(f) for f in self.fields]).dropDuplicates(["key"])
        fresh = scratch.cut(rows.withColumn("batch", F.lit(state["batches"]).cast("int")), "docs")
        self._retire(fresh, state)
        lengths = fresh.select("key", "batch", *[F.size(f).alias(f"n{i}") for i, f in enumerate(self.fields)], self._bucket("key"))
        count, *tokens = self._totals(lengths)
        listed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(f).alias("length"), F.col(f).alias("tokens")) for f in self.fields]))
        places = fresh.select("key", "batch", listed.alias("f")).select("key", "batch", "f.field", "f.length", F.posexplode("f.tokens").alias("position", "token"))
        postings = places.groupBy("key", "batch", "field", "length", "token").agg(F.sort_array(F.collect_list("position")).alias("positions"))
        state["postings"] = [*state["postings"], self._write("postings", postings.withColumn("bucket", self._bucket("token")))]
        state["docs"] = [*state["docs"], self._write("docs", lengths)]
        state["documents"] += count
        state["tokens"] = [a + b for a, b in zip(state["tokens"], tokens)]
        self._commit(state)
        scratch.delete()

    def delete(self, keys: DataFrame) -> None:
        state = dict(self.state)
        self._retire(keys.where(F.col("key").isNotNull()), state)
        self._commit(state)

    def compact(self) -> None:
        """Write the live rows anew; the files that no reader of this or the version before needs are deleted."""
        state = dict(self.state)
        before = [*state["postings"], *state["docs"], *state["dead"]]
        live = self._read("postings").join(self._read("dead"), ["key", "batch"], "left_anti")
        state["postings"], state["docs"], state["dead"] = [self._write("postings", live)], [self._write("docs", self._live_docs())], []
        stale, state["stale"] = state["stale"], before
        self.versions.publish(self.version + 1, json.dumps(state))
        self.version, self.state = self.version + 1, state
        for path in stale:
            delete_folder(self.spark, path)

    def lookup(self, tokens: list[str], fields: tuple[str, ...]) -> DataFrame:
        """The live postings of some tokens; only their buckets are read."""
        words = self.spark.createDataFrame([(t,) for t in tokens], "token string")
        buckets = [r[0] for r in words.select(self._bucket("token")).distinct().collect()]
        found = self._read("postings").where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens) & F.col("field").isin(list(fields)))
        return found.join(self._read("dead"), ["key", "batch"], "left_anti").drop("bucket", "batch")

    def phrase(self, field: str, tokens: list[str]) -> DataFrame:
        """Keys of documents with the tokens one after another in a field; none for an empty phrase."""
        wanted = sorted(set(tokens))
        if not wanted:
            return self._read("docs").select("key").where(F.lit(False))
        found = self.lookup(wanted, (field,)).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"))
        # from the places of the rarest token on
        offsets = {t: [i for i, x in enumerate(tokens) if x == t] for t in wanted}

        def follows(p: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.array_contains(F.col(f"at{wanted.index(t)}"), p + F.lit(i)) for t in wanted for i in offsets[t]])

        places = found.select("key", *[F.coalesce(F.col("at").getItem(t), F.array().cast("array<int>")).alias(f"at{k}") for k, t in enumerate(wanted)])
        return places.where(F.exists(F.col(f"at{wanted.index(tokens[0])}"), follows)).select("key")

    def bm25(self, query: str, fields: tuple[str, ...], limit: int = 50) -> DataFrame:
        """(key, score) of the `limit` best documents, as in the function of that name."""
        terms = sorted(set(_query_tokens(query)))
        if not terms or not self.state["documents"]:
            return self._read("docs").select("key", F.lit(0.0).alias("score")).where(F.lit(False))
        found = self.lookup(terms, fields)
        known = {(r["field"], r["token"]): r["count"] for r in found.groupBy("field", "token").count().collect()}  # terms times fields
        n, score = self.state["documents"], F.lit(0.0)
        for (field, token), df in known.items():
            mean = self.state["tokens"][self.fields.index(field)] / n or 1.0
            tf = F.size("positions")
            weight = F.lit(math.log(1 + (n - df + 0.5) / (df + 0.5))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
            score = F.when((F.col("field") == field) & (F.col("token") == token), weight).otherwise(score)
        scored = found.withColumn("part", score).groupBy("key").agg(F.sum("part").alias("score"))
        return scored.orderBy(F.desc(F.round("score", 6)), "key").limit(limit)


def _counts(tokens: Column, field: int, terms: list[str]) -> list[Column]:
    def occurrences(term: str) -> Column:
        return F.size(F.filter(tokens, lambda t: t == F.lit(term)))

    return [F.size(tokens).alias(f"length{field}")] + [occurrences(t).alias(f"tf{field}_{j}") for j, t in enumerate(terms)]


def _query_tokens(query: str) -> list[str]:
    current, out = "", []
    for char in query.lower() + " ":
        if char.isalnum():
            current += char
        elif current:
            out.append(current)
            current = ""
    return [t for t in out if len(t.encode()) < 40]
