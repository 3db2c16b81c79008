"""Ranked lexical search of all documents for a set of items, as a blocked sparse matrix product.

The items are a sparse matrix A of term multiplicities, the documents a sparse matrix B of term impacts; the scores are A B in 64-bit integers.
B is cut into blocks of documents, one an Arrow batch, and written by term, for the terms that an item holds: that pass also counts
what the impacts need - documents, words, and documents a term. With these counts each task multiplies its blocks: a row of the result is merged from
the block's rows of the item's terms (Gustavson), and only the best k of it stay beside those of the task's earlier blocks. A last
reduction over buckets of documents, then over all, leaves k an item.

Items travel in groups of at most GROUP_TERMS distinct terms, a counted bound, or one item; each group goes through the same two passes, so neither a task
nor the driver holds more than one group, and no document is left out. What comes to the driver is one group's terms with their counts.

A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))) and its impact on a document weight * ((10^9 tf) div (1000 tf + 8 m)) with m =
100 - B_LENGTH + (B_LENGTH n N) div L; N are the documents with a term, L all terms with repeats, n those of the document.

Defined cases: null and empty texts have no terms, so they count for nothing and are never found; rows with equal item_id are one item; a null
item_id or doc_id is an id, the last in order. Repeated documents are ranked each, equal scores by doc_id. Fewer than k documents with a score above
0 give fewer rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spanveil.llm.decontaminate import words
from spanveil.llm.fm_index import ranges
from spanveil.llm.memory import give_back
from spanveil.session import keep, shared_path, ship, table

TOP = 10
B_LENGTH = 90
GROUP_TERMS = 250_000
#: Buckets of documents that the first step of the last reduction tells apart.
BUCKETS = 64
#: Signs between terms; A-Z have been lower-cased.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of every item."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select("item_id", F.explode(F.split(F.regexp_replace(low, NO_TERM, " "), " ")).alias("term"))
    return each.where("term <> ''").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def groups_of(terms: DataFrame, most: int) -> tuple[DataFrame, int]:
    """terms with the group of their item, and the number of groups; a group has at most `most` terms or is one large item and few others."""
    total = terms.count()
    if total <= most:
        return terms.withColumn("group", F.lit(0)), 1
    groups = 2 * -(-total // most)
    largest = terms.groupBy("item_id").count().agg(F.max("count")).first()[0]
    while True:
        placed = terms.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int"))
        if placed.groupBy("group").count().agg(F.max("count")).first()[0] <= max(most, 2 * largest):
            return placed, groups
        groups *= 2


class Items:
    """The matrix A of a group: item numbers by row, terms by column."""

    def __init__(self, rows: list[tuple], multiplicity: bool):
        # Ids are told by a struct's order in Spark; here any fixed order will do.
        self.ids = list(dict.fromkeys(r[0] for r in rows))
        self.vocabulary: dict[bytes, int] = {}
        number = {x: k for k, x in enumerate(self.ids)}
        own: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        for item, term, times in rows:
            col = self.vocabulary.setdefault(term.encode("utf-8", "surrogatepass"), len(self.vocabulary))
            own[number[item]].append((col, times if multiplicity else 1))
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        self.cols = np.array([c for x in own for c, _ in x], np.int64)
        self.times = np.array([m for x in own for _, m in x], np.int64)


def block_schema(id_type: T.DataType) -> T.StructType:
    binary = lambda c: T.StructField(c, T.BinaryType())
    return T.StructType([
        T.StructField("documents", T.LongType()), T.StructField("words", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
        binary("n"), binary("terms"), binary("starts"), binary("docs"), binary("tf"),
    ])


def matrix_block(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words a text; the texts that hold a known term; and their matrix by term: terms, where each one's entries start (and end), texts as numbers among those
    that hold one, occurrences."""
    get, d = vocabulary.get, len(texts)
    n, keys = np.zeros(d, np.int64), [np.zeros(0, np.int64)]
    for k, t in enumerate(texts):
        ws = words(t)
        n[k] = len(ws)
        at = np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
        keys.append(at[at >= 0] * d + k)
    key, tf = np.unique(np.concatenate(keys), return_counts=True)
    term, doc = key // max(d, 1), key % max(d, 1)
    some, doc = np.unique(doc, return_inverse=True)
    terms, starts = np.unique(term, return_index=True)
    return n, some, terms, np.append(starts, len(term)), doc, tf


def indexer(items, id_type: T.DataType):
    """Arrow function (doc_id, text) -> blocks of the matrix B, one a batch."""
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in block_schema(id_type)])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = items.value.vocabulary
        for batch in batches:
            n, some, terms, starts, doc, tf = matrix_block(batch.column(1).to_pylist(), vocabulary)
            ids = batch.column(0).take(pa.array(some))
            raw = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
            yield pa.record_batch(
                [pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([ids.to_pylist()], schema.field("ids").type),
                 raw(n[some], "<i8"), raw(terms, "<i4"), raw(starts, "<i8"), raw(doc, "<i4"), raw(tf, "<i4")], schema=schema,
            )
            give_back()

    return index


def tally(size: int):
    """Arrow function blocks (terms, starts) -> (term, df) of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                df[np.frombuffer(terms.as_py(), "<i4")] += np.diff(np.frombuffer(starts.as_py(), "<i8"))
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    return count


def product_rows(items: Items, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, its scores over the block's documents) of the items that meet the block; the array is used again for the next one."""
    at = np.full(len(items.vocabulary), -1, np.int64)
    at[terms] = np.arange(len(terms))
    sizes = np.diff(starts)
    scores = np.zeros(n_docs, np.int64)
    for k in range(len(items.ids)):
        span = slice(items.start[k], items.start[k + 1])
        rows, times = at[items.cols[span]], items.times[span]
        there = rows >= 0
        rows, times = rows[there], times[there]
        if len(rows):
            entries = ranges(starts[rows], sizes[rows])
            scores[:] = 0
            np.add.at(scores, docs[entries], impacts[entries] * np.repeat(times, sizes[rows]))
            yield k, scores


def ranker(items, weights: np.ndarray, documents: int, total: int, k: int, id_type: T.DataType, item_type: T.DataType):
    """Arrow function blocks -> (item_id, doc_id, score): the best k of a task's blocks for each item."""
    fields = [("item_id", to_arrow_type(item_type)), ("doc_id", to_arrow_type(id_type)), ("score", pa.int64())]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, best = items.value, {}
        for batch in batches:
            for row in range(batch.num_rows):
                n, terms, starts, docs, tf = (np.frombuffer(batch.column(c)[row].as_py(), t).astype(np.int64) for c, t in ((1, "<i8"), (2, "<i4"), (3, "<i8"), (4, "<i4"), (5, "<i4")))
                ids = batch.column(0)[row].values
                m = 100 - B_LENGTH + (B_LENGTH * n * documents) // total
                impacts = np.repeat(weights[terms], np.diff(starts)) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
                for item, scores in product_rows(a, terms, starts, docs, impacts, len(n)):
                    own = best.setdefault(item, [])
                    least = max(1, -own[-1][0]) if len(own) == k else 1
                    some = np.flatnonzero(scores >= least)
                    if len(some) > k:
                        some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
                    if len(some):
                        fresh = [(-s, x is None, x) for s, x in zip(scores[some].tolist(), ids.take(pa.array(some)).to_pylist())]
                        best[item] = sorted(own + fresh, key=_order)[:k]
            give_back()
        rows = [(a.ids[i], x, -s) for i, own in best.items() for s, _, x in own]
        yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, (_, t) in enumerate(fields)], names=[f for f, _ in fields])

    return rank


def _order(x: tuple) -> tuple:
    return x[:2] if x[1] else x


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item, with their rank."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    near = found.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "bucket").orderBy(*order))).where(F.col("rank") <= k)
    return near.drop("bucket").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, multiplicity: bool = False, group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the best k rows of docs (doc_id, text) for each of items (item_id, text).

    With `multiplicity` a term counts as often as the item holds it, else once.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    id_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    terms, groups = groups_of(keep(item_terms(items.select("item_id", "text")), "item_terms"), group_terms)
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    path = shared_path(spark, "found") if groups > 1 else ""

    def one(group: int) -> DataFrame:
        own = Items([tuple(r) for r in terms.where(F.col("group") == group).select("item_id", "term", "times").toLocalIterator()], multiplicity)
        sent, size = sc.broadcast(own), len(own.vocabulary)
        blocks = keep(docs.select("doc_id", "text").mapInArrow(indexer(sent, id_type), block_schema(id_type)), "matrix")
        documents, total = blocks.agg(F.sum("documents"), F.sum("words")).first()
        counts = blocks.select("terms", "starts").mapInArrow(tally(size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
        df = np.zeros(size, np.int64)
        df[counts["term"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
        weights = np.floor(1000 * np.log((2 * (documents or 0) + 2) / (2 * df + 1))).astype(np.int64)
        rank = ranker(sent, weights, documents or 0, total or 1, k, id_type, item_type)
        return blocks.select("ids", "n", "terms", "starts", "docs", "tf").mapInArrow(rank, schema)

    if groups == 1:
        found = one(0)
    else:
        for g in range(groups):
            one(g).write.parquet(f"{path}/group={g}")
        found = spark.read.schema(schema).parquet(*[f"{path}/group={g}" for g in range(groups)])
    return _best(found, k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, n_docs),
b AS (SELECT t.rid, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * ({100 - B_LENGTH} + ({B_LENGTH} * CAST(len(w) AS BIGINT) * n_docs) // total))) AS impact
      FROM t JOIN f USING (term) JOIN d ON d.rid = t.rid, s),
p AS (SELECT item_id, rid, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN b USING (term) GROUP BY item_id, rid HAVING sum(impact) > 0),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM p JOIN d USING (rid))
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}"""
