"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a bounded run of rows inside a task. Its words are numbered, words that no test phrase holds become separators, and only
stretches long enough for a phrase are indexed. Phrases are searched backwards through the index's wavelet ranks, their
occurrences located by sampled suffix positions, and overlapping occurrences merged to removal spans.

The benchmark travels in blocks of at most BLOCK_WORDS words, a checked bound. A benchmark of one block is searched in the pass that reads the
texts, which never leave their rows: no shuffle. For a larger one each shard's index is built once, over a numbering of its own, and written
to the shared folder; one block after the other is then broadcast, searched in all indexes and dropped, so that a task and the
driver hold one block at a time and the plan does not grow with the benchmark. Only what was found is grouped, by row.

Defined cases: null or empty texts and items have no words. An item of fewer words than a window is one window. An item_id that
is null counts as the string "null"; rows with equal item_id are one item. Repeated documents each get a result, ties don't arise. A
column that has the result's name is replaced.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.llm.fm_index import FMIndex, ranges
from spanveil.llm.memory import give_back
from spanveil.session import keep, shared_path, ship, table

WINDOW = 13
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 4_000_000
#: Bytes of UTF-8 that belong to words; A-Z fall to lower case, all others to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN)),
])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS)])


def words(text: str | None) -> list[bytes]:
    """Words as lower-cased UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Phrases:
    """The windows of one block of items: vocabulary, distinct windows, and the items that have each."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[str, int] = {}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, ws in items:
            k = number.setdefault(item, len(number))
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in ws), np.int32, len(ws))  # 0 ends, 1 separates
            if 0 < len(ids) < window:
                rows.append(np.pad(ids, (0, window - len(ids)))[None, :])
            elif len(ids):
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            owners.append(np.full(max(1, len(ids) - window + 1) if len(ids) else 0, k, np.int64))
        # Rows of numbers throughout: a window is never an object of its own.
        self.items = list(number)
        self.phrases, at = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(at.reshape(-1) * max(1, len(number)) + np.concatenate(owners))
        self.owners = pairs % max(1, len(number))
        self.owner_start = np.searchsorted(pairs // max(1, len(number)), np.arange(len(self.phrases) + 1)).astype(np.int64)
        self.lengths = (self.phrases > 0).sum(1).astype(np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.size = len(self.vocabulary) + 2

    def only(self, which: np.ndarray) -> Phrases:
        """The same with some of the windows only; for their owners."""
        part = object.__new__(Phrases)
        sizes = np.diff(self.owner_start)[which]
        part.items, part.owners = self.items, self.owners[ranges(self.owner_start[which], sizes)]
        part.owner_start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        return part


class Shard:
    """The index of some texts. flat: their word numbers from 2 on, 1 for a separator, with one behind each text; sizes: words a text."""

    def __init__(self, flat: np.ndarray, sizes: list[int], numbers: int, shortest: int):
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        edges = np.diff(np.concatenate(([False], flat > 1, [False])).astype(np.int8))
        a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = b - a >= shortest
        self.stretch, lengths = a[long], b[long] - a[long] + 1  # each stretch and the separator behind it
        self.offset = np.cumsum(lengths) - lengths
        self.index = FMIndex(flat[ranges(self.stretch, lengths)], numbers) if len(lengths) else None

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (phrase, position in flat) of all occurrences."""
        none = np.zeros(0, np.int64)
        found, low, high = self.index.search(phrases, lengths) if self.index and len(phrases) else (none, none, none)
        if not len(found):
            return none, none
        at = self.index.locate(ranges(low, high - low))
        k = np.searchsorted(self.offset, at, "right") - 1
        return np.repeat(found, high - low), self.stretch[k] + at - self.offset[k]

    def hits(self, phrases: np.ndarray, lengths: np.ndarray, p: Phrases) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """(text, items with an occurring window, positions of hit words) of the texts with an occurrence; `phrases` are those of p."""
        which, at = self.find(phrases, lengths)
        if not len(which):
            return
        cover = np.zeros(int(self.starts[-1]) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + lengths[which], -1)
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        doc_of_hit = np.searchsorted(self.starts, hit, "right") - 1
        doc_of_at = np.searchsorted(self.starts, at, "right") - 1
        n_own = p.owner_start[which + 1] - p.owner_start[which]
        pairs = np.unique(np.repeat(doc_of_at, n_own) * len(p.items) + p.owners[ranges(p.owner_start[which], n_own)])
        items: dict[int, list[str]] = {}
        for d, i in zip((pairs // len(p.items)).tolist(), (pairs % len(p.items)).tolist()):
            items.setdefault(d, []).append(p.items[i])
        cut = np.flatnonzero(np.diff(doc_of_hit)) + 1
        for group in np.split(np.arange(len(hit)), cut):
            d = int(doc_of_hit[group[0]])
            yield d, items[d], hit[group] - self.starts[d]


def _numbered(texts: list[str | None], number) -> tuple[np.ndarray, list[int]]:
    """flat and sizes of a Shard; number(words) yields a number for each."""
    ids, sizes = [np.zeros(0, np.int64)], []
    for t in texts:
        ws = words(t)
        ids += [np.fromiter(number(ws), np.int64, len(ws)), np.ones(1, np.int64)]
        sizes.append(len(ws))
    return np.concatenate(ids), sizes


def search_shard(texts: list[str | None], p: Phrases) -> list[tuple[int, list[str], np.ndarray]]:
    """For each text: number of words, items with an occurring window, and which words are hit (as sorted positions)."""
    get = p.vocabulary.get
    flat, sizes = _numbered(texts, lambda ws: map(get, ws, repeat(1)))
    out = [(n, [], np.zeros(0, np.int64)) for n in sizes]
    for d, items, hit in Shard(flat, sizes, p.size, p.shortest).hits(p.phrases, p.lengths, p):
        out[d] = (sizes[d], items, hit)
    return out


def char_spans(text: str, positions: np.ndarray) -> list[dict[str, int]]:
    """Code point spans of runs of hit words."""
    hit = set(positions.tolist())
    spans, open_at = [], None
    for k, m in enumerate(_WORD.finditer(text)):
        if k in hit:
            spans.append({"start": m.start(), "end": m.end()}) if open_at is None else spans[-1].update(end=m.end())
            open_at = k
        else:
            open_at = None
    return spans


def _result(text: str | None, n: int, items: list[str], hit) -> dict:
    return {"n_words": n, "n_hit": len(hit), "items": items, "spans": char_spans(text, np.asarray(hit)) if len(hit) else []}


def searcher(phrases):
    """Arrow function text -> RESULT for one block of phrases; a batch is one shard, or several if it is larger."""

    @F.arrow_udf(RESULT)
    def search(texts: pa.Array) -> pa.Array:
        p, rows = phrases.value, []
        shard: list[str | None] = []
        size = 0

        def flush() -> None:
            rows.extend(_result(t, *r) for t, r in zip(shard, search_shard(shard, p)))
            shard.clear()

        for t in texts:
            s = t.as_py()
            shard.append(s)
            size += len(s) if s else 0
            if size >= SHARD_BYTES:
                flush()
                size = 0
        flush()
        out = pa.array(rows, type=_ARROW)
        del rows
        give_back()
        return out

    return search


def segmenter(window: int, most: int):
    """Arrow function text -> its words in pieces of at most `most`, which share window - 1 words, so that no window is lost."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def segments(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            ws = words(t.as_py())
            starts = range(0, max(1, len(ws) - window + 1), most - window + 1) if ws else ()
            out.append([b" ".join(ws[k : k + most]).decode("utf-8", "surrogatepass") for k in starts])
        return pa.array(out, type=pa.list_(pa.string()))

    return segments


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """(block, item, piece) of the benchmark's items, and the number of blocks; the words of a block are counted to be within the bound."""
    most = max(2 * window, block_words // 64)
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    pieces = benchmark.select(item.alias("item"), F.explode(segmenter(window, most)("text")).alias("piece")).distinct()
    sized = pieces.withColumn("n", F.size(F.split("piece", " ")))
    total = sized.agg(F.sum("n")).first()[0] or 0
    if total <= block_words:
        return pieces.select(F.lit(0).alias("block"), "item", "piece"), 1
    sized, blocks = keep(sized, "benchmark"), 2 * -(-total // block_words)
    while True:
        placed = sized.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)).cast("int"))
        if placed.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= max(block_words, 64 * most):
            return placed.select("block", "item", "piece"), blocks
        blocks *= 2


def phrases_of(pieces: DataFrame, window: int) -> Phrases:
    """The windows of one block, whose words the driver may hold: at most BLOCK_WORDS. They come one by one and leave as arrays."""
    return Phrases(((r["item"], r["piece"].encode("utf-8", "surrogatepass").split(b" ")) for r in pieces.select("item", "piece").toLocalIterator()), window)


def shard_builder(shortest: int):
    """Arrow function (row, text) -> shards: the rows in each, and its index with the words it numbers."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        texts: list[str | None] = []
        size = 0

        def shard() -> pa.RecordBatch:
            own: dict[bytes, int] = {}
            flat, sizes = _numbered(texts, lambda ws: (own.setdefault(w, len(own) + 2) for w in ws))
            made = pickle.dumps((Shard(flat, sizes, len(own) + 2, shortest), b" ".join(own)), protocol=5)
            out = pa.record_batch([pa.array([rows], pa.list_(pa.int64())), pa.array([made], pa.binary())], names=["rows", "shard"])
            rows.clear()
            texts.clear()
            give_back()
            return out

        for batch in batches:
            for r, t in zip(batch.column(0), batch.column(1)):
                s = t.as_py()
                rows.append(r.as_py())
                texts.append(s)
                size += len(s) if s else 0
                if size >= SHARD_BYTES:
                    yield shard()
                    size = 0
        if rows:
            yield shard()

    return build


def block_searcher(phrases):
    """Arrow function shards -> (row, items, hits) of the texts that hold a phrase of a block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        for batch in batches:
            for rows, made in zip(batch.column(0), batch.column(1)):
                shard, names = pickle.loads(made.as_py())
                number = {w: k + 2 for k, w in enumerate(names.split(b" "))} if names else {}
                own = np.zeros(p.size, np.int32)  # the shard's number of each of the block's words, 0 where it has none
                for w, k in p.vocabulary.items():
                    own[k] = number.get(w, 0)
                phrases_here = own[p.phrases]
                there = (phrases_here > 0).sum(1) == p.lengths
                which = np.flatnonzero(there)
                part = p.only(which)
                found = list(shard.hits(phrases_here[which], p.lengths[which], part))
                ids = rows.as_py()
                yield pa.record_batch(
                    [pa.array([ids[d] for d, _, _ in found], pa.int64()), pa.array([i for _, i, _ in found], pa.list_(pa.string())), pa.array([h.tolist() for _, _, h in found], pa.list_(pa.int32()))],
                    names=["__row", "items", "hits"],
                )
                del shard
                give_back()

    return search


@F.arrow_udf(RESULT)
def _united(texts: pa.Array, items: pa.Array, hits: pa.Array) -> pa.Array:
    """RESULT from what all blocks found in a text."""
    return pa.array([_result(t.as_py(), len(words(t.as_py())), i.as_py() or [], h.as_py() or []) for t, i, h in zip(texts, items, hits)], type=_ARROW)


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs has not."""
    while name in docs.columns:
        name = "_" + name
    return name


def annotate(docs: DataFrame, benchmark: DataFrame, name: str = "contamination", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with one more column RESULT: words, hit words, items and removal spans of each text."""
    spark = docs.sparkSession
    ship(spark)
    pieces, blocks = blocks_of(benchmark, window, block_words)
    sc = spark.sparkContext
    if blocks == 1:
        return docs.withColumn(name, searcher(sc.broadcast(phrases_of(pieces, window)))("text"))
    row, items, hits = (_free(c, docs) for c in ("row", "items", "hits"))
    own = keep(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    shortest = min(window, pieces.agg(F.min(F.size(F.split("piece", " ")))).first()[0])
    shards = keep(own.select(row, "text").mapInArrow(shard_builder(shortest), "rows array<long>, shard binary"), "shards")
    schema, path = "__row long, items array<string>, hits array<int>", shared_path(spark, "found")
    for k in range(blocks):
        block = sc.broadcast(phrases_of(pieces.where(F.col("block") == k), window))
        shards.mapInArrow(block_searcher(block), schema).write.parquet(f"{path}/block={k}")
        block.destroy()
    found = spark.read.schema(schema + ", block int").parquet(path)
    union = lambda c, to: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(to)
    merged = found.groupBy(F.col("__row").alias(row)).agg(union("items", items), union("hits", hits))
    joined = own.join(merged, row, "left").withColumn(name, _united("text", items, hits))
    return joined.select(*[c for c in docs.columns if c != name], name)


def contaminated(result: Column) -> Column:
    """At least one word in twenty is part of a test phrase."""
    return (result["n_hit"] > 0) & (result["n_hit"] * 20 >= result["n_words"])


@F.arrow_udf(T.StringType())
def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts with the removal spans cut out."""
    out = []
    for t, found in zip(texts, spans):
        s, found = t.as_py(), found.as_py()
        if s is not None and found:
            edges = [0, *(x[k] for x in found for k in ("start", "end")), len(s)]
            s = "".join(s[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append(s)
    return pa.array(out, type=pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; all others stay as they are.

    By the one-in-twenty rule a document with less overlap is clean, and clean text is not altered; who wants its passages gone as
    well cuts them out by `without_spans`.
    """
    name = _free("contamination", docs)
    return annotate(docs, benchmark, name).where(~contaminated(F.col(name))).drop(name)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Counts, items, the contamination flag and the spans to be removed (code points, end exclusive) of every document."""
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    r = F.col("contamination")
    return found.select(
        "doc_id", r["n_words"].alias("n_words"), r["n_hit"].alias("n_hit"), F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(r["items"]), ","), 256).alias("items_sha256"),
        contaminated(r).alias("contaminated"), F.array_join(F.transform(r["spans"], lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """n_words, n_hit, n_items, items_sha256, contaminated by comparing every position; for tests."""
    ws, hit, own = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for k in range(max(1, len(iw) - window + 1) if iw else 0):
            w = iw[k : k + window]
            for at in range(len(ws) - len(w) + 1):
                if ws[at : at + len(w)] == w:
                    own.add(item)
                    hit.update(range(at, at + len(w)))
    return len(ws), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g, least(len(w), {WINDOW}) AS n
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hp AS (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)),
pos AS (SELECT rid, count(*) AS n_hit FROM hp GROUP BY rid),
runs AS (SELECT rid, min(p) AS a, max(p) AS b FROM (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS g FROM hp) GROUP BY rid, g),
gaps AS (SELECT rid, w, string_split_regex(documents.text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS g FROM d JOIN (SELECT row_number() OVER () AS rid, text FROM documents) documents USING (rid) WHERE rid IN (SELECT rid FROM pos)),
sp AS (SELECT rid, string_agg(CAST(lead AS VARCHAR) || ':' || CAST(lead + size AS VARCHAR), ',' ORDER BY a) AS spans FROM (
  SELECT rid, a, list_sum(list_transform(g[1:a], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x))), 0) AS lead,
    list_sum(list_transform(w[a:b], lambda x: length(x))) + coalesce(list_sum(list_transform(g[a + 1:b], lambda x: length(x))), 0) AS size FROM runs JOIN gaps USING (rid)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid) LEFT JOIN sp USING (rid)"""
