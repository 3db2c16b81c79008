"""All words of a table found in texts, in one pass, by an Aho-Corasick automaton.

Words become a trie with failure links, laid out as one table of transitions (state, class of the sign), so the cost of a text does not depend on
the number of words. A batch of texts is cut into lanes of equal length that overlap by the longest word; all lanes step together through the table, and a match is
reported by the lane in which it ends. Word tables of any size go through in blocks whose transition tables have at most CELLS cells, a counted bound; what the
blocks find is brought together by text.

Overlaps: "all" keeps every occurrence, "each" the leftmost of those of one word that overlap, "longest" the leftmost of all and of these the longest.

Offsets are code points. Defined cases: null texts hold nothing; empty and null words are none; repeated words are one; repeated rows have equal hits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.session import keep, shared_path, ship

CELLS = 16_000_000
LANE = 512
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
OVERLAPS = ("all", "each", "longest")


class Automaton:
    """The transition table of some words."""

    def __init__(self, words: list[str]):
        self.words = words
        signs = sorted({c for w in words for c in w})
        number = {c: i + 1 for i, c in enumerate(signs)}
        self.classes = np.zeros((ord(signs[-1]) if signs else 0) + 2, np.int32)  # 0: in no word; the last entry stands for all above
        for c, i in number.items():
            self.classes[ord(c)] = i
        width = len(signs) + 1
        below: list[dict[int, int]] = [{}]
        word_at = [-1]
        for k, w in enumerate(words):
            at = 0
            for c in w:
                nxt = below[at].get(number[c])
                if nxt is None:
                    nxt = below[at][number[c]] = len(below)
                    below.append({})
                    word_at.append(-1)
                at = nxt
            word_at[at] = k
        self.table = np.zeros((len(below), width), np.int32)
        self.word_at = np.array(word_at, np.int32)
        self.shorter = np.full(len(below), -1, np.int32)  # the next state on the way of failures that ends a word
        fail, queue = np.zeros(len(below), np.int64), [0]
        for s in queue:  # grows while it is read: breadth first
            f = fail[s]
            if s:
                self.table[s] = self.table[f]
                self.shorter[s] = f if word_at[f] >= 0 else self.shorter[f]
            for c, child in below[s].items():
                fail[child] = self.table[s, c]  # what the failure state does, before the child is put in
                self.table[s, c] = child
                queue.append(child)
        self.ends = (self.word_at >= 0) | (self.shorter >= 0)
        self.longest = max(map(len, words), default=0)

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, word) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not self.longest or not texts:
            return none, none, none
        sizes = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        sign = self.classes[np.minimum(code, len(self.classes) - 1)]
        lane = max(LANE, 4 * self.longest)
        lanes = -(-sizes // lane)
        text = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        offset = (np.cumsum(sizes) - sizes)[text]
        first = nth * lane
        warm = np.minimum(first, self.longest - 1)  # signs read ahead of the lane, in which no match is reported
        length = warm + np.minimum(lane, sizes[text] - first)
        order = np.argsort(-length, kind="stable")
        start, warm, length = (offset + first - warm)[order], warm[order], length[order]
        state = np.zeros(len(order), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        flat, width = self.table.ravel(), self.table.shape[1]
        live = len(order)
        for k in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length[:live], -k, "left"))
            state[:live] = flat[state[:live] * width + sign[start[:live] + k]]
            hit = np.flatnonzero(self.ends[state[:live]] & (k >= warm[:live]))
            if len(hit):
                found.append((hit, state[hit], k))
        if not found:
            return none, none, none
        lanes_hit = np.concatenate([h for h, _, _ in found])
        states = np.concatenate([s for _, s, _ in found])
        ends = start[lanes_hit] + np.concatenate([np.full(len(h), k) for h, _, k in found]) + 1
        texts_hit = text[order[lanes_hit]]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(states):
            own = self.word_at[states] >= 0
            out.append((texts_hit[own], ends[own], self.word_at[states[own]].astype(np.int64)))
            states = self.shorter[states]
            more = states >= 0
            states, ends, texts_hit = states[more], ends[more], texts_hit[more]
        t, e, w = (np.concatenate(x) for x in zip(*out))
        return t, e - (np.cumsum(sizes) - sizes)[t], w


#: Signs of the texts that are scanned at once: what a task holds beside its batch grows with this, not with the batch.
PORTION = 500_000


def portions(sizes: list[int], signs: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of texts of these sizes, in order, of at most so many signs each, or of one text."""
    first, size = 0, 0
    for k, n in enumerate(sizes):
        if k > first and size + n > signs:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def resolve(spans: list[tuple[int, int, str]], overlaps: str) -> list[tuple[int, int, str]]:
    """Occurrences of a text (start, end, word) by the rule for overlaps, in order of start and end."""
    if overlaps == "all":
        return sorted(spans)
    out, reach = [], {}
    for a, b, w in sorted(spans, key=lambda s: (s[0], -s[1])):
        key = w if overlaps == "each" else ""
        if a >= reach.get(key, 0):
            out.append((a, b, w))
            reach[key] = b
    return sorted(out)


def _spans(automaton: Automaton, texts: list[str | None], overlaps: str) -> pa.Array:
    """What stands in some texts, as Arrow."""
    rows = [t or "" for t in texts]
    spans: list[list[tuple[int, int, str]]] = [[] for _ in rows]
    for t, e, w in zip(*(x.tolist() for x in automaton.scan(rows))):
        word = automaton.words[w]
        spans[t].append((e - len(word), e, word))
    own = [resolve(s, overlaps) for s in spans]
    flat = [s for o in own for s in o]
    offsets = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int32)
    ends = [pa.array([s[k] for s in flat], pa.int32()) for k in range(2)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([*ends, pa.array([s[2] for s in flat], pa.string())], fields=list(_ARROW.value_type)), type=_ARROW)


def _finder(model, overlaps: str):
    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        automaton = model.value
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        return pa.chunked_array([_spans(automaton, texts.slice(a, b - a).to_pylist(), overlaps) for a, b in portions(sizes)], _ARROW).combine_chunks()

    return find


def _resolver(overlaps: str):
    @F.arrow_udf(SPANS)
    def settle(spans: pa.Array) -> pa.Array:
        rows = ([(x["start"], x["end"], x["value"]) for x in s.as_py()] for s in spans)
        return pa.array([[{"start": a, "end": b, "value": w} for a, b, w in resolve(s, overlaps)] for s in rows], type=_ARROW)

    return settle


def blocks_of(words: DataFrame, cells: int = CELLS) -> Iterator[list[str]]:
    """Distinct words in blocks; a block's states times classes are at most `cells`, or it is one word."""
    own = keep(words.select(F.col("word").cast("string").alias("word")).where("word <> ''").distinct(), "words")
    total, signs = own.agg(F.sum(F.length("word")), F.size(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.split("word", ""))))))).first()
    if not total:
        return
    blocks = -(-(total + 1) * (signs + 1) // cells)
    while True:
        placed = own.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int"))
        if blocks == 1 or placed.groupBy("block").agg(F.sum(F.length("word")).alias("n"), F.count("*").alias("k")).where((F.col("k") > 1) & ((F.col("n") + 1) * (signs + 1) > cells)).isEmpty():
            break
        blocks *= 2
    for b in range(blocks):
        found = sorted(r["word"] for r in placed.where(F.col("block") == b).select("word").toLocalIterator())
        if found:
            yield found


def find_words(texts: DataFrame, words: DataFrame, keys: list[str], overlaps: str = "all", column: str = "text", cells: int = CELLS) -> DataFrame:
    """keys, start, end, value: where the words (word) occur in the texts. Keys identify a text where the words take several blocks."""
    if overlaps not in OVERLAPS:
        raise ValueError(f"overlaps: one of {OVERLAPS}")
    spark = texts.sparkSession
    ship(spark)
    rows = texts.select(*keys, column)
    flat = lambda df: df.select(*keys, F.explode("__spans").alias("s")).select(*keys, "s.start", "s.end", "s.value")
    scan = lambda block, how: rows.withColumn("__spans", _finder(spark.sparkContext.broadcast(Automaton(block)), how)(column))
    blocks = blocks_of(words, cells)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return flat(scan(first or [], overlaps))
    path = shared_path(spark, "dictionary")
    number = 0
    for block in (first, second, *blocks):
        found = scan(block, "all" if overlaps == "longest" else overlaps)
        found.where(F.size("__spans") > 0).select(*keys, "__spans").write.parquet(f"{path}/block={number}")
        number += 1
    together = spark.read.parquet(*[f"{path}/block={k}" for k in range(number)])
    if overlaps != "longest":  # blocks share no word
        return flat(together)
    per_text = together.groupBy(*keys).agg(F.flatten(F.collect_list("__spans")).alias("__spans"))
    return flat(per_text.withColumn("__spans", _resolver(overlaps)("__spans")))
