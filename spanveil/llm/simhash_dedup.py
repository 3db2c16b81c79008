"""SimHash near-duplicates: all links within a Hamming radius, found exactly, and their connected components.

Fingerprints are reduced to distinct values first, so exact copies cost nothing further. The index is hierarchical: an
upper node is a masked bit pattern that all its fingerprints share. Spark lays out the upper levels: by the pigeonhole
principle two values that differ in at most 3 bits agree on one of four blocks, and on one of four blocks of the remaining bits, and so on, so
every link lies inside one of the four nodes (path, shared bits) of each value on the first level. Counting nodes first, with partial aggregation,
tells two cases apart: nodes of at most NODE values go to a task, and larger nodes are
split by the same principle on their remaining bits. Five levels fix 49 of 64 bits, so a node has at most 2 ** 15 distinct
values however skewed the data: no cap on candidates is needed.

Inside a node the values come in Gray rank order. Groups of FAN neighbours form nodes with the bits they share, groups of FAN nodes the
next level, and so on; a search carries the differences accumulated on the way down and prunes a whole group once they exceed the
radius. A task emits one row per value, linking it to its component's least id in that node: connectivity is kept without
writing all pairs. Components over all nodes come from alternating large-star and small-star joins over written tables.

Three-word shingles change in threes, so that few near copies differ in three bits only. `near_groups` links by that one fingerprint.
`drop_near_duplicates` is for finding near copies: it takes PRINTS fingerprints of a text's distinct words, of independent hashes, and links what
any of them links. Repeated words don't count there, since long texts of one language share their frequent words' shares.

Defined cases: null and empty texts have fingerprint zero, which is linked like any other. doc_id identifies a document;
rows with a null doc_id never represent a group. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.llm.fm_index import ranges
from spanveil.llm.memory import give_back
from spanveil.session import discard, keep, ship, table

SHINGLE = 3
SEED = 42
RADIUS = 3
NODE = 1024
FAN = 16
DEPTH = 5
PRINTS = 6
_PIECE = 1 << 16


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _PIECE):
        part = hashes[k : k + _PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of word shingles; A-Z lower-cased, words split at space and U+0009 to U+000D."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(ws) - width + 1)
    h = xxhash.xxh64_intdigest
    return _majority(np.array([h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[min(width, len(ws)) - 1 :].tolist())], np.uint64))


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    out = pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))
    give_back()
    return out


def word_prints(text: str | None, prints: int = PRINTS) -> list[int]:
    """SimHashes of the distinct words, one for each of several hashes; the words' own is spread by multiplication and shifts."""
    ws = set(text.encode("utf-8", "surrogatepass").lower().split()) if text else ()
    base = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in ws), np.uint64, len(ws))
    out = []
    for k in range(1, prints + 1):
        x = base ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def simhashes(texts: pa.Array) -> pa.Array:
    out = np.array([word_prints(t.as_py()) for t in texts], np.uint64).view(np.int64)
    give_back()
    return pa.array(list(out), type=pa.list_(pa.int64()))


def gray_rank(fp: Column) -> Column:
    """Rank of a value in the reflected Gray sequence: each bit is the parity of the bits from it upwards."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def quarters(bits: list[int]) -> list[list[int]]:
    """Four nearly equal blocks."""
    n = len(bits)
    return [bits[n * k // 4 : n * (k + 1) // 4] for k in range(4)]


def masks(depth: int) -> dict[str, tuple[int, list[int]]]:
    """Path of block numbers -> (mask of the bits fixed on it, the bits left)."""
    level = {"": (0, list(range(64)))}
    for _ in range(depth):
        level = {
            path + str(k): (mask | sum(1 << b for b in block), [b for b in left if b not in block])
            for path, (mask, left) in level.items()
            for k, block in enumerate(quarters(left))
        }
    return level


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _below(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (fp, id), (tag, fp, id) or, deeper down, (path, fp, id): one row for each node of the given depth that holds the value. A path
    begins with the tag, so that values of different tags never share a node."""
    if "path" not in rows.columns:
        tag = F.col("tag") if "tag" in rows.columns else F.lit("")
        nodes = [F.struct(F.concat(tag, F.lit(p)).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shared")) for p, (m, _) in masks(depth).items()]
        return rows.select(F.explode(F.array(*nodes)).alias("n"), "fp", "id").select("n.path", "n.shared", "fp", "id")
    by_path = F.create_map(*[x for p, (m, _) in masks(depth).items() for x in (F.lit(p), F.lit(_signed(m)))])
    child = rows.select(F.explode(F.array(*[F.concat("path", F.lit(str(k))) for k in range(4)])).alias("path"), "fp", "id")
    return child.select("path", F.col("fp").bitwiseAND(F.try_element_at(by_path, F.substring("path", -depth, depth))).alias("shared"), "fp", "id")


def node_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i < j) of all values within the radius; the values come in Gray order."""
    n = len(fps)
    if n <= FAN:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        return i[near], j[near]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    # Levels bottom-up: bits set in all members, bits set in any, so that ~(any ^ all) is the mask they share.
    levels = [(fps, fps)]
    while len(levels[-1][0]) > 1:
        every, some = levels[-1]
        edges = np.arange(0, len(every), FAN)
        levels.append((np.bitwise_and.reduceat(every, edges), np.bitwise_or.reduceat(some, edges)))
    q = np.arange(n)
    node = np.zeros(n, np.int64)
    done = np.zeros(n, np.int64)  # differences accumulated so far
    fixed_above = np.zeros(1, np.uint64)
    for depth in range(len(levels) - 1, -1, -1):
        every, some = levels[depth]
        fixed = ~(some ^ every) & full
        above = fixed_above[np.arange(len(every)) // FAN] if depth < len(levels) - 1 else fixed_above
        fresh = fixed & ~above  # bits that this level fixes and its parent did not
        done = done + np.bitwise_count((fps[q] ^ every[node]) & fresh[node])
        last = np.minimum((node + 1) * FAN**depth, n) - 1
        alive = (done <= radius) & (last > q)
        q, node, done = q[alive], node[alive], done[alive]
        if depth:
            below = np.minimum(FAN, len(levels[depth - 1][0]) - node * FAN)
            q, done = np.repeat(q, below), np.repeat(done, below)
            node = ranges(node * FAN, below)
        fixed_above = fixed
    return q, node


def least_reachable(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each index the least id of its component under the links (i, j)."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        fresh = label.copy()
        np.minimum.at(fresh, i, low)
        np.minimum.at(fresh, j, low)
        if (fresh == label).all():
            return label
        label = fresh


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _small_nodes(starts: np.ndarray, sizes: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many nodes of at most FAN values at once, as indices into fps."""
    out_i, out_j = [], []
    for size in np.unique(sizes).tolist():
        first = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        out_i.append(a[near])
        out_j.append(b[near])
    return np.concatenate(out_i or [np.zeros(0, np.int64)]), np.concatenate(out_j or [np.zeros(0, np.int64)])


def search_nodes(node: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by node and Gray rank; returns edges (id, least id linked to it inside the node)."""
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    sizes = np.diff(np.append(starts, len(node)))
    small = sizes <= FAN
    i, j = _small_nodes(starts[small], sizes[small], fps, radius)
    parts_i, parts_j = [i], [j]
    for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
        x, y = node_links(fps[s : s + n], radius)
        parts_i.append(x + s)
        parts_j.append(y + s)
    i, j = np.concatenate(parts_i), np.concatenate(parts_j)
    # Rows of different nodes may carry the same id, so components are taken over rows, not ids.
    least = least_reachable(ids, i, j)
    moved = least != ids
    return ids[moved], least[moved]


def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function over rows (key, fp, id) in node order; a node that straddles batches is held until it is whole."""
    held: list[pa.RecordBatch] = []

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, fps, ids = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in rows]) for k in range(3))
        a, b = search_nodes(node, fps.view(np.uint64), ids)
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[-1])  # start of the last node
        whole = [*held, batch.slice(0, cut)] if cut else []
        if cut:
            yield solve(whole)
            held = [batch.slice(cut)]
        elif held and held[-1].column(0)[-1].as_py() != keys[0]:
            yield solve(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield solve(held)
    held.clear()
    give_back()


def link_edges(values: DataFrame, node: int = NODE) -> DataFrame:
    """Edges (a, b), a > b, of ids whose fingerprints are connected within the radius; values: distinct (fp, id), or (tag, fp, id) for
    several fingerprints at once, tags being of one character."""
    parts, rows, depth = [], values, 1
    while True:
        # A node is told by a hash of its path and bits: rows stay short, and nodes that collide only compare more values.
        placed = _below(rows, depth).select(F.xxhash64("path", "shared").alias("key"), "path", "fp", "id")
        small, large = placed, None
        if depth < DEPTH:
            large = keep(placed.groupBy("key").count().where(F.col("count") > node).select("key"), f"nodes{depth}")
            large = None if large.isEmpty() else large
        if large is not None:
            small = placed.join(large, "key", "left_anti")
        # One task gets whole nodes of bounded size; rows of a node are in Gray order.
        ordered = small.select("key", "fp", "id").repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")))
        parts.append(ordered.mapInArrow(links_of, EDGE))
        if large is None:
            break
        rows = keep(placed.join(large, "key").select("path", "fp", "id"), f"large{depth}")
        depth += 1
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): b is the least id that a reaches, for every a that is not itself the least. Edges have a > b.

    Alternating star contractions; each round is written to the shared folder, so its lineage is short and a hub's
    rows meet their minimum in a join that adaptive execution can split.
    """
    least = lambda e: keep(e.groupBy("a").agg(F.min("b").alias("m")), "least")
    state = lambda e: tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
    now = keep(edges, "edges")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = least(both)
        m = lows.withColumn("m", F.least("a", "m"))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = keep(large, "large")
        m = least(large)
        small = large.join(m, "a").select("b", "m").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        fresh = keep(small.unionByName(m.select("a", F.col("m").alias("b"))).distinct(), "small")
        discard(now, lows, large, m)  # nothing reads a finished round's tables
        after = state(fresh)
        if after == seen:
            return fresh
        now, seen = fresh, after
    return now


def _numbered(firsts: DataFrame, id_type: T.DataType) -> DataFrame:
    """firsts (..., name: least doc_id of its row) with `id`, a long in the order of the names: the name itself, or a number given along a sort."""
    if isinstance(id_type, T.IntegralType):
        return firsts.withColumn("id", F.col("name").cast("long"))
    return firsts.orderBy("name").withColumn("id", F.monotonically_increasing_id())  # partitions of a sort ascend, and so do their numbers


def _rooted(firsts: DataFrame, linked: DataFrame, id_type: T.DataType) -> DataFrame:
    """firsts with component_id, the name of the least id that each reaches."""
    roots = firsts.join(linked.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    if isinstance(id_type, T.IntegralType):
        return roots.withColumn("component_id", F.col("root").cast(id_type))
    return roots.join(firsts.select(F.col("id").alias("root"), F.col("name").alias("component_id")), "root")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64-bit), component_id of every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    prints = keep(docs.select("doc_id", simhash("text").alias("fp")), "prints")
    values = keep(_numbered(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("name")), id_type), "values")
    labels = _rooted(values, components(link_edges(values.select("fp", "id"))), id_type).select("fp", "component_id")
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of every row of docs (doc_id, text), linked by any of the PRINTS fingerprints of distinct words."""
    ship(docs.sparkSession)
    fps = [f"fp{k}" for k in range(PRINTS)]
    id_type = docs.schema["doc_id"].dataType
    made = docs.select("doc_id", simhashes("text").alias("fps"))
    prints = keep(made.select("doc_id", *[F.get("fps", F.lit(k)).alias(c) for k, c in enumerate(fps)]), "prints")
    sets = keep(_numbered(prints.where("doc_id IS NOT NULL").groupBy(*fps).agg(F.min("doc_id").alias("name")), id_type), "sets")
    each = sets.select("id", F.explode(F.array(*[F.struct(F.lit(str(k)).alias("tag"), F.col(c).alias("fp")) for k, c in enumerate(fps)])).alias("t")).select("id", "t.*")
    values = keep(each.groupBy("tag", "fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "values")
    shared = values.where("n > 1").select("tag", "fp", F.col("id").alias("b"))  # one fingerprint of different texts
    equal = each.select(F.col("id").alias("a"), "tag", "fp").join(shared, ["tag", "fp"]).where("a <> b").select("a", "b")
    linked = components(link_edges(values.select("tag", "fp", "id")).unionByName(equal).distinct())
    labels = _rooted(sets, linked, id_type).select(*fps, "component_id")
    return prints.join(labels, fps, "left").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the documents that are not the least doc_id of their group of copies; rows with a null doc_id stay."""
    groups = keep(copy_groups(docs.select("doc_id", "text")), "groups")
    stays = groups.where("doc_id = component_id").select("doc_id")
    goes = groups.where("doc_id <> component_id").select("doc_id").join(stays, "doc_id", "left_anti").distinct()
    return docs.join(keep(goes, "goes"), "doc_id", "left_anti").select(*docs.columns)


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
