"""Prefix trie of conversations, merged family first.

Conversation c begins with the first `head_size(c)` turns of its family's base, conversation c - c % 100, and goes on with its own turns
behind its first `head_size(c)`. A node stands for a distinct sequence of turns (role, text) that a rebuilt conversation begins with.

Only digests travel: a turn is (conv_id, turn, 128 bits of its SHA-256, code points), and a node is told by a digest chained over its turns; texts
stay where they are. Each family's turns and its base's first turns are cogrouped as one sorted stream, so a task holds a family's
trie and never its rows. A family of more than HEAVY turns is spread over its conversations; a trie of more than NODES nodes is given out in parts. A
part sums over its subtrees what it can: the members' code points, which add up over parts, and leaves and distinct turns, which are final
where no other part has the node. Only these combined nodes are shuffled. Nodes of one part are done then; shared
ones get the sums of the unshared subtrees that hang on them, and sums over shared subtrees in log2(depth) rounds of doubling: part rows carry their ancestors
at distances 1, 2, 4, ..., so each round is an aggregation, pre-aggregated before it shuffles, and a join of unique keys.
A node's ended members are joined per part first and then hashed in a stream in order of families; a hash is one chain, so that stream is one task's, but
never held. Parents of many children are broadcast within a counted bound.

Defined cases: rows whose conv_id is null or no number belong to no conversation; a null role or text is empty; a null turn comes first;
rows of a conversation with equal turn are ordered by the SHA-256 of role and text, so equal rows stand side by side. A conversation without
a base keeps its own turns behind its first `head_size(c)`; a rebuilt one without turns ends at the root. No conversations make no nodes. Extra columns are not read.
A task holds one conversation's nodes at least, however long it is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.memory import give_back
from spanveil.session import keep, ship, table

FAMILY = 100
HEADS = 6
#: Turns of a family beyond which each of its conversations is a part of its own.
HEAVY = 200_000
#: Nodes that a part has at most, but for those of one conversation.
NODES = 50_000
#: Parents of that many children are hot; BROADCAST of them at most are sent to all tasks.
HOT, BROADCAST = 10_000, 100_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_FLUSH = 20_000


def head_size(conv_id: int, heads: int = HEADS) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % heads


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, family, turn, x (16 bytes of digest), n (code points of the text) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    conv = F.expr("try_cast(conv_id AS bigint)")
    return conversations.select(conv.alias("conv_id"), (conv - conv % FAMILY).alias("family"), "turn", x.alias("x"), F.length(text).cast("long").alias("n")).where("conv_id IS NOT NULL")


class Part:
    """The trie of some conversations of a family. Node 0 is the root; a node's parent comes before it."""

    def __init__(self, family: int, salt: int, number: int):
        self.name = (family, salt, number)
        self.parent, self.depth, self.conv, self.members, self.chars, self.key = [-1], [0], [None], [0], [0], [bytes(16)]
        self.below: dict[tuple[int, bytes], int] = {}
        self.ends: dict[int, list[str]] = {}

    def visit(self, node: int, conv: int) -> int:
        """Count a member; conversations come in ascending order."""
        if self.conv[node] is None:
            self.conv[node] = conv
        self.members[node] += 1
        return node

    def step(self, node: int, x: bytes, n: int, conv: int) -> int:
        at = self.below.get((node, x))
        if at is None:
            at = self.below[node, x] = len(self.parent)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.conv.append(conv)
            self.members.append(1)
            self.chars.append(n)
            self.key.append(hashlib.blake2b(self.key[node] + x, digest_size=16).digest())
            return at
        self.members[at] += 1
        return at

    def rows(self) -> dict[str, list]:
        """Columns of all nodes with the sums over their subtrees."""
        n = len(self.parent)
        gross = [m * c for m, c in zip(self.members, self.chars)]
        own, leaves, children = list(self.chars), [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            if not children[k]:
                leaves[k] = 1
            p = self.parent[k]
            if p >= 0:
                children[p] += 1
                gross[p] += gross[k]
                own[p] += own[k]
                leaves[p] += leaves[k]
        # Ancestors at distances 1, 2, 4, ...: those of a node at 2^(j+1) are its ancestor's at 2^j.
        up: list[list[int]] = []
        for k in range(n):
            a, mine = self.parent[k], []
            while a >= 0:
                mine.append(a)
                j = len(mine) - 1
                a = up[a][j] if j < len(up[a]) else -1
            up.append(mine)
        halves = [np.frombuffer(b"".join(self.key), ">i8").reshape(-1, 2)[:, h].astype(np.int64).tolist() for h in (0, 1)]
        of_parent = lambda xs: [xs[p] if p >= 0 else None for p in self.parent]
        family, salt, number = self.name
        return {
            "k1": halves[0], "k2": halves[1], "p1": of_parent(halves[0]), "p2": of_parent(halves[1]), "depth": self.depth, "conv_id": self.conv, "parent_conv_id": of_parent(self.conv),
            "n_convs": self.members, "n_children": children, "n_leaves": leaves, "gross": gross, "own": own, "chars": self.chars,
            "up": [b"".join(self.key[a] for a in mine) for mine in up], "family": [family] * n, "salt": [salt] * n, "number": [number] * n,
            "ends": [",".join(self.ends[k]) if k in self.ends else None for k in range(n)],
        }


_LONGS = ["k1", "k2", "p1", "p2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "gross", "own", "chars"]
_PART = pa.schema([*((c, pa.int64()) for c in _LONGS), ("up", pa.binary()), ("family", pa.int64()), ("salt", pa.int64()), ("number", pa.int64()), ("ends", pa.string())])
_PART_SQL = ", ".join([*(f"{c} long" for c in _LONGS), "up binary", "family long", "salt long", "number long", "ends string"])


def part_builder(heads: int, most: int):
    """Arrow function over sorted rows (family, salt, own, conv_id, x, n), a base's first turns (own = 0) ahead, -> nodes of parts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Part | None = None
        base: list[tuple[bytes, int]] = []
        conv, node, skip = None, 0, 0
        out: dict[str, list] = {f.name: [] for f in _PART}

        def give(p: Part) -> None:
            for c, values in p.rows().items():
                out[c] += values

        def batch_of() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(out[f.name], f.type) for f in _PART], schema=_PART)
            for values in out.values():
                values.clear()
            give_back()
            return made

        def end_conversation() -> None:
            if conv is not None:
                part.ends.setdefault(node, []).append(str(conv))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for family, salt, own, c, x, n in zip(*columns):
                if part is None or (family, salt) != part.name[:2]:
                    if part is not None:
                        end_conversation()
                        if len(part.key) > 1 or part.members[0]:
                            give(part)
                    part, base, conv = Part(family, salt, 0), [], None
                if not own:
                    base.append((x, n))
                    continue
                if c != conv:
                    end_conversation()
                    if len(part.key) > most:
                        give(part)
                        part = Part(family, salt, part.name[2] + 1)
                    conv, skip = c, head_size(c, heads)
                    node = part.visit(0, c)
                    for bx, bn in base[:skip]:
                        node = part.step(node, bx, bn, c)
                if skip:
                    skip -= 1
                else:
                    node = part.step(node, x, n, c)
            if len(out["k1"]) >= _FLUSH:
                yield batch_of()
        if part is not None:
            end_conversation()
            if part.members[0]:
                give(part)
        if out["k1"]:
            yield batch_of()

    return build


def family_parts(conversations: DataFrame, heads: int = HEADS, heavy: int = HEAVY, nodes: int = NODES) -> DataFrame:
    """The combined nodes of every family's tries."""
    ship(conversations.sparkSession)
    turns = turn_digests(conversations)
    order = [F.col("turn").asc_nulls_first(), "x"]
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    base = turns.where("conv_id = family").withColumn("r", first).where(F.col("r") < heads).select("family", "r", "x", "n")
    big = keep(turns.groupBy("family").count().where(F.col("count") > heavy).select("family"), "heavy")
    if big.isEmpty():
        own, base = turns.withColumn("salt", F.lit(0).cast("long")), base.withColumn("salt", F.lit(0).cast("long"))
    else:  # each conversation of a heavy family is a part of its own, and each gets the base
        is_big = big.withColumn("big", F.lit(True))
        spread = lambda salts: F.when(F.col("big"), salts)
        own = turns.join(is_big, "family", "left").withColumn("salt", F.coalesce(spread(F.col("conv_id") % FAMILY), F.lit(0)).cast("long"))
        offsets = F.sequence(F.lit(1 - FAMILY).cast("long"), F.lit(FAMILY - 1).cast("long"))
        base = base.join(is_big, "family", "left").withColumn("salt", F.explode(F.coalesce(spread(offsets), F.array(F.lit(0).cast("long")))))
    turn_type = conversations.schema["turn"].dataType
    columns = ["family", "salt", "own", "conv_id", "turn", "x", "n", "r"]
    rows = own.withColumns({"own": F.lit(1), "r": F.lit(0)}).select(*columns).unionByName(
        base.withColumns({"own": F.lit(0), "conv_id": F.col("family"), "turn": F.lit(None).cast(turn_type)}).select(*columns)
    )
    ordered = rows.repartition("family", "salt").sortWithinPartitions("family", "salt", "own", "conv_id", "r", *order)
    return ordered.select("family", "salt", "own", "conv_id", "x", "n").mapInArrow(part_builder(heads, nodes), _PART_SQL)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, ends) in order -> SHA-256 of each node's lists, joined by commas."""
    at, state = None, hashlib.sha256()
    done: list[tuple[int, int, str]] = []
    give = lambda: pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "sha"])
    for batch in batches:
        for k1, k2, ends in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (k1, k2) != at:
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.encode())
        if len(done) >= _FLUSH:
            yield give()
            done.clear()
    if at is not None:
        done.append((*at, state.hexdigest()))
    if done:
        yield give()


def _up(level: int) -> list[Column]:
    """Both halves of the key of the ancestor at distance 2^level."""
    half = lambda k: F.conv(F.hex(F.substring("up", 16 * level + 8 * k + 1, 8)), 16, -10).cast("long")
    return [half(0).alias("k1"), half(1).alias("k2")]


def _shared_sums(parts: DataFrame, merged: DataFrame) -> DataFrame:
    """k1, k2, conv_id, n_children, own, n_leaves of the nodes that several parts have; the sums cover their whole subtrees."""
    key = ["k1", "k2"]
    one = F.col("parts") == 1
    kids = merged.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.sum(F.when(one, F.col("own")).otherwise(0)).alias("own_below"), F.sum(F.when(one, F.col("n_leaves")).otherwise(0)).alias("leaves_below"),
    )
    shared = merged.where("parts > 1").select(*key, "conv_id", "chars", "depth")
    # One part has a node's smallest member; it lends its list of ancestors.
    named = shared.join(parts.select(*key, "conv_id", "up"), [*key, "conv_id"])
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    now = keep(named.join(kids, key, "left").select(
        *key, "conv_id", "depth", "up", none(F.col("n_children")).alias("n_children"), (F.col("chars") + none(F.col("own_below"))).alias("own"),
        F.when(F.col("n_children").isNull(), 1).otherwise(F.col("leaves_below")).cast("long").alias("n_leaves"),
    ), "shared")
    deepest = now.agg(F.max("depth")).first()[0] or 0
    for level in range(int(deepest).bit_length()):
        given = now.where(F.length("up") > 16 * level).groupBy(*_up(level)).agg(F.sum("own").alias("o"), F.sum("n_leaves").alias("l"))
        now = keep(now.join(given, key, "left").select(
            *key, "conv_id", "depth", "up", "n_children", (F.col("own") + none(F.col("o"))).alias("own"), (F.col("n_leaves") + none(F.col("l"))).alias("n_leaves"),
        ), f"doubled{level}")
    return now.select(*key, "conv_id", "n_children", "own", "n_leaves")


def prefix_trie(conversations: DataFrame, heads: int = HEADS, heavy: int = HEAVY, nodes: int = NODES, hot: int = HOT) -> DataFrame:
    """Nodes: k1, k2 (key), p1, p2 (parent's, null at the root), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    key = ["k1", "k2"]
    parts = keep(family_parts(conversations, heads, heavy, nodes), "parts")
    alone = lambda c: F.max(c).alias(c)  # noqa: E731  meant where one part has the node
    merged = keep(parts.groupBy(*key).agg(
        F.count("*").alias("parts"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("gross").alias("gross"),
        *[alone(c) for c in ("p1", "p2", "depth", "chars", "n_children", "n_leaves", "own", "parent_conv_id")],
    ), "merged")
    shared = keep(_shared_sums(parts, merged), "tops")
    ends = parts.where("ends IS NOT NULL").select(*key, "family", "salt", "number", "ends").repartition(*key).sortWithinPartitions(*key, "family", "salt", "number")
    ends = ends.select(*key, "ends").mapInArrow(_hash_ends, "k1 long, k2 long, sha string")
    tops = shared.select(*key, *[F.col(c).alias("s_" + c) for c in ("n_children", "own", "n_leaves")])
    pick = lambda c: F.coalesce(F.col("s_" + c), F.col(c))
    whole = merged.join(tops, key, "left").join(ends, key, "left").select(
        *key, "p1", "p2", "depth", "conv_id", "parent_conv_id", "n_convs", pick("n_children").alias("n_children"), pick("n_leaves").alias("n_leaves"),
        (F.col("gross") - pick("own")).alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    # A shared parent's smallest member is known after the merge only. Hot parents go to all tasks, as far as their counted number allows.
    up = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("top"), "n_children")
    while up.where(F.col("n_children") >= hot).count() > BROADCAST:
        hot *= 10
    by_hot = whole.join(F.broadcast(up.where(F.col("n_children") >= hot).select("p1", "p2", F.col("top").alias("hot_top"))), ["p1", "p2"], "left")
    rest = up.where(F.col("n_children") < hot).select("p1", "p2", "top")
    known = by_hot.where("hot_top IS NOT NULL OR p1 IS NULL").withColumn("top", F.lit(None).cast("long"))
    other = by_hot.where("hot_top IS NULL AND p1 IS NOT NULL").join(rest, ["p1", "p2"], "left")
    return known.unionByName(other).withColumn("parent_conv_id", F.coalesce("hot_top", "top", "parent_conv_id")).drop("hot_top", "top")


def rebuilt(conversations: DataFrame, heads: int = HEADS) -> DataFrame:
    """conv_id, place (from 1), role, text of the rebuilt conversations; DataFrame functions only."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.expr("try_cast(conv_id AS bigint)")
    x = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    own = conversations.select(conv.alias("conv_id"), "turn", x.alias("x"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "x")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("r") < heads)).select(F.col("conv_id").alias("family"), F.col("r").alias("place"), "role", "text")
    sizes = base.groupBy("family").agg(F.max("place").alias("size"))
    convs = own.groupBy("conv_id").agg(F.first(F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")).withColumn("h", h).join(sizes, "family", "left")
    taken = convs.join(base, "family").where("place <= h").select("conv_id", "place", "role", "text")
    shift = convs.select("conv_id", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("taken"))
    kept = own.join(shift, "conv_id").where("r > h").select("conv_id", (F.col("r") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    return taken.unionByName(kept).select("conv_id", F.col("place").cast("long").alias("place"), "role", "text")


def with_turns(nodes: DataFrame, conversations: DataFrame, heads: int = HEADS) -> DataFrame:
    """nodes with role and text of their last turn; null at the root."""
    turns = rebuilt(conversations, heads).withColumnRenamed("place", "depth")
    return nodes.join(turns, ["conv_id", "depth"], "left")


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of the trie over all conversations."""
    nodes = prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 of decimal ids in DuckDB: the table-free bitwise form, one step a bit.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i:i]) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END))"""

ORACLE = f"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(t ORDER BY r) AS ts, CAST(xor({_CRC}, CAST(4294967295 AS BIGINT)) % {HEADS} AS BIGINT) AS h FROM own GROUP BY conv_id),
built AS (SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM lists a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
prefixes AS (SELECT conv_id, len(ts) AS size, unnest(list_transform(range(0, len(ts) + 1), lambda d: {{'d': d, 'p': ts[1:d]}})) AS x FROM built),
node AS (SELECT x.p AS p, x.d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = x.d), '') AS ends FROM prefixes GROUP BY ALL),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(node.p[depth].text) END AS own FROM node LEFT JOIN kids ON kids.p = node.p),
up AS (SELECT p[1:a] AS p, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT p, own, n_children, unnest(range(0, depth + 1)) AS a FROM full_node) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(up.leaves AS BIGINT) AS n_leaves,
  CAST(up.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN up ON up.p = f.p LEFT JOIN node q ON f.depth > 0 AND q.p = f.p[1:f.depth - 1]"""
