"""Packing of token streams into fixed windows by order-preserving dynamic programming.

Every partition is one stream of documents in row order. Windows are cut at document ends, at sentence ends, or, where a
stretch without either exceeds a window, at whole windows. Over the possible cuts the programme minimises padding plus a
penalty for each cut inside a document. A window from cut i to cut j costs length - (j - i) tokens of padding, so the best
start is the least cost(i) + i among cuts at most one window back: a monotone queue yields it in constant time. A window whose
size is a power of two needs no padding; such sizes from LEAST_POWER up are further transitions.

The stream is cut block by block, each block's last windows being carried into the next, so memory is bounded by the block
and the largest document. No shuffle: rows stay in the partition that read them, and a lost task repeats the same cuts
as its rows come in the same order.

Defined cases: a null text counts as empty; an empty document is its end token alone. Repeated rows are packed as often
as they occur. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.llm.fm_index import ranges
from spanveil.llm.memory import give_back
from spanveil.session import ship, table

LENGTH = 2048
END = 1
BLOCK_TOKENS = 400_000
TEXT_BYTES = 4_000_000
#: Tokens of padding that a cut is worth: at a sentence end, elsewhere in a document, and for one more, smaller window.
SENTENCE, ANYWHERE, SMALL_WINDOW = 2, 16, 16
LEAST_POWER = 256
#: Beyond so many chunks or tokens the cache of encodings keeps the more frequent half.
CACHE_CHUNKS, CACHE_TOKENS = 400_000, 8_000_000
#: So many chunks go through the tokenizer at once; its results take much room.
ENCODE_CHUNKS = 4000

PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


#: The normaliser and pre-tokeniser under which a text's ids are its chunks' ids in order (fixed values of that format).
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of one case after str.lower and NFC as the tokenizer has them, and a run of marks up to the chunk's end: two pieces.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]*)([!-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 for itself, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(visible)))}


_BYTES = byte_letters()


def parts_at_blanks(config: dict) -> bool:
    """Whether a tokenizer, by its own description, lower-cases, drops white space and never joins characters across it."""
    pre = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    model = config["model"]
    return (
        (config.get("normalizer") or {}).get("normalizers") == _NORMALIZER
        and len(pre) == 2
        and {k: pre[0].get(k) for k in ("pattern", "behavior", "invert")} == {"pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True}
        and {k: pre[1].get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        and {k: model.get(k) for k in ("type", "dropout", "ignore_merges")} == {"type": "BPE", "dropout": None, "ignore_merges": False}
        and all(t["special"] and not t["lstrip"] and not t["rstrip"] and not set(t["content"]) & set(" \t\n\r") for t in config["added_tokens"])
    )


class ChunkEncoder:
    """Ids of texts. With a tokenizer that parts at blanks (`parts_at_blanks`), each distinct chunk is encoded once; with any other
    one every text goes through it whole.

    Blanks are those of ASCII, chunks what stands between. A chunk of plain letters with or
    without marks behind them is one or two pieces, which the model encodes alone; other chunks go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.most = CACHE_CHUNKS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = not parts_at_blanks(json.loads(self.tokenizer.to_str()))
        alone = [self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".!?"]
        self.sentence_ends = np.array(sorted(x[0] for x in alone if len(x) == 1), np.uint32)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0
        self.met = np.zeros(1024, np.int64)

    def shrink(self, most: int) -> None:
        """Keep the chunks met most often, at most `most` of them and none that was met once only."""
        order = np.argsort(-self.met[: len(self.index)], kind="stable")[:most]
        stay = np.zeros(len(self.index), bool)
        stay[order[self.met[order] > 1]] = True
        stay[0] = False
        again = [c for c, k in self.index.items() if stay[k]]
        old = np.flatnonzero(stay)  # chunks are numbered in the order of the index
        flat, lengths, counts = self.flat[ranges(self.starts[old], self.lengths[old])], self.lengths[old], self.met[old]
        self.clear()
        if again and len(flat) <= CACHE_TOKENS // 2:
            self._store(again, flat, lengths)
            self.met[1 : len(again) + 1] = counts

    def _store(self, chunks: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, total = len(self.index), len(flat)
        for name, need in (("starts", n + len(chunks)), ("lengths", n + len(chunks)), ("met", n + len(chunks)), ("flat", self.used + total)):
            if need > len(getattr(self, name)):
                setattr(self, name, np.concatenate((getattr(self, name), np.zeros(need, getattr(self, name).dtype))))
        self.starts[n : n + len(chunks)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(chunks)] = lengths
        self.flat[self.used : self.used + total] = flat
        self.used += total
        self.index.update(zip(chunks, range(n, n + len(chunks))))

    def _model_ids(self, pieces: list[str]) -> None:
        """Store pieces that the pre-tokeniser leaves whole."""
        tokenize = self.tokenizer.model.tokenize
        found = [tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)) for p in pieces]
        flat = np.array([t.id for ts in found for t in ts], np.uint32)
        self._store(pieces, flat, np.fromiter(map(len, found), np.int64, len(found)))

    def _add(self, chunks: list[str]) -> None:
        """Encode new chunks: pieces first, which are chunks of their own, then what is put together from two of them."""
        matches = list(map(_PLAIN.fullmatch, chunks))
        plain = [c for c, m in zip(chunks, matches) if m]
        odd = [c for c, m in zip(chunks, matches) if m is None]
        for k in range(0, len(odd), ENCODE_CHUNKS):
            part = odd[k : k + ENCODE_CHUNKS]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._store(part, np.array(list(chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        heads, marks = [m[1].lower() for m in matches if m], [m[2] for m in matches if m]
        del matches
        own = self.index
        self._model_ids([p for p in dict.fromkeys(chain(heads, marks)) if p not in own])
        made = [x for x in zip(plain, heads, marks) if x[0] not in own]
        if made:
            names, first, second = zip(*made)
            pair = np.empty(2 * len(made), np.int64)
            pair[::2] = np.fromiter(map(own.__getitem__, first), np.int64, len(made))
            pair[1::2] = np.fromiter(map(own.__getitem__, second), np.int64, len(made))
            lengths = self.lengths[pair]
            self._store(list(names), self.flat[ranges(self.starts[pair], lengths)], lengths[::2] + lengths[1::2])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; a null has none."""
        if self.whole:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array(list(chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        if len(self.index) > self.most or self.used > CACHE_TOKENS:
            self.shrink(self.most // 2)
        split = pc.ascii_split_whitespace(texts)
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = split.flatten().dictionary_encode()
        names = chunks.dictionary.to_pylist()
        at = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            fresh = [names[k] for k in new]
            self._add(fresh)
            at[new] = np.fromiter(map(self.index.__getitem__, fresh), np.int64, len(fresh))
        at = at[chunks.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(at)
        self.met[: len(counts)] += counts
        lengths = self.lengths[at]
        ids = self.flat[ranges(self.starts[at], lengths)]
        edges = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))]
        return ids, np.diff(edges)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def choose_cuts(cuts: np.ndarray, penalties: np.ndarray, last: bool, length: int = LENGTH) -> list[int]:
    """Positions of the chosen window ends; cuts ascend from 0 in steps of at most `length`.

    With last, the final window ends at the last cut; else at whichever of the last window's cuts is cheapest.
    """
    n = len(cuts)
    powers = [2**k for k in range(LEAST_POWER.bit_length() - 1, length.bit_length()) if 2**k < length]
    exact: dict[int, list[int]] = {}
    for size in powers:
        k = np.searchsorted(cuts, cuts - size)
        for j in np.flatnonzero(cuts[k] == cuts - size).tolist():
            exact.setdefault(j, []).append(int(k[j]))
    at, pen = cuts.tolist(), penalties.tolist()
    cost, back = [0.0] * n, [0] * n
    # The monotone queue lies in keys[head:tail], ascending; starts[head] is the first cut within a window's reach.
    keys, starts, head, tail = [0.0] * n, [0] * n, 0, 1
    for j in range(1, n):
        x = at[j]
        reach = x - length
        while at[starts[head]] < reach:
            head += 1
        i = starts[head]
        best = keys[head] - reach
        if j in exact:
            for k in exact[j]:
                if cost[k] + SMALL_WINDOW < best:
                    best, i = cost[k] + SMALL_WINDOW, k
        best += pen[j]
        cost[j], back[j] = best, i
        key = best + x
        while tail > head and keys[tail - 1] > key:
            tail -= 1
        keys[tail], starts[tail] = key, j
        tail += 1
    end = n - 1
    if not last:
        tail = int(np.searchsorted(cuts, at[-1] - length, "right"))
        end = max(range(tail, n), key=lambda j: (-cost[j], j))
    chosen = []
    while end:
        chosen.append(at[end])
        end = back[end]
    return chosen[::-1]


def merged(*ascending) -> np.ndarray:
    """Distinct values of ascending arrays, in order."""
    x = np.sort(np.concatenate(ascending), kind="stable").astype(np.int64, copy=False)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions from 0 to the end, and their penalties.

    Besides the natural cuts there is one full window behind each of them, so that a window can always be filled at the price
    of a cut inside a sentence, and whole windows inside stretches without a natural cut.
    """
    ends = np.flatnonzero(np.isin(ids, sentence_ends)) + 1
    natural = merged([0], ends, doc_ends)
    gaps = np.diff(natural)
    wide = np.flatnonzero(gaps > length)
    extra = natural[np.repeat(wide, (gaps[wide] - 1) // length)] + length * (ranges(np.zeros(len(wide), np.int64), (gaps[wide] - 1) // length) + 1)
    full = natural + length
    cuts = merged(natural, extra, full[full < natural[-1]])
    penalties = np.full(len(cuts), ANYWHERE)
    penalties[np.searchsorted(cuts, natural)] = SENTENCE
    penalties[np.searchsorted(cuts, doc_ends)] = 0
    return cuts, penalties


class Packer:
    """Stream of one partition: documents go in, pieces come out."""

    def __init__(self, sentence_ends: np.ndarray, first_sequence: int, length: int = LENGTH, id_type: pa.DataType | None = None):
        self.sentence_ends, self.sequence, self.length, self.id_type = sentence_ends, first_sequence, length, id_type or pa.int64()
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, tokens here, all its tokens
        self.size = 0

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(doc_ids):
            self.ids.append(ids)
            self.docs += [(d, n, n) for d, n in zip(doc_ids, sizes.tolist())]
            self.size += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.size:
            return None
        ids = np.concatenate(self.ids)
        ends = np.cumsum([n for _, n, _ in self.docs])
        windows = np.array(choose_cuts(*possible_cuts(ids, ends, self.sentence_ends, self.length), last, self.length), np.int64)
        stop = int(windows[-1])
        edges = np.unique(np.concatenate(([0], windows, ends[ends <= stop])))
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, a, "right")
        window = np.searchsorted(windows, a, "right")
        window_start = np.concatenate(([0], windows))[window]
        total = np.array([t for _, _, t in self.docs], np.int64)
        raw = ids.astype("<u4").tobytes()
        out = pa.record_batch(
            [
                pa.array([self.docs[d][0] for d in doc.tolist()], self.id_type),
                pa.array(a - ends[doc] + total[doc]),
                pa.array(b - a),
                pa.array([raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist())], pa.binary()),
                pa.array(total[doc]),
                pa.array(self.sequence + window),
                pa.array(a - window_start),
            ],
            names=_NAMES,
        )
        self.sequence += len(windows)
        done = int(np.searchsorted(ends, stop, "right"))
        rest = self.docs[done:]
        if rest and done < len(ends):
            left = int(ends[done]) - stop
            rest[0] = (rest[0][0], left, rest[0][2])
        self.ids, self.docs, self.size = [ids[stop:]], rest, len(ids) - stop
        return out


def slices(texts: pa.Array, size: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows of about `size` bytes, a longer text being a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, end - at
        at = end


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, cache_chunks: int = CACHE_CHUNKS, keep_cache: bool = False) -> DataFrame:
    """Pieces of the packed sequences; ids are little-endian unsigned 32-bit. Needs doc_id, of any type, and text.

    cache_chunks bounds a worker's cache of encodings, at some 200 bytes each. keep_cache leaves it for the worker's next task:
    faster where workers do nothing else, but room that other operators of the same application lack.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        enc.most = cache_chunks
        packer = None
        for batch in batches:
            packer = packer or Packer(enc.sentence_ends, TaskContext.get().partitionId() << 40, length, batch.schema.field(0).type)
            for at, n in slices(batch.column(1)):
                ids, sizes = enc.encode(batch.column(1).slice(at, n))
                ends = np.cumsum(sizes)
                packer.add(batch.column(0).slice(at, n).to_pylist(), np.insert(ids, ends, END), sizes + 1)
                if packer.size >= BLOCK_TOKENS and (out := packer.flush(False)) is not None:
                    yield out
        if packer and (out := packer.flush(True)) is not None:
            yield out
        if not keep_cache:
            enc.clear()
            give_back()

    own = docs.select("doc_id", "text")
    return own.mapInArrow(run, T.StructType([own.schema["doc_id"], *T.StructType.fromDDL(PIECE).fields]))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of 2048 tokens."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache_chunks=1_000_000, keep_cache=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
