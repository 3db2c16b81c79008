import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanveil.llm import packing as p
from tests.llm.cases import PROSE, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_encode_like_whole_texts():
    enc, tokenizer = p.ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", PROSE, "THE, the! a|b | Don't x. ... café. ÉA, <|endoftext|> Σας it's. I, a.b , .", "a\u00a0b\u2003c\x0bd\x85e\x1ff", "e\u0301 \u0301x 12,345.", "|", "||| |", "日本語 テスト。", "ß İi ﬁ", PROSE * 50]
    for _ in range(2):  # cold and warm
        ids, sizes = enc.encode(pa.array(texts))
        at = 0
        for t, n in zip(texts, sizes.tolist()):
            assert tokenizer.encode(t, add_special_tokens=False).ids == ids[at : at + n].tolist(), t
            at += n
    enc.shrink(20)
    assert len(enc.index) <= 21
    assert enc.encode(pa.array([PROSE]))[0].tolist() == tokenizer.encode(PROSE, add_special_tokens=False).ids


def slow_cost(cuts, penalties, length):
    best = [0.0] + [float("inf")] * (len(cuts) - 1)
    for j in range(1, len(cuts)):
        for i in range(j):
            n = cuts[j] - cuts[i]
            if n <= length:
                pad = length - n
                if n < length and n >= p.LEAST_POWER and n & (n - 1) == 0:
                    pad = min(pad, p.SMALL_WINDOW)
                best[j] = min(best[j], best[i] + pad + penalties[j])
    return best[-1]


def test_cuts_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(30):
        cuts = np.concatenate(([0], np.cumsum(rng.choice([64, 100, 128, 256, 300], 40))))
        penalties = rng.choice([0, 2, 16], 41)
        ends = p.choose_cuts(cuts, penalties, True, 512)
        cost, before = 0.0, 0
        for e in ends:
            n = e - before
            cost += (p.SMALL_WINDOW if n < 512 and n >= p.LEAST_POWER and n & (n - 1) == 0 and p.SMALL_WINDOW < 512 - n else 512 - n) + penalties[int(np.searchsorted(cuts, e))]
            before = e
        assert before == cuts[-1] and abs(cost - slow_cost(cuts.tolist(), penalties.tolist(), 512)) < 1e-6


def test_round_trip_of_all_documents(spark):
    docs = documents(spark, [(50 + i, PROSE * (i % 7), "en", "c", None) for i in range(60)])
    rows = p.pack(docs, PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"]).tolist()[:-1]] and s["length"].sum() <= p.LENGTH
    texts = {}
    for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        texts[r["doc_id"]] = r["text"] or ""
    for d, t in texts.items():
        want = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, p.END], "<u4")
        own = rows[rows["doc_id"] == d].sort_values(["start", "sequence_id"])
        times = 2 if d == 2 else 1
        assert own["length"].sum() == times * len(want) and set(own["doc_tokens"]) == {len(want)}
        for s, n, raw in zip(own["start"], own["length"], own["ids"]):
            assert want[s : s + n].tobytes() == bytes(raw) and zlib.crc32(bytes(raw)) == zlib.crc32(want[s : s + n].tobytes())


def test_little_padding_and_bounded_blocks(spark):
    rng = np.random.default_rng(1)
    packer, n = p.Packer(p.ChunkEncoder(PATH).sentence_ends, 0), 0
    ends = packer.sentence_ends[0]
    pieces = []
    for _ in range(400):
        size = int(rng.integers(1, 3000))
        ids = rng.integers(5, 1000, size).astype(np.uint32)
        ids[:: int(rng.integers(8, 40))] = ends
        packer.add([n], ids, np.array([size]))
        n += 1
        if packer.size > 100_000:
            pieces.append(packer.flush(False).to_pandas())
            assert packer.size <= p.LENGTH
    pieces.append(packer.flush(True).to_pandas())
    sizes = [x for frame in pieces for x in frame.groupby("sequence_id")["length"].sum()]
    padding = sum(0 if x & (x - 1) == 0 else p.LENGTH - x for x in sizes)
    assert padding / sum(sizes) < 0.02


def test_empty_table(spark):
    assert p.pack(documents(spark).where(F.lit(False)), PATH).count() == 0


def test_other_tokenizers_encode_whole_texts_and_ids_keep_their_type(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert p.ChunkEncoder(path).whole and not p.ChunkEncoder(PATH).whole
    texts = {"a": "One  two.\n\nThree", "b": None, "c": PROSE}
    docs = spark.createDataFrame([*texts.items()], "doc_id string, text string").coalesce(1)
    rows = p.pack(docs, path).collect()
    assert docs.schema["doc_id"] == p.pack(docs, path).schema["doc_id"]
    for d, t in texts.items():
        own = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == d)
        assert b"".join(raw for _, raw in own) == np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, p.END], "<u4").tobytes()


def test_slices_are_bounded():
    texts = pa.array(["a" * 10, None, "b" * 25, "", "c" * 9, "d"])
    assert list(p.slices(texts, 20)) == [(0, 2), (2, 1), (3, 3)] and list(p.slices(texts.slice(0, 0))) == []
