"""Cross-tokenizer alignment against the two libraries, text by text and pair by pair."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mobilome.llm import alignment
from mobilome.storage import materialize
from tests.llm.test_operators_llm import ODD, SCHEMA

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
MORE = ["▁x y", "a ▁ b", "<0x41> <s> </s> <unk>", " ", "  ", "\n", "x ", " x", "a\n b  \n  c", "a​ b ﻿ c᠎ d", "\u0000 a", "tail  \t", "\x85 a \x85", "emoji 👩‍👩‍👧 flag 🇩🇪"]


def plain(texts):
    """(a, b, groups, linked pairs) of every text, from the libraries alone; None without tokens."""
    tok, model = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tok.encode_special_tokens = True
    code = alignment._byte_of()
    found = []
    for t in texts:
        if not t:
            found.append(None)
            continue
        a, b = tok.encode(" " + t, add_special_tokens=False).ids, model.encode(t)
        a_bytes = [bytes(code[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            found.append(None)
            continue
        spans = []
        for tokens in (a_bytes, b_bytes):
            at, own = 0, []
            for x in tokens:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for e in ends:
            side = [[i for i, (s, z) in zip(ids, own) if start <= s and z <= e] for ids, own in zip((a, b), spans)]
            groups.append("|".join(",".join(map(str, x)) for x in side))
            start = e
        links = [(i, j) for i, (s, z) in zip(a, spans[0]) for j, (u, v) in zip(b, spans[1]) if s < v and u < z]
        found.append((a, b, groups, links))
    return found


def expected(rows):
    found = plain([t for _, t in rows])
    counts = Counter(p for f in found if f for p in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), f in zip(rows, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        shown = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), shown))
    return sorted(out, key=repr)


def given(df):
    rows = df.collect()
    return sorted(
        ((r.doc_id, *(r[n] for n in NAMES), hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in rows), key=repr
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "of", "Straße", "naïve", "tion", "x1", "42", "end.\nNext", "été,", "don't", "日本", "re-entry", "", " ", "\t"]
    texts = ODD + MORE + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    texts += ["".join(rng.choice(["a", "b1", "'s", " ", " ", "\n", "\t", ".", "é", "　", "​", "中"]) for _ in range(rng.randrange(0, 25))) for _ in range(300)]
    return [*enumerate(texts), (3, texts[3]), (None, texts[40]), (None, None)]


def frame(spark, rows, parts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 1, "z", 2) for i, t in rows], SCHEMA).repartition(parts)


def test_equals_the_libraries(spark, rows):
    want = expected(rows)
    assert given(alignment.align(frame(spark, rows, 4))) == want
    assert given(alignment.align(frame(spark, rows, 3), shard_pairs=50)) == want


@pytest.mark.parametrize("limits", [{"BLOCK_CHUNKS": 20}, {"BLOCK_CHARS": 700, "SLICE_CHARS": 100}, {"CALL_CHARS": 5, "SLICE_CHUNKS": 3}])
def test_limits_change_nothing(rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in x], pa.int64()), pa.array([t for _, t in x], pa.string())], ["a", "b"]) for x in (rows[:90], rows[90:])]
    blocks = list(alignment._blocks(PATHS)(batches))
    used = [pa.RecordBatch.from_arrays(b.columns[:7], b.schema.names[:7]) for b in blocks]
    got = [r for b in alignment._answers([], np.ones(40_000, np.int64), 50_257)(used) for r in b.to_pylist()]
    assert len(blocks) > 1 or "CALL_CHARS" in limits
    found = plain([t for _, t in rows])
    assert [(r["doc_id"], r["n_links"], r["groups"]) for r in got] == [(i, len(f[3]) if f else 0, ";".join(f[2]) if f else "") for (i, _), f in zip(rows, found)]


def test_a_worker_keeps_no_table_behind_its_last_block(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["a", "b"])
    assert list(alignment._blocks(PATHS)([batch]))
    kept = alignment._aligner(PATHS)
    assert (len(kept.number), len(kept.shown), len(kept.links), kept.facts.shape[1]) == (0, 0, 0, 0)


def test_answers_take_one_block_of_a_batch_at_a_time(rows, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_CHUNKS", 20)
    monkeypatch.setattr(alignment, "SLICE_CHARS", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["a", "b"])
    blocks = pa.Table.from_batches(list(alignment._blocks(PATHS)([batch]))).combine_chunks().to_batches()
    assert len(blocks) == 1 and blocks[0].num_rows > 1
    got = [r["doc_id"] for b in alignment._answers([], np.ones(40_000, np.int64), 50_257)([blocks[0].select(range(7))]) for r in b.to_pylist()]
    assert got == [i for i, _ in rows]


def test_shards_hold_every_pair_once_and_sorted(spark, rows):
    blocks = materialize(frame(spark, rows, 3).select("doc_id", "text").mapInArrow(alignment._blocks(PATHS), alignment._BLOCK), "test-blocks")
    size = alignment._aligner(PATHS).n_a
    counts = alignment.count_pairs(blocks, size, 32_000, shard_pairs=50)
    assert len(counts.paths) > 3
    pairs = np.hstack([np.load(p, mmap_mode="r") for p in counts.paths])
    assert (np.diff(pairs[0]) > 0).all()
    want = Counter((i, j) for f in plain([t for _, t in rows]) if f for i, j in f[3])
    assert {(int(k % size), int(k // size)): int(n) for k, n in pairs.T} == want
    best = Counter()
    for (_, b), n in want.items():
        best[b] = max(best[b], n)
    assert {b: int(n) for b, n in enumerate(counts.best) if n} == dict(best)


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_very_long_text(spark):
    text = "word étude " * 150_000 + "x" * 50_000
    got = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    tok, model = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    assert (got.n_a, got.n_b) == (len(tok.encode(" " + text).ids), len(model.encode(text)))


def test_the_shared_folder_must_be_mounted():
    assert alignment._mounted("file:///shared/x") == "/shared/x"
    with pytest.raises(RuntimeError):
        alignment._mounted("hdfs://cluster/shared")


def test_a_block_is_a_row_group(spark, monkeypatch):
    """Readers hold one block at a time, because each has a row group of its own."""
    import glob
    import os

    import pyarrow.parquet as pq

    from mobilome.storage import shared_dir

    rows = [(i, f"one two three {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    real = alignment._blocks

    def small(paths):
        run = real(paths)

        def each(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 100):  # a block each
                    yield from run(iter([batch.slice(at, 100)]))

        return each

    monkeypatch.setattr(alignment, "_blocks", small)
    assert alignment.align(docs).count() == 600
    folder = max(glob.glob(f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}/aligned-blocks-*"), key=os.path.getmtime)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
    assert sum(f.num_rows for f in files) == 6 and all(f.num_row_groups == f.num_rows for f in files)
