"""Token counts without token ids.

Documents are read once, in blocks of bounded size.  A block keeps, for each of
its documents, how often each of the block's distinct pre-tokens occurs.  The
distinct pre-tokens of all blocks, dealt by ranges of their hash, meet in one place each; there
every pre-token is tokenised once and its number of pieces is joined back to
the blocks that hold it, where counts times frequencies are summed by document.
What is shuffled is a block's vocabulary, not its words, and a word that all
texts share is one entry per block.  The number of ranges follows the measured size of
all vocabularies, so that a range holds about BUCKET_WORDS of their entries at any scale.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a very long text is read whole and closes its block; special
strings inside a text count as the one token that the library makes of them; a
null id or a repeated row is passed on as it is; an empty table gives an empty
result.  Counts have no ties.  Other columns than the id and the text, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.llm.pretokens import cut_all, pieces, specials, tokenizer
from mobilome.storage import materialize

#: A block is closed when its texts reach this many characters.
BLOCK_CHARS = 24_000_000
#: Entries of all vocabularies that one range of hashes holds on average.
BUCKET_WORDS = 500_000

_BLOCK = "block long, doc_ids array<long>, n_bytes array<long>, special array<long>, entries array<binary>, n_words long, vocabulary binary"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 3)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _planes(a: np.ndarray) -> bytes:
    """uint32 values by byte plane, which compresses far better than value by value."""
    return _pack(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _pack_words(words: list[str]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    return zstandard.compress(len(words).to_bytes(4, "little") + lengths + "".join(words).encode(), 3)


def _unpack_words(b: bytes) -> list[str]:
    raw = zstandard.decompress(b)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64).tolist()
    text = raw[4 + 4 * n :].decode()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Block:
    """Documents gathered until they are closed into one row."""

    def __init__(self, tok, marks):
        self.tok = tok
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.number: defaultdict = defaultdict(count().__next__)
        self.ids, self.n_bytes, self.special = [], [], []
        self.at, self.times, self.length = [], [], []
        self.chars = 0

    def add(self, doc_id, text: str) -> None:
        n_special = 0
        if self.marks is not None and self.marks.search(text):
            parts = self.marks.split(text)
            n_special = len(parts) - 1
            found = sum((pieces(self.tok, p) for p in parts), Counter())
        else:
            found = pieces(self.tok, text)
        self.at.append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))
        self.length.append(len(found))
        self.ids.append(doc_id)
        self.n_bytes.append(len(text.encode()))
        self.special.append(n_special)
        self.chars += len(text)

    def close(self, block: int) -> dict:
        flat, owner = cut_all(self.tok, list(self.number))
        by_owner = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by_owner], np.arange(len(self.number) + 1))
        words: defaultdict = defaultdict(count().__next__)
        flat_words = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))[by_owner]
        # Order the vocabulary by hash, then by word, so that counts of ranges of hashes can be laid end to end.
        names = sorted(words)
        by_hash = np.argsort(_hashes(names), kind="stable")
        place = np.empty(len(names), np.int64)
        place[np.fromiter(map(words.__getitem__, names), np.int64, len(names))[by_hash]] = np.arange(len(names))
        flat_words = place[flat_words]
        # Pieces of documents become pre-tokens of documents.
        at = np.concatenate(self.at)
        n = cuts[at + 1] - cuts[at]
        start = np.repeat(cuts[at] - (np.cumsum(n) - n), n)
        key = np.repeat(np.repeat(np.arange(len(self.ids)), self.length), n) * max(1, len(names))
        key += flat_words[start + np.arange(len(start))]
        order = np.argsort(key, kind="stable")
        key, freq = key[order], np.repeat(np.concatenate(self.times), n)[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        # Ascending (document, word) keys, kept as steps.
        steps = np.diff(key[new], prepend=0)
        freq = np.add.reduceat(freq, new) if len(new) else freq
        entries = [_planes(steps & 0xFFFFFFFF), _planes(steps >> 32), _planes(freq)]
        return {
            "block": block, "doc_ids": self.ids, "n_bytes": self.n_bytes, "special": self.special,
            "entries": entries, "n_words": len(names), "vocabulary": _pack_words([names[i] for i in by_hash]),
        }


def _blocks(path: str, block_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        marks = specials(tok)
        number = TaskContext.get().partitionId() << 32
        block = _Block(tok, marks)
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array):
                block.add(None if pd.isna(doc_id) else int(doc_id), "" if pd.isna(text) else text)
                if block.chars >= block_chars:
                    yield pd.DataFrame([block.close(number)])
                    number, block = number + 1, _Block(tok, marks)
        if block.ids:
            yield pd.DataFrame([block.close(number)])

    return run


def _ranges(buckets: int):
    """The vocabulary of each block, cut where one range of hashes ends and the next begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, packed in zip(pdf["block"], pdf["vocabulary"]):
                words = _unpack_words(packed)
                bucket = _hashes(words) * buckets >> 32
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                cuts = [*first.tolist(), len(words)]
                yield pd.DataFrame(
                    {"block": block, "bucket": bucket[first].astype(np.int32), "words": [_pack_words(words[a:z]) for a, z in zip(cuts, cuts[1:])]}
                )

    return run


def _piece_counts(path: str):
    """For one range of hashes: tokenise each distinct pre-token once, and answer every block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tok = tokenizer(path)
        lists = [_unpack_words(b) for b in pdf["words"]]
        index: dict[str, int] = {}
        for words in lists:
            for w in words:
                index.setdefault(w, len(index))
        distinct, counts = list(index), []
        for i in range(0, len(distinct), 20_000):
            some = distinct[i : i + 20_000]
            owner = tok.encode(some, is_pretokenized=True, add_special_tokens=False).word_ids
            counts.append(np.bincount(np.array(owner, np.int64), minlength=len(some)))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        answers = [_planes(n[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]) for words in lists]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "counts": answers})

    return run


def _sums(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """For one block: pieces times frequencies, by document."""
    answers = answers.sort_values("bucket")
    out = []
    for b in blocks.itertuples(index=False):
        n = [_unplanes(x) for x in answers["counts"]]
        n = np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)
        low, high, freq = (_unplanes(x).astype(np.int64) for x in b.entries)
        key = np.cumsum(low | (high << 32))
        width = max(1, b.n_words)
        total = np.bincount(key // width, n[key % width] * freq if len(key) else None, len(b.doc_ids)) if len(key) else np.zeros(len(b.doc_ids))
        out.append(
            pd.DataFrame(
                {
                    "doc_id": pd.array([None if x is None or x != x else int(x) for x in b.doc_ids], "Int64"),
                    "n_bytes": np.asarray(b.n_bytes, np.int64),
                    "n_tokens": total.astype(np.int64) + np.asarray(b.special, np.int64),
                }
            )
        )
    return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_bytes": [], "n_tokens": []})


def count_tokens(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8) and n_tokens.

    ``vocabulary`` is the path of a byte-level BPE ``tokenizer.json``.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(rows.mapInPandas(_blocks(path, block_chars), _BLOCK), "token-blocks")
    entries = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    answers = (
        blocks.select("block", "vocabulary")
        .mapInPandas(_ranges(int(entries // bucket_words) + 1), "block long, bucket int, words binary")
        .groupBy("bucket")
        .applyInPandas(_piece_counts(path), "block long, bucket int, counts binary")
    )
    return (
        blocks.drop("vocabulary")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(_sums, "doc_id long, n_bytes long, n_tokens long")
    )


def query(spark, sf_dir: str) -> DataFrame:
    counts = count_tokens(tables.read(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
