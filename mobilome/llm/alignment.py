"""How the tokens of two tokenizers meet on the same texts.

Tokenizer A is a byte-level BPE and tokenizer B a SentencePiece BPE with byte fallback; both cut the bytes of a space and
the text.  Where both end a token, the tokens fall into groups; an A and a B token whose byte ranges overlap are a link.

A text is cut before every space that follows a solid character.  No token of either tokenizer runs over such a cut, and
nothing beyond it changes how the rest is cut, so a stretch between two cuts (a chunk) is encoded once for all its
occurrences in a block of texts, together with others.  A block is one row: its chunks with their tokens, groups and links, the
chunk numbers of its texts, and how often each pair is linked in it.  It is closed at a bounded number of characters or chunks, and
the texts are read once.

The links of the corpus are counted as packed int64 keys, B id first: ``np.unique`` gives a block's partial counts, a range
partitioning by key sorts them globally, and runs of equal keys are summed into sorted shards in the shared folder.  Every
task maps the shards into memory and finds the counts of its blocks' links by binary search; no worker holds them.  There are at
most |A| x |B| keys however large the corpus is, and one number a B id comes to the driver.

Defined results: a text that is null, empty, or whose tokens do not spell a space and the text (one that holds U+2581) has
no tokens, and its links count nowhere; special strings inside a text are plain text; a very long text is read whole; a
null id or a repeated row is passed on as it is, and its links count as often as it occurs; tied counts are all best; an
empty table gives an empty result; other columns, whatever their names, are not read.

The shared folder must be a path that every machine has mounted, since its files are mapped into memory.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.llm.packing import give_back, packed, packed_texts, unpacked, unpacked_texts
from mobilome.storage import materialize, shared_dir

#: A block is closed when its texts reach this many characters, or its chunks this many.
BLOCK_CHARS, BLOCK_CHUNKS = 8_000_000, 100_000
#: Characters of new chunks that are encoded in one call.
CALL_CHARS = 200_000
#: Characters read, chunk occurrences answered, and rows turned into strings, at a time.
SLICE_CHARS, SLICE_CHUNKS, SLICE_ROWS = 1_000_000, 200_000, 500
#: Pairs that a shard of counts holds on average (16 bytes each).
SHARD_PAIRS = 4_000_000

#: Characters that are white space to some library; a space after one of them is no cut.
LOOSE = re.compile(r"[\s\u0085\u180e\u200b-\u200d\u2060\ufeff]")
UNSAFE = re.compile(r"(?:\A|[\s\u0085\u180e\u200b-\u200d\u2060\ufeff])(?: |\Z)")


def chunks(text: str) -> list[str]:
    """The stretches of a space and ``text`` between two cuts, each without the space that it opens with."""
    parts = text.split(" ")
    if not UNSAFE.search(text):
        return parts
    out, run = [], []
    for p in parts:
        run.append(p)
        if p and not LOOSE.match(p[-1]):
            out.append(" ".join(run))
            run = []
    return out + [" ".join(run)] if run else out


class Aligner:
    """Tokens, groups and links of the chunks of a block, in arrays with one stretch a chunk."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_a = self.a.get_vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(self.n_a)]
        code = _byte_of()
        self.a_bytes = [bytes(code[c] for c in x) if all(c in code for c in x) else x.encode() for x in names]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # A token's text by what follows it: another of its side and group, or the end of both.
        self.a_shown, self.b_shown = (
            np.array([[f"{i}{end}" for i in range(n)] for end in ends], object)
            for n, ends in ((self.n_a, ",|"), (len(self.b_bytes), ",;"))
        )
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[str] = []
        self.facts = np.zeros((4, 0), np.int64)  # n_a, n_b, n_groups and n_links of each chunk
        self.bad = np.zeros(0, bool)
        self.links = np.zeros(0, np.int64)

    def _encode(self, joined: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides for a text that opens with a space; None unless both spell it."""
        a = self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids
        b = self.b.encode(joined[1:]) if len(joined) > 1 else [self.b.piece_to_id("▁")]  # of an empty text the model makes nothing
        raw = joined.encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def learn(self, new: list[str]) -> None:
        if not new:
            return
        a_ids, b_ids, sizes, bad = [], [], [], []

        def take(group: list[str]) -> None:
            if not group:
                return
            found = self._encode(" " + " ".join(group))
            if found is None and len(group) > 1:  # a text in it cannot be spelt: look for it
                half = len(group) // 2
                take(group[:half])
                take(group[half:])
                return
            bad.extend([found is None] * len(group))
            sizes.extend([0] * len(group) if found is None else [len(c.encode()) + 1 for c in group])
            if found is not None:
                a_ids.append(found[0])
                b_ids.append(found[1])

        # What ends in white space is the end of a text and stays by itself, since what follows would change its cut.
        alone = [c for c in new if not c or LOOSE.match(c[-1])]
        together = [c for c in new if c and not LOOSE.match(c[-1])] if alone else new
        group, chars = [], 0
        for c in together:
            group.append(c)
            chars += len(c)
            if chars > CALL_CHARS:
                take(group)
                group, chars = [], 0
        take(group)
        for c in alone:
            take([c])
        order = together + alone if alone else new
        self.number.update(zip(order, range(len(self.bad), len(self.bad) + len(order))))
        self._lay(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_ids, b_ids)), np.array(sizes, np.int64), np.array(bad, bool))

    def _lay(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, bad: np.ndarray) -> None:
        """Add chunks of ``sizes`` bytes, whose tokens lie end to end, to the table."""
        n = len(sizes)
        end = np.cumsum(sizes)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_start, b_start = a_end - self.a_len[a], b_end - self.b_len[b]
        a_chunk, b_chunk = np.searchsorted(end, a_end), np.searchsorted(end, b_end)
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        low = np.searchsorted(b_end, a_start, "right")
        width = np.searchsorted(b_start, a_end, "left") - low
        left = np.repeat(np.arange(len(a)), width)
        right = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(len(left))
        n_links = np.bincount(a_chunk[left], minlength=n)
        facts = [np.bincount(x, minlength=n) for x in (a_chunk, b_chunk, np.searchsorted(end, both))]
        # One list of texts, group by group, A before B.
        last_a, last_b = (np.append(np.diff(g) > 0, True) if len(g) else np.zeros(0, bool) for g in (a_group, b_group))
        pieces = np.concatenate((self.a_shown[last_a.astype(int), a], self.b_shown[last_b.astype(int), b]))
        pieces = pieces[np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")].tolist()
        cuts = np.concatenate(([0], np.cumsum(facts[0] + facts[1]))).tolist()
        self.shown += ["".join(pieces[x:y]) for x, y in zip(cuts, cuts[1:])]
        self.facts = np.hstack((self.facts, np.array([*facts, n_links], np.int64)))
        self.bad = np.concatenate((self.bad, bad))
        self.links = np.concatenate((self.links, b[right] * self.n_a + a[left]))

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk numbers of all texts end to end, how many each text has, and which texts have no tokens."""
        cut = [chunks(t) if t else [] for t in texts]
        self.learn(list(set().union(*cut).difference(self.number)))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        void = (n == 0) | (np.bincount(np.repeat(np.arange(len(n)), n), self.bad[at], len(n)) > 0)
        return at, n, void


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on in order."""
    plain = [x for x in range(256) if 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xFF and x != 0xAD]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(rest)}


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    """One for each pair of tokenizers and process."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        z, chars = a, 0
        while z < len(texts) and (z == a or chars + len(texts[z] or "") <= SLICE_CHARS):
            chars += len(texts[z] or "")
            z += 1
        yield a, z
        a = z


_BLOCK = "doc_ids array<long>, n_chunks binary, void binary, at binary, facts binary, links binary, shown binary, pairs binary, counts binary, n_pairs long"


class _Block:
    """Texts gathered until they are closed into one row."""

    def __init__(self, aligner: Aligner):
        aligner.forget()
        self.aligner, self.ids, self.chars = aligner, [], 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list, texts: list[str | None]) -> bool:
        """Whether the block is full now."""
        at, n, void = self.aligner.read(texts)
        self.parts.append((at.astype(np.int32), n, void))
        self.ids += ids
        self.chars += sum(len(t or "") for t in texts)
        return self.chars >= BLOCK_CHARS or len(self.aligner.bad) >= BLOCK_CHUNKS

    def close(self) -> pa.RecordBatch:
        aligner = self.aligner
        at, n, void = (np.concatenate(x) for x in zip(*self.parts))
        times = np.bincount(at[~np.repeat(void, n)], minlength=len(aligner.bad))
        # Sorted in place of numbering every link: the weights go along, and runs of equal keys are added up.
        order = np.argsort(aligner.links)
        keys, counts = aligner.links[order], np.repeat(times, aligner.facts[3])[order]
        del order
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        used = counts > 0
        row = {
            "doc_ids": self.ids, "n_chunks": packed(n), "void": packed(void, "u1"), "at": packed(at, "<u4"), "facts": packed(aligner.facts.ravel(), "<u4"),
            "links": packed(aligner.links), "shown": packed_texts(aligner.shown), "pairs": packed(np.diff(keys[used], prepend=0)), "counts": packed(counts[used]),
            "n_pairs": int(used.sum()),
        }
        types = [pa.list_(pa.int64()), *[pa.binary()] * 8, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))


def _blocks(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(_aligner(paths))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                ids, texts = (batch.column(i).slice(at, SLICE_ROWS).to_pylist() for i in range(2))
                for a, z in _slices(texts):
                    if block.add(ids[a:z], texts[a:z]):
                        yield block.close()
                        block = _Block(block.aligner)
                        give_back()
        if block.ids:
            yield block.close()
        # The worker lives on for other tasks, which must not find the last block's tables beside their own.
        block.aligner.forget()
        del block
        give_back()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            keys, n = (batch.column(i)[row].as_py() for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(unpacked(keys))), pa.array(unpacked(n))], ["pair", "n"])


def _shards(folder: str, n_a: int):
    """Sum runs of equal keys of one range, write them as a sorted shard, and tell where it is and each B id's highest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        keys, n = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in found]) for i in (0, 1))
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        pairs = np.stack((keys[first], np.add.reduceat(n, first)))
        path = f"{folder}/{uuid.uuid4().hex}.npy"
        with open(f"{path}.part", "wb") as f:
            np.save(f, pairs)
        os.replace(f"{path}.part", path)
        b = pairs[0] // n_a
        own = np.flatnonzero(np.diff(b, prepend=-1))
        best = pa.ListArray.from_arrays([0, len(own)], pa.array(np.maximum.reduceat(pairs[1], own)))
        ids = pa.ListArray.from_arrays([0, len(own)], pa.array(b[own]))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0][:1]), pa.array([path]), ids, best], ["first", "path", "b", "best"])

    return run


def _mounted(uri: str) -> str:
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise RuntimeError(f"counts of pairs are mapped into memory: the shared folder {uri} must be mounted on every machine")
    return at.path


class Counts:
    """The sorted shards, mapped into memory, and the highest count of each B id."""

    def __init__(self, shards: list[tuple[int, str]], best: np.ndarray):
        self.first = np.array([f for f, _ in shards], np.int64)
        self.paths = [p for _, p in shards]
        self.best = best
        self.open: dict[int, np.ndarray] = {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys; 0 for those that only texts without tokens hold."""
        out = np.zeros(len(keys), np.int64)
        if not self.paths:
            return out
        shard = np.maximum(np.searchsorted(self.first, keys, "right") - 1, 0)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
        for x, y in zip(cuts, [*cuts[1:], len(keys)]):
            s = int(shard[x])
            if s not in self.open:
                self.open[s] = np.load(self.paths[s], mmap_mode="r")
            pairs = self.open[s]
            place = np.minimum(np.searchsorted(pairs[0], keys[x:y]), pairs.shape[1] - 1)
            out[x:y] = np.where(pairs[0][place] == keys[x:y], pairs[1][place], 0)
        return out



def count_pairs(blocks: DataFrame, n_a: int, n_b: int, shard_pairs: int = SHARD_PAIRS) -> Counts:
    """The counts of all linked id pairs of written blocks, as sorted shards in the shared folder."""
    spark = blocks.sparkSession
    rows = blocks.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0]
    folder = f"{_mounted(shared_dir(spark))}/mobilome/{spark.sparkContext.applicationId}/pairs-{uuid.uuid4().hex}"
    os.makedirs(folder)
    shards = (
        blocks.select("pairs", "counts").mapInArrow(_pairs, "pair long, n long")
        .repartitionByRange(int(rows // shard_pairs) + 1, "pair").sortWithinPartitions("pair")
        .mapInArrow(_shards(folder, n_a), "first long, path string, b array<long>, best array<long>")
        .collect()
    )
    best = np.zeros(n_b, np.int64)
    for s in shards:
        np.maximum.at(best, np.array(s["b"]), np.array(s["best"]))
    return Counts(sorted((s["first"], s["path"]) for s in shards), best)


_FACTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _answers(shards: list[tuple[int, str]], best: np.ndarray, n_a: int):
    """Give the links of a block their counts, and add up its chunks by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counts(shards, best)
        for batch in batches:
            for row in range(batch.num_rows):  # one block at a time, also of a batch that holds several
                ids, n, void, at, facts, links, shown = (batch.column(i)[row].as_py() for i in range(7))
                n, void, at, links = unpacked(n), unpacked(void, "u1") > 0, unpacked(at, "<u4"), unpacked(links)
                facts = unpacked(facts, "<u4").reshape(4, -1).astype(np.int64)
                shown = unpacked_texts(shown, facts.shape[1])
                keys, place = np.unique(links, return_inverse=True)
                counts = counted.of(keys)[place]
                is_best = counts == best[links // n_a]
                del links, keys, place
                # The links of a chunk lie side by side.
                every = np.zeros((6, facts.shape[1]), np.int64)
                every[:4] = facts
                has = np.flatnonzero(facts[3])
                if len(has):
                    first = (np.cumsum(facts[3]) - facts[3])[has]
                    every[4, has], every[5, has] = np.add.reduceat(is_best, first, dtype=np.int64), np.add.reduceat(counts, first)
                del counts, is_best
                ends = np.cumsum(n)
                a = 0
                while a < len(n):
                    start = int(ends[a] - n[a])
                    z = max(a + 1, int(np.searchsorted(ends, start + SLICE_CHUNKS)))
                    own = at[start : ends[z - 1]]
                    sums = np.zeros((6, z - a), np.int64)
                    full = np.flatnonzero(n[a:z])
                    if len(full):
                        sums[:, full] = np.add.reduceat(every[:, own], (ends[a:z] - n[a:z] - start)[full], axis=1)
                    sums[:, void[a:z]] = 0
                    texts = list(map(shown.__getitem__, own.tolist()))
                    cuts = zip((ends[a:z] - n[a:z] - start).tolist(), (ends[a:z] - start).tolist(), void[a:z].tolist())
                    groups = ["" if none else "".join(texts[x:y])[:-1] for x, y, none in cuts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a:z], pa.int64()), *map(pa.array, sums), pa.array(groups, pa.string())], ["doc_id", *_FACTS, "groups"]
                    )
                    a = z
                del at, facts, every, shown
            give_back()

    return run


def align(
    docs: DataFrame, byte_bpe: str | None = None, piece_bpe: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_pairs: int = SHARD_PAIRS
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and ``groups``, the aligned ids as ``a1,a2|b1;a3|b2,b3``.

    ``byte_bpe`` is the path of a byte-level BPE ``tokenizer.json`` and ``piece_bpe`` that of a SentencePiece model.
    ``n_best`` counts links whose pair is the most frequent of its B id in the corpus, ``count_sum`` adds up the counts of all links.
    """
    paths = (byte_bpe or public_tokenizers.path("byte_bpe_50k.json"), piece_bpe or public_tokenizers.path("piece_bpe_32k.model"))
    aligner = _aligner(paths)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # A block is a row group, so that neither its writer nor any reader holds another one beside it.
    blocks = materialize(rows.mapInArrow(_blocks(paths), _BLOCK), "aligned-blocks", **{"parquet.block.row.count.limit": 1})
    counts = count_pairs(blocks, aligner.n_a, len(aligner.b_bytes), shard_pairs)
    return blocks.select("doc_ids", "n_chunks", "void", "at", "facts", "links", "shown").mapInArrow(
        _answers(list(zip(counts.first.tolist(), counts.paths)), counts.best, aligner.n_a),
        "doc_id long, " + ", ".join(f"{x} long" for x in _FACTS) + ", groups string",
    )


def query(spark, sf_dir: str) -> DataFrame:
    aligned = align(tables.read(spark, sf_dir, "documents"))
    return aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
