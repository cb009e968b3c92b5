"""BPE encoding and decoding by batched numpy merge rounds.

The distinct words of a batch of texts are encoded together: their symbols lie
end to end in one array.  A round looks up every adjacent pair by binary search
over the sorted pair keys of the vocabulary, takes the lowest rank in each word
and merges it there; words without a known pair leave.  Words that were encoded
before are taken from a table of bounded size.

Defined results: a very long text is encoded whole, by itself; a null text counts as empty and gives no ids and an empty
decoded text; special strings inside a text become their single id; a null id
or a repeated row is passed on as it is; an empty table gives an empty result.
Of pairs with equal rank the leftmost is merged first.  Other columns than the id and the text, whatever their names, are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.llm.pretokens import AGREED, specials, tokenizer

#: Chunks remembered between batches of a task; beyond it the table starts anew.
REMEMBERED = 300_000
#: UTF-8 bytes of the rows answered at a time, so that long texts do not gather in memory.
SLICE_BYTES = 2_500_000

#: Fixed value: the word pattern of the tokenizer with word ends.
WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: The same, and the spaces between chunks.
WORD_OR_SPACE = regex.compile(WORD.pattern + "| ")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary; spaces and line ends, which no word holds, stay."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(shown))} | {10: 10, 32: 32}


BYTE_LETTERS = _byte_letters()


class Merges:
    """The vocabulary of a tokenizer.json as arrays, and the rounds over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        self.names = [""] * self.size
        for name, i in vocab.items():
            self.names[i] = name
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs))
        # What a merge makes can be part of an earlier merge only if it has a second way of being made.
        first_use = np.full(self.size, len(pairs))
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        self.one_by_one = first_use[made] < rank
        self.made = made
        keys = left * self.size + right
        last = {int(k): i for i, k in enumerate(keys)}  # of repeated pairs the last holds
        self.keys = np.array(sorted(last), np.int64)
        self.rank = np.array([last[int(k)] for k in self.keys], np.int64)
        self.vocab = vocab

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol ids of all words end to end, and each word's first place (and the end)."""
        vocab, end = self.vocab, self.end
        ids: list[int] = []
        starts = [0]
        for w in words:
            ids += [vocab[c] for c in w[:-1]]
            ids.append(vocab[w[-1] + end])
            starts.append(len(ids))
        return np.array(ids, np.int64), np.array(starts, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words end to end, and where each word's begin (and the end)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        sym, starts = self.symbols(words)
        owner = np.repeat(np.arange(len(words)), np.diff(starts))
        done_sym, done_owner = [], []
        none = len(self.made)
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            length = np.diff(np.append(first, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, first), length)
            active = best < none
            done_sym.append(sym[~active])
            done_owner.append(owner[~active])
            sym, owner, rank, best = sym[active], owner[active], rank[active], best[active]
            if not len(sym):
                break
            hit = rank == best
            # Of pairs that overlap, as in "aaa", every second one from the left of its run.
            runs = np.flatnonzero(hit)
            new = np.flatnonzero(np.diff(runs, prepend=-2) != 1)
            depth = np.arange(len(runs)) - np.repeat(new, np.diff(np.append(new, len(runs))))
            runs = runs[depth % 2 == 0]
            careful = self.one_by_one[best[runs]]
            if careful.any():  # only the first of the word
                lead = np.flatnonzero(np.diff(owner[runs], prepend=-1))
                keep = ~careful
                keep[lead] = True
                runs = runs[keep]
            sym[runs] = self.made[best[runs]]
            stay = np.ones(len(sym), bool)
            stay[runs + 1] = False
            sym, owner = sym[stay], owner[stay]
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        return sym[order].astype(np.int32), np.concatenate(([0], ends))


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from ``start`` on, end to end."""
    return flat[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())]


_merges: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _merges:
        _merges[path] = Merges(path)
    return _merges[path]


class Encoder:
    """Encodes texts; remembers the ids of chunks between single spaces.

    The normaliser and the word pattern treat the text on either side of a
    space alone, so a chunk's ids do not depend on its neighbours.
    """

    def __init__(self, path: str):
        self.tok, self.merges = tokenizer(path), merges(path)
        marks = specials(self.tok)
        self.mark_ids = {m: self.tok.token_to_id(m) for m in marks}
        self.names = self.merges.names + [""] * (1 + max(self.mark_ids.values(), default=0) - len(self.merges.names))
        for m, i in self.mark_ids.items():
            self.names[i] = m
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.forget()

    def forget(self) -> None:
        """Start anew with the special strings alone."""
        self.number = {m: i for i, m in enumerate(self.mark_ids)}
        self.shown = list(self.mark_ids)
        self.flat = np.array(list(self.mark_ids.values()), np.int32)
        self.length = np.ones(len(self.mark_ids), np.int64)

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isprintable():
            return WORD.findall(chunk.lower())
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(chunk))]

    def cut_all(self, new: list[str]) -> tuple[list[str], dict[str, int], np.ndarray]:
        """(chunks in an order of their own, numbers of their distinct words, number of each word, -1 behind each chunk): plain chunks are cut together, between spaces."""
        plain, marked, rest = [], [], []
        for c in new:
            (plain if c.isascii() and c.isprintable() else marked if c.split() == [c] else rest).append(c)
        shown = self.tok.normalizer.normalize_str(" ".join(marked)).split(" ") if marked else []
        if len(shown) != len(marked):  # a normaliser that makes or takes spaces
            rest, marked, shown = rest + marked, [], []
        known = [max(s, default=" ") < AGREED and s.split() == [s] for s in shown]
        rest += [c for c, k in zip(marked, known) if not k]
        marked, shown = [c for c, k in zip(marked, known) if k], [s for s, k in zip(shown, known) if k]
        text = [" ".join(plain).lower(), *shown] if plain else shown
        found = WORD_OR_SPACE.findall(" ".join([*text, ""])) if text else []
        # The pattern sees letters; bytes take their place once words are cut.
        names = list(dict.fromkeys(found))
        as_bytes = "\n".join(names).encode().decode("latin-1").translate(BYTE_LETTERS).split("\n")
        place: dict[str, int] = {}
        code = {w: -1 if w == " " else place.setdefault(b, len(place)) for w, b in zip(names, as_bytes)}
        others: list[int] = []
        for c in rest:
            others += [place.setdefault(w, len(place)) for w in self.words(c)]
            others.append(-1)
        used = np.fromiter(map(code.__getitem__, found), np.int64, len(found))
        return [*plain, *marked, *rest], place, np.concatenate((used, np.array(others, np.int64)))

    def learn(self, new: list[str]) -> None:
        """Encode chunks that are not in the table, each word among them once."""
        new, place, used = self.cut_all(new)
        behind = used < 0
        owner, used = (np.cumsum(behind) - behind)[~behind], used[~behind]
        n_words = np.bincount(owner, minlength=len(new))
        flat, at = self.merges.encode(list(place))
        names = self.names
        pieces = [names[i] for i in flat.tolist()]
        cuts = at.tolist()
        shown = [" ".join(pieces[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        size = np.diff(at)
        self.number.update(zip(new, range(len(self.shown), len(self.shown) + len(new))))
        words, first = used.tolist(), np.cumsum(n_words) - n_words
        self.shown += [shown[words[f]] if n == 1 else " ".join([shown[i] for i in words[f : f + n]]) for f, n in zip(first.tolist(), n_words.tolist())]
        self.flat = np.concatenate((self.flat, gather(flat, at[used], size[used])))
        self.length = np.concatenate((self.length, np.bincount(owner, size[used], len(new)).astype(np.int64)))
        self.start = np.cumsum(self.length) - self.length

    def chunks(self, text: str) -> list[str]:
        if self.marks is None or not self.marks.search(text):
            return text.split(" ")
        out: list[str] = []
        for part in self.marks.split(text):
            out += [part] if part in self.mark_ids else part.split(" ")
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The ids of all texts end to end, how many each has, and what each decodes to."""
        cut = [self.chunks(t) for t in texts]
        if len(self.number) > REMEMBERED:
            self.forget()
        new: set[str] = set().union(*cut)
        new.difference_update(self.number)
        self.learn(list(new))
        number, shown = self.number, self.shown
        n_chunks = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(n_chunks.sum()))
        ids = gather(self.flat, self.start[at], self.length[at])
        n_ids = np.bincount(np.repeat(np.arange(len(cut)), n_chunks), self.length[at], len(cut)).astype(np.int64)
        decoded, a, places = [], 0, at.tolist()
        for n in n_chunks.tolist():
            decoded.append(" ".join([s for i in places[a : a + n] if (s := shown[i])]))
            a += n
        return ids, n_ids, decoded


def encode_documents(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, ``ids`` (array of int) and ``decoded``, the text that the ids decode to.

    ``vocabulary`` is the path of a BPE ``tokenizer.json`` with word ends.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            doc_id, column = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            a = 0
            while a < len(sizes):
                z, size = a, 0
                while z < len(sizes) and (z == a or size + sizes[z] <= SLICE_BYTES):
                    size += sizes[z]
                    z += 1
                ids, n_ids, decoded = encoder.encode(["" if t is None else t for t in column.slice(a, z - a).to_pylist()])
                ends = np.concatenate(([0], np.cumsum(n_ids))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [doc_id.slice(a, z - a), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
                )
                a = z

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode_ids(frame: DataFrame, vocabulary: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``frame`` with a column ``decoded``: what an array of ids decodes to (null: empty)."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        names = Encoder(path).names
        return ids.map(lambda x: "" if x is None else " ".join([names[i] for i in x]))

    return frame.withColumn("decoded", decode(F.col(ids_col)))


def query(spark, sf_dir: str) -> DataFrame:
    encoded = encode_documents(tables.read(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
