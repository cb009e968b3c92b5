"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Words and an end mark are the tokens of a document.  The model gives P(token | context) = P(class | context) x P(token |
class, context).  The most frequent words share classes of ``SLOTS`` words each, in order of their count; a rarer word belongs to one of ``TAILS``
classes by its last letters, and within it has its share of the counts plus one.  Both softmaxes are log-linear: a
bias from the counts, and one row of weights for each feature of the context (the word before, the pair before, the word before
that skipping one), where feature, and class in the second softmax, are hashed to a row of one table.  Rarer words stand in
features for their class.

Everything is learnt from all training documents, whatever their number:

1. Documents are read once, in blocks of bounded size that hold token numbers and the block's vocabulary.
2. Vocabularies are dealt by ranges of hashes; each distinct word is counted once for the corpus and answered to its blocks.
3. Blocks become codes: a word's rank among the most frequent, or its rare class; base scores come from the answers.
4. In every round each task makes gradient updates (Adagrad, mini-batches) on its share of the training documents,
   starting from the weights of the round before; the updates of all tasks are averaged row by row in the cluster, weighted by
   how many tokens touched the row, a bounded number at a time.  Each document is trained on in one round.
5. Blocks are scored in numpy batches.

The driver holds the weights (2^``BITS`` x ``SLOTS`` numbers) and the frequent words, whose sizes are parameters; the broadcast is of that size too.

Defined results: a null text is empty, and an empty text has the end mark alone; a null id is not held out; a very long text is
read whole and closes its block; repeated rows count as often as they occur; of words with equal counts the smaller bytes come
first in rank; without training documents all tokens are unknown (base 0, the model's classes even); an empty table gives an empty
result; other columns, whatever their names, are not read.  Scores depend in their last places on how documents are dealt over tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.llm.labelled import held_out
from mobilome.llm.packing import packed, unpacked
from mobilome.storage import discard, materialize

FOLD = (7, 2)
#: Classes of frequent words, words in each, and classes of rarer words.
CLASSES, SLOTS, TAILS = 48, 64, 16
FREQUENT = CLASSES * SLOTS
#: Rows of the weight table, as a power of two that 16 bits can hold.
BITS = 16
ROUNDS, BATCH, RATE = 2, 4_096, 0.15
#: A weight is no further from 0 than this.
MOST = 25.0
#: A block is closed when its texts reach this many characters.
BLOCK_CHARS = 24_000_000
#: Entries of all vocabularies that one range of hashes holds on average.
BUCKET_WORDS = 500_000
#: Parts that the weight table is averaged in, and updates that one task averages at most.
PARTS, FAN = 64, 64
#: Rows of a batch whose gradients are summed one row at a time.
FEW = 16
#: Tokens scored at a time.
SCORED = 4_096

#: The end mark as a word: no word is empty.
END = b""


def tail_of(word: bytes) -> int:
    """The class of a rarer word, by its last three bytes."""
    return zlib.crc32(word[-3:]) % TAILS


# --- blocks of documents

_BLOCK = "block long, doc_ids array<long>, n_tokens binary, held binary, at binary, n_words long, words binary, counts binary"


class _Block:
    def __init__(self):
        self.number: defaultdict = defaultdict(count().__next__)
        self.ids, self.held, self.n, self.at, self.chars = [], [], [], [], 0

    def add(self, doc_id: int | None, held: bool, text: str | None) -> None:
        # Lower-casing bytes changes A-Z alone, and bytes are cut at the six characters of white space.
        tokens = (text or "").encode().lower().split()
        tokens.append(END)
        self.ids.append(doc_id)
        self.held.append(held)
        self.n.append(len(tokens))
        self.at.append(np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens)))
        self.chars += len(text or "")

    def close(self, block: int) -> pa.RecordBatch:
        words = list(self.number)
        hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        n, at = np.array(self.n), place[np.concatenate(self.at)]
        counts = np.bincount(at[~np.repeat(self.held, n)], minlength=len(words))
        row = {
            "block": block, "doc_ids": self.ids, "n_tokens": packed(n), "held": packed(np.array(self.held), "u1"), "at": packed(at, "<u4"),
            "n_words": len(words), "words": b"\n".join([words[i] for i in order.tolist()]), "counts": packed(counts, "<u4"),
        }
        types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))


def _blocks(block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block.add(*row)
                if block.chars >= block_chars:
                    yield block.close(number)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.close(number)

    return run


# --- counts of words

_COUNTED = "block long, bucket int, counts binary, words binary, n long, v long, mass array<long>"


def _ranges(buckets: int):
    """The vocabulary of each block, cut where one range of hashes ends and the next begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, counts = words.split(b"\n"), unpacked(counts, "<u4")
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * buckets >> 32
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                cuts = [*first.tolist(), len(words)]
                spans = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(spans), pa.int64()), pa.array(bucket[first].astype(np.int32)),
                        pa.array([b"\n".join(words[a:z]) for a, z in spans], pa.binary()), pa.array([packed(counts[a:z], "<u4") for a, z in spans], pa.binary()),
                    ],
                    ["block", "bucket", "words", "counts"],
                )

    return run


def _merged(frequent: int):
    """For one range: count each distinct word once, answer every block, and sum up the range (as block -1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [b.split(b"\n") for b in pdf["words"]]
        index: dict[bytes, int] = {}
        places = [np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)) for words in lists]
        total = np.zeros(len(index), np.int64)
        for place, counts in zip(places, pdf["counts"]):
            total[place] += unpacked(counts, "<u4")
        words = list(index)
        known = np.flatnonzero(total)
        mass = np.bincount([tail_of(words[i]) for i in known.tolist()], total[known] + 1, TAILS).astype(np.int64)
        if len(known) > frequent:
            least = np.partition(total[known], len(known) - frequent)[len(known) - frequent]
            known_top = known[total[known] >= least]
        else:
            known_top = known
        top = sorted(((-int(total[i]), words[i]) for i in known_top.tolist()))[:frequent]
        answers = pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "counts": [packed(total[p]) for p in places]})
        answers["words"], answers["n"], answers["v"], answers["mass"] = None, None, None, None
        summary = pd.DataFrame(
            {
                "block": [-1], "bucket": [int(pdf["bucket"].iloc[0])], "counts": [packed(np.array([-n for n, _ in top], np.int64))],
                "words": [b"\n".join([w for _, w in top])], "n": [int(total.sum())], "v": [len(known)], "mass": [mass.tolist()],
            }
        )
        for part in (answers, summary):
            part["n"], part["v"] = part["n"].astype("Int64"), part["v"].astype("Int64")
        return pd.concat([answers.astype({"words": object, "mass": object}), summary])

    return run


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = unpacked(counts)
            yield pa.RecordBatch.from_arrays([pa.array(words.split(b"\n") if len(n) else [], pa.binary()), pa.array(n)], ["word", "n"])


class Counts:
    """What the whole corpus has: tokens, distinct tokens, the frequent words with their counts, and the mass of each rare class."""

    def __init__(self, n: int, v: int, top: list[tuple[bytes, int]], mass: np.ndarray):
        self.n, self.v = n, v
        self.rank = {w: i for i, (w, _) in enumerate(top)}
        # The mass of a rare class is the counts plus one of its words, and one for all unknown words.
        rest = mass.astype(np.float64) + 1
        for w, c in top:
            rest[tail_of(w)] -= c + 1
        self.rest = rest
        own = np.zeros(FREQUENT)
        own[: len(top)] = [c + 1 for _, c in top]
        own = own.reshape(CLASSES, SLOTS)
        weight = np.concatenate([own.sum(1), rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_bias = np.maximum(np.log(weight / weight.sum()), -1e30).astype(np.float32)
            self.slot_bias = np.nan_to_num(np.maximum(np.log(own / own.sum(1, keepdims=True)), -1e30), nan=0.0).astype(np.float32)


# --- codes

_CODED = "doc_ids array<long>, n_tokens binary, held binary, codes binary, base binary, rare binary, known binary"


def _coded(counted: Counts):
    """For one block: codes of its tokens and, by document, base score, the log share of rarer words in their classes, and known tokens."""
    rank, rest, floor = counted.rank, np.log(counted.rest), np.log(counted.n + counted.v + 1)

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        answers = answers.sort_values("bucket")
        for b in blocks.itertuples(index=False):
            words = b.words.split(b"\n")
            total = np.concatenate([unpacked(x) for x in answers["counts"]])
            code = np.fromiter((r if (r := rank.get(w)) is not None else FREQUENT + tail_of(w) for w in words), np.int64, len(words))
            log_count = np.log(total + 1.0)
            rare = code >= FREQUENT
            share = np.where(rare, log_count - rest[np.where(rare, code - FREQUENT, 0)], 0.0)
            at, n = unpacked(b.at, "<u4"), unpacked(b.n_tokens)
            first = np.cumsum(n) - n
            by_doc = [np.add.reduceat(x[at], first) for x in (log_count - floor, share, (total > 0).astype(np.int64))]
            out.append((b.doc_ids, b.n_tokens, b.held, packed(code[at], "<u2"), packed(by_doc[0], "<f8"), packed(by_doc[1], "<f8"), packed(by_doc[2])))
        return pd.DataFrame(out, columns=["doc_ids", "n_tokens", "held", "codes", "base", "rare", "known"])

    return run


# --- the model

#: Codes of what stands before a document's first token, and how many codes there are.
BEFORE = FREQUENT + TAILS
WIDTH = BEFORE + 1


def _row(key: np.ndarray) -> np.ndarray:
    """The row of a feature, by multiplicative hashing."""
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.uint16)


def contexts(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the features of every token: the word before, the word before that, and the pair; documents begin at ``first``."""
    one = np.concatenate(([BEFORE], codes[:-1])).astype(np.int64)
    one[first] = BEFORE
    two = np.concatenate(([BEFORE], one[:-1]))
    two[first] = BEFORE
    return one, WIDTH + two, (one + 1) * (4 * WIDTH) + two


def sums_by_row(rows: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, how often each occurs, and the sum of its lines of ``slope``.

    ``np.add.reduceat`` adds a column of a row at a time; here the second, third, ... lines of all rows that have one are added at once,
    and what the ``FEW`` most frequent rows have beyond that row by row.
    """
    order = np.argsort(rows, kind="stable")
    found = rows[order]
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    n = np.diff(first, append=len(rows))
    by_n = np.argsort(-n, kind="stable")
    first, n = first[by_n], n[by_n]
    grad = slope.take(order[first], 0)
    # more[k]: how many rows occur more than k times; these come first.
    more = len(n) - np.cumsum(np.bincount(n))
    k = 1
    while k < len(more) and (m := int(more[k])) > FEW:
        grad[:m] += slope.take(order[first[:m] + k], 0)
        k += 1
    for i in range(int(more[k]) if k < len(more) else 0):
        grad[i] += slope.take(order[first[i] + k : first[i] + n[i]], 0).sum(0)
    return found[first], n, grad


class Model:
    """One table of weights; ``mass`` is each row's sum of squared gradients, ``touched`` how many tokens it was updated by."""

    def __init__(self, counted: Counts, weights: np.ndarray | None, mass: np.ndarray | None = None):
        self.counted = counted
        self.weights = np.zeros((1 << BITS, SLOTS), np.float32) if weights is None else weights.astype(np.float32)
        self.mass = np.full(1 << BITS, 1e-8, np.float32) if mass is None else mass.astype(np.float32)
        self.touched = np.zeros(1 << BITS, np.int64)

    def softmax(self, rows: list[np.ndarray], bias: np.ndarray, wanted: np.ndarray, train: bool) -> np.ndarray:
        """Log chances of what is wanted; ``bias`` is one row for all or one for each.

        Biases are at most 0, and the largest at least -log(SLOTS + TAILS); with weights within MOST of 0, no sum of exponentials overflows or vanishes.
        """
        logits = self.weights.take(rows[0], 0)
        logits += bias
        for r in rows[1:]:
            logits += self.weights.take(r, 0)
        each = np.arange(len(wanted))
        own = logits[each, wanted]
        np.exp(logits, out=logits)
        total = logits.sum(1)
        if train:
            logits *= (1 / total)[:, None]
            logits[each, wanted] -= 1
            for r in rows:
                self.update(r, logits)
        return own - np.log(total)

    def update(self, rows: np.ndarray, slope: np.ndarray) -> None:
        row, n, grad = sums_by_row(rows, slope)
        self.touched[row] += n
        own = self.mass[row] + np.einsum("ij,ij->i", grad, grad) / SLOTS
        self.mass[row] = own
        grad *= (-RATE / np.sqrt(own))[:, None]
        grad += self.weights.take(row, 0)
        self.weights[row] = np.clip(grad, -MOST, MOST, out=grad)

    def batch(self, codes: np.ndarray, keys: list[np.ndarray], train: bool = False) -> np.ndarray:
        """Log chances of classes and of places in them (of rarer words: of the class alone)."""
        frequent = np.flatnonzero(codes < FREQUENT)
        kind = np.where(codes < FREQUENT, codes // SLOTS, codes.astype(np.int64) - FREQUENT + CLASSES)
        rows = [_row(k + 1) for k in keys]
        chance = self.softmax(rows, self.counted.class_bias, kind, train).astype(np.float64)
        if len(frequent):
            own = kind[frequent]
            rows = [_row(k[frequent] + 1 + ((own + 1) << 42)) for k in keys[:2]]
            chance[frequent] += self.softmax(rows, self.counted.slot_bias[own], codes[frequent] % SLOTS, train)
        return chance

    def train(self, codes: np.ndarray, n: np.ndarray, batch: int = BATCH) -> None:
        """Updates by documents of ``n`` tokens that lie end to end; a batch takes every so many-th token."""
        if not len(codes):
            return
        keys = contexts(codes, np.cumsum(n) - n)
        steps = -(-len(codes) // batch)
        for i in range(steps):
            self.batch(codes[i::steps], [k[i::steps] for k in keys], True)

    def score(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """By document, the sum of log chances."""
        keys = contexts(codes, np.cumsum(n) - n)
        chance = np.concatenate([self.batch(codes[a : a + SCORED], [k[a : a + SCORED] for k in keys]) for a in range(0, len(codes), SCORED)])
        return np.add.reduceat(chance, np.cumsum(n) - n)


_UPDATE = "part int, task long, touched binary, mass binary, weights binary"


def _trained(counted, shared, turn: int, rounds: int):
    """Gradient updates by one task's documents of this turn; what comes out is the change of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mass = shared.value
        model = Model(counted, weights, mass)
        before = model.weights.copy()
        for batch in batches:
            for n, held, codes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, held, codes = unpacked(n), unpacked(held, "u1"), unpacked(codes, "<u2")
                use = (held == 0) & (np.arange(len(n)) % rounds == turn)
                model.train(codes[np.repeat(use, n)], n[use])
        if not model.touched.any():
            return
        model.weights -= before
        size = (1 << BITS) // PARTS
        parts = [slice(i * size, (i + 1) * size) for i in range(PARTS)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, TaskContext.get().partitionId(), np.int64)),
                *(pa.array([packed(x[p].ravel(), kind) for p in parts], pa.binary()) for x, kind in ((model.touched, "<i8"), (model.mass, "<f4"), (model.weights, "<f2"))),
            ],
            ["part", "task", "touched", "mass", "weights"],
        )

    return run


def _averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The updates of one part of the table, weighted by touches."""
    size = (1 << BITS) // PARTS
    touched, mass, weights = np.zeros(size, np.int64), np.zeros(size), np.zeros((size, SLOTS))
    for row in pdf.itertuples(index=False):
        n = unpacked(row.touched)
        touched += n
        mass += n * unpacked(row.mass, "<f4")
        weights += n[:, None] * unpacked(row.weights, "<f2").reshape(size, SLOTS)
    share = np.maximum(touched, 1)
    return pd.DataFrame(
        {
            "part": pdf["part"].iloc[:1], "task": pdf["task"].min(), "touched": [packed(touched)], "mass": [packed(mass / share, "<f4")],
            "weights": [packed((weights / share[:, None]).ravel(), "<f2")],
        }
    )


def train(coded: DataFrame, counted: Counts, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
    """The weights and their masses after all rounds over written codes."""
    spark = coded.sparkSession
    weights = mass = None
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((weights, mass))
        rows = coded.select("n_tokens", "held", "codes")
        updates = materialize(rows.mapInArrow(_trained(counted, shared, turn, rounds), _UPDATE), "updates")
        tasks = updates.agg(F.countDistinct("task")).first()[0]
        while tasks > FAN:
            groups = -(-tasks // FAN)
            fewer = updates.groupBy("part", F.pmod(F.xxhash64("task"), F.lit(groups)).alias("group")).applyInPandas(_averaged, _UPDATE)
            before, updates, tasks = updates, materialize(fewer, "updates"), groups
            discard(before)
        # PARTS rows, together one table of weights whatever the number of documents.
        found = updates.groupBy("part").applyInPandas(_averaged, _UPDATE).toPandas()
        discard(updates)
        shared.unpersist()
        if not len(found):
            continue
        found = found.sort_values("part")
        change = np.concatenate([unpacked(x, "<f2") for x in found["weights"]]).astype(np.float32).reshape(-1, SLOTS)
        seen = np.concatenate([unpacked(x) for x in found["touched"]]) > 0
        new_mass = np.concatenate([unpacked(x, "<f4") for x in found["mass"]])
        weights = change if weights is None else weights + change
        mass = np.where(seen, new_mass, 1e-8 if mass is None else mass).astype(np.float32)
    return weights, mass


def _scored(counted, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counted, shared.value)
        for batch in batches:
            for ids, n, codes, base, rare, known in zip(*(batch.column(i).to_pylist() for i in range(6))):
                n = unpacked(n)
                score = (model.score(unpacked(codes, "<u2"), n) + unpacked(rare, "<f8")) / np.log(10)
                base = unpacked(base, "<f8") / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n), pa.array(unpacked(known)), pa.array(base), pa.array(score)],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def corpus_counts(counts: DataFrame, frequent: int = FREQUENT) -> Counts:
    """The corpus-wide counts of written answers; what comes to the driver is of fixed size."""
    summary = counts.filter("block = -1")
    sums = [F.coalesce(F.sum(F.col("mass")[i]), F.lit(0)).alias(f"m{i}") for i in range(TAILS)]
    n, v, *mass = summary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0)), *sums).first()
    words = summary.select("words", "counts").mapInArrow(_unfold, "word binary, n long")
    top = [(bytes(r["word"]), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(frequent).collect()]
    return Counts(n, v, top, np.array(mass))


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = FOLD, rounds: int = ROUNDS,
    block_chars: int = BLOCK_CHARS, bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score, score (log10) and train_tokens; documents of the fold are not learnt from."""
    spark: SparkSession = docs.sparkSession
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id, *fold).alias("held"), F.col(text_col).alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(block_chars), _BLOCK), "lm-blocks")
    entries = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    counts = materialize(
        blocks.select("block", "words", "counts")
        .mapInArrow(_ranges(int(entries // bucket_words) + 1), "block long, bucket int, words binary, counts binary")
        .groupBy("bucket").applyInPandas(_merged(FREQUENT), _COUNTED),
        "lm-counts",
    )
    counted = corpus_counts(counts)
    answers = counts.filter("block >= 0").select("block", "bucket", "counts")
    coded = blocks.select("block", "doc_ids", "n_tokens", "held", "at", "words").groupBy("block").cogroup(answers.groupBy("block"))
    coded = materialize(coded.applyInPandas(_coded(counted), _CODED), "lm-codes")
    discard(blocks)
    discard(counts)
    weights, _ = train(coded, counted, rounds)
    shared = spark.sparkContext.broadcast(weights)
    scored = coded.select("doc_ids", "n_tokens", "codes", "base", "rare", "known").mapInArrow(
        _scored(counted, shared), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(counted.n).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    scored = lm_scores(tables.read(spark, sf_dir, "documents"))
    return scored.select("doc_id", held_out(F.col("doc_id"), *FOLD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
