"""Language-model scores: counts and base by brute force, the model as a distribution, and its gain on documents not learnt from."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from mobilome.llm import maxent_lm
from tests.llm.test_operators_llm import ODD, SCHEMA


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        own = tokens(text)
        out.append((i, len(own), sum(t in counts for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 6)))
    return sorted(out, key=repr)


def given(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 1, "z", 2) for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    """Documents of two made-up languages with word order, odd texts, repeated rows and null ids."""
    rng = random.Random(11)
    langs = [[f"{a}{b}" for a in s for b in range(60)] for s in (["ka", "lo"], ["Mi", "ñu"])]
    found = []
    for i in range(700):
        words, at, out = langs[i % 2], rng.randrange(120), []
        for _ in range(rng.randrange(1, 120)):
            at = (at * 7 + rng.choice([1, 1, 1, 2, 5])) % 120
            out.append(words[at] if rng.random() < 0.95 else f"rare{rng.randrange(4000)}")
        found.append((i, rng.choice([" ", "\n", " \t "]).join(out)))
    found += [(1000 + i, t) for i, t in enumerate(ODD)]
    return [*found, found[3], found[3], (None, found[5][1]), (None, None)]


def test_counts_and_base_by_brute_force(spark, rows):
    want = plain(rows)
    assert given(maxent_lm.lm_scores(frame(spark, rows))) == want
    assert given(maxent_lm.lm_scores(frame(spark, rows, 5), block_chars=5_000, bucket_words=300)) == want


def test_the_model_beats_the_base_on_documents_not_learnt_from(spark, rows, monkeypatch):
    monkeypatch.setattr(maxent_lm, "BATCH", 256)
    got = maxent_lm.lm_scores(frame(spark, rows)).toPandas()
    assert (got["score"] <= 0).all() and np.isfinite(got["score"]).all()
    out = got[got["doc_id"].map(lambda i: i == i and held(int(i)) and i < 1000)]
    assert len(out) > 60
    assert out["score"].sum() > 0.85 * out["base_score"].sum()


def small_counts():
    top = [(f"w{i}".encode(), 500 - i) for i in range(100)]
    return maxent_lm.Counts(40_000, 900, top, np.full(maxent_lm.TAILS, 4_000))


def test_chances_of_all_tokens_add_up_to_one():
    rng = np.random.default_rng(1)
    counted = small_counts()
    model = maxent_lm.Model(counted, rng.normal(0, 0.5, (1 << maxent_lm.BITS, maxent_lm.SLOTS)))
    codes = np.concatenate([np.arange(100), np.arange(maxent_lm.FREQUENT, maxent_lm.BEFORE)]).astype(np.uint16)
    for before in ([maxent_lm.BEFORE] * 2, [5, 99], [maxent_lm.FREQUENT + 3, 7]):
        keys = [np.full(len(codes), k) for k in (before[0], maxent_lm.WIDTH + before[1], (before[0] + 1) * 4 * maxent_lm.WIDTH + before[1])]
        assert abs(np.exp(model.batch(codes, keys)).sum() - 1) < 1e-5


def test_an_untrained_model_is_the_base(spark, rows):
    got = maxent_lm.lm_scores(frame(spark, rows), rounds=0).toPandas()
    # Rarer classes hold an unknown word each where the base holds one for all.
    n_types = 1 + sum(plain(rows)[0][3:4])
    assert (abs(got["score"] - got["base_score"]) <= 1e-5 * got["n_tokens"] + got["n_tokens"] * np.log10(1 + 20 / n_types)).all()


def test_gradient_of_a_batch():
    """The first update follows minus the slope of the log likelihood, by differences."""
    counted = small_counts()
    codes = np.array([3, 70, 3, 5, 99, 2], np.uint16)
    keys = maxent_lm.contexts(codes, np.array([0, 3]))
    zero = maxent_lm.Model(counted, None)
    base = zero.batch(codes, keys).sum()
    zero.batch(codes, keys, True)
    for row, slot in [(int(maxent_lm._row(keys[0][1:2] + 1)[0]), 1), (int(maxent_lm._row(keys[1][2:3] + 1)[0]), 0)]:
        moved = np.zeros_like(zero.weights)
        moved[row, slot] = 1e-2
        slope = (maxent_lm.Model(counted, moved).batch(codes, keys).sum() - base) / 1e-2
        assert slope * zero.weights[row, slot] > 0


def summed_by_reduceat(rows, slope):
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[order].astype(int), prepend=-1))
    return np.add.reduceat(slope.take(order, 0), first, axis=0)


@pytest.mark.parametrize("rows", [[7], [5] * 300, list(range(90)), [3] * 40 + [9] * 2 + list(range(20, 60)) * 3, None])
def test_sums_by_row(rows):
    rng = np.random.default_rng(3)
    rows = np.array(rows if rows else np.minimum(rng.zipf(1.2, 4_096), 60_000), np.uint16)
    slope = rng.normal(0, 1, (len(rows), maxent_lm.SLOTS)).astype(np.float32)
    row, n, total = maxent_lm.sums_by_row(rows, slope)
    order = np.argsort(row)
    names, counts = np.unique(rows, return_counts=True)
    assert row[order].tolist() == names.tolist() and n[order].tolist() == counts.tolist()
    assert np.allclose(total[order], summed_by_reduceat(rows, slope), atol=1e-4)


def test_updates_do_not_add_column_by_column():
    """Training took over half its time in ``np.add.reduceat``, more than the check's budget of CPU seconds bears."""
    rng = np.random.default_rng(3)
    rows = np.minimum(rng.zipf(1.2, maxent_lm.BATCH), 60_000).astype(np.uint16)
    slope = rng.normal(0, 1, (len(rows), maxent_lm.SLOTS)).astype(np.float32)

    def best(f):
        times = []
        for _ in range(30):
            start = time.process_time()
            f(rows, slope)
            times.append(time.process_time() - start)
        return min(times)

    assert best(maxent_lm.Model(small_counts(), None).update) < 1.1 * best(summed_by_reduceat)


def test_contexts_stop_at_documents():
    one, two, pair = maxent_lm.contexts(np.array([1, 2, 3, 4], np.uint16), np.array([0, 2]))
    before, width = maxent_lm.BEFORE, maxent_lm.WIDTH
    assert one.tolist() == [before, 1, before, 3] and (two - width).tolist() == [before, before, before, before]
    assert len(set(pair.tolist())) == 3


def test_averages_are_weighted_by_touches():
    import pandas as pd

    size = (1 << maxent_lm.BITS) // maxent_lm.PARTS
    rows = []
    for task, (n, w) in enumerate([(1, 1.0), (3, 2.0)]):
        rows.append((0, task, maxent_lm.packed(np.full(size, n)), maxent_lm.packed(np.full(size, n), "<f4"), maxent_lm.packed(np.full(size * maxent_lm.SLOTS, w), "<f2")))
    got = maxent_lm._averaged(pd.DataFrame(rows, columns=["part", "task", "touched", "mass", "weights"])).iloc[0]
    assert maxent_lm.unpacked(got["weights"], "<f2")[0] == 1.75 and maxent_lm.unpacked(got["touched"])[0] == 4


def test_no_rows_and_no_training_documents(spark):
    assert maxent_lm.lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    only = next(i for i in range(100) if held(i))
    got = maxent_lm.lm_scores(frame(spark, [(only, "a b")])).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0) and math.isfinite(got.score)


def test_a_very_long_text(spark):
    rows = [(1, "Word other " * 100_000 + "x" * 90_000), (2, "word")]
    assert given(maxent_lm.lm_scores(frame(spark, rows, 1))) == plain(rows)
