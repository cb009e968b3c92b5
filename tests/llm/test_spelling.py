"""Spelling variants against plain counting and the comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mobilome.llm import spelling
from mobilome.storage import materialize
from tests.llm.test_operators_llm import ODD, SCHEMA


def plain_words(rows, deleted=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % deleted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = []
    forms = {}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    for w, own in near.items():
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            forms[w] = best
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), counts[forms[w]] if w in forms else None))
    return sorted(out, key=repr)


def given(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Words with variants of all edits, chains of forms, ties, and odd texts."""
    rng = random.Random(7)
    stems = ["señorita", "garçonne", "Straßenbahn", "aaaaaa", "aaaaaaa", "abababab", "banana×s", "letters", "element", "cluster", "elefant", "résumés"]
    letters = "abcdefgñéüßÿ÷"
    words = []
    for s in stems:
        made = [s]
        for k in (1, 2):
            for _ in range(12):
                w, at = rng.choice(made), rng.randrange(len(s))
                c = rng.choice(letters)
                made.append(rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]]))
        for w in made:
            words += [w] * rng.choice([1, 4, 5, 5, 6, 25, 26, 130])
        words += [s] * rng.choice([30, 700])
    words += ["rooted"] * 700 + ["rootea"] * 130 + ["roteea"] * 0 + ["rootaa"] * 26 + ["rootab"] * 5 + ["Rooted"] * 9
    rng.shuffle(words)
    texts = []
    while words:
        n = rng.randrange(1, 40)
        texts.append(rng.choice([" ", "-", "\n", "1", "ā"]).join(words[:n]))
        words = words[n:]
    texts += ODD
    return [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, texts[5]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 1, "z", 2) for i, t in rows], SCHEMA).repartition(4)


def test_words_and_variants_by_brute_force(spark, rows):
    docs = frame(spark, rows)
    counts = plain_words(rows)
    assert len(counts) > 80
    want = plain(counts)
    assert any(r[1] != r[2] for r in want if r[1])  # a chain of forms
    assert given(spelling.spelling_variants(docs)) == want
    # Crowded segments, dealt over tiles, give the same.
    assert given(spelling.spelling_variants(docs, tile=2)) == want


def test_deletions_are_made(spark, rows):
    few = plain_words(rows, 3)
    got = {r.word: r.n for r in spelling.count_words(frame(spark, rows), deleted=3).collect()}
    assert got == few and few != plain_words(rows)


@pytest.mark.parametrize("tile", [1, 3, 2000])
def test_every_near_pair_comes_once(spark, tile):
    rng = random.Random(tile)
    words = list({"".join(rng.choice("aéb") for _ in range(rng.randrange(6, 10))) for _ in range(400)})
    table = materialize(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), "test-words")
    got = [(r.a, r.b) for r in spelling.near_pairs(table, tile).collect()]
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_a_hot_word_and_a_long_text(spark):
    text = "element " * 200_000 + "elemant " * 9 + "x" * 70_000
    got = given(spelling.spelling_variants(frame(spark, [(1, text)] + [(i, "Element elemants") for i in range(2, 30)])))
    assert got == plain(plain_words([(1, text)] + [(i, "Element elemants") for i in range(2, 30)]))


def test_no_rows_and_no_pairs(spark):
    assert given(spelling.spelling_variants(spark.createDataFrame([], SCHEMA))) == []
    assert given(spelling.spelling_variants(frame(spark, [(1, "singular " * 5)]))) == plain(plain_words([(1, "singular " * 5)]))
    assert spelling.spelling_variants(frame(spark, [(1, None)])).filter(F.col("n") > 0).count() == 0
