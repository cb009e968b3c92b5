"""Reading frames and gene finding against plain forms, and planted genes found again."""

import random
from itertools import combinations

import numpy as np
import pytest

from mobilome.functions import boundary_kernels as K
from mobilome.functions import gene_kernels as G
from mobilome.operators import genes, scan


def dna(n, rng, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def plain_frames(s, least):
    """Codon by codon, on both strands."""
    out, n = [], len(s)
    for strand, x in (("+", s), ("-", K.reverse_complement(s))):
        for frame in range(3):
            first, opened = frame, x[frame : frame + 3] not in G.STARTS
            for i in range(frame, n - 2, 3):
                if x[i : i + 3] in G.STOPS:
                    if first is not None and i + 3 - first >= least:
                        out.append((strand, first, i + 3, opened, False))
                    first, opened = None, False
                elif first is None and x[i : i + 3] in G.STARTS:
                    first = i
            last = n - (n - frame) % 3
            if first is not None and last - first >= least:
                out.append((strand, first, last, opened, True))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_longest_frames_are_the_plain_ones(seed):
    rng = random.Random(seed)
    s, least = dna(rng.choice([0, 1, 3, 5, 60, 400]), rng, rng.choice(["ACGT", "ACGTN", "ATG"])), rng.choice([3, 6, 30])
    want = []
    for strand, a, b, left, right in plain_frames(s, least):
        x = s if strand == "+" else K.reverse_complement(s)
        protein = "".join("X" if set(c) - set(G.BASES) else G.CODE[16 * G.BASES.index(c[0]) + 4 * G.BASES.index(c[1]) + G.BASES.index(c[2])] for c in (x[i : i + 3] for i in range(a, b - 2, 3)))
        protein = protein.rstrip("*")
        want.append((a, b, "+", left, right, protein) if strand == "+" else (len(s) - b, len(s) - a, "-", right, left, protein))
    assert scan.reading_frames(s, least) == sorted(want)


@pytest.mark.parametrize("seed", range(15))
def test_scored_frames_by_trying_every_start(seed):
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    s = dna(rng.randrange(20, 400), rng, "ACGTN" if seed % 3 == 0 else "ACGT")
    odds, starts = draw.normal(0.3, 1, G.HEXAMERS), draw.normal(0, 1, 3)
    codon = G.codons(G.base_codes(s))
    want = []
    for frame in range(3):
        own = [s[i : i + 3] for i in range(frame, len(s) - 2, 3)]
        ends = [i for i, c in enumerate(own) if c in G.STOPS]
        begin = 0
        for end in [*ends, len(own)]:
            options = []
            for a in range(begin, end):
                opened = a == 0 and own[0] not in G.STARTS
                if own[a] not in G.STARTS and not opened:
                    continue
                stop = end + 1 if end < len(own) else len(own)
                if (stop - a) * 3 < 12:
                    continue
                score = 0.0 if opened else starts[G.STARTS.index(own[a])]
                for x, y in zip(own[a : end - 1], own[a + 1 : end]):
                    if not (set(x + y) - set("ACGT")):
                        score += odds[G._number(x) * 64 + G._number(y)]
                options.append((score - 1.0, -a, frame + 3 * a, frame + 3 * stop, opened, end == len(own)))
            best = max(options, default=None)
            if best and best[0] > 0:
                want.append((*best[2:], round(best[0], 6)))
            begin = end + 1
    got = [(*f[:4], round(f[4], 6)) for f in G.scored_frames(codon, len(s), odds, starts, 1.0, 12)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", range(25))
def test_the_best_set_of_genes_by_trying_all(seed):
    rng = random.Random(seed)
    spans = [(a, a + rng.randrange(5, 60)) for a in (rng.randrange(200) for _ in range(rng.randrange(1, 10)))]
    scores = [rng.uniform(-1, 10) for _ in spans]

    def worth(some):
        some = sorted(some, key=lambda i: (spans[i][1], spans[i][0]))
        total = sum(scores[i] for i in some)
        for x, y in zip(some, some[1:]):
            shared = spans[x][1] - spans[y][0]
            if shared > 0:
                if shared > 20 or spans[x][0] >= spans[y][0] or spans[x][1] >= spans[y][1]:
                    return -1.0
                total -= 0.1 * shared
        return total

    best = max(worth(c) for n in range(len(spans) + 1) for c in combinations(range(len(spans)), n))
    got = G.chosen(spans, scores, 20, 0.1)
    assert worth(got) == pytest.approx(best)


CODONS = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in G.STOPS]


def planted(rng, n_genes=25, liked=None):
    """A contig with genes of skewed codons on both strands, and their places."""
    liked = liked or rng.choices(CODONS, k=14)
    out, places, at = [], [], 0
    for _ in range(n_genes):
        gap = dna(rng.randrange(80, 500), rng)
        body = "".join(rng.choice(liked) if rng.random() < 0.8 else rng.choice(CODONS) for _ in range(rng.randrange(60, 300)))
        gene = "ATG" + body + rng.choice(G.STOPS)
        strand = rng.choice("+-")
        out += [gap, gene if strand == "+" else K.reverse_complement(gene)]
        places.append((at + len(gap), at + len(gap) + len(gene), strand))
        at += len(gap) + len(gene)
    return "".join(out) + dna(300, rng), places


def test_planted_genes_are_found_more_often_than_by_frames(spark):
    liked = random.Random(77).choices(CODONS, k=14)
    contigs, truth = [], set()
    for i in range(6):
        contig, places = planted(random.Random(i), 25, liked)
        contigs.append((f"c{i}", contig))
        truth |= {(f"c{i}", a, z, s) for a, z, s in places}
    frame = spark.createDataFrame([*contigs, ("short", "ATG"), ("null", None), ("empty", "")], "contig_id string, sequence string").repartition(3)
    found = {(r.contig_id, r.start, r.end, r.strand): r for r in genes.predict_genes(frame).collect()}
    frames = {(r.contig_id, r.start, r.end, r.strand) for r in scan.find_genes(frame).collect()}
    exact, ends = len(truth & set(found)), lambda some: {(c, z if s == "+" else a, s) for c, a, z, s in some}
    assert exact > 0.75 * len(truth) and len(ends(truth) & ends(found)) > 0.97 * len(truth)
    # Few others are called, where the frames call many.
    assert len(ends(found) - ends(truth)) < 0.15 * len(truth) < len(ends(frames) - ends(truth))
    assert exact > len(truth & frames) or exact / len(found) > 3 * len(truth & frames) / len(frames)
    text = dict(contigs)
    for (c, a, z, s), r in found.items():
        own = text[c][a:z] if s == "+" else K.reverse_complement(text[c][a:z])
        assert r.protein == G.translate(own).rstrip("*")
        assert r.partial_left or r.partial_right or len(own) % 3 == 0


def test_a_given_model_and_no_contigs(spark):
    none = spark.createDataFrame([], "contig_id string, sequence string")
    assert genes.predict_genes(none).count() == 0
    rng = random.Random(2)
    contig, _ = planted(rng)
    one = spark.createDataFrame([("a", contig), ("a", contig.lower())], "contig_id string, sequence string")
    model = genes.train(one)
    rows = [tuple(r) for r in genes.predict_genes(one, model).collect()]
    assert len(rows) == 2 * len(set(rows)) and rows[0][1] == "a_1"
