"""Affine-gap alignment of many pairs of sequences at once, in numpy, and its statistics.

All pairs of a batch advance together, one row of their matrices at a time; a run of horizontal gaps is a running maximum
once its slope is taken out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np

RESIDUES = "ARNDCQEGHILKMFPSTVWYX"
UNKNOWN = len(RESIDUES) - 1
# What a residue scores against itself, in the order of RESIDUES, and residues that replace each other readily or sometimes.
SAME = (4, 5, 6, 6, 9, 5, 5, 6, 8, 4, 4, 5, 5, 6, 7, 4, 5, 4, 11, 7, -1)
READILY = ("ILMV", "FWY", "KR", "DE", "NQDE", "ST", "AS", "EQK", "HNY", "AG")
SOMETIMES = ("ILMVFAC", "STNAGP", "KRHQNE", "DENQS")
#: Share of each residue in proteins, in the order of RESIDUES without X.
BACKGROUND = np.array([8.3, 5.5, 4.1, 5.5, 1.4, 3.9, 6.8, 7.1, 2.3, 5.9, 9.7, 5.8, 2.4, 3.9, 4.7, 6.6, 5.3, 6.9, 1.1, 2.9])
BACKGROUND /= BACKGROUND.sum()
OPEN, EXTEND = 11, 1
#: Cells of one batch at most, which bounds its memory, and places of a diagonal over all its pairs, which keeps local batches in the cache.
CELLS, LANES = 24_000_000, 200_000
_FAR = -(10**8)


@cache
def substitution_matrix() -> np.ndarray:
    """Scores of residue pairs, made by rule: readily replaced ones 1, sometimes replaced ones -1, others -3."""
    m = np.full((len(RESIDUES) + 1,) * 2, -3, np.int32)
    for groups, score in ((SOMETIMES, -1), (READILY, 1)):
        for g in groups:
            at = [RESIDUES.index(c) for c in g]
            m[np.ix_(at, at)] = np.maximum(m[np.ix_(at, at)], score)
    np.fill_diagonal(m, (*SAME, 0))
    m[UNKNOWN, :], m[:, UNKNOWN] = -1, -1
    m[-1, :], m[:, -1] = _FAR, _FAR  # the padding behind a sequence
    return m


_CODE = np.full(256, UNKNOWN, np.uint8)
for _i, _c in enumerate(RESIDUES):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def encoded(s: str) -> np.ndarray:
    """Residue numbers of a protein; letters that are no residue are X."""
    return _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]


def points(s: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass
class Aligned:
    """A pair's alignment: its score, the half-open spans in both, and which residues stand in one column."""

    score: int
    q_start: int
    q_end: int
    t_start: int
    t_end: int
    q_at: np.ndarray
    t_at: np.ndarray

    @property
    def columns(self) -> int:
        return self.q_end - self.q_start + self.t_end - self.t_start - len(self.q_at)


def _padded(seqs: Sequence[np.ndarray]) -> np.ndarray:
    out = np.full((len(seqs), max(map(len, seqs), default=0)), len(RESIDUES), np.uint8)
    for row, s in zip(out, seqs):
        row[: len(s)] = s
    return out


def align_pairs(queries: Sequence[np.ndarray], targets: Sequence[np.ndarray], local: bool = True, opening: int = OPEN, extending: int = EXTEND) -> list[Aligned]:
    """The best local, or global, alignment of every pair of encoded sequences; a gap of g costs opening + (g - 1) extending.

    Of equal alignments the one that ends first in the query, then in the target, is taken, and it prefers diagonal steps, then gaps in the target.
    """
    out: list[Aligned | None] = [None] * len(queries)
    order = sorted(range(len(queries)), key=lambda i: (len(queries[i]), len(targets[i])))
    by_diagonals = local and opening >= extending >= 0
    for batch in _batches(order, queries, targets, LANES if by_diagonals else CELLS):
        one, other = [queries[i] for i in batch], [targets[i] for i in batch]
        for i, found in zip(batch, _align_local(one, other, opening, extending) if by_diagonals else _align(one, other, local, opening, extending)):
            out[i] = found
    return out


def _batches(order: list[int], queries: Sequence[np.ndarray], targets: Sequence[np.ndarray], lanes: int) -> Iterator[list[int]]:
    batch, n, m = [], 0, 0
    for i in order:
        n, m = max(n, len(queries[i])), max(m, len(targets[i]))
        if batch and ((len(batch) + 1) * n * m > CELLS or (len(batch) + 1) * n > lanes):
            yield batch
            batch, n, m = [], len(queries[i]), len(targets[i])
        batch.append(i)
    if batch:
        yield batch


def _align(queries: list[np.ndarray], targets: list[np.ndarray], local: bool, opening: int, extending: int) -> list[Aligned]:
    scores = substitution_matrix()
    q, t = _padded(queries), _padded(targets)
    pairs, n, m = len(queries), q.shape[1], t.shape[1]
    size_q, size_t = np.array(list(map(len, queries))), np.array(list(map(len, targets)))
    slope = extending * np.arange(m + 1)
    edge = np.zeros(m + 1, np.int32) if local else np.concatenate(([0], -opening - extending * np.arange(m))).astype(np.int32)
    above = np.repeat(edge[None], pairs, 0)
    down = np.full((pairs, m + 1), _FAR, np.int32)
    #: By cell: where its score comes from (0 nowhere, 1 diagonal, 2 above, 3 left), and whether the gap above (4) or left (8) goes on.
    trace = np.zeros((n + 1, pairs, m + 1), np.uint8)
    trace[0, :, 1:] = 0 if local else 3 | 8
    best, at_q, at_t = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    final = np.where(size_q == 0, above[np.arange(pairs), size_t], 0)
    for i in range(1, n + 1):
        goes_on = down - extending >= above - opening
        down = np.where(goes_on, down - extending, above - opening)
        here = down.copy()
        diagonal = above[:, :-1] + scores[q[:, i - 1][:, None], t]
        source = np.where(diagonal >= here[:, 1:], 1, 2).astype(np.uint8)
        here[:, 1:] = np.maximum(diagonal, here[:, 1:])
        if local:
            here[:, 0] = 0
            source[here[:, 1:] <= 0] = 0
            np.maximum(here, 0, out=here)
        left = np.full((pairs, m + 1), _FAR, np.int32)
        left[:, 1:] = np.maximum.accumulate(here + slope, 1)[:, :-1] - opening + extending - slope[1:]
        stays = np.zeros((pairs, m + 1), bool)
        stays[:, 2:] = left[:, 1:-1] - extending >= here[:, 1:-1] - opening
        source[left[:, 1:] > here[:, 1:]] = 3
        above = np.maximum(here, left)
        trace[i, :, 1:] = source
        trace[i, :, 0] = 0 if local else 2
        trace[i] |= 4 * goes_on.astype(np.uint8) | 8 * stays.astype(np.uint8)
        if local:
            place = np.argmax(above, 1)
            value = above[np.arange(pairs), place]
            better = value > best
            best[better], at_q[better], at_t[better] = value[better], i, place[better]
        else:
            final = np.where(size_q == i, above[np.arange(pairs), size_t], final)
    if not local:
        best, at_q, at_t = final, size_q, size_t
    return [_traced(trace[:, p], int(best[p]), int(at_q[p]), int(at_t[p]), local) for p in range(pairs)]


def _align_local(queries: list[np.ndarray], targets: list[np.ndarray], opening: int, extending: int) -> list[Aligned]:
    """``_align`` of local alignments, an antidiagonal of all pairs at a time, so that no cell waits for one beside it; in 16 bits where scores fit."""
    table = substitution_matrix().copy()
    table[-1, :], table[:, -1] = -3, -3  # what lies behind a sequence scores less than its end in any case
    width = len(table)
    sizes = max(map(len, queries), default=0), max(map(len, targets), default=0)
    small = int(table.max()) * min(sizes) + opening < 15_000
    kind, far = (np.int16, -16_000) if small else (np.int32, _FAR)
    q, t = np.ascontiguousarray(_padded(queries).T).astype(np.intp) * width, np.ascontiguousarray(_padded(targets)[:, ::-1].T).astype(np.intp)
    (n, pairs), m = q.shape, len(t)
    if not (n and m and pairs):
        return [Aligned(0, 0, 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    table = table.astype(kind).ravel()
    opening, extending, zero = kind(opening), kind(extending), kind(0)
    # Place i of an array is row i of the antidiagonal; what is never written are the edges.
    h = [np.zeros((n + 1, pairs), kind) for _ in range(3)]
    down, left = ([np.full((n + 1, pairs), far, kind) for _ in range(2)] for _ in range(2))
    index, opened, gap, score = np.empty((n, pairs), np.intp), np.empty((n + 1, pairs), kind), np.empty((n, pairs), kind), np.empty((n, pairs), kind)
    flag = np.empty((n, pairs), bool)
    lows = np.array([max(1, d - m) for d in range(n + m + 1)])
    counts = np.array([max(0, min(n, d - 1) - low + 1) for d, low in enumerate(lows)])
    # Cell (i, d - i) lies at row begins[d] + i: its score, and whether its left gap goes on (8), the one above (4), it ends a left gap (2), comes from the diagonal (1).
    begins = np.cumsum(counts) - counts - lows
    scores, trace = np.empty((n * m, pairs), kind), np.empty((n * m, pairs), np.uint8)
    most = np.zeros((n + 1, pairs), kind)
    for d in range(2, n + m + 1):
        low, count = int(lows[d]), int(counts[d])
        high, at = low + count, int(begins[d]) + low
        now, before, corner = h[d % 3], h[(d - 1) % 3], h[(d - 2) % 3]
        f, g, o, x = trace[at : at + count], flag[:count], opened[: count + 1], gap[:count]
        np.subtract(before[low - 1 : high], opening, out=o)
        np.subtract(left[(d - 1) % 2][low:high], extending, out=x)
        np.greater_equal(x, o[1:], out=f.view(bool))
        here_left = np.maximum(x, o[1:], out=left[d % 2][low:high])
        np.subtract(down[(d - 1) % 2][low - 1 : high - 1], extending, out=x)
        np.greater_equal(x, o[:-1], out=g)
        here_down = np.maximum(x, o[:-1], out=down[d % 2][low:high])
        f += f
        f |= g.view(np.uint8)
        np.add(q[low - 1 : high - 1], t[low + m - d : high + m - d], out=index[:count])
        np.take(table, index[:count], out=score[:count], mode="clip")
        np.add(score[:count], corner[low - 1 : high - 1], out=x)
        f += f
        here = score[:count]
        np.maximum(x, here_down, out=here)
        np.maximum(here, zero, out=here)
        np.greater(here_left, here, out=g)
        f |= g.view(np.uint8)
        f += f
        np.greater_equal(x, here_down, out=g)
        f |= g.view(np.uint8)
        cells = np.maximum(here, here_left, out=scores[at : at + count])
        now[low:high] = cells
        np.maximum(most[low:high], cells, out=most[low:high])
    row, lane = np.argmax(most, 0), np.arange(pairs)
    best = most[row, lane]
    met = np.where(row > 0, row, 1)
    columns = np.arange(1, m + 1)[:, None]
    column = np.where(best > 0, 1 + np.argmax(scores[begins[columns + met] + met, lane] == best, 0), 0)
    # All paths go back together; how is 1 on a diagonal, 2 in a gap above, 3 in a gap to the left, 0 at the end.
    i, j = np.where(best > 0, row, 0), column
    places_q, places_t = np.full((n + m, pairs), -1, np.int32), np.full((n + m, pairs), -1, np.int32)
    start_q, start_t = i.copy(), j.copy()

    def source(i: np.ndarray, j: np.ndarray, lane: np.ndarray) -> np.ndarray:
        at = np.where((i > 0) & (j > 0), begins[i + j] + i, 0)
        code = trace[at, lane]
        return np.where((i > 0) & (j > 0) & (scores[at, lane] > 0), np.where(code & 2, 3, np.where(code & 1, 1, 2)), 0)

    live = np.flatnonzero(best > 0)
    i, j = i[live], j[live]
    how = source(i, j, live)
    step = 0
    while len(live):
        code = trace[begins[i + j] + i, live]
        diagonal, up = how == 1, how == 2
        goes_on = np.where(up, code & 4, code & 8) > 0
        i, j = i - (how != 3), j - (how != 2)
        places_q[step, live[diagonal]], places_t[step, live[diagonal]] = i[diagonal], j[diagonal]
        start_q[live], start_t[live] = i, j
        how = np.where(~diagonal & goes_on, how, source(i, j, live))
        kept = (how > 0) & (i > 0) & (j > 0)
        live, i, j, how = live[kept], i[kept], j[kept], how[kept]
        step += 1
    places_q, places_t = np.ascontiguousarray(places_q[:step][::-1].T), np.ascontiguousarray(places_t[:step][::-1].T)
    taken = places_q >= 0
    ends = np.cumsum(taken.sum(1))
    flat_q, flat_t = places_q[taken].astype(np.int64), places_t[taken].astype(np.int64)
    first = [0, *ends[:-1].tolist()]
    spans = zip(best.tolist(), start_q.tolist(), np.where(best > 0, row, 0).tolist(), start_t.tolist(), column.tolist(), first, ends.tolist())
    return [Aligned(s, a, b, c, e, flat_q[x:y], flat_t[x:y]) for s, a, b, c, e, x, y in spans]


def _traced(trace: np.ndarray, score: int, i: int, j: int, local: bool) -> Aligned:
    q_end, t_end, q_at, t_at = i, j, [], []
    kind = trace[i, j] & 3
    while (i or j) and kind and (i and j or not local):
        if kind == 1:
            i, j = i - 1, j - 1
            q_at.append(i)
            t_at.append(j)
            kind = trace[i, j] & 3
        elif kind == 2:
            on = trace[i, j] & 4
            i -= 1
            kind = 2 if on else trace[i, j] & 3
        else:
            on = trace[i, j] & 8
            j -= 1
            kind = 3 if on else trace[i, j] & 3
    return Aligned(score, i, q_end, j, t_end, np.array(q_at[::-1], np.int64), np.array(t_at[::-1], np.int64))


@cache
def statistics(opening: int = OPEN, extending: int = EXTEND, length: int = 150, pairs: int = 400) -> tuple[float, float]:
    """(lambda, K) of local scores: the extreme-value curve fitted, by moments, to pairs of random proteins of one seed."""
    rng = np.random.default_rng(7)
    a, b = (rng.choice(len(BACKGROUND), (pairs, length), p=BACKGROUND).astype(np.uint8) for _ in range(2))
    s = np.array([x.score for x in align_pairs(list(a), list(b), True, opening, extending)], float)
    rate = np.pi / np.sqrt(6 * s.var())
    mode = s.mean() - 0.5772156649 / rate
    return float(rate), float(np.exp(rate * mode) / length**2)


def bits(score: float) -> float:
    rate, k = statistics()
    return (rate * score - np.log(k)) / np.log(2)


def neighbours(word: str, least: int) -> list[str]:
    """The words that score ``least`` at least against ``word``, itself always among them; halves are combined from sorted lists."""
    scores = substitution_matrix()[:20, :20]
    halves = []
    for part in (word[: len(word) // 2], word[len(word) // 2 :]):
        names, totals = [""], np.zeros(1, int)
        for c in encoded(part):
            if c == UNKNOWN:
                return [word]
            totals = (totals[:, None] + scores[c]).ravel()
            names = [n + r for n in names for r in RESIDUES[:20]]
        order = np.argsort(-totals, kind="stable")
        halves.append(([names[i] for i in order], totals[order]))
    (left, score_left), (right, score_right) = halves
    out = [a + b for a, s in zip(left, score_left) for b in right[: int(np.searchsorted(-score_right, s - least, "right"))]]
    return out if word in out else [*out, word]


@cache
def _half_codes(part: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scores) of all words as long as ``part``, those that score best against it first."""
    totals = np.zeros(1, np.int64)
    for c in encoded(part):
        totals = (totals[:, None] + substitution_matrix()[c, :20]).ravel()
    order = np.argsort(-totals, kind="stable")
    return order, totals[order]


def neighbour_codes(word: str, least: int) -> np.ndarray:
    """``word_code`` of all ``neighbours`` of a word of the twenty residues."""
    middle = len(word) // 2
    (left, score_left), (right, score_right) = _half_codes(word[:middle]), _half_codes(word[middle:])
    n = np.searchsorted(-score_right, score_left - least, "right")
    place = np.repeat(np.arange(len(n)), n)
    out = left[place] * 20 ** (len(word) - middle) + right[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
    own = word_code(word)
    return out if (out == own).any() else np.append(out, own)


def column_path(scores: np.ndarray, opening: float = OPEN, extending: float = EXTEND) -> tuple[np.ndarray, np.ndarray, float]:
    """(rows, columns, score) of the best global path through a matrix of scores: the places that stand in one column, in order; gaps cost as in ``align_pairs``."""
    n, m = scores.shape
    slope = extending * np.arange(m + 1)
    above = np.concatenate(([0.0], -opening - extending * np.arange(m)))
    down = np.full(m + 1, float(_FAR))
    trace = np.zeros((n + 1, m + 1), np.uint8)
    trace[0, 1:] = 3 | 8
    for i in range(1, n + 1):
        goes_on = down - extending >= above - opening
        down = np.where(goes_on, down - extending, above - opening)
        here = down.copy()
        diagonal = above[:-1] + scores[i - 1]
        source = np.where(diagonal >= here[1:], 1, 2).astype(np.uint8)
        here[1:] = np.maximum(diagonal, here[1:])
        left = np.full(m + 1, float(_FAR))
        left[1:] = np.maximum.accumulate(here + slope)[:-1] - opening + extending - slope[1:]
        stays = np.zeros(m + 1, bool)
        stays[2:] = left[1:-1] - extending >= here[1:-1] - opening - 1e-9
        source[left[1:] > here[1:]] = 3
        above = np.maximum(here, left)
        trace[i, 1:], trace[i, 0] = source, 2
        trace[i] |= 4 * goes_on.astype(np.uint8) | 8 * stays.astype(np.uint8)
    found = _traced(trace, 0, n, m, False)
    return found.q_at, found.t_at, float(above[m])


def column_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the columns of two groups: the mean score of their residue pairs, a gap against a residue being 0; a column is counts of 21 residues and of gaps."""
    matrix = substitution_matrix()[:21, :21].astype(float)
    x, y = a[:, :21] / a.sum(1, keepdims=True), b[:, :21] / b.sum(1, keepdims=True)
    return x @ matrix @ y.T


#: Hits that are held at a time, unless one query has more.
HITS = 2_000_000
_LETTER = {ord(c): i for i, c in enumerate(RESIDUES[:20])}


def word_code(word: str) -> int:
    """The number of a word of the twenty residues, -1 of any other."""
    code = 0
    for c in word:
        if ord(c) not in _LETTER:
            return -1
        code = 20 * code + _LETTER[ord(c)]
    return code


def _side(seqs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all sequences end to end, and their lengths."""
    return points("".join(seqs)), np.fromiter(map(len, seqs), np.int64, len(seqs))


def _word_places(points: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words as rows of code points, sequence, place) of the words with more than two different letters."""
    n = np.maximum(sizes - k + 1, 0)
    seq = np.repeat(np.arange(len(sizes)), n)
    pos = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(sizes) - sizes)[seq] + pos
    words = points[start[:, None] + np.arange(k)]
    kept = (np.diff(np.sort(words, 1), axis=1) != 0).sum(1) > 1
    return words[kept], seq[kept], pos[kept]


def _codes(words: np.ndarray, k: int) -> np.ndarray:
    """``word_code`` of words; those with other letters are numbered behind by the order of their rows."""
    table = np.full(128, 20, np.int64)
    table[list(_LETTER)] = list(_LETTER.values())
    letters = np.where(words < 128, table[np.minimum(words, 127)], 20)
    pure = (letters < 20).all(1) & (k <= 13)
    out = np.zeros(len(words), np.int64)
    for i in range(k if k <= 13 else 0):
        out = out * 20 + letters[:, i]
    if not pure.all():
        out[~pure] = 20 ** min(k, 13) + np.unique(words[~pure], axis=0, return_inverse=True)[1].ravel()
    return out


def stretches(
    queries: Sequence[str], targets: Sequence[str], k: int, stretch: int, near: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
    owners: tuple[np.ndarray, np.ndarray] | None = None, labels: tuple[np.ndarray, np.ndarray] | None = None,
) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, target, diagonal, stretch, first, last, hits): stretches of diagonals with two hits that do not overlap, by places in the two lists.

    ``near`` has the sorted codes of words, where the neighbours of each begin, and the codes of all neighbours; without it equal words meet.
    ``owners`` has, for every place in either list, that of the first sequence of the same id; sequences of one id lie side by side.
    With ``labels``, numbers from 0 on of the sequences in either list, those of equal labels do not meet.
    Stretch v holds the places from v * ``stretch`` on, twice as many as its step, so any two hits within a step share one.
    """
    (q_points, q_sizes), (t_points, t_sizes) = _side(queries), _side(targets)
    (q_words, q_seq, q_pos), (t_words, t_seq, t_pos) = _word_places(q_points, q_sizes, k), _word_places(t_points, t_sizes, k)
    q_label, t_label = (np.zeros(len(seq), np.int64) if labels is None else side[seq] for seq, side in zip((q_seq, t_seq), labels or (None, None)))
    if owners is not None:
        q_seq, t_seq = owners[0][q_seq], owners[1][t_seq]
    codes = _codes(np.vstack((q_words, t_words)), k)
    q_code, t_code = codes[: len(q_words)], codes[len(q_words) :]
    if near is not None and len(near[0]):
        at = np.minimum(np.searchsorted(near[0], q_code), len(near[0]) - 1)
        known = near[0][at] == q_code
        width = np.where(known, near[1][at + 1] - near[1][at], 1)
        place = np.repeat(np.arange(len(q_code)), width)
        inside = np.arange(len(place)) - np.repeat(np.cumsum(width) - width, width)
        q_code = np.where(known[place], near[2][np.minimum(near[1][at][place] + inside, len(near[2]) - 1)], q_code[place])
        q_seq, q_pos, q_label = q_seq[place], q_pos[place], q_label[place]
    if labels is not None:
        met = np.isin(q_code, t_code)
        q_code, q_seq, q_pos, q_label = q_code[met], q_seq[met], q_pos[met], q_label[met]
    order = np.lexsort((t_label, t_code)) if labels is not None else np.argsort(t_code, kind="stable")
    t_code, t_seq, t_pos, t_label = t_code[order], t_seq[order], t_pos[order], t_label[order]
    low, high = np.searchsorted(t_code, q_code, "left"), np.searchsorted(t_code, q_code, "right")
    if labels is not None:
        # What a word meets lies before and behind the places of its own label.
        kinds = 1 + int(max(q_label.max(initial=0), t_label.max(initial=0)))
        own, both = q_code * kinds + q_label, t_code * kinds + t_label
        low = np.stack((low, np.searchsorted(both, own, "right")), 1).ravel()
        high = np.stack((np.searchsorted(both, own, "left"), high), 1).ravel()
        q_seq, q_pos = np.repeat(q_seq, 2), np.repeat(q_pos, 2)
    n = high - low
    met = n > 0
    low, n, q_seq, q_pos = low[met], n[met], q_seq[met], q_pos[met]
    ends = np.append(np.flatnonzero(np.diff(q_seq)) + 1, len(q_seq)) if len(q_seq) else np.zeros(0, np.int64)
    total = np.cumsum(n)
    a = 0
    while a < len(n):
        # Whole queries up to HITS, one at least.
        before = total[a] - n[a]
        z = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(total[ends - 1], before + HITS, "right") - 1)])
        yield _two_hits(low[a:z], n[a:z], q_seq[a:z], q_pos[a:z], t_seq, t_pos, int(q_sizes.max()), int(t_sizes.max()), len(t_sizes), k, stretch)
        a = z


def pair_regions(q, t, diagonal, first, last, hits, k: int, region: int, most: int) -> tuple[np.ndarray, ...]:
    """(query, target, first, last, low, high): ``operators.alignment.regions`` of stretches of whole pairs; regions of a pair lie side by side, the one with most hits first."""
    pair = q * (int(t.max(initial=0)) + 1) + t
    band = np.concatenate((diagonal // region - 1, diagonal // region)).astype(np.int64)
    twice = np.tile(np.arange(len(pair)), 2)
    twice_pair = pair[twice]
    order = np.lexsort((band, twice_pair))
    band, by, twice = band[order], twice_pair[order], twice[order]
    begin = np.flatnonzero(np.append(True, (np.diff(by) != 0) | (np.diff(band) != 0))) if len(by) else np.zeros(0, np.int64)
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    place = np.stack((np.minimum.reduceat(first[twice], begin), np.maximum.reduceat(last[twice], begin) + k, np.minimum.reduceat(diagonal[twice], begin), np.maximum.reduceat(diagonal[twice], begin)))
    total, by, band, one = np.add.reduceat(hits[twice], begin), by[begin], band[begin], twice[begin]
    order = np.lexsort((band, -total, by))
    place, by, one = place[:, order], by[order], one[order]
    fresh = np.append(True, np.diff(by) != 0)
    rank = np.arange(len(by)) - np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
    # Two bands hold the same hits where these lie in their common half; such a region is aligned once.
    again = np.append(False, (place[:, 1:] == place[:, :-1]).all(0)) & ~fresh
    kept = (rank < most) & ~again
    return q[one[kept]], t[one[kept]], *place[:, kept]


def _two_hits(low, n, q_seq, q_pos, t_seq, t_pos, q_most: int, t_most: int, targets: int, k: int, stretch: int) -> tuple[np.ndarray, ...]:
    own = np.repeat(np.arange(len(n)), n)
    at = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    pairs, pair = np.unique(q_seq[own] * targets + t_seq[at], return_inverse=True)
    pos = q_pos[own]
    diagonal = t_pos[at] - pos + q_most
    wide, steps = q_most + t_most + 1, q_most // stretch + 2
    if len(pairs) * wide * steps * stretch >= 1 << 62:
        raise ValueError("sequences are too long for the tiles of the word search")
    # One number a hit; equal ones are one hit.
    full = np.sort(((pair * wide + diagonal) * steps + pos // stretch) * stretch + pos % stretch)
    full = full[np.diff(full, prepend=-1) > 0]
    key = full // stretch
    start = np.flatnonzero(np.diff(key, prepend=-1))
    end = np.append(start[1:], len(key))
    key, hits = key[start], end - start
    step = key % steps
    first, last = step * stretch + full[start] % stretch, step * stretch + full[end - 1] % stretch
    # A step and the one behind it are a stretch; a step without one before it is also the end of the stretch before.
    goes_on = np.append((np.diff(key) == 1) & (step[1:] > 0), False)
    opens = ~np.append(False, goes_on[:-1])
    following = np.minimum(np.arange(len(key)) + 1, len(key) - 1)
    out_key, out_v = np.concatenate((key, key[opens])), np.concatenate((step, step[opens] - 1))
    out_first = np.concatenate((first, first[opens]))
    out_last = np.concatenate((np.where(goes_on, last[following], last), last[opens]))
    out_hits = np.concatenate((hits + np.where(goes_on, hits[following], 0), hits[opens]))
    kept = out_last - out_first >= k
    line = out_key[kept] // steps
    found = pairs[line // wide]
    return found // targets, found % targets, line % wide - q_most, out_v[kept], out_first[kept], out_last[kept], out_hits[kept]
