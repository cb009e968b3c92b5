"""Profile models of aligned families: their numbers, and the best local path of many proteins through one at once.

A model has columns with a match, an insert and a delete state each.  ``match[j, r]`` is the log2 odds of residue r in column j, and
``moves[j]`` the log2 chances of going on from column j: match to match, insert or delete, insert to match or insert, delete to match or
delete.  Inserted residues have the odds of the background.  A path enters at any match state with equal chance and leaves from any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from mobilome.functions import alignment_kernels as A

MM, MI, MD, IM, II, DM, DD = range(7)
#: Added counts: of residues that the seen ones would be replaced by, and of moves.
RESIDUE_WEIGHT = 5.0
MOVE_COUNTS = np.array([18.0, 0.6, 0.6, 1.0, 1.0, 1.0, 1.0])
_SHARES = ((MM, MI, MD), (IM, II), (DM, DD))
_NONE = -1e9
#: Random proteins, and their length, that a model's chance scores are fitted to.
DRAWS, DRAWN = 120, 200


@dataclass
class Profile:
    match: np.ndarray
    moves: np.ndarray
    mode: float = 0.0

    def __len__(self) -> int:
        return len(self.match)

    def packed(self) -> bytes:
        return np.concatenate(([len(self), self.mode], self.match.ravel(), self.moves.ravel())).astype("<f4").tobytes()


def unpacked(b: bytes) -> Profile:
    a = np.frombuffer(b, "<f4").astype(np.float32)
    n = int(a[0])
    return Profile(a[2 : 2 + 21 * n].reshape(n, 21), a[2 + 21 * n :].reshape(n, 7), float(a[1]))


def estimated(counts: np.ndarray) -> Profile:
    """A model from counts by column: of 20 residues, then of 7 moves."""
    seen, moves = counts[:, :20].astype(float), counts[:, 20:] + MOVE_COUNTS
    total = seen.sum(1, keepdims=True)
    replaced = A.BACKGROUND * 2.0 ** (A.substitution_matrix()[:20, :20] / 2.0)
    replaced /= replaced.sum(1, keepdims=True)
    expected = np.where(total > 0, seen / np.maximum(total, 1) @ replaced, A.BACKGROUND)
    chance = (seen + RESIDUE_WEIGHT * expected) / (total + RESIDUE_WEIGHT)
    match = np.hstack((np.log2(chance / A.BACKGROUND), np.zeros((len(counts), 1))))
    for own in _SHARES:
        moves[:, own] = np.log2(moves[:, own] / moves[:, own].sum(1, keepdims=True))
    return Profile(match.astype(np.float32), moves.astype(np.float32))


def best_paths(model: Profile, proteins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the best path of each protein, and the span of residues from its first match to its last.

    All proteins advance together; a run of deletes along the columns is a running maximum once the moves' sums are taken out.
    """
    p, n, size = len(proteins), max(map(len, proteins), default=0), len(model)
    letters = np.full((p, n), A.UNKNOWN, np.uint8)
    for row, s in zip(letters, proteins):
        row[: len(s)] = s
    lengths = np.array(list(map(len, proteins)))
    m = model.moves
    entry = -np.log2(max(1, size))
    passed = np.concatenate(([0.0], np.cumsum(m[:-1, DD], dtype=np.float64))) if size else np.zeros(0)
    low = np.full((p, size), _NONE)
    match, insert, delete = low.copy(), low.copy(), low.copy()
    # Where the path that ends in a state began.
    from_m, from_i, from_d = (np.zeros((p, size), np.int64) for _ in range(3))
    best, start, end = np.full(p, -np.inf), np.zeros(p, np.int64), np.zeros(p, np.int64)
    every = np.arange(p)
    for i in range(n):
        options = np.full((4, p, size), _NONE)
        options[0] = entry
        origins = np.full((4, p, size), i)
        for k, (state, origin, move) in enumerate(((match, from_m, MM), (insert, from_i, IM), (delete, from_d, DM)), 1):
            options[k, :, 1:] = state[:, :-1] + m[:-1, move]
            origins[k, :, 1:] = origin[:, :-1]
        choice = np.argmax(options, 0)
        grid = np.ogrid[:p, :size]
        new_match = np.where(i < lengths[:, None], options[choice, *grid] + model.match[:, letters[:, i]].T, _NONE)
        new_from = origins[choice, *grid]
        stay, come = insert + m[:, II], match + m[:, MI]
        from_i = np.where(come >= stay, from_m, from_i)
        insert = np.maximum(come, stay)
        match, from_m = new_match, new_from
        # Deletes: from the match of any earlier column of this row, by the moves between.
        opened = np.full((p, size), _NONE)
        opened[:, 1:] = match[:, :-1] + m[:-1, MD] - passed[1:]
        reached = np.maximum.accumulate(opened, 1)
        at = np.maximum.accumulate(np.where(opened >= reached, np.arange(size), 0), 1)
        delete = reached + passed
        from_d = from_m[every[:, None], np.maximum(at - 1, 0)]
        if size:
            place = np.argmax(match, 1)
            value = match[every, place]
            better = value > best
            best[better], start[better], end[better] = value[better], from_m[every, place][better], i + 1
    return best, start, end


def fitted(model: Profile) -> Profile:
    """The model with the mode of its chance scores: an extreme-value curve of rate ln 2 fitted to random proteins of one seed."""
    rng = np.random.default_rng(11)
    drawn = [rng.choice(20, DRAWN, p=A.BACKGROUND).astype(np.uint8) for _ in range(DRAWS)]
    scores = best_paths(model, drawn)[0]
    mode = -np.log(np.mean(np.exp(-np.log(2) * scores))) / np.log(2)
    return Profile(model.match, model.moves, float(mode))


def words(model: Profile, k: int, least: float, top: int = 7) -> list[tuple[int, str]]:
    """(column, word) of the words of ``k`` residues that score ``least`` bits at least from that column on, of the ``top`` residues of each."""
    order = np.argsort(-model.match[:, :20], axis=1, kind="stable")[:, :top]
    value = np.take_along_axis(model.match, order, 1)
    out = []
    for j in range(len(model) - k + 1):
        total, names = value[j], [A.RESIDUES[r] for r in order[j]]
        for c in range(j + 1, j + k):
            total = (total[:, None] + value[c]).ravel()
            names = [a + A.RESIDUES[r] for a in names for r in order[c]]
        out += [(j, names[i]) for i in np.flatnonzero(total >= least)]
    return out
