"""Batches of rows cut by what their texts hold, because Arrow cuts them by rows alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

#: Characters that a kernel sees at a time, one row at least; what it makes of them is many times as large.
CHARACTERS = 1_000_000


def portions(batches: Iterable[pd.DataFrame], *columns: str, most: int | None = None) -> Iterator[pd.DataFrame]:
    """The rows of all batches in order, in frames whose ``columns`` hold about ``most`` characters together; an empty batch stays one."""
    most = CHARACTERS if most is None else most
    for pdf in batches:
        size = sum(pdf[c].str.len().fillna(0).to_numpy(np.int64) for c in columns) + 1 if len(pdf) else np.zeros(0, np.int64)
        at = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(pdf)]
        for a, z in zip(cuts, cuts[1:]):
            yield pdf.iloc[a:z].reset_index(drop=True)
