"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many of all rows; so there are always fewer hot keys than this.
HOT_PARTS = 10_000


def join_answers(rows: DataFrame, answers: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``answers`` that have their key; ``how`` is "inner" or "left".

    ``answers`` has each key once, with the number of its rows in ``size``; the
    column names of both sides are distinct but for ``key``.  The answers of hot keys
    are fewer than HOT_PARTS whatever the data, because their rows add up to all
    rows at most; they are broadcast, so the rows of a hot key stay where they are.
    All other rows are shuffled to their answer.  Both sides are read more than once: pass written tables.
    """
    total = answers.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    is_hot = F.col(size) > F.lit(total) / HOT_PARTS
    hot, rest = answers.filter(is_hot), answers.filter(~is_hot)
    met = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return met.unionByName(others.join(rest, key, how))
