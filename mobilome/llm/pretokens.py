"""Pre-tokens exactly as a byte-level BPE tokenizer cuts them, at split() speed.

A text is cut at single spaces between two non-spaces.  The pattern below never
matches across such a space, so each piece (with its leading space) can be
looked up in a table of pieces seen before; only a new piece is matched.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the pre-token pattern of the byte-level tokenizer.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Below this code point the pattern's classes agree with the tokenizer's own; beyond it, the tokenizer cuts.
AGREED = "՘"

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once per process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def specials(tok) -> list[str]:
    """The special strings that the tokenizer takes out of a text first."""
    return sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)


def cut(tok, text: str) -> Sequence[str]:
    """The pre-tokens of ``text``, which holds no special string."""
    if not text:
        return ()
    if text.isascii() or max(text) < AGREED:
        return PATTERN.findall(text)
    return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]


#: White space beside a space, or a space at the end: there, cutting at single spaces is not exact.
UNSAFE = re.compile(r"\s | \s| \Z")


def pieces(tok, text: str) -> Counter:
    """How often each piece occurs in ``text``, which holds no special string.

    A str key stands for a piece with a space before it, a 1-tuple for a
    pre-token by itself.
    """
    if UNSAFE.search(text):
        return Counter((p,) for p in cut(tok, text))
    first, *rest = text.split(" ")
    found = Counter(rest)
    for p in cut(tok, first):
        found[(p,)] += 1
    return found


def cut_all(tok, keys: list) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of many keys end to end, and for each the place of its key.

    Pieces are matched in one go: only the first pre-token of a piece opens with
    a space, so the matches tell where each piece begins.
    """
    plain = [i for i, k in enumerate(keys) if isinstance(k, str) and (k.isascii() or max(k) < AGREED)]
    found = PATTERN.findall(" " + " ".join([keys[i] for i in plain])) if plain else []
    place = np.cumsum(np.fromiter((p[0] == " " for p in found), np.int64, len(found))) - 1
    owner = [np.array(plain, np.int64)[place]] if plain else []
    for i in sorted(set(range(len(keys))).difference(plain)):
        own = (keys[i][0],) if isinstance(keys[i], tuple) else cut(tok, " " + keys[i])
        found += own
        owner.append(np.full(len(own), i, np.int64))
    return found, np.concatenate(owner) if owner else np.zeros(0, np.int64)
