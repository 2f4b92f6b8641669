"""Byte-level BPE ids of whole texts, for the operators that count or store tokens.

The vocabulary is a ``tokenizers`` JSON file without normaliser (byte-level BPE,
ids in merge order). Such a file holds the same ranks as a rank file, so the ids
are made with ``tiktoken``'s merge loop, several times as fast as the other
library's; tests compare both on every text of a table.
"""

from __future__ import annotations

import functools
import json

import numpy as np


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies show for each byte:
    itself where printable in Latin-1, else the next free code from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """ids(text) -> uint32 array, equal to the library's with add_special_tokens=False."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = byte_symbols()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return functools.partial(encoding.encode_to_numpy, allowed_special="all")


def with_end(path: str, text: str, end_id: int) -> np.ndarray:
    """Little-endian uint32 ids of ``text`` followed by ``end_id``."""
    ids = encoder(path)(text)
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = end_id
    return out
