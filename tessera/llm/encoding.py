"""Token ids of whole texts by a byte-level BPE vocabulary of ranks; the file's path is a parameter."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Where vocabulary files are. On a cluster every executor has the folder at this path, or another path is given.
FOLDER = "/opt/tokenizers"
RANKS = f"{FOLDER}/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern backs off over white space and runs out of stack where it is very long; such a run, but for a last blank before a word, is one piece.
_BLANKS = re.compile(r"\s{1000,}")


@lru_cache(maxsize=2)
def encoder(path: str = RANKS, pattern: str = PATTERN):
    """The encoder of a file of ranks, loaded once in each process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, path: str = RANKS) -> np.ndarray:
    """Ids of a text; strings of special tokens are ordinary text."""
    encode, piece = encoder(path).encode_ordinary, encoder(path)._encode_single_piece
    ids, at = [], 0
    if "  " in text or "\n\n" in text:
        for run in _BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += encode(text[at : run.start()]) + piece(text[run.start() : end].encode())
            at = end
    return np.array(ids + encode(text[at:]) if at else encode(text), np.int32)


def encoded(column: pa.Array, path: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's begin; nulls have none."""
    each = [token_ids(text, path) if text else np.empty(0, np.int32) for text in column.to_pylist()]
    return np.concatenate(each) if each else np.empty(0, np.int32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
