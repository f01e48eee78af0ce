"""Token ids of whole texts with the public byte-level vocabulary.

``byte_bpe_50k.json`` and ``byte_bpe_50k.tiktoken`` hold one vocabulary and
give the same ids; the second library takes about a quarter of the CPU time.
The two differ only where a text spells a special token, which the first reads
as that token; such texts go through the first.  So do texts with very long runs
of white space, on which the second's pattern matcher runs out of stack.

Cases: an empty text has no ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np


@functools.cache
def _pair(json_path: str | None, ranks_path: str | None):
    import public_tokenizers
    import tiktoken

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.ones(max(ranks.values()) + 2, dtype=np.int64)
    for piece, i in ranks.items():
        sizes[i] = len(piece)
    sizes[-1] = len(SPECIAL)
    return fast, json_path or public_tokenizers.path("byte_bpe_50k.json"), sizes


@functools.cache
def _slow(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


SPECIAL = "<|endoftext|>"
LONG_RUN = 20_000  # white space in a row; the matcher takes some hundred thousand
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


def encode(text: str, json_path: str | None = None, ranks_path: str | None = None) -> list[int]:
    """Ids of one whole text, as tokenizers gives them with add_special_tokens=False."""
    fast, path, _ = _pair(json_path, ranks_path)
    if SPECIAL in text or len(text) >= LONG_RUN and _LONG_RUN.search(text):
        return _slow(path).encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def byte_sizes(json_path: str | None = None, ranks_path: str | None = None) -> np.ndarray:
    """Bytes of text that each id stands for; the pieces of a text's ids, joined, are its UTF-8 bytes."""
    return _pair(json_path, ranks_path)[2]
