"""Token ids of a public byte-level vocabulary, per worker."""

from __future__ import annotations

import base64
import functools


@functools.lru_cache(maxsize=2)
def encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    path = path or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
