"""Public tokenizers inside Python workers.

The vocabulary files are found by ``public_tokenizers.path(name)`` on the
machine of the task. What is loaded is kept in the worker for later tasks.
"""

from __future__ import annotations

import sys
import types

VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks, for the faster encoder.
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"


def kept(key: tuple, make):
    """What ``make`` gives, made once per worker process."""
    store = sys.modules.setdefault("fieldglass_worker_store", types.ModuleType("fieldglass_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def library(name: str = VOCABULARY):
    """The tokenizer as its library loads it."""

    def load():
        import public_tokenizers
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(public_tokenizers.path(name))
        found.no_truncation()
        found.no_padding()
        return found

    return kept(("library", name), load)


def fast_encoder(name: str = RANKS):
    """An encoder of the same vocabulary that gives the same ids for texts without special strings."""

    def load():
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    return kept(("fast", name), load)


def token_ids(text: str):
    """The ids of a whole text as the library gives them, as an array of 32-bit numbers."""
    import numpy as np

    if SPECIAL in text:
        return np.array(library().encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(fast_encoder().encode_ordinary(text), dtype="<u4")

