"""Public byte-level BPE, loaded once per Python worker.

The vocabulary file is a parameter; its default is the installed package of public vocabularies.
Ids are those of ``tokenizers`` with the JSON file and ``add_special_tokens=False``. Texts without
control strings of the vocabulary go through ``tiktoken`` with the ranks file of the same vocabulary,
whose ids are the same (tests compare them) at about a quarter of the time. A text that holds a
control string, or that exhausts the fast library's stack, goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable
from functools import lru_cache

NAME = "byte_bpe_50k"


@lru_cache(maxsize=4)
def exact_encoder(path: str) -> Callable[[str], list[int]]:
    """Encoding function of ``tokenizers`` for a JSON file, as it is configured."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    return lambda text: exact.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def control_strings(path: str) -> tuple[str, ...]:
    """Strings that the vocabulary of a JSON file takes as one token wherever they stand."""
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file)["added_tokens"])


@lru_cache(maxsize=4)
def encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """Encoding function for a ``tokenizers`` JSON file, fast where its ranks file lies beside it."""
    import public_tokenizers

    path = path or public_tokenizers.path(f"{NAME}.json")
    ranks_path = f"{path.removesuffix('.json')}.tiktoken"
    if not os.path.exists(ranks_path):
        return exact_encoder(path)
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    controls = control_strings(path)

    def encode(text: str) -> list[int]:
        if any(c in text for c in controls):
            return exact_encoder(path)(text)
        try:
            return fast(text)
        except BaseException as error:
            # Runs of about a million white spaces exhaust the pattern's stack, which comes up as a panic of the
            # native library: no Exception. Interrupts and exits pass.
            if type(error).__name__ != "PanicException":
                raise
            return exact_encoder(path)(text)

    return encode
