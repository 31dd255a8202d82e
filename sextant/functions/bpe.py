"""Byte-pair encoding with a tokenizer file, as Arrow functions.

Reads the common JSON form: a vocabulary (map, or list of [token, score] pairs), merges ("a b" or
pairs), added tokens, byte fallback and fusing of unknowns. Symbols are code points.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Special ids, length of an encoded query, and the sign that stands for a space.
PAD, EOS, BOS, UNKNOWN = 0, 1, 2, 3
LENGTH = 64
SPACE_SIGN = "▁"

#: Stretches of at most so many characters are remembered with their symbols, so many at a time.
KNOWN_LENGTH, KNOWN_STRETCHES = 32, 65_536


@dataclass
class Tokenizer:
    """Vocabulary and merge ranks. ``eos_in_cut``: the end token is added before cutting and forced into the last slot."""

    vocabulary: dict[str, int]
    ranks: dict[tuple[str, str], int]
    byte_fallback: bool = False
    fuse_unknown: bool = True
    eos_in_cut: bool = False
    tokens: dict[int, str] = field(default_factory=dict)
    joints: set[tuple[str, str]] = field(init=False, repr=False, compare=False)
    known: dict[str, list[str]] = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.tokens = {i: t for t, i in self.vocabulary.items()}
        # Characters between which a merge can close a gap: the last of its left and the first of its right part.
        self.joints = {(left[-1], right[0]) for left, right in self.ranks if left and right}

    @classmethod
    def from_json(cls, text: str, **options) -> Tokenizer:
        data = json.loads(text)
        model = data["model"]
        listed = model["vocab"]
        vocabulary = dict(listed) if isinstance(listed, dict) else {entry[0] if isinstance(entry, list) else entry: i for i, entry in enumerate(listed)}
        vocabulary |= {t["content"]: t["id"] for t in data.get("added_tokens") or ()}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges") or ()]
        options = {"byte_fallback": model.get("byte_fallback", False), "fuse_unknown": model.get("fuse_unk", True)} | options
        return cls(vocabulary, {m: i for i, m in enumerate(merges)}, **options)

    def pieces(self, text: str) -> list[str]:
        """Symbols of a text after all merges: always the leftmost pair of the lowest rank.

        No merge reaches over two neighbouring characters at which no pair of the ranks meets, so the stretches between them
        are merged each by itself.
        """
        signs = text.replace(" ", SPACE_SIGN)
        joints, known, symbols, start = self.joints, self.known, [], 0
        for end, pair in enumerate(zip_longest(signs, signs[1:]), 1):
            if pair in joints:
                continue
            if end - start == 1:
                symbols.append(signs[start])
            else:
                stretch = signs[start:end]
                found = known.get(stretch)
                if found is None:
                    found = self._merged(list(stretch))
                    if len(stretch) <= KNOWN_LENGTH:
                        if len(known) >= KNOWN_STRETCHES:
                            known.clear()
                        known[stretch] = found
                symbols += found
            start = end
        return symbols

    def _merged(self, symbols: list[str]) -> list[str]:
        """``pieces`` of one stretch in n log n steps: pairs wait in a heap, and those that a merge has changed are passed over."""
        ranks, n = self.ranks, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(rank, i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (rank := ranks.get(pair, -1)) >= 0]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            if not symbols[i] or j == n or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i], symbols[j], after[i] = symbols[i] + symbols[j], "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (rank := ranks.get((symbols[left], symbols[after[left]]), -1)) >= 0:
                    heapq.heappush(waiting, (rank, left))
        return [s for s in symbols if s]

    def raw(self, text: str) -> list[int]:
        """Ids of a text, without end token or padding."""
        ids: list[int] = []
        for symbol in self.pieces(text):
            if symbol in self.vocabulary:
                ids.append(self.vocabulary[symbol])
                continue
            bytes_ = [f"<0x{b:02X}>" for b in symbol.encode()] if self.byte_fallback else []
            if bytes_ and all(b in self.vocabulary for b in bytes_):
                ids += [self.vocabulary[b] for b in bytes_]
            elif not (self.fuse_unknown and ids and ids[-1] == UNKNOWN):
                ids.append(UNKNOWN)
        return ids

    def encode(self, text: str, length: int = LENGTH) -> list[int]:
        """Ids with an end token, cut and padded to ``length``."""
        ids = self.raw(text)
        if self.eos_in_cut:
            ids = [*ids, EOS][:length]
            if len(ids) == length:
                ids[-1] = EOS
        else:
            ids = [*ids[: length - 1], EOS]
        return ids + [PAD] * (length - len(ids))

    def decode(self, ids: list[int]) -> str:
        """Text of ids; control tokens and tokens that begin with ``<`` are left out."""
        tokens = [self.tokens.get(i, "") for i in ids if i not in (PAD, EOS, BOS)]
        return "".join(t for t in tokens if not t.startswith("<")).replace(SPACE_SIGN, " ").strip()


def encode(text: Column, tokenizer: Tokenizer, length: int = LENGTH) -> Column:
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else tokenizer.encode(t, length))

    return run(text)


def encode_raw(text: Column, tokenizer: Tokenizer) -> Column:
    """Ids with the end token, neither cut nor padded."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [*tokenizer.raw(t), EOS])

    return run(text)


def decode(ids: Column, tokenizer: Tokenizer) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda r: None if r is None else tokenizer.decode([int(i) for i in r]))

    return run(ids)


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: F.when(i != PAD, 1).otherwise(0))


def letters_tokenizer(**options) -> Tokenizer:
    """A small tokenizer by rule: control tokens, bytes, letters, and all merges of two common letters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = "aeinorst"
    merges = [(a, b) for a in common for b in common]
    tokens = ["<pad>", "<eos>", "<bos>", "<unk>", *(f"<0x{b:02X}>" for b in range(256)), SPACE_SIGN, *letters, *(a + b for a, b in merges)]
    return Tokenizer({t: i for i, t in enumerate(tokens)}, {m: i for i, m in enumerate(merges)}, **options)
