"""License scan: MinHash bands over overlapping text windows, then exact containment. DataFrame functions only.

A text's words become shingles of ``SHINGLE`` words, hashed to 64 bits. Windows of four times the longest template of a tier
overlap by half, so that every run of up to twice that length, a template with as many words put in between, lies whole in one window. A
window's signature is a one-permutation MinHash: the top bits of a shingle's hash name one of B bins, and each bin keeps its
smallest hash. Every bin is a band of one row: a window is a candidate of a template if they agree
in the minimum of any bin. Templates of like length share a tier with its own window length and B,
chosen so that a window that holds ``SIMILARITY`` of a template's shingles agrees with it somewhere
with a probability of at least 1 - ``MISS`` (see ``bins``). Candidates are then verified: the share of the
template's shingles that the window holds must be ``SIMILARITY`` or more.

Bands are evaluated from the templates' side: a window can only agree in a minimum that it holds as a shingle, so texts that
hold none of the templates' minima, nearly all, have no candidates and make no windows. The others' windows get their
minima.

Templates of fewer words than a shingle are one shingle of all their words; windows of one shingle
are their own minimum, so these are found for sure. Signatures are computed inside the row, by
higher-order functions; only windows that hit a template leave it, and nothing but matches is
shuffled. Several templates may share a name; its row is that of the best of them. Template keys are a literal set of at most ``KEYS_AT_ONCE``; larger template tables are
scanned in several passes over the text.

Defined results: null, empty and too short texts match nothing. Words are compared in lower case. A longer run than twice the
tier's longest template, up to the window's length, matches if the windows happen to hold enough of it.
Rows of equal id count as one document. Empty templates are left out; no templates: no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import words
from sextant.session import spread

SHINGLE = 5
SIMILARITY = 0.8
MISS = 1e-4
KEYS_AT_ONCE = 20_000
#: Largest template length, in shingles, of each tier; windows are four times as long and advance by twice as much.
TIERS = (1, 8, 64, 512, 4096, 32768)

#: License notices that documents carry as a line of their own.
NOTICES = (
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)


@dataclass(frozen=True)
class Tier:
    """Templates of ``size`` words a shingle and up to ``longest`` shingles."""

    size: int
    longest: int
    bits: int
    templates: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def stride(self) -> int:
        return 1 if self.longest == 1 else 2 * self.longest

    @property
    def window(self) -> int:
        return 1 if self.longest == 1 else 4 * self.longest


def bins(window: int, shortest: int) -> int:
    """log2 of the number of bins.

    Of the U different shingles of window and template, one is its bin's minimum with a probability of B / U (1 - exp(-U / B)).
    The window and the template agree in a bin if that minimum is one of the at least ``SIMILARITY * shortest`` shared ones;
    none of these is a minimum with a probability of the rest to their number's power.
    """
    shared = math.ceil(SIMILARITY * shortest)
    union = window + shortest - shared
    bits = 1
    while (1 - 2**bits / union * -math.expm1(-union / 2**bits)) ** shared > MISS:
        bits += 1
    return bits


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text.lower())


def tiers(templates: Sequence[tuple[str, str]]) -> list[Tier]:
    """Templates by words a shingle and length tier, in chunks of bounded key count."""
    groups: dict[tuple[int, int], list[tuple[str, tuple[str, ...]]]] = {}
    for name, text in templates:
        own = template_words(text or "")
        if own:
            size = min(SHINGLE, len(own))
            shingles = tuple(dict.fromkeys(" ".join(own[i : i + size]) for i in range(len(own) - size + 1)))
            longest = next((t for t in TIERS if t >= len(own) - size + 1), len(own))
            groups.setdefault((size, longest), []).append((name, shingles))
    found = []
    for (size, longest), members in sorted(groups.items()):
        chunk: list[tuple[str, tuple[str, ...]]] = []
        for member in members:
            if chunk and sum(len(s) for _, s in chunk) + len(member[1]) > KEYS_AT_ONCE:
                found.append((size, longest, tuple(chunk)))
                chunk = []
            chunk.append(member)
        found.append((size, longest, tuple(chunk)))
    return [Tier(size, longest, 0 if longest == 1 else bins(4 * longest, min(len(s) for _, s in members)), members) for size, longest, members in found]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Computes ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def _halves(size: int) -> tuple[int, int]:
    """A shingle's hash is that of its first half's, which has the word in the middle, and its second half's."""
    return (size + 1) // 2, size // 2


def _shingle(words_: Column, start: int, size: int) -> Column:
    """Hash of the shingle of ``size`` words from ``start`` on."""
    first, second = _halves(size)
    return F.xxhash64(words_[start]) if size == 1 else F.xxhash64(_shingle(words_, start, first), _shingle(words_, start + first, second))


def _joined(first: Column, second: Column, size: int) -> Column:
    """Hashes of the shingles of ``size`` words from those of their halves; none if there are fewer words."""
    many, few = _halves(size)
    least = lambda n: F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(first, 1, least(F.size(first) - few)), F.slice(second, many + 1, least(F.size(second) - many)), lambda x, y: F.xxhash64(x, y))


def _steps(sizes: Iterable[int]) -> list[int]:
    """The sizes and all that they are made of, in order."""
    found: set[int] = set()
    todo = list(sizes)
    while todo:
        size = todo.pop()
        if size not in found:
            found.add(size)
            todo += [half for half in _halves(size) if size > 1]
    return sorted(found)


def _minima(hashes: Column, bits: int) -> Column:
    """Each bin's smallest hash: in sorted order, the first of its bin."""
    top = lambda h: F.shiftright(h, 64 - bits)
    return _let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (top(h) != top(F.get(s, i - 1)))))


def template_table(spark: SparkSession, tier: Tier) -> DataFrame:
    """(license_id, shingles, keys): hashes of a tier's templates and their minima."""
    rows = spark.createDataFrame([(name, list(shingles)) for name, shingles in tier.templates], "license_id string, texts array<string>")
    hashed = rows.select("license_id", F.transform("texts", lambda t: _let(F.split(t, " "), lambda w: _shingle(w, 0, tier.size))).alias("shingles"))
    return hashed.withColumn("keys", _minima(F.col("shingles"), tier.bits) if tier.bits else F.col("shingles"))


def _constant(values: list, kind: str) -> Column:
    """A constant array, parsed as a whole."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _windows(hashes: Column, tier: Tier, owners: dict[int, list[int]], literals: dict[int, Column]) -> Column:
    """Windows that agree with a template in a minimum: array of (start, candidates, shingles). ``owners``: numbers of the templates of each minimum."""
    among = [literals[k] for k in owners]
    keys = sorted(owners)
    listed, numbers = _constant(keys, "array<bigint>"), _constant([owners[k] for k in keys], "array<array<int>>")
    candidates = lambda hits: F.array_distinct(F.flatten(F.transform(hits, lambda h: F.element_at(numbers, F.array_position(listed, h).cast("int")))))
    if tier.window == 1:
        hits = F.filter(F.transform(hashes, lambda h, i: F.struct(i.alias("start"), h.alias("hit"))), lambda w: w["hit"].isin(among))
        return F.transform(hits, lambda w: F.struct(w["start"].alias("start"), candidates(F.array(w["hit"])).alias("candidates"), F.array(w["hit"]).alias("shingles")))
    # A window that only repeats the end of the one before is not needed.
    last = F.greatest(F.lit(0), F.size(hashes) - 1 - (tier.window - tier.stride))
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), last, F.lit(tier.stride))).otherwise(F.array().cast("array<int>"))
    part = lambda s: F.slice(hashes, s + 1, tier.window)
    hits = lambda s: F.filter(_minima(part(s), tier.bits), lambda h: h.isin(among))
    found = F.transform(starts, lambda s: F.struct(s.alias("start"), hits(s).alias("hits")))
    return F.transform(F.filter(found, lambda w: F.size(w["hits"]) > 0), lambda w: F.struct(w["start"].alias("start"), candidates(w["hits"]).alias("candidates"), part(w["start"]).alias("shingles")))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license_id, containment, first_word) of every document and template that match.

    ``containment`` is the largest over the windows; ``first_word`` is the first word's index of the first
    window that reaches it.
    """
    spark = docs.sparkSession
    found = tiers(templates)
    empty = spark.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, license_id string, containment double, start int")
    if not found:
        return empty.select(F.col("id").alias(id_col), "license_id", "containment", F.col("start").cast("long").alias("first_word"))
    tables = [template_table(spark, t) for t in found]
    owners: list[dict[int, list[int]]] = []
    side = []
    for table in tables:
        own: dict[int, list[int]] = {}
        for r in table.collect():
            for key in r["keys"]:
                own.setdefault(key, []).append(len(side))
            side.append((len(side), r["license_id"], r["shingles"]))
        owners.append(own)
    # Each becomes a constant once: that is most of the time that planning takes.
    literals = {k: F.lit(k) for k in sorted({k for own in owners for k in own})}
    templates_ = spark.createDataFrame(side, "number int, license_id string, template array<long>")

    def held(hashes: Column, own: list[int]) -> Column:
        """The hashes if any of them is among these keys, else none: then no window can agree with a template."""
        return F.when(F.exists(hashes, lambda h: h.isin([literals[k] for k in own])), hashes).otherwise(F.array().cast("array<bigint>"))

    def of_tier(hashes: Column, number: int) -> Column:
        return _let(held(hashes, list(owners[number])), lambda h: _windows(h, found[number], owners[number], literals))

    sizes = {size: [n for n, t in enumerate(found) if t.size == size] for size in sorted({t.size for t in found})}

    steps = _steps(sizes)

    def of_hashes(known: dict[int, Column], size: int) -> list[Column]:
        """Matching windows of shingles of ``size`` words and more. ``known``: hashes of the sizes up to it."""
        parts = []
        if numbers := sizes.get(size):
            every = sorted({k for n in numbers for k in owners[n]})
            parts.append(_let(held(known[size], every), lambda h: F.concat(*[of_tier(h, n) for n in numbers])))
        if later := [n for n in steps if n > size]:
            halves = [known[n] for n in _halves(later[0])]
            parts.append(_let(_joined(*halves, later[0]), lambda h: F.concat(*of_hashes({**known, later[0]: h}, later[0]))))
        return parts

    def of_text(tokens: Column) -> Column:
        return _let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda own: F.concat(*of_hashes({1: own}, 1)))

    hits = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), F.explode(_let(words(F.lower(text_col)), of_text)).alias("w"))
    # The templates are in the plan already, as literal keys; their number does not follow the data's.
    candidates = hits.select("id", "w.start", "w.shingles", F.explode("w.candidates").alias("number")).join(F.broadcast(templates_), "number")
    share = F.size(F.array_intersect("template", "shingles")) / F.size("template")
    verified = candidates.select("id", "license_id", "start", share.alias("containment")).filter(F.col("containment") >= similarity)
    best = verified.groupBy("id", "license_id").agg(F.max("containment").alias("containment"), F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("first"))
    return best.select(F.col("id").alias(id_col), "license_id", "containment", (-F.col("first.back")).cast("long").alias("first_word"))
