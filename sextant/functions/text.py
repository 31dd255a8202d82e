"""Rule-driven normalisation of informal, code-switched text as Column expressions.

The stages run in a fixed order: case folding, dictionary substitution, apostrophes and hyphens,
character runs, punctuation spacing, affix stripping, reduplication. Rule tables are parameters
(``Lexicon``); nothing here depends on a language. Word borders are ASCII borders throughout: a
letter with an accent separates words, as rule keys are plain ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The punctuation that is set apart, the stages' names and the minimal -ing length.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STAGES = ("CaseFolding", "DictionarySubstitution", "ApostropheHyphen", "CharRunCollapse", "PunctuationSpacing", "AffixStripping", "Reduplication")
ING_LONGER_THAN = 4

_PUNCTUATION_CLASS = "([!-/:-@\\[-`{-~])"
_WORD = re.compile(r"\w+", re.ASCII)


@dataclass(frozen=True)
class Lexicon:
    """Rule tables of the normaliser.

    rules: ordered (key, value) substitutions at word borders; a later rule sees earlier results.
    context: whole-token replacements. verbs: stems that affix stripping may arrive at. prefixes: tried in
    order. repeats: "word word" pairs that reduplication leaves alone.
    """

    rules: tuple[tuple[str, str], ...] = ()
    context: tuple[tuple[str, str], ...] = ()
    verbs: frozenset[str] = frozenset()
    prefixes: tuple[str, ...] = ()
    repeats: frozenset[str] = frozenset()

    @classmethod
    def from_rows(cls, rules: DataFrame, **tables) -> Lexicon:
        """Rules from a table (ord, key, value), kept in ``ord`` order. Rule tables are small by nature; they become literals."""
        rows = rules.orderBy("ord").select("key", "value").collect()
        return cls(rules=tuple((r["key"], r["value"]) for r in rows), **tables)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def phases(rules: Sequence[tuple[str, str]]) -> list[tuple[str, dict[str, str]]]:
    """Compiles ordered rules to as few passes as give the same result.

    A stretch of single-word rules with distinct keys is one lookup pass, as long as none of its
    values holds, as a word, a key that comes later in the stretch. A rule with another key is a
    pass of its own. Rules that change nothing are left out.
    """
    found: list[tuple[str, dict[str, str]]] = []
    for key, value in rules:
        if key == value:
            continue
        if not _WORD.fullmatch(key):
            found.append(("regex", {key: value}))
            continue
        stretch = found[-1][1] if found and found[-1][0] == "lookup" else None
        if stretch is None or key in stretch or any(key in _WORD.findall(v) for v in stretch.values()) or any(not (_WORD.fullmatch(v[:1]) and _WORD.fullmatch(v[-1:])) for v in stretch.values()):
            stretch = {}
            found.append(("lookup", stretch))
        stretch[key] = value
    return found


def lookup(token: Column, table: dict[str, str]) -> Column:
    """Value of a token, or the token. The hashed membership test spares most tokens the map."""
    if not table:
        return token
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(token.isin(*table), F.element_at(pairs, token)).otherwise(token)


def _border_pattern(key: str) -> str:
    """ASCII word borders on both ends of a literal key."""
    before = "(?<![A-Za-z0-9_])" if _WORD.match(key[0]) else "(?<=[A-Za-z0-9_])"
    after = "(?![A-Za-z0-9_])" if _WORD.match(key[-1]) else "(?=[A-Za-z0-9_])"
    return before + re.sub(r"([\W_])", r"\\\1", key, flags=re.ASCII).replace("\\_", "_") + after


def fold_case(text: Column) -> Column:
    return F.lower(text)


def substitute(text: Column, lexicon: Lexicon) -> Column:
    """Dictionary substitution, then whole-token replacements between single spaces."""
    for kind, table in phases(lexicon.rules):
        if kind == "regex":
            ((key, value),) = table.items()
            text = F.regexp_replace(text, _border_pattern(key), value.replace("\\", "\\\\").replace("$", "\\$"))
        else:
            pieces = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
            text = F.array_join(_looked_up(pieces, table), "")
    if lexicon.context:
        text = F.array_join(_looked_up(F.split(text, " "), dict(lexicon.context)), " ")
    return text


def _looked_up(tokens: Column, table: dict[str, str]) -> Column:
    return F.transform(tokens, lambda token: lookup(token, table))


def drop_apostrophes(text: Column) -> Column:
    """Deletes apostrophes, turns hyphens to spaces."""
    return F.replace(F.replace(text, F.lit("'"), F.lit("")), F.lit("-"), F.lit(" "))


def collapse_runs(text: Column) -> Column:
    """Three or more of a character become two."""
    return F.regexp_replace(text, "(.)\\1{2,}", "$1$1")


def space_punctuation(text: Column) -> Column:
    """Sets ASCII punctuation apart, one space between tokens."""
    return squeeze(F.regexp_replace(text, _PUNCTUATION_CLASS, " $1 "))


def squeeze(text: Column) -> Column:
    """White space (Unicode) to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def tokens(text: Column) -> Column:
    """Tokens between white space; none for an empty text."""
    return F.filter(F.split(squeeze(text), " "), lambda t: t != "")


def strip_ing(token: Column, verbs: frozenset[str]) -> Column:
    """Stem of an -ing form if it is a known verb: plain, with a doubled consonant undone, or with an e; else null."""
    known = lambda stem: stem.isin(*sorted(verbs)) if verbs else F.lit(False)
    stem = F.left(token, F.char_length(token) - 3)
    undone = F.left(stem, F.char_length(stem) - 1)
    doubled = (F.char_length(stem) >= 2) & (F.right(stem, F.lit(1)) == F.right(undone, F.lit(1)))
    with_e = F.concat(stem, F.lit("e"))
    found = F.when(known(stem), stem).when(doubled & known(undone), undone).when(known(with_e), with_e)
    return F.when(F.endswith(token, F.lit("ing")) & (F.char_length(token) > ING_LONGER_THAN), found)


def strip_affixes(token: Column, lexicon: Lexicon) -> Column:
    """Verb stem of an affixed token; the token itself if none is found.

    The first prefix that leaves a known verb, with or without -ing, decides; without any, -ing alone is tried.
    """
    if not lexicon.verbs:
        return token
    tried = []
    for prefix in lexicon.prefixes:
        stem = F.right(token, F.char_length(token) - len(prefix))
        own = F.when(stem.isin(*sorted(lexicon.verbs)), stem).otherwise(strip_ing(stem, lexicon.verbs))
        tried.append(F.when(F.startswith(token, F.lit(prefix)) & (F.char_length(token) > len(prefix)), own))
    return F.coalesce(*tried, strip_ing(token, lexicon.verbs), token)


def drop_repeats(words: Column, lexicon: Lexicon) -> Column:
    """Drops a token equal to the one before it, unless the pair is a listed repetition."""
    allowed = sorted(lexicon.repeats)

    def kept(token: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        listed = F.concat_ws(" ", before, token).isin(*allowed) if allowed else F.lit(False)
        return (i == 0) | (token != before) | listed

    return F.filter(words, kept)


def stages(lexicon: Lexicon) -> list[Callable[[Column], Column]]:
    """What each of STAGES does to a text."""
    return [
        fold_case,
        lambda t: substitute(t, lexicon),
        drop_apostrophes,
        collapse_runs,
        space_punctuation,
        lambda t: F.array_join(F.transform(tokens(t), lambda token: strip_affixes(token, lexicon)), " "),
        lambda t: let(tokens(t), lambda words: F.array_join(drop_repeats(words, lexicon), " ")),
    ]


def normalise(text: Column, lexicon: Lexicon, passes: int = 1) -> Column:
    """All stages; ``passes`` repeats the whole chain. Null stays null, empty stays empty."""
    for _ in range(passes):
        for step in stages(lexicon):
            text = let(text, step)
    return text


def trace(df: DataFrame, text_col: str, lexicon: Lexicon) -> DataFrame:
    """A row for each stage and text: (rule, step, before, after, fired) beside the input's columns. Empty texts have no stages."""
    current = df.filter(F.char_length(text_col) > 0).withColumn("stage_0", F.col(text_col))
    for i, step in enumerate(stages(lexicon)):
        current = current.withColumn(f"stage_{i + 1}", let(F.col(f"stage_{i}"), step))
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("rule"), F.col(f"stage_{i}").alias("before"), F.col(f"stage_{i + 1}").alias("after")) for i, name in enumerate(STAGES)])
    return current.select(*df.columns, F.inline(rows)).withColumn("fired", F.col("before") != F.col("after"))


def is_punctuation(token: Column) -> Column:
    return F.rlike(token, F.lit("^[!-/:-@\\[-`{-~]+$"))


def without_punctuation(words: Column) -> Column:
    return F.filter(words, lambda t: ~is_punctuation(t))


def plain_words(words: Column) -> Column:
    """Tokens of ASCII letters only."""
    return F.filter(words, lambda t: F.rlike(t, F.lit("^[a-zA-Z]+$")))


def unknown_share(text: Column, vocabulary: Sequence[str]) -> Column:
    """Share of a text's characters that a vocabulary lacks; 0 for a blank text. Spaces are the vocabulary's own sign."""
    symbols = F.split(F.replace(text, F.lit(" "), F.lit("▁")), "")
    unknown = F.size(F.filter(symbols, lambda c: ~c.isin(*vocabulary)))
    return F.when(F.char_length(F.trim(text)) == 0, F.lit(0.0)).otherwise(unknown / F.size(symbols))


def prompt(text: Column) -> Column:
    """Wraps short labels in a caption; longer phrases stand for themselves."""
    return F.when((F.instr(text, " ") > 0) & (F.char_length(text) > 20), text).otherwise(F.concat(F.lit("a photo of "), text))
