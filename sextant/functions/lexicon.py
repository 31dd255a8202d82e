"""A small default lexicon for informal Tagalog-English text.

It covers common chat spellings and serves as an example of the tables; larger ones come in
through ``Lexicon.from_rows``. Prefixes and the context rule are fixed values; the other tables are a sample of common words.
"""

from __future__ import annotations

from sextant.functions.text import Lexicon

RULES = (
    ("d q", "hindi ko"),
    ("w/o", "without"),
    ("aq", "ako"),
    ("akoh", "ako"),
    ("cya", "siya"),
    ("d2", "dito"),
    ("dn", "din"),
    ("gud", "good"),
    ("kc", "kasi"),
    ("kse", "kasi"),
    ("lng", "lang"),
    ("nmn", "naman"),
    ("pic", "picture"),
    ("pix", "pictures"),
    ("pls", "please"),
    ("plz", "please"),
    ("sna", "sana"),
    ("thx", "thanks"),
    ("u", "you"),
    ("wla", "wala"),
    ("w/", "with"),
    ("bday", "birthday"),
    ("b4", "before"),
    ("tmrw", "tomorrow"),
)
# The rule that applies by context, and the verb prefixes in the order in which they are tried.
CONTEXT = (("san", "saan"),)
PREFIXES = ("naka", "nag", "mag", "na", "ma")
VERBS = frozenset("bake bike call camp climb cook dance drive eat hike jog paint party picnic play ride run sail shop sing sit ski sleep smile stand surf swim travel upload walk wave write".split())
REPEATS = frozenset(f"{w} {w}" for w in "araw gabi isa sino sabay iba maya".split())
DEFAULT = Lexicon(RULES, CONTEXT, VERBS, PREFIXES, REPEATS)

TRANSLATIONS = {
    "aso": "dog", "pusa": "cat", "bahay": "house", "dagat": "sea", "bundok": "mountain", "araw": "sun", "ulan": "rain", "bata": "child", "pamilya": "family", "pagkain": "food", "bulaklak": "flower", "puno": "tree",
    "dog": "aso", "cat": "pusa", "house": "bahay", "sea": "dagat", "mountain": "bundok", "sun": "araw", "rain": "ulan", "child": "bata", "family": "pamilya", "food": "pagkain", "flower": "bulaklak", "tree": "puno",
}
STOP_WORDS = frozenset("a an and are as at be by for from in is it of on or that the this to was with ang ng sa mga at ay na ni si kay para".split())
