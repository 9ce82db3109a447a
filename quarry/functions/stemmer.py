"""Tokens of a text and their stems by Porter's 1980 algorithm.

A token is a maximal run of ASCII letters and digits, in lower case. Stems come
from pandas-free Arrow functions over distinct tokens only."""

from __future__ import annotations

import re
from functools import lru_cache

TOKEN = "[A-Za-z0-9]+"
_TOKEN = re.compile(TOKEN)

#: Suffixes and what replaces them, in the order in which a step tries them.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def tokens(text: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(text)]


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(stem: str) -> int:
    """How many vowel-consonant sequences a stem has."""
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _closed(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: tuple) -> str:
    for suffix, new in rules:
        if word.endswith(suffix) and measure(word[: -len(suffix)]) > 0:
            return word[: -len(suffix)] + new
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    # Plurals.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and progressive forms.
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and _closed(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP_2)
    word = _replaced(word, STEP_3)
    longest = max((s for s in STEP_4 if word.endswith(s)), key=len, default="")
    if longest:
        base = word[: -len(longest)]
        if measure(base) > 1 and (longest != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _closed(word[:-1])):
            word = word[:-1]
    if measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word
