"""Suffix stripping of English words, after Porter's published algorithm (1980), with the usual departures: irregular words, short words in -ies and -ied, -y after a vowel, and a few more suffixes."""

from __future__ import annotations

import re
from functools import lru_cache

#: Suffixes and what they become, by step; each needs a measure of its stem above 0 (step 4: above 1).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "fulli": "ful",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Words that have a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing",
    "canning": "canning", "cannings": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _kinds(stem: str) -> str:
    """c or v for each letter; a y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(stem):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Does it end in consonant, vowel, consonant, the last one not w, x or y; or is it a vowel and a consonant?"""
    kinds = _kinds(word)
    return (kinds[-3:] == "cvc" and word[-1] not in "wxy") or kinds == "vc"


def _replace(word: str, table: dict[str, str], above: int) -> str:
    """The longest suffix of the table that fits decides; it is replaced if the measure of what is left is large enough."""
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            good = _measure(stem) > above and (end != "ion" or stem[-1:] in ("s", "t"))
            return stem + table[end] if good else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = False
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _kinds(word[:-2]):
        word, cut = word[:-2], True
    elif word.endswith("ing") and "v" in _kinds(word[:-3]):
        word, cut = word[:-3], True
    if cut:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and len(word) > 2 and _kinds(word)[-2] == "c":
        word = word[:-1] + "i"
    again = word.endswith("alli")
    word = _replace(word, STEP_2, 0)
    if again and not word.endswith("alli"):
        word = _replace(word, STEP_2, 0)
    if word.endswith("logi") and _measure(word[:-3]) > 0:
        word = word[:-1]
    word = _replace(word, STEP_3, 0)
    word = _replace(word, dict.fromkeys(STEP_4, ""), 1)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
