"""The English (Porter2) stemmer, from its published description; words are lower case."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
#: Fixed values of the algorithm.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
AFTER_PLURALS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = tuple("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
#: A vowel that counts, then a consonant: the end of the word before a region.
REGION = re.compile(r"[aeiouy][^aeiouy]")
SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin in which suffixes may be taken off."""
    special = re.match(r"gener|commun|arsen", word)
    first = special.end() if special else (m.end() if (m := REGION.search(word)) else len(word))
    second = m.end() if (m := REGION.search(word, first)) else len(word)
    return first, second


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    first, second = _regions(word)
    word = word.removesuffix(_longest(word, ("'", "'s", "'s'")))
    if word in WHOLE:
        return WHOLE[word]
    if word in UNCHANGED:
        return word
    word = _plurals(word)
    if word in AFTER_PLURALS:
        return word
    word = _participles(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _step2(word, first)
    if (s := _longest(word, STEP3)) and len(word) - len(s) >= (second if s == "ative" else first):
        word = word.removesuffix(s) + STEP3[s]
    if (s := _longest(word, STEP4)) and len(word) - len(s) >= second and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word.removesuffix(s)
    if word.endswith("e"):
        if len(word) - 1 >= second or (len(word) - 1 >= first and not SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


def word_prefix(term: str) -> str:
    """What every word whose stem is term starts with, after at most one apostrophe.

    Steps cut a word's end, and put no other letters there than e, i, l after b, le, y, and ie in three whole words.
    """
    if term.endswith(("le", "ie")):
        return term[:-2]
    return term[:-1] if term.endswith(("e", "i", "l", "y")) else term


def _plurals(word: str) -> str:
    s = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        return word[:-2]
    if s in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if s == "s" and re.search(r"[aeiouy]", word[:-2]):
        return word[:-1]
    return word


def _participles(word: str, first: int) -> str:
    s = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    rest = word.removesuffix(s)
    if s in ("eed", "eedly"):
        return rest + "ee" if len(rest) >= first else word
    if not s or not re.search(r"[aeiouy]", rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if DOUBLE.search(rest):
        return rest[:-1]
    return rest + "e" if len(rest) <= first and SHORT_END.search(rest) else rest


def _step2(word: str, first: int) -> str:
    s = _longest(word, STEP2)
    rest = word.removesuffix(s)
    if not s or len(rest) < first:
        return word
    if (s == "ogi" and not rest.endswith("l")) or (s == "li" and not re.search(r"[cdeghkmnrt]$", rest)):
        return word
    return rest + STEP2[s]
