"""The English (Porter2) stemmer, written from its published description."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=len, reverse=True)


def _by_last(ends: list, key=lambda x: x) -> dict[str, list]:
    """Endings by their last letter, in their order."""
    return {c: [x for x in ends if key(x)[-1] == c] for c in {key(x)[-1] for x in ends}}


STEP2, STEP3, STEP4 = _by_last(STEP2, lambda x: x[0]), _by_last(STEP3, lambda x: x[0]), _by_last(STEP4)
#: A word that ends otherwise is its own stem.
TOUCHED = frozenset("sdgyel") | STEP2.keys() | STEP3.keys() | STEP4.keys()
REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        m = REGION.search(word)
        first = m.end() if m else len(word)
    m = REGION.search(word, first)
    return first, m.end() if m else len(word)


def _short_syllable(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")):
        return w
    return w[:-1] if w.endswith("s") and _has_vowel(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            if not _has_vowel(stem := w[: -len(end)]):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem.endswith(DOUBLES):
                return stem[:-1]
            return stem + "e" if r1 >= len(stem) and _short_syllable(stem) else stem
    return w


def _replace(w: str, r1: int, r2: int, table: dict[str, list[tuple[str, str]]]) -> str:
    for end, new in table.get(w[-1:], ()):
        if w.endswith(end):
            at = len(w) - len(end)
            allowed = at >= (r2 if end == "ative" else r1)
            if end == "ogi":
                allowed = allowed and w[at - 1 : at] == "l"
            if end == "li":
                allowed = allowed and w[at - 1 : at] in tuple(LI_BEFORE)
            return w[:at] + new if allowed else w
    return w


def _suffix(w: str, r2: int) -> str:
    for end in STEP4.get(w[-1:], ()):
        if w.endswith(end):
            at = len(w) - len(end)
            return w[:at] if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")) else w
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    if word[-1] not in TOUCHED:
        return word
    w = re.sub("(^|[aeiouy])y", r"\1Y", word)  # from left to right: a y so marked is no vowel for the next
    r1, r2 = _regions(w)
    w = _plural(w)
    if w in AFTER_1A:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _replace(w, r1, r2, STEP2)
    w = _replace(w, r1, r2, STEP3)
    w = _suffix(w, r2)
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
