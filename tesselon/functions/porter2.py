"""The English (Porter2) stemmer, after its published description."""

from __future__ import annotations

import re

#: Fixed values of the description, down to DOUBLES.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "evening", "proceed", "exceed", "succeed"}
R1_PREFIXES = ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ", "inter")
STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in R1_PREFIXES if word.startswith(p)), None)
    if r1 is None:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _short_end(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in "aeiouy" and w[1] not in "aeiouy"
    return w == "past" or len(w) > 2 and w[-3] not in "aeiouy" and w[-2] in "aeiouy" and w[-1] not in "aeiouywxY"


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.replace("’", "'").removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    w = _step1a(w)
    if w in AFTER_1A:
        return w
    w = _step1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _step2(w, r1)
    w = _step3(w, r1, r2)
    for end in sorted((*STEP4, "ion"), key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _step1a(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")):
        return w
    if w.endswith("s") and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _step1b(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if not w.endswith(end):
            continue
        base = w[: -len(end)]
        if end == "ing" and len(base) == 2 and base[1] == "Y" and base[0] not in "aeiou":
            return base[0] + "ie"
        if not _VOWEL.search(base):
            return w
        if base.endswith(("at", "bl", "iz")):
            return base + "e"
        if base.endswith(DOUBLES):
            return base if len(base) == 3 and base[0] in "aeo" else base[:-1]
        return base + "e" if len(base) <= r1 and _short_end(base) else base
    return w


def _step2(w: str, r1: int) -> str:
    for end, new in STEP2:
        if w.endswith(end):
            return w[: -len(end)] + new if len(w) - len(end) >= r1 else w
    if w.endswith("ogist"):
        return w[:-2] if len(w) - 5 >= r1 else w
    if w.endswith("ogi"):
        return w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
    if w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
        return w[:-2]
    return w


def _step3(w: str, r1: int, r2: int) -> str:
    if w.endswith("ative"):
        return w[:-5] if len(w) - 5 >= r2 else w
    for end, new in STEP3:
        if w.endswith(end):
            return w[: -len(end)] + new if len(w) - len(end) >= r1 else w
    return w
