"""The English (Porter 2) stemmer and stop words, for bag-of-words search."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: The usual English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
    himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don don't should
    should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
    haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
    weren weren't won won't wouldn wouldn't""".split()
)

#: Words with stems of their own, and words that stay once a plural s is gone.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: The suffixes of steps 2, 3 and 4 with what takes their place.
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
LI_ENDINGS, DOUBLES = "cdeghkmnrt", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

#: All that the steps may take off the end of a word.
ENDINGS = (*sorted({*STEP2, *STEP3, *STEP4, "ative", "ogi", "li", "ly", "ion"}), "s", "es", "'s", "ed", "edly", "ing", "ingly", "e", "y", "ies", "ied", "eed")

_WORD = re.compile(r"[^\W_]+(?:[\u0300-\u036f]+[^\W_]*)*")


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and combining marks after lower case and NFKD, without stop words."""
    return [t for t in _WORD.findall(unicodedata.normalize("NFKD", text.lower())) if t not in STOP_WORDS]


def terms(text: str) -> list[str]:
    return [stem(t) for t in tokens(text)]


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first non-vowel that follows a vowel, and again from there."""

    def after(at: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(w, at)
        return m.end() if m else len(w)

    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if first is None else first
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    """Ends in a non-vowel but w, x, Y after a vowel after a non-vowel, or is a vowel and a non-vowel."""
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch("[aeiouy][^aeiouy]", w))


def _ending(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other than ASCII letters stay."""
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    # a y at the start or after a vowel counts as a consonant, written Y
    w = re.sub("(^|[aeiouy])y", lambda m: m[1] + "Y", word)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        extra = ("ogi", "li") if table is STEP2 else ("ative",)
        end = _ending(w, (*table, *extra))
        at = len(w) - len(end or "")
        if end is None or at < r1:
            continue
        if end == "ogi":
            w = w[:-1] if w[at - 1] == "l" else w
        elif end == "li":
            w = w[:at] if w[at - 1] in LI_ENDINGS else w
        elif end == "ative":
            w = w[:at] if at >= r2 else w
        else:
            w = w[:at] + table[end]
    end = _ending(w, (*STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
