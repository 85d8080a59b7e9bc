"""English stemming by the published Porter2 algorithm, as a function of words and of array columns."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = frozenset("cdeghkmnrt")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"),
    ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"),
    ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
    ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", None), ("li", None),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", None), ("icate", "ic"), ("iciti", "ic"),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP4 = (
    "ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous",
    "al", "er", "ic",
)
#: Words that a stemmer told to leave stop words alone returns unchanged.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both
    but by can did do does doing don down during each few for from further had has have having he her here hers herself
    him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or
    other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves
    then there these they this those through to too under until up very was we were what when where which while who
    whom why will with you your yours yourself yourselves""".split()
)


def _region(word: str, start: int) -> int:
    """The place after the first non-vowel that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_syllable_at_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return (
        len(word) > 2
        and word[-1] not in _VOWELS
        and word[-1] not in "wxY"
        and word[-2] in _VOWELS
        and word[-3] not in _VOWELS
    )


@lru_cache(maxsize=200_000)
def stem(word: str, stem_stop_words: bool = False) -> str:
    """The stem of a lower-case word. Words of one or two letters, and stop words unless asked for, stay."""
    if len(word) <= 2 or (not stem_stop_words and word in STOP_WORDS):
        return word
    word = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if word.startswith("'"):
        word = word[1:]
    if word in _SPECIAL:
        return _SPECIAL[word]
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in _VOWELS):
            letters[i] = "Y"
    word = "".join(letters)

    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _region(word, 0)
    r2 = _region(word, r1)

    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break

    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif not word.endswith(("us", "ss")) and word.endswith("s") and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _KEPT_AFTER_1A:
        return word

    # 1b
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not word.endswith(suffix):
            continue
        at = len(word) - len(suffix)
        if suffix in ("eed", "eedly"):
            if at >= r1:
                word = word[:at] + "ee"
        elif any(c in _VOWELS for c in word[:at]):
            word = word[:at]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _short_syllable_at_end(word):
                word += "e"
        break

    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    # 2
    for suffix, other in _STEP2:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1:
                if suffix == "li":
                    if at and word[at - 1] in _LI:
                        word = word[:at]
                elif suffix == "ogi":
                    if at and word[at - 1] == "l":
                        word = word[:-1]
                else:
                    word = word[:at] + other
            break

    # 3
    for suffix, other in _STEP3:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1:
                if suffix == "ative":
                    if at >= r2:
                        word = word[:at]
                else:
                    word = word[:at] + other
            break

    # 4
    for suffix in _STEP4:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or (at and word[at - 1] in "st")):
                word = word[:at]
            break

    # 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_syllable_at_end(word[:at])):
            word = word[:at]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stem_array(words: Column, stem_stop_words: bool = False) -> Column:
    """Stems of an array of words, in Arrow batches: each distinct word of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def stems(batch: pa.Array) -> pa.Array:
        coded = batch.flatten().dictionary_encode()
        distinct = pa.array([stem(w, stem_stop_words) for w in coded.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(batch), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        mask = batch.is_null() if batch.null_count else None
        return pa.ListArray.from_arrays(offsets, distinct.take(coded.indices), mask=mask)

    return stems(words)
