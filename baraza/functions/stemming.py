"""English stems (Porter, 1980) for a dictionary of distinct terms."""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Suffix tables of the published algorithm.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
          "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """``c``/``v`` per letter; ``y`` is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, table):
    hits = [entry for entry in table if word.endswith(entry[0])]
    return max(hits, key=lambda e: len(e[0])) if hits else None


def porter(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        cut = next((n for s, n in (("ed", 2), ("ing", 3)) if word.endswith(s) and "v" in _shape(word[:-n])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        hit = _longest(word, table)
        if hit and _measure(word[:-len(hit[0])]):
            word = word[:-len(hit[0])] + hit[1]
    hit = _longest(word, [(s,) for s in STEP_4])
    if hit:
        stem = word[:-len(hit[0])]
        if _measure(stem) > 1 and (hit[0] != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_dictionary(terms: DataFrame, term: str = "term") -> DataFrame:
    """``(term, stem)`` for the distinct terms: one call per distinct term, never per occurrence."""

    @F.pandas_udf("string")
    def stem(series: pd.Series) -> pd.Series:
        return series.map(porter)

    return terms.select(F.col(term).alias("term")).distinct().withColumn("stem", stem("term"))
