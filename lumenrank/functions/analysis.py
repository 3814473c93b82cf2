"""Analyzers: text to terms. ``simple`` is all Catalyst; ``english`` drops stop words and stems."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD, GAP = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"

# The usual English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now".split()
)

# The published Porter2 tables.
_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_UNCHANGED = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_ENDINGS = tuple((table, sorted(table, key=len, reverse=True), tuple(table)) for table in (_STEP2, _STEP3))
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        m = _REGION.search(word)
        first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter2 (English), written from the published algorithm."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2 or word in _UNCHANGED:
        return word
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    one, two = _regions(word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    # 1b
    if word.endswith(("eedly", "eed")):
        end = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(end) >= one:
            word = word[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None)
        if end and _VOWEL.search(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLE):
                word = word[:-1]
            elif one >= len(word) and _short_end(word):
                word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # 2 and 3: the longest ending, in the first region
    for table, longest_first, endings in _ENDINGS:
        end = next(e for e in longest_first if word.endswith(e)) if word.endswith(endings) else None
        if end:
            if len(word) - len(end) >= one:
                word = word[: -len(end)] + table[end]
        elif table is _STEP2:
            if word.endswith("ogi") and word[-4:-3] == "l" and len(word) - 3 >= one:
                word = word[:-1]
            elif word.endswith("li") and len(word) - 2 >= one and word[-3:-2] in tuple("cdeghkmnrt"):
                word = word[:-2]
        elif word.endswith("ative") and len(word) - 5 >= two:
            word = word[:-5]
    # 4
    end = next((e for e in _STEP4 if word.endswith(e)), None)
    if end:
        if len(word) - len(end) >= two:
            word = word[: -len(end)]
    elif word.endswith("ion") and word[-4:-3] in ("s", "t") and len(word) - 3 >= two:
        word = word[:-3]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= two or len(word) - 1 >= one and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= two:
        word = word[:-1]
    return word.replace("Y", "y")


def simple(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def spaced(text: Column) -> Column:
    """The words of ``simple`` in one string, with a space between two (there may be one at an end): it goes to Python faster than an array of strings."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), GAP, " ")


def english_terms(words: list[str]) -> list[str | None]:
    """The term of each simple word; None for a stop word."""
    return [None if w in STOP_WORDS else stem(w) for w in words]


def coded(flat: pa.Array, terms: Callable[[list[str]], list[str | None]] | None) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers of distinct terms, -1 for what ``terms`` drops: it is asked once for each distinct word of a batch."""
    own = flat.dictionary_encode()
    numbers = own.indices.to_numpy(zero_copy_only=False)
    if terms is None:
        return numbers, own.dictionary
    changed = pa.array(terms(own.dictionary.to_pylist()), pa.string()).dictionary_encode()
    places = changed.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return (places[numbers] if len(places) else numbers), changed.dictionary


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stems(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for rows in words:
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        numbers, terms = coded(rows.flatten(), english_terms)
        kept = numbers >= 0
        ends = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(sizes)))]
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms.take(pa.array(numbers[kept])))


def english(text: Column) -> Column:
    """Stems of the simple terms without stop words."""
    return _stems(simple(text))


ANALYZERS = {"simple": simple, "english": english}
#: What an analyzer makes of a simple word; None where that is the word.
WORD_TERMS = {"simple": None, "english": english_terms}
