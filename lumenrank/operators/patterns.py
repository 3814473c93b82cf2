"""Pattern search over a trigram index: a regular expression is tried only on notes that hold the trigrams that each of its matches must hold."""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.operators.files import COLUMNS, MATCHES, grep
from lumenrank.session import small_batches

#: Strings that a run of a pattern may stand for before it is cut; characters of a class that are told apart.
MOST_STRINGS, MOST_CHARACTERS = 16, 4
#: Spellings that Java and the parser read differently, or that change how others are read: flags (but s and m, which change no character),
#: intersections, classes that start with a bracket or hold one, quotes, numbers, code units, and boundaries in braces.
_OWN_MEANING = re.compile(r"\(\?(?![sm]+[:)])[a-zA-Z-]|&&|\[\^?\]|\[(?:[^\]\\]|\\.)*\[|\\[vQE0-9uU]|\\[bB]\{", re.DOTALL)
#: Lists of an Arrow batch that goes back from Python.
LISTS = 2_000
#: Longest part that is written out where it is repeated a fixed number of times.
MOST_REPEATED = 16
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)

#: A need: None (none), a trigram, or ("and" | "or", needs).
Need = str | tuple[str, list] | None


def _all(needs: list[Need]) -> Need:
    needs = [n for n in dict.fromkeys(map(_frozen, needs)) if n is not None]
    return None if not needs else needs[0] if len(needs) == 1 else ("and", tuple(needs))


def _any(needs: list[Need]) -> Need:
    needs = list(dict.fromkeys(map(_frozen, needs)))
    return None if None in needs else needs[0] if len(needs) == 1 else ("or", tuple(needs))


def _frozen(need: Need) -> Need:
    return (need[0], tuple(need[1])) if isinstance(need, tuple) else need


class _Walk:
    """Collects what the parts of a sequence need; ``strings`` are what the run that is still open may stand for."""

    def __init__(self) -> None:
        self.needs: list[Need] = []
        self.strings = [""]

    def close(self) -> None:
        if self.strings != [""]:
            self.needs.append(_any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in self.strings]))
        self.strings = [""]

    def one_of(self, characters: list[str]) -> None:
        if len(self.strings) * len(characters) > MOST_STRINGS:
            self.close()
        self.strings = [s + c for s, c in product(self.strings, characters)]

    def sequence(self, items) -> None:
        for kind, arg in items:
            if kind is op.LITERAL:
                self.one_of([chr(arg)])
            elif kind is op.IN and (own := _characters(arg)):
                self.one_of(own)
            elif kind is op.SUBPATTERN and not arg[1] and not arg[2]:
                self.sequence(arg[3])
            elif kind is op.ATOMIC_GROUP:
                self.sequence(arg)
            elif kind is op.BRANCH:
                self.close()
                self.needs.append(_any([_need(branch) for branch in arg[1]]))
            elif kind in _REPEATS and arg[0] == arg[1] <= 4 and 0 < arg[2].getwidth()[1] <= MOST_REPEATED:
                for _ in range(arg[0]):
                    self.sequence(arg[2])
            elif kind in _REPEATS:
                self.close()
                if arg[0]:
                    self.needs.append(_need(arg[2]))
            elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):  # these take no characters
                self.close()


def _characters(items) -> list[str] | None:
    """The characters of a small class, or None."""
    out: list[str] = []
    for kind, arg in items:
        if kind is op.LITERAL:
            out.append(chr(arg))
        elif kind is op.RANGE and arg[1] - arg[0] < MOST_CHARACTERS:
            out += map(chr, range(arg[0], arg[1] + 1))
        else:
            return None
    return list(dict.fromkeys(out)) if len(set(out)) <= MOST_CHARACTERS else None


def _need(items) -> Need:
    walk = _Walk()
    walk.sequence(items)
    walk.close()
    return _all(walk.needs)


def needed(pattern: str) -> Need:
    """What the text of every match must hold, as a tree of trigrams; None where nothing is known, as for a pattern that is read with flags or in Java alone."""
    if _OWN_MEANING.search(pattern):
        return None
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return None
    return _need(tree)


def trigrams_of(need: Need) -> set[str]:
    return set() if need is None else {need} if isinstance(need, str) else set().union(*map(trigrams_of, need[1]))


def _holds(need: Need, has) -> Column:
    if isinstance(need, str):
        return has(need)
    return reduce((lambda a, b: a & b) if need[0] == "and" else (lambda a, b: a | b), [_holds(n, has) for n in need[1]])


def trigram_lists(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(trigrams, texts, ends): trigram i is in the texts, by number, from ``ends[i]`` to ``ends[i + 1]``, each once."""
    keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, text in enumerate(texts):
        if text and len(text) > 2:
            c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
            own = np.sort((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            keys.append(own)
            places.append(np.full(len(own), i))
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    own = key[starts]
    letters = np.stack([own >> 42, (own >> 21) & 0x1FFFFF, own & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [letters[i : i + 3] for i in range(0, len(letters), 3)], place, np.append(starts, len(key))


class PatternIndex:
    """Postings (gram, mode, source) of the distinct trigrams of titles and texts, as lists (gram, mode, sources) of the notes of one Arrow batch, sorted by trigram in each file.

    A search reads the lists of the pattern's trigrams only: the scan gets them as pushed filters, which skip row
    groups and pages by their least and greatest trigram. Notes without three characters in a column have no posting
    there; a null source is kept as null.
    """

    def __init__(self, notes: DataFrame, postings: DataFrame):
        self.notes, self.postings = notes, postings

    @classmethod
    def store(cls, notes: DataFrame, path: str) -> PatternIndex:
        """Index ``notes`` (source, title, text) at ``path``: trigrams are found and put in lists where the notes lie, and nothing is shuffled."""
        rows = small_batches(notes).select("source", *COLUMNS.values())
        schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("sources", T.ArrayType(T.StringType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sources = batch.column("source").cast(pa.string())
                for mode, column in COLUMNS.items():
                    grams, places, ends = trigram_lists(batch.column(column).to_pylist())
                    for i in range(0, len(grams), LISTS):
                        own = ends[i : i + LISTS + 1]
                        lists = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), sources.take(pa.array(places[own[0] : own[-1]])))
                        part = pa.array(grams[i : i + LISTS], pa.string())
                        yield pa.RecordBatch.from_arrays([part, pa.array([mode] * len(part), pa.string()), lists], ["gram", "mode", "sources"])

        rows.mapInArrow(run, schema).sortWithinPartitions("gram").write.parquet(path)
        return cls.open(notes.sparkSession, notes, path)

    @classmethod
    def open(cls, spark: SparkSession, notes: DataFrame, path: str) -> PatternIndex:
        lists = spark.read.schema("gram string, mode string, sources array<string>").parquet(path)
        return cls(notes, lists.select("gram", "mode", F.explode("sources").alias("source")))

    def candidates(self, pattern: str, modes: tuple[str, ...] = ("title", "content")) -> DataFrame | None:
        """(source): notes that can match in one of the modes; None where the pattern needs no trigram, so that all can."""
        need = needed(pattern)
        if need is None:
            return None
        grams = sorted(trigrams_of(need))
        read = self.postings.where(F.col("gram").isin(grams) & F.col("mode").isin(list(modes)))
        held = read.groupBy("source", "mode").agg(F.collect_set("gram").alias("held"))  # at most the pattern's own
        return held.where(_holds(need, lambda g: F.array_contains("held", g))).select("source").distinct()

    def grep(self, pattern: str, modes: tuple[str, ...] = ("title", "content"), matches: int = MATCHES) -> DataFrame:
        """The rows of ``files.grep`` over all notes; the expression is tried on the candidates' texts only."""
        found = self.candidates(pattern, modes)
        notes = self.notes
        if found is not None:
            notes = notes.join(found.select(F.col("source").alias("candidate")), F.col("source").eqNullSafe(F.col("candidate")), "left_semi")
        return grep(notes, pattern, modes, matches)

    def share(self, pattern: str) -> float:
        """The share of notes on which the expression is tried."""
        found = self.candidates(pattern)
        if found is None:
            return 1.0
        return found.count() / max(1, self.notes.select("source").distinct().count())
