"""Language ID by rank-order profiles of character n-grams.

A language's profile is the ranking of its most frequent 1- to 3-grams over all training
documents; a document's profile ranks its own. The out-of-place distance adds, for each
n-gram of the document's profile, how far its rank is from the language's rank, or the
greatest penalty where the language's profile lacks it. The nearest language wins.

Texts are lower-cased; an n-gram is up to three code points of letters, packed into 64 bits;
every run of other characters is one word boundary. Whole texts are counted, with
vectorised sorts in Arrow batches.

Scale: training counts are combined inside each task, and given on whenever they reach a
bound, before one shuffle of (language, n-gram) rows; the profiles that
are broadcast are languages x PROFILE ranks. Prediction moves no rows at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import bounded, crc32_mod, slices

#: N-grams in a profile, and the greatest penalty of one.
PROFILE = 400
BATCH_BYTES = 2_000_000
#: Text whose n-grams are sorted at once while learning; its arrays take some 70 times as much.
LEARN_BYTES = 400_000
#: Distinct n-grams that a task holds before it gives their counts on, about.
HELD = 400_000
HELD_OUT = (4, 2)
UNDETERMINED = "und"
#: Stands for a word boundary; no letter has this code point.
EDGE = 1
#: Bits of a code point.
BITS = 21


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes, sorted, and counts of the text's 1- to 3-grams; one without a letter or with an inner boundary is left out.

    A single boundary at the start or end of a 2- or 3-gram is part of it.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.full(len(points) + 2, EDGE, np.int64)
    a[1:-1] = np.where(letter, points, EDGE)
    a = a[np.concatenate(([True], (a[1:] != EDGE) | (a[:-1] != EDGE)))]  # runs of boundaries are one
    two = a[:-1] << BITS | a[1:]
    three = (two[:-1] << BITS | a[2:])[a[1:-1] != EDGE]
    codes = np.concatenate((a[a != EDGE], two, three))
    codes.sort()
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
    return codes[edge[:-1]], np.diff(edge)


def _top(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Codes by falling count, ties by code, at most ``most``."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """The ranks of each language's most frequent n-grams."""

    def __init__(self, ranked: dict[str, list[int]], most: int = PROFILE):
        self.languages, self.most = sorted(ranked), most
        self.codes = np.unique(np.array([c for own in ranked.values() for c in own], np.int64))
        self.rank = np.full((len(self.languages), len(self.codes) + 1), most, np.int64)  # the last column: not in any profile
        for i, name in enumerate(self.languages):
            self.rank[i, np.searchsorted(self.codes, np.array(ranked[name], np.int64))] = np.arange(len(ranked[name]))

    def distances(self, text: str | None) -> tuple[np.ndarray, int]:
        """The out-of-place distance to each language, and the number of n-grams in the text's profile."""
        codes, counts = grams(text) if text else (np.zeros(0, np.int64),) * 2
        own = _top(codes, counts, self.most)
        if not len(self.codes):
            return np.zeros(len(self.languages), np.int64), len(own)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at[self.codes[at] != own] = len(self.codes)
        there = self.rank[:, at]
        return np.where(there < self.most, np.abs(there - np.arange(len(own))), self.most).sum(axis=1), len(own)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how much nearer it is than the next (0 to 1)."""
        distance, size = self.distances(text)
        if not size or not self.languages:
            return UNDETERMINED, 0.0
        best = int(np.argmin(distance))
        if len(distance) == 1:
            return self.languages[0], 1.0 - float(distance[0]) / (self.most * size)
        second = float(np.partition(distance, 1)[1])
        return self.languages[best], (second - float(distance[best])) / second if second else 0.0


def learn(docs: DataFrame, lang_col: str = "lang", most: int = PROFILE) -> Profiles:
    """Profiles from all rows of ``docs`` (text and language); rows without either are skipped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in slices(batches, "text", LEARN_BYTES):
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                total.setdefault(lang, []).append(grams("\n".join(own)))  # a line feed is a boundary, as texts' ends are
            if sum(len(c) for parts in total.values() for c, _ in parts) > HELD:
                total = {lang: [_summed(parts)] for lang, parts in total.items()}
                if sum(len(c) for parts in total.values() for c, _ in parts) > HELD // 2:
                    yield from flush(total)
        yield from flush(total)

    def flush(total: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang in list(total):
            code, n = _summed(total.pop(lang))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    rows = bounded(docs).where(F.col("text").isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), "text")
    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", "code", "rank")
    ranked: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):  # languages x PROFILE rows
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, most)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row; null text or text without a letter is ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learning only from documents that are not held out.

    Held out is crc32(doc_id as text) mod ``held_out[0]`` equal to ``held_out[1]``; null ids
    count as the empty text. Null languages teach nothing; with no labelled document every
    text is ``und``. Ties in distance go to the first language by name, repeated rows are
    each predicted, an empty table gives no rows, other columns are not read.
    """
    out = crc32_mod(F.col("doc_id"), held_out[0]) == held_out[1]
    profiles = learn(docs.where(~out).select("text", "lang"))
    return predict(docs, profiles).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score")
