"""Near-duplicate groups by DartMinHash signatures, banding and exact verification.

Shingles are five consecutive words (white space separates, A-Z count as a-z); a text of
fewer words, but not none, is one shingle. Documents are linked when the Jaccard
similarity of their shingle sets is at least 0.8; groups are the connected components.

DartMinHash throws darts into each element's region of the (weight, rank) plane: here the
ranks of an element's darts are the arrivals of a Poisson process of rate one for each
unit of weight, all drawn from hashes of the element, so equal elements get equal darts
in every document. Each dart falls on one coordinate; the earliest dart of a coordinate is
its value. A document of total weight W only needs darts up to rank about K ln K / W, so
the work is a hash for each element and some K ln K darts, not K hashes for each element.
If a coordinate stays empty, the rank limit is doubled.

Texts with the same words are one vertex, a band's value is a bucket, and the groups come from
the buckets by the links of ``linking``: every two texts that share a bucket are either in one
component or decided exactly on whole shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm import linking
from lumenrank.llm.bitmaps import mix
from lumenrank.llm.common import ASCII_LOWER, BROADCAST_ROWS, id_and_text

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Members, and bytes of shingles, in one block of a large bucket, about.
BLOCK = 256
BLOCK_BYTES = 2_000_000
#: Shingles in one step of a block's comparison.
COLUMNS = 8_192
#: So many ids are sent to the executors, at most (some 40 bytes each); more are joined by a shuffle.
BROADCAST_IDS = BROADCAST_ROWS

_U = np.uint64


class _WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _WordHash()


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _text_name(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    acc = hashes[: n - width + 1].copy()
    for j in range(1, width):
        acc = acc * _U(0x9E3779B97F4A7C15) + hashes[j : n - width + 1 + j]
    acc = np.sort(mix(acc))
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """k 64-bit values of a non-empty weighted set; two sets agree in a value with their weighted Jaccard similarity.

    A weight w covers the unit cells 0, 1, ... below w of the element's weight axis; in
    the last, partial cell only darts below the rest of w count. Without weights all are 1.
    """
    if weights is not None:
        cells = np.ceil(weights).astype(np.int64)
        index = np.repeat(np.arange(len(elements)), cells)
        cell = np.arange(len(index)) - np.repeat(np.cumsum(cells) - cells, cells)
        part = np.minimum(weights[index] - cell, 1.0)
        elements = mix(elements[index] + cell.astype(np.uint64) * _U(0xD1B54A32D192ED03))
        total = float(weights.sum())
    else:
        part, total = None, float(len(elements))
    limit = k * (math.log(k) + 4) / total

    def drawn(base: np.ndarray, number: np.ndarray) -> np.ndarray:
        return mix(base + number.astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def gap(hashed: np.ndarray) -> np.ndarray:
        return -np.log(((hashed >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)

    first = gap(drawn(elements, np.ones(1)))
    while True:
        live = np.flatnonzero(first <= limit)
        base, rank = elements[live], first[live]
        bases, ranks, numbers, owners = [base], [rank], [np.ones(len(live), np.int64)], [live]
        number, more = 2, int(limit + 4 * math.sqrt(limit)) + 2
        while len(live):
            steps = np.arange(number, number + more)
            times = rank[:, None] + np.cumsum(gap(drawn(base[:, None], steps[None, :])), axis=1)
            inside = times <= limit
            at, step = np.nonzero(inside)
            bases.append(base[at])
            ranks.append(times[inside])
            numbers.append(steps[step])
            owners.append(live[at])
            on = inside[:, -1]
            live, base, rank, number = live[on], base[on], times[on, -1], number + more
        base, rank, number = np.concatenate(bases), np.concatenate(ranks), np.concatenate(numbers)
        dart = drawn(base ^ _U(0xA5A5A5A5A5A5A5A5), number)
        if part is not None:
            height = (drawn(dart, np.full(1, 7)) >> _U(11)).astype(np.float64) * 2.0**-53
            keep = height < part[np.concatenate(owners)]
            dart, rank = dart[keep], rank[keep]
        order = np.argsort(-rank, kind="stable")  # the earliest is written last
        out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        slot = (dart[order] % _U(k)).astype(np.int64)
        out[slot] = dart[order]
        filled[slot] = True
        if filled.all():
            return mix(out)
        limit *= 2


def band_values(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    grid = signature.reshape(bands, rows)
    acc = np.arange(1, bands + 1).astype(np.uint64)
    for r in range(rows):
        acc = mix(acc * _U(0x9E3779B97F4A7C15) + grid[:, r])
    return acc.view(np.int64)


def block_links(one: list[dict], two: list[dict], similarity: float) -> list[tuple[int, int]]:
    """Links between members of two blocks ({v, label, shingles}) of different components: one for each two components that have any.

    Overlaps are counted for all pairs at once, as a product of 0/1 matrices over the shingles that both blocks hold.
    """
    common = max((x["label"] for x in one), key=Counter(x["label"] for x in one).__getitem__)
    rest = [x for x in one if x["label"] != common], [x for x in one if x["label"] == common]
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for left, right in ((rest[0], two), (rest[1], [x for x in two if x["label"] != common])):
        if not left or not right:
            continue
        sets = [[np.frombuffer(x["shingles"], np.uint64) for x in side] for side in (left, right)]
        sizes = [np.array([len(s) for s in side], np.float32) for side in sets]
        flat = [np.concatenate(side) for side in sets]
        shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
        if not len(shared):
            continue
        both = np.zeros((len(left), len(right)), np.float32)
        places = []
        for all_, own in zip(flat, sizes):
            at = np.minimum(np.searchsorted(shared, all_), len(shared) - 1)
            hit = shared[at] == all_
            places.append((np.repeat(np.arange(len(own)), own.astype(np.int64))[hit], at[hit]))
        for start in range(0, len(shared), COLUMNS):
            grids = []
            for own, (row, at) in zip(sizes, places):
                inside = (at >= start) & (at < start + COLUMNS)
                grid = np.zeros((len(own), min(COLUMNS, len(shared) - start)), np.float32)
                grid[row[inside], at[inside] - start] = 1
                grids.append(grid)
            both += grids[0] @ grids[1].T
        linked = both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-3
        for i, j in zip(*np.nonzero(linked)):
            x, y, exact = left[i], right[j], int(both[i, j])
            if x["label"] != y["label"] and exact >= similarity * (len(sets[0][i]) + len(sets[1][j]) - exact) - 1e-9:
                out.setdefault((min(x["label"], y["label"]), max(x["label"], y["label"])), (x["v"], y["v"]))
    return list(out.values())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, tile: int = linking.TILE,
) -> DataFrame:
    """One row per input row: doc_id, group_id, group_size, kept.

    group_id is the smallest doc_id of the group and the row that has it is kept. Null or
    wordless texts have no shingles: each is a group of its own. Repeated rows are copies;
    one of them stays. A null doc_id never wins against another id. Ties don't matter, as
    groups are whole components. An empty table gives no rows; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)

    def sketcher(text: str) -> tuple[bytes, np.ndarray, int] | None:
        hashes = word_hashes(text)
        if not len(hashes):
            return None
        own = shingles(hashes)
        return _text_name(hashes), band_values(dart_minhash(own, k=bands * rows), bands, rows), len(own)

    def reader(text: str) -> tuple[bytes, np.ndarray]:
        hashes = word_hashes(text)
        return _text_name(hashes), shingles(hashes)

    sketched = linking.sketch(docs, sketcher, _WORDS.clear)
    found = linking.vertices(sketched)
    labels = linking.link(docs, found, reader, block_links, similarity, block, block_bytes, done=_WORDS.clear, sent=BROADCAST_IDS, tile=tile)
    out = linking.grouped(sketched, found, labels)
    kept = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "group_id", "group_size", kept.alias("kept"))
