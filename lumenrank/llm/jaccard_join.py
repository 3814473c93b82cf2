"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact intersection.

A document's set holds its distinct word n-grams. Two sets link when 100 * intersection >= percent * union.

Tiles. Sets of a linked pair have sizes in the ratio ``percent`` : 100 or nearer, so sizes are cut into
zones, and a set enters its own zone and, where a linked set could be larger, the next. A linked pair of sizes up to U
differs in at most D = 2 U (100 - percent) / (100 + percent) n-grams. A zone cuts the range of n-gram hashes into more segments
than D, so the two sets hold the very same n-grams in some segment; zone, segment and a digest of its n-grams name a tile,
and no link is lost. A segment of fewer than ``WEAK`` n-grams says little (one frequent n-gram would fill a tile), so a zone has E segments
to spare: sets with at most E weak segments leave those out, as one equal segment still remains. Larger tiles are cut again into narrow size bands, each with the next.

In a tile, sizes give the range of partners, then bitmaps (a hashed bit for each n-gram) bound
the overlap from above: two sets whose bitmaps differ in h bits differ in at least h n-grams, so the
overlap is at most (a + b - h) / 2. Only pairs that this leaves, of components not yet joined, get the exact intersection
of the sorted arrays. A tile of up to ``linking.TILE`` vertices holds their bitmaps alone, and its pairs meet the sets once however many
tiles they share; larger tiles are compared in blocks of whole sets. Components of all links follow by ``linking``, which first joins groups of near copies through one leader.

Equal sets are one vertex. N-grams are 64-bit hashes and sets are named by 128 bits; both as in near-dedup.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm import linking
from lumenrank.llm.bitmaps import bitmaps, candidates, mix, width
from lumenrank.llm.common import BROADCAST_ROWS, id_and_text
from lumenrank.llm.minhash import _WORDS, shingles, word_hashes

WORDS_EACH, PERCENT = 3, 90
#: Growth of sizes within a zone.
ZONE = 1.5
#: N-grams below which a segment is weak.
WEAK = 3
#: Members, and bytes of n-grams, in one block of a large tile, about.
BLOCK = 256
BLOCK_BYTES = 2_000_000
#: Bits of a bitmap for each n-gram of the block's largest set, rounded up to a power of two within these bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 4, 256, 16_384

_U = np.uint64


class Zones:
    """Zones of sizes 1, 2, ...; each with its segments."""

    def __init__(self, percent: int = PERCENT) -> None:
        if not 1 <= percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.percent, self.first, self._cuts = percent, [1], {}

    def of(self, size: int) -> int:
        while self.first[-1] <= size:
            self.first.append(max(self.first[-1] + 1, int(self.first[-1] * ZONE)))
        return int(np.searchsorted(self.first, size, side="right")) - 1

    def reached(self, size: int) -> range:
        """The zones of a linked set that is at least so large."""
        return range(self.of(size), self.of(size * 100 // self.percent) + 1)

    def cuts(self, zone: int) -> tuple[np.ndarray, int]:
        """First hashes of a zone's segments but the first, and E, how many weak segments may be left out."""
        if zone not in self._cuts:
            self.of(self.first[zone])  # the next zone's start is known
            most = self.first[zone + 1] - 1
            differ = 2 * most * (100 - self.percent) // (100 + self.percent)
            spare = differ // 8
            n = differ + 1 + spare
            self._cuts[zone] = np.array([(i << 64) // n for i in range(1, n)], np.uint64), spare
        return self._cuts[zone]


def tile_keys(own: np.ndarray, zones: Zones) -> np.ndarray:
    """Tiles of a set of sorted n-gram hashes, as 64-bit numbers."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(own ^ _U(0x5851F42D4C957F2D)))))
    out = []
    for zone in zones.reached(len(own)):
        cuts, spare = zones.cuts(zone)
        edges = np.concatenate(([0], np.searchsorted(own, cuts), [len(own)]))
        counts = np.diff(edges)
        content = sums[edges[1:]] - sums[edges[:-1]]
        segment = np.arange(len(counts)).astype(np.uint64)
        keys = mix(mix(content + mix(segment * _U(0x9E3779B97F4A7C15) + _U(zone + 1))) + counts.astype(np.uint64))
        weak = counts < WEAK
        out.append(keys[~weak] if weak.sum() <= spare else keys)
    return np.concatenate(out).view(np.int64)


def tile_links(one: list[dict], two: list[dict], similarity: float) -> list[tuple[int, int]]:
    """Links between members of two blocks ({v, label, shingles}) of different components: enough to join all those that the blocks' links join."""
    percent = round(similarity * 100)
    one, two = (sorted(side, key=lambda x: len(x["shingles"])) for side in (one, two))
    sets = [[np.frombuffer(x["shingles"], np.uint64) for x in side] for side in (one, two)]
    number = {label: i for i, label in enumerate({x["label"] for side in (one, two) for x in side})}
    group = [np.array([number[x["label"]] for x in side]) for side in (one, two)]
    out = []
    sizes = [np.array([len(x) for x in side], np.int64) for side in sets]
    bits = width(int(max(side[-1] for side in sizes)))
    for at, other in candidates(*sizes, *(bitmaps(side, bits) for side in sets), percent):
        for i, j in zip(at.tolist(), other.tolist()):
            g, h = group[0][i], group[1][j]
            if g != h and linking.similar(sets[0][i], sets[1][j], similarity):
                out.append((one[i]["v"], two[j]["v"]))
                for side in group:
                    side[side == h] = g
    return out


def size_bands(large: DataFrame, percent: int) -> DataFrame:
    """Large tiles (bucket, v, size, label) cut into size bands, each with the next one: sets that can be linked still meet."""
    width = max(math.log(100 / percent), 1e-9) * (1 + 1e-6)  # a little more than linked sizes differ, for rounding
    band = F.floor(F.log("size") / width).cast("long")
    bands = F.explode(F.array(band, band - 1))
    return large.withColumn("band", bands).withColumn("bucket", F.xxhash64("bucket", "band")).drop("band")


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words_each: int = WORDS_EACH,
    block: int = BLOCK, block_bytes: int = BLOCK_BYTES, sent: int = BROADCAST_ROWS, tile: int = linking.TILE,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    Words are separated by ASCII white space, A-Z count as a-z. A text of fewer words than an n-gram, but not
    none, has its whole word sequence as one element. Null and wordless texts have empty sets and no
    links. Equal sets are linked, so repeated rows and copies are in one component. A null doc_id
    is never the smallest of several. Components are whole, so ties and order don't matter. An empty table
    gives no rows; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    zones = Zones(percent)

    def name(own: np.ndarray) -> bytes:
        return hashlib.blake2b(own.tobytes(), digest_size=16).digest()

    def sketcher(text: str) -> tuple[bytes, np.ndarray, int] | None:
        own = shingles(word_hashes(text), words_each)
        return (name(own), tile_keys(own, zones), len(own)) if len(own) else None

    def reader(text: str) -> tuple[bytes, np.ndarray]:
        own = shingles(word_hashes(text), words_each)
        return name(own), own

    sketched = linking.sketch(docs, sketcher, _WORDS.clear)
    found = linking.vertices(sketched)
    labels = linking.link(docs, found, reader, tile_links, percent / 100, block, block_bytes, lambda large: size_bands(large, percent), _WORDS.clear, sent, tile)
    out = linking.grouped(sketched, found, labels, by_size=True)
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.col("group_id").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE [array_to_string(words[i:i + 2], ' ') FOR i IN range(1, len(words) - 1)] END) AS shingle
    FROM w
), n AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
    SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), e AS MATERIALIZED (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
    SELECT x AS doc_id, x AS reached FROM (SELECT DISTINCT x FROM e) UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached
), c AS (
    SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(c.component_id, w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
