"""Benchmark decontamination: an FM-index for each training shard answers the test phrases.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z. A test phrase is a
window of 13 consecutive item words; an item of fewer words, but not none, is one window.

A shard is a bounded amount of document text within a task. Words that no item has
cannot be part of an occurrence, nor can runs shorter than the shortest phrase, so the
shard's index holds the other runs, with positions into the documents. All phrases are
searched backwards through the wavelet matrix, occurrences are located from sampled
suffix positions, and their spans are merged into removal spans for each document.

Scale: no shuffle of documents. Items go out in blocks of bounded size, one pass over the
documents for each block, so the items may exceed memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import ASCII_LOWER, bounded, slices
from lumenrank.llm.fm_index import FMIndex

WINDOW = 13
#: Item text sent to the executors at once, in characters; its windows take about 40 bytes for each, and 100 while they are built.
BLOCK_CHARS = 1_000_000
#: Document text in one shard, in bytes.
SHARD_BYTES = 4_000_000

_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in ASCII_LOWER)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Phrases:
    """The windows of one block of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.names: list[str] = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                size = min(window, len(ids))
                for i in range(len(ids) - size + 1):
                    found.setdefault(tuple(ids[i : i + size]), set()).add(len(self.names))
                self.names.append(name)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.patterns = np.zeros((len(found), window), np.int64)
        for row, p in enumerate(found):
            self.patterns[row, window - len(p) :] = p
        self.items = [sorted(x) for x in found.values()]


def shard_hits(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its number of words, the merged word spans of occurrences, the items found."""
    ids: list[np.ndarray] = []
    counts: list[int] = []
    get = phrases.vocabulary.get
    for text in texts:
        own = [get(w, 0) for w in words(text)]
        counts.append(len(own))
        ids.append(np.array([*own, 0], np.int64))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    names: list[list[str]] = [[] for _ in texts]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    # Runs of item words, long enough for the shortest phrase, each with a separator after it.
    inside = np.concatenate(([0], (flat > 0).astype(np.int8), [0]))
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if len(begin) and len(phrases.patterns):
        size = end - begin + 1
        origin = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        text = flat[origin]  # the place after a run holds a word that no item has, or the end of a document: 0
        index = FMIndex(text)
        low, high = index.search(phrases.patterns, phrases.lengths)
        many = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(many)), many)
        rows = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + low[which]
        at = origin[index.locate(rows)] if len(rows) else np.zeros(0, np.int64)
        doc = np.searchsorted(starts, at, side="right") - 1
        cover = np.zeros(len(flat) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + phrases.lengths[which], -1)
        change = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8))))
        for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True):
            d = int(np.searchsorted(starts, a, side="right")) - 1
            spans[d].append((int(a - starts[d]), int(b - starts[d])))
        seen: dict[int, set[int]] = {}
        for d, p in set(zip(doc.tolist(), which.tolist())):
            seen.setdefault(d, set()).update(phrases.items[p])
        for d, own in seen.items():
            names[d] = sorted({phrases.names[i] for i in own})
    return list(zip(counts, spans, names))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    ends = [(m.start(), m.end()) for m in _WORD.finditer(text.translate({b: b + 32 for b in range(65, 91)}))]
    return [(ends[a][0], ends[b - 1][1]) for a, b in spans]


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], window: int, last: bool) -> DataFrame:
    """One block of items over all documents; earlier findings are merged, and the last pass sums them up."""
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))
    again = "n_words" in docs.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_BYTES):
            texts = batch.column("text").to_pylist()
            found = shard_hits(texts, phrases.value)
            if again:
                before = zip(batch.column("word_spans").to_pylist(), batch.column("item_ids").to_pylist())
                found = [(n, _merge([*s, *map(tuple, s0)]), sorted({*i, *i0})) for (n, s, i), (s0, i0) in zip(found, before)]
            n, spans, names = ([x[k] for x in found] for k in range(3))
            ids = pa.array(names, pa.list_(pa.string()))
            if not last:
                columns = [batch.column("doc_id"), batch.column("text"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_words", "word_spans", "item_ids"])
                continue
            where = [_char_spans(t, s) if s else [] for t, s in zip(texts, spans)]
            hit = [sum(b - a for a, b in s) for s in spans]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, hit, list(map(len, names)))), pa.array(digests, pa.string()), ids, pa.array(where, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "item_ids", "spans"])

    spans, ids = T.ArrayType(T.ArrayType(T.IntegerType())), T.StructField("item_ids", T.ArrayType(T.StringType()))
    counts = [T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")]
    if last:
        schema = [docs.schema["doc_id"], *counts, T.StructField("items_sha256", T.StringType()), ids, T.StructField("spans", spans)]
    else:
        schema = [docs.schema["doc_id"], docs.schema["text"], counts[0], T.StructField("word_spans", spans), ids]
    return docs.mapInArrow(search, T.StructType(schema))


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans.

    ``spans`` are the removal spans, in code points, end exclusive, merged. ``items`` has
    item_id and text. Null or wordless text has no words and no hits; a null item_id
    counts as the empty id; repeated items count once by their id. An empty table of
    documents gives no rows, an empty table of items finds nothing. Other columns are
    not read.
    """
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    found = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = _pass(found, [(r[0], r[1]) for r in part.toLocalIterator()], window, b == blocks - 1)
    flag = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", flag.alias("contaminated"), "item_ids", "spans")


#: The same rows from joins on the windows' words.
ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(13, len(w)) AS m FROM iw WHERE len(w) > 0),
ip AS (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0),
ik AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM ip),
dp AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m),
dk AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM dp),
occ AS (SELECT r, i, dk.m, item_id FROM dk JOIN ik ON dk.m = ik.m AND dk.k = ik.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
