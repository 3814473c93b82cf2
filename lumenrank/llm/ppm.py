"""Language-model scoring by prediction by partial matching over bytes.

The model is a byte-context trie of order ``ORDER``, held as counts of (ORDER + 1)-grams of the
training documents. Counts of shorter contexts follow the usual rule that a symbol counts there
only when the longer context had not seen it: the count is the number of different longer
contexts. A symbol seen in a context has (count - DISCOUNT) / total; otherwise the model escapes
with DISCOUNT * distinct / total to the next shorter context, where symbols of the longer one are
excluded, and at last to a uniform choice among the bytes never seen. A text is framed by an
end symbol.

Pretrained scoring (``score``): the code length of every gram of any text is worked out once, as a
table, so a document is scored by table look-ups. Adaptive scoring (``adaptive_scores``) starts
from an empty trie for each document and learns it as it goes.

The base score is a smoothed unigram model of words with its counts over all training
documents. Frequent words, at most ``HEAD``, are broadcast; the others are joined.

Scale: each task combines its counts before the shuffle; the tables of counts and code lengths
stay distributed, sharded by gram, and keep every gram. What reaches the driver at a time is bounded by
``HEAD`` words and ``GRAMS`` code lengths: more grams than that are looked up shard by shard, in several
passes over the texts. Their number grows with the variety of byte sequences, far slower than the text.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import ASCII_LOWER, crc32_mod, discard, id_and_text, materialize, slices

ORDER = 5
#: What a symbol gives up of its count for those not seen.
DISCOUNT = 0.3
#: Words whose counts are broadcast, at most, and grams that are looked up in a pass, about.
HEAD = 100_000
GRAMS = 2_900_000
#: How full a table of code lengths gets, at most.
FULL = 0.7
EMPTY = np.int64(-1)
#: Grams looked up at once, so that the arrays stay in the processor's cache.
LOOKED_UP = 1 << 15
#: Words, and grams beyond those already summed, that a counting task holds at a time, about.
HELD_WORDS, HELD_GRAMS = 80_000, 600_000
#: Frames a text; no UTF-8 text has this byte.
FRAME = 0xFF
SMOOTH = 0.1
#: The end token's key; no word has a space.
END = b" "
#: Text in one step; its arrays take some 40 times as much.
BATCH_BYTES = 600_000


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def framed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each after ORDER frame bytes and before one; and where each ends."""
    edge = bytes([FRAME])
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = b"".join(edge * ORDER + p + edge for p in parts)
    return np.frombuffer(flat, np.uint8), np.cumsum([len(p) + ORDER + 1 for p in parts])


def _grams(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of the grams that predict a byte of a text or its end."""
    codes = np.zeros(len(flat) - ORDER, np.int64)
    for i in range(ORDER + 1):
        codes = (codes << 8) | flat[i : len(flat) - ORDER + i]
    keep = np.ones(len(codes), bool)
    for e in ends[:-1]:
        keep[e - ORDER : e] = False  # those would cross into the next text's frame
    return codes[keep]


def _count(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if weights is None:
        codes = np.sort(codes)
        edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
        return codes[edge[:-1]], np.diff(edge)
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(weights, first)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    parts.clear()
    return _count(codes, n)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, gram, n) of all texts: a row has either a word (the end token is one space) or a gram's code.

    Only texts that aren't ``held_out`` count; grams that no other text has are rows of 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(n, keys: list[bytes] | None = None, codes: np.ndarray | None = None) -> pa.RecordBatch:
            word = pa.nulls(len(n), pa.binary()) if keys is None else pa.array(keys, pa.binary())
            gram = pa.nulls(len(n), pa.int64()) if codes is None else pa.array(codes, pa.int64())
            return pa.RecordBatch.from_arrays([word, gram, pa.array(n, pa.int64())], ["word", "gram", "n"])

        seen: Counter[bytes] = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, "text", BATCH_BYTES):
            taught: tuple[list[str], list[str]] = ([], [])
            for text, out_of_it in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                taught[not out_of_it].append(text)
            for text in taught[1]:
                seen.update(words(text))
            if taught[1]:
                seen[END] += len(taught[1])
            if len(seen) > HELD_WORDS:
                yield out(list(seen.values()), keys=list(seen))
                seen.clear()
            for counts, texts in enumerate(taught):
                if texts:
                    codes, n = _count(_grams(*framed(texts)))
                    held.append((codes, n * counts))
            if sum(len(c) for c, _ in held[1:]) > max(HELD_GRAMS, len(held[0][0])):
                held = [_summed(held)]
        if seen:
            yield out(list(seen.values()), keys=list(seen))
        if held:
            codes, n = _summed(held)
            held.clear()
            for i in range(0, len(codes), 100_000):
                yield out(n[i : i + 100_000], codes=codes[i : i + 100_000])

    return docs.select("text", "held_out").mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def code_lengths(counts: DataFrame) -> DataFrame:
    """(gram, value) of every gram of a count table: its log10 probability.

    Counts go from the longest contexts down, probabilities from the empty context up. A
    gram that a context lacks has the escape's share of what is left in the next shorter one,
    without the symbols of the longer one: as those were all seen there too, sums over the
    shorter context and over its symbols that the longer one has are enough.
    """

    def ratio(x: Column, y: Column) -> Column:
        return x / F.greatest(y, F.lit(1)).cast("double")

    def share(n: Column, total: Column, kinds: Column, after: Column) -> Column:
        return F.when(n > 0, ratio(n - DISCOUNT, total)).when(total > 0, ratio(kinds * DISCOUNT, total) * after).otherwise(after)

    levels = [counts.where("gram IS NOT NULL").select("gram", "n")]
    for order in range(ORDER - 1, -1, -1):
        code = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        fewer = levels[0].groupBy(code.alias("gram")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n"))
        levels.insert(0, materialize(fewer, "ppm-level"))
    lower, used = None, list(levels[:-1])
    for order, level in enumerate(levels):
        own = level.withColumn("context", F.shiftright("gram", 8))
        within = Window.partitionBy("context")
        if lower is not None:
            below = lower.select(F.col("gram").alias("low"), F.col("n").alias("before"), F.col("total").alias("total0"), F.col("kinds").alias("kinds0"), F.col("after").alias("after0"))
            own = own.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))).join(below, "low")
        known = F.col("n") > 0
        own = own.withColumn("total", F.sum("n").over(within)).withColumn("kinds", F.sum(known.cast("long")).over(within))
        if lower is None:
            after = ratio(F.lit(1.0), F.lit(256) - F.col("kinds"))
        else:
            own = own.withColumn("total0", F.col("total0") - F.sum(F.when(known, F.col("before")).otherwise(0)).over(within)).withColumn("kinds0", F.col("kinds0") - F.col("kinds"))
            after = share(F.col("before"), F.col("total0"), F.col("kinds0"), F.col("after0"))
        lower = own.withColumn("after", after).select("gram", "n", "total", "kinds", "after")
        if order < ORDER:
            lower = materialize(lower, "ppm-order")
            used.append(lower)
    out = materialize(lower.select("gram", F.log10(share(F.col("n"), F.col("total"), F.col("kinds"), F.col("after"))).cast("float").alias("value")), "ppm-lengths")
    for level in used:
        discard(level)
    return out


class Table:
    """Log probabilities by gram, in an open table."""

    def __init__(self, grams: np.ndarray, values: np.ndarray, keep: bool = True):
        self.own = (grams, values) if keep else None
        self.bits = max(4, math.ceil(math.log2((len(grams) + 1) / FULL)))
        self.slots, self.values = np.full(1 << self.bits, EMPTY, np.int64), np.zeros(1 << self.bits, np.float32)
        at = self._first(grams)
        while len(grams):
            free = np.flatnonzero(self.slots[at] == EMPTY)
            self.slots[at[free]] = grams[free]
            won = self.slots[at] == grams
            self.values[at[won]] = values[won]
            grams, values, at = grams[~won], values[~won], (at[~won] + 1) & (len(self.slots) - 1)

    def __reduce__(self):
        return Table, (*self.own, False)  # sent without the free places, and opened once

    def _first(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The value of each gram, 0 for those of other passes."""
        out = np.zeros(len(grams), np.float32)
        left, at, wanted = np.arange(len(grams)), self._first(grams), grams
        while len(left):
            slot = self.slots[at]
            hit = slot == wanted
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (slot != EMPTY)
            left, at, wanted = left[more], (at[more] + 1) & (len(self.slots) - 1), wanted[more]
        return out

    def log10(self, texts: list[str]) -> np.ndarray:
        """log10 probability of each text and its end, as far as this table's grams go."""
        flat, ends = framed(texts)
        codes = np.zeros(len(flat) - ORDER, np.int64)
        for i in range(ORDER + 1):
            codes = (codes << 8) | flat[i : len(flat) - ORDER + i]
        starts = np.concatenate(([0], ends[:-1]))
        for e in starts[1:]:
            codes[e - ORDER : e] = codes[e]  # they cross into the next text's frame and are not summed
        found = [self(codes[i : i + LOOKED_UP]) for i in range(0, len(codes), LOOKED_UP)]
        total = np.concatenate(([0.0], np.cumsum(np.concatenate(found) if found else codes, dtype=np.float64)))
        return total[ends - ORDER] - total[starts]


def _tables(lengths: DataFrame, most: int) -> Iterator[Table]:
    """The code lengths in as many tables as it takes for each to hold about ``most``."""
    parts = max(1, -(-lengths.count() // most))
    for part in range(parts):
        rows = lengths.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part).toArrow()
        yield Table(rows.column("gram").to_numpy(), rows.column("value").to_numpy())


def adaptive_log10(text: str, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that starts empty and learns each symbol after coding it."""
    counts: dict[bytes, Counter[int]] = defaultdict(Counter)
    data, total = bytes([FRAME]) * order + text.encode("utf-8", "surrogatepass") + bytes([FRAME]), 0.0
    for at in range(order, len(data)):
        symbol, excluded, found = data[at], set(), False
        for k in range(order, -1, -1):
            own = {s: n for s, n in counts[data[at - k : at]].items() if s not in excluded}
            if not own:
                continue
            whole = sum(own.values())
            if symbol in own:
                total += math.log10((own[symbol] - DISCOUNT) / whole)
                found = True
                break
            total += math.log10(DISCOUNT * len(own) / whole)
            excluded |= own.keys()
        if not found:
            total -= math.log10(256 - len(excluded))
        for k in range(order, -1, -1):
            context = counts[data[at - k : at]]
            context[symbol] += 1
            if context[symbol] > 1:
                break  # a shorter context counts it only where the longer one had not seen it
    return total


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id and score of each document under a trie of its own; null text is the empty text. No row moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = [adaptive_log10(t, order) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    docs = id_and_text(docs)
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def _partial(scored: DataFrame, table: Table) -> DataFrame:
    """(row, score) of the texts under one more table."""
    shared = scored.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = shared.value.log10(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.float64())], ["row", "score"])

    out = materialize(scored.select("row", "text").mapInArrow(run, "row long, score double"), "ppm-part")
    shared.unpersist()
    return out


def score(docs: DataFrame, held_out: tuple[int, int] = (10, 0), head: int = HEAD, grams: int = GRAMS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out is crc32(doc_id as text) mod ``held_out[0]`` equal to ``held_out[1]``; the other
    documents teach. Null text is the empty text, whose one token is the end. With nothing
    to learn from, every token is unknown and every byte uniform. Repeated rows count and are
    scored each; null ids count as the empty text in the hash. An empty table gives no rows.
    """
    out = crc32_mod(F.col("doc_id"), held_out[0]) == held_out[1]
    docs = id_and_text(docs).withColumn("held_out", out)
    spark = docs.sparkSession
    counts = materialize(corpus_counts(docs), "ppm-counts")
    vocabulary = counts.where("word IS NOT NULL").select("word", "n")
    sums = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    distinct, total = sums["v"], sums["n"]
    least, size = 1, distinct
    while size > head:
        least *= 2
        size = vocabulary.where(F.col("n") >= least).count()
    frequent = vocabulary.where(F.col("n") >= least).toArrow()
    bottom = total + SMOOTH * (distinct + 1)
    known = {k: math.log10((n + SMOOTH) / bottom) for k, n in zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist())}
    lengths = code_lengths(counts)
    several = lengths.count() > grams
    tables = _tables(lengths, grams)
    shared = spark.sparkContext.broadcast((known, next(tables)))

    own_columns = ["doc_id", "held_out", *["text"] * several]  # later passes read the texts under their row numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, table = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            scores, rows, base, tokens, found, rare, times = table.log10(texts), [], [], [], [], [], []
            for text in texts:
                own = words(text)
                own.append(END)
                value = [head_words.get(w) for w in own]
                missing = Counter(w for w, x in zip(own, value) if x is None) if None in value else {}
                base.append(math.fsum(x for x in value if x is not None) if missing else math.fsum(value))
                tokens.append(len(own))
                found.append(len(own) - sum(missing.values()))
                rare.append(list(missing))
                times.append(list(missing.values()))
                rows.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [
                    *map(batch.column, own_columns), pa.array(rows, pa.int64()), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())),
                ],
                [*own_columns, "row", "n_tokens", "n_known", "base", "score", "rare", "times"],
            )

    names = {"row": T.LongType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "base": T.DoubleType(), "score": T.DoubleType(), "rare": T.ArrayType(T.BinaryType()), "times": T.ArrayType(T.LongType())}
    schema = T.StructType([*(docs.schema[k] for k in own_columns), *(T.StructField(k, t) for k, t in names.items())])
    scored = materialize(docs.mapInArrow(run, schema), "ppm-scored")
    shared.unpersist()
    parts = [scored.select("row", "score")]
    for table in tables:
        parts.append(_partial(scored, table))
    if several:
        scored = scored.drop("text", "score").join(reduce(DataFrame.union, parts).groupBy("row").agg(F.sum("score").alias("score")), "row")
    tail = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("row", F.col("z.rare").alias("word"), F.col("z.times").alias("k"))
    joined = tail.join(vocabulary.where(F.col("n") < least), "word", "left")
    n = F.coalesce("n", F.lit(0))
    more = joined.groupBy("row").agg(
        F.sum(F.col("k") * F.log10((n + SMOOTH) / F.lit(float(bottom)))).alias("more"), F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("known")
    )
    return scored.drop("rare", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
