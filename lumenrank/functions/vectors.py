"""Vector columns: array<float> or array<double>."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.functions.analysis import WORD
from lumenrank.functions.text import CHARS_PER_TOKEN, MARGIN, packed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean of each key's vectors, in element order, not normalised again."""
    long = df.select(key, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


@lru_cache(maxsize=1)
def _spacer() -> Callable[[str], str]:
    """The ``WORD`` terms of a text in lower case, with spaces between; those of a Latin-1 text by a table of its bytes, which is faster than an expression."""
    import regex

    word = regex.compile(WORD)
    table = bytes(i if word.match(chr(i)) else 32 for i in range(256))

    def spaced(text: str) -> str:
        try:
            return text.encode("latin-1").translate(table).decode("latin-1")
        except UnicodeEncodeError:
            return " ".join(word.findall(text))

    return spaced


class HashingEncoder:
    """Stands in for a model: signed feature hashing of simple terms, unit length. Each distinct term of a call is hashed once."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        spaced = _spacer()
        words = pc.split_pattern(pa.array([spaced((text or "").lower()) for text in texts], pa.large_string()), " ")
        rows = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        terms = coded.dictionary.cast(pa.large_binary()).to_pylist()
        h = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in terms), "<u8")
        sign = np.where(h >> np.uint64(63), 1.0, -1.0) * np.array([t != b"" for t in terms], bool)  # nothing is between two spaces
        place, own = (h % np.uint64(self.dimensions)).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False)
        sums = np.bincount(rows * self.dimensions + place[own], sign[own], len(texts) * self.dimensions)
        out = sums.astype(np.float64).reshape(len(texts), self.dimensions)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, where=size > 0, out=np.zeros_like(out))


def embed(text: Column, encoder=None) -> Column:
    """Vectors of a text column by an encoder with ``encode(list of str)``; batches keep their order."""
    encoder = encoder or HashingEncoder()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(list(encoder.encode(s.fillna("").tolist())), index=s.index)

    return run(text)


#: Forms of making a text fit a model's window.
FORMS = ("pack", "truncate", "barbell")


def fitted(text: str, budget: int, form: str = "pack") -> list[str]:
    """The pieces of a text that each fit ``budget`` tokens, as ``text.pack_sentences``, ``truncate`` and ``barbell`` give them; a text without any piece has an empty one."""
    if -(-len(text) // CHARS_PER_TOKEN) <= budget:
        return [text]
    if form == "truncate":
        return [text[: CHARS_PER_TOKEN * budget]]
    if form == "barbell":
        head, tail = budget // 2 * CHARS_PER_TOKEN, (budget - budget // 2) * CHARS_PER_TOKEN
        return [f"{text[:head]} {text[-tail:]}"]
    return packed(text, budget) or [""]


def embed_fitted(text: Column, encoder: object | Callable[[], object], max_tokens: int, form: str = "pack", at_once: int = 64) -> Column:
    """Vectors of texts of any length: texts are made to fit, their pieces encoded and averaged, all within an Arrow batch and so without a shuffle.

    ``encoder`` has ``encode(list of str)``, or is a class or function that makes it, called once in each task. Pieces of a
    batch go to it ordered by length, ``at_once`` in a call, so that padding is little. A text of one piece keeps the
    piece's vector; of several the vector is the mean, not normalised again. Null counts as empty. A row that the encoder
    returns of another number of pieces is an error.
    """
    if form not in FORMS:
        raise ValueError(f"unknown overflow form {form!r}; known: {FORMS}")
    budget = max_tokens - MARGIN
    if budget < 2 or at_once < 1:
        raise ValueError("the window is too small for any text, or no piece goes to the encoder at once")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder() if isinstance(encoder, type) or not hasattr(encoder, "encode") else encoder
        for s in batches:
            pieces = [fitted(t, budget, form) for t in s.fillna("")]
            flat = [p for own in pieces for p in own]
            if not flat:
                yield pd.Series([], dtype=object, index=s.index)
                continue
            order = sorted(range(len(flat)), key=lambda i: len(flat[i]))
            calls = [order[i : i + at_once] for i in range(0, len(order), at_once)]
            coded = [np.asarray(model.encode([flat[i] for i in call]), dtype=np.float64) for call in calls]
            if [len(c) for c in coded] != [len(call) for call in calls]:
                raise ValueError("the encoder gave another number of vectors than it was given texts")
            rows = np.concatenate(coded)[np.argsort(order)]
            sizes = np.array([len(own) for own in pieces])
            means = np.add.reduceat(rows, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
            yield pd.Series(list(means), index=s.index)

    return run(text)


@dataclass(frozen=True)
class EncoderSpec:
    """What a table of a model's vectors relies on."""

    dimensions: int
    max_tokens: int
    query_prompt: bool


# The published models.
SPECS = {"qwen": EncoderSpec(1024, 32_768, True), "bge-m3": EncoderSpec(1024, 8_192, False)}
#: Encoders by name; a model plugs in by ``plug``.
ENCODERS = {"hashing": HashingEncoder}


def plug(name: str, factory) -> None:
    """Make ``factory(**options)``, whose result has ``encode(list of str)``, the encoder of that name."""
    ENCODERS[name] = factory


def build_encoder(name: str, **options):
    """An encoder by name; one of a published model must have the model's dimensions."""
    if name not in ENCODERS:
        known = f"; plug in its model of {SPECS[name].dimensions} dimensions first" if name in SPECS else ""
        raise ValueError(f"unknown encoder {name!r}{known}; known: {sorted(ENCODERS)}")
    encoder = ENCODERS[name](**options)
    if name in SPECS and getattr(encoder, "dimensions", SPECS[name].dimensions) != SPECS[name].dimensions:
        raise ValueError(f"encoder {name!r} needs {SPECS[name].dimensions} dimensions")
    return encoder
