"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans, which always stay. The field looks at every other
candidate: a run with an at sign, or a run of seven or more digits. Each candidate has a
label (none, email, ip, card, phone) and local features; neighbours share a chain
potential; and candidates with the same or a similar value (equal digits or letters,
or one a tail of the other's digits), however far apart, share a skip potential. Loopy
sum-product message passing on the document's graph then makes labels of one value
agree, so a telephone number that is written once in full is also found where its
prefix is missing. Base spans are observed nodes.

Training: weights and potentials are fitted together by pseudo-likelihood: the label of a
node given its features and the labels of its neighbours. Base spans teach their labels, and
candidates that share no skip edge with a base span teach the label none; a candidate that does is
the case in question and stays unlabelled. Counts of (features, neighbours' labels, label) come from
all documents; the ``PATTERNS`` most frequent combinations are fitted, which bounds what reaches the driver.

Scale: two passes over the documents, no document is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import id_and_text, slices

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is none; label i is KINDS[i - 1].
LABELS = len(KINDS) + 1
#: Distinct combinations of features and neighbours that the field is fitted on, the most frequent first.
PATTERNS = 5_000
#: Neighbours of one label that count, at most, while fitting.
NEIGHBOURS = 3
#: Log potentials before any data: equal labels on a skip edge, and how strongly the fit is held to the start.
EQUAL, HELD_TO = 7.0, 1e-4
#: An added span's label has at least this marginal.
SURE = 0.5
#: Digits that a candidate without an at sign has at least, and a tail shares at least.
DIGITS = 7
#: Code points between neighbours that share a chain potential, at most.
NEAR = 60
ROUNDS = 12
BATCH_BYTES = 4_000_000

# The patterns.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN = re.compile(r"[\x20().0-9+-]*")
_RUN_CHARS = frozenset(" ().0123456789+-")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_AT_RUN = re.compile(r"[^\s,;<>()\[\]\"']*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a match's local part ends at an at sign and starts as far left as it can."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", at + 1)
    return out


def number_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of digits and the characters that may stand between them; every number match lies in one."""
    out, at = [], 0
    while m := _DIGIT.search(text, at):
        start = m.start()
        while start > at and text[start - 1] in _RUN_CHARS:
            start -= 1
        end = _RUN.match(text, m.start()).end()
        out.append((start, end))
        at = end
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the patterns' valid matches, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for start, end in number_runs(text):
        if end - start < 7:
            continue
        for m in _IP.finditer(text, start, end):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, start, end):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, start, end):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, label, end) of the field's nodes in order: base spans with their label, other candidates with -1."""
    nodes = [(a, k + 1, b) for a, k, b in base]
    taken: list[list[int]] = []  # the base spans' union
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts, ends = [x[0] for x in taken], [x[1] for x in taken]

    def within(a: int, b: int) -> list[list[int]]:
        """The parts of the union that meet [a, b)."""
        return taken[bisect_right(ends, a) : bisect_left(starts, b)]

    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = _AT_RUN.match(text, at).end()
        if end - start > 2 and not within(start, end):
            nodes.append((start, -1, end))
        at = text.find("@", max(end, at + 1))
    for start, end in number_runs(text):
        if end - start < DIGITS:
            continue
        # Split at base spans; trim to digits, keeping an opening sign.
        cuts = [start, *(x for s in within(start, end) for x in s), end]
        for a, b in zip(cuts[::2], cuts[1::2]):
            piece = text[a:b]
            left = len(piece) - len(piece.lstrip(" ).-."))
            right = len(piece.rstrip(" ().+-"))
            if left < right and len(_NOT_DIGIT.sub("", piece[left:right])) >= DIGITS:
                nodes.append((a + left, -1, a + right))
    return sorted(nodes)


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """A node's local features, each a small integer; the opening sign of a number is not among them."""
    value = text[start:end]
    digits = len(_NOT_DIGIT.sub("", value))
    groups = len([g for g in re.split(r"[^0-9]+", value) if g])
    after = value.rpartition("@")[2]
    return (
        min(digits, 20), min(groups, 6), int("@" in value) + 2 * int("." in after and "@" in value),
        int("(" in value), int("-" in value), min(value.count("."), 4), min(value.count(" "), 4),
        int(start > 0 and text[start - 1].isalnum()), int(end < len(text) and text[end].isalnum()), int(digits > 12 and luhn(_NOT_DIGIT.sub("", value))),
    )


#: How many values each feature has.
FEATURE_SIZES = (21, 7, 4, 2, 2, 5, 5, 2, 2, 2)
_OFFSETS = np.cumsum([0, *FEATURE_SIZES])


def _key(value: str) -> str:
    return value.lower() if "@" in value else _NOT_DIGIT.sub("", value)


def edges(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between near neighbours, and skip edges between similar values.

    A value's occurrences form a chain in order, so an often repeated value costs one edge each.
    """
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][2] <= NEAR]
    skip, last, tails = [], {}, {}
    for i, (a, _, b) in enumerate(nodes):
        key = _key(text[a:b])
        if key in last:
            skip.append((last[key], i))
        elif "@" not in key:
            tail = key[-10:] if len(key) >= 10 else key
            for t in {tail, key[-DIGITS:]}:
                if len(t) >= DIGITS and t in tails:
                    skip.append((tails[t], i))
                    break
            for t in {tail, key[-DIGITS:]}:
                tails.setdefault(t, i)
        last[key] = i
    return chain, skip


class Field:
    """Weights: one for each (feature value, label), and log potentials of chain and skip edges."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def marginals(self, text: str, nodes: list[tuple[int, int, int]]) -> np.ndarray:
        """Label marginals of each node by damped loopy sum-product."""
        local = np.array([self.weights[_OFFSETS[:-1] + features(text, a, b)].sum(axis=0) for a, _, b in nodes])
        for i, (_, label, _) in enumerate(nodes):
            if label >= 0:
                local[i] = -50.0
                local[i, label] = 0.0
        chain, skip = edges(text, nodes)
        both = chain + skip
        if not both:
            return _softmax(local)
        pair = np.concatenate((np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)))
        one, two = np.array(both).T
        source, target = np.concatenate((one, two)), np.concatenate((two, one))
        pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(both)) + len(both), np.arange(len(both))))
        message = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, message)
            out = _logsumexp(pair + (belief[source] - message[back])[:, :, None])
            out -= out.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * out
        belief = local.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def _logsumexp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(field: Field, x: np.ndarray, around: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Minus the weighted log pseudo-likelihood, and its derivatives by weights, chain and skip potentials.

    ``x``: feature indexes of each pattern; ``around``: how many chain and skip neighbours have each
    label, as (patterns, 2, LABELS); ``y``: labels; ``n``: pattern weights. Potentials are symmetric.
    """
    logits = field.weights[x].sum(axis=1) + around[:, 0] @ field.chain + around[:, 1] @ field.skip
    p = _softmax(logits)
    loss = -float((n * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
    p[np.arange(len(y)), y] -= 1
    p *= n[:, None]
    weights = np.zeros_like(field.weights)
    for f in range(x.shape[1]):
        np.add.at(weights, x[:, f], p)
    pairs = [around[:, k].T @ p for k in range(2)]
    return loss, [weights, *pairs]


def fit(patterns: list[tuple[tuple[int, ...], tuple[int, ...], int, int]], steps: int = 400) -> Field:
    """A field from counts: (features, neighbours, label, n); neighbours are LABELS chain counts, then LABELS skip counts.

    AdaGrad from no weights, no chain potential and a preference for equal labels on skip edges.
    """
    start = [np.zeros((int(_OFFSETS[-1]), LABELS)), np.zeros((LABELS, LABELS)), EQUAL * np.eye(LABELS)]
    field = Field(*(x.copy() for x in start))
    if not patterns:
        return field
    x = np.array([_OFFSETS[:-1] + f for f, _, _, _ in patterns])
    around = np.array([c for _, c, _, _ in patterns], float).reshape(-1, 2, LABELS)
    y = np.array([label for _, _, label, _ in patterns])
    n = np.log1p(np.array([c for _, _, _, c in patterns], float))  # frequent patterns do not drown the others
    n /= n.sum()
    own = [field.weights, field.chain, field.skip]
    squares = [np.full_like(v, 1e-8) for v in own]
    for _ in range(steps):
        _, slopes = gradient(field, x, around, y, n)
        for k, (v, first, square, slope) in enumerate(zip(own, start, squares, slopes)):
            if k:
                slope = (slope + slope.T) / 2
            slope = slope + HELD_TO * (v - first)
            square += slope**2
            v -= 0.5 * slope / np.sqrt(square)
    np.clip(field.chain, -8, 8, out=field.chain)
    np.clip(field.skip, -8, 8, out=field.skip)
    return field


def lessons(text: str) -> Iterator[tuple[tuple[int, ...], tuple[int, ...], int]]:
    """(features, neighbours, label) of the nodes of a text that teach."""
    nodes = _nodes(text)
    if not nodes:
        return
    chain, skip = edges(text, nodes)
    labels = [label for _, label, _ in nodes]
    open_ = set()
    for i, j in skip:
        for one, other in ((i, j), (j, i)):
            if labels[one] < 0 and labels[other] > 0:
                open_.add(one)
    known = [None if i in open_ else max(label, 0) for i, label in enumerate(labels)]
    counts = [[0] * (2 * LABELS) for _ in nodes]
    for kind, pairs in enumerate((chain, skip)):
        for i, j in pairs:
            for one, other in ((i, j), (j, i)):
                if known[other] is not None:
                    counts[one][kind * LABELS + known[other]] += 1
    for (a, _, b), label, own in zip(nodes, known, counts):
        if label is not None:
            yield features(text, a, b), tuple(min(c, NEIGHBOURS) for c in own), label


def learn(docs: DataFrame) -> Field:
    """A field from the lessons of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, int]] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["value", "label", "n"])
            total.clear()
            return found

        for batch in slices(batches, "text", BATCH_BYTES):
            for text in batch.column("text").to_pylist():
                for own, around, label in lessons(text):
                    total[",".join(map(str, (*own, *around))), label] += 1
            if len(total) > 50_000:
                yield out()
        yield out()

    counts = docs.select("text").mapInArrow(run, "value string, label int, n long").groupBy("value", "label").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "value", "label").limit(PATTERNS).collect()
    size, patterns = len(FEATURE_SIZES), []
    for r in rows:
        value = tuple(map(int, r["value"].split(",")))
        patterns.append((value[:size], value[size:], r["label"], r["n"]))
    return fit(patterns)


def _nodes(text: str | None) -> list[tuple[int, int, int]]:
    if not text or "@" not in text and not _DIGIT.search(text):
        return []
    return candidates(text, base_spans(text))


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans, both (start, kind index, end)."""
    nodes = _nodes(text)
    base = [(a, k - 1, b) for a, k, b in nodes if k > 0]
    added = []
    if len(base) < len(nodes):
        for (a, label, b), p in zip(nodes, field.marginals(text, nodes)):
            best = int(np.argmax(p))
            if label < 0 and best > 0 and p[best] >= SURE:
                added.append((a, best - 1, b))
    return base, added


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of base spans; ``spans`` holds all. Offsets are code points, ends
    exclusive. Null text is the empty text and has no spans; repeated rows are read each;
    spans that start together are listed by kind. An empty table gives no rows; other
    columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    field = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base, added = all_spans(text, field.value)
                for k, own in enumerate(counts):
                    own.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.mapInArrow(run, schema)
