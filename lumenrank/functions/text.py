"""Text functions on columns; Catalyst expressions wherever Spark has them."""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that stand for one token where no model tokenizer is given.
CHARS_PER_TOKEN = 3
#: Tokens left free in a model's window.
MARGIN = 16

# Characters that cleaning deletes.
INVISIBLE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{200b}-\x{200d}\x{2060}\x{feff}]"
#: Runs of white space as Python's split() sees it, but for a single space between words, which stays as it is.
_SPACE = r"(?U)(?! [^\s\x1c-\x1f])[\s\x1c-\x1f]+"
#: Unicode's white space.
_OUTER = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space as DuckDB's \s sees it (Java's has the vertical tab too), with the same exception.
_SQL_SPACE = r"(?! [^\t\n\f\r ])[\t\n\f\r ]+"
#: What DuckDB's trim deletes: Unicode's space separators.
_SQL_OUTER = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, which Spark has no function for."""
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Full Unicode case folding (lower() keeps, for one, the sharp s)."""
    for s in texts:
        yield s.map(str.casefold, na_action="ignore")


def clean(text: Column, normalise: bool = True) -> Column:
    """NFKC, line ends, invisible characters, blanks, blank lines, and outer white space, in this order.

    The patterns match only where something changes, so that plain text is passed through.
    """
    out = nfkc(text) if normalise else text
    for pattern, by in (("\r\n?", "\n"), (INVISIBLE, ""), ("\t[ \t]*| [ \t]+", " "), (" \n ?|\n ", "\n"), ("\n{3,}", "\n\n")):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(by))
    return F.btrim(out, F.lit(_OUTER))


def collapse(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def collapse_sql(text: Column) -> Column:
    """``collapse`` as DuckDB's ``trim(regexp_replace(text, '\\s+', ' ', 'g'))`` has it: of Unicode's other spaces, only outer ones go."""
    return F.btrim(F.regexp_replace(text, _SQL_SPACE, " "), F.lit(_SQL_OUTER))


def query_key(query: Column, ascii_only: bool = False) -> Column:
    """A query's identity: collapsed and case-folded. ``ascii_only`` stays in Catalyst."""
    return F.lower(collapse(query)) if ascii_only else casefold(collapse(query))


def digest(text: Column) -> Column:
    """16 hex digits of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_key(text: Column, retriever: Column, chunk_id: Column) -> Column:
    """A text's identity: 16 hex digits of its collapsed text, or its retriever and id where it is null or empty."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, digest(collapse(text))).otherwise(
        F.concat(F.lit("noid:"), retriever, F.lit(":"), F.coalesce(chunk_id, F.lit("")))
    )


def title_of(stem: Column) -> Column:
    """A file stem without a trailing 32-digit hex id; the stem itself where nothing else is left."""
    bare = F.regexp_replace(stem, r"\s*[0-9a-f]{32}$", "")
    return F.when(bare == "", stem).otherwise(bare)


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat_ws("#", source, index.cast("string"))


def n_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def truncate(text: Column, max_tokens: int) -> Column:
    """The leading tokens that fit a model's window."""
    budget = max_tokens - MARGIN
    return F.when(n_tokens(text) <= budget, text).otherwise(F.substring(text, 1, CHARS_PER_TOKEN * budget))


def barbell(text: Column, max_tokens: int) -> Column:
    """The head and the tail of a text that does not fit, with a space between."""
    budget = max_tokens - MARGIN
    head, tail = budget // 2 * CHARS_PER_TOKEN, (budget - budget // 2) * CHARS_PER_TOKEN
    return F.when(n_tokens(text) <= budget, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" "), F.right(text, F.lit(tail))))


def pack_sentences(text: Column, max_tokens: int) -> Column:
    """Pieces of at most the budget: sentences packed greedily, over-long ones cut."""
    budget = max_tokens - MARGIN

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: packed(t, budget), na_action="ignore")

    return F.when(n_tokens(text) <= budget, F.array(text)).otherwise(pack(text))


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def packed(text: str, budget: int) -> list[str]:
    size = lambda s: -(-len(s) // CHARS_PER_TOKEN)
    out: list[tuple[str, int]] = []
    open_ = False  # whether the last piece may still grow
    for sentence in filter(None, _SENTENCE.split(text)):
        need = size(sentence)
        if need > budget:
            step = budget * CHARS_PER_TOKEN
            out += [(sentence[i : i + step], budget) for i in range(0, len(sentence), step)]
            open_ = False
        elif open_ and out[-1][1] + need <= budget:
            out[-1] = (f"{out[-1][0]} {sentence}", out[-1][1] + need)
        else:
            out.append((sentence, need))
            open_ = True
    return [piece for piece, _ in out]


def by_tokens(text: Column, tokenizer, max_tokens: int, form: str = "truncate") -> Column:
    """The overflow forms by a model's own tokens: an array of pieces that fit its window.

    ``tokenizer`` has ``encode(text)`` to ids and ``decode(ids)`` to text, and is sent to the workers. ``truncate`` gives the
    leading tokens, ``barbell`` the leading and the last ones with a space between, ``split`` all, in order.
    """
    budget = max_tokens - MARGIN
    if form not in ("truncate", "barbell", "split"):
        raise ValueError(f"unknown overflow form {form!r}")

    def pieces(t: str) -> list[str]:
        ids = tokenizer.encode(t)
        if len(ids) <= budget:
            return [t]
        if form == "truncate":
            return [tokenizer.decode(ids[:budget])]
        if form == "barbell":
            return [f"{tokenizer.decode(ids[: budget // 2])} {tokenizer.decode(ids[-(budget - budget // 2) :])}"]
        return [tokenizer.decode(ids[i : i + budget]) for i in range(0, len(ids), budget)]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(pieces, na_action="ignore")

    return run(text)


#: Where a text is cut, the coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ")


class _Run(str):
    """A text without any separator that is too long for one chunk."""


def _pieces(text: str, limit: int, level: int = 0) -> Iterator[str | None]:
    """Pieces shorter than ``limit`` with separators at their ends, and runs that have none.

    None comes between pieces that are not merged: around a piece that had to be cut finer.
    """
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        yield text if len(text) < limit else _Run(text)
        return
    cut = SEPARATORS[level]
    parts = [p + cut for p in text.split(cut)]
    parts[-1] = parts[-1][: -len(cut)]
    for part in filter(None, parts):
        if len(part) < limit:
            yield part
        else:
            yield None
            yield from _pieces(part, limit, level + 1)
            yield None


def chunked(text: str | None, most: int = 2000, least: int = 200, overlap: int = 50) -> list[str]:
    """Chunks of at most ``most`` characters; a last one below ``least`` joins the one before."""
    if least >= most:
        raise ValueError("the least chunk size must be below the greatest")
    chunks: list[str] = []
    held: deque[str] = deque()
    size = fresh = 0

    def emit() -> None:
        chunk = "".join(held).strip()
        if chunk:
            chunks.append(chunk)

    for piece in _pieces(text or "", most):
        if piece is None or isinstance(piece, _Run):
            if fresh:
                emit()
            held.clear()
            size = fresh = 0
            if piece:  # cut at any place, each slice with the overlap of the one before
                slices = (piece[i : i + most].strip() for i in range(0, max(1, len(piece) - overlap), max(1, most - overlap)))
                chunks += filter(None, slices)
            continue
        if size + len(piece) > most:
            emit()
            while held and (size > overlap or size + len(piece) > most):
                size -= len(held.popleft())
        held.append(piece)
        size += len(piece)
        fresh = 1
    if fresh:
        emit()
    if len(chunks) > 1 and len(chunks[-1]) < least:
        last, before = chunks.pop(), chunks[-1]
        shared = max(k for k in range(len(last) + 1) if before.endswith(last[:k]))
        chunks[-1] = before + last[shared:] if shared else f"{before} {last}"
    return chunks


def chunks(text: Column, most: int = 2000, least: int = 200, overlap: int = 50) -> Column:
    """``chunked`` on a column."""
    if least >= most:
        raise ValueError("the least chunk size must be below the greatest")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: chunked(t, most, least, overlap))

    return run(text)


def titled(title: Column, text: Column) -> Column:
    """The text to embed under a title; what is stored stays the text."""
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.concat(title, F.lit("\n\n"), text))


def document_prompt(title: Column, text: Column) -> Column:
    return F.format_string("title: %s | text: %s", F.coalesce(title, F.lit("none")), text)


def query_prompt(query: Column) -> Column:
    return F.format_string("task: search result | query: %s", query)


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, with a note on how many more there are."""
    n = F.length(text)
    note = F.concat(F.substring(text, 1, most), F.lit("… ["), (n - most).cast("string"), F.lit(" more characters]"))
    return F.when(n > most, note).otherwise(text)


def shortened_items(items: Column, most: int = 100) -> Column:
    """``shortened`` on the text field of an array of structs."""
    return F.transform(items, lambda x: x.withField("text", shortened(x["text"], most)))


def thousandths(x: Column) -> Column:
    """A number with three digits after the point, rounded as C, Python and SQL's printf do.

    Those round the double itself, and a tie to an even digit; ``format_string`` rounds the shortest decimal that names the
    double, so that it gives 1.001 for 1.0005, which lies below the tie. From 2^53 on there are no digits to round.
    """
    x = x.cast("double")
    size = F.when(F.abs(x) < 2.0**53, F.abs(x))
    part = (size - F.floor(size)) * 2.0**53  # exact, and its thousandfold fits a long
    below = (part - F.floor(part)) * 1000  # the bits of numbers below one
    scaled = F.floor(part) * 1000 + F.floor(below)
    rest, low = scaled.bitwiseAND(F.lit(2**53 - 1)), F.shiftright(scaled, 53)
    up = (rest > 2**52) | (rest == 2**52) & ((below > F.floor(below)) | (low % 2 == 1))
    digits = low + up.cast("long")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, (F.floor(size) + (digits == 1000).cast("long")).cast("string"), F.lit("."), F.lpad((digits % 1000).cast("string"), 3, "0"))
    return F.coalesce(text, F.format_string("%.3f", x))
