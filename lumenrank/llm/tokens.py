"""Byte-level BPE ids for whole texts, fast in a Python worker.

Ids are those of the ``tokenizers`` file at ``path`` without special tokens. A byte-level BPE
file is run by ``tiktoken`` with the same vocabulary, as its ranks, where the file says
that both mean the same: no normaliser, the standard pattern, merges in the order of their ids.
Any other file, and any text that holds an added token's string, goes through ``tokenizers``.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in table.values():
            table[chr(256 + extra)] = b
            extra += 1
    return table


@lru_cache(maxsize=2)
def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def id_type(path: str, *others: int) -> str:
    """The numpy type of flat id files: two bytes where the vocabulary's ids and the ``others`` fit, else four."""
    spec = _spec(path)
    vocabulary = spec.get("model", {}).get("vocab", {})
    ids = vocabulary.values() if isinstance(vocabulary, dict) else range(len(vocabulary))
    most = max([*ids, *(t["id"] for t in spec.get("added_tokens", [])), *others])
    return "<u2" if most < 1 << 16 else "<u4"


def end_of_document(path: str, given: int | None) -> int:
    """The id that ends documents: the given one, or the file's first special added token, or else the first id beyond the vocabulary.

    An id that texts can have raises: documents would be cut in two there.
    """
    spec = _spec(path)
    vocabulary, added = spec.get("model", {}).get("vocab", {}), spec.get("added_tokens", [])
    ids = set(vocabulary.values()) if isinstance(vocabulary, dict) else set(range(len(vocabulary)))
    special = sorted(t["id"] for t in added if t.get("special"))
    if given is None:
        return special[0] if special else max([*ids, *(t["id"] for t in added), -1]) + 1
    if given < 0 or (given in ids or given in {t["id"] for t in added}) and given not in special:
        raise ValueError(f"id {given} is an ordinary id of {path}: it can't end documents")
    return given


def narrowed(ids: bytes, dtype: str) -> bytes:
    """32-bit ids in another width; ids that it can't hold raise."""
    if dtype == "<u4":
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) > np.iinfo(dtype).max:
        raise ValueError(f"id {int(wide.max())} does not fit {dtype}")
    return wide.astype(dtype).tobytes()


class Encoder:
    """``encode(text)`` gives little-endian unsigned 32-bit ids as bytes.

    ``literal`` takes the strings of added tokens as ordinary text; otherwise they are
    those tokens, as ``tokenizers`` has it by default.
    """

    def __init__(self, path: str, literal: bool = False):
        import tokenizers

        spec = _spec(path)
        self._slow = tokenizers.Tokenizer.from_file(path)
        self._slow.encode_special_tokens = literal
        added = spec.get("added_tokens", [])
        self._added = [t["content"] for t in added if not (literal and t.get("special"))]
        self._fast = self._byte_level(spec, {t["content"] for t in added})

    def _byte_level(self, spec: dict, added: set[str]):
        """The same vocabulary in a faster library, or None where the file is of another kind."""
        import public_tokenizers
        import tiktoken

        model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or spec.get("normalizer"):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            return None
        vocabulary = model["vocab"]
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        alphabet = _byte_alphabet()
        if merged != sorted(merged) or any(c not in vocabulary for c in alphabet):
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "It's 12 words,  and  \n more:\té汉字 <|x|> don't stop here \n"
        same = fast.encode_ordinary(probe) == self._slow.encode(probe, add_special_tokens=False).ids
        return fast if same else None

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._fast is None or any(t in text for t in self._added):
            return array("I", self._slow.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self._fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, literal: bool = False) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, literal)
