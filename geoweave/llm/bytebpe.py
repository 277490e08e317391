"""A public byte-level BPE vocabulary as data: ranks, merges, pre-token rules, the library's own encoder."""

from __future__ import annotations

import functools
import json

import numpy as np

DEFAULT = "byte_bpe_50k"

#: Character classes of the pre-token pattern.
OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point, from the Unicode categories: L*, N*, white space."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), OTHER, kind)
    table[0x20] = SPACE
    return table


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, by its published rule."""
    plain = [b for b in range(256) if (0x21 <= b <= 0x7E) or (0xA1 <= b <= 0xAC) or (0xAE <= b <= 0xFF)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[tuple[int, int], tuple[int, int]], list[tuple[str, int]]]:
    """Token bytes to id; (left id, right id) to (rank, merged id); added special strings with their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    assert spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges"), "a plain BPE model is needed"
    added = [(t["content"], t["id"]) for t in spec["added_tokens"]]
    alphabet, special = byte_alphabet(), {c for c, _ in added}
    vocab = spec["model"]["vocab"]
    tokens = {bytes(alphabet[c] for c in k): v for k, v in vocab.items() if k not in special}
    merges = {}
    for rank, m in enumerate(spec["model"]["merges"]):
        left, right = m.split(" ") if isinstance(m, str) else m
        merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
    return tokens, merges, added
