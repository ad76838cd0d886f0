"""Exact token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import json
import sys
import types

import numpy as np
import tiktoken

#: Fixed value: how the vocabulary's pre-tokenizer splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, and the bytes that they stand for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_ranks(model: dict) -> dict[bytes, int]:
    """{token bytes: id} of a byte-level BPE file (its model's vocabulary, whose ids follow the order of merges)."""
    of = byte_alphabet()
    added = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(of[c] for c in t): k for t, k in model["model"]["vocab"].items() if t not in added}


def read_added(model: dict) -> dict[str, int]:
    """{text: id} of the file's added tokens, which stand for themselves wherever a text holds them."""
    for t in model.get("added_tokens", []):
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError(f"added token {t['content']!r} takes blanks or word borders into account")
    return {t["content"]: t["id"] for t in model.get("added_tokens", [])}


def token_ids(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a whole text as little-endian unsigned 32-bit integers."""
    return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def worker_encoding(key: str, raw: bytes) -> tiktoken.Encoding:
    """One encoding per Python worker and vocabulary, kept from task to task in a module of its own."""
    kept = sys.modules.setdefault("_quern_worker_encodings", types.ModuleType("_quern_worker_encodings")).__dict__
    if key not in kept:
        model = json.loads(raw)
        kept[key] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=read_ranks(model), special_tokens=read_added(model))
    return kept[key]
