"""Byte-level BPE vocabularies read from the files of public tokenizers."""

from __future__ import annotations

import base64
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from millrace.llm.intmap import IntMap

#: Letters, numbers, white space and everything else, as the pattern of byte_bpe_50k tells them apart.
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The characters of the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
#: Endings that the pattern splits off after an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def default_path() -> str:
    """byte_bpe_50k of the installed public_tokenizers; another file can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def all_characters() -> tuple[np.ndarray, str]:
    points = np.r_[np.arange(0xD800), np.arange(0xE000, sys.maxunicode + 1)]
    return points, "".join(map(chr, points.tolist()))


@lru_cache(maxsize=4)
def marked(pattern: str) -> np.ndarray:
    """Boolean by code point: whether the one-character pattern matches."""
    points, text = all_characters()
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in regex.finditer(f"(?:{pattern})+", text):
        out[points[m.start() : m.end()]] = True
    return out


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    out[marked(r"\p{L}")], out[marked(r"\p{N}")] = LETTER, NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins by which the JSON files of byte-level BPE write bytes: bytes that Latin-1 can print stand
    for themselves, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and unicodedata.category(chr(b)) != "Cf"]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that merge into token last, by merging its bytes with all smaller ranks."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


class Vocabulary:
    """Tokens with their merges.

    tokens: bytes by id. rank: order of the merge that makes a token, -1 for single bytes. left, right: the parts of
    that merge. merge: the token that a pair makes, by pair_key.
    """

    def __init__(self, tokens: list[bytes], splits: dict[int, tuple[int, int]]):
        n = len(tokens)
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int32)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        self.rank = np.full(n, -1, np.int32)
        for order, (token, (a, b)) in enumerate(splits.items()):
            self.left[token], self.right[token], self.rank[token] = a, b, order
        made = np.array(list(splits), np.int64)
        self.merge = IntMap(len(made))
        self.merge.put(self.pair_key(self.left[made], self.right[made]), made)
        self._trie()

    @staticmethod
    def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _trie(self) -> None:
        """child: node and byte to node; token_at: the token that ends at a node, or -1."""
        children: dict[int, int] = {}
        token_at = [-1]
        for token, text in enumerate(self.tokens):
            node = 0
            for byte in text:
                key = node << 8 | byte
                if (to := children.get(key)) is None:
                    to = children[key] = len(token_at)
                    token_at.append(-1)
                node = to
            if text:
                token_at[node] = token
        self.children = children
        self.child = IntMap(len(children))
        keys = np.fromiter(children.keys(), np.uint64, len(children))
        self.child.put(keys, np.fromiter(children.values(), np.int32, len(children)))
        self.token_at = np.array(token_at, np.int32)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a .json file with explicit merges or a .tiktoken file of ranks. Special tokens are no tokens here."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            letters = _byte_letters()
            ids = model["vocab"]
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            splits = {ids[a + b]: (ids[a], ids[b]) for a, b in merges}
            known = {ids[c] for c in letters} | set(splits)
            tokens = [b""] * (max(ids.values()) + 1)
            for text, token in ids.items():
                if token in known:
                    tokens[token] = bytes(letters[c] for c in text)
            return cls(tokens, splits)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for text, token in ranks.items():
            tokens[token] = text
        splits = {}
        for text, token in sorted(ranks.items(), key=lambda x: x[1]):
            if len(text) > 1:
                a, b = _merge_of(text, ranks)
                splits[token] = ranks[a], ranks[b]
        return cls(tokens, splits)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)
