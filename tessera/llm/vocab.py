"""Byte-level vocabularies (tokenizer JSON files) and their text splitters."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

# The split patterns of the two public byte-level vocabularies.
WORD_OR_SPACE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
# Letters and numbers younger than the Unicode tables of the
# tokenizer library, known to the regex module; they split like symbols.
YOUNG_LETTERS = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1
    ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8
    16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2
    1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
    1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479
    3d000-3fc3f"""
YOUNG_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def _members(ranges: str) -> str:
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split())


def without_young(pattern: str) -> str:
    """The same pattern over the older tables."""
    young = _members(YOUNG_LETTERS) + _members(YOUNG_NUMBERS)
    for kind in ("L", "N"):
        pattern = pattern.replace(rf"\s\p{{L}}\p{{N}}]", "SYMBOL").replace(
            rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{young}]]").replace("SYMBOL", r"\s\p{L}\p{N}]")
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{young}])")


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others for 256, 257, ... in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Vocabulary:
    """Merges and tokens of a byte-level BPE file, as arrays.

    ``byte_id[b]`` / ``last_id[b]``: the symbol of byte ``b`` inside / at the
    end of a piece (they differ only with a word-end suffix). A merge of rank
    ``r`` turns ``left[r], right[r]`` into ``merged[r]``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.byte_id = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last_id = np.array([ids[c + suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = (self.left << 32) | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.lower = spec["normalizer"] is not None
        words = WORD_ONLY if suffix else WORD_OR_SPACE
        self.words = regex.compile(words)
        self.high = re.compile("[\u0558-\U0010ffff]")   # a quick first look
        self.young = regex.compile(f"[{_members(YOUNG_LETTERS + ' ' + YOUNG_NUMBERS)}]")
        self.old_words = regex.compile(without_young(words), regex.V1)
        byte_of = {c: b for b, c in enumerate(letters)}
        self.token_bytes: list[bytes] = [b""] * (max([*ids.values(), *self.specials.values()]) + 1)
        for token, i in ids.items():
            stem = token[: len(token) - len(suffix)] + " " if suffix and token.endswith(suffix) else token
            self.token_bytes[i] = bytes(byte_of.get(c, 32) for c in stem)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where the pair never merges."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def pieces(self, text: str) -> list[str]:
        """The units merged on their own, special strings among them."""
        if self.special_split is None or "<|" not in text:
            return self.split(text)
        out: list[str] = []
        for part in self.special_split.split(text):
            if part in self.specials:
                out.append(part)
            elif part:
                out += self.split(part)
        return out

    def split(self, text: str) -> list[str]:
        text = self.normalise(text)
        if not self.high.search(text) or not self.young.search(text):
            return self.words.findall(text)
        return self.old_words.findall(text)

    def normalise(self, text: str) -> str:
        """NFC and lower case, letter by letter (no final-sigma rule)."""
        if not self.lower:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """One copy per Python worker."""
    return Vocabulary(path)
