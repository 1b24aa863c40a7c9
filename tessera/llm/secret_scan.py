"""Secret scan: Aho-Corasick prefilter, anchored patterns, checksums.

One automaton over the whole text finds the keywords of every kind. A pattern
is tried only at a hit, anchored there. Kinds whose tokens embed a checksum
keep a match only when the checksum holds.

Kinds, in the order in which spans of equal start are listed:
  assign  a keyword, ``:`` or ``=``, and a value of 12 or more characters
  access  AKIA and upper-case letters or digits, 18 characters or more
  hex     a run of 16 or more lower-case hex digits
  github  ghp_ gho_ ghu_ ghs_ ghr_ + 36 letters or digits; the last six are the
          base-62 CRC-32 of the 30 before them
  npm     npm_ + 36 letters or digits with the same checksum
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import UPPER, frees_memory, text_slices, with_results

KINDS = ["assign", "access", "hex", "github", "npm"]
BASE = KINDS[:3]
# Keywords and patterns of the base kinds.
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# Prefixes of tokens with an embedded checksum.
CHECKED = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
TOKEN = re.compile(r"[a-z]{3}_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
DIGITS62 = "0123456789" + UPPER + UPPER.lower()
HEX_STEP = 4      # every run of 16 hex digits holds 4-grams of hex digits


def crc62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS62[d] + out
    return out


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Every keyword with its kind and length, in lower case."""
    a = ahocorasick.Automaton()
    for w in KEYWORDS:
        a.add_word(w, ("assign", len(w)))
    for w in CHECKED:
        a.add_word(w, (CHECKED[w], len(w)))
    a.add_word("akia", ("access", 4))
    for gram in product("0123456789abcdef", repeat=HEX_STEP):
        a.add_word("".join(gram), ("hex", HEX_STEP))
    a.make_automaton()
    return a


def fold(text: str) -> str:
    """A-Z in lower case, code points in place."""
    return text.encode().lower().decode()


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start, then kind as listed."""
    spans: list[tuple[int, int, str]] = []
    hits: dict[str, list[int]] = {k: [] for k in KINDS}
    run_end = 0
    for end, (kind, size) in automaton().iter(fold(text)):
        if kind == "hex":
            if end < run_end:
                continue
            m = HEX.match(text, start := end + 1 - size)
            if m is None:           # upper-case letters inside
                continue
            # the run starts at its first 4-gram; after it, hits inside are skipped
            run_end = m.end()
            if run_end - start >= 16:
                spans.append((start, run_end, "hex"))
        else:
            hits[kind].append(end + 1 - size)
    last = 0
    for at in sorted(hits["assign"]):
        if at >= last and (m := ASSIGN.match(text, at)):
            last = m.end()
            if len(m[2]) >= 12:
                spans.append((at, last, "assign"))
    last = 0
    for at in hits["access"]:
        if at >= last and (m := ACCESS.match(text, at)):
            last = m.end()
            if last - at >= 18:
                spans.append((at, last, "access"))
    for kind in ("github", "npm"):
        for at in hits[kind]:
            m = TOKEN.match(text, at)
            if m and crc62(m[1]) == m[2] and not text[at - 1:at].isalnum():
                spans.append((at, m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, or run of overlapping spans, as ``[SECRET]``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``secrets`` array<struct<start, end, kind>> (code points,
    end exclusive) and ``redacted_text``.

    A null or empty text has no spans and is redacted to the empty text. Rows
    are independent: null or repeated ids, ties and extra columns pass
    through; the two results replace columns of those names; an empty table
    gives an empty result. Texts of any length are scanned whole.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    @F.arrow_udf("struct<secrets:array<struct<start:bigint,end:bigint,kind:string>>,redacted_text:string>")
    @frees_memory
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in text_slices(batch):
                found = [scan(t) for t in texts]
                rows = [[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in found]
                clean = [redact(t, x) if x else t for t, x in zip(texts, found)]
                yield pa.StructArray.from_arrays([pa.array(rows, pa.list_(span)), pa.array(clean, pa.string())],
                                                 names=["secrets", "redacted_text"])
    return with_results(docs, run(F.col(text_col)), ["secrets", "redacted_text"])
