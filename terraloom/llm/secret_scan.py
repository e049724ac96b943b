"""Secret scan: fixed patterns, and a token-efficiency test for strings that no pattern knows.

A subword vocabulary packs ordinary text into few tokens; random strings break into many. A run of key
characters whose characters-per-token ratio is low is therefore taken as a secret; of other runs, the stretch of
tokens that is furthest below the ratio, so that words joined to a secret don't hide it. Before that, known digests
(hexadecimal of a usual digest length) and identifiers (UUIDs, names of words, numbers, dotted names) are excluded.

Null and empty texts have no spans; an empty table gives an empty result; texts of any length are scanned whole.
Repeated rows are scanned each. Only the id and the text are read from the input.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import batches, small_batches

# What the patterns must match.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6

#: Runs of key characters that the token test looks at.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_STRETCH = 16
#: Letters alone are tested from this length on, and are no secret if the parts of the camel-case or joined name tokenise well.
MIN_LETTERS = 20
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SEPARATOR = re.compile(r"[+/_=-]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-fA-F]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
KINDS = ("assign", "access", "hex", "random")
#: Random strings over letters and digits get 1.2 to 1.7 characters a token, words 2.5 and more.
MAX_RATIO = 2.0


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _vocabulary(path: str | None):
    import public_tokenizers

    return _encoding(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def is_random(run: str, encoding, max_ratio: float = MAX_RATIO) -> bool:
    """Low characters per token, and neither a known digest nor an identifier."""
    if DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run):
        return False
    if not any(c.isalpha() for c in run):
        return False
    if not any(c.isdigit() for c in run):
        humps = HUMP.findall(run)
        if len(run) < MIN_LETTERS or len(run) >= 4 * len(humps) and len(run) >= max_ratio * sum(len(encoding.encode_ordinary(h.lower())) for h in humps):
            return False
    return len(run) < max_ratio * len(encoding.encode_ordinary(run))


def random_stretches(run: str, encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: all of it, or pieces between separators, or stretches of tokens of the rest."""
    pieces = [m for m in re.finditer(r"[^+/_=-]+", run) if len(m[0]) >= MIN_STRETCH]
    known = [m.span() for m in UUID.finditer(run)] + [m.span() for m in pieces if DIGEST.fullmatch(m[0]) and len(m[0]) in DIGEST_LENGTHS]
    if not known and is_random(run, encoding, max_ratio):
        return [(0, len(run))]
    found = [m.span() for m in pieces if is_random(m[0], encoding, max_ratio)]
    at = 0
    for start, end in [*sorted(known + found), (len(run), len(run))]:
        if start - at >= MIN_STRETCH:
            found += [(at + a, at + b) for a, b in _low_stretches(run[at:start], encoding, max_ratio)]
        at = max(at, end)
    return sorted(found)


def _low_stretches(part: str, encoding, max_ratio: float) -> list[tuple[int, int]]:
    """The stretch whose tokens have the most below the ratio, and those on both sides of it."""
    best, total, first, at, span = 0.0, 0.0, 0, 0, None
    for token in encoding.encode_ordinary(part):
        n = len(encoding.decode_single_token_bytes(token))
        letters = len(SEPARATOR.sub("", part[at : at + n]))
        if total <= 0:
            total, first = 0.0, at
        total += (max_ratio - letters) if letters else 0
        at += n
        if total > best:
            best, span = total, (first, at)
    if span is None:
        return []
    start, end = span
    start, end = start + len(part[start:end]) - len(part[start:end].lstrip("+/_=-")), start + len(part[start:end].rstrip("+/=_-"))
    pieces = SEPARATOR.split(part[start:end])
    bare = "".join(pieces)
    if len(bare) < MIN_STRETCH or len(bare) < 4 * len(pieces) or not is_random(bare, encoding, max_ratio):
        return []
    sides = [(a, b) for a, b in ((0, start), (end, len(part))) if b - a >= MIN_STRETCH]
    return sorted([(start, end), *((a + x, a + y) for a, b in sides for x, y in _low_stretches(part[a:b], encoding, max_ratio))])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns: leftmost, not overlapping within a kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    return [(m.start() + a, 3, m.start() + b) for m in RUN.finditer(text) for a, b in random_stretches(m[0], encoding, max_ratio)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    spans holds kind:start:end in code points, end exclusive, ordered by start and kind. vocabulary is the
    path of a rank file that every executor can open; by default the installed 50k byte-level vocabulary.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _vocabulary(vocabulary)
        for f in batches(frames, 1024):
            out = []
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                base = base_spans(text)
                more = random_spans(text, encoding, max_ratio)
                n = [0, 0, 0]
                for _, kind, _ in base:
                    n[kind] += 1
                out.append((doc_id, *n, len(more), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more) if more else base)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
