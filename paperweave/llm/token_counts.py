"""Token counts of whole texts, long ones by overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks with token offsets. Two neighbouring chunks are spliced at a boundary that
both have and that is proven stable: a place where pre-tokenisation starts anew whatever stands before it, so that the tokens left of
it depend on the left chunk alone and those right of it on the right one. Such places are the beginnings of white space and the changes
between letters, digits and other characters. An overlap without one is widened, and where there is none at all the chunk is doubled.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick
from .scratch import small_batches
from .textops import runs

#: Characters of a chunk, and those that two chunks share at first.
CHUNK, OVERLAP = 4_096, 64
LIMIT = 512
#: Texts handed to the library at once, in bytes.
CALL_BYTES = 256 << 10
#: UTF-8 of code points up to U+027F has no byte above this; within them both encoders split alike (tests/llm/test_token_counts.py).
PLAIN_BYTE = 0xC9


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The tokens of byte_bpe_50k.json as the tokenizers library gives them.

    A second, faster encoder is made from the same file. It counts the texts in which both are known to split alike.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        spec = json.loads(Path(path).read_text())
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding(Path(path).stem, pat_str=split, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.marks = tuple(special)
        sizes = {i: len(t) for t, i in ranks.items()} | {i: len(t.encode()) for t, i in special.items()}
        self.sizes = np.zeros(max(sizes) + 1, np.int64)
        self.sizes[list(sizes)] = list(sizes.values())

    def spans(self, text: str) -> list[tuple[int, int]]:
        """First and end character of each token, a token of part of a character having that character."""
        return self.slow.encode(text, add_special_tokens=False).offsets

    def _plain(self, text: str) -> list[int]:
        if any(m in text for m in self.marks):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    def count_plain(self, text: str) -> int:
        return len(self._plain(text))

    def plain_spans(self, text: str) -> np.ndarray:
        """The same as ``spans``, by the second encoder."""
        size = self.sizes[np.array(self._plain(text), np.int64)]
        end = np.cumsum(size)
        start = end - size
        if len(text) < (end[-1] if len(end) else 0):
            of = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1  # the character of each byte
            start, end = of[start], of[end - 1] + 1
        return np.stack([start, end], 1)

    def count_batch(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]


def _kind(c: str) -> str:
    """L, N, S for a letter, a number or white space, O for others; empty where versions of Unicode do not agree."""
    k = unicodedata.category(c)
    if k != unicodedata.ucd_3_2_0.category(c) or k == "Cn":
        return ""
    return "S" if c.isspace() else k[0] if k[0] in "LN" else "O"


def stable_cuts(text: str, marks: tuple[str, ...]) -> Callable[[int], bool]:
    """Whether splitting starts anew at a place, in no special token.

    White space begins there, or letters, digits and other characters change. A letter after an apostrophe is none, as it may
    belong to a contraction, and so are the information separators, which not all libraries count as white space.
    """

    def stable(i: int) -> bool:
        if not 0 < i < len(text) or "\x1c" <= text[i] <= "\x1f" or "\x1c" <= text[i - 1] <= "\x1f":
            return False
        before, after = _kind(text[i - 1]), _kind(text[i])
        if not before or not after or before in ("S", after) or (text[i - 1] == "'" and after == "L"):
            return False
        return not any(text.startswith(m, j) for m in marks for j in range(max(0, i - len(m) + 1), i + 1))

    return stable


def count_long(text: str, spans: Callable[[str], np.ndarray | list[tuple[int, int]]], marks: tuple[str, ...], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, counted over overlapping chunks. Each chunk is encoded once, but where it is doubled or an overlap widened."""

    def tokens(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(spans(text[a:b]), np.int64).reshape(-1, 2) + a
        return at[:, 0], at[:, 1]

    if len(text) <= chunk:
        return len(spans(text))
    stable = stable_cuts(text, marks)
    total, start, end, size = 0, 0, chunk, chunk  # tokens before ``start`` are counted
    here = tokens(0, chunk)
    while end < len(text):
        wide, cut, tried = overlap, None, end
        while cut is None and tried > start + 1:
            left = max(start, end - wide)
            place = next((i for i in range(tried - 1, left, -1) if stable(i)), None)
            if place is None:
                tried, wide = left + 1, wide * 4
                continue
            stop = min(len(text), end + chunk)
            there = tokens(left, stop)
            if (here[0] == place).any() and (here[1] == place).any() and (there[0] == place).any():
                cut = place
            else:  # not aligned after all
                tried, wide = place, wide * 4
        if cut is None:
            size *= 2
            end = min(len(text), start + size)
            here = tokens(start, end)
            continue
        total += int(((here[0] >= start) & (here[0] < cut)).sum())
        start, here, end, size = cut, there, stop, chunk
    return total + int((here[0] >= start).sum())


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _calls(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CALL_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is a byte-level file of the tokenizers library, readable under that path on every executor. No begin, end or added
    special tokens; special strings inside a text become their special token, as is the library's default. A null text is empty: no
    bytes, no tokens. Repeated rows are counted one by one; other columns are not read. An empty table gives no rows. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for part, data, at in runs(batch):
                n_bytes = np.diff(at)
                texts = [t.as_py() or "" for t in part.column(1)]
                n = np.zeros(len(texts), np.int64)
                other = []
                for i, t in enumerate(texts):
                    plain = at[i] == at[i + 1] or data[at[i] : at[i + 1]].max() <= PLAIN_BYTE
                    if len(t) > chunk:
                        n[i] = count_long(t, encoder.plain_spans if plain else encoder.spans, encoder.marks, chunk, overlap)
                    elif plain:
                        n[i] = encoder.count_plain(t)
                    else:
                        other.append(i)
                done = 0
                for call in _calls([texts[i] for i in other]):
                    n[other[done : done + len(call)]] = encoder.count_batch(call)
                    done += len(call)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
