"""Exact deduplication by Patricia-trie owners.

Every distinct normalised text goes, with its length and a content hash, to one partition. There full byte strings are inserted
into a compressed radix trie whose terminals hold the identifier that stays and the number of copies. A map-side trie merges
copies before the shuffle, so a text that a third of all rows repeat crosses it once per task.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick
from .scratch import small_batches

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of keys that one trie holds before it spills a subtree.
TRIE_BYTES = 48 << 20
#: The same for the trie that merges copies before the shuffle; it is emitted and begun anew.
MERGE_BYTES = 16 << 20


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def content_key(data: bytes) -> bytes:
    """Content hash and length, which deal the keys out, then the whole text."""
    return xxhash.xxh3_64_digest(data) + len(data).to_bytes(8, "big") + data


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class Node:
    __slots__ = ("edge", "kids", "value")

    def __init__(self, edge: bytes, kids: dict[int, Node], value):
        self.edge, self.kids, self.value = edge, kids, value


class PatriciaTrie:
    """Byte strings with merged values; beyond ``limit`` bytes the heaviest subtree of the root is spilled.

    A spilled subtree is a file in the task's own temporary folder. Later keys of that subtree are appended, and ``items`` ends by
    reading each file into a trie of its own, whose root lies one byte deeper. No file outlives ``items``.
    """

    def __init__(self, merge: Callable, limit: int = TRIE_BYTES, depth: int = 0):
        self.merge, self.limit, self.depth = merge, limit, depth
        self.root = Node(b"", {}, None)
        self.held: dict[int, int] = {}
        self.spilled: dict[int, object] = {}
        self.bytes = 0

    def insert(self, key: bytes, value) -> None:
        if len(key) <= self.depth:
            self.root.value = value if self.root.value is None else self.merge(self.root.value, value)
            return
        top = key[self.depth]
        if top in self.spilled:
            pickle.dump((key, value), self.spilled[top])
            return
        node, at = self.root, self.depth
        while True:
            kid = node.kids.get(key[at]) if at < len(key) else None
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            if kid is None:
                node.kids[key[at]] = Node(key[at:], {}, value)
                self._grew(top, len(key) - at)
                return
            edge, rest = kid.edge, len(key) - at
            if len(edge) <= rest and key.startswith(edge, at):
                node, at = kid, at + len(edge)
                continue
            same = len(os.path.commonprefix([edge, key[at : at + len(edge)]]))
            split = Node(edge[:same], {edge[same]: kid}, None)
            kid.edge = edge[same:]
            node.kids[key[at]] = split
            node, at = split, at + same

    def _grew(self, top: int, n: int) -> None:
        self.held[top] = self.held.get(top, 0) + n + 200
        self.bytes += n + 200
        if self.bytes > self.limit and len(self.held) > 1 or self.bytes > 2 * self.limit:
            self._spill(max(self.held, key=self.held.get))

    def _spill(self, top: int) -> None:
        out = tempfile.TemporaryFile()  # noqa: SIM115  closed by items()
        for item in self._walk(self.root.kids.pop(top), bytes(self.depth)):
            pickle.dump(item, out)
        self.bytes -= self.held.pop(top)
        self.spilled[top] = out

    def _walk(self, node: Node, above: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, above)]
        while stack:
            node, above = stack.pop()
            key = above + node.edge
            if node.value is not None:
                yield key, node.value
            stack += [(k, key) for k in node.kids.values()]

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """Every key once with its merged value. ``prefix``: the bytes above this trie's root."""
        if self.root.value is not None:
            yield prefix, self.root.value
        for kid in self.root.kids.values():
            yield from self._walk(kid, prefix)
        self.root.kids.clear()
        for top in list(self.spilled):
            part = PatriciaTrie(self.merge, self.limit, self.depth + 1)
            with self.spilled.pop(top) as kept:
                kept.seek(0)
                while True:
                    try:
                        key, value = pickle.load(kept)
                    except EOFError:
                        break
                    part.insert(prefix + key[len(prefix) :], value)
            yield from part.items(prefix + bytes([top]))


def _merge(a: tuple, b: tuple) -> tuple:
    return larger(a[0], b[0]), a[1] + b[1]


_TEXTS = "content long, n_bytes long, body binary, owner long, copies long"
_OWNERS = "sha binary, keep_id long, group_size long"


def _text_rows(items: list[tuple[bytes, tuple]]) -> pa.RecordBatch:
    cols = list(zip(*[(int.from_bytes(k[:8], "big", signed=True), len(k) - 16, k[16:], *v) for k, v in items], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["content", "n_bytes", "body", "owner", "copies"])


def _merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit() -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for item in trie.items():
            held.append(item)
            size += len(item[0])
            if size > 4 << 20:
                yield _text_rows(held)
                held, size = [], 0
        if held:
            yield _text_rows(held)

    trie = PatriciaTrie(_merge, 1 << 62)
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            trie.insert(content_key(normalise(text.as_py())), (doc, 1))
            if trie.bytes > MERGE_BYTES:
                yield from emit()
                trie = PatriciaTrie(_merge, 1 << 62)
    yield from emit()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(_merge)
    for batch in batches:
        for body, owner, copies in zip(batch.column("body"), batch.column("owner").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            trie.insert(content_key(body.as_py()), (owner, copies))
    held = []
    for key, (owner, copies) in trie.items():
        held.append((hashlib.sha256(key[16:]).digest(), owner, copies))
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(("sha", "keep_id", "group_size"), x, strict=True)) for x in held], schema=_OWNER_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(("sha", "keep_id", "group_size"), x, strict=True)) for x in held], schema=_OWNER_ARROW)


_OWNER_ARROW = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(normalise(t.as_py())).digest() for t in batch.column(1)], pa.binary())], ["doc_id", "sha"])


def text_owners(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: SHA-256, the largest doc_id that holds it, number of rows."""
    small_batches(docs.sparkSession)
    base = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(_merge_copies, _TEXTS).repartition("n_bytes", "content").mapInArrow(_own, _OWNERS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z only; a null text counts as empty, and the empty text is a text
    like any other. The largest doc_id of a group stays; a null doc_id stays only where the whole group has none. Rows that repeat
    both doc_id and text are all counted in group_size and returned, and one of them is kept. Other columns are not read.
    An empty table gives no rows.
    """
    base = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = base.mapInArrow(_digests, "doc_id long, sha binary").groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(text_owners(docs), "sha")
    each = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
