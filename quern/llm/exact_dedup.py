"""Exact dedup by Patricia tries (operator 7).

Every input partition first puts its texts in a compressed radix trie, so a text goes on once per partition however
many copies it has (once per 4096 copies, as more are not held). The distinct texts are then dealt by length and content
hash, and the trie of each such partition decides on full byte strings which are equal. Terminal nodes hold the copies'
ids, which count towards a trie's budget; subtrees are spilled to a task's own temporary files when a trie outgrows it,
and are finished one after another.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cleaned, small_batches, trim, written


class Node:
    __slots__ = ("held", "kids", "label", "spill")

    def __init__(self, label: bytes):
        self.label, self.kids, self.held, self.spill = label, {}, None, None


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie from byte strings to lists of what was put there."""

    NODE_BYTES, HELD_BYTES = 300, 150

    def __init__(self, budget: int = 192 << 20):
        self.root, self.budget, self.bytes = Node(b""), budget, 0

    def put(self, key: bytes, what) -> list | None:
        """The list that it went to; None if that is spilled, or may just have been."""
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], [what]), node.spill)
                return None
            if at == len(key):
                break
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.bytes += len(kid.label) + self.NODE_BYTES
            elif not key.startswith(kid.label, at):
                kid = self._split(node, kid, common_prefix(key[at : at + len(kid.label)], kid.label))
            node, at = kid, at + len(kid.label)
        if node.held is None:
            node.held = []
        node.held.append(what)
        self.bytes += self.HELD_BYTES
        if self.bytes > self.budget:
            self._spill()
            return None
        return node.held

    def empty(self, held: list) -> None:
        """Forgets what a list that put() returned holds."""
        self.bytes -= self.HELD_BYTES * len(held)
        held.clear()

    def _split(self, parent: Node, kid: Node, at: int) -> Node:
        middle = Node(kid.label[:at])
        kid.label = kid.label[at:]
        middle.kids[kid.label[0]] = kid
        parent.kids[middle.label[0]] = middle
        self.bytes += self.NODE_BYTES
        return middle

    def _weight(self, node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + self.NODE_BYTES + self.HELD_BYTES * len(x.held or ())
            todo += x.kids.values()
        return total

    def _spill(self) -> None:
        """The heaviest subtree below the first fork goes to a file; what later belongs there follows it."""
        fork = self.root
        while len(alive := [k for k in fork.kids.values() if k.spill is None]) == 1 and alive[0].kids:
            fork = alive[0]
        if not alive:
            return
        heaviest = max(alive, key=self._weight)
        self.bytes -= self._weight(heaviest)
        file = tempfile.TemporaryFile()
        for key, held in self._walk(heaviest, b""):
            pickle.dump((key, held), file)
        heaviest.kids, heaviest.held, heaviest.spill = {}, None, file

    def _walk(self, node: Node, before: bytes):
        todo = [(node, before)]
        while todo:
            x, prefix = todo.pop()
            if x.held:
                yield prefix, x.held
            todo += [(k, prefix + k.label) for k in x.kids.values()]
            if x.spill is not None:
                x.spill.seek(0)
                below = PatriciaTrie(self.budget)
                while True:
                    try:
                        rest, held = pickle.load(x.spill)
                    except EOFError:
                        break
                    for what in held:
                        below.put(rest, what)
                x.spill.close()
                for rest, held in below.items():
                    yield prefix + rest, held

    def items(self):
        """(byte string, list) of each terminal node; can be called once when anything was spilled."""
        return self._walk(self.root, b"")


LOCAL = pa.schema([("doc_id", pa.int64()), ("copy_key", pa.int64()), ("is_first", pa.bool_()), ("n", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("text", pa.binary())])


def _batches(rows, schema: pa.Schema, limit: int = 8 << 20):
    """Rows (tuples) as record batches of about `limit` bytes in their last column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _smallest(a, b, largest: bool) -> bool:
    """Whether a goes before b as owner; null goes last."""
    if a is None or b is None:
        return b is None and a is not None
    return a > b if largest else a < b


def _owner(held: list, largest: bool):
    best = held[0]
    for x in held[1:]:
        if _smallest(x[0], best[0], largest):
            best = x
    return best


def _local(largest: bool, budget: int, most_held: int):
    def run(batches):
        trie = PatriciaTrie(budget)
        base, seen = TaskContext.get().partitionId() << 36, 0

        def copies(text, held):
            """Equal texts as rows, of which the first owner brings the text."""
            nonlocal seen
            key, seen = base + seen, seen + 1
            sha, best = hashlib.sha256(text).hexdigest(), _owner(held, largest)
            for x in held:
                yield (x[0], key, x is best, len(held), len(text), sha, text if x is best else None)

        for batch in batches:
            for part in small_batches(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    held = trie.put(text or b"", (doc_id,))
                    if held is not None and len(held) >= most_held:
                        yield from _batches(copies(text or b"", held), LOCAL)
                        trie.empty(held)
        yield from _batches((row for text, held in trie.items() for row in copies(text, held)), LOCAL)
        trim()

    return run


OWNERS = pa.schema([("copy_key", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("owner_key", pa.int64())])


def _owners(largest: bool, budget: int):
    def run(batches):
        trie = PatriciaTrie(budget)
        for batch in batches:
            for doc_id, key, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.put(text, (doc_id, key, n))
            del batch

        def rows():
            for _, held in trie.items():
                best, total = _owner(held, largest), sum(x[2] for x in held)
                for x in held:
                    yield (x[1], best[0], total, best[1])

        yield from _batches(rows(), OWNERS)
        trim()

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = 192 << 20, part_bytes: int = 32 << 20, most_held: int = 4096) -> DataFrame:
    """Groups of equal texts: a row per input row with doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group stays. A null text counts as empty, so nulls and empty texts are one
    group. A null id loses against any other; of rows that repeat the kept id one stays; in a group with null ids
    only, keep_id is null and one row stays. An empty table gives no rows. Texts are dealt to partitions of about
    part_bytes; a trie that outgrows trie_bytes spills, and most_held copies of a text go on before more are taken. Other
    columns of docs are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    largest = keep == "largest"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = written(rows.mapInArrow(_local(largest, trie_bytes, most_held), "doc_id long, copy_key long, is_first boolean, n long, n_bytes long, text_sha256 string, text binary"))
    distinct = local.where("text is not null")
    with cleaned(docs.sparkSession):
        size = distinct.agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(max(1, min(1 << 17, size // part_bytes)))
    dealt = distinct.repartition(parts, F.col("n_bytes"), F.substring("text_sha256", 1, 16)).select("doc_id", "copy_key", "n", "text")
    owners = dealt.mapInArrow(_owners(largest, trie_bytes), "copy_key long, keep_id long, group_size long, owner_key long")
    return local.select("doc_id", "copy_key", "is_first", "text_sha256").join(owners, "copy_key").select("doc_id", "keep_id", "group_size", (F.col("is_first") & (F.col("copy_key") == F.col("owner_key"))).alias("kept"), "text_sha256")
