"""Line dedup by a log-template tree (operator 5).

Lines are parsed by a tree of fixed depth: token count, then leading tokens, with variable tokens masked. In a leaf a
line joins the template that it shares at least 80 % of its positions with, and positions that differ become variable;
otherwise it founds a template. Templates that recur across documents are dropped from all documents but the first.

Only hashes travel for most lines: equal masked lines are counted first, and only lines of leaves that could hold a
recurring template of several lines are read again, once each. Which leaves those are travels as a bit array of fixed
size that leaves none out. The tree has the same depth at every size; in a leaf only templates that share a block of
positions are compared.
"""

from __future__ import annotations

import re
from itertools import combinations, pairwise
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_key, cleaned, discard, small_batches, trim, written

MASK = "<*>"
VARIABLE = re.compile(r"[0-9@]|://")
MIN_TOKENS = 3
MIN_DOCS = 3
DEPTH = 3
SIMILARITY = 0.8
LEAF_BITS = 24  # the bit array of leaves has 2 ** 24 bits, 2 MB, at every size


def masked(line: str) -> list[str]:
    """Tokens of a line; those with digits, addresses or links are variable."""
    tokens = line.split()
    return [MASK if VARIABLE.search(t) else t for t in tokens] if VARIABLE.search(line) else tokens


def _hash(tokens: list[str], count: int) -> int:
    return xxhash.xxh64_intdigest(f"{count} {' '.join(tokens)}".encode(), 5) - (1 << 63)


def line_key(tokens: list[str]) -> int:
    return _hash(tokens, len(tokens))


class TemplateTree:
    """The templates of one leaf, all of one token count, of which the first `lead` tokens are equal.

    A line that shares enough positions with a template differs from it in at most d of the others. Those are cut into
    d + 1 blocks, one of which must be equal (or d + 2, two of which must be), so only templates with such a block, as
    they now stand, are compared. That leaves out none that the line could join.
    """

    def __init__(self, similarity: float = SIMILARITY, lead: int = DEPTH):
        self.similarity, self.lead, self.templates = similarity, lead, []
        self.by_block: dict[int, list[int]] = {}
        self.parts: list[tuple[slice, ...]] | None = None

    def _cut(self, n: int) -> None:
        self.least = next((m for m in range(n + 1) if m >= self.similarity * n), n + 1)
        d, free, self.parts = n - self.least, n - self.lead, []
        if free <= max(d, 0):
            return
        agree = 2 if d <= 2 and free >= d + 2 else 1
        cuts = [self.lead + round(free * k / (d + agree)) for k in range(d + agree + 1)]
        self.parts = list(combinations([slice(x, y) for x, y in pairwise(cuts)], agree))

    def _blocks(self, tokens: list[str]) -> list[int]:
        return [hash((k, *(tuple(tokens[s]) for s in part))) for k, part in enumerate(self.parts)]

    def put(self, tokens: list[str]) -> int:
        """Number of the template that takes the line; the most similar, then the oldest."""
        if self.parts is None:
            self._cut(len(tokens))
        blocks = self._blocks(tokens)
        near = {t for b in blocks for t in self.by_block.get(b, ())} if self.parts else range(len(self.templates))
        best, most = -1, 0
        for t in near:
            # a position that is variable in both is counted with the others; the line is compared with the founder's fixed positions
            count = sum(map(eq, tokens, self.templates[t]))
            if count > most or count == most and t < best:
                best, most = t, count
        if best >= 0 and most >= self.least:
            template = self.templates[best]
            merged = [a if a == b else MASK for a, b in zip(template, tokens, strict=True)]
            if merged != template:
                for old, new in zip(self._blocks(template), self._blocks(merged), strict=True):
                    if old != new:
                        self.by_block[old].remove(best)
                        if not self.by_block[old]:
                            del self.by_block[old]
                        self.by_block.setdefault(new, []).append(best)
                self.templates[best] = merged
            return best
        number = len(self.templates)
        self.templates.append(list(tokens))
        for b in blocks:
            self.by_block.setdefault(b, []).append(number)
        return number


def leaf_key(tokens: list[str]) -> int:
    return _hash(tokens[:DEPTH], len(tokens))


LINES = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("leaf", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _lines(min_tokens: int):
    """Each document's distinct masked lines of enough tokens, as hashes."""

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    seen = set()
                    for line in (text or "").split("\n"):
                        tokens = masked(line)
                        if len(tokens) < min_tokens or (key := line_key(tokens)) in seen:
                            continue
                        seen.add(key)
                        rows.append((doc_id, key, leaf_key(tokens)))
                if rows:
                    yield _rows(rows, LINES)
        trim()

    return run


class Leaves:
    """A bit for each slot of leaf hashes; a set bit may stand for other leaves too, a clear one for none that is wanted."""

    def __init__(self, wanted: DataFrame, bits: int):
        self.slots = (1 << bits) - 1
        slot = F.col("leaf").bitwiseAND(self.slots)
        words = wanted.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, CAST(leaf & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        with cleaned(wanted.sparkSession):
            found = words.toArrow()  # 2 ** (bits - 6) rows at most
        self.bits = np.zeros((self.slots >> 6) + 1, np.int64)
        self.bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    def __contains__(self, leaf: int) -> bool:
        return bool(int(self.bits[(leaf & self.slots) >> 6]) >> (leaf & 63) & 1)


TEXTS = pa.schema([("line", pa.int64()), ("tokens", pa.string())])


def _texts(min_tokens: int, shared):
    """Masked lines of the leaves that are wanted, each once a batch."""

    def run(batches):
        leaves = shared.value
        for batch in batches:
            for part in small_batches(batch, "text"):
                rows = {}
                for text in part.column("text").to_pylist():
                    for line in (text or "").split("\n"):
                        tokens = masked(line)
                        if len(tokens) >= min_tokens and leaf_key(tokens) in leaves:
                            rows[line_key(tokens)] = " ".join(tokens)
                if rows:
                    yield _rows(list(rows.items()), TEXTS)
        trim()

    return run


def _templates(similarity: float):
    """Templates of leaves that arrive sorted: (leaf, line, tokens) to (line, template)."""

    def run(batches):
        leaf, tree, head = None, None, 0
        for batch in batches:
            out_line, out_template = [], []
            for key, line, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != leaf:
                    leaf, tree, head = key, TemplateTree(similarity), []
                number = tree.put(tokens.split(" "))
                if number == len(head):
                    head.append(line)
                out_line.append(line)
                out_template.append(head[number])
            yield pa.RecordBatch.from_arrays([pa.array(out_line, pa.int64()), pa.array(out_template, pa.int64())], names=["line", "template"])

    return run


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """(doc_id, line): masked lines to drop from each document of (doc_id, text)."""
    spark = docs.sparkSession
    lines = written(docs.mapInArrow(_lines(min_tokens), "doc_id long, line long, leaf long"))
    counts = written(lines.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    # a leaf with a single line is its own template, and one whose lines occur too rarely has none that recurs
    leaves = counts.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") > 1) & (F.col("n") >= min_docs))
    wanted = written(counts.join(leaves.select("leaf"), "leaf").select("leaf", "line", "n"))
    shared = spark.sparkContext.broadcast(Leaves(wanted, leaf_bits))
    texts = docs.mapInArrow(_texts(min_tokens, shared), "line long, tokens string").groupBy("line").agg(F.min("tokens").alias("tokens"))
    with cleaned(spark):
        rows = wanted.count()
    ordered = by_key(texts.join(wanted, "line"), rows, "leaf").sortWithinPartitions("leaf", F.col("n").desc(), "tokens").select("leaf", "line", "tokens")
    templates = written(ordered.mapInArrow(_templates(similarity), "line long, template long"))
    of_line = counts.join(templates, "line", "left").select("line", "n", "first", F.coalesce("template", "line").alias("template"))
    # n counts rows, so it is never below the number of documents: templates below min_docs rows need not be counted
    likely = of_line.groupBy("template").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_docs).drop("n")
    located = written(lines.select("doc_id", "line").join(of_line.select("line", "template").join(likely, "template"), "line"))
    # written, so that the join that follows can split a template that very many documents hold
    kept = written(located.select("template", "doc_id").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs))
    drops = written(located.where(F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first"))).join(kept.select("template"), "template").select("doc_id", "line").distinct())
    shared.unpersist()
    discard(lines, counts, wanted, templates, located, kept)
    return drops


def _kept(text: str | None, drop: set[int] | None) -> tuple[str | None, int, int]:
    """The text without dropped lines, its number of lines, and of those dropped."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not drop:
        return text, len(lines), 0
    kept = [x for x in lines if line_key(masked(x)) not in drop]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with text_col rid of recurring templates, and the columns n_lines and n_dropped.

    A template recurs if it is in at least min_docs (3) documents; the document with the smallest id keeps its lines.
    Lines end at a line feed. Lines of fewer than min_tokens (3) tokens stay. A null text stays null with no lines, an
    empty one has one line. Documents are told apart by their ids: rows that repeat an id are one document and are cleaned
    alike, and so are rows with a null id, which never keep a template that a row with an id has. An empty table gives no
    rows. Other columns pass through whatever their names; n_lines and n_dropped are replaced if they are there.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    drops = recurring(rows, **settings).groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_list("line").alias("drop_lines"))
    # what passes through has names of our own meanwhile, so none can clash
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    others = [(f"c{k}", c) for k, c in enumerate(names) if c != text_col]
    held = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in others], F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"))
    both = held.join(drops, F.col("id").eqNullSafe(F.col("drop_id")), "left").drop("id", "drop_id")
    schema = T.StructType([*[T.StructField(k, docs.schema[c].dataType) for k, c in others], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, "text"):
                found = [_kept(t, set(d) if d else None) for t, d in zip(part.column("text").to_pylist(), part.column("drop_lines").to_pylist(), strict=True)]
                texts, n, gone = zip(*found, strict=True)
                columns = [*part.columns[:-2], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
        trim()

    done = both.mapInArrow(run, schema)
    return done.select(*[F.col("text" if c == text_col else f"c{k}").alias(c) for k, c in enumerate(names)], "n_lines", "n_dropped")


def digests(docs: DataFrame, **settings) -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, kept_sha256 (of the kept text in UTF-8, null as empty)."""
    return clean(docs.select("doc_id", "text"), **settings).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
