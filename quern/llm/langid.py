"""Language identification by language-bitmask n-gram filters (operator 6).

An n-gram is known to a language if it is about as frequent there as anywhere. All languages share one bit-sliced
Bloom filter: every slot holds a mask with a bit per language, in as many bytes as the languages need, and the AND of an
n-gram's slots gives all languages that contain it. A text's score for a language is the share of its n-grams that the language contains, corrected for
the share that the filter would claim by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import byte_lengths, cleaned, small_batches, trim

ORDERS = (2, 3, 4, 5)
CHUNK = 1 << 20  # bytes whose n-grams are looked up at a time, however long a text is
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = r"[^\p{L}\p{M}']+"


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case, with every run of other characters than letters as one space, and a space on either side."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_LETTERS, " ")
    return pc.binary_join_element_wise("", pc.utf8_trim(plain, " "), "", " ")


def hashed_grams(flat: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from every position of flat; n at most 8, so the bytes themselves are the key."""
    size = max(0, len(flat) - n + 1)
    key = np.zeros(size, np.uint64)
    for k in range(n):
        key <<= np.uint64(8)
        key |= flat[k : k + size]
    key += np.uint64(n)
    key *= MULTIPLIER
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all normalised texts, where each starts, its length)."""
    joined = normalised(texts)
    lengths = byte_lengths(joined)
    return np.frombuffer(b"".join(joined.cast(pa.binary()).to_pylist()), np.uint8), np.cumsum(lengths) - lengths, lengths


class Filters:
    """The bit-sliced filter: `masks[slot]` has a bit per language, `probes` slots an n-gram."""

    def __init__(self, languages: list[str], bits: int, probes: int = 2):
        self.languages, self.bits, self.probes = languages, bits, probes
        self.masks = np.zeros((1 << bits, max(1, -(-len(languages) // 8))), np.uint8)

    def slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits * (probe + 1)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, members: np.ndarray) -> None:
        """members: n-grams by languages, whether the language contains the n-gram."""
        masks = np.packbits(members, axis=1, bitorder="little")
        for p in range(self.probes):
            np.bitwise_or.at(self.masks, self.slots(keys, p), masks)

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """Mask of the languages that contain each n-gram."""
        found = self.masks[self.slots(keys, 0)]
        for p in range(1, self.probes):
            found &= self.masks[self.slots(keys, p)]
        return found

    def _bit(self, masks: np.ndarray, language: int) -> np.ndarray:
        return masks[:, language >> 3] >> np.uint8(language & 7) & np.uint8(1)

    def chance(self) -> np.ndarray:
        """For each language, how often the filter claims an n-gram that was never added."""
        return np.array([self._bit(self.masks, b).mean() for b in range(len(self.languages))]) ** self.probes

    def shares(self, texts: pa.Array) -> np.ndarray:
        """Corrected share of each text's n-grams that each language contains: texts by languages."""
        flat, starts, lengths = laid_out(texts)
        counts, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for n in ORDERS:
            ends = starts + np.maximum(lengths - n + 1, 0)  # of the n-grams of each text; none crosses to the next
            total += ends - starts
            for at in range(0, len(flat), CHUNK):
                found = self.containing(hashed_grams(flat[at : at + CHUNK + n - 1], n))
                a, b = (np.clip(x - at, 0, len(found)) for x in (starts, ends))
                for k in range(len(self.languages)):
                    done = np.concatenate([[0], np.cumsum(self._bit(found, k), dtype=np.int64)])
                    counts[:, k] += done[b] - done[a]
        share, chance = counts / np.maximum(total, 1)[:, None], self.chance()
        return np.clip((share - chance) / np.maximum(1 - chance, 1e-9), 0, 1)


COUNTED = pa.schema([("gram", pa.int64()), ("lang", pa.string()), ("texts", pa.int64()), ("n", pa.int64())])


def _count(batches):
    """(n-gram, language, texts, occurrences) of the texts of each batch."""
    for batch in batches:
        for part in small_batches(batch, "text"):
            langs, code = np.unique(np.array(part.column("lang").to_pylist(), dtype=object), return_inverse=True)
            flat, starts, lengths = laid_out(part.column("text"))
            keys, of, counts = [], [], []
            for i, (a, size) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                for n in ORDERS:
                    k, c = np.unique(hashed_grams(flat[a : a + size], n), return_counts=True)
                    keys.append(k)
                    of.append(np.full(len(k), code[i]))
                    counts.append(c)
            keys, of, counts = np.concatenate(keys), np.concatenate(of), np.concatenate(counts)
            if not len(keys):
                continue
            order = np.lexsort((keys, of))
            keys, of, counts = keys[order], of[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]))
            texts = np.diff(np.append(first, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys[first].view(np.int64), langs[of[first]].tolist(), texts, np.add.reduceat(counts, first)), COUNTED.types, strict=True)], schema=COUNTED)
    trim()


def fit(labelled: DataFrame, text_col: str, lang_col: str, key_col: str, sample_rows: int = 4000, most_grams: int = 400_000, bits: int = 21, ratio: float = 0.35) -> Filters:
    """Filters learned from a bounded sample of whole labelled texts, the same number for every language.

    Of L languages each gives sample_rows / L rows (100 at least): those with the smallest hash of key and text. Of its
    n-grams, those in three texts or more (fewer where a language has under 20 texts: one, and one more for each ten)
    can be learned, the most_grams / L (5,000 at least) most frequent are. An n-gram is a language's if its rate there is
    at least `ratio` of its best rate. So every labelled language is learned at every size of the corpus, be it from one
    row, and what comes to the driver grows with the number of languages only.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(key_col, text_col).alias("h")).where("text is not null and lang is not null")
    with cleaned(rows.sparkSession):
        there = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(there)
    filters = Filters(languages, bits)
    if not languages:
        return filters
    quota, top = max(100, sample_rows // len(languages)), max(5_000, most_grams // len(languages))
    by_lang = lambda f, kind: F.create_map(*[F.lit(x) for k in languages for x in (k, f(there[k]))])[F.col("lang")].cast(kind)
    # hashes below a bound that somewhat more than the quota pass; only those are ordered, so no task gets more
    bound = by_lang(lambda n: min(int(min(1.0, 1.2 * (quota + 50) / n) * 2**63), 2**63 - 1), "long")
    ranked = Window.partitionBy("lang").orderBy("h", "text")
    sample = rows.where(F.shiftrightunsigned("h", 1) <= bound).withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= quota).select("text", "lang")
    counted = sample.repartition(8, "text").mapInArrow(_count, "gram long, lang string, texts long, n long").groupBy("gram", "lang").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n"))
    enough = F.col("texts") >= by_lang(lambda n: min(3, 1 + min(n, quota) // 10), "long")
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    kept = counted.where(enough).withColumn("k", F.row_number().over(best)).where(F.col("k") <= top).select("gram").distinct()
    with cleaned(rows.sparkSession):
        table = counted.join(kept, "gram", "left_semi").select("gram", "lang", "n").toArrow()
    keys, at = np.unique(table.column("gram").to_numpy(), return_inverse=True)
    number = {k: i for i, k in enumerate(languages)}
    n = np.zeros((len(keys), len(languages)))
    n[at, np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)] = table.column("n").to_numpy()
    rate = n / np.maximum(n.sum(0), 1)
    filters.add(keys.view(np.uint64), (rate > 0) & (rate >= ratio * rate.max(1, keepdims=True, initial=0)))
    return filters


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and its score, the corrected share from 0 to 1, of each whole text.

    `und` with score 0 for a null text, one without a letter, or when no row was labelled; ties, and texts of which no
    language knows anything, go to the first language by name. Other columns pass through unchanged; those named like the
    two new ones are replaced.
    """
    docs = docs.drop(lang_name, score_name)
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)  # 2**bits slots of a bit per language, whatever the input

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in small_batches(batch, text_col, 1 << 20):
                texts = part.column(text_col)
                if known.languages:
                    share = known.shares(texts)
                    best = share.argmax(1)
                    score = share[np.arange(len(best)), best]
                    names = [known.languages[b] for b in best]
                else:
                    score, names = np.zeros(part.num_rows), ["und"] * part.num_rows
                for i, t in enumerate(texts.to_pylist()):
                    if t is None or not LETTER.search(t):
                        names[i], score[i] = "und", 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], names=[*part.schema.names, lang_name, score_name])
        trim()

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score; learned from the rows that are not held out.

    A null id counts as held out. Rows that repeat an id each get a row. Without labelled rows all is `und`. Only the
    text is an input of a prediction; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = F.coalesce(held_out("doc_id"), F.lit(True))
    filters = fit(rows.where(~out), "text", "lang", "doc_id", sample_rows)
    return predict(rows.select("doc_id", "text", out.alias("held_out")), filters).select("doc_id", "held_out", "lang_pred", "score")
