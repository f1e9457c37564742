"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by how often a text has them times ln(1 + N / df), where df of N texts have the word (counted over
all rows, by BUCKETS hashes of words). For each of SAMPLES draws k and each term, independent numbers follow from hashes of
(term, k): r and c, Gamma(2, 1), and b, uniform. With t = floor(ln w / r + b), the draw picks the term of smallest
ln c - r (1 + t - b), and the pair (term, t) is the sample. Two texts agree in a draw with a probability equal to their
generalised Jaccard similarity, the sum of smaller over the sum of larger weights; with 256 draws the share of agreeing
draws has a standard deviation of 0.031 at most. What a draw makes of a term is kept for the terms that come again.

A fingerprint is SAMPLES 16-bit marks as hex digits; the likeness of two is the share of equal marks.

Defined results: null texts count as empty; texts without words have the mark 0000 throughout, equal to each other's and to
no other text's; equal texts have equal fingerprints; rows of equal id follow one another by the hash of their text, then by
the text; rows with a null id come first; a lone document is its own next one; no rows give no rows; ``compare`` takes ids
of integer types only and says so else; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import map_rows, only, slices, trim

SAMPLES = 256
SEED = 2010
BUCKETS = 1 << 17
#: Terms (word, times in a text) whose draws a task keeps: SAMPLES * 4 bytes each.
KEPT = 1 << 16
#: Terms of one text that are looked at together.
PART = 1 << 12
#: Terms whose draws are made together: the numbers in between stay in the processor's cache.
BLOCK = 64
#: Parts by id are cut at quantiles, at most so many; each is cut evenly beyond that.
QUANTILES = 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sampler:
    """inverse: ln(1 + N / df) of each bucket of words; all words weigh alike without it.

    Each (term, draw) has a 64-bit hash, the term's under the draw's key. Its four parts make r and c: Gamma(2, 1) is minus ln
    of the product of two uniform numbers, for which parts of two draws' hashes meet, each part once. b comes from a sum of
    the halves, one of them multiplied.
    """

    def __init__(self, inverse: np.ndarray | None = None, samples: int = SAMPLES, seed: int = SEED):
        self.inverse, self.samples, self.seed = inverse, samples, seed
        self.keys = np.random.default_rng(seed).integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.step = (np.arange(samples, dtype=np.uint64) + np.uint64(1)) * _GOLDEN
        # a term's row is that of its key; PART rows more are for terms whose row another one of the same texts has
        self.values = np.empty((KEPT + PART, samples), np.float32)
        self.hashes, self.ln_w = np.empty(KEPT + PART, np.uint64), np.empty(KEPT + PART, np.float32)
        #: key of the term in each row (at first one of another row); when each row was last asked for, and for which new term
        self.keys_in = np.arange(1, KEPT + 1, dtype=np.uint64)
        self.asked, self.now, self.taker = np.zeros(KEPT, np.int64), 0, np.empty(KEPT, np.int64)
        # keys of the hashes whose parts make each draw's r, and of its own; how far each part is shifted
        draw = self._draw = np.arange(samples)
        self._eight = np.arange(8)[:, None]
        self._whose = self.keys[np.stack([draw // 4, (draw + 2 * samples) // 4, draw])]
        self._shift = (16 * np.stack([draw % 4, (draw + 2 * samples) % 4])).astype(np.uint64)
        self._room = self._rooms(BLOCK)

    def _rooms(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the hashes, their parts and their halves of n terms go."""
        return np.empty((2, n, self.samples), np.uint64), np.empty((2, n, 2 * self.samples), np.float32), np.empty((2, n, self.samples), np.uint32)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, itertools.repeat(self.seed))), ">u8").astype(np.uint64)

    def _ln_weights(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        if self.inverse is not None:
            times = times * self.inverse[np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS]
        return np.log(times).astype(np.float32)

    def draws(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, c and b of each term and draw; r and c of up to BLOCK terms stay until the next call."""
        n, half = len(h), 2 * self.samples
        (x, high), (u, v), (low32, high32) = (room[:, :n] for room in (self._room if n <= BLOCK else self._rooms(n)))
        np.multiply(h[:, None], self.keys, out=x)
        np.right_shift(x, np.uint64(32), out=high)
        x ^= high
        parts = x.view(np.uint16)
        np.copyto(u, parts[:, :half])
        np.copyto(v, parts[:, half:])
        u += np.float32(0.5)
        v += np.float32(0.5)
        u *= v
        np.log(u, out=u)
        np.subtract(np.float32(32 * np.log(2)), u, out=u)
        # evenly spread whatever either half of a hash is, since the other one is
        np.copyto(low32, x, casting="unsafe")
        np.copyto(high32, high, casting="unsafe")
        low32 *= np.uint32(0x9E3779B1)
        low32 += high32
        b = low32.astype(np.float32)
        b *= np.float32(2.0**-32)
        return u[:, : self.samples], u[:, self.samples :], b

    def samples_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word, had once, its hash, and for each draw ln c - r (1 + t - b) and t."""
        h = self._hashes(words)
        return h, *self._values(h, self._ln_weights(words, np.ones(len(words))))

    def _values(self, h: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, c, b = self.draws(h)
        t = np.divide(ln_w[:, None], r)
        t += b
        np.floor(t, out=t)
        b -= t
        b -= np.float32(1)
        b *= r  # -r (1 + t - b)
        np.log(c, out=c)
        b += c
        return b, t

    def _levels(self, h: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
        """t of one term for each text and draw, as ``samples_of`` has it: made again, as that takes less than to keep them."""
        x = h[:, None] * self._whose
        x ^= x >> np.uint64(32)
        u = (x[:, :2] >> self._shift & np.uint64(0xFFFF)).astype(np.float32)
        u += np.float32(0.5)
        r = np.float32(32 * np.log(2)) - np.log(u[:, 0] * u[:, 1])
        b = (x[:, 2].astype(np.uint32) * np.uint32(0x9E3779B1) + (x[:, 2] >> np.uint64(32)).astype(np.uint32)).astype(np.float32)
        b *= np.float32(2.0**-32)
        return np.floor(ln_w / r + b)

    def _places(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Rows of ``values`` that hold these terms, at most PART of them; terms may repeat. They hold until the next call."""
        h = self._hashes(words)
        keys = h + (times - 1).astype(np.uint64) * _GOLDEN
        at = (keys % np.uint64(KEPT)).astype(np.int64)
        there = self.keys_in[at] == keys
        self.now += 1
        self.asked[at[there]] = self.now
        missing = np.flatnonzero(~there)
        if len(missing):
            new, rows, order = keys[missing], at[missing], np.arange(len(missing))
            self.taker[rows] = order
            taker = self.taker[rows]
            fits = (new[taker] == new) & (self.asked[rows] < self.now)
            made = np.flatnonzero(fits & (taker == order))
            rows = rows[made]
            self.keys_in[rows] = new[made]
            if not fits.all():
                rest = np.flatnonzero(~fits)
                _, first, which = np.unique(new[rest], return_index=True, return_inverse=True)
                at[missing[rest]] = KEPT + which
                made, rows = np.append(made, rest[first]), np.append(rows, KEPT + np.arange(len(first)))
            made = missing[made]
            h, ln_w = h[made], self._ln_weights([words[k] for k in made.tolist()], times[made])
            self.hashes[rows], self.ln_w[rows] = h, ln_w
            for start in range(0, len(rows), BLOCK):
                some = slice(start, start + BLOCK)
                self.values[rows[some]] = self._values(h[some], ln_w[some])[0]
        return at

    def _least(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest value of each draw and its first row: by groups of eight rows, as argmin over all is slow this way round."""
        n = len(values)
        whole = n // 8 * 8
        groups = values[:whole].reshape(-1, 8, self.samples).min(axis=1)
        if whole < n:
            groups = np.concatenate([groups, values[whole:].min(axis=0)[None]])
        rows = np.minimum(8 * groups.argmin(axis=0) + self._eight, n - 1)
        few = values[rows, self._draw]
        one = few.argmin(axis=0)
        return few[one, self._draw], rows[one, self._draw]

    def marks_of(self, texts: list[list[bytes]]) -> np.ndarray:
        """For each text, given as its words, its samples as 16-bit marks; 0 where there are no words."""
        parts = []
        for k, words in enumerate(texts):
            counted = Counter(words)
            words, times = list(counted), list(counted.values())
            parts += [(k, words[start : start + PART], times[start : start + PART]) for start in range(0, len(words), PART)]
        best = np.full((len(texts), self.samples), np.inf, np.float32)
        h, ln_w = np.zeros(best.shape, np.uint64), np.zeros(best.shape, np.float32)
        while parts:
            # as many as can be looked at together
            ends = list(itertools.accumulate(len(words) for _, words, _ in parts))
            n = max(1, sum(end <= PART for end in ends))
            some, parts = parts[:n], parts[n:]
            places = self._places([w for _, words, _ in some for w in words], np.array([n for _, _, times in some for n in times], np.int64))
            for (k, words, _), end in zip(some, ends, strict=False):
                at = places[end - len(words) : end]
                low, least = self._least(self.values[at])
                at = at[least]
                new = low < best[k]
                if new.all():
                    new = slice(None)
                best[k, new], h[k, new], ln_w[k, new] = low[new], self.hashes[at[new]], self.ln_w[at[new]]
        # the pair of term and t that each draw picks, as a mark
        level = self._levels(h, ln_w).astype(np.int64).astype(np.uint64)
        mark = np.maximum(_mixed(h + level * _GOLDEN ^ self.step) >> np.uint64(48), 1)
        mark[np.isinf(best)] = 0
        return mark.astype(np.uint16)

    def marks(self, words: list[bytes]) -> np.ndarray:
        return self.marks_of([words])[0]

    def of(self, text: str | None) -> np.ndarray:
        return self.marks(split(text))


def as_hex(marks: np.ndarray) -> str:
    return marks.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b) / len(a))


def edited(text: str, after: str) -> str:
    """The last half of the text replaced by as many first characters of the next one, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def inverse_frequency(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """ln(1 + N / df) for each bucket of words, over all rows. A task counts BUCKETS numbers, and as many reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(BUCKETS, np.int64), 0
        crc = zlib.crc32
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    count[np.array([crc(w) for w in set(split(text))], np.int64) % BUCKETS] += 1
                    rows += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(count[at], rows))], names=["bucket", "n"])
        trim()

    counted = docs.select(F.col(text_col)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    rows = max(int(n[at < 0].sum()), 1)
    out = np.full(BUCKETS, np.log1p(rows))
    out[at[at >= 0]] = np.log1p(rows / n[at >= 0])
    return out


def _parts(docs: DataFrame) -> F.Column:
    """The part of (doc_id, h), in their order: ranges of ids between quantiles; rows of one id, or without one, that fill
    several ranges are parted by h, the hash of their text."""
    wanted = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = min(wanted, QUANTILES)
    told = docs.agg(F.percentile_approx("doc_id", [k / m for k in range(m + 1)], 20_000).alias("q"), F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    by_hash = lambda n: F.floor(F.shiftrightunsigned("h", 11).cast("double") * F.lit(2.0**-53) * n).cast("int")
    nulls = -(-m * (told["all"] - told["n"]) // max(told["all"], 1))
    null_part = by_hash(F.lit(nulls)) if nulls > 1 else F.lit(0)
    many = Counter(int(q) for q in told["q"] or [])
    if not many:
        return null_part
    edges, sub = sorted(many), -(-wanted // m)
    #: parts before the one of each edge: ``many - 1`` for the edge's own rows, then ``sub`` up to the next edge
    first, at = [], nulls
    for e in edges:
        first.append(at)
        at += (many[e] if many[e] > 1 else 0) + sub
    array = lambda values, kind="long": F.array(*[F.lit(v).cast(kind) for v in values])
    k = F.greatest(F.size(F.filter(array(edges), lambda e: e <= F.col("doc_id"))), F.lit(1))
    edge, after = F.element_at(array(edges), k), F.element_at(array([*edges[1:], edges[-1] + 1]), k)
    own = F.element_at(array([many[e] if many[e] > 1 else 0 for e in edges]), k)
    even = F.least(F.lit(sub - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - edge).cast("double") * sub / F.greatest(after - edge, F.lit(1)))))
    within = F.when((F.col("doc_id") <= edge) & (own > 0), by_hash(own)).otherwise(own + even)
    return F.when(F.col("doc_id").isNull(), null_part).otherwise(F.element_at(array(first), k) + within)


def _parted(docs: DataFrame) -> DataFrame:
    """Rows (part, copy, doc_id, text): parts follow the order of rows, and the first row of a part also goes, as a copy, to
    the part before it (that of the first part to the last), so that each row's next one is in its own part."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # unsigned order of h is the order of its top bits, by which rows are parted
    parted = hashed.select(_parts(hashed).cast("int").alias("part"), "doc_id", F.col("h").bitwiseXOR(F.lit(-(2**63))).alias("h"), "text")
    # a row for each part: four times the shuffle partitions and as many for repeated ids, at most
    first = sorted((r["part"], r["m"]["doc_id"], r["m"]["h"]) for r in parted.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("m")).collect())
    before = [(d, h, first[k - 1][0]) for k, (_, d, h) in enumerate(first)]
    sent = F.broadcast(docs.sparkSession.createDataFrame(before, "f_id long, f_h long, to_part int"))
    both = parted.join(sent, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("copy"))
    other = F.struct(F.col("to_part").alias("part"), F.lit(1).alias("copy"))
    rows = both.select(F.explode(F.when(F.col("to_part").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("to"), "doc_id", "h", "text")
    return rows.select("to.part", "to.copy", "doc_id", "h", "text").repartition("part").sortWithinPartitions("part", "copy", "doc_id", "h", "text").select("part", "copy", "doc_id", "text")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col}: ids must be integers, which have a next one")
    own = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    inverse = docs.sparkSession.sparkContext.broadcast(inverse_frequency(own))  # BUCKETS numbers, whatever the input
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _parted(own).mapInArrow(lambda batches: _compare(batches, Sampler(inverse.value)), schema)


def _compare(batches: Iterator[pa.RecordBatch], sampler: Sampler) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    held = None  # (part, doc_id, text, marks) that waits for its next one
    rows = []
    # long texts: at most a few MB of Python objects at once
    pieces = (piece for batch in batches for piece in slices(batch))
    for piece in pieces:
        for part, copy, doc_id, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
            if copy and (held is None or held[0] != part):
                continue  # a further copy: the first has answered
            if held is None or held[0] != part:
                new = sampler.of(text)
            else:
                _, own_id, own_text, own = held
                mixed = edited(own_text, text)
                new, other = sampler.marks_of([split(text), split(mixed)])
                rows.append((own_id, len(own_text), hashlib.sha256(mixed.encode("utf-8", "replace")).hexdigest(), as_hex(own), as_hex(other), likeness(own, other), likeness(own, new)))
                if len(rows) >= 500:
                    yield made(rows)
                    rows = []
            held = None if copy else (part, doc_id, text, new)
    if rows:
        yield made(rows)
    trim()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, inverse: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint of every whole text, where it lies: the plain operator."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        s = Sampler(inverse, samples)
        return lambda b: {"doc_id": b["doc_id"], "fingerprint": [as_hex(s.of(t)) for t in b["text"]]}

    return map_rows(only(docs, doc_id=id_col, text=text_col), f"doc_id {kind}, fingerprint string", make)
