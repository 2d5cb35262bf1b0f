"""Alignment of two tokenizers over a corpus: which ids of one end where ids of the other end, and how often.

Both encode a space and the text. Where a token of each ends, the text is cut into groups, and the two tokens that end
there are linked. Counts of linked id pairs are dense vectors over a minimal perfect hash of the distinct pairs:

1. Every task counts the pairs of its documents; partial counts are written to a table.
2. The distinct pairs come to the driver and are hashed. There are at most as many as the vocabularies allow
   (most_pairs): of two tokens that end together, one's bytes are the end of the other's.
3. Every task of the table adds its counts up in a vector indexed by the hash, keys verified, and the vectors are summed
   as a tree of FAN branches. One vector remains, from it the highest count of each B id.
4. Documents are aligned again and look their links' counts up, keys verified.

Words repeat, so texts are cut where neither tokenizer joins what stands on both sides, and each distinct chunk of a
task is aligned once, all new ones of a slice of documents at a time in arrays.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import ByteBpe, tokenizer_path
from .common import SLICE, remove, scratch, table

#: Distinct chunks that a task keeps before it starts anew.
CHUNKS = 250_000
#: Vectors that are summed at a time.
FAN = 16
SPACE = "▁"


class Pieces:
    """Ids of a sentence-piece file that adds a space before a text, and the bytes of its ids."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.of_id = [bytes([int(n[3:5], 16)]) if self._model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.of_id], np.int64)
        #: Whether no piece goes on after a space that stands behind something else, so that a text may be cut before spaces.
        self.cuts = not any(SPACE in n.lstrip(SPACE) for n in names)
        self._blank = self._model.encode("x ")[len(self._model.encode("x")) :]

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, each with the space that it begins with."""
        return [self._blank if not c else ids for c, ids in zip((c[1:] for c in chunks), self._model.encode([c[1:] for c in chunks], num_threads=1))]


_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_MEETS = re.compile(r"\s \s|  ")


class Aligner:
    """Both tokenizers, and what is known of the chunks met so far: ids, groups, links."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteBpe(a), Pieces(b)
        # what is written of a token: its id and what follows, by kind of place (within a group, at its end, at a chunk's end)
        self._names_a, self._names_b = (np.array([[f"{i}{e}" for i in range(len(t.sizes))] for e in ends], object) for t, ends in ((self.a, ",|"), (self.b, ",;\n")))
        self.clear()

    def clear(self) -> None:
        #: Number of each chunk; those that either tokenizer does not give back have none.
        self.number: dict[str, int] = {}
        self.broken: set[str] = set()
        self.links: list[np.ndarray] = []  # of all chunks, in their order
        self.facts: list[np.ndarray] = []  # n_a, n_b, n_links by chunk
        self.groups: list[str] = []

    def __len__(self) -> int:
        return len(self.number)

    def chunks(self, text: str) -> list[str]:
        """A space and the text, cut before spaces where no token of either goes across."""
        text = " " + text
        if not self.b.cuts:
            return [text]
        if _MEETS.search(text):
            return _BEFORE_SPACE.split(text)
        return [" " + w for w in text[1:].split(" ")]

    def learn(self, chunks: list[str], with_groups: bool) -> None:
        """Align chunks that are new."""
        leans = [c for c in chunks if self._leans(c)]
        if leans:
            chunks = [c for c in chunks if not self._leans(c)] + leans
        bodies = [c.encode() for c in chunks]
        ids_b = self.b.ids(chunks)
        broken = {c for c, body, ids in zip(chunks, bodies, ids_b) if b"".join(map(self.b.of_id.__getitem__, ids)) != body}
        self.broken |= broken
        if broken:
            kept = [i for i, c in enumerate(chunks) if c not in broken]
            chunks, bodies, ids_b = ([x[i] for i in kept] for x in (chunks, bodies, ids_b))
        if not chunks:
            return
        for c in chunks:
            self.number[c] = len(self.number)
        ends = np.cumsum([len(b) for b in bodies])
        a, b = self._ids_a(chunks, sum(c not in self.broken for c in leans)), np.fromiter(itertools.chain.from_iterable(ids_b), np.int64)
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        if ends_a[-1] != ends[-1]:
            raise ValueError("the byte-level tokenizer does not give texts back")
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
        chunk_a, chunk_b, chunk_link = (np.searchsorted(e, ends, "right") for e in (ends_a, ends_b, both))
        self.links.append((a[at_a] << 32) | b[at_b])
        self.facts.append(np.stack([np.diff(c, prepend=0) for c in (chunk_a, chunk_b, chunk_link)], axis=1))
        if with_groups:
            # of each group its A tokens, then its B tokens; every chunk ends with a group
            n_a, n_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
            kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            kind_a[at_a], kind_b[at_b] = 1, 1
            kind_b[at_b[chunk_link - 1]] = 2
            out = np.empty(len(a) + len(b), object)
            out[np.arange(len(a)) + np.repeat(at_b + 1 - n_b, n_a)] = self._names_a[kind_a, a]
            out[np.arange(len(b)) + np.repeat(at_a + 1, n_b)] = self._names_b[kind_b, b]
            self.groups += "".join(out.tolist()).split("\n")[:-1]

    @staticmethod
    def _leans(chunk: str) -> bool:
        """Whether white space at an end may be read together with what stands beside the chunk."""
        return chunk[1:2].isspace() or chunk[-1:].isspace()

    def _ids_a(self, chunks: list[str], leaning: int) -> np.ndarray:
        """Ids of chunks one after the other; those that do not lean come first and are encoded as one text."""
        apart = len(chunks) - leaning
        return np.concatenate([self.a.whole("".join(chunks[:apart])), *map(self.a.whole, chunks[apart:])]).astype(np.int64)

    def numbers(self, texts: list[str | None], with_groups: bool = False) -> Iterator[np.ndarray | None]:
        """The chunks' numbers of every text; None for one that has no tokens: null, empty, or not given back."""
        cut = [self.chunks(t) if t else None for t in texts]
        new = set(itertools.chain.from_iterable(c for c in cut if c)) - self.number.keys() - self.broken
        if new:
            self.learn(sorted(new), with_groups)
        for c in cut:
            yield None if c is None or self.broken and not self.broken.isdisjoint(c) else np.fromiter(map(self.number.__getitem__, c), np.int64, len(c))

    def counts(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and how often they are linked, chunk i standing weights[i] times in the corpus."""
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        per_link = np.repeat(weights, np.concatenate(self.facts)[:, 2])
        keys, where = np.unique(np.concatenate(self.links), return_inverse=True)
        return keys, np.bincount(where, per_link, len(keys)).astype(np.int64)


def most_pairs(a: str, b: str) -> int:
    """How many pairs of ids can be linked at all: pairs of which one's bytes end the other's."""
    left, right = ByteBpe(a), Pieces(b)
    of_a = [left.bytes_of(np.array([i])) for i in range(len(left.sizes))]
    ends: dict[bytes, list[int]] = {}  # of every ending of a token: tokens of A and of B that are it, and that go on
    for k, tokens in enumerate((of_a, right.of_id)):
        for t in tokens:
            for i in range(len(t)):
                ends.setdefault(t[i:], [0, 0, 0, 0])[2 * (i > 0) + k] += 1
    return sum(n[0] * n[1] + n[0] * n[3] + n[2] * n[1] for n in ends.values())


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 well mixed bits of each key, others at every level."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, by levels of bit arrays.

    At each level the keys that are left are hashed into twice as many places; who is alone in a place is settled, the
    others go on. A key's index is the number of settled places before its own. keys holds each index's key, so that a
    key that was never hashed is told apart.
    """

    def __init__(self, keys: np.ndarray):
        keys = left = np.asarray(keys, np.int64)
        self._levels, before = [], 0
        while len(left):
            size = 2 * len(left) + 1
            at = self._places(left, len(self._levels), size)
            alone = np.bincount(at, minlength=-(-size // 64) * 64) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            settled = np.bitwise_count(words).astype(np.int64)
            self._levels.append((words, before + np.cumsum(settled) - settled, size))
            before += int(settled.sum())
            left = left[~alone[at]]
        self.keys = np.zeros(before, np.int64)
        self.keys[self._index(keys)] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(keys, level) % np.uint64(size)).astype(np.int64)

    def _index(self, keys: np.ndarray) -> np.ndarray:
        index, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks, size) in enumerate(self._levels):
            at = self._places(keys[left], level, size)
            word, bit = words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = word & bit != 0
            index[left[hit]] = (ranks[at >> 6] + np.bitwise_count(word & (bit - np.uint64(1))))[hit]
            left = left[~hit]
        return index

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key; KeyError if one is none of those hashed."""
        index = self._index(np.asarray(keys, np.int64))
        if len(index) and (index.min() < 0 or not np.array_equal(self.keys[index], keys)):
            raise KeyError("a pair that was not counted")
        return index


def _partial_counts(docs: DataFrame, text: str, a: str, b: str) -> DataFrame:
    """pair, n: counts of linked pairs, a row for each pair and task (or part of one)."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, weights = Aligner(a, b), np.zeros(0)

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in aligner.counts(weights)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                met = [n for n in aligner.numbers(batch.column(0).slice(at, SLICE).to_pylist()) if n is not None]
                if not met:
                    continue
                weights = np.pad(weights, (0, len(aligner) - len(weights))) + np.bincount(np.concatenate(met), minlength=len(aligner))
                if len(aligner) > CHUNKS:
                    yield give()
                    aligner.clear()
                    weights = np.zeros(0)
        yield give()

    return docs.select(F.col(text)).mapInArrow(run, "pair bigint, n bigint")


def _vectors(partial: DataFrame, hashed) -> DataFrame:
    """node, counts: a dense vector of counts for each task, as bytes."""
    schema = pa.schema([("node", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashed.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            np.add.at(total, known.find(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    return partial.mapInArrow(run, "node bigint, counts binary")


def _sum_tree(vectors: DataFrame, tasks: int) -> DataFrame:
    """One row: the sum of all vectors, FAN at a time."""

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py(), np.int64) for v in group.column(1)], axis=0, dtype=np.int64)
        return pa.table({"node": group.column(0).slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    while tasks > 1:
        vectors = vectors.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("node").applyInArrow(add, "node bigint, counts binary")
        tasks = -(-tasks // FAN)
    return vectors


def pair_counts(docs: DataFrame, a: str, b: str, text: str = "text") -> tuple[PerfectHash, np.ndarray]:
    """The distinct linked pairs (id of A times 2^32, plus id of B), hashed, and the count of each by its index.

    On the driver, as vocabularies bound their number (most_pairs); counts come from all texts.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "pairs")
    _partial_counts(docs, text, a, b).write.parquet(f"{folder}/counts")
    partial = spark.read.parquet(f"{folder}/counts")
    most = most_pairs(a, b)
    found = partial.select("pair").distinct().limit(most + 1).toArrow().column(0).to_numpy()
    if len(found) > most:
        raise ValueError(f"more pairs than the {most} that vocabularies allow")
    known = PerfectHash(np.sort(found))
    hashed = spark.sparkContext.broadcast(known)
    counts = np.zeros(len(known), np.int64)
    for r in _sum_tree(_vectors(partial, hashed), partial.rdd.getNumPartitions()).collect():  # one row, of 8 bytes a pair
        counts = counts + np.frombuffer(r["counts"], np.int64)
    remove(spark, folder)
    return known, counts


RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and RESULT of every row: tokens of A and B, groups, links, those whose count is the highest of their B id, the
    sum of the links' counts, and a digest of the groups' ids (a1,a2|b1;a3|b2).

    a: a plain byte-level BPE file, b: a sentence-piece file that puts a space before a text; strings of special tokens in
    texts are ordinary text. Texts that are null, empty, or that either tokenizer does not give back byte by byte have no
    tokens: zeros and an empty digest, and no part in the counts. Repeated rows count as often as they stand there, null
    keys are rows of their own, other columns are dropped, an empty table gives no rows. Counts are made when this is
    called, over all rows.
    """
    known, counts = pair_counts(docs, a, b, text)
    b_ids = known.keys & 0xFFFFFFFF
    top = np.zeros(int(b_ids.max(initial=0)) + 1, np.int64)
    np.maximum.at(top, b_ids, counts)
    looked_up = docs.sparkSession.sparkContext.broadcast((known, counts, counts == top[b_ids]))  # bounded like the pairs
    schema = to_arrow_schema(StructType.fromDDL(f"{key} {dict(docs.dtypes)[key]}, {RESULT}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = looked_up.value
        aligner, table = Aligner(a, b), np.zeros((0, 5), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(at, SLICE), []
                numbers = list(aligner.numbers(part.column(1).to_pylist(), True))
                if len(aligner) > len(table):
                    facts, links = aligner.facts.pop(), aligner.links.pop()
                    where, first = known.find(links), np.cumsum(facts[:, 2]) - facts[:, 2]
                    # every chunk ends where both tokenizers end, so it has a link
                    sums = np.stack([np.add.reduceat(v, first) for v in (best[where].astype(np.int64), counts[where])], axis=1)
                    table = np.concatenate([table, np.concatenate([facts, sums], axis=1)])
                for n in numbers:
                    if n is None:
                        rows.append((0, 0, 0, 0, 0, 0, ""))
                        continue
                    n_a, n_b, links, n_best, count = table[n].sum(axis=0).tolist()
                    rows.append((n_a, n_b, links, links, n_best, count, hashlib.sha256(";".join(map(aligner.groups.__getitem__, n.tolist())).encode()).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]], schema=schema)
                if len(aligner) > CHUNKS:
                    aligner.clear()
                    table = table[:0]

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, {RESULT}")


def op12_align_tokenizers(spark, sf_dir: str) -> DataFrame:
    """Alignment of byte-level BPE and sentence pieces over all documents, with the corpus-wide counts of their links.

    Null, empty and not reproducible texts have zeros and an empty digest.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
