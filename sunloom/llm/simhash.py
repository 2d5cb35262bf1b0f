"""SimHash near-dedup: a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two that differ in d bits or fewer share at least 8 - d byte positions. The index files a
fingerprint under sets of byte positions with the bytes that stand there, such that any two that share 8 - d positions
meet in at least one posting list; in a list, the shared positional bytes of each pair are tallied, pairs under the
guaranteed minimum are dropped, and the others are verified bit by bit.

Single bytes would make posting lists that grow with the input (1 in 256 of all). For d = 3 the sets are the 14 blocks
{a, b, c, a xor b xor c} of the Steiner system S(3, 4, 8): any 5 positions hold a block, and a posting list holds 1 in
2^32 of what is unrelated. For smaller d, d + 1 equal shares of the positions do.

What could be hot is not: equal fingerprints are one node before the index; within a posting list only a spanning
forest of the links leaves the task, not the pairs; lists of more than CHUNK nodes are cut into chunks that share leaders,
and only what their links leave apart is met chunk by chunk (postings.py), so no link is lost and no task holds more than
two chunks. Links become components by alternating star contractions, each written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_rows
from .postings import MOST_BROADCAST, deal_chunks, deal_rest, narrow, small, spread_join

SHINGLE, MAX_BITS, SEED = 3, 3, 42
CHUNK = 8192
_BLOCK = 512


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: 1 where over half of the shingles' XXH64 have 1.

    Shingles are shingle words in a row, A-Z lower-cased, joined by single spaces, repeats included; fewer words are one
    shingle, no words give 0.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return fingerprint_of(b" ".join(words), np.concatenate([[0], ends[:-1] + 1]), ends, shingle, seed)


def fingerprint_of(joined: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The same of words joined by single spaces, from where each starts and ends."""
    import xxhash

    k, digest = min(shingle, len(starts)), xxhash.xxh64_intdigest
    starts, ends = starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions one of which any 8 - max_bits positions contain."""
    if max_bits == 3:
        return sorted({tuple(sorted((a, b, c, a ^ b ^ c))) for a, b, c in combinations(range(8), 3)})
    if 0 <= max_bits < 3:
        # d differing positions leave one of d + 1 equal shares whole
        shares = [tuple(range(8 * i // (max_bits + 1), 8 * (i + 1) // (max_bits + 1))) for i in range(max_bits + 1)]
        return [tuple(range(8))] if max_bits == 0 else shares
    raise ValueError("fingerprints link at 0 to 3 differing bits")


def posting_keys(fp: Column, max_bits: int) -> Column:
    """Array of (set, bytes at its positions) of a fingerprint."""
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))

    def key(n: int, positions: tuple[int, ...]) -> Column:
        packed = F.lit(0).cast("long")
        for p in positions:
            packed = F.shiftleft(packed, 8).bitwiseOR(byte(p))
        return F.struct(F.lit(n).alias("set"), packed.alias("bytes"))

    return F.array(*[key(n, s) for n, s in enumerate(position_sets(max_bits))])


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs share 8 - max_bits positional bytes and then differ in max_bits bits or fewer."""
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=-1)
    out = shared >= 8 - max_bits
    out[out] = np.bitwise_count(differ[out]) <= max_bits
    return out


def _forest(nodes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for all linked nodes of one list; pairs are compared block by block."""
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(nodes), _BLOCK):
        part = nodes[at : at + _BLOCK]
        for other in range(at, len(nodes), _BLOCK):
            hit = _linked(np.ascontiguousarray(np.broadcast_to(part[:, None], (len(part), len(nodes[other : other + _BLOCK])))), np.ascontiguousarray(np.broadcast_to(nodes[None, other : other + _BLOCK], (len(part), len(nodes[other : other + _BLOCK])))), max_bits)
            # of each row only links that still join two trees are walked
            for i, js in ((at + i, other + np.flatnonzero(hit[i])) for i in np.flatnonzero(hit.any(axis=1))):
                for j in js[root[js] != root[i]] if len(js) > 1 else js:
                    a, b = find(i), find(int(j))
                    if a != b:
                        root[max(a, b)] = min(a, b)
    found = [(i, find(i)) for i in range(len(nodes))]
    return [(int(nodes[i]), int(nodes[r])) for i, r in found if i != r]


def _links(batches: Iterator, max_bits: int) -> Iterator:
    """Links within runs of equal (list, chunk pair) of sorted rows; a run that a batch cuts is carried on."""
    import pyarrow as pa

    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest: tuple[np.ndarray, np.ndarray] | None = None

    def solve(keys: np.ndarray, nodes: np.ndarray):
        edges: list[tuple[int, int]] = []
        if len(nodes) > 1:
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            sizes = np.diff(np.append(starts, len(nodes)))
            two = starts[sizes == 2]  # most lists that hold a pair hold no more
            hit = two[_linked(nodes[two], nodes[two + 1], max_bits)]
            edges += zip(np.maximum(nodes[hit], nodes[hit + 1]).view(np.int64).tolist(), np.minimum(nodes[hit], nodes[hit + 1]).view(np.int64).tolist())
            for i, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                edges += [tuple(np.array(e, np.uint64).view(np.int64).tolist()) for e in _forest(np.sort(nodes[i : i + n]), max_bits)]
        for at in range(0, len(edges), 10_000):
            a, b = zip(*edges[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=fields)

    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        nodes = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if rest is not None:
            keys, nodes = np.concatenate([rest[0], keys]), np.concatenate([rest[1], nodes])
        if not len(nodes):
            continue
        last = int(np.argmax((keys == keys[-1]).all(axis=1)))
        yield from solve(keys[:last], nodes[:last])
        rest = keys[last:], nodes[last:]
    if rest is not None:
        yield from solve(*rest)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp): spanning forests of the posting lists' pairs that link.

    Lists of more than chunk nodes are dealt as postings.py describes, and met again where their first links leave several
    components.
    """
    names = ["set", "bytes"]
    postings = nodes.select("fp", F.explode(posting_keys(F.col("fp"), max_bits)).alias("key")).select("fp", "key.set", "key.bytes")
    lists = durable(postings.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1"))
    long = lists.filter(F.col("n") > chunk)
    long = None if long.isEmpty() else long

    def solve(dealt: DataFrame) -> DataFrame:
        keys = [*names, "x", "y"]
        return dealt.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _links(batches, max_bits), "a bigint, b bigint").distinct()

    found = solve(deal_chunks(postings, lists, long, names, "fp", chunk).withColumn("y", F.col("x")))
    if long is None:
        return found
    found = durable(found)
    roots = components(found).withColumnRenamed("node", "fp")
    members = postings.join(small(long.select(*names)), names).join(roots, "fp", "left")
    members = members.select(*names, "fp", F.coalesce("root", "fp").alias("root"), F.lit(1.0 / chunk).alias("weight"))
    return found.unionByName(solve(deal_rest(durable(members), names, "fp"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots: root is the smallest node that it reaches.

    Large-star and small-star contractions in turn, until the edges stay the same: every node's star then hangs from its
    component's smallest node. Where there are more edges than one task should take (MOST_BROADCAST), those of one node are
    spread over tasks to meet its least neighbour. Fewer are kept in as many partitions as tasks run at a time, so that
    rounds over few edges leave few shuffle files.
    """
    edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    met, close, state = spread_join, lambda df: df, sums(edges)
    if state[0] <= MOST_BROADCAST:
        tasks = edges.sparkSession.sparkContext.defaultParallelism
        met, close = lambda rows, own, key, by: rows.join(own, key), lambda df: df.coalesce(tasks)
        edges = close(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = close(close(met(both, least, "a", "b")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        other = met(large, least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = durable(close(close(other.filter("a <> b")).distinct()))
        before, state = state, sums(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """key, fp (the fingerprint as a signed long) and component_id (smallest key of the component) for every row.

    A null text counts as empty: fingerprint 0, linked like any other. Repeated rows are given each; a row of a null key
    takes part, and its component's id is the smallest key that is not null, null if there is none. Other columns are
    dropped; an empty table gives none.
    """

    def body(keys, texts):
        for k, t in zip(keys, texts):
            fp = fingerprint(t or "", shingle, seed)
            yield k, fp - (1 << 64) if fp >> 63 else fp

    fps = durable(map_rows(docs.withColumns({"__key": F.col(key), "__text": F.col(text)}), ["__key", "__text"], f"key {dict(docs.dtypes)[key]}, fp bigint", body))
    nodes = fps.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(links(nodes.select("fp"), max_bits))
    rooted = durable(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = spread_join(rooted, rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root", "fp").select("fp", "component_id")
    return spread_join(fps, named, "fp", "key").select(F.col("key").alias(key), "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near copies of every document. Null and empty texts have fingerprint zero, linked like any other; a null doc_id names no group."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
