"""Near copies by text similarity: SimHash with a byte-position inverted index and count filtering, then exact verification.

Two texts are near copies if 0.8 or more of their words are shared: the words of both that stand in 5-word shingles which
both texts hold, over the words of both. An edit of one word breaks five shingles but leaves the words around it shared,
so one changed word in twenty leaves 0.93 of the words and 0.63 of the shingle sets' union. A Jaccard similarity of the
shingle sets of 0.8 or more makes near copies too (with repeated passages it can be the higher of the two).

First the SimHash fingerprints of all texts meet in simhash.py's index: those of equal fingerprints, and those that differ
in MAX_BITS bits or fewer. These pairs are verified on their whole texts like all others.

An edit of one word in twenty moves one SimHash of 64 bits by more, about 13, beyond what an exact byte index can promise.
So the texts also have a wide fingerprint of POSITIONS bytes, each the hash byte of one of its word pairs, the smallest
under the position's own order (a min-wise sample), filed by byte positions in the same way. It adds to what SimHash
links and replaces none of it; the README gives figures. Bytes at a position agree with the probability that the pair
sets' similarity is, whatever the kind of edit; near copies have 0.6 or more.

The byte positions are cut into shares of SHARE; a posting list holds the texts whose bytes agree on a share. A pair of
similar word-pair sets meets in a list with probability 1 - (1 - s^4)^32: 0.989 at 0.6, 0.9999 at 0.7. Within a list the
shared positional bytes of each pair are tallied, pairs under MIN_SHARED are dropped, and of the others a spanning forest
leaves the task. Its pairs are verified on their whole texts. Only verified pairs link: where a forest's pair is rejected,
its list is met again, whole shingle sequences at hand. Measured recall is in the tests and the README.

Equal texts (as words) are one node before the index; long lists are dealt as postings.py describes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_rows
from .postings import deal_chunks, deal_rest, narrow, small, spread_join
from .simhash import components, fingerprint_of
from .simhash import links as simhash_links

SHARE, SHARES, PAIR, SHINGLE, SIMILARITY = 4, 32, 2, 5, 0.8
POSITIONS = SHARE * SHARES
#: Of the POSITIONS bytes: what near copies share at least, at 0.6 of them less four deviations.
MIN_SHARED = 54
CHUNK = 2048
#: Of whole shingle sequences in a chunk; a pair of chunks is in one task's memory.
CHUNK_BYTES = 16 << 20
_BLOCK = 1024
#: An odd factor per position; XXH64 values times it, modulo 2^64, are the position's order.
_ORDERS = np.random.default_rng(2024).integers(1 << 62, dtype=np.uint64, size=POSITIONS)[:, None] * np.uint64(2) + np.uint64(1)


def _words(text: str) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """Hash of the words as a signed number, the words joined by spaces, where they start and where they end."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1 if words else np.array([0])
    node = xxhash.xxh64_intdigest(joined)
    return node - (1 << 64) if node >> 63 else node, joined, np.concatenate([[0], ends[:-1] + 1]), ends


def _hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every run of length words, in order; fewer words are one run."""
    import xxhash

    digest, k = xxhash.xxh64_intdigest, min(length, len(starts))
    return np.array([digest(joined[i:j]) for i, j in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def signature(text: str) -> tuple[int, int, bytes]:
    """Hash of the words, SimHash (as a signed number; 0 without words), wide fingerprint of POSITIONS bytes."""
    node, *words = _words(text)
    fp = fingerprint_of(*words) if words[0] else 0
    hashes, least = np.unique(_hashes(*words, PAIR)), np.full(POSITIONS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (_ORDERS * hashes[at : at + _BLOCK]).min(axis=1))
    return node, fp - (1 << 64) if fp >> 63 else fp, (least >> np.uint64(56) ^ least & np.uint64(255)).astype(np.uint8).tobytes()


def sequence(text: str, shingle: int = SHINGLE) -> tuple[int, int, bytes]:
    """Hash of the words, number of words, hashes of the shingles in order (little-endian)."""
    node, joined, starts, ends = _words(text)
    return node, len(starts) if joined else 0, _hashes(joined, starts, ends, shingle).astype("<u8").tobytes()


def _covered(held: np.ndarray, n: int) -> int:
    """Of n words, those in a shingle that is held: shingles start at the words in order."""
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(held)
    edges[at] += 1
    edges[at + (n - len(held) + 1)] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def likeness(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> float:
    """Of two texts' shingle sequences and numbers of words: shared words over all, or the sets' Jaccard if that is higher."""
    sa, sb = np.unique(a), np.unique(b)
    both = np.intersect1d(sa, sb, assume_unique=True)
    if not len(both):
        return 0.0
    if n_a + n_b == 0:
        return 1.0
    shared = sum(_covered(np.isin(x, both), n) for x, n in ((a, n_a), (b, n_b)))
    return max(shared / (n_a + n_b), len(both) / (len(sa) + len(sb) - len(both)))


def _near(i: int, rest: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Of rest, the nodes that share MIN_SHARED bytes with i."""
    return rest[(wide[rest] == wide[i]).sum(axis=1) >= MIN_SHARED]


def _first_met(i: int, rest: np.ndarray, wide: np.ndarray, share: int) -> np.ndarray:
    """Of rest, the nodes that meet i in no list of an earlier share, so that one list answers for each pair."""
    same = wide[rest, : SHARE * share] == wide[i, : SHARE * share]
    return rest[~same.reshape(len(rest), share, SHARE).all(axis=2).any(axis=1)]


def _after(i: int, top: np.ndarray) -> np.ndarray:
    """The nodes after i that are not joined to it."""
    return i + 1 + np.flatnonzero(top[i + 1 :] != top[i])


def _join(top: np.ndarray, i: int, j: int) -> bool:
    if top[i] == top[j]:
        return False
    top[top == top[j]] = top[i]
    return True


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _objects(column) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _wide(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _runs(batches: Iterator, keys: int, read) -> Iterator:
    """(key, columns of a run): whole runs of equal values in the first keys columns of sorted rows, across batches."""
    rest = None
    for batch in batches:
        new = (np.stack([_numbers(batch.column(i)) for i in range(keys)], axis=1), *read(batch))
        new = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new))
        if not len(new[0]):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (new[0][1:] != new[0][:-1]).any(axis=1)]))
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if j - i > 1:
                yield new[0][i].tolist(), *[x[i:j] for x in new[1:]]
        rest = tuple(x[starts[-1] :] for x in new)
    if rest is not None and len(rest[0]) > 1:
        yield rest[0][0].tolist(), *rest[1:]


def _to_arrow(rows: Iterator[tuple], names: list[str]) -> Iterator:
    """Batches of rows of numbers; share is an int, all others are longs."""
    import pyarrow as pa

    fields = pa.schema([(n, pa.int32() if n == "share" else pa.int64()) for n in names])
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*kept), fields)], schema=fields)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*kept), fields)], schema=fields)


def _forests(batches: Iterator) -> Iterator:
    """share, bytes, n, a, b: of every chunk of a list a spanning forest of the pairs that the tally keeps; n is the chunk's size."""

    def solve():
        for (share, key, _), nodes, wide in _runs(batches, 3, lambda b: (_numbers(b.column(3)), _wide(b.column(4)))):
            n, top = len(nodes), np.arange(len(nodes))
            for i in range(n - 1):
                for j in _near(i, _after(i, top), wide).tolist():
                    if _join(top, i, j):
                        yield share, key, n, int(nodes[j]), int(nodes[i])
                if (top == top[0]).all():
                    break

    yield from _to_arrow(solve(), ["share", "bytes", "n", "a", "b"])


def _unsettled(batches: Iterator) -> Iterator:
    """share, bytes, node, root: nodes of pairs that the tally keeps, of different roots and met in no earlier list."""

    def solve():
        for (share, key, _, _), nodes, roots, wide in _runs(batches, 4, lambda b: (_numbers(b.column(4)), _numbers(b.column(5)), _wide(b.column(6)))):
            open_ = np.zeros(len(nodes), bool)
            for i in range(len(nodes) - 1):
                rest = _first_met(i, _near(i, _after(i, roots), wide), wide, share)
                open_[rest] = True
                open_[i] |= len(rest) > 0
            yield from ((share, key, a, r) for a, r in zip(nodes[open_].tolist(), roots[open_].tolist()))

    yield from _to_arrow(solve(), ["share", "bytes", "node", "root"])


def _settled_links(batches: Iterator, least: float) -> Iterator:
    """a, b: a spanning forest of roots by the pairs of a run whose whole shingle sequences make near copies."""

    def solve():
        read = lambda b: (_numbers(b.column(4)), _wide(b.column(5)), _numbers(b.column(6)), _objects(b.column(7)))
        for (share, *_), roots, wide, words, shingles in _runs(batches, 4, read):
            top, held = np.unique(roots, return_inverse=True)[1], [np.frombuffer(x, "<u8") for x in shingles]
            for i in range(len(roots) - 1):
                for j in _first_met(i, _near(i, _after(i, top), wide), wide, share).tolist():
                    if top[i] != top[j] and likeness(held[i], int(words[i]), held[j], int(words[j])) >= least:
                        yield int(roots[i]), int(roots[j])
                        _join(top, i, j)

    yield from _to_arrow(solve(), ["a", "b"])


def _verified(batches: Iterator, least: float) -> Iterator:
    """a, b of the rows (a, b, words, shingles, words, shingles) that are near copies."""

    def solve():
        for batch in batches:
            a, b, n_a, n_b = (_numbers(batch.column(i)).tolist() for i in (0, 1, 2, 4))
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (3, 5))
                if likeness(s, n_a[i], t, n_b[i]) >= least:
                    yield a[i], b[i]

    yield from _to_arrow(solve(), ["a", "b"])


_LIST = ["share", "bytes"]


def _sequences(docs: DataFrame, rows: DataFrame, wanted: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """node, words, shingles of the wanted nodes, from one row's text each.

    The keys of those rows are counted and broadcast if they are few, so that the other texts stay where they are.
    """
    keys = durable(rows.join(wanted.distinct(), "node").groupBy("node").agg(F.min("key").alias("__want")).select("__want").distinct())
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    asked = texts.join(small(keys), F.col("__key").eqNullSafe(F.col("__want")), "left_semi")
    found = map_rows(asked, ["__text"], "node bigint, words bigint, shingles binary", lambda texts: (sequence(t or "", shingle) for t in texts))
    return found.dropDuplicates(["node"])


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of pairs with a and b, those of different roots."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return pairs.filter("root_a <> root_b").drop("root_a", "root_b")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: nodes of equal SimHash with the least of them, and the least nodes of SimHashes that simhash.py links."""
    firsts = durable(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    several = small(firsts.filter("n > 1").select("fp", "first"))
    same = nodes.join(several, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    linked = narrow(durable(simhash_links(firsts.select("fp"))))
    for c in ("a", "b"):
        linked = linked.join(firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")), c)
    return same.unionByName(linked.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def _links(docs: DataFrame, rows: DataFrame, key: str, text: str, shingle: int, least: float, chunk: int) -> DataFrame:
    """node, root of every node that is linked to another: see the module."""
    close = _simhash_pairs(rows.select("node", "fp").distinct())
    nodes = rows.select("node", "wide").dropDuplicates(["node"])
    bytes_at = lambda i: F.conv(F.hex(F.substring("wide", SHARE * i + 1, SHARE)), 16, 10).cast("long")
    postings = nodes.select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("share"), bytes_at(i).alias("bytes")) for i in range(SHARES)])).alias("p")).select("node", "p.share", "p.bytes")
    lists = durable(postings.groupBy(*_LIST).agg(F.count("*").alias("n")).filter("n > 1"))
    long = lists.filter(F.col("n") > chunk)
    long = None if long.isEmpty() else long
    dealt = deal_chunks(postings, lists, long, _LIST, "node", chunk).join(nodes, "node").select(*_LIST, "x", "node", "wide", "lead")
    runs = dealt.repartition(*_LIST, "x").sortWithinPartitions(*_LIST, "x", F.desc("lead"), "node")
    found = narrow(durable(runs.mapInArrow(_forests, "share int, bytes bigint, n bigint, a bigint, b bigint")))

    pairs = narrow(durable(found.select("a", "b").unionByName(close).distinct()))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sequences = narrow(durable(_sequences(docs, rows, ends, key, text, shingle)))

    def verify(some: DataFrame) -> DataFrame:
        of = lambda c: sequences.select(F.col("node").alias(c), F.col("words").alias(f"words_{c}"), F.col("shingles").alias(f"shingles_{c}"))
        met = spread_join(some.join(of("a"), "a"), of("b"), "b", "a")
        return met.select("a", "b", "words_a", "shingles_a", "words_b", "shingles_b").mapInArrow(lambda batches: _verified(batches, least), "a bigint, b bigint")

    # most nodes are linked by one pair; what other pairs add is asked of those that are still apart
    sure = narrow(durable(verify(pairs.groupBy("a").agg(F.min("b").alias("b")))))
    roots = components(sure)
    sure = sure.unionByName(durable(verify(_apart(pairs, roots).join(sure, ["a", "b"], "left_anti"))))
    roots = components(sure)

    # lists whose forest holds a rejected pair of nodes that are apart, and long lists, are met again
    again = _apart(found.filter("n > 2").select(*_LIST, "a", "b"), roots).select(*_LIST)
    again = durable((again if long is None else again.unionByName(long.select(*_LIST))).distinct())
    if again.isEmpty():
        return roots
    members = postings.join(small(again), _LIST).join(roots, "node", "left").select(*_LIST, "node", F.coalesce("root", "node").alias("root"))
    met = deal_rest(durable(members.withColumn("weight", F.lit(1.0 / chunk))), _LIST, "node").join(nodes, "node").select(*_LIST, "x", "y", "node", "root", "wide")
    open_ = durable(met.repartition(*_LIST, "x", "y").sortWithinPartitions(*_LIST, "x", "y", "node").mapInArrow(_unsettled, "share int, bytes bigint, node bigint, root bigint").distinct())
    known = open_.select("node").distinct().join(sequences.select("node"), "node", "left_anti")
    whole = sequences.unionByName(durable(_sequences(docs, rows, known, key, text, shingle)))
    weighed = open_.join(whole.select("node", F.greatest(F.lit(1.0 / chunk), F.length("shingles") / CHUNK_BYTES).alias("weight")), "node")
    met = deal_rest(durable(weighed), _LIST, "node").join(nodes, "node").join(whole, "node").select(*_LIST, "x", "y", "root", "wide", "words", "shingles", "node")
    runs = met.repartition(*_LIST, "x", "y").sortWithinPartitions(*_LIST, "x", "y", "node")
    last = components(runs.mapInArrow(lambda batches: _settled_links(batches, least), "a bigint, b bigint"))
    last = last.select(F.col("node").alias("root"), F.col("root").alias("met"))
    return roots.join(last, "root", "left").select("node", F.coalesce("met", "root").alias("root")).unionByName(last.select(F.col("root").alias("node"), F.col("met").alias("root")))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """key and component_id (smallest key of the near copies it is linked to, itself included) for every row.

    A null text counts as empty; empty texts are copies of each other. Rows of a null key take part, and are given.
    Repeated rows are given each; other columns are dropped; an empty table gives none.
    """
    body = lambda keys, texts: [(k, *signature(t or "")) for k, t in zip(keys, texts)]
    schema = f"key {dict(docs.dtypes)[key]}, node bigint, fp bigint, wide binary"
    rows = durable(map_rows(docs.withColumns({"__key": F.col(key), "__text": F.col(text)}), ["__key", "__text"], schema, body))
    roots = _links(docs, rows, key, text, shingle, least, chunk)
    known = rows.groupBy("node").agg(F.min("key").alias("first"))
    rooted = durable(known.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    named = spread_join(rooted, rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root", "node").select("node", "component_id")
    return spread_join(rows.select("key", "node"), named, "node", "key").select(F.col("key").alias(key), "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest key.

    Rows that share a key are one document: the one with the smallest hash of its text, then of its other columns as JSON,
    stays if any does. A row of a null key cannot stand for others and stays. All columns of docs are kept, and no others;
    their names and types are free, map columns included.
    """
    stay = near_copies(docs, key, text, least=least).filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("__stay")).distinct()
    kept = docs.join(stay, docs[key] == stay["__stay"], "left_semi")
    order = [F.xxhash64(text), F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c != text])))]
    once = kept.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
    return once.unionByName(docs.filter(F.col(key).isNull()))
