import random
import re
from itertools import combinations

import pytest
import xxhash

from sunloom.llm import nearcopies, simhash

from .conftest import SMALL


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, linked):
    """prints: (key, fingerprint); smallest key that is not null of what each row reaches."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if linked(prints[i], prints[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [min((prints[j][0] for j in range(len(prints)) if find(j) == find(i) and prints[j][0] is not None), default=None) for i in range(len(prints))]


def check(df, docs):
    rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    want = sorted(zip([r[0] for r in rows], [r[1] for r in rows], brute_components([(k, f) for k, f in rows], lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in df.collect()), key=str)
    assert got == want


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(simhash.near_duplicates(docs), docs)


def test_hard_rows(hard, nothing):
    check(simhash.near_duplicates(hard), hard)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_position_sets_cover(bits):
    sets = simhash.position_sets(bits)
    assert all(any(set(s) <= set(shared) for s in sets) for shared in combinations(range(8), 8 - bits))


@pytest.mark.parametrize("chunk", [3, 8192])
def test_links_lose_nothing_in_hot_lists(spark, chunk):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    nodes = set(base)
    for b in base:
        for _ in range(60):
            f = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << bit
            nodes.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in nodes)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, chunk)).collect()}
    want = brute_components([(f, f) for f in signed], lambda a, b: ((a[1] ^ b[1]) % (1 << 64)).bit_count() <= 3)
    assert [roots.get(f, f) for f in signed] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 199)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 150)} | {200: 199}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def parts(text):
    """Words and 5-word shingles of a text, in order."""
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return words, [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]


def overlap(a, b):
    """Of two texts' parts: the share of words in shared shingles, or the Jaccard similarity of the shingle sets if higher."""
    both = set(a[1]) & set(b[1])
    if not both:
        return 0.0
    shared = sum(any(x[i] in both for i in range(max(0, at - 4), min(at + 1, len(x)))) for words, x in (a, b) for at in range(len(words)))
    return max(shared / max(1, len(a[0]) + len(b[0])), len(both) / len(set(a[1]) | set(b[1])))


def test_near_copies_found_and_others_left(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, near = [], []
    for g in range(40):
        base = rng.choices(vocabulary, k=rng.randint(80, 600))
        copy = edited(rng, base, rng.choice([0.01, 0.05, 0.2]))
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(copy)), (10 * g + 2, " ".join(base).upper()), (10 * g + 3, " ".join(rng.choices(vocabulary, k=200)))]
        near.append(overlap(parts(" ".join(base)), parts(" ".join(copy))))
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * g + 2] == 10 * g for g in range(40))
    assert all(got[10 * g + 3] == 10 * g + 3 for g in range(40))
    assert all((got[10 * g + 1] == 10 * g) == (near[g] >= 0.8) for g in range(40))
    assert 10 < sum(x >= 0.8 for x in near) < 40


@pytest.mark.parametrize("kind", ["words", "end", "head"])
def test_near_copies_of_every_edit(spark, kind):
    """Scattered words, a block at the end, a lost head: similarities on both sides of the threshold."""
    rng = random.Random(kind)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        n = rng.choice([25, 60, 300, 1500])
        base = rng.choices(vocabulary, k=n)
        copy = {"words": edited(rng, base, rng.uniform(0, 0.16)), "end": base + rng.choices(vocabulary, k=int(n * rng.uniform(0.05, 0.8))), "head": base[int(n * rng.uniform(0.05, 0.6)) :]}[kind]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [overlap(parts(rows[2 * g][1]), parts(rows[2 * g + 1][1])) for g in range(60)]
    assert 10 < sum(x >= 0.8 for x in near) < 60
    assert all((got[2 * g + 1] == 2 * g) == (near[g] >= 0.8) for g in range(60))


def test_near_copies_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], parts(r["text"])) for r in docs.collect()]
    want = brute_components(rows, lambda a, b: overlap(a[1], b[1]) >= 0.8)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
    assert [got[k] for k, _ in rows] == want


def test_near_copies_in_chunks(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(edited(rng, base, 0.004))) for i in range(60)]
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), chunk=7)
    assert {r["component_id"] for r in got.collect()} == {0}


@pytest.mark.parametrize("changed,chunk", [([28, 30], 2048), ([30, 32], 2048), ([30, 32], 30)])
def test_near_copies_of_groups_around_the_threshold(spark, changed, chunk):
    """Variants of one text at 0.75 to 0.85: a pair that is verified as no link must not cost others theirs."""
    rng = random.Random(17)
    base, rows = rng.choices([f"w{i}" for i in range(3000)], k=600), []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(600), rng.choice(changed)):
            words[at] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [(i, parts(t)) for i, t in rows]
    want = brute_components(sets, lambda a, b: overlap(a[1], b[1]) >= 0.8)
    near = [overlap(sets[0][1], b) for _, b in sets[1:]]
    assert min(near) < 0.8 < max(near)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()}
    assert [got[i] for i in range(150)] == want


@pytest.mark.parametrize("seed", range(30))
def test_likeness_equals_its_definition(seed):
    import numpy as np

    rng = random.Random(seed)
    a = rng.choices("abcde", k=rng.randint(0, 40))
    b = [*a[: rng.randint(0, len(a))], *rng.choices("abcde", k=rng.randint(0, 9)), *a[rng.randint(0, len(a)) :]]
    (_, n, s), (_, m, t) = (nearcopies.sequence(" ".join(x)) for x in (a, b))
    assert nearcopies.likeness(np.frombuffer(s, "<u8"), n, np.frombuffer(t, "<u8"), m) == pytest.approx(1.0 if not a + b else overlap(parts(" ".join(a)), parts(" ".join(b))))


@pytest.mark.parametrize("chunk", [4, 10**6])
def test_long_lists_are_met_whole(spark, chunk):
    """Every pair of different roots shares a task, whatever the chunks; pairs of one root need not."""
    from pyspark.sql import functions as F

    from sunloom.llm import postings

    rows = [(1, i, 0 if i < 30 else i) for i in range(40)] + [(2, i, i) for i in range(9)] + [(3, i, 5) for i in range(20)]
    members = spark.createDataFrame(rows, "list int, node long, root long").withColumn("weight", F.lit(1.0 / chunk))
    dealt, tasks = postings.deal_rest(members, ["list"], "node").collect(), {}
    for r in dealt:
        tasks.setdefault((r["list"], r["x"], r["y"]), set()).add(r["node"])
    met = {(k[0], a, b) for k, t in tasks.items() for a in t for b in t}
    root = {(x, n): r for x, n, r in rows}
    assert all((x, a, b) in met for x, a, ra in rows for y, b, rb in rows if x == y and ra != rb)
    assert 3 not in {k[0] for k in tasks} and len(root) == len(rows)


def test_drop_near_copies_hard(hard, nothing):
    kept = nearcopies.drop_near_copies(hard)
    assert kept.columns == hard.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 6, 7, 8, None]
    assert nearcopies.drop_near_copies(nothing).count() == 0


def test_near_copies_take_simhash_links(spark, monkeypatch):
    """Where the wide fingerprints give no pair, texts whose SimHash differs in 3 bits or fewer are still linked, and no others."""
    import numpy as np

    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(10**6, size=900)]
    other = [f"w{k}" for k in rng.integers(10**6, size=900)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(["start", *words])), (4, " ".join(other)), (5, " ".join([*other[:450], *words[:450]]))]
    bits = [simhash.fingerprint(t) for _, t in rows]
    assert all((bits[0] ^ b).bit_count() <= simhash.MAX_BITS for b in bits[1:3]) and all((bits[0] ^ b).bit_count() > simhash.MAX_BITS for b in bits[3:])
    monkeypatch.setattr(nearcopies, "_forests", lambda batches: iter(()))
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_simhash_pairs_reach_every_node(spark):
    """Equal fingerprints hang from their least node, fingerprints within 3 bits from each other's."""
    nodes = [(10, 5), (11, 5), (12, 5), (20, 5 ^ 0b1011), (30, 5 ^ (0b1111 << 40)), (40, -1)]
    got = {frozenset(r) for r in nearcopies._simhash_pairs(spark.createDataFrame(nodes, "node long, fp long")).collect()}
    assert got == {frozenset(p) for p in ((10, 11), (10, 12), (10, 20))}
