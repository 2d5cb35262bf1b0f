import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sunloom.llm import mixing, packing

from .conftest import SMALL

ODD = ["a  b", "a \n b", "  x", "\n\n a", "<|endoftext|> x<|endoftext|>", "", "a  b  \n\n c ", " a b ", "x\n y\n", "ab \t c", "\u00e9 \u00fc\u2019s 12 a\r\n b", "don't we'll", "\u00a0 \u3000x", "a\u2003 b"]


BPE: dict = {}


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_ids_are_the_tokenizers(spark, reference):
    bpe = packing.ByteBpe(packing.tokenizer_path())
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for t in texts:
        assert np.frombuffer(bpe.ids(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, t[:80]


@given(st.text(alphabet=" \n\tab'1,\u00e9\u00a0", max_size=30))
def test_ids_of_white_space(text):
    bpe = BPE.setdefault("bpe", None) or BPE.update(bpe=packing.ByteBpe(packing.tokenizer_path())) or BPE["bpe"]
    assert bpe.ids(text) == np.array(bpe._bpe.encode_ordinary(text), "<u4").tobytes()


def check_packing(rows, length=packing.LENGTH):
    """Offsets gapless from 0, no sequence over its length."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences)


def test_whole_table(spark, reference):
    rows = packing.pack(packing.tokenize_pieces(spark.read.parquet(f"{SMALL}/documents.parquet"), packing.tokenizer_path())).collect()
    used = check_packing(rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for k, pieces in by_doc.items():
        ids = reference.encode(texts[k], add_special_tokens=False).ids + [packing.END]
        assert [i for p in sorted(pieces, key=lambda p: p["start"]) for i in p["ids"]] == ids
        for p in pieces:
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    assert sum(r["length"] for r in rows) > 0.97 * used * packing.LENGTH


def test_groups_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    rng = random.Random(2)
    pieces = [(1, 0, rng.choice([1, 5, 700, 2048])) for _ in range(600)]
    rows = packing.pack(spark.createDataFrame(pieces, "doc_id long, start long, length long")).collect()
    assert Counter(r["length"] for r in rows) == Counter(p[2] for p in pieces)
    check_packing(rows)
    assert len({r["sequence_id"] >> 32 for r in rows}) > 5


def test_hard_rows_packed(hard, nothing):
    rows = packing.pack(packing.tokenize_pieces(hard, packing.tokenizer_path(), with_ids=False)).collect()
    check_packing(rows)
    whole = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    assert whole == Counter([1, 1, 2, 3, 4, 5, 6, 7, 8, None])
    assert all(r["doc_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4))
    assert packing.pack(packing.tokenize_pieces(nothing, packing.tokenizer_path())).count() == 0


@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing_against_plain(lengths):
    bins, offsets = packing.first_fit_decreasing(lengths, 20)
    free = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, room in enumerate(free) if room >= lengths[i]), len(free))
        if b == len(free):
            free.append(20)
        assert bins[i] == b and offsets[i] == 20 - free[b]
        free[b] -= lengths[i]


def test_first_fit_rejects_misfits():
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([0], 4)
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([5], 4)


def sql_rows(docs):
    con = duckdb.connect()
    frame = docs.select("doc_id", "source", "text").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    return sorted(con.sql(mixing.OP3_SQL).fetchall(), key=str)


@pytest.mark.parametrize("range_rows", [7, 4000])
def test_mix_equals_sql(spark, hard, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), hard):
        got = mixing.plan_mix(docs, mixing.word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken", "copies", "finish")
        # a place in the order of rows that agree is any of theirs
        assert [r[:6] for r in sorted(map(tuple, got.collect()), key=str)] == [r[:6] for r in sql_rows(docs)]


def test_targets_by_resharing(spark):
    """The closed form against the rule as it is told: share, stop what is above, reshare."""
    rng = random.Random(8)
    for _ in range(5):
        sizes = {f"s{i:02}": rng.choice([0, 1, 5, 50, 1000, 20000]) for i in range(9)}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
        left, open_, want = float(sum(sizes.values())), set(sizes), {}
        while open_:
            total = sum(weight[s] for s in open_)
            above = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
            if not above:
                want |= {s: left * weight[s] / total for s in open_}
                break
            for s in above:
                want[s] = 3.0 * sizes[s]
            left -= sum(want[s] for s in above)
            open_ -= above
        assert got == pytest.approx(want)


def test_mixture_rows(spark, hard, nothing):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs, mixing.word_count(F.col("text"))).collect()}
    rows = mixing.mixture(docs)
    assert rows.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter({k: n for k, n in plan.items() if n})
    assert mixing.mixture(hard).columns == hard.columns
    assert mixing.mixture(nothing).count() == 0
    assert mixing.plan_mix(nothing, mixing.word_count(F.col("text"))).count() == 0


def test_rows_that_agree_are_split(spark, monkeypatch):
    """Rows of one key, source and size, as null keys have, are planned by their count and dealt in parts; SQL has one by one."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rows = [(None, "a", "five words are in here")] * 100 + [(i, s, "some words " * (i % 9)) for i in range(60) for s in "ab"] + [(5, "b", "x y")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    plan = mixing.plan_mix(docs, mixing.word_count(F.col("text"))).collect()
    assert len(plan) == len(rows)
    want = Counter((None if r[0] is None or r[0] != r[0] else int(r[0]), r[1], r[2]) for r in con.sql(f"SELECT doc_id, size, copies FROM ({mixing.OP3_SQL})").fetchall())
    assert Counter((r["doc_id"], r["size"], r["copies"]) for r in plan) == want
    numbers = sorted(r["number"] for r in plan if r["doc_id"] is None)
    assert numbers == list(range(1, 101))
    taken = Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.mixture(docs).collect())
    assert sum(taken.values()) == sum(r["copies"] for r in plan)
    for (k, s, t), n in taken.items():
        assert n == sum(r["copies"] for r in plan if (r["doc_id"], r["source"], r["size"]) == (k, s, len(t.split())))
