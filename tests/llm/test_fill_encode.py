"""Fill-in-the-middle, tree encoding and alignment against plain versions, whole tables and hard rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sunloom.llm import alignment, bpe, fillmiddle, treebpe

from .conftest import SMALL

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def tally(rows):
    return Counter(map(tuple, rows))


def filled(doc_id, text):
    text = text or ""
    units, digest = UNITS.findall(text), sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, len(units), form, len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(text)


def test_op11_whole_table_and_sql(spark):
    got = fillmiddle.op11_fill_middle(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = [filled(*r) for r in texts_of(docs)]
    assert tally(got.collect()) == tally(want) and {w[2] for w in want} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = con.sql(fillmiddle.OP11_SQL)
    assert list(found.columns) == got.columns and tally(found.fetchall()) == tally(want)


def test_fill_in_middle_on_hard_rows(spark, hard, nothing, huge):
    more = spark.createDataFrame([(k, t) for k in range(40, 60) for t in ("a <P> b c", "<S", "x<", "é😀 <M>", "\n\n", "< P>  <S ><M", "one two  three\n", "<<P")], "doc_id long, text string")
    for docs in (hard, more, huge, docs_of_blanks(spark)):
        assert tally(fillmiddle.fill_in_middle(docs).collect()) == tally(filled(*r) for r in texts_of(docs))
    assert fillmiddle.fill_in_middle(nothing).count() == 0
    renamed = hard.withColumnsRenamed({"doc_id": "piece", "text": "place"})
    assert tally(fillmiddle.fill_in_middle(renamed, "piece", "place").collect()) == tally(filled(*r) for r in texts_of(hard))


def docs_of_blanks(spark):
    return spark.createDataFrame([(1, " " * 100_000), (2, "x" * 100_000 + " y"), (3, None)], "doc_id long, text string")


def test_pieces_are_of_whole_units_and_sorted_into_outputs(spark):
    docs = spark.createDataFrame([(k, "some words of several lengths here " * 40) for k in range(30)], "doc_id long, text string")
    rows = fillmiddle.pieces(docs, piece=64).collect()
    heads = {r["row"]: r for r in rows if r["place"] == -1}
    assert len(heads) == 30 and all(len(r["piece"]) <= 64 for r in rows if r["piece"] is not None)
    by_row = {k: b"".join(bytes(r["piece"]) for r in sorted((r for r in rows if r["row"] == k and r["place"] >= 0), key=lambda r: r["place"])).decode() for k in heads}
    assert tally((heads[k]["key"], sha(v)) for k, v in by_row.items()) == tally((f[0], f[5]) for f in (filled(*r) for r in texts_of(docs)))


@given(st.sampled_from(["psm", "spm", "plain"]), st.tuples(*[st.text("<PSM> ab", max_size=12)] * 3), st.integers(1, 5))
def test_marks_are_found_wherever_pieces_are_cut(form, parts, size):
    p, m, s = (re.sub("<[PSM]>", "", x) for x in parts)
    p, m, s = (re.sub("<[PSM]>", "", x) for x in (p, m, s))
    if re.search("<[PSM]>", p + m + s):
        return  # such a text is plain
    out = {"psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}", "plain": p + m + s}[form].encode()
    restore = fillmiddle.Restore(form)
    found = [x for i in range(0, len(out), size) for x in restore.feed(out[i : i + size])] + list(restore.feed(b"", True))
    assert b"".join(d for _, d in sorted(found)).decode() == p + m + s


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(bpe.tokenizer_path())


def coded(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))


def test_op13_whole_table(spark, library):
    want = [coded(library, *r) for r in texts_of(spark.read.parquet(f"{SMALL}/documents.parquet"))]
    assert tally(treebpe.op13_bpe_roundtrip(spark, SMALL).collect()) == tally(want)


def test_encode_decode_on_hard_rows(spark, hard, nothing, huge, library):
    odd = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "|endoftext|>", "x" * 90_000, "漢字" * 20_000, " " * 50_000 + "a", "ab\n\n  c\t" * 9_000, "\x00\x1c \x85 ", "don't 'll '" * 900, ("<|endoftext|>" + "y" * 7_000) * 6]
    docs = spark.createDataFrame(list(enumerate(odd)) + [(1, "again " * 7_000), (1, "again " * 7_000), (None, "again " * 7_000)], "doc_id long, text string")
    for rows, leaf in ((hard, 64), (hard, treebpe.LEAF), (docs, 1_000), (docs, treebpe.LEAF), (huge.filter("doc_id < 4"), treebpe.LEAF)):
        got = treebpe.encode_decode(rows, bpe.tokenizer_path(), leaf=leaf).collect()
        assert tally(got) == tally(coded(library, *r) for r in texts_of(rows))
    assert treebpe.encode_decode(nothing, bpe.tokenizer_path()).count() == 0


@given(st.text(" '\nsaé漢1!tlrevdm\t", min_size=1, max_size=90), st.integers(4, 20))
def test_trees_equal_the_library(library, own, text, leaf):
    tree = treebpe.Tree(own)
    for h in treebpe.halves(text.encode(), leaf):
        assert h and len(h) <= leaf
        tree.add(np.frombuffer(own.plain(h.decode()), "<u4"))
    assert tree.ids().tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_joins_grow_until_both_sides_agree(library, own, seed):
    rng = random.Random(seed)
    for alphabet in ("ab", "aaaab", " a", "01234", "漢字かabc", "'s!", "é́😀👍🏽x"):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 70)))
            at = rng.randrange(1, len(text))
            sides = [np.frombuffer(own.plain(t), "<u4") for t in (text[:at], text[at:])]
            assert own.join(*sides, window=1).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_refused(library):
    import json

    file = json.loads(library.to_str())
    bpe.check_plain(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": file["model"] | {"merges": file["model"]["merges"][::-1]}}, {"added_tokens": [{**file["added_tokens"][0], "lstrip": True}]}, {"model": file["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.check_plain(file | change)


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    a = Tokenizer.from_file(bpe.tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))


def aligned(both, docs):
    """The contract, pair by pair."""
    (a, b), of_char = both, bpe.byte_characters()
    bytes_a = {i: bytes(of_char[c] for c in t) if i != 50256 else t.encode() for t, i in a.get_vocab().items()}
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    done, counts = [], Counter()
    for key, text in docs:
        body = (" " + text).encode() if text else b""
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spans = [[], []]
        for side, table in enumerate((bytes_a, bytes_b)):
            at = 0
            for i in ids[side]:
                at += len(table[i])
                spans[side].append((at, i))
        if not text or any(b"".join(t[i] for i in x) != body for x, t in zip(ids, (bytes_a, bytes_b))):
            done.append((key, None))
            continue
        ends_b = dict(spans[1])
        links = [(i, ends_b[at]) for at, i in spans[0] if at in ends_b]
        counts.update(links)
        groups, held_a, rest = [], [], list(spans[1])
        for at, i in spans[0]:
            held_a.append(str(i))
            if at in ends_b:
                held_b = [str(j) for e, j in rest if e <= at]
                rest = [(e, j) for e, j in rest if e > at] if len(rest) < 400 else rest[len(held_b) :]
                groups.append(f"{','.join(held_a)}|{','.join(held_b)}")
                held_a = []
        done.append((key, (len(spans[0]), len(spans[1]), len(groups), links, ";".join(groups))))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(k, 0, 0, 0, 0, 0, 0, "") if f is None else (k, *f[:3], len(f[3]), sum(counts[p] == top[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), sha(f[4])) for k, f in done]


def test_op12_whole_table(spark, both):
    want = aligned(both, texts_of(spark.read.parquet(f"{SMALL}/documents.parquet")))
    got = alignment.op12_align_tokenizers(spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert tally(got.collect()) == tally(want) and any(0 < w[5] < w[4] for w in want)


FILES = bpe.tokenizer_path(), bpe.tokenizer_path("piece_bpe_32k.model")


def test_align_on_hard_rows(spark, hard, nothing, huge, both, monkeypatch):
    odd = ["a ", " a", "  a  b ", " ", "  ", "\n", "x\n y", "x \n y\n\n  z ", "a▁b", "▁", "ok ▁ then", "<s> </s><|endoftext|>", "\x00\x1c a\x85b \x1d c", "漢字 かな", "é 😀👍🏽", "don't  we'll 'S", "a  b　 c", "\t\t tab", "1 22 333  4444"]
    docs = spark.createDataFrame([*enumerate(odd), (3, "a "), (3, "a "), (None, "ok then"), (None, None)], "doc_id long, text string")
    for rows in (hard, docs, docs.unionByName(hard.select("doc_id", "text"))):
        assert tally(alignment.align(rows, *FILES).collect()) == tally(aligned(both, texts_of(rows)))
    assert alignment.align(nothing, *FILES).count() == 0 and alignment.align(nothing, *FILES).columns[0] == "doc_id"
    words = huge.filter("doc_id < 3")
    got = {r["doc_id"]: r for r in alignment.align(words, *FILES).collect()}
    text = dict(texts_of(words))[1]
    assert got[1]["n_a"] == len(both[0].encode(" " + text, add_special_tokens=False).ids) and got[1]["n_b"] == len(both[1].encode(text))


def test_alignment_starts_anew_and_sums_as_a_tree(spark, both, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    docs = spark.createDataFrame([(k, f"word{k % 7} and more{k % 3} text") for k in range(40)], "doc_id long, text string").repartition(7)
    want = tally(aligned(both, texts_of(docs)))
    assert tally(alignment.align(docs, *FILES).collect()) == want
    few = alignment.Aligner(*FILES)
    keys, counts = Counter(), 0
    for _, text in texts_of(docs):  # one text at a time, forgotten in between, counts the same
        (n,) = few.numbers([text])
        keys.update(dict(zip(*(x.tolist() for x in few.counts(np.bincount(n, minlength=len(few)))))))
        few.clear()
    known, found = alignment.pair_counts(docs, *FILES)
    assert keys == Counter(dict(zip(known.keys.tolist(), found.tolist())))


@given(st.sets(st.integers(0, 2**50), max_size=300))
def test_perfect_hash(keys):
    known = alignment.PerfectHash(np.array(sorted(keys), np.int64))
    assert sorted(known.find(np.array(sorted(keys), np.int64)).tolist()) == list(range(len(keys)))
    for other in (k + 1 for k in keys if k + 1 not in keys):
        with pytest.raises(KeyError):
            known.find(np.array([other]))


@given(st.lists(st.text(" a\nbé漢▁'1", min_size=1, max_size=20), min_size=1, max_size=4))
def test_chunks_keep_both_tokenizers_apart(both, texts):
    aligner = ALIGNER.setdefault("it", None) or ALIGNER.update(it=alignment.Aligner(*FILES)) or ALIGNER["it"]
    for text, n in zip(texts, aligner.numbers(texts, True)):
        want = aligned(both, [(0, text)])[0]
        assert (n is None) == (want[1] == 0)
        if n is not None:
            assert sha(";".join(aligner.groups[i] for i in n)) == want[7]


ALIGNER: dict = {}
