"""The corpus pipeline against a plain version of every stage, over whole tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from sunloom.llm import mixing, packing, secrets

from .conftest import SMALL
from .test_packing_mixing import check_packing
from .test_rows import brute_measures
from .test_simhash import brute_components, overlap, parts


def clean(text):
    words, chars, symbols, repeated_lines, repeated_words = brute_measures(text)
    lines = sum(1 for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
    return not (
        words < 20 or 100 * repeated_words > 30 * words or 5 * symbols > chars or lines >= 4 and 10 * repeated_lines > 3 * lines
        or chars > 25 * words or chars < 2 * words or 10 * symbols > max(4 * words, chars)
    )


def brute_copies(docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs)[["doc_id", "source", "text"]])
    return {r[0]: r[1] for r in con.sql(f"SELECT doc_id, copies FROM ({mixing.OP3_SQL})").fetchall()}


def test_run_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    kept = [d for d in docs if clean(d["text"])]
    assert 0 < len(kept) < len(docs)
    classes = brute_components([(d["doc_id"], parts(d["text"])) for d in kept], lambda a, b: overlap(a[1], b[1]) >= 0.8)
    single = [d for d, c in zip(kept, classes) if d["doc_id"] == c]
    assert len(single) < len(kept)
    redacted = [d | {"text": secrets.redact(d["text"], secrets.find_secrets(d["text"]))} for d in single]
    copies, tokenizer, want = brute_copies(redacted), Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for d in redacted:
        ids = np.array([*tokenizer.encode(d["text"], add_special_tokens=False).ids, packing.END], "<u4")
        for at in range(0, len(ids), packing.LENGTH):
            piece = ids[at : at + packing.LENGTH]
            want[d["doc_id"], at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += copies[d["doc_id"]]
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == +want
    check_packing(rows)


@pytest.mark.parametrize("table", ["hard", "nothing"])
def test_stages_take_hard_rows(spark, table, request):
    docs = request.getfixturevalue(table)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        # each stage is given the hard rows themselves, not what stages before leave of them
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() <= 3 * docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert (out.count() > 0) == (table == "hard")


def test_stages_take_megabytes(spark, huge):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, huge, SMALL).collect()
        ids = sorted({r["doc_id"] for r in out})
        # few words fail a rule; equal texts and one that holds three quarters of them are one; the mix takes each text that has words
        assert ids == ([1, 3, 4] if name == "quality_rules" else [1, 2] if name == "near_dedup" else [1, 2, 3, 4] if name == "secret_scan" else ids)
    assert corpus_pipeline.STAGES[-1][1](spark, huge, SMALL).count() > 1000


def test_run_leaves_one_stage_table(spark):
    from pathlib import Path

    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.glob("pipeline-*"))
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    (new,) = set(folder.glob("pipeline-*")) - before
    assert [x.name for x in new.iterdir()] == ["mix_sources"]


def test_packed_rows_hold_the_ids(spark):
    """Each document's ids, put together again from the sequences they were packed into, are the tokenizer's."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(300)
    rows = corpus_pipeline.stage_pack(spark, docs, SMALL).collect()
    sequences, found = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], np.zeros(packing.LENGTH, "<u4"))[r["offset"] : r["offset"] + r["length"]] = ids
    for r in sorted(rows, key=lambda r: r["start"]):
        found.setdefault(r["doc_id"], []).extend(sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tolist())
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = {d["doc_id"]: [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, packing.END] for d in docs.collect()}
    assert found == want


def test_redaction_leaves_no_base_secret(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.stage_secrets(spark, docs, SMALL).collect():
        text = r["text"]
        assert r["n_chars"] == len(text) and not any(s[0] != "guess" for s in secrets.find_secrets(text) if "[SECRET]" not in text[s[1] : s[2]])
        assert text == before[r["doc_id"]] or "[SECRET]" in text
