"""Damaged image files: each gives its rows and none ends a query; hard rows through both directions; digests of the query."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import tiff

from .conftest import SMALL


def payload(n, seed=0):
    rng = random.Random(seed)
    return bytes(rng.choice(b"abcdefgh  \n") for _ in range(192 * n))


FILES = [tiff.encode(payload(n, seed)) for seed, n in enumerate([1, 2, 3, 17, 40, 130, 5, 9, 21, 33, 50, 64])]


def entries(data):
    """Places of the entries of the first directory."""
    at = struct.unpack_from("<I", data, 4)[0]
    return [at + 2 + 12 * i for i in range(struct.unpack_from("<H", data, at)[0])]


def changed():
    """Every tag of every file with every odd value, type and count; then files cut, and bytes changed anywhere."""
    odd = [0, 1, 2, 3, 7, 255, 256, 65_535, 65_536, 2**31 - 1, 2**31, 2**32 - 1]
    for data in FILES:
        for at in entries(data):
            for v in odd:
                yield data[: at + 8] + struct.pack("<I", v) + data[at + 12 :]
                yield data[: at + 4] + struct.pack("<I", v) + data[at + 8 :]
            for kind in (0, 1, 6, 8, 9, 13, 99):
                yield data[: at + 2] + struct.pack("<H", kind) + data[at + 4 :]
                yield data[: at + 2] + struct.pack("<HII", kind, 1, 2**32 - 5) + data[at + 12 :]
    rng = random.Random(9)
    for data in FILES:
        for _ in range(40):
            yield data[: rng.randrange(len(data))]
            body = bytearray(data)
            for _ in range(rng.choice((1, 3, 9))):
                body[rng.randrange(len(body))] = rng.randrange(256)
            yield bytes(body)
    for w, h in ((2**32 - 1, 2**32 - 1), (2**32 - 1, 1), (1, 2**32 - 1), (2**31, 2**31)):
        for data in FILES:
            body = bytearray(data)
            for at in entries(data):
                tag = struct.unpack_from("<H", data, at)[0]
                if tag in (tiff.WIDTH, tiff.HEIGHT, tiff.ROWS_PER_STRIP, tiff.TILE_WIDTH, tiff.TILE_HEIGHT):
                    struct.pack_into("<HHII", body, at, tag, 4, 1, w if tag in (tiff.WIDTH, tiff.TILE_WIDTH) else h)
            yield bytes(body)


def test_no_file_ends_a_query(spark):
    files = [*changed(), b"", b"II", b"MM\x00\x2a", b"II*\x00" + b"\xff" * 4]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "doc_id long, media binary").repartition(8)
    rows = tiff.read_tiff(df).select("doc_id", "page", "error", F.length("data").alias("n"), "width", "height", "samples", "bits").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["doc_id"], []).append(r)
    assert by_file.keys() == set(range(len(files))) and len(files) > 3000
    for found in by_file.values():
        assert [r["page"] for r in found] == (list(range(len(found))) if found[0]["page"] is not None else [None])
        for r in found:
            assert (r["error"] is None) != (r["n"] is None) and r["error"] != ""
            assert r["n"] is None or r["n"] == r["width"] * r["height"] * r["samples"] * max(1, r["bits"] // 8)
    assert sum(r["error"] is None for r in rows) > 200 and sum(r["error"] is not None for r in rows) > 1000


def test_bombs_are_not_decoded_beyond_the_page():
    """A deflate strip that goes on for a gigabyte behind a page of one row; a page that no strip could hold."""
    stream = zlib.compressobj(9)
    long = stream.compress(bytes(192)) + b"".join(stream.compress(bytes(1 << 20)) for _ in range(64)) + stream.flush()
    tags = {tiff.WIDTH: (64,), tiff.HEIGHT: (1,), tiff.BITS: (8, 8, 8), tiff.COMPRESSION: (tiff.DEFLATE,), tiff.SAMPLES: (3,), tiff.STRIP_OFFSETS: (8,), tiff.STRIP_BYTES: (len(long),)}
    assert tiff.decode_page(b"II*\0\0\0\0\0" + long, tags)[1] == bytes(192)
    for width, height, bits in ((2**20, 2**20, 8), (2**32 - 1, 1, 32), (1, 2**32 - 1, 16)):
        with pytest.raises(tiff.TiffError):
            tiff.decode_page(b"II*\0\0\0\0\0" + long, {**tags, tiff.WIDTH: (width,), tiff.HEIGHT: (height,), tiff.BITS: (bits,) * 3})


@pytest.mark.parametrize("codec", [tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_decoders_stop_at_what_is_wanted(codec):
    data = payload(30, 4)
    packed = {tiff.PACKBITS: tiff.pack_bits, tiff.LZW: tiff.pack_lzw, tiff.DEFLATE: zlib.compress}[codec](data)
    for most in (1, 500, len(data) - 1, len(data)):
        found = tiff.DECODERS[codec](packed, most)
        assert found[:most] == data[:most] and len(found) <= most + 4096


def test_hard_rows_make_the_round_trip(spark, hard, nothing, huge):
    def stored(df):
        raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
        whole = F.greatest(F.lit(192), F.ceil(F.octet_length(raw) / 192) * 192).cast("int")
        return tiff.write_tiff(df.withColumn("payload", F.rpad(raw, whole, F.lit(b" "))))

    for df in (hard, huge.filter("doc_id < 3")):
        pages = tiff.read_tiff(stored(df)).select("doc_id", "page", "error", F.sha2("data", 256).alias("h")).collect()
        want = []
        for r in df.select("doc_id", "text").collect():
            raw = (r["text"] or "").encode()
            want.append((r["doc_id"], 0, None, hashlib.sha256(raw.ljust(max(192, -(-len(raw) // 192) * 192))).hexdigest()))
        assert sorted(map(str, map(tuple, pages))) == sorted(map(str, want))
    assert stored(nothing).count() == 0 and tiff.read_tiff(stored(nothing)).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, b"x" * 192), (1, None)], "doc_id long, payload binary")
    assert sorted((r["doc_id"] or 0, r["error"]) for r in tiff.read_tiff(tiff.write_tiff(nulls)).collect()) == [(0, None), (1, "no file"), (1, "no file")]


def test_op6_stored_form_and_feature(spark):
    rows = tiff.op6_media_tiff(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        whole = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        stored = tiff.encode(whole)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        values = np.frombuffer(whole, "u1").astype(float)
        mean, spread, bits = r["feature"].split(":")
        edges = [i * len(values) // 64 for i in range(65)]
        plain = "".join("1" if values[a:b].mean() > values.mean() else "0" for a, b in zip(edges, edges[1:]))
        assert (float(mean), float(spread)) == (pytest.approx(values.mean(), abs=6e-4), pytest.approx(values.std(), abs=6e-4)) and int(bits, 16) == int(plain, 2)
