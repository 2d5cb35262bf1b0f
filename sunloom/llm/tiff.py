"""Media columns: TIFF.

``read_tiff`` walks the image directories of a binary column, decodes uncompressed, PackBits, LZW and deflate strips
and tiles of 1-, 2-, 4-, 8-, 16- or 32-bit samples, undoes the horizontal and the floating-point predictor and emits one
row per page. ``write_tiff`` stores bytes as RGB pages of 8-bit samples. Files are handled row by row; a page that is
damaged or not read gives a row with its error, as does a damaged file.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Fixed values of the format: field types' sizes and struct codes, and tag numbers.
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 13: (4, "I")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 266, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """PackBits, up to the run that reaches most bytes."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and (most is None or len(out) < most):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            if i + 1 >= n:
                raise TiffError("a PackBits run ends early")
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(row: bytes) -> bytes:
    """Runs of three to 128 as runs, the rest as literals."""
    out, at = bytearray(), 0

    def literals(end: int) -> None:
        for i in range(at, end, 128):
            piece = row[i : min(i + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for run in _RUN.finditer(row):
        literals(run.start())
        out.extend((257 - len(run[0]), run[0][0]))
        at = run.end()
    literals(len(row))
    return bytes(out)


def _lzw_widths(places: np.ndarray) -> np.ndarray:
    """Widths of codes by their place behind the last clear code: 9 to 12 bits, widened one code early."""
    known = 258 + np.maximum(places - 1, 0)  # entries when the code is read: each code but the first made one
    return 9 + (known >= 511) + (known >= 1023) + (known >= 2047)


def unpack_lzw(data: bytes, most: int | None = None) -> bytes:
    """TIFF's LZW, up to the code that reaches most bytes: codes most significant bit first; 256 clears, 257 ends.

    Codes are read a table's worth at a time.
    """
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    raw = np.frombuffer(data + bytes(3), "u1").astype(np.int64)
    windows, end = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:], 8 * len(data)
    out: list[bytes] = []
    table, last, place, at, size = list(first), b"", 0, 0, 0
    while True:
        widths = _lzw_widths(np.arange(place, place + 4096))
        starts = at + np.cumsum(widths) - widths
        n = int(np.searchsorted(starts + widths, end, side="right"))
        codes = (windows[starts[:n] >> 3] >> 24 - (starts[:n] & 7) - widths[:n]) & (1 << widths[:n]) - 1
        marks = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(marks[0]) if len(marks) else n
        for code in codes[:stop].tolist():
            if code < len(table):
                word = table[code]
            elif code == len(table) and last:
                word = last + last[:1]
            else:
                raise TiffError("an LZW code is out of its table")
            out.append(word)
            if last:
                table.append(last + word[:1])
            last = word
            size += len(word)
            if most is not None and size >= most:
                return b"".join(out)
        if len(marks) and codes[stop] == 256:
            table, last, place, at = list(first), b"", 0, int(starts[stop] + widths[stop])
        elif len(marks) or n < 4096:  # the end, or no whole code is left
            return b"".join(out)
        else:
            place, at = place + n, int(starts[n - 1] + widths[n - 1])


#: Codes of a table: with so many behind a clear code every code stays within 12 bits.
LZW_CODES = 3836


def pack_lzw(data: bytes) -> bytes:
    """TIFF's LZW of data; widths follow from each code's place behind its clear code, so bits are laid out at once."""
    codes, places, size = [256], [0], 0
    table: dict[int, int] = {}
    word, find = data[0] if data else -1, table.get
    for c in data[1:]:
        longer = find(word << 8 | c)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        places.append(size)
        table[word << 8 | c] = 258 + size
        word, size = c, size + 1
        if size == LZW_CODES:
            codes.append(256)
            places.append(size)
            size = 0
            table.clear()
    if word >= 0:
        codes.append(word)
        places.append(size)
        size += 1
    codes.append(257)
    places.append(size)
    widths = _lzw_widths(np.array(places))
    at = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
    bits = np.repeat(np.array(codes), widths) >> (np.repeat(widths, widths) - 1 - at) & 1
    return np.packbits(bits.astype("u1")).tobytes()


def _inflate(data: bytes, most: int | None = None) -> bytes:
    """Deflate, up to most bytes."""
    try:
        stream = zlib.decompressobj()
        out = stream.decompress(data, most or 0)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None
    if not stream.eof and (most is None or len(out) < most):
        raise TiffError("deflate: the stream ends early")
    return out


def _stored(data: bytes, most: int | None = None) -> bytes:
    return data[:most]


#: Bytes that one stored byte can stand for at most: a run of two for 128, a code of 12 bits for a table, deflate's own bound.
GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
DECODERS = {NONE: _stored, LZW: unpack_lzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}


def _tags(data: bytes, order: str, at: int, n: int) -> dict[int, tuple]:
    """The n tags of the directory at an offset."""
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in TYPES:
            size, code = TYPES[kind]
            place = at + 10 + 12 * i
            if size * count > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if size * count > len(data):
                raise TiffError(f"tag {tag} is longer than the file")
            try:
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
            except struct.error:
                raise TiffError(f"tag {tag} lies outside the file") from None
    return tags


def walk(data: bytes) -> list[dict[int, tuple] | TiffError]:
    """The tags of every image directory, in order, or what is wrong with it; one outside the file is the last.

    Without a first directory, and where directories form a loop, the file is in error.
    """
    order, found, seen = {b"II": "<", b"MM": ">"}.get(data[:2]), [], set()
    try:
        if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise TiffError("not a TIFF header")
        at = struct.unpack_from(order + "I", data, 4)[0]
        while at:
            if at in seen:
                raise TiffError("the image directories form a loop")
            seen.add(at)
            n = struct.unpack_from(order + "H", data, at)[0]
            after = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
            try:
                found.append(_tags(data, order, at, n))
            except TiffError as e:
                found.append(e)
            at = after
    except struct.error:
        found.append(TiffError("a directory lies outside the file"))
        if len(found) == 1:
            raise found[0] from None
    if not found:
        raise TiffError("no image directory")
    return found


def directories(data: bytes) -> list[dict[int, tuple]]:
    """The tags of every image directory, in order; an error if any has one."""
    found = walk(data)
    for tags in found:
        if isinstance(tags, TiffError):
            raise tags
    return found


#: Bytes with their bits in reverse, for fill order 2.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _samples(raw: bytes, rows: int, wide: int, deep: int, bits: int, predictor: int, kind: np.dtype) -> np.ndarray:
    """(rows, wide, deep) of a decoded strip or tile; rows of samples under a byte are filled up to whole bytes."""
    line = -(-wide * deep * bits // 8)
    if len(raw) < rows * line:
        raise TiffError("a strip or tile ends early")
    lines = np.frombuffer(raw, "u1", rows * line).reshape(rows, line)
    if bits < 8:
        spread = np.unpackbits(lines, axis=1)[:, : wide * deep * bits].reshape(rows, wide, deep, bits)
        return (spread << np.arange(bits - 1, -1, -1, dtype="u1")).sum(axis=3, dtype="u1")
    if predictor == 3:
        # differences of bytes, one pixel's samples apart, over planes of bytes from the most to the least significant
        planes = np.cumsum(lines.reshape(rows, -1, deep), axis=1, dtype="u1").reshape(rows, bits // 8, wide * deep)
        values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{bits // 8}")
        return values.reshape(rows, wide, deep).astype(kind)
    block = np.frombuffer(raw, kind, rows * wide * deep).reshape(rows, wide, deep)
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")).astype(kind) if predictor == 2 else block


def decode_page(data: bytes, tags: dict[int, tuple]) -> tuple[dict, bytes]:
    """What the page's tags say, and its samples: row by row, the samples of a pixel side by side.

    A sample under 8 bits is a byte; others are in the file's byte order. Sizes are held against what the strips or tiles
    can stand for before anything of that size is made, and no more is decoded than the page takes.
    """
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, samples, planar = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(PLANAR, 1)
    bits, compression, predictor = set(tags.get(BITS, (1,))), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if not width or not height or min(width, height, samples) < 1:
        raise TiffError("a page without size")
    known = len(bits) == 1 and bits <= {1, 2, 4, 8, 16, 32} and compression in DECODERS and planar in (1, 2)
    if not known or predictor not in (1, 2, 3) or predictor == 2 and min(bits) < 8 or predictor == 3 and min(bits) < 16:
        raise TiffError(f"not read: bits {sorted(bits)}, compression {compression}, predictor {predictor}, planar {planar}")
    kind = np.dtype(("<" if data[:2] == b"II" else ">") + f"u{max(1, min(bits) // 8)}")
    tiled = TILE_OFFSETS in tags
    offsets, sizes = (tags.get(TILE_OFFSETS), tags.get(TILE_BYTES)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_BYTES))
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not offsets or not sizes or not bw or not bh or min(bw, bh) < 1 or min(*offsets, *sizes, 0) < 0:
        raise TiffError("a page without strips or tiles")
    across, down = -(-width // bw), -(-height // bh)
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes or len(sizes) < len(offsets):
        raise TiffError("strips or tiles are missing")
    line = -(-bw * deep * min(bits) // 8)
    parts = [data[o : o + n] for o, n in zip(offsets[: across * down * planes], sizes)]
    if any(len(p) * GROWTH[compression] < line * (bh if tiled else min(bh, height - k % down * bh)) for k, p in enumerate(parts)):
        raise TiffError("a strip or tile is too short for its size")
    page = np.zeros((height, width, samples), kind)
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        y, x = (v * s for v, s in zip(divmod(rest, across), (bh, bw)))
        rows = bh if tiled else min(bh, height - y)
        stored = parts[k].translate(REVERSED) if one(FILL_ORDER, 1) == 2 else parts[k]
        raw = DECODERS[compression](stored, rows * line)
        block = _samples(raw, rows, bw, deep, min(bits), predictor, kind)
        part = block[: height - y, : width - x]
        page[y : y + part.shape[0], x : x + part.shape[1], plane : plane + deep] = part
    return {"width": width, "height": height, "samples": samples, "bits": min(bits), "compression": compression, "predictor": predictor, "tiled": tiled}, page.tobytes()


PIXELS, SAMPLES_PER_PIXEL = 64, 3
ROW = PIXELS * SAMPLES_PER_PIXEL
STRIP_ROWS, TILE_ROWS = 128, 16
CODECS = (PACKBITS, LZW, DEFLATE)


def encode(payload: bytes) -> bytes:
    """One RGB page, 64 pixels wide, of a payload of whole rows (192 bytes each).

    The payload's CRC chooses between PackBits, LZW and deflate and between strips and tiles, whatever its size. Deflate
    comes with the horizontal predictor; LZW without, as differences of text repeat too little for its table.
    """
    if not payload or len(payload) % ROW:
        raise ValueError(f"a payload is a positive multiple of {ROW} bytes")
    rows, choice = len(payload) // ROW, zlib.crc32(payload)
    page = np.frombuffer(payload, "u1").reshape(rows, PIXELS, SAMPLES_PER_PIXEL)
    codec, tiled = CODECS[choice % 3], choice // 3 % 2 == 1
    step = TILE_ROWS if tiled else STRIP_ROWS
    blocks = []
    for y in range(0, rows, step):
        block = page[y : y + step]
        if tiled and len(block) < step:
            block = np.concatenate([block, np.zeros((step - len(block), *block.shape[1:]), "u1")])
        if codec == PACKBITS:
            blocks.append(b"".join(pack_bits(r.tobytes()) for r in block))
            continue
        if codec == LZW:
            blocks.append(pack_lzw(block.tobytes()))
            continue
        differences = block.copy()
        differences[:, 1:] -= block[:, :-1]
        blocks.append(zlib.compress(differences.tobytes(), 6))
    tags = {WIDTH: [PIXELS], HEIGHT: [rows], BITS: [8] * SAMPLES_PER_PIXEL, COMPRESSION: [codec], PHOTOMETRIC: [2], SAMPLES: [SAMPLES_PER_PIXEL], PLANAR: [1], PREDICTOR: [2 if codec == DEFLATE else 1]}
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b) + len(b) % 2
    sizes = [len(b) for b in blocks]
    tags |= {TILE_WIDTH: [PIXELS], TILE_HEIGHT: [TILE_ROWS], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tiled else {ROWS_PER_STRIP: [min(STRIP_ROWS, rows)], STRIP_OFFSETS: offsets, STRIP_BYTES: sizes}
    body = b"".join(b + b"\0" * (len(b) % 2) for b in blocks)
    entries, extra, base = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        values = tags[tag]
        short = tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR)
        packed_values = struct.pack(f"<{len(values)}{'H' if short else 'I'}", *values)
        entries += struct.pack("<HHI", tag, 3 if short else 4, len(values))
        if len(packed_values) <= 4:
            entries += packed_values.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", base + len(extra))
            extra += packed_values + b"\0" * (len(packed_values) % 2)
    return b"II" + struct.pack("<HI", 42, at) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def feature(samples: bytes) -> str:
    """Mean and deviation of the samples, and an 8 x 8 average hash of them, as text."""
    values = np.frombuffer(samples, "u1")
    if not len(values):
        return ""
    if len(values) < 64:
        values = np.resize(values, 64)
    edges = np.arange(64) * len(values) // 64
    sums = np.add.reduceat(values, edges, dtype=np.int64)
    means = sums / np.diff(np.append(edges, len(values)))
    bits = np.packbits(means > values.mean()).tobytes().hex()
    return f"{values.mean():.3f}:{values.std():.3f}:{bits}"


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, feature string, error string"


def read_tiff(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for every page of every file: key, PAGE's columns.

    data: the page's samples, row by row. A page that is damaged or not read gives a row of its number with its error, and
    the pages after it are given; a null or damaged file gives one row of page null with its error. No file ends the query:
    whatever a page's decoding raises is that page's error. Repeated rows stay repeated; other columns are dropped; an
    empty table gives none.
    """
    names = ("width", "height", "samples", "bits", "compression", "predictor", "tiled")

    def body(keys, files):
        for k, data in zip(keys, files):
            try:
                if data is None:
                    raise TiffError("no file")
                found = walk(data)
            except Exception as e:  # a damaged file is a row, whatever is wrong with it
                yield k, None, *[None] * 9, str(e) or type(e).__name__
                continue
            for p, tags in enumerate(found):
                try:
                    if isinstance(tags, TiffError):
                        raise tags
                    about, samples = decode_page(data, tags)
                except Exception as e:  # and so is a damaged page
                    yield k, p, *[None] * 9, str(e) or type(e).__name__
                else:
                    yield k, p, *[about[n] for n in names], samples, feature(samples), None

    return map_rows(df.withColumns({"__key": F.col(key), "__media": F.col(media)}), ["__key", "__media"], f"{key} {dict(df.dtypes)[key]}, {PAGE}", body)


def write_tiff(df: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """key and media: each payload as a TIFF file; null stays null.

    A payload is a positive number of whole rows (192 bytes); another one raises. Repeated rows stay repeated and equal
    payloads give equal files; other columns are dropped; an empty table gives none.
    """

    def body(keys, payloads):
        return [(k, None if p is None else encode(p)) for k, p in zip(keys, payloads)]

    return map_rows(df.withColumns({"__key": F.col(key), "__payload": F.col(payload)}), ["__key", "__payload"], f"{key} {dict(df.dtypes)[key]}, media binary", body)


def op6_media_tiff(spark, sf_dir: str) -> DataFrame:
    """Every document's text as the samples of a TIFF page, read back: lengths, digests and a feature. Null texts are empty, so one row of blanks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    whole = F.greatest(F.lit(ROW), F.ceil(size / ROW) * ROW).cast("int")
    # the key carries what the files' rows need to keep: id, unpadded length, the stored form's length and digest
    stored = write_tiff(docs.select(F.struct("doc_id", size.cast("long").alias("n_bytes")).alias("key"), F.rpad(raw, whole, F.lit(b" ")).alias("payload")), "key")
    kept = F.struct("key.*", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = read_tiff(stored.select(kept.alias("key"), "media"), "key")
    return pages.select(
        "key.doc_id", "key.n_bytes", F.length("data").cast("long").alias("payload_bytes"), F.sha2("data", 256).alias("payload_sha256"),
        F.crc32(F.substring("data", -16, 16)).alias("tail_crc32"), "key.media_bytes", "key.media_sha256", "feature", "page", "compression", "tiled",
    )
