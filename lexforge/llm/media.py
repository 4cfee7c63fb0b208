"""Media columns in ISO base media containers.

`pack_media` stores a text's bytes as one track of unsigned 8-bit samples; `read_media` walks
the nested boxes of any such container, decodes its sample tables and gives codec, duration
and the byte ranges of keyframes and of all packets, without decoding a payload.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, short_batches

PACKET = 192
RATE = 8000
KEY_EVERY = 8
CHUNK = 16

_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


#: Deepest nesting of boxes that is read.
_DEEPEST = 32


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")


def pad(raw: bytes) -> bytes:
    """raw with bytes 32 appended up to a positive multiple of PACKET."""
    return raw + b" " * (-len(raw) % PACKET if raw else PACKET)


def pack(raw: bytes) -> bytes:
    """A container whose media data is pad(raw)."""
    payload = pad(raw)
    packets = len(payload) // PACKET
    ticks = len(payload)
    chunks = -(-packets // CHUNK)
    wide = len(payload) >= 1 << 31
    last = packets - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if last == CHUNK else [(1, last, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, last, 1)]
    keys = np.arange(1, packets + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    tables = (
        _full(b"stsd", struct.pack(">I", 1), entry)
        + _full(b"stts", struct.pack(">III", 1, packets, PACKET))
        + _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes())
        + _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs))
        + _full(b"stsz", struct.pack(">II", PACKET, packets))
    )

    def head(start: int) -> bytes:
        at = start + np.arange(chunks, dtype=np.int64) * (CHUNK * PACKET)
        offsets = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes())
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks & 0xFFFFFFFF, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), _box(b"stbl", tables, offsets)),
        )
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks & 0xFFFFFFFF), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        movie = _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, ticks & 0xFFFFFFFF), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _FTYP + _box(b"moov", movie, _box(b"trak", track, media))

    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return head(len(head(0)) + len(data)) + data + payload


def walk(raw: bytes, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path of box kinds, start and end of the content) of all boxes, depth first."""
    end = len(raw) if end is None else end
    if len(path) > _DEEPEST:
        raise ValueError("boxes nested too deep")
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        size = end - start if size == 0 else size
        if size < head or start + size > end:
            raise ValueError(f"broken box {kind!r} at {start}")
        yield (*path, kind), start + head, start + size
        if kind in _CONTAINERS:
            yield from walk(raw, start + head, start + size, (*path, kind))
        start += size


def tracks(raw: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """The boxes of each track by kind, those of one track never taken for another's."""
    out: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(raw):
        if path == (b"moov", b"trak"):
            out.append({})
        elif path[:2] == (b"moov", b"trak"):
            out[-1].setdefault(path[-1], (a, b))
    return out


def _table(raw: bytes, box: tuple[int, int], at: int, width: str, per: int = 1) -> np.ndarray:
    """The entries of a table that states their number; they must fit into their box."""
    a, b = box
    n = struct.unpack_from(">I", raw, a + at)[0]
    if a + at + 4 + n * per * int(width[-1]) > b:
        raise ValueError(f"table of {n} entries in a box of {b - a} bytes")
    return np.frombuffer(raw, width, n * per, a + at + 4).astype(np.int64).reshape(n, per)


def _sizes(raw: bytes, found: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Sizes of the samples (stsz or the compact stz2); no more of them than the file can hold."""
    if b"stz2" in found:
        a, b = found[b"stz2"]
        bits, n = raw[a + 7], struct.unpack_from(">I", raw, a + 8)[0]
        if bits not in (4, 8, 16) or a + 12 + (n * bits + 7) // 8 > b:
            raise ValueError("broken compact sizes")
        if bits == 4:
            pairs = np.frombuffer(raw, np.uint8, (n + 1) // 2, a + 12)
            return np.column_stack([pairs >> 4, pairs & 15]).ravel()[:n].astype(np.int64)
        return np.frombuffer(raw, f">u{bits // 8}", n, a + 12).astype(np.int64)
    a, _ = found[b"stsz"]
    one, n = struct.unpack_from(">II", raw, a + 4)
    if not one:
        return _table(raw, found[b"stsz"], 8, ">u4")[:, 0]
    if one * n > len(raw):
        raise ValueError(f"{n} samples of {one} bytes in {len(raw)} bytes")
    return np.full(n, one, np.int64)


def describe(raw: bytes, track: int = 0) -> dict:
    """Codec, seconds, offsets and sizes of a track's packets and which are keyframes.

    Counts are tested against the boxes and the file before anything is made by them.
    """
    every = tracks(raw)
    if track >= len(every):
        raise ValueError("no such track")
    found = every[track]
    a, _ = found[b"mdhd"]
    rate = struct.unpack_from(">I", raw, a + (20 if raw[a] else 12))[0]
    if not rate:
        raise ValueError("no time scale")
    codec = raw[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16].decode("latin-1")
    ticks = sum(n * each for n, each in _table(raw, found[b"stts"], 4, ">u4", 2).tolist())
    sizes = _sizes(raw, found)
    n = len(sizes)
    wide = b"co64" in found
    chunks = _table(raw, found[b"co64" if wide else b"stco"], 4, ">u8" if wide else ">u4")[:, 0]
    runs = _table(raw, found[b"stsc"], 4, ">u4", 3)
    length = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if n and (not len(runs) or runs[0, 0] != 1 or (length < 0).any()):
        raise ValueError("broken chunk runs")
    last = np.minimum(np.cumsum(np.minimum(np.repeat(runs[:, 1], length), n)), n)
    if n and (not len(last) or last[-1] < n):
        raise ValueError("chunks hold fewer samples than there are sizes")
    held = np.diff(last, prepend=0)
    total = np.concatenate([[0], np.cumsum(sizes)])
    offsets = np.repeat(chunks - total[last - held], held) + total[:-1]
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(raw)):
        raise ValueError("samples outside the file")
    keys = _table(raw, found[b"stss"], 4, ">u4")[:, 0] - 1 if b"stss" in found else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("keyframes outside the track")
    return {"codec": codec, "seconds": ticks / rate, "offsets": offsets, "sizes": sizes, "keys": keys}


def pack_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds media_col (binary): the container of each text as UTF-8 (null: empty).

    A column of that name is replaced; every row gives one; equal texts give equal bytes.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop(media_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).cast(pa.binary())
            media = pa.array([pack(x.as_py() or b"") for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, media], names=[*batch.schema.names, media_col])

    return docs.mapInArrow(run, extended(docs.schema, f"`{media_col}` binary"))


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds codec, duration (seconds), packets, keyframes (array of offset and size), payload
    (the packets' bytes in order) and media_error, all of the first track.

    Null or broken media, counts that their boxes or the file can't hold and movies in
    fragments only give nulls and an error; columns of these names are replaced; each row
    gives one; empty: empty.
    """
    names = ("codec", "duration", "packets", "keyframes", "payload", "media_error")
    media = media.drop(*names)
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for x in batch.column(batch.schema.names.index(media_col)):
                raw = x.as_py()
                try:
                    if raw is None:
                        raise ValueError("no media")
                    got = describe(raw)
                    at, size, keys = got["offsets"], got["sizes"], got["keys"]
                    cut = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
                    begin = np.concatenate([[0], cut]).astype(int) if len(at) else []
                    stop = np.concatenate([cut, [len(at)]]).astype(int) if len(at) else []
                    payload = b"".join(raw[at[i] : at[j - 1] + size[j - 1]] for i, j in zip(begin, stop, strict=True))
                    row = (got["codec"], got["seconds"], len(at), [{"offset": int(at[k]), "size": int(size[k])} for k in keys], payload, None)
                except (ValueError, KeyError, IndexError, OverflowError, struct.error) as error:
                    row = (None, None, None, None, None, f"{type(error).__name__}: {error}")
                for into, value in zip(out, row, strict=True):
                    into.append(value)
            kinds = (pa.string(), pa.float64(), pa.int64(), ranges, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=[*batch.schema.names, *names])

    ddl = "codec string, duration double, packets long, keyframes array<struct<offset:bigint,size:bigint>>, payload binary, media_error string"
    return media.mapInArrow(run, extended(media.schema, ddl))
