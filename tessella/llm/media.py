"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV files, expanded to 16-bit PCM and resampled."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SLICE_BYTES, slices, tidy

A_LAW, MU_LAW, ADPCM = 6, 7, 0x11

# Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def mu_law_table() -> np.ndarray:
    """PCM of each mu-law byte: inverted bits of sign, exponent and mantissa, biased by 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """PCM of each A-law byte: every other bit inverted, exponent 0 without the hidden bit."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """Samples of mono IMA ADPCM: a step at a time through the block, all blocks at once. A short last block ends early."""
    short = len(data) % block
    if short and short >= 4:
        return np.concatenate([decode_adpcm(data[: len(data) - short], block), decode_adpcm(data[-short:], short)])
    blocks = np.frombuffer(data[: len(data) - short], dtype=np.uint8).reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    out = np.empty((len(blocks), 1 + 2 * (block - 4)), dtype=np.int16)
    out[:, 0] = value
    for i in range(2 * (block - 4)):
        nibble = (blocks[:, 4 + i // 2] >> (4 * (i % 2))) & 15
        step, size = STEPS[index], nibble & 7
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX[size], 0, 88)
        out[:, i + 1] = value
    return out.reshape(-1)


def wav(samples: bytes, codec: int = MU_LAW, rate: int = 8000, block: int = 1) -> bytes:
    """A mono WAV file that holds coded samples as they are. Odd data gets the format's pad byte, which the length leaves out."""
    bits = 4 if codec == ADPCM else 8
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if codec == ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", codec, 1, rate, rate * bits // 8, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[int, int, int, bytes]:
    """(codec, rate, block size, coded samples). ValueError for anything but a mono WAV file of a telephony codec."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = data[at + 8 : at + 8 + size]
        elif name == b"data" and len(form) >= 16:
            codec, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", form)
            if channels != 1 or codec not in (A_LAW, MU_LAW, ADPCM) or codec == ADPCM and block < 5:
                raise ValueError("no mono telephony codec")
            return codec, rate, block, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def expand_all(files: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """16-bit samples of each (codec, block size, coded samples). Whole ADPCM blocks of one size are decoded together."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.int16)] * len(files)
    together: dict[int, list[int]] = {}
    for i, (codec, block, samples) in enumerate(files):
        if codec != ADPCM:
            out[i] = TABLES[codec][np.frombuffer(samples, dtype=np.uint8)]
        elif len(samples) % block:
            out[i] = decode_adpcm(samples, block)
        else:
            together.setdefault(block, []).append(i)
    for block, found in together.items():
        pcm = decode_adpcm(b"".join(files[i][2] for i in found), block)
        cuts = np.cumsum([len(files[i][2]) // block * (1 + 2 * (block - 4)) for i in found])[:-1]
        for i, part in zip(found, np.split(pcm, cuts), strict=True):
            out[i] = part
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate; doubling, the usual case, puts a mean between neighbours."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), dtype=np.int16)
        out[0::2], out[-1] = pcm, pcm[-1]
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        return out
    n = max(1, len(pcm) * to // rate)
    return np.interp(np.arange(n) * (rate / to), np.arange(len(pcm)), pcm).astype(np.int16)


def features(pcm: np.ndarray) -> str:
    """Samples, peak, mean square, zero crossings and a checksum of the resampled PCM."""
    wide = pcm.astype(np.int32)
    square = int((wide.astype(np.int64) ** 2).sum()) // max(len(pcm), 1)
    negative = pcm < 0
    crossings = int(np.count_nonzero(negative[1:] != negative[:-1]))
    return f"n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};ms={square};zc={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, filled with zero bytes to a positive multiple of `unit`, as the coded
    samples of a WAV file: of mu-law, A-law, or ADPCM with blocks of `unit` bytes, by a checksum of the bytes, so that equal texts are
    equal files. Null text is empty. Rows that repeat an id are stored each."""

    @tidy

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, files, held = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(doc)
                sizes.append(len(data))
                data = data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")
                codec = (MU_LAW, A_LAW, ADPCM)[zlib.crc32(data) % 3]
                files.append(wav(data, codec, block=unit if codec == ADPCM else 1))
                held += len(files[-1])
                if held > 4 << 20:
                    yield _stored(ids, sizes, files)
                    ids, sizes, files, held = [], [], [], 0
            yield _stored(ids, sizes, files)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def _stored(ids: list, sizes: list, files: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def decode_telephony(media: DataFrame, *, media_col: str = "media", rate: int = 16_000, keep_pcm: bool = True) -> DataFrame:
    """Every row of media without its file, with the columns codec, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes),
    media_bytes, media_sha256, feature and, with keep_pcm, pcm: little-endian 16-bit samples at `rate`.

    A null file or one that is no mono telephony WAV gives nulls in the columns that need its samples.
    """
    names = [c for c in media.columns if c != media_col]
    schema = media.select(*names).schema
    kinds = {"codec": "integer", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"} | ({"pcm": "binary"} if keep_pcm else {})
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    arrow = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def some(files: list[bytes | None]) -> list[dict]:
        rows = [{} if x is None else {"media_bytes": len(x), "media_sha256": hashlib.sha256(x).hexdigest()} for x in files]
        found = []
        for row, data in zip(rows, files, strict=True):
            try:
                if data is not None:
                    found.append((row, *read_wav(data)))
            except (ValueError, struct.error):
                continue
        for (row, codec, own, _, samples), wide in zip(found, expand_all([(c, b, s) for _, c, _, b, s in found]), strict=True):
            pcm = resample(wide, own, rate)
            row |= {"codec": codec, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-64:]), "feature": features(pcm)}
            row |= {"pcm": pcm.astype("<i2").tobytes()} if keep_pcm else {}
        return rows

    @tidy

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(media_col), SLICE_BYTES // 2):
                part = batch.slice(a, b - a)
                rows = some(part.column(media_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array([r.get(c) for r in rows], arrow[k]) for c, k in kinds.items())], names=[*names, *kinds])

    return media.mapInArrow(work, schema)
