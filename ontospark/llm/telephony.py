"""Media columns: telephony audio.

mu-law and A-law are expanded by tables of 256 entries, IMA ADPCM is decoded block-wise with numpy,
one step for all blocks of a batch at a time. Media are WAV bytes in a binary column;
decoded PCM has 16 bits. ``resampled`` adds it at another rate, by a windowed-sinc filter in polyphase form that runs over all
media of a batch at once, as a column; ``features`` describes that column, stored or as it comes.

Defined cases: null audio gives null PCM and null features; audio that isn't such a WAV raises; a last
ADPCM block that is cut off raises; step indexes over 88 count as 88; empty data gives
empty PCM, whose features are zero; other columns are kept, and a column of the name that is added is replaced; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

RATE = 8000
#: Format tags of WAV.
ALAW, MULAW, IMA = 6, 7, 17
#: Rate of the PCM that ``decoded`` and ``resampled`` make, above that of the media: no sample is lost.
PCM_RATE = 16000
#: Zero crossings of the sinc on each side, at the lower of both rates.
WINGS = 8
#: Bytes of data in an ADPCM block after its 4-byte header; 576 bytes make four blocks.
UNIT = 144


def mulaw_table() -> np.ndarray:
    """ITU-T G.711: sign, three bits of exponent, four of mantissa, all inverted."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """ITU-T G.711: even bits inverted; the first two segments are linear."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """Fixed values of IMA ADPCM: 89 step sizes."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


MU, A, STEPS = mulaw_table(), alaw_table(), ima_steps()
#: Fixed values of IMA ADPCM: how a code moves the step index.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(blocks × align) bytes to (blocks × samples); the loop is over a block's codes, each step over all blocks."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    body = blocks[:, 4:]
    codes = np.empty((body.shape[1] * 2, len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = body.T & 0x0F, body.T >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for i, code in enumerate(codes):
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + MOVES[code], 0, 88)
        out[i + 1] = value
    return np.ascontiguousarray(out.T)


def wav(tag: int, payload: bytes, rate: int = RATE, unit: int = UNIT) -> bytes:
    """A mono WAV file of 8-bit mu-law or A-law samples, or of ADPCM blocks of ``unit`` payload bytes after a zero header."""
    if tag == IMA:
        body = np.frombuffer(payload, np.uint8).reshape(-1, unit)
        data = np.concatenate([np.zeros((len(body), 4), np.uint8), body], axis=1).tobytes()
        samples, align, bits = len(body) * (1 + 2 * unit), unit + 4, 4
        extra = struct.pack("<HH", 2, 1 + 2 * unit)
    else:
        data, samples, align, bits, extra = payload, len(payload), 1, 8, struct.pack("<H", 0)
    speed = rate * align // (1 + 2 * unit) if tag == IMA else rate
    fmt = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    chunks += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, rate, block align, data) of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found[name] = memoryview(media)[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if channels != 1 or tag not in (ALAW, MULAW, IMA):
        raise ValueError(f"format {tag} with {channels} channels isn't telephony audio")
    return tag, rate, align, found[b"data"]


def payload_of(media: bytes) -> bytes:
    """The bytes that ``wav`` was given."""
    tag, _, align, data = parse_wav(media)
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes() if tag == IMA else bytes(data)


def decode_all(media: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """(rate, 16-bit samples) of each; all ADPCM blocks of the list are decoded together."""
    out: list = [None] * len(media)
    blocks: dict[int, list] = {}
    for i, m in enumerate(media):
        if m is None:
            continue
        tag, rate, align, data = parse_wav(m)
        raw = np.frombuffer(data, np.uint8)
        if tag == IMA:
            if len(raw) % align:
                raise ValueError("the last ADPCM block is cut off")
            blocks.setdefault(align, []).append((i, rate, raw.reshape(-1, align)))
        else:
            out[i] = rate, (MU if tag == MULAW else A)[raw]
    for own in blocks.values():
        pcm = decode_ima(np.concatenate([b for *_, b in own]))
        at = 0
        for i, rate, b in own:
            out[i] = rate, pcm[at : at + len(b)].reshape(-1)
            at += len(b)
    return out


def kernel(up: int, down: int) -> np.ndarray:
    """(phases × taps): a sinc cut off at the lower rate under a Hann window, each phase of sum 1; tap k is sample k - wing from the base."""
    cut = min(1.0, up / down)
    wing = math.ceil(WINGS / cut)
    x = np.arange(-wing, wing + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.where(np.abs(x) < wing, 0.5 + 0.5 * np.cos(np.pi * x / wing), 0.0)
    taps = np.sinc(x * cut) * window
    return taps / taps.sum(axis=1, keepdims=True)


def resample_all(pcm: list[np.ndarray], rate: int, to: int) -> list[np.ndarray]:
    """Each signal at rate ``to``: ceil(n · to / rate) samples; beyond its ends it counts as silence."""
    if rate == to or not pcm:
        return pcm
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    taps = kernel(up, down)
    wing = taps.shape[1] // 2
    # all signals in one array, each from a multiple of `down` on, silence of a wing at least between them
    sizes = np.array([len(x) for x in pcm], np.int64)
    starts = wing + np.concatenate([[0], np.cumsum((sizes + wing + down - 1) // down * down)])
    line = np.zeros(int(starts[-1]) + 2 * wing + down, np.float32)
    for s, x in zip(starts, pcm, strict=False):
        line[s : s + len(x)] = x
    frames = int(starts[-1] - wing) // down + 1
    out = np.zeros((frames, up))
    for phase in range(up):
        at = phase * down // up  # output frame·up + phase lies this many samples after frame·down
        row = taps[phase * down % up]
        for k in range(taps.shape[1]):
            first = at + k
            piece = line[first : first + (frames - 1) * down + 1 : down]
            out[: len(piece), phase] += row[k] * piece
    flat = np.clip(np.rint(out.reshape(-1)), -32768, 32767).astype(np.int16)
    begins = (starts[:-1] - wing) // down * up
    return [flat[b : b + n] for b, n in zip(begins.tolist(), (-(-sizes * up // down)).tolist(), strict=True)]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    return resample_all([pcm], rate, to)[0]


def pcm_of(media: list[bytes | None], to: int) -> list[np.ndarray | None]:
    """The decoded media at rate ``to``."""
    decoded, out = decode_all(media), [None] * len(media)
    for rate in {x[0] for x in decoded if x is not None}:
        own = [i for i, x in enumerate(decoded) if x is not None and x[0] == rate]
        for i, x in zip(own, resample_all([decoded[i][1] for i in own], rate, to), strict=True):
            out[i] = x
    return out


def resampled(media: DataFrame, column: str = "media", to: int = PCM_RATE, batch_bytes: int = 4 << 20) -> DataFrame:
    """Adds ``pcm`` (little-endian 16-bit samples at rate ``to``) to a table with WAV bytes in ``column``; a column ``pcm`` of its own is replaced."""
    ship(media.sparkSession)
    kept = [c for c in media.columns if c.lower() != "pcm"]
    rows = media.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{column}`").alias("media"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", batch_bytes):
            pcm = [None if x is None else x.astype("<i2").tobytes() for x in pcm_of(batch.column(1).to_pylist(), to)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pcm, pa.binary())], ["row", "pcm"])

    return rows.mapInArrow(decode, f"row {rows.schema['row'].dataType.simpleString()}, pcm binary").select("row.*", "pcm")


def stored(docs: DataFrame, multiple: int = 4 * UNIT) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's bytes, filled up with 255, as mu-law, A-law or ADPCM audio; the payload's checksum picks which."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            sizes, media = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                text = text or b""
                payload = text + b"\xff" * (-len(text) % multiple if text else multiple)
                sizes.append(len(text))
                media.append(wav((MULAW, ALAW, IMA)[zlib.crc32(payload) % 3], payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id bigint, n_bytes bigint, media binary")


DECODED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, codec string, pcm binary"


def decoded(media: DataFrame, to: int = PCM_RATE, feature: bool = False) -> DataFrame:
    """``doc_id, n_bytes, media`` as read back: digests of the payload and of the stored bytes, the codec, and the PCM at rate ``to``; null media give nulls.

    With ``feature`` that column stands in place of codec and PCM, as ``features`` gives it, so the PCM never leaves its batch.
    """
    ship(media.sparkSession)
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = DECODED.replace("codec string, pcm binary", "feature string") if feature else DECODED
    kinds = pa.schema([(n, types[t]) for n, t in (x.split() for x in columns.split(", "))])
    names = {MULAW: "mulaw", ALAW: "alaw", IMA: "ima_adpcm"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1 << 20):
            rows, held = [], batch.column(2).to_pylist()
            for doc_id, n, m, pcm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), held, pcm_of(held, to), strict=True):
                if m is None:
                    rows.append((doc_id, n, *[None] * (len(kinds) - 2)))
                    continue
                payload, codec = payload_of(m), names[parse_wav(m)[0]]
                signal = (f"{codec};{described(pcm)}",) if feature else (codec, pcm.astype("<i2").tobytes())
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), *signal))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, columns)


def features(pcm_table: DataFrame) -> DataFrame:
    """The rows of ``decoded``, stored or not, with ``feature`` (null for null PCM) in place of codec and PCM."""
    ship(pcm_table.sparkSession)
    columns = [c for c in pcm_table.columns if c not in ("codec", "pcm", "feature")]
    rows = pcm_table.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "codec", "pcm")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "pcm", 8 << 20):
            said = [None if p is None else f"{c};{described(np.frombuffer(p, '<i2'))}" for c, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["row", "feature"])

    return rows.mapInArrow(describe, f"row {rows.schema['row'].dataType.simpleString()}, feature string").select("row.*", "feature")


def described(pcm: np.ndarray) -> str:
    """Number of samples, peak, energy, zero crossings and sum."""
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"samples={len(x)};peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum())};crossings={crossings};sum={int(x.sum())}"
