import hashlib
import struct
import zlib

import numpy as np
import pytest

from ontospark.llm import telephony as tel
from ontospark.llm.common import written


def test_tables():
    assert [int(tel.MU[i]) for i in (0, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(tel.A[i]) for i in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert len(np.unique(tel.MU)) == 255 and len(np.unique(tel.A)) == 256


def ima_by_sample(block):
    """One block, one code at a time."""
    value, index = struct.unpack("<hB", block[:3])
    index, out = min(index, 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(tel.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_adpcm_across_blocks_is_adpcm_by_sample():
    blocks = np.random.default_rng(3).integers(0, 256, (37, 40), dtype=np.uint8)
    got = tel.decode_ima(blocks)
    assert got.tolist() == [ima_by_sample(b.tobytes()) for b in blocks]


def test_documents_round_trip(spark, odd, none):
    media = written(tel.stored(odd, 576), "media")
    rows = tel.features(written(tel.decoded(media), "pcm")).collect()
    want = []
    for r in odd.collect():
        data = (r.text or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        want.append((r.doc_id, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {r.payload_sha256: (r.media_sha256, r.media_bytes, r.feature) for r in rows}
    assert all(by[r.payload_sha256] == (r.media_sha256, r.media_bytes, r.feature) for r in rows)
    for m in media.collect():
        assert hashlib.sha256(m.media).hexdigest() in {x[0] for x in by.values()}
    assert tel.features(tel.decoded(tel.stored(none))).count() == 0


def test_wav_keeps_payloads_and_rejects_others():
    payload = bytes(range(256)) * 9
    for tag in (tel.MULAW, tel.ALAW, tel.IMA):
        assert tel.payload_of(tel.wav(tag, payload)) == payload
    with pytest.raises(ValueError):
        tel.parse_wav(b"RIFFxxxxAVI " + b"0" * 40)
    with pytest.raises(ValueError):
        tel.decode_all([tel.wav(tel.IMA, payload)[:-5].replace(b"fact", b"fakt")])


def slow_resample(pcm, rate, to):
    """Every output sample as one sum over all samples."""
    cut = min(1.0, to / rate)
    wing, out = int(np.ceil(tel.WINGS / cut)), []
    for j in range(-(-len(pcm) * to // rate)):
        t = j * rate / to
        near = range(int(np.floor(t)) - wing, int(np.floor(t)) + wing + 1)
        w = {i: np.sinc((i - t) * cut) * (0.5 + 0.5 * np.cos(np.pi * (i - t) / wing)) if abs(i - t) < wing else 0.0 for i in near}
        total = sum(w.values())
        out.append(sum(x * float(pcm[i]) for i, x in w.items() if 0 <= i < len(pcm)) / total)
    return np.clip(np.rint(out), -32768, 32767).astype(np.int64)


@pytest.mark.parametrize(("rate", "to"), [(8000, 2000), (8000, 16000), (8000, 6000), (11025, 8000), (8000, 11025)])
def test_resampling_is_the_plain_sum(rate, to):
    rng = np.random.default_rng(7)
    signals = [rng.integers(-32768, 32767, n).astype(np.int16) for n in (1, 2, 97, 400, 0, 33)]
    for x, y in zip(signals, tel.resample_all(signals, rate, to), strict=True):
        want = slow_resample(x, rate, to)
        assert len(y) == len(want) and (len(y) == 0 or np.abs(y.astype(int) - want).max() <= 1)  # sums in another order may round apart
        assert (tel.resample(x, rate, to) == y).all()


def test_a_tone_above_the_band_goes_and_one_below_stays():
    at = np.arange(8000) / 8000
    for hertz, share in ((200, 1.0), (3000, 0.0)):
        x = np.rint(10000 * np.sin(2 * np.pi * hertz * at)).astype(np.int16)
        y = tel.resample(x, 8000, 2000)[100:-100].astype(float)
        assert abs(np.sqrt((y * y).mean()) / (10000 / np.sqrt(2)) - share) < 0.01


def test_feature_string_by_plain_loops(spark, documents):
    media = written(tel.stored(documents.limit(40), 576), "media")
    got = {r.doc_id: r for r in tel.features(written(tel.decoded(media), "pcm")).collect()}
    for r in media.collect():
        tag, rate, align, data = tel.parse_wav(r.media)
        raw = bytes(data)
        if tag == tel.IMA:
            pcm = [x for k in range(0, len(raw), align) for x in ima_by_sample(raw[k : k + align])]
        else:
            pcm = [int((tel.MU if tag == tel.MULAW else tel.A)[b]) for b in raw]
        y = [int(x) for x in tel.resample(np.array(pcm, np.int16), rate, tel.PCM_RATE)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(y, y[1:]))
        name = {tel.MULAW: "mulaw", tel.ALAW: "alaw", tel.IMA: "ima_adpcm"}[tag]
        assert got[r.doc_id].feature == f"{name};samples={len(y)};peak={max(map(abs, y))};energy={sum(x * x for x in y)};crossings={crossings};sum={sum(y)}"


def test_null_and_empty_media(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, tel.wav(tel.ALAW, b"")), (3, 0, tel.wav(tel.IMA, b""))], "doc_id bigint, n_bytes bigint, media binary")
    got = {r.doc_id: r for r in tel.features(tel.decoded(df)).collect()}
    assert got[1].feature is None and got[1].payload_sha256 is None
    assert got[2].feature == "alaw;samples=0;peak=0;energy=0;crossings=0;sum=0" and got[3].payload_bytes == 0


def test_resampled_column(spark):
    tone = np.rint(100 + 20 * np.sin(np.arange(800) / 9)).astype(np.uint8).tobytes()
    df = spark.createDataFrame([(1, tel.wav(tel.MULAW, tone), "x", 0), (2, None, "y", 0), (3, tel.wav(tel.ALAW, b""), "z", 0)], "id int, media binary, row string, pcm int")
    done = tel.resampled(df, to=16000)
    assert done.columns == ["id", "media", "row", "pcm"]
    got = {r.id: r for r in done.collect()}
    pcm = np.frombuffer(got[1].pcm, "<i2")
    assert len(pcm) == 1600 and np.abs(pcm[::2].astype(int) - tel.MU[np.frombuffer(tone, np.uint8)]).max() <= 1
    assert got[2].pcm is None and got[3].pcm == b"" and got[1].row == "x"
    low = np.frombuffer({r.id: r for r in tel.resampled(df, to=4000).collect()}[1].pcm, "<i2")
    assert len(low) == 400


def test_query_keeps_every_sample(spark, tmp_path):
    """The feature covers the whole signal: at least as many samples as the media hold."""
    from ontospark.llm.queries import op2_telephony

    texts = ["", "a" * 700, "mu and A law " * 90, "ä" * 2000, *(f"text {i} " * (i + 1) for i in range(40))]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op2_telephony(spark, str(tmp_path)).collect():
        codec, *said = r.feature.split(";")
        told = dict(x.split("=") for x in said)
        held = r.payload_bytes // 144 * 289 if codec == "ima_adpcm" else r.payload_bytes
        assert int(told["samples"]) == 2 * held
