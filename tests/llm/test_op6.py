import hashlib
import zlib

import numpy as np
import pytest

from cadence.llm import audio
from cadence.llm.queries import QUERIES


def test_round_trip(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op6_telephony_audio"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = audio.wav(full, audio.codec_for(full))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert {r.feature.split(";")[0] for r in rows} == {"mulaw", "alaw", "adpcm"}


def slow_adpcm(block):
    """One block, sample by sample, as the format is told."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio._STEP[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(0).integers(0, 256, (40, audio.UNIT), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]
    steps = audio._STEP.astype(float)
    assert len(steps) == 89 and np.all(steps[40:] / steps[39:-1] > 1.09) and np.all(steps[40:] / steps[39:-1] < 1.11)


def test_g711_tables():
    mu, a = audio.EXPAND[audio.MULAW].astype(int), audio.EXPAND[audio.ALAW].astype(int)
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0) and (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert np.all(np.diff(mu[0x80:][::-1]) > 0) and len(set(a)) == 256 and np.array_equal(mu[:128], -mu[128:])


def test_resampling():
    assert audio.resample(np.array([0, 10, -10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 0, -10, -10]
    assert audio.resample(np.array([1, 2, 3, 4], np.int16), 8000, 4000).tolist() == [1, 3] and len(audio.resample(np.zeros(0, np.int16), 8000, 16000)) == 0


def test_stored_pcm(odd):
    media = audio.store_payload(odd)
    rows, pcm = {(r.doc_id, r.media) for r in media.collect()}, audio.decode_media(media).collect()
    assert len(pcm) == odd.count() and all(r.rate == 16000 and len(r.pcm) > 0 for r in pcm) and len(rows) >= 10
    assert audio.digest(odd.transform(audio.store_payload)).filter("n_bytes = 0 and payload_bytes = 64").count() == 3
    assert audio.digest(audio.store_payload(odd.filter("false"))).count() == 0
    with pytest.raises(ValueError):
        audio.parse_wav(b"x" * 100)


def test_stored_pcm_is_what_the_file_decodes_to(spark, sf):
    stored = audio.store_payload(spark.read.parquet(f"{sf}/documents.parquet"))
    of_files = audio.decode_media(stored.select("doc_id", "media"))
    assert stored.select("doc_id", "codec", "rate", "pcm").exceptAll(of_files).count() == 0 and of_files.count() == stored.count()
    for r in stored.limit(40).collect():
        codec, rate, payload = audio.parse_wav(r.media)
        if codec == audio.ADPCM:
            pcm = [x for i in range(0, len(payload), audio.UNIT) for x in slow_adpcm(payload[i : i + audio.UNIT])]
        else:
            pcm = [int(audio.EXPAND[codec][x]) for x in payload]
        own = []
        for i in range(-(-len(pcm) * 16000 // rate)):
            left, part = divmod(i * rate, 16000)
            own.append((pcm[left] * (16000 - part) + pcm[min(left + 1, len(pcm) - 1)] * part + 8000) // 16000 if rate != 16000 else pcm[left])
        assert np.frombuffer(r.pcm, "<i2").tolist() == own
