import hashlib
import zlib

import numpy as np

from ambulo.llm.media import FRAME, RATE, decode_media, encode_media, feature_digest, from_wav, pad, peak_pairs, to_wav


def test_round_trip():
    for text in (b"", b"x", b"y" * 192, "é日".encode() * 100, bytes(range(256)) * 3):
        assert len(pad(text)) % 192 == 0 and pad(text)
        assert from_wav(to_wav(pad(text))).rstrip(b" ") == text.rstrip(b" ")
    assert len(pad(b"y" * 192)) == 192


def test_a_tone_gives_its_frequency():
    t = np.arange(40 * FRAME)
    for hertz in (250, 1000, 3000):
        wave = (128 + 100 * np.sin(2 * np.pi * hertz * t / RATE)).astype(np.uint8).tobytes()
        times, codes = peak_pairs(wave)
        assert set((codes >> 16).tolist()) == {round(hertz * FRAME / RATE)}
        assert (np.diff(times) >= 0).all() and times[-1] == 38


def test_operator(spark):
    texts = [None, "", "one text", "one text", "Ünïcode " * 9000, "x" * 192]
    docs = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = decode_media(encode_media(docs)).withColumn("feature", feature_digest()).collect()
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts, strict=True):
        raw = (text or "").encode()
        payload = pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(to_wav(payload)))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(to_wav(payload)).hexdigest() and len(r.times) == len(r.codes)
    assert rows[2].feature == rows[3].feature != rows[4].feature and rows[0].feature == rows[1].feature
    assert decode_media(encode_media(docs.limit(0))).collect() == []
