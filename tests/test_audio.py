"""WAV files of all kinds against what they were written from."""

import io
import struct
import wave

import numpy as np
import pytest

from locutio.plans.audio_queries import wav
from locutio.sources import audio


def file(form: bytes, data: bytes, before: bytes = b"", after: bytes = b"") -> bytes:
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + before + b"data" + struct.pack("<I", len(data)) + data + after
    return b"RIFF" + struct.pack("<I", len(body)) + body


def form(code, channels, rate, bits, more=b""):
    return struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + more


def written(values, channels, width):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in values))
    return out.getvalue()


@pytest.mark.parametrize("channels", [1, 2, 3])
@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_integers_of_each_width(width, channels):
    rng = np.random.default_rng(width)
    top = 1 << (8 * width - 1)
    values = rng.integers(0, 256, 60) if width == 1 else rng.integers(-top, top, 60)
    rate, n, mono, problem = audio.decoded(written(values, channels, width))
    want = ((values - 128) / 128 if width == 1 else values / top).reshape(-1, channels).mean(1)
    assert (rate, n, problem) == (8000, channels, None) and np.allclose(mono, want, atol=1e-6)


def test_floats_extensible_odd_chunks_and_cut_files():
    own = np.array([0.5, -0.25, 1.0, 0.0], "<f4")
    assert audio.decoded(file(form(3, 2, 16000, 32), own.tobytes()))[2].tolist() == [0.125, 0.5]
    assert audio.decoded(file(form(3, 1, 16000, 64), own.astype("<f8").tobytes()))[2].tolist() == own.tolist()
    pcm = np.array([16384, -16384, 8192], "<i2").tobytes()
    extensible = form(0xFFFE, 1, 16000, 16, struct.pack("<HHIH", 22, 16, 0, 1) + bytes(14))
    assert audio.decoded(file(extensible, pcm, b"LIST" + struct.pack("<I", 3) + b"abc\0", b"junk"))[2].tolist() == [0.5, -0.5, 0.25]
    whole = file(form(1, 2, 16000, 16), pcm)
    assert audio.decoded(whole)[2].tolist() == [0.0] and audio.decoded(whole[:-3])[2].tolist() == []


@pytest.mark.parametrize(("content", "said"), [
    (None, "not a WAV file"), (b"", "not a WAV file"), (b"RIFF1234AVI x", "not a WAV file"), (b"RIFF1234WAVE", "no samples"), (file(form(1, 1, 8000, 12), b"xx"), "unsupported format 1 of 12 bits"),
    (file(form(85, 1, 8000, 16), b"xx"), "unsupported format 85 of 16 bits"), (file(form(1, 0, 8000, 16), b"xx"), "unsupported format 1 of 16 bits"),
    (b"RIFF1234WAVEdata" + struct.pack("<I", 2) + b"xx", "samples before their format"),
])
def test_what_cannot_be_read(content, said):
    assert audio.decoded(content)[2:] == (None, said)


def test_files_and_rows(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(written([100, -100] * 800, 2, 2))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.WAV").write_bytes(b"no")
    (tmp_path / "c.txt").write_text("no")
    rows = {r.path: r for r in audio.read_wavs(spark, str(tmp_path)).join(audio.decode_wav(audio.read_wavs(spark, str(tmp_path))), "doc_id").collect()}
    assert set(rows) == {"a.wav", "b.WAV"} and rows["a.wav"].duracion == 0.1 and rows["a.wav"].muestras[:2] == [0.0, 0.0] and rows["b.WAV"].problema == "not a WAV file"
    made = spark.createDataFrame([("x", [1, -2, 32767, -32768, 5])], "doc_id string, pcm array<int>")
    got = audio.decode_wav(made.select("doc_id", wav(made.pcm, 2, 16000).alias("content"))).first()
    assert got.canales == 2 and got.tasa == 16000 and got.muestras == [-0.5 / 32768, -0.5 / 32768] and audio.decode_wav(made.limit(0).select("doc_id", made.doc_id.cast("binary").alias("content"))).count() == 0
