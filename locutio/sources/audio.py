"""Samples from WAV files: a scan of binary files, their chunks walked and decoded in Arrow batches, one narrow pass.

Converting other containers is left to an outside tool; what it leaves is read here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_key

#: Format codes of integers, of floats, and of files that give the code further on.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Samples of one output batch.
BATCH = 1 << 20

SAMPLES = "doc_id string, tasa int, canales int, duracion double, muestras array<float>, problema string"


def chunks(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """(id, body) of the chunks of a RIFF file; a body that is cut short, or has no length yet, reaches to the end."""
    at = 12
    while at + 8 <= len(data):
        name, size = bytes(data[at : at + 4]), struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def samples(body: memoryview, code: int, bits: int) -> np.ndarray:
    """Samples as numbers from -1 to 1."""
    width = bits // 8
    raw = body[: len(body) // width * width]
    if code == FLOAT:
        return np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    return np.frombuffer(raw, "<i2" if bits == 16 else "<i4") / float(1 << (bits - 1))


def decoded(content: bytes | None) -> tuple[int | None, int | None, np.ndarray | None, str | None]:
    """(rate, channels, mono samples, problem) of a WAV file: channels are averaged, a last frame that lacks channels is left out."""
    data = memoryview(content or b"")
    if len(data) < 12 or bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"WAVE":
        return None, None, None, "not a WAV file"
    form = None
    for name, body in chunks(data):
        if name == b"fmt " and len(body) >= 16:
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if code == EXTENSIBLE and len(body) >= 26:
                code = struct.unpack("<H", body[24:26])[0]
            form = code, channels, rate, bits
        elif name == b"data":
            if form is None:
                return None, None, None, "samples before their format"
            code, channels, rate, bits = form
            if not channels or not rate or (code, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
                return rate, channels, None, f"unsupported format {code} of {bits} bits"
            own = samples(body, code, bits)
            frames = own[: len(own) // channels * channels].reshape(-1, channels)
            return rate, channels, (frames[:, 0] if channels == 1 else frames.mean(1)).astype(np.float32), None
    return None, None, None, "no samples"


def decode_wav(files: DataFrame) -> DataFrame:
    """(doc_id, tasa, canales, duracion, muestras, problema) of rows (doc_id, content): mono samples from -1 to 1, their rate and the seconds they last.

    What can't be read has null samples and a problem; a null content is no WAV file. Integers of 8, 16, 24 and 32 bits and floats are read.
    A file and its samples are values of one row.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.string()), ("tasa", pa.int32()), ("canales", pa.int32()), ("duracion", pa.float64()), ("muestras", pa.list_(pa.float32())), ("problema", pa.string())])
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for part in batches:
            for doc_id, content in zip(part.column(0), part.column(1)):
                rate, channels, mono, problem = decoded(None if not content.is_valid else content.as_buffer().to_pybytes())
                held.append((doc_id.as_py(), rate, channels, None if mono is None else len(mono) / rate, mono, problem))
                size += 16 + (0 if mono is None else len(mono))
                if size >= BATCH:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(kernel, SAMPLES)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of the WAV files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV,Wav}").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(file_key(name, F.col("content")).alias("doc_id"), name.alias("path"), "content")
