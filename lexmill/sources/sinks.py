"""Sinks: append-only logs, graphs, exported documents, loop state and small binary media."""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; earlier files are never rewritten."""
    df.write.mode("append").json(path)


def replay_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; edges are unique by (src, rel, dst)."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").dropDuplicates(["src", "rel", "dst"])


def export_notes(bindings: DataFrame, path: str) -> None:
    """One Markdown text per sense with its forms by language, below one folder per sense."""
    lines = bindings.groupBy("sense").agg(F.sort_array(F.collect_set(F.concat(F.lit("- "), "lang", F.lit(": [["), "form", F.lit("]]")))).alias("l"))
    notes = lines.select("sense", F.concat(F.lit("# "), "sense", F.lit("\n"), F.array_join("l", "\n")).alias("value"))
    notes.write.mode("overwrite").partitionBy("sense").text(path)


def save_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def png_bytes(width: int, height: int, rgb: bytes) -> bytes:
    """A truecolour image from rows of red, green and blue bytes."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def wav_bytes(samples: list[float], rate: int = 16_000) -> bytes:
    """16-bit mono sound from samples in [-1, 1]."""
    out = io.BytesIO()
    body = b"".join(struct.pack("<h", int(max(-1.0, min(1.0, s)) * 32767)) for s in samples)
    out.write(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16))
    out.write(b"data" + struct.pack("<I", len(body)) + body)
    return out.getvalue()


def formants(frequencies: list[float], seconds: float = 0.1, rate: int = 16_000) -> list[float]:
    """A sum of sines under a rising and falling envelope."""
    n = int(seconds * rate)
    return [math.sin(math.pi * i / max(1, n - 1)) * sum(math.sin(2 * math.pi * f * i / rate) for f in frequencies) / max(1, len(frequencies)) for i in range(n)]


def encode_images(images: DataFrame) -> DataFrame:
    """id, width, height, rgb (binary) to id, png (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "png": [png_bytes(int(w), int(h), bytes(x)) for w, h, x in zip(b["width"], b["height"], b["rgb"], strict=True)]})

    return images.select("id", "width", "height", "rgb").mapInPandas(run, "id long, png binary")
