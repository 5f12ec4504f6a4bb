"""Line-aligned chunks of files, and their vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_CHARS = 2000


def chunk_text(text: str, limit: int = MAX_CHARS) -> list[tuple[int, str, int, int]]:
    """``(chunk_index, content, start_line, end_line)``: whole lines (as ``splitlines`` counts them) packed up to ``limit``
    characters without overlap; a longer line is a chunk of its own; an empty text has none."""
    out: list[tuple[int, str, int, int]] = []
    part: list[str] = []
    size = first = 0
    for n, line in enumerate(text.splitlines(keepends=True), 1):
        if part and size + len(line) > limit:
            out.append((len(out), "".join(part), first, n - 1))
            part, size = [], 0
        if not part:
            first = n
        part.append(line)
        size += len(line)
    if part:
        out.append((len(out), "".join(part), first, first + len(part) - 1))
    return out


_CHUNK = pa.list_(pa.struct([("chunk_index", pa.int32()), ("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))


def chunk_files(files: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """``(file_id, chunk_index, content, start_line, end_line)`` of every file with a content."""

    def run(texts: pa.Array) -> pa.Array:
        names = ("chunk_index", "content", "start_line", "end_line")
        return pa.array([None if t is None else [dict(zip(names, c)) for c in chunk_text(t, limit)] for t in texts.to_pylist()], _CHUNK)

    parts = F.arrow_udf(run, "array<struct<chunk_index:int,content:string,start_line:int,end_line:int>>")
    return files.where(F.col("content").isNotNull()).select(F.col("id").alias("file_id"), F.inline(parts("content")))


class TooManyChunks(RuntimeError):
    """A branch has more chunks than the limit; it is indexed without chunks and marked degraded."""


def hash_embedder(dim: int = 128) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: hashed words, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[i, h % dim] += 1.0 if h & 0x10000 else -1.0
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).tolist()

    return embed


def embed_chunks(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 64, attempts: int = 3) -> DataFrame:
    """``chunks`` with ``embedding``: contents go to ``embedder`` in batches, order kept; a batch is tried ``attempts``
    times, and an answer of another count or dimension is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("content")).to_pylist()
            vectors: list[list[float]] = []
            for k in range(0, len(texts), batch):
                part = [t or "" for t in texts[k : k + batch]]
                for n in range(attempts):
                    try:
                        got = embedder(part)
                        break
                    except Exception:
                        if n + 1 == attempts:
                            raise
                if len(got) != len(part) or any(len(v) != dim for v in got):
                    raise ValueError("the embedder answered with another number or size of vectors")
                vectors += got
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    chunks = chunks.drop("embedding")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, f"{kept}, embedding array<float>")
