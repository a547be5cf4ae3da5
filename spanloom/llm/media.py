"""Media columns: payloads in tar shards, addressed by content, with rows that carry digest, offset and length.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of ``WIDTH``, are the samples of an 8-bit grey image
``WIDTH`` wide, stored losslessly as a PNG file named by the payload's SHA-256. Each task appends its images to tar shards of its
own in the shared folder, a payload once a shard, and emits index rows. ``describe`` fills metadata columns by reading only a
PNG's first ``HEADER`` bytes in place; ``read_back`` reads the whole range, decodes it and computes features. Every step is a map:
no payload is shuffled, and a repeated task writes a shard under another name, so rows never point at half a file.

Cases: a null text counts as empty, an empty text is one row of zero samples; texts may be of any length; repeated texts share
digest and features; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, text_or_empty, written

WIDTH = 64
SHARD_BYTES = 256 << 20
SHARD_ROWS = 100_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and IHDR chunk
LEVEL = 6


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def png(payload: bytes) -> bytes:
    """An 8-bit grey image of WIDTH columns; each row has filter type 0."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header at this offset")
    return struct.unpack(">IIB", head[16:25])


def samples(image: bytes) -> bytes:
    """The payload of an image that png() wrote."""
    width, height, _ = header(image[:HEADER])
    at, parts = HEADER, []
    while at < len(image):
        size = struct.unpack(">I", image[at : at + 4])[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unknown row filter")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, their entropy in bits, and the share of zeros."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
    mean = float(n @ np.arange(256))
    p = n[n > 0]
    return f"grey8 {WIDTH}x{len(payload) // WIDTH} mean={mean:.4f} dev={float(n @ (np.arange(256) - mean) ** 2) ** 0.5:.4f} entropy={abs(float(-(p * np.log2(p)).sum())):.4f} zeros={n[0]:.4f}"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class Shards:
    """A task's tar shards: appended to, and put under their final names when full."""

    def __init__(self, root: str):
        self.root, (self.fs, self.path) = root, filesystem(root)
        self.tag, self.n, self.out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, None

    def add(self, digest: str, image_of) -> tuple[str, int, int]:
        if self.out is not None and (self.at > SHARD_BYTES or len(self.known) >= SHARD_ROWS):
            self.close()
        if self.out is None:
            self.name, self.at, self.known = f"shard-{self.tag}-{self.n:04d}.tar", 0, {}
            self.out, self.n = self.fs.open_output_stream(f"{self.path}/.{self.name}"), self.n + 1
        if digest not in self.known:
            image = image_of()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + image + bytes(-len(image) % tarfile.BLOCKSIZE))
            self.known[digest] = self.at + tarfile.BLOCKSIZE, len(image)
            self.at += tarfile.BLOCKSIZE + len(image) + -len(image) % tarfile.BLOCKSIZE
        return (self.name, *self.known[digest])

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.fs.move(f"{self.path}/.{self.name}", f"{self.path}/{self.name}")
            self.out = None


def store(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows, written once: id, n_bytes, digest, shard, offset, length. root: a folder all executors share."""
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    target, path = filesystem(root)
    target.create_dir(path, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards = Shards(root)
        for b in batches:
            rows = []
            for t in b["text"]:
                raw = t.encode("utf-8", "surrogatepass")
                payload = padded(raw)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((len(raw), digest, *shards.add(digest, lambda: png(payload))))
            out = pd.DataFrame(rows, columns=["n_bytes", "digest", "shard", "offset", "length"])
            out.insert(0, "id", b["id"].to_numpy())
            out["shard"] = root + "/" + out["shard"]
            yield out
        shards.close()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return written(rows.mapInPandas(run, f"id {kind}, n_bytes long, digest string, shard string, offset long, length long"), "media-index").withColumnRenamed("id", id_col)


def ranges(b: pd.DataFrame, length_of) -> Iterator[tuple[int, bytes]]:
    """(row, bytes) for each row of an index, shard by shard; a range that several rows share is read once."""
    for shard, rows in b.groupby("shard", sort=False):
        files, path = filesystem(shard)
        with files.open_input_file(path) as f:
            for offset, same in rows.groupby("offset", sort=False):
                got = f.read_at(length_of(same.iloc[0]), int(offset))
                for i in same.index:
                    yield i, got


def describe(index: DataFrame) -> DataFrame:
    """The index with width, height, bit_depth and payload_bytes, from the images' headers alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            got = {i: header(head) for i, head in ranges(b, lambda row: HEADER)}
            w, h, d = (np.array([got[i][k] for i in b.index], np.int64) for k in range(3))
            yield b.assign(width=w, height=h, bit_depth=d, payload_bytes=w * h * d // 8)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInPandas(run, f"{schema}, width long, height long, bit_depth long, payload_bytes long")


def read_back(index: DataFrame) -> DataFrame:
    """The index with payload_sha256, tail_crc32, media_sha256 and feature, from the stored bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            got, last = {}, (None, None)
            for i, image in ranges(b, lambda row: int(row["length"])):
                if last[0] is not image:
                    p = samples(image)
                    last = image, (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), hashlib.sha256(image).hexdigest(), features(p))
                got[i] = last[1]
            for k, name in enumerate(("payload_sha256", "tail_crc32", "media_sha256", "feature")):
                b[name] = [got[i][k] for i in b.index]
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInPandas(run, f"{schema}, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def members(shard: str) -> dict[str, bytes]:
    """A shard's files by name, as tar itself reads them."""
    files, path = filesystem(shard)
    with files.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as t:
        return {m.name: t.extractfile(m).read() for m in t}


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = store(table(spark, sf_dir, "documents"))
    got = read_back(describe(index))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "digest")
