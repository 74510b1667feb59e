"""Media columns: content-addressed payloads in tar shards.

The payload of a text is its UTF-8 bytes, filled with blanks to a positive multiple of WIDTH; its
form in store is a grey PNG image of WIDTH columns and 8 bits, one sample for a byte. Tasks write
the images to tar shards in a folder that all machines share; rows keep only the digest of the
payload, and an index has the shard, offset and length of each digest. Metadata columns are read
by ranges that hold no more than an image's header; payloads are read back by range as well.

Equal payloads are stored once by each task that meets them; the index names one place. A shard
has a name of its own for every attempt, and the index is written before it is read, so that lost
or repeated tasks leave unused shards at worst. Texts are not shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe.lineage import shared_folder
from veilframe.llm.common import slices, written

WIDTH = 192
TAIL = 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the header chunk with its length, name and check sum.
HEADER_BYTES = 33
LEVEL = 6
#: A task begins a new shard after so many bytes, and remembers so many digests.
SHARD_BYTES = 256 << 20
KNOWN = 500_000
#: Ranges of a shard that one task reads one after the other.
READ_BYTES = 8 << 20


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def n_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def payload_digest(text: Column) -> Column:
    """SHA-256 of the payload, as `payload_of` makes it."""
    size = n_bytes(text)
    fill = F.when(size == 0, F.lit(WIDTH)).otherwise(F.pmod(-size, F.lit(WIDTH)))
    return F.sha2(F.concat(F.coalesce(text, F.lit("")), F.repeat(F.lit(" "), fill.cast("int"))), 256)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def image_of(payload: bytes) -> bytes:
    """A grey 8-bit PNG with the payload as its samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header_of(raw: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and colour type, from the first HEADER_BYTES of an image."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR" or struct.unpack(">I", raw[29:33])[0] != zlib.crc32(raw[12:29]):
        raise ValueError("not the header of a stored image")
    return struct.unpack(">IIBB", raw[16:26])


def samples_of(image: bytes) -> np.ndarray:
    """The samples of a stored image, a row for each line."""
    width, height, bits, colour = header_of(image[:HEADER_BYTES])
    at, parts = HEADER_BYTES, []
    while at < len(image):
        size, name = struct.unpack(">I4s", image[at:at + 8])
        data = image[at + 8:at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size:at + 12 + size])[0] != zlib.crc32(name + data):
            raise ValueError("a damaged stored image")
        if name == b"IDAT":
            parts.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if (bits, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not in the form that images are stored in")
    return lines[:, 1:]


class _Shards:
    """Tar files that one task writes."""

    def __init__(self, root: str) -> None:
        self.root, self.stream, self.place, self.at = root, None, "", 0
        self.files, self.folder = pa.fs.FileSystem.from_uri(root)
        self.files.create_dir(self.folder, recursive=True)

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.at > SHARD_BYTES:
            self.close()
            leaf = f"shard-{uuid.uuid4().hex}.tar"
            self.stream = self.files.open_output_stream(f"{self.folder}/{leaf}")
            self.place, self.at = f"{self.root}/{leaf}", 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.stream.write(info.tobuf(tarfile.USTAR_FORMAT))
        start = self.at + 512
        self.stream.write(data + b"\0" * (-len(data) % 512))
        self.at = start + len(data) + (-len(data) % 512)
        return self.place, start, len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(b"\0" * 1024)
            self.stream.close()
            self.stream = None


def store(df: DataFrame, text: str = "text", root: str | None = None) -> DataFrame:
    """The index of all payloads: digest, shard, offset, length; one row for each digest.

    `root` is a folder that all machines share (by default a new one below spark.checkpoint.dir), in
    any store that pyarrow opens by its URI. Null counts as empty; an empty table gives no rows.
    """
    root = root or f"{shared_folder(df.sparkSession)}/media"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = None, set()
        try:
            for batch in batches:
                for part in slices(batch, "t"):
                    rows = []
                    for t in part.column("t").to_pylist():
                        payload = payload_of(t)
                        digest = hashlib.sha256(payload).hexdigest()
                        if digest not in known:
                            known.add(digest)
                            shards = shards or _Shards(root)
                            rows.append((digest, *shards.add(f"{digest}.png", image_of(payload))))
                    if len(known) > KNOWN:
                        known.clear()
                    cols = list(zip(*rows)) or [(), (), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                                     names=["digest", "shard", "offset", "length"])
        finally:
            if shards is not None:
                shards.close()

    made = df.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(put, "digest string, shard string, offset long, length long")
    made = written(made, "placed")
    return made.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(index: DataFrame, size: Column, fields: list[T.StructField], make) -> DataFrame:
    """The index and what is made of the first `size` bytes of each image; reads each shard in order."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = index.repartition(n, "shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")
    schema = T.StructType([*index.schema.fields, *fields])
    kept, names = index.columns, schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for shard, offset, length in zip(*(part.column(c).to_pylist() for c in ("shard", "offset", "read"))):
                    if shard != name:
                        if file is not None:
                            file.close()
                        files, path = pa.fs.FileSystem.from_uri(shard)
                        name, file = shard, files.open_input_file(path)
                    rows.append(make(file.read_at(length, offset)))
                made = [pa.array(list(x)) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=names)
        if file is not None:
            file.close()

    return near.select("*", size.cast("long").alias("read")).mapInArrow(read, schema)


def with_headers(index: DataFrame) -> DataFrame:
    """The index with width, height, bits and colour, by reading headers only."""
    fields = [T.StructField(x, T.LongType()) for x in ("width", "height", "bits", "colour")]
    return _ranges(index, F.lit(HEADER_BYTES), fields, header_of)


def _read_back(image: bytes) -> tuple:
    samples = samples_of(image)
    payload = samples.tobytes()
    counts = np.bincount(samples.ravel(), minlength=256) / samples.size
    entropy = float(-(counts[counts > 0] * np.log2(counts[counts > 0])).sum())
    feature = f"{samples.shape[1]}x{samples.shape[0]};mean={samples.mean():.4f};std={samples.std():.4f};blank={counts[32]:.4f};entropy={entropy:.4f}"
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(image), hashlib.sha256(image).hexdigest(), feature)


def read_back(index: DataFrame) -> DataFrame:
    """The index with the size, digest and tail check sum of the payload, size and digest of the image, and features."""
    fields = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
              T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
    return _ranges(index, F.col("length"), fields, _read_back)


def with_references(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys, n_bytes and the digest that refers to the payload: what a row holds in place of its media."""
    t = F.col(f"`{text}`").cast("string")
    return df.select(*keys, n_bytes(t).alias("n_bytes"), payload_digest(t).alias("digest"))
