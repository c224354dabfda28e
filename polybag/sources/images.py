"""Image catalogues and pixels from directories, one directory per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polybag.session import map_arrow


def _entity(path: str):
    """The parent directory's name."""
    return F.element_at(F.split(path, "/"), -2)


def scan_images(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """(sid, path, length) of every file below ``root``; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select(_entity("path").alias("sid"), "path", "length")


def _images(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("image.*")
    )


def decode_images(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """(sid, path, height, width, pixels) with interleaved RGB bytes.

    Spark's image source delivers blue first, and one channel for grey or four with alpha.
    Files that it can't decode are left out here and named by :func:`undecodable_images`.
    """
    raw = _images(spark, root, pattern).where("height > 0").select(
        _entity("origin").alias("sid"), F.col("origin").alias("path"),
        "height", "width", "nChannels", "data")
    return map_arrow(raw, _to_rgb, "sid string, path string, height int, width int, pixels binary")


def undecodable_images(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """(sid, path) of the files that are no images: an empty table before a run is trusted."""
    return _images(spark, root, pattern).where("height <= 0").select(
        _entity("origin").alias("sid"), F.col("origin").alias("path"))


def write_bitmaps(images: DataFrame, root: str) -> None:
    """Write (sid, name, height, width, pixels) rows as ``root/sid/name`` bitmaps.

    Each executor writes the files of its rows, to any store that ``root`` names.
    """
    list(map_arrow(images.select("sid", "name", "height", "width", "pixels"), _bitmap_writer(root),
                   "written bigint").agg(F.sum("written")).collect())


def _bitmap_writer(root: str):
    def run(batches):
        import struct

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            for row in batch.to_pylist():
                h, w = row["height"], row["width"]
                rgb = np.frombuffer(row["pixels"], dtype=np.uint8).reshape(h, w, 3)
                line = np.zeros((h, -(-w * 3 // 4) * 4), dtype=np.uint8)
                # Bottom line first, blue first, lines filled up to four bytes.
                line[:, :w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
                head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + line.size, 0, 0, 54,
                                   40, w, h, 1, 24, 0, line.size, 0, 0, 0, 0)
                store.create_dir(f"{base}/{row['sid']}", recursive=True)
                with store.open_output_stream(f"{base}/{row['sid']}/{row['name']}") as out:
                    out.write(head + line.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["written"])

    return run


def _to_rgb(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        pixels = []
        for data, channels in zip(col["data"], col["nChannels"].to_pylist()):
            raw = np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(-1, channels)
            order = [0, 0, 0] if channels == 1 else [2, 1, 0]
            pixels.append(raw[:, order].tobytes())
        yield pa.RecordBatch.from_arrays(
            [col["sid"], col["path"], col["height"], col["width"],
             pa.array(pixels, type=pa.binary())],
            names=["sid", "path", "height", "width", "pixels"])


def image_ids(decoded: DataFrame) -> DataFrame:
    """Decoded images keyed by path, as the view operators expect."""
    return decoded.withColumnRenamed("path", "image_id")
