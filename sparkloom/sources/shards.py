"""Tar shards of records: layout, writing, scanning and byte-range reads.

A shard is one tar file. It is written as a stream, so its size is bounded by no memory; scanning reads the headers and seeks over the
payloads; a range is read by seeking to it. Files are reached through Arrow's file systems, by the address of the folder
(a local or mounted path, or an address with a scheme).
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = BLOCK = 512


def padded(size: Column) -> Column:
    """Size rounded up to whole blocks."""
    return F.ceil(size / BLOCK) * BLOCK


def layout(df: DataFrame, key: str, order: str, size: str, per_shard: int) -> DataFrame:
    """Shard and byte range of each payload: shard_no, offset, length. Rows carry a dense position ``order`` (from 0), so the
    running sum is within a shard, whose rows are bounded by ``per_shard``."""
    t = df.select(key, F.col(order).alias("pos"), F.col(size).cast("bigint").alias("length")).withColumn("shard_no", F.floor(F.col("pos") / per_shard))
    before = Window.partitionBy("shard_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(HEADER + padded(F.col("length"))).over(before), F.lit(0)) + HEADER
    return t.select(key, "shard_no", start.alias("offset"), "length")


def _at(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return system, path.rstrip("/")


def _name(shard_no: int) -> str:
    return f"shard-{shard_no:08d}.tar"


def write(df: DataFrame, key: str, payload: str, root: str, per_shard: int, position: str) -> DataFrame:
    """Rolling shards of ``per_shard`` payloads under ``root``; returns the index (key, shard_no, offset, length).

    A shard is written under another name and renamed when it is whole, so a lost task leaves no half shard; a repeated one writes the same again.
    Null payloads are written empty.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    src = df.select(F.col(key).cast("string").alias("k"), body.alias("body"), F.col(position).alias("pos"), F.floor(F.col(position) / per_shard).alias("shard_no"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        system, path = _at(root)
        system.create_dir(path, recursive=True)
        now, tar, out, part, at, rows = None, None, None, "", 0, []

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()
                system.move(part, f"{path}/{_name(now)}")

        for f in frames:
            for k, body, no in f[["k", "body", "shard_no"]].itertuples(index=False):
                if no != now:
                    close()
                    now, at, part = int(no), 0, f"{path}/.{_name(int(no))}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(part)
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)
                info = tarfile.TarInfo(k)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(bytes(body)))
                rows.append((k, now, at + HEADER, len(body)))
                at += HEADER + -(-len(body) // BLOCK) * BLOCK
            yield pd.DataFrame(rows, columns=["key", "shard_no", "offset", "length"])
            rows = []
        close()

    packed = src.repartition("shard_no").sortWithinPartitions("shard_no", "pos").mapInPandas(pack, "key string, shard_no bigint, offset bigint, length bigint")
    packed.write.mode("overwrite").parquet(f"{root}/index")
    return df.sparkSession.read.parquet(f"{root}/index")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Index (key, shard_no, offset, length) rebuilt from the shards' headers; unreadable shards are left out."""
    system, path = _at(root)
    there = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    files = [(int(f.base_name[6:14]), f.path) for f in there if f.base_name.startswith("shard-") and f.base_name.endswith(".tar")]

    def headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _at(root)
        for f in frames:
            for no, name in f[["shard_no", "path"]].itertuples(index=False):
                rows = []
                try:
                    with system.open_input_file(name) as data, tarfile.open(fileobj=data, mode="r:") as tar:
                        rows = [(m.name, no, m.offset_data, m.size) for m in tar]
                except (tarfile.TarError, OSError):
                    continue
                yield pd.DataFrame(rows, columns=["key", "shard_no", "offset", "length"])

    # One row per shard, some 30 GB each.
    listed = spark.createDataFrame(files, "shard_no bigint, path string")
    return listed.repartition(max(1, min(len(files), 4096)), "shard_no").mapInPandas(headers, "key string, shard_no bigint, offset bigint, length bigint")


def read_ranges(index: DataFrame, root: str) -> DataFrame:
    """key and payload of byte ranges (key, shard_no, offset, length); a range beyond its shard, or of a shard that is not there, gives null."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _at(root)
        now, data, size = None, None, 0
        for f in frames:
            out = []
            for no, offset, length in f[["shard_no", "offset", "length"]].itertuples(index=False):
                if no != now:
                    if data is not None:
                        data.close()
                    now, data, size = no, None, 0
                    try:
                        data = system.open_input_file(f"{path}/{_name(int(no))}")
                        size = data.size()
                    except OSError:
                        pass
                if data is None or offset < 0 or offset + length > size:
                    out.append(None)
                else:
                    data.seek(offset)
                    out.append(data.read(length))
            yield pd.DataFrame({"key": f["key"], "payload": pd.Series(out, dtype=object)})
        if data is not None:
            data.close()

    wanted = index.select("key", "shard_no", "offset", "length").repartition("shard_no").sortWithinPartitions("shard_no", "offset")
    return wanted.mapInPandas(read, "key string, payload binary")
