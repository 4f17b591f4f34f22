"""Filling containers of fixed token capacity with documents: shortest-pack-first over the length histogram.

Texts are measured in tokens of a public tokenizer; one longer than the capacity is cut into pieces of the full
capacity and a rest. The histogram of piece lengths (at most ``capacity`` rows) is packed on the driver, longest
lengths first, each into the packs with the most room left; packs are kept as patterns with counts, never one by
one. Then the k-th piece of a length, by rank, gets the k-th place that the patterns hold for that length.

Ranks come from one range partitioning by length and id: counts per partition and length give each partition its
offsets, so no length, however common, is ranked in one task.

Defined results: null and empty texts (and texts of no token) get no container; repeated rows are placed each;
a null id is kept as null; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.common import checkpoint, parallelism, written

#: Default tokenizer file (a parameter of every function that reads it).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

PIECE = "doc_id bigint, piece_no int, n_tokens int, char_start bigint, char_end bigint"


def measure(df: DataFrame, key: str, text: str, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece_no, n_tokens, char_start, char_end (0-based, end exclusive)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    src = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("body")).where("body <> ''")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        for frame in frames:
            rows: list[tuple] = []
            ids, bodies = frame["doc_id"].tolist(), frame["body"].tolist()
            for a in range(0, len(ids), 128):
                for key_, body, enc in zip(ids[a : a + 128], bodies[a : a + 128], tok.encode_batch(bodies[a : a + 128], add_special_tokens=False)):
                    n = len(enc)
                    if n <= capacity:
                        if n:
                            rows.append((key_, 0, n, 0, len(body)))
                        continue
                    at = enc.offsets
                    ends = [at[k][0] for k in range(capacity, n, capacity)] + [len(body)]
                    for no, end in enumerate(ends):
                        rows.append((key_, no, min(capacity, n - no * capacity), ends[no - 1] if no else 0, end))
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "n_tokens", "char_start", "char_end"]).astype({"doc_id": "Int64"})

    # Tokenising is the heavy part: even it out over the cores, as one file may hold most of the long texts.
    return src.repartition(parallelism(df.sparkSession)).mapInPandas(count, PIECE)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with the number of containers of each, lengths longest first.

    Each length goes into the packs with the most room; where none has room, packs of as many pieces of that
    length as fit are opened.
    """
    room: dict[int, list[list]] = {}  # room left -> [pattern, count]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        while left:
            space = max(room, default=0)
            if space >= length:
                pattern, n = room[space].pop()
                if not room[space]:
                    del room[space]
                # As many containers get one more piece as there are pieces and containers of this pattern.
                used = min(n, left)
                if used < n:
                    room.setdefault(space, []).append([pattern, n - used])
                room.setdefault(space - length, []).append([_more(pattern, length, 1), used])
                left -= used
            else:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    room.setdefault(capacity - each * length, []).append([((length, each),), full])
                if rest:
                    room.setdefault(capacity - rest * length, []).append([((length, rest),), 1])
                left = 0
    total: Counter = Counter()
    for packs in room.values():
        for pattern, n in packs:
            total[pattern] += n
    return sorted(total.items())


def _more(pattern: tuple, length: int, times: int) -> tuple:
    if pattern and pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + times))
    return (*pattern, (length, times))


def places(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """Per length the places as rows (first rank, first container, slot, token offset), ranks rising."""
    out: dict[int, list] = {}
    nxt: Counter = Counter()
    base = 0
    for pattern, n in patterns:
        slot = offset = 0
        for length, times in pattern:
            for _ in range(times):
                out.setdefault(length, []).append((nxt[length], base, slot, offset))
                nxt[length] += n
                slot, offset = slot + 1, offset + length
        base += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(df: DataFrame, key: str, text: str, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers of all pieces: container_id, slot, token_offset, doc_id, piece_no, n_tokens, char_start, char_end."""
    spark = df.sparkSession
    # Written first: the range partitioning reads its input twice, once for a sample.
    pieces = written(measure(df, key, text, capacity, tokenizer))
    parts = parallelism(spark)
    ranged = pieces.repartitionByRange(parts, "n_tokens", "doc_id", "piece_no").sortWithinPartitions("n_tokens", "doc_id", "piece_no")
    ranged = checkpoint(ranged).withColumn("part", F.spark_partition_id())
    # Lengths per partition: at most capacity + partitions rows, as the partitions are ranges of length.
    seen = sorted((r["part"], r["n_tokens"], r["n"]) for r in ranged.groupBy("part", "n_tokens").agg(F.count("*").alias("n")).collect())
    counts: Counter = Counter()
    first: dict[tuple[int, int], int] = {}
    for part, length, n in seen:
        first[part, length] = counts[length]
        counts[length] += n
    table = places(pack_histogram(dict(counts), capacity))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: Counter = Counter()
        for f in frames:
            out = []
            for (part, length), g in f.groupby(["part", "n_tokens"], sort=False):
                at = table[int(length)]
                start = first[int(part), int(length)] + done[part, length]
                done[part, length] += len(g)
                rank = np.arange(start, start + len(g))
                i = np.searchsorted(at[:, 0], rank, side="right") - 1
                g = g.drop(columns="part")
                out.append(g.assign(container_id=at[i, 1] + rank - at[i, 0], slot=at[i, 2], token_offset=at[i, 3]))
            if out:
                yield pd.concat(out)

    return ranged.mapInPandas(place, PIECE + ", container_id bigint, slot int, token_offset int").select("container_id", "slot", "token_offset", "doc_id", "piece_no", "n_tokens", "char_start", "char_end")
