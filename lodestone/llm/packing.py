"""Packing documents into sequences by hierarchical residual best fit.

Documents become token pieces. Full pieces are sequences of their own. The others are dealt into
groups and packed by best fit inside each; bins that are nearly full are final, the underfull ones
travel on as single items whose length is their fill, and groups merge them by best fit again, in
a tree, until one group is left.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch, by_group, texts

#: Fixed value: how byte-level BPE splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Token ids of whole texts, as ``tokenizers`` gives them without adding special tokens.

    Where the file is a plain byte-level BPE whose merges stand in the order of their ids, the same
    vocabulary is run by ``tiktoken``, which is several times faster; texts that spell a special
    token, and all other files, go through ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _ranks(path, self.special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


def _ranks(path: str, special: list[str]):
    """The vocabulary as a tiktoken encoding, or None if that would not give the same ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("dropout") or model.get("unk_token"):
        return None
    # the printable stand-ins of bytes: themselves where printable, else from 256 on in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = {w: i for w, i in model["vocab"].items() if w not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)) or len(vocabulary) != 256 + len(merges):
        return None
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={bytes(stand_in[c] for c in w): i for w, i in vocabulary.items()}, special_tokens={})


_LOADED: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents cut into pieces of ``capacity`` tokens.

    The first piece of a longer document takes what is left over, so all later ones are full.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows, out = ids_of(tokenizer).encode, [], []
        for k, text in enumerate(texts(batch)):
            ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
            first = len(ids) % capacity or min(capacity, len(ids))
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                rows.append(k)
                out.append((piece, a, b - a, crc32(ids[a:b].tobytes())))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(by_batch(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: the bin and offset of each item, and the fill of each bin.

    Lengths are small whole numbers, so open bins are stacks by free room and a sorted list of the
    rooms that occur.
    """
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    fill: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at == len(rooms):
            k, room = len(fill), capacity
            fill.append(0)
        else:
            room = rooms[at]
            stack = by_room[room]
            k = stack.pop()
            if not stack:
                rooms.pop(at)
                del by_room[room]
        bins[i], offsets[i] = k, fill[k]
        fill[k] += n
        if room := room - n:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(k)
    return bins, offsets, np.array(fill, dtype=np.int64)


#: Pieces in a group that is packed as a whole.
GROUP_ROWS = 200_000
_GROUP_BITS, _BIN_BITS = 32, 24


def travels(fill: np.ndarray, capacity: int, limit: int, most: int) -> np.ndarray:
    """Which bins of a packed group go on to later rounds: all up to half full, and ``most`` of each other fill below ``limit``."""
    order = np.argsort(fill, kind="stable")
    place = np.empty(len(fill), dtype=np.int64)
    place[order] = np.arange(len(fill)) - np.searchsorted(fill[order], fill[order])
    return (fill < limit) & ((2 * fill <= capacity) | (place < most))


def rounds_after(groups: int, fan_in: int) -> int:
    """Rounds of merging ``fan_in`` groups at a time until one is left."""
    n = 0
    while groups > 1:
        groups, n = -(-groups // fan_in), n + 1
    return n


def _round(items: DataFrame, capacity: int, limit: int, most: int, level: int) -> DataFrame:
    """Pack the ``length`` of the rows of each ``group``: all columns and bin, at (offset in the bin), fill, travels.

    Bin numbers hold the round, the group and a counter. Bins of equal fill are alike for later rounds,
    and of two bins of a packed group at most one is half empty, as best fit would have joined them.
    So a round over ``fan_in`` groups has at most ``fan_in`` items of up to half the capacity, and takes
    at most as many of the fuller bins of any one fill. All rounds still to come take ``most``, which is
    ``fan_in`` for each of them, at most, so only ``most`` of each fill travel and all others are final.
    What travels is bounded by ``most`` * capacity / 2 bins a group, whatever the input.
    """

    def pack(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        lengths, group = rows.column("length").to_numpy(), rows.column("group")[0].as_py()
        bins, offsets, fill = best_fit(lengths, capacity)
        goes_on = travels(fill, capacity, limit, most)
        number = (level << (_GROUP_BITS + _BIN_BITS)) + (group << _BIN_BITS) + bins
        out = [pa.array(number), pa.array(offsets), pa.array(fill[bins]), pa.array(goes_on[bins])]
        return pa.RecordBatch.from_arrays([*(c.chunk(0) for c in rows.columns), *out], names=[*rows.column_names, "bin", "at", "fill", "travels"])

    others = [c for c in items.columns if c != "group"]
    dealt = items.select("group", *others).repartition("group").sortWithinPartitions("group", F.desc("length"), "item")
    kinds = ", ".join(f"{c} {k}" for c, k in dealt.dtypes)
    return dealt.mapInArrow(by_group(pack, 1), f"{kinds}, bin long, at long, fill long, travels boolean")


def _grouped(short: DataFrame, group_rows: int) -> tuple[DataFrame, int]:
    """The rows with their group, and how many groups there are.

    Groups follow from the row count and a hash of what a piece is, never from partitions, so the same
    table is packed alike however it is dealt. Many equal pieces share a hash; a group that holds more
    than twice the rows it should is cut further by the number of the row.
    """
    count = max(1, -(-short.count() // group_rows))
    rows = short.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(count)))
    # at most one in two * group_rows rows each, so few
    crowded = rows.groupBy("group").count().where(F.col("count") > 2 * group_rows).orderBy("group").collect()
    if not crowded:
        return rows, count
    cut = []
    for r in crowded:
        parts = -(-r["count"] // group_rows)
        cut.append((r["group"], parts, count))
        count += parts - 1
    extra = F.broadcast(short.sparkSession.createDataFrame(cut, "_g long, _parts long, _from long"))
    part = F.pmod(F.xxhash64("item"), F.col("_parts"))
    moved = F.when(F.coalesce(part, F.lit(0)) == 0, F.col("group")).otherwise(F.col("_from") + part - 1)
    return rows.join(extra, F.col("group") == F.col("_g"), "left").withColumn("group", moved).drop("_g", "_parts", "_from"), count


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, nearly_full: float = 0.99, fan_in: int = 8, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Equal rows are packed one by one. A null id is kept
    as it is. An empty table gives an empty result; other columns are ignored.

    What is packed are numbers, never texts. A group of about ``group_rows`` pieces is packed by best
    fit and bins that are nearly full leave; underfull bins travel on as single items whose length is
    their fill, and ``fan_in`` groups at a time merge them by best fit again, round by round. The
    number of sequences depends on the pieces alone, not on partitions or cores.
    """
    scratch = Scratch()
    cut = scratch(pieces(docs, tokenizer, capacity, end_id).withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    short = cut.where(F.col("length") < capacity)
    grouped, groups = _grouped(short, group_rows)
    limit, level, left = int(capacity * nearly_full), 1, rounds_after(groups, fan_in)
    placed = moved = scratch(_round(grouped, capacity, limit, fan_in * left, level), "pack-round")
    maps = []
    while groups > 1:
        # the row at the start of a bin stands for the bin
        bins = moved.where("at = 0 AND travels").select(F.col("bin").alias("item"), F.col("fill").alias("length"), F.floor(F.col("group") / fan_in).cast("long").alias("group"))
        groups, level, left = -(-groups // fan_in), level + 1, left - 1
        moved = scratch(_round(bins, capacity, limit, fan_in * left, level), "pack-round")
        maps.append(moved)
    # bins of the last round are final; from there back, a bin that moved on takes its new place
    final = None
    for step in reversed(maps):
        here = step.select(F.col("item").alias("old"), F.col("bin").alias("new"), F.col("at").alias("shift"))
        if final is not None:
            later = final.select(F.col("old").alias("new"), F.col("new").alias("newer"), F.col("shift").alias("further"))
            here = here.join(later, "new", "left").select("old", F.coalesce("newer", "new").alias("new"), (F.col("shift") + F.coalesce("further", F.lit(0))).alias("shift"))
        final = here
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if final is None:
        filled = placed.select(*columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    else:
        filled = placed.join(final, placed["bin"] == final["old"], "left").select(*columns, F.coalesce("new", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
    whole = cut.where(F.col("length") >= capacity).select(*columns, (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return scratch.finish(filled.unionByName(whole), "packed")
