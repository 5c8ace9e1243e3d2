"""Training-order materialisation: token sequences in a keyed random order, in binary shards.

Documents are cut into sequences of at most ``stride`` tokens, numbered through without
gaps, and put in a global order by a keyed Feistel permutation: it permutes the smallest
even number of bits that holds all numbers, and a result beyond the last number is
permuted again (cycle walking). A shard holds ``shard_rows`` consecutive places; sequence
k of it starts at byte ``k * stride * 2``. Ids are unsigned 16-bit, little endian, padded
with the end id; an index file of fixed-size records beside the shard holds doc_id, piece
and length. A reader can begin at any place by seeking, and a run that is repeated leaves
shards alone that already hold the same bytes.

Sequences are numbered by (doc_id, digest of the text, piece), so that the training order
depends on the rows and the key only, not on how Spark cut the input. The ids stay where
they are for that: slim rows of documents are sorted by range, and each part of the token
table gets a file with the first number of each of its documents.

Null and empty texts are one sequence of the end id. A null doc_id comes first and is stored
as the smallest 64-bit number. Texts of any length are encoded whole. Repeated rows are
repeated sequences; which of two equal rows comes first makes no difference. An empty table
writes no shard. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyarrow import fs

from .common import map_arrow, scratch, table, text_buffers, written
from .files import attempt, committed, store
from .tokens import END, default_path, encode
from .words import mix

STRIDE = 256
SHARD_ROWS = 65_536
ROUNDS = 4
KEY = 20_240_229
NO_ID = -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("n", "<i4")])
#: A task deals so many bytes of ids to their shards at a time.
DEALT_BYTES = 1 << 25


def permuted(numbers: np.ndarray, total: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Places of ``numbers`` below ``total`` under the keyed permutation of 0 to total - 1."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in range(rounds):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD6E8FEB86659FD93) % (1 << 64))
            left, right = right, left ^ (mix(right ^ salt) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def token_table(docs: DataFrame, folder: str, stride: int, vocabulary: str) -> DataFrame:
    """Writes (part, row, doc_id, digest, pieces, piece, ids) as Parquet, a row a sequence. ``row``
    counts the documents of each part; ``digest`` and ``pieces`` are there for piece 0 only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids = encode(text, vocabulary).astype("<u2")
                for k in range(0, len(ids), stride):
                    first = (hashlib.blake2b(text.encode(), digest_size=16).digest(), -(-len(ids) // stride)) if k == 0 else (None, None)
                    rows.append((part, at, doc, *first, k // stride, ids[k : k + stride].tobytes()))
                at += 1
                held += len(ids)
                if held > 1 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    def out(rows):
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "row", "doc_id", "digest", "pieces", "piece", "ids"])

    schema = "part int, row long, doc_id long, digest binary, pieces long, piece int, ids binary"
    tokens = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
    tokens.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(tokens.schema).parquet(folder)


def write_numbers(tokens: DataFrame, folder: str) -> int:
    """Writes, for each part of the token table, the number of the first sequence of each of its
    documents, 8 bytes each, and returns how many sequences there are. Only slim rows are sorted;
    equal documents are told apart by their place, so that many of them spread over tasks."""
    docs = tokens.where("piece = 0").select("doc_id", "digest", "part", "row", "pieces")
    order = ["doc_id", "digest", "part", "row"]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged-documents")
    before, total = {}, 0
    for task, n in ranged.groupBy("task").agg(F.sum("pieces")).orderBy("task").collect():  # one row a task
        before[task], total = total, total + n
    if not total:
        return 0
    begins = F.coalesce(F.sum("pieces").over(Window.partitionBy("task").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(tokens.sparkSession.createDataFrame(list(before.items()), "task int, before long"))
    numbered = ranged.withColumn("begins", begins).join(offsets, "task").select("part", "row", (F.col("begins") + F.col("before")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        mine, current, out = attempt(), None, []

        def close():
            with committed(system, path, f"part-{current:06d}.num", mine) as stream:
                stream.write(np.concatenate(out).astype("<i8").tobytes())

        for batch in batches:
            parts, numbers = batch.column("part").to_numpy(), batch.column("number").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]])
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if parts[low] != current:
                    if current is not None:
                        close()
                    current, out = int(parts[low]), []
                out.append(numbers[low:high])
        if current is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["done"])

    filed = map_arrow(numbered.repartition("part").sortWithinPartitions("part", "row"), run, "done int")
    filed.agg(F.sum("done")).collect()
    return total


def same_bytes(system: fs.FileSystem, path: str, content: bytes, step: int = 1 << 20) -> bool:
    """Whether the file is there and holds just these bytes."""
    there = system.get_file_info(path)
    if there.type != fs.FileType.File or there.size != len(content):
        return False
    with system.open_input_file(path) as file:
        return all(file.read(min(step, len(content) - low)) == content[low : low + step] for low in range(0, len(content), step))


def packed(place: np.ndarray, rows: pa.Table, shard_rows: int) -> pa.RecordBatch:
    """(shard, rows, size, block): the rows (doc_id, piece, ids) of each shard in one compressed block of
    ``size`` bytes, in the order of their places: the places, the index records, the ids. Ids of many
    sequences together take much less room in the shuffle than one by one."""
    order = np.argsort(place)
    place, rows = place[order], rows.take(pa.array(order)).combine_chunks()
    data, offsets = text_buffers(rows.column("ids").combine_chunks())
    index = np.empty(len(place), INDEX)
    index["doc_id"] = rows.column("doc_id").fill_null(NO_ID).to_numpy()
    index["piece"], index["n"] = rows.column("piece").to_numpy(), np.diff(offsets) // 2
    shard, codec, out = place // shard_rows, pa.Codec("zstd", compression_level=3), []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    for low, high in zip(cuts, cuts[1:]):
        content = place[low:high].astype("<i8").tobytes() + index[low:high].tobytes() + data[offsets[low] : offsets[high]].tobytes()
        out.append((int(shard[low]), int(high - low), len(content), codec.compress(content, asbytes=True)))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["shard", "rows", "size", "block"])


def unpacked(rows: int, size: int, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, index records and ids of a block."""
    content = pa.Codec("zstd").decompress(block, decompressed_size=size, asbytes=True)
    begin = rows * 8
    return np.frombuffer(content, "<i8", rows), np.frombuffer(content, INDEX, rows, begin), np.frombuffer(content, "<u2", offset=begin + rows * INDEX.itemsize)


def write_shards(tokens: DataFrame, folder: str, stride: int = STRIDE, shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """Writes the shards of a token table and returns the manifest (shard, rows, crc32). The folder
    may hold shards already: those with other bytes are replaced, each in one move."""
    numbers = scratch(tokens.sparkSession, "numbers")
    total = write_numbers(tokens, numbers)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(numbers)
        known, first = None, np.zeros(0, np.int64)
        places, held, size = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, rows = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            number = batch.column("piece").to_numpy().astype(np.int64)
            for part in np.unique(parts):
                if part != known:
                    with system.open_input_file(f"{path}/part-{part:06d}.num") as file:
                        known, first = part, np.frombuffer(file.read(), "<i8")
                own = parts == part
                number[own] += first[rows[own]]
            places.append(permuted(number, total, key))
            held.append(batch.select(["doc_id", "piece", "ids"]))
            size += held[-1].nbytes
            if size > DEALT_BYTES:
                yield packed(np.concatenate(places), pa.Table.from_batches(held), shard_rows)
                places, held, size = [], [], 0
        if held:
            yield packed(np.concatenate(places), pa.Table.from_batches(held), shard_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        mine, shards, current, blocks = attempt(), [], None, []

        def close():
            places, index, ids = map(np.concatenate, zip(*blocks))
            padded = np.full((len(index), stride), END, "<u2")
            padded[np.arange(stride) < index["n"][:, None]] = ids
            order = np.argsort(places)
            data = padded[order].tobytes()
            for name, content in ((f"shard-{current:06d}.idx", index[order].tobytes()), (f"shard-{current:06d}.bin", data)):
                if not same_bytes(system, f"{path}/{name}", content):
                    with committed(system, path, name, mine) as out:
                        out.write(content)
            shards.append((current, len(index), zlib.crc32(data)))

        for batch in batches:
            for shard, *block in zip(*[batch.column(c).to_pylist() for c in ("shard", "rows", "size", "block")]):
                if shard != current:
                    if current is not None:
                        close()
                    current, blocks = shard, []
                blocks.append(unpacked(*block))
        if current is not None:
            close()
        columns = list(zip(*shards)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "rows", "crc32"])

    dealt = map_arrow(tokens.select("part", "row", "doc_id", "piece", "ids"), placed, "shard long, rows long, size long, block binary")
    # shards are numbered without gaps, so no sample of the ids is needed to cut them
    dealt = dealt.repartitionById(max(1, -(-total // shard_rows)), F.col("shard").cast("int")).sortWithinPartitions("shard")
    manifest = map_arrow(dealt, run, "shard long, rows long, crc32 long")
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return tokens.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def read_shards(manifest: DataFrame, folder: str, stride: int = STRIDE, shard_rows: int = SHARD_ROWS, start: int = 0) -> DataFrame:
    """(place, shard, doc_id, piece, n_tokens, ids_crc32) of all sequences from place ``start`` on."""
    shards = manifest.where(F.col("shard") >= start // shard_rows).select("shard", "rows")
    shards = shards.repartition(max(1, shards.count()), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        for batch in batches:
            for shard, rows in zip(batch.column("shard").to_pylist(), batch.column("rows").to_pylist()):
                first = max(0, start - shard * shard_rows)
                with system.open_input_file(f"{path}/shard-{shard:06d}.bin") as ids, system.open_input_file(f"{path}/shard-{shard:06d}.idx") as index:
                    ids.seek(first * stride * 2)
                    index.seek(first * INDEX.itemsize)
                    for low in range(first, rows, 4096):
                        n = min(4096, rows - low)
                        own = np.frombuffer(index.read(n * INDEX.itemsize), INDEX)
                        data = np.frombuffer(ids.read(n * stride * 2), "<u2").reshape(n, stride)
                        crc = [zlib.crc32(data[k, : own["n"][k]].astype("<u4").tobytes()) for k in range(n)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(shard * shard_rows + np.arange(low, low + n)), pa.array([shard] * n, pa.int64()),
                            pa.array(own["doc_id"].astype(np.int64), mask=own["doc_id"] == NO_ID), pa.array(own["piece"].astype(np.int32)),
                            pa.array(own["n"].astype(np.int64)), pa.array(crc, pa.int64()),
                        ], ["place", "shard", "doc_id", "piece", "n_tokens", "ids_crc32"])

    return map_arrow(shards, run, "place long, shard long, doc_id long, piece int, n_tokens long, ids_crc32 long")


def op7_token_shards(spark, sf_dir: str) -> DataFrame:
    tokens = token_table(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), STRIDE, default_path())
    folder = scratch(spark, "shards")
    return read_shards(write_shards(tokens, folder), folder)
