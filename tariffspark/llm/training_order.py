"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed stride.

Documents are tokenised and packed, each followed by the end token, into
sequences of ``length`` token ids (16 bits each); only the last sequence of a
task is padded. Sequences are numbered over the written table, and a keyed
Feistel network over the next even number of bits, walked until it falls below
the number of sequences, turns the number into a global slot: a permutation
that needs no memory, no sort of random numbers and can be inverted. Rows are
range-partitioned by shard, so that every shard is one run of slots of one
task, and record ``slot`` of the training order lies at a known byte.

The order is a function of the key and of the written sequences; sequences
depend on how the input is split into tasks, as packing does not cross them.

Defined results: null texts give no tokens and no end token; empty texts give
an end token; documents without an id stand as null in the lists; repeated rows
are packed as often as they come; an empty table gives no sequences; other
columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.llm.lookups import bounded
from tariffspark.session import shared_folder

ROUNDS = 6


def encoder(ranks_path: str | None, end_token: int = 50256):
    """Function that builds (texts -> arrays of ids) in a task; without a path, ids are bytes and 256 ends a text.

    The ranks file has to be present on every executor, as a package's file is.
    """

    def build():
        import numpy as np

        if ranks_path is None:
            return lambda texts: [np.append(np.frombuffer(t.encode(), dtype=np.uint8).astype(np.uint16), np.uint16(256)) for t in texts]
        import base64

        import tiktoken

        # Fixed value: how the public byte-level vocabularies cut a text before merging.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(texts):
            return [np.append(np.asarray(coder.encode_ordinary(t), dtype=np.uint16), np.uint16(end_token)) for t in texts]

        return encode

    return build


def _packer(build, length: int, pad: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part = build(), TaskContext.get().partitionId()
        kinds = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int32()), ("tokens", pa.binary())])
        held, owners, at = np.empty(0, dtype=np.uint16), [], 0  # owners: (doc, first token beyond it), in the held tokens

        def rows(full):
            nonlocal held, owners, at
            out, start = [], 0
            size = len(held)
            first = 0
            while size - start >= length or not full and start < size:
                end = min(start + length, size)
                ids, k = [], first
                while k < len(owners):
                    ids.append(owners[k][0])
                    if owners[k][1] > end:
                        break
                    k += 1
                first = k
                piece = held[start:end]
                if end - start < length:
                    piece = np.concatenate([piece, np.full(length - len(piece), pad, dtype=np.uint16)])
                out.append((part, at, ids, end - start, piece.astype("<u2").tobytes()))
                at, start = at + 1, end
            held, owners = held[start:].copy(), [(d, e - start) for d, e in owners[first:] if e > start]
            return out

        def batch_of(out):
            return pa.record_batch([pa.array([r[i] for r in out], kinds.field(i).type) for i in range(5)], schema=kinds)

        for batch in batches:
            pairs = [(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None]
            parts, size = [held], len(held)
            for (doc, _), ids in zip(pairs, encode([t for _, t in pairs])):
                parts.append(ids)
                size += len(ids)
                owners.append((doc, size))
            held = np.concatenate(parts)
            if out := rows(True):
                yield batch_of(out)
        if len(held):
            yield batch_of(rows(False))

    return run


def permutation(n: int, key: int):
    """numpy array of places below ``n`` -> slots below ``n``; with ``inverse=True`` the way back."""

    def slots(places, inverse=False):
        import numpy as np

        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        mask, size = np.uint64((1 << half) - 1), np.uint64(half)
        keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % (1 << 64)) for i in range(ROUNDS)]

        def mixed(x, k):
            x = (x ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(32))) & mask

        def once(x):
            left, right = x >> size, x & mask
            if inverse:
                for k in reversed(keys):
                    left, right = right ^ mixed(left, k), left
            else:
                for k in keys:
                    left, right = right, left ^ mixed(right, k)
            return (left << size) | right

        x = once(np.asarray(places, dtype=np.uint64))
        while (out := x >= np.uint64(n)).any():
            x[out] = once(x[out])
        return x.astype(np.int64)

    return slots


def ordered(docs: DataFrame, ranks_path: str | None, length: int = 1024, shard_rows: int = 4096, key: int = 1, end_token: int = 50256,
            id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (slot, shard, record, byte_offset, doc_ids, n_tokens, tokens) in the order of slots."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    pad = end_token if ranks_path is not None else 256
    packed = source.mapInArrow(_packer(encoder(ranks_path, end_token), length, pad), "part int, at long, doc_ids array<long>, n_tokens int, tokens binary")
    path = f"{shared_folder(spark)}/sequences-{uuid.uuid4().hex}"
    packed.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(packed.schema).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per input task
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    offsets = bounded(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    permute = permutation(max(int(n), 1), key)

    @F.pandas_udf("long")
    def slot(places):
        import pandas as pd

        return pd.Series(permute(places.to_numpy()))

    placed = table.join(offsets, "part").withColumn("slot", slot(F.col("before") + F.col("at")))
    shard = F.expr(f"slot div {shard_rows}").cast("int")
    record = (F.col("slot") % shard_rows).cast("int")
    rows = placed.select("slot", shard.alias("shard"), record.alias("record"), (record.cast("long") * (2 * length)).alias("byte_offset"), "doc_ids", "n_tokens", "tokens")
    return rows.repartitionByRange(F.col("shard")).sortWithinPartitions("slot")


def write_shards(rows: DataFrame, uri: str) -> DataFrame:
    """Write ``ordered`` rows as files of fixed stride; (shard, records, bytes, crc32) of what was written.

    Any store that ``pyarrow.fs`` names by URI will do. A shard is written
    under a name of its own attempt and then moved, so that repeated and lost
    attempts leave whole files only.
    """

    def run(batches):
        import uuid as unique
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        kinds = pa.schema([("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())])
        now, stream, temporary, done = None, None, None, []

        def close():
            stream.close()
            store.move(temporary, f"{root}/shard-{now[0]:06d}.bin")
            done.append(tuple(now))

        for batch in batches:
            names = batch.schema.names
            for shard, tokens in zip(batch.column(names.index("shard")).to_pylist(), batch.column(names.index("tokens")).to_pylist()):
                if now is None or now[0] != shard:
                    if now is not None:
                        close()
                    now, temporary = [shard, 0, 0, 0], f"{root}/_{shard}-{unique.uuid4().hex}"
                    stream = store.open_output_stream(temporary)
                stream.write(tokens)
                now[1:] = now[1] + 1, now[2] + len(tokens), zlib.crc32(tokens, now[3])
        if now is not None:
            close()
        yield pa.record_batch([pa.array([d[i] for d in done], kinds.field(i).type) for i in range(4)], schema=kinds)

    return rows.mapInArrow(run, "shard int, records long, bytes long, crc32 long")


def read_from(uri: str, slot: int, length: int, shard_rows: int):
    """Sequences from ``slot`` on, in training order; how a trainer resumes."""
    import numpy as np
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    stride = 2 * length
    shard, record = divmod(slot, shard_rows)
    while store.get_file_info(name := f"{root}/shard-{shard:06d}.bin").type == fs.FileType.File:
        with store.open_input_file(name) as f:
            f.seek(record * stride)
            while len(block := f.read(stride)) == stride:
                yield np.frombuffer(block, dtype="<u2")
        shard, record = shard + 1, 0
