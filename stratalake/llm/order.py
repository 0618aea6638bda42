"""Token-id output in training order: packed sequences, a keyed permutation of them, fixed-stride binary shards.

All texts are tokenised, closed with an end token each and joined to one stream in the order of the table, cut into
sequences of ``seq_len`` tokens. A keyed Feistel network with cycle-walking sends the index of a sequence to its
*slot*, a bijection on 0..n-1 that needs no table. Slots are dealt to shards by range; a shard is a file of
sequences of equal length, so that slot s lies at ``(s % shard_sequences) * stride`` and a run resumes at any slot.

The texts are tokenised once, to a table of token ids with each text's place among those of its scan task; the tasks'
totals (a number each) then fix where every text starts in the stream, however the table is read again. The sequences
are moved and written in WAVES ranges of shards, so that the shuffle of one is gone before the next begins.

Defined cases: null and empty texts give no tokens, and so no end token; repeated rows are repeated in the stream; a
text longer than a sequence runs on into the next ones; the last sequence is padded with the end token and has
``n_tokens`` below seq_len; an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, open_fs, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary's publisher gives for splitting texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
MAX_VOCABULARY = 64 << 20
WAVES = 4
SEQUENCE = "slot long, sequence long, shard int, path string, offset long, n_tokens int, doc_ids array<long>"


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slots of these indexes below n: a keyed bijection on 0..n-1.

    A balanced network permutes the smallest even power of two from n on; what falls beyond n walks on along its
    cycle until it comes back below n. The power is below 4 n, so that few steps are needed.
    """
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(uuid.uuid5(uuid.NAMESPACE_OID, f"{key}/{r}").bytes[:8], "big")) for r in range(rounds)]

    def mix(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def permute(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right, k) & mask)
        return (left << bits) | right

    with np.errstate(over="ignore"):
        out = permute(np.asarray(index, dtype=np.uint64))
        while (beyond := out >= np.uint64(n)).any():
            out[beyond] = permute(out[beyond])
    return out.astype(np.int64)


class Tokeniser:
    """Token ids of texts as little-endian 16-bit bytes."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        if max(ranks.values()) >= END:
            raise ValueError("the vocabulary must leave the end token free and fit 16 bits")
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()


def token_table(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(part, start, doc_id, ids): the tokens of each text with an end token, after ``start`` others of its task."""

    def encode(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, at = Tokeniser(words.value), TaskContext.get().partitionId(), 0
        for batch in slices(it):
            rows = [(i, t) for i, t in zip(*(c.to_pylist() for c in batch.columns)) if t]
            ids = [tokens.encode(t) + END.to_bytes(2, "little") for _, t in rows]
            ends = np.cumsum([len(x) // 2 for x in ids], dtype=np.int64)
            starts = at + np.concatenate(([0], ends))
            at = int(starts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(starts[:-1]), pa.array([i for i, _ in rows], pa.int64()), pa.array(ids, pa.binary())], names=["part", "start", "doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, "part int, start long, doc_id long, ids binary")


def materialise_order(
    docs: DataFrame,
    scratch: Scratch,
    key: int = 20_240_229,
    seq_len: int = 2048,
    shard_sequences: int = 8192,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Write the shards of (doc_id, text) rows; a row a sequence, with its slot, shard, path, offset and documents.

    The vocabulary is broadcast; its size is checked. The totals by scan task (a number each) pass the driver.
    """
    spark = docs.sparkSession
    fs, path = open_fs(vocabulary if ":" in vocabulary else f"file:{vocabulary}")
    with fs.open_input_file(path) as f:
        if f.size() > MAX_VOCABULARY:
            raise ValueError(f"the vocabulary has {f.size()} bytes; at most {MAX_VOCABULARY} are broadcast")
        words = spark.sparkContext.broadcast(f.read())
    with lean(spark):
        table = scratch.table(token_table(docs, words), "tokens", compression="zstd")
    ends = table.groupBy("part").agg(F.max(F.col("start") + F.octet_length("ids") / 2).cast("long").alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(ends):
        starts[r.part], total = total, total + r.n
    if not total:
        return spark.createDataFrame([], SEQUENCE)
    n = -(-total // seq_len)
    at = spark.sparkContext.broadcast(starts)
    fields = pa.schema([("shard", pa.int32()), ("slot", pa.int64()), ("sequence", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def cut(it: Iterable[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        """Pieces of the sequences that lie in the shards from low to below high."""
        for batch in slices(it):
            part, start, doc_id, ids = (c.to_pylist() for c in batch.columns)
            begin = np.array([at.value[p] + s for p, s in zip(part, start)], np.int64)
            end = begin + [len(x) // 2 for x in ids]
            first, last = begin // seq_len, (end - 1) // seq_len
            row = np.repeat(np.arange(len(ids)), last - first + 1)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            slot = feistel(sequence, n, key)
            own = np.flatnonzero((slot // shard_sequences >= low) & (slot // shard_sequences < high))
            row, sequence, slot = row[own], sequence[own], slot[own]
            a = np.maximum(begin[row], sequence * seq_len)
            b = np.minimum(end[row], (sequence + 1) * seq_len)
            pieces = [ids[r][2 * i : 2 * j] for r, i, j in zip(row.tolist(), (a - begin[row]).tolist(), (b - begin[row]).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array((slot // shard_sequences).astype(np.int32)), pa.array(slot), pa.array(sequence), pa.array((a - sequence * seq_len).astype(np.int32)), pa.array([doc_id[r] for r in row.tolist()], pa.int64()), pa.array(pieces, pa.binary())], schema=fields)

    folder, stride = scratch.path("shards"), 2 * seq_len
    out = pa.schema([("slot", pa.int64()), ("sequence", pa.int64()), ("shard", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64()))])

    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, now, rows = None, "", None, []
        held: tuple | None = None  # slot, sequence, shard, pieces, doc_ids

        def close(x: tuple) -> tuple:
            data = b"".join(x[3])
            file.write(data + END.to_bytes(2, "little") * (seq_len - len(data) // 2))
            return x[0], x[1], x[2], name, x[0] % shard_sequences * stride, len(data) // 2, list(dict.fromkeys(x[4]))

        for batch in slices(it):
            for shard, slot, sequence, _, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == slot:
                    held[3].append(ids)
                    held[4].append(doc_id)
                    continue
                if held:
                    rows.append(close(held))
                held = (slot, sequence, shard, [ids], [doc_id])
                if shard != now:
                    if file:
                        file.close()
                    to, path = open_fs(name := f"{folder}/shard-{shard:08d}-{uuid.uuid4().hex[:12]}.bin")
                    to.create_dir(path.rpartition("/")[0], recursive=True)
                    file, now = to.open_output_stream(path), shard
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows = []
        if held:
            rows.append(close(held))
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    shards = -(-n // shard_sequences)
    waves = min(WAVES, shards)
    out_rows = None
    with lean(spark):
        for w in range(waves):
            low, high = w * shards // waves, (w + 1) * shards // waves
            pieces = table.mapInArrow(lambda it, low=low, high=high: cut(it, low, high), "shard int, slot long, sequence long, pos int, doc_id long, ids binary")
            dealt = pieces.repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("slot", "pos")
            wave = scratch.table(dealt.mapInArrow(write, SEQUENCE), f"manifest-{w}")
            out_rows = wave if out_rows is None else out_rows.union(wave)
    scratch.drop("tokens")
    return out_rows


def read_slots(manifest: DataFrame, start: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens) in training order from slot start on: a reader for one training process.

    It fetches the paths of the shards (a few bytes each) and then reads the files one after another.
    """
    shards = manifest.where(F.col("slot") >= start).groupBy("shard").agg(F.min("path").alias("path"), F.min("slot").alias("slot"), F.min("offset").alias("offset"), F.count("*").alias("n")).orderBy("slot")
    length = manifest.agg(F.max("n_tokens")).first()[0]
    for row in shards.toLocalIterator():
        fs, path = open_fs(row.path)
        with fs.open_input_file(path) as f:
            f.seek(row.offset)
            for slot in range(row.slot, row.slot + row.n):
                if count is not None and slot >= start + count:
                    return
                yield slot, np.frombuffer(f.read(2 * length), "<u2")
