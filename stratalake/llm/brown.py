"""Class-based bigram language model (Brown et al. 1992) with exchange clustering, and the scores of all texts.

``P(w | v) = P(class(w) | class(v)) * P(w | class(w))``: classes come from exchange clustering, transitions are
interpolated with the class frequencies, emissions use absolute discounting.

*Store.* One pass writes each task's texts in blocks of about BLOCK_BYTES as files of word numbers in a numbering of
the block's own, and a table (block, number, word, count): a row for each word of a block, not for each token. One
join gives each block the corpus ids and counts of its words; the later passes read the files of the blocks.

*Clustering.* The exchange objective sums ``n(v, c) log n(v, c) - n(c) log n(c)`` over classes v and c on either side.
Every training word is clustered, from all its bigrams: its profile counts the classes before and after it, so it has
at most 2 * WIDTH cells. The CLASSES most frequent words start as a class each and all others in none (LONE); each
sweep moves half of the words (by hash), each to the class that raises the objective most, to first order, with the
counts of the sweep's start and without the word's own share in its class. The objective is then summed anew: from
the third sweep on, when each word has had a class, moves that do not raise it together are taken back, and once no part's
moves raise it, parts are halved. SWEEPS ends before the objective has settled. Profiles are summed in each block, then by word, a running sum for the
word at hand; the moved words go back to their blocks. The state is a table of classes by classes, all that the driver
holds.

Words of held-out texts alone stay in LONE; the end of a text is a class of its own. Words: white-space runs with A-Z
in lower case; each text ends with one end token.

Defined cases: null and empty texts are one end token; repeated rows count each time; a null doc_id counts as an empty
text in crc32; with no training rows every score is that of the uniform unknown word; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, lean, open_fs, slices, utf8

CLASSES, SWEEPS = 48, 6
BLOCK_BYTES = 32 << 20  # the larger, the fewer rows for a word
LONE, END_CLASS = CLASSES, CLASSES + 1  # words without training tokens or a class yet, and the end of a text
WIDTH = END_CLASS + 1
END_WORD = b"\n"  # no word holds white space
TURNS = 64  # into so many parts at most words are divided by hash
PARTITIONS = 4096  # of the passes over blocks; a task takes its blocks one after the other
BACKOFF = 0.02  # share of the class frequency in a transition
DELTA = 0.1  # of the base model


def save(uri: str, words: list[bytes], arrays: list[np.ndarray]) -> None:
    """A file of int64 lengths, the words and int32 arrays, each compressed."""
    parts = [zstandard.ZstdCompressor(level=1).compress(a) for a in (b" ".join(words), *(a.astype(np.int32).tobytes() for a in arrays))]
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(np.array([len(parts), *map(len, parts)], np.int64).tobytes())
        for p in parts:
            out.write(p)


def load(uri: str, with_words: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[int | None]]:
    """Words by number, token numbers, text lengths, held-out flags and doc_ids of a block."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        n = int(np.frombuffer(f.read(8), np.int64)[0])
        sizes = np.frombuffer(f.read(8 * n), np.int64)
        words, *arrays = [zstandard.ZstdDecompressor().decompress(p) if i or with_words else b"" for i, p in enumerate(f.read(int(s)) for s in sizes)]
    flat, lengths, held, known, high, low = (np.frombuffer(a, np.int32) for a in arrays)
    ids = (high.astype(np.int64) << 32) | low.view(np.uint32).astype(np.int64)
    return words.split(b" "), flat, lengths, held != 0, [int(i) if k else None for i, k in zip(ids, known)]


def put(uri: str, *arrays: np.ndarray) -> None:
    """A file of arrays of their own types, compressed."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    raw = io.BytesIO()
    for a in arrays:
        np.save(raw, a)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(zstandard.ZstdCompressor(level=1).compress(raw.getvalue()))


def take(uri: str, n: int) -> list[np.ndarray]:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        raw = io.BytesIO(zstandard.ZstdDecompressor().decompress(f.read()))
    return [np.load(raw) for _ in range(n)]


class Numbers(dict):
    """Numbers of words, in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def write_store(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks of (doc_id, text, held_out) rows; returns (block, num, word, n): n counts training tokens only.

    A block's file holds its words, token numbers, text lengths, held-out flags and the halves of the doc_ids.
    """
    folder = scratch.path("blocks")
    schema = pa.schema([("block", pa.int64()), ("num", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def store(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers({END_WORD: 0})
        tokens, lengths, held, ids, raw = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal numbers, tokens, lengths, held, ids, raw
            block = uuid.uuid4().int >> 65
            flat = np.concatenate(tokens)
            train = np.repeat(~np.array(held, bool), lengths)
            n = np.bincount(flat[train], minlength=len(numbers))
            known = np.array([i is not None for i in ids])
            wide = np.array([i or 0 for i in ids], np.int64)
            save(f"{folder}/{block}", list(numbers), [flat, np.array(lengths), np.array(held), known, wide >> 32, (wide & 0xFFFFFFFF).astype(np.uint32).view(np.int32)])
            made = pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), block)), pa.array(np.arange(len(numbers)), pa.int32()), pa.array(list(numbers), pa.binary()), pa.array(n, pa.int64())], schema=schema)
            numbers, tokens, lengths, held, ids, raw = Numbers({END_WORD: 0}), [], [], [], [], 0
            return made

        for batch in slices(it):
            for doc_id, text, out in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or b"").lower().split()
                words.append(END_WORD)
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                lengths.append(len(words))
                held.append(out)
                ids.append(doc_id)
                raw += len(text or b"")
                if raw >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), (crc_mod("doc_id", 10) == 0).alias("held_out"))
    with lean(docs.sparkSession):
        return scratch.table(rows.mapInArrow(store, "block long, num int, word binary, n long"), "store")


def bigrams(flat: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token classes and the classes before them."""
    here = classes[flat].astype(np.int32)
    return here, np.concatenate((np.array([END_CLASS], np.int32), here[:-1]))


def objective(table: np.ndarray) -> float:
    """What exchange raises: the log likelihood of the classes' order, but for what no move changes."""
    n = table[table > 0]
    each = [x[x > 0] for x in (table.sum(1), table.sum(0))]
    return float((n * np.log(n)).sum() - sum((x * np.log(x)).sum() for x in each))


def recode(changes: DataFrame, folder: str, blocks: int, step: int, base: int | None = None) -> np.ndarray:
    """Write the blocks' classes of a step; the training counts of class after class under them.

    Without a base it takes (block, num, wid, n, home, turn, class) of all words, else (block, num, class) of the words
    moved since the step ``base``, and a row of number -1 for each block.
    """
    first = base is None

    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(WIDTH * WIDTH, np.int64)
        last, parts = None, []

        def close() -> None:
            nonlocal table
            nums, *cols = (np.concatenate(c) for c in zip(*parts))
            if first:
                order = np.argsort(nums)
                wid, n, home, turn, classes = (c[order] for c in cols)
                put(f"{folder}/numbers/{last}", wid, n, home.astype(bool), turn.astype(np.int8))
            else:
                (classes,) = take(f"{folder}/classes{base}/{last}", 1)
                classes[nums[nums >= 0]] = cols[0][nums >= 0]
            put(f"{folder}/classes{step}/{last}", classes.astype(np.int8))
            _, flat, lengths, held, _ = load(f"{folder}/blocks/{last}", with_words=False)
            here, before = bigrams(flat, classes)
            train = np.repeat(~held, lengths)
            table += np.bincount(before[train] * WIDTH + here[train], minlength=WIDTH * WIDTH)

        for batch in it:
            if not batch.num_rows:
                continue
            block, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(edges, edges[1:]):
                if block[i] != last:
                    if parts:
                        close()
                    last, parts = int(block[i]), []
                parts.append([c[i:j] for c in cols])
        if parts:
            close()
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(table[cells])], names=["cell", "n"])

    table = np.zeros(WIDTH * WIDTH)
    rows = changes.repartition(blocks, "block").sortWithinPartitions("block")
    for cell, n in rows.mapInArrow(write, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        table[cell] = n
    return table.reshape(WIDTH, WIDTH)


def profiles(blocks: DataFrame, folder: str, step: int, turns: int, parts: int) -> DataFrame:
    """(wid, block, num, class, slots, counts) of the words whose turn it is to move, a row a word and block.

    Bytes and uint32 numbers: the word's training counts after (slot v) and before (slot WIDTH + v) class v.
    """

    def binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
        offsets = ((ends - ends[0]) * data.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[ends[0] : ends[-1]].tobytes())])

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (x for b in it for x in b.column(0).to_pylist()):
            wid, _, _, turn = take(f"{folder}/numbers/{block}", 4)
            (classes,) = take(f"{folder}/classes{step}/{block}", 1)
            _, flat, lengths, held, _ = load(f"{folder}/blocks/{block}", with_words=False)
            here, before = bigrams(flat, classes)
            ok = np.flatnonzero(np.repeat(~held, lengths) & (flat > 0) & (turn[flat] % parts == turns))
            base = flat[ok].astype(np.int32 if len(wid) * 2 * WIDTH < 1 << 31 else np.int64) * (2 * WIDTH)
            keys, n = np.unique(np.concatenate([base + before[ok], base + WIDTH + here[ok + 1]]), return_counts=True)
            nums, starts = np.unique(keys // (2 * WIDTH), return_index=True)
            ends, slots, n = np.append(starts, len(keys)), (keys % (2 * WIDTH)).astype(np.uint8), n.astype(np.uint32)
            for i in range(0, len(nums), 20_000):
                part, cut = nums[i : i + 20_000], ends[i : i + 20_001]
                yield pa.RecordBatch.from_arrays([pa.array(wid[part]), pa.array(np.full(len(part), block)), pa.array(part.astype(np.int32)), pa.array(classes[part].astype(np.int32)), binary(cut, slots), binary(cut, n)], names=["wid", "block", "num", "class", "slots", "counts"])

    return blocks.mapInArrow(count, "wid long, block long, num int, class int, slots binary, counts binary")


def place_words(profile: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The classes that raise the objective most, of words by their profiles (words by slots) and classes."""
    state = np.concatenate([table[:, :CLASSES], table[:CLASSES].T])
    both = np.stack([state[:WIDTH].sum(0), state[WIDTH:].sum(0)])
    m = np.stack([profile[:, :WIDTH].sum(1), profile[:, WIDTH:].sum(1)], 1)
    gain = profile @ np.log(state + 0.5) - m @ np.log(both + 0.5 * WIDTH)
    at = np.flatnonzero(own < CLASSES)
    p, now = profile[at], own[at]
    mine = (p * np.log(np.maximum(state[:, now].T - p, 0) + 0.5)).sum(1)
    gain[at, now] = mine - (m[at] * np.log(np.maximum(both[:, now].T - m[at], 0) + 0.5 * WIDTH)).sum(1)
    return gain.argmax(1)


def moves(profile: DataFrame, table: np.ndarray) -> DataFrame:
    """(block, num, class) of the words that change their class, for each block that has them."""

    def cells(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        size = np.dtype(kind).itemsize
        return np.diff(ends) // size, np.frombuffer(data.slice(int(ends[0]), int(ends[-1] - ends[0])), kind)

    def moved(profile: np.ndarray, own: np.ndarray, word: np.ndarray, block: np.ndarray, num: np.ndarray) -> pa.RecordBatch:
        to = place_words(profile, own, table)
        far = np.flatnonzero((to != own)[word])
        return pa.RecordBatch.from_arrays([pa.array(block[far]), pa.array(num[far]), pa.array(to[word[far]], pa.int32())], names=["block", "num", "class"])

    def merge(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # of the last word, which may go on: number, class, sums, places

        def close() -> pa.RecordBatch:
            places = [np.concatenate(x) for x in zip(*held[3])]
            return moved(held[2][None], np.array([held[1]]), np.zeros(len(places[0]), np.int64), *places)

        for batch in it:
            if not batch.num_rows:
                continue
            wid, block, num, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = np.concatenate(([True], wid[1:] != wid[:-1]))
            word = np.cumsum(new) - 1
            sizes, slots = cells(batch.column(4), np.uint8)
            _, counts = cells(batch.column(5), np.uint32)
            sums = np.bincount(np.repeat(word, sizes) * (2 * WIDTH) + slots, counts, (word[-1] + 1) * 2 * WIDTH).reshape(-1, 2 * WIDTH)
            begin = 0
            if held and held[0] == wid[0]:
                begin = int(np.searchsorted(word, 1))
                held = (*held[:2], held[2] + sums[0], [*held[3], (block[:begin], num[:begin])])
            if begin == len(wid):
                continue
            if held:
                yield close()
            end, first = int(np.searchsorted(word, word[-1])), int(word[begin])
            if end > begin:
                yield moved(sums[first:-1], own[new][first:-1], word[begin:end] - first, block[begin:end], num[begin:end])
            held = wid[-1], own[-1], sums[-1], [(block[end:], num[end:])]
        if held:
            yield close()

    return profile.repartition("wid").sortWithinPartitions("wid").mapInArrow(merge, "block long, num int, class int")


def blocks_of(it: Iterable[pa.RecordBatch], folder: str, step: int) -> Iterator[tuple]:
    """(token classes, token counts, classes before, lengths, held out, doc_ids) of blocks."""
    for block in (x for b in it for x in b.column(0).to_pylist()):
        _, n, *_ = take(f"{folder}/numbers/{block}", 4)
        (classes,) = take(f"{folder}/classes{step}/{block}", 1)
        _, flat, lengths, held, ids = load(f"{folder}/blocks/{block}", with_words=False)
        here, before = bigrams(flat, classes)
        yield here, n[flat], before, lengths, held, ids


def class_words(blocks: DataFrame, folder: str, step: int) -> DataFrame:
    """(word, n, class) of all words, each from the block that is its home."""

    def emit(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (x for b in it for x in b.column(0).to_pylist()):
            _, n, home, _ = take(f"{folder}/numbers/{block}", 4)
            (classes,) = take(f"{folder}/classes{step}/{block}", 1)
            words = load(f"{folder}/blocks/{block}")[0]
            at = np.flatnonzero(home)
            for i in range(0, len(at), 20_000):
                part = at[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in part], pa.binary()), pa.array(n[part]), pa.array(classes[part].astype(np.int32))], names=["word", "n", "class"])

    return blocks.mapInArrow(emit, "word binary, n long, class int")


def class_model(docs: DataFrame, scratch: Scratch, sweeps: int = SWEEPS) -> tuple[DataFrame, dict]:
    """Blocks and the model: N, V, transition and unknown-word log10 probabilities, class sums, discount."""
    spark, folder = docs.sparkSession, scratch.uri
    store = write_store(docs, scratch)
    counts = store.groupBy("word").agg(F.sum("n").alias("n"), F.min("block").alias("home")).withColumn("wid", F.monotonically_increasing_id())
    counts = scratch.table(counts, "counts")
    is_end = F.col("word") == F.lit(END_WORD)
    frequent = counts.where((F.col("n") > 0) & ~is_end).orderBy(F.desc("n"), "word").limit(CLASSES).collect()
    first = F.when(is_end, END_CLASS)
    for i, r in enumerate(frequent):
        first = first.when(F.col("word") == F.lit(bytes(r.word)), i)
    counts = counts.select("word", "wid", "n", "home", F.expr(f"cast(pmod(xxhash64(word), {TURNS}) as int)").alias("turn"), first.otherwise(LONE).alias("class"))
    blocks = scratch.table(store.where("num = 0").select("block"), "block_list")
    size = min(max(1, blocks.count()), PARTITIONS)
    blocks = blocks.repartition(size, "block")
    numbers = store.select("block", "num", "word").join(counts, "word").select("block", "num", "wid", "n", (F.col("home") == F.col("block")).cast("int").alias("home"), "turn", "class")
    marks = blocks.select("block", F.lit(-1).alias("num"), F.lit(-1).alias("class"))
    with lean(spark):
        table = recode(numbers, folder, size, 0)
        base, trace, parts, refused = 0, [objective(table)], 2, 0
        for step in range(1, sweeps + 1):
            new = recode(moves(profiles(blocks, folder, base, step % parts, parts), table).unionByName(marks), folder, size, step, base)
            better = step <= 2 or objective(new) > trace[-1]
            scratch.drop(f"classes{base if better else step}")
            base, table = (step, new) if better else (base, table)
            # Where each part in turn was refused, nothing would change any more: parts of half the size are tried.
            refused = 0 if better else refused + 1
            if refused == parts:
                parts, refused = min(2 * parts, TURNS), 0
            trace.append(objective(table))
    scratch.drop("store", "counts")
    words = scratch.table(class_words(blocks, folder, base), "words")
    sums = words.groupBy("class").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")).collect()
    total, types = np.zeros(WIDTH), np.zeros(WIDTH)
    for r in sums:
        total[r["class"]], types[r["class"]] = r.n, r.v
    once, twice = sum(r.n1 for r in sums), sum(r.n2 for r in sums)
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    N = total.sum()
    prior = total / max(N, 1)
    rows = table.sum(1, keepdims=True)
    step = np.where(rows > 0, (1 - BACKOFF) * table / np.maximum(rows, 1) + BACKOFF * prior, prior)
    lost = np.where(total > 0, discount * types / np.maximum(total, 1), 0)
    lost[END_CLASS] = 0
    with np.errstate(divide="ignore"):
        model = {"N": int(N), "V": int(types.sum()), "step": np.log10(step), "unknown": np.log10(step @ lost) if N else np.zeros(WIDTH), "total": total, "discount": discount, "classes": base, "objective": trace}
    return blocks, model


def score_texts(docs: DataFrame, scratch: Scratch, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    blocks, model = class_model(docs, scratch, sweeps)
    folder = scratch.uri
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        N, V, d, total = m["N"], m["V"], m["discount"], m["total"]
        for here, n, before, lengths, held, ids in blocks_of(it, folder, m["classes"]):
            base = np.log10((n + DELTA) / (N + DELTA * (V + 1)))
            off = np.where(here == END_CLASS, 0, d)
            with np.errstate(divide="ignore"):
                known = m["step"][before, here] + np.log10(np.maximum(n - off, 1e-9)) - np.log10(np.maximum(total[here], 1))
            own = np.where(n > 0, known, m["unknown"][before])
            starts = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x, starts) for x in ((n > 0).astype(np.int64), base, own)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(lengths, pa.int64()), pa.array(sums[0]), pa.array(np.full(len(ids), N)), pa.array(sums[1]), pa.array(sums[2])], schema=schema)

    out = scratch.table(blocks.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    scratch.drop("blocks", "block_list", "numbers", "words", f"classes{model['classes']}")
    return out
