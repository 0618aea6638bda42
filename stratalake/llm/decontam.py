"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton recognises every run of words that occurs in some item. Texts are streamed through it: after each word
it holds the longest suffix that occurs in an item (the *matching length*). A run of ``window`` words is a hit; an
item with fewer words is a hit where it occurs whole. Words no item has end every match, so only stretches of known
words that are long enough are streamed.

The items are the query set: they are cut in blocks of at most BLOCK_WORDS words, each with an automaton of its own:
arrays, and dictionaries for the states with several ways on, measured 26 MB in a worker and 14 MB as plain values for
300,000 words, so about 140 MB a block. A single block is broadcast. Of several, each is a file in the shared scratch folder; a task runs a batch of texts through
one after the other, so it never holds more than one.

Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case.

Defined cases: null or wordless texts have no words and no hits; items without words are never found; items with
equal ids count once; a null item_id is named ``null``; an empty benchmark finds nothing; repeated rows are scanned
each; other columns are kept where rows are returned (:func:`drop_leaks`, :func:`excise`) and not read.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, open_fs, slices, utf8

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: The arrays of an automaton.
ARRAYS = ("link", "size", "word", "to", "near", "at", "lengths", "items")
#: Bytes of words stay (capitals in lower case), all others become a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Automaton:
    """A generalised suffix automaton over items' words, with the windows that end at each state.

    A state's first way on is in two arrays, further ones in ``more``; ``near`` is the nearest state on the way to the
    root, itself included, that stands for windows, and ``at`` where these begin in ``lengths`` and ``items``.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.link, self.size, self.word, self.to = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        coded = [(name, array("i", (self.ids.setdefault(w, len(self.ids)) for w in words))) for name, words in items if words]
        self.least = min((min(window, len(w)) for _, w in coded), default=window)
        self.names = sorted({name for name, _ in coded})
        number = {name: i for i, name in enumerate(self.names)}
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        found = [array("q"), array("q"), array("q")]  # state, words, item
        for name, words in coded:
            whole, item = len(words) < window, number[name]
            need = len(words) if whole else window
            for at, state, length in self.stream(words):
                if length >= need and (not whole or at == len(words) - 1):
                    while self.size[self.link[state]] >= need:
                        state = self.link[state]
                    for column, x in zip(found, (state, need, item)):
                        column.append(x)
        state, lengths, owners = np.unique(np.array(found, np.int64), axis=1)
        self.lengths, self.items = array("i", lengths.tolist()), array("i", owners.tolist())
        self.at = array("i", np.searchsorted(state, np.arange(len(self.size) + 1)).tolist())
        self.near = array("i", [-1]) * len(self.size)
        for v in np.argsort(np.array(self.size), kind="stable")[1:].tolist():
            self.near[v] = v if self.at[v] < self.at[v + 1] else self.near[self.link[v]]

    def packed(self) -> tuple:
        """Plain values, from which :meth:`unpacked` makes the automaton again."""
        more = array("i", (x for v, ways in self.more.items() for w, to in ways.items() for x in (v, w, to)))
        return (self.least, self.names, b" ".join(self.ids), more.tobytes(), *(getattr(self, k).tobytes() for k in ARRAYS))

    @classmethod
    def unpacked(cls, packed: tuple) -> Automaton:
        self = cls.__new__(cls)
        self.least, self.names, words, more, *arrays = packed
        self.ids = {w: i for i, w in enumerate(words.split(b" "))} if words else {}
        for k, x in zip(ARRAYS, arrays):
            setattr(self, k, array("i", x))
        self.more, triples = {}, array("i", more)
        for v, w, to in zip(triples[::3], triples[1::3], triples[2::3]):
            self.more.setdefault(v, {})[w] = to
        return self

    def _next(self, state: int, w: int) -> int:
        return self.to[state] if self.word[state] == w else self.more[state].get(w, -1) if state in self.more else -1

    def _lead(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (w, -1):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _state(self, size: int, link: int) -> int:
        for column, x in ((self.size, size), (self.link, link), (self.word, -1), (self.to, -1)):
            column.append(x)
        return len(self.size) - 1

    def _extend(self, last: int, w: int) -> int:
        def split(p: int, q: int) -> int:
            clone = self._state(self.size[p] + 1, self.link[q])
            self.word[clone], self.to[clone] = self.word[q], self.to[q]
            if q in self.more:
                self.more[clone] = dict(self.more[q])
            self.link[q] = clone
            while p >= 0 and self._next(p, w) == q:
                self._lead(p, w, clone)
                p = self.link[p]
            return clone

        if (q := self._next(last, w)) >= 0:  # an item before has this run
            return q if self.size[q] == self.size[last] + 1 else split(last, q)
        new, p = self._state(self.size[last] + 1, 0), last
        while p >= 0 and self._next(p, w) < 0:
            self._lead(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, w)
            self.link[new] = q if self.size[q] == self.size[p] + 1 else split(p, q)
        return new

    def stream(self, ids: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, matching length) after each word."""
        word, to, more, link, size, state, length, none = self.word, self.to, self.more, self.link, self.size, 0, 0, {}
        for i, w in enumerate(ids):
            while True:
                new = to[state] if word[state] == w else more.get(state, none).get(w, -1)
                if new >= 0:
                    state, length = new, length + 1
                    break
                if not state:
                    break
                state = link[state]
                length = size[state]
            yield i, state, length

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged word spans [from, to) covered by windows, the items found, and the longest matching length."""
        ids = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        most = 0
        for begin, end in known.reshape(-1, 2):
            if end - begin < self.least:
                continue
            for i, state, length in self.stream(ids[begin:end].tolist()):
                v, reach = self.near[state], 0
                most = max(most, length)
                while v > 0:
                    for k in range(self.at[v], self.at[v + 1]):
                        if (n := self.lengths[k]) <= length:
                            items.add(self.items[k])
                            reach = max(reach, n)
                    v = self.near[self.link[v]]
                if reach:
                    a, b = int(begin) + i + 1 - reach, int(begin) + i + 1
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, b))
        return spans, {self.names[k] for k in items}, most


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items (item_id, text) in blocks of at most block_words words (or one longer item), in no set order."""
    block, n = [], 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), utf8("text").alias("text"))
    for row in rows.toLocalIterator():
        words = words_of(None if row.text is None else bytes(row.text))
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((row.item_id, words))
        n += len(words)
    if block:
        yield block


def others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c.lower() != "text"]


def restored(docs: DataFrame) -> list[Column]:
    """The columns of docs from a scan's row and words."""
    return [F.col("words").cast("string").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns]


def stored(uri: str, packed: tuple) -> str:
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(pickle.dumps(packed))
    return uri


def fetched(uri: str) -> tuple:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return pickle.loads(f.read())


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs' columns but the text as a struct ``row``, the text's bytes as ``words``, n_words, spans (word positions
    [a, b), flat), items (sorted) and longest (matching length)."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in others(docs)])
    rows = docs.select(row.alias("row"), utf8("text").alias("words"))
    blocks, files = item_blocks(items, block_words), []
    one = Automaton(next(blocks, []), window).packed()  # without items, an empty automaton still counts the words
    for block in blocks:
        if not files:
            folder = Scratch(spark, "items")
            files.append(stored(folder.path("0"), one))
        files.append(stored(folder.path(str(len(files))), Automaton(block, window).packed()))
    shared = spark.sparkContext.broadcast(None if files else one)

    def stream(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None if files else Automaton.unpacked(shared.value)
        for batch in it if files else slices(it):  # with several blocks, each is read once for a whole batch
            spans, names, longest, counts = [], [], [], []
            for k, source in enumerate(files or [None]):
                if source is not None:
                    machine = Automaton.unpacked(fetched(source))
                for i in range(batch.num_rows):
                    words = words_of(batch.column(1)[i].as_py())
                    got, found, most = machine.hits(words) if words else ([], set(), 0)
                    flat = [x for s in got for x in s]
                    if k:
                        spans[i], longest[i] = merge(flat, spans[i]), max(most, longest[i])
                        names[i] |= found
                    else:
                        spans.append(flat)
                        names.append(found)
                        longest.append(most)
                        counts.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(longest, pa.int32()), pa.array(counts, pa.int64())], names=["row", "words", "spans", "items", "longest", "n_words"])

    made = (F.lit(None).cast(t).alias(c) for c, t in (("spans", "array<int>"), ("items", "array<string>"), ("longest", "int"), ("n_words", "long")))
    out = rows.mapInArrow(stream, rows.select("*", *made).schema)
    return out.withColumns({"spans": F.coalesce("spans", F.array().cast("array<int>")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def merge(a: list[int], b: list[int]) -> list[int]:
    """The union of two flat lists of spans."""
    out: list[int] = []
    for begin, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def n_hit() -> Column:
    """Words inside the spans."""
    return F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")))["sum"]


def decontamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, spans) of each row."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), items, window, block_words)
    return found.select("row.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "longest", "spans")


def drop_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.0) -> DataFrame:
    """The rows of docs whose share of hit words is at most max_coverage (by default: those without a hit)."""
    return scan(docs, items, window).where(n_hit() <= F.col("n_words") * max_coverage).select(*restored(docs))


def excise(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """docs with the hit spans of more than max_span words cut out of the text; rows covered above max_coverage go.

    What stands between the words of a span goes with it, what stands beside it stays. Null and wordless texts, and those
    without such a span, stay as they are; repeated rows are cut each; an empty benchmark or table changes nothing.
    """

    def cut(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                long = [(a, b) for a, b in zip(spans[::2], spans[1::2]) if b - a > max_span]
                if long:
                    at = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
                    kept, last = [], 0
                    for a, b in long:
                        kept.append(text[last : at[a][0]])
                        last = at[b - 1][1]
                    text = b"".join([*kept, text[last:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "words"])

    found = scan(docs, items, window).where(n_hit() <= F.col("n_words") * max_coverage)
    part = found.select("row", "words", "spans")
    return part.mapInArrow(cut, part.drop("spans").schema).select(*restored(docs))
