"""Exact n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Two documents link when the sets of their 5-word shingles have a Jaccard similarity of 0.8 or more. No pair is lost:

1. Equal sets become one *node*, by a hash of 128 bits; a written table gives nodes their ids. Shingles are 64-bit
   hashes, ordered by value. A set of n shingles gives its ``n - ceil(0.8 n) + n // 10`` smallest ones: two linked sets
   have at least ``ceil(0.8 n) // 10`` of these in common, for either's n. Shingles that one node alone gives are gone
   after one count, and with them the nodes with too few left. The others are *live*. Of a live node's whole set,
   ``ceil(0.8 n)`` must be in another live node's; of these it leaves out the ``ceil(0.8 n) - 1`` most frequent, and
   meets any partner at one of the rest, its *keys*.
2. *Block rounds*: nodes with the same least key meet in blocks of bounded size, where links are followed but not
   within a component. One node of each component goes on to the next round, so a group of many copies shrinks by up
   to the block size each round and never forms all its pairs.
3. *Tiles*: for every key, nodes of different components so far meet in tiles of a size band and the one below (sets
   further apart in size can't link); large tiles are cut in chunks, and pairs of chunks go to tasks of their own.
   Bit counts of the signatures bound the overlap from above: nodes without a possible partner leave the tile. The
   sorted sets of the others meet in the same tile again, and are intersected exactly. A tile gives links only, and
   none within what it has already joined: fewer than it has nodes, also where thousands of copies of one text link
   with it alone.

Counts of a shingle or a key are sums made in the tasks first, joined back by sort and merge, where Spark can split
the partition of a frequent one. The edges left for the connected components are between the components of step 2.

Defined cases: null and empty texts have an empty set and link with nothing; below five words the whole sequence is
one shingle; rows with one doc_id are one document to the links, each row with its own n_shingles; rows without
doc_id link with nothing and have no component; ties need no rule (components don't depend on order); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, slices, utf8
from .graph import components

WORDS = 5
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # nodes and shingles of a block, and of each of a tile's two chunks
ROUNDS = 2
CACHED = 200_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Shingler(dict):
    """Sorted arrays of distinct shingle hashes; words' hashes are cached."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def set(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            k = min(WORDS, len(h))
            out = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                out = (out ^ h[i : len(h) - k + 1 + i]) * MIX[0]
                out ^= out >> np.uint64(29)
            out = (out ^ (out >> np.uint64(30))) * MIX[1]
            out = (out ^ (out >> np.uint64(27))) * MIX[2]
        return np.unique(out ^ (out >> np.uint64(31)))


def need(n: int) -> int:
    """The overlap that a set of n shingles must have with any partner; also the least size of a partner."""
    return -(-4 * n // 5)


def shared_least(n: int) -> int:
    """How many prefix shingles a set of n shingles shares with any partner at least."""
    return max(1, need(n) // 10)


def prefix(n: int) -> int:
    return n - need(n) + max(1, n // 10)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 |a & b| >= 80 |a | b| for sorted arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return 9 * int((large[at] == small).sum()) >= 4 * (len(a) + len(b))


def signature(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of a power of two bits, two or more for each shingle."""
    size = max(64, 1 << (2 * max(1, len(shingles)) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """The signature over fewer bits: the lower bits of the hashes decide, so halves are laid over each other."""
    while len(sig) > words:
        sig = sig[: len(sig) // 2] | sig[len(sig) // 2 :]
    return sig


def may_link(sig: np.ndarray, n: int, sigs: np.ndarray, ns: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Which of these could link: an upper bound of the overlap from bits that only one of the two has."""
    both = np.bitwise_count(sigs & sig).sum(1, dtype=np.int64)
    most = np.minimum(n - (int(np.bitwise_count(sig).sum()) - both), ns - (ones - both))
    return 9 * most >= 4 * (n + ns)


def streamed(it: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows that agree in the first columns; the rows come sorted by them."""
    rows = (row for b in slices(it) for row in zip(*(c.to_pylist() for c in b.columns)))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(group)


def node_of(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes(), len(s)) if len(s) else None


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node[, prefix]) of each row; a task gives a node's prefix once."""

    def sets(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        for batch in slices(it):
            ns, nodes, prefixes = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingler.set(text)
                node = node_of(s)
                ns.append(len(s))
                nodes.append(node)
                new = node is not None and doc_id is not None and node not in seen
                if new:
                    seen.add(node)
                prefixes.append(s[: prefix(len(s))].view(np.int64) if new else None)
            if len(seen) > CACHED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(nodes, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(sets, "doc_id long, n long, node binary, prefix array<long>")


def needed() -> Column:
    """need() of column n."""
    return F.ceil(F.col("n") * 4 / 5)


def short(node: str) -> Column:
    """A hash of 64 bits of a node's own; nodes that agree in it are at worst both live."""
    return F.xxhash64(node)


def live_nodes(first: DataFrame) -> DataFrame:
    """(x): short hashes of the nodes that share as much of their prefix with another as a partner would."""
    flat = first.where("prefix is not null").select(short("node").alias("x"), F.col("n").cast("int").alias("n"), F.explode("prefix").alias("h"))
    # Several tasks may give a node's prefix: a shingle is shared if two different nodes give it.
    shared = flat.groupBy("h").agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low < high").select("h")
    per = flat.join(shared, "h").groupBy("x").agg(F.max("n").alias("n"), F.size(F.collect_set("h")).alias("m"))
    return per.where(F.col("m") >= F.greatest(F.lit(1), F.floor(needed() / 10))).select("x")


def candidate_keys(sets: DataFrame) -> DataFrame:
    """(node, keys) for the nodes with four fifths of their set among the other live nodes' sets, rarest keys first."""

    def unpack(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            sets = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
            if sets:
                sizes = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets))], names=["node", "n", "h"])

    flat = sets.select("node", "shingles").mapInArrow(unpack, "node long, n long, h long")
    counts = flat.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    per = flat.join(counts, "h").groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("shared"))
    per = per.withColumn("m", F.size("shared")).where(F.col("m") >= needed())
    return per.select("node", F.transform(F.slice("shared", F.lit(1), (F.col("m") - needed() + 1).cast("int")), lambda x: x["h"]).alias("keys"))


def live_sets(docs: DataFrame, live: DataFrame) -> DataFrame:
    """(node, n, shingles, sig) of the live nodes (hash, node, n, doc_id), made again from one document of each.

    Rows may share a doc_id: of the texts that meet a node, those whose set is the node's are taken.
    """

    def build(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(it):
            sets = [shingler.set(t) for t in batch.column("text").to_pylist()]
            own = [i for i, (s, h) in enumerate(zip(sets, batch.column("hash").to_pylist())) if node_of(s) == h]
            batch, sets = batch.take(pa.array(own, pa.int64())), [sets[i] for i in own]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=["node", "n", "shingles", "sig"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return texts.join(live, "doc_id").select("hash", "node", "n", "text").mapInArrow(build, "node long, n long, shingles binary, sig binary")


def signatures(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures over as many bits as the shortest has, and the number of their bits."""
    words = min(len(x) // 8 for x in sigs)
    out = np.stack([fold(np.frombuffer(x, np.uint64), words) for x in sigs])
    return out, np.bitwise_count(out).sum(1, dtype=np.int64)


class Meeting:
    """Nodes that meet: their sizes, sorted sets and components; links are followed between components only."""

    def __init__(self, ns: list[int], sets: list[bytes], comps: list[int]):
        self.ns = np.array(ns)
        self.shingles, self.codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        self.ends = np.concatenate(([0], np.cumsum(self.ns)))
        _, self.comp = np.unique(comps, return_inverse=True)  # numbers of the components, joined as links are found
        self.mark = np.zeros(len(self.shingles), bool)

    def links(self, i: int, others: np.ndarray) -> Iterator[int]:
        """Those of the others that link with i and were of another component; the components are joined."""
        others = others[self.comp[others] != self.comp[i]]
        if not len(others):
            return
        self.mark[mine := self.codes[self.ends[i] : self.ends[i + 1]]] = True
        sizes = self.ns[others]
        at = np.repeat(self.ends[others] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        overlap = np.add.reduceat(self.mark[self.codes[at]].astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        self.mark[mine] = False
        for j in others[9 * overlap >= 4 * (self.ns[i] + sizes)].tolist():
            if self.comp[i] != self.comp[j]:
                self.comp[self.comp == self.comp[j]] = self.comp[i]
                yield j


def join_block(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single linkage within each block: (a, b) from each node to the first of its component there.

    Nodes are compared with all before them, but for those of their component so far.
    """
    for _, rows in streamed(it, 2):
        rows = sorted({r[2]: r for r in rows}.values(), key=lambda r: (-r[3], r[2]))
        (sigs, ones), at = signatures([r[5] for r in rows]), Meeting([r[3] for r in rows], [r[4] for r in rows], [r[2] for r in rows])
        for i in range(1, len(rows)):
            for _ in at.links(i, np.flatnonzero(may_link(sigs[i], int(at.ns[i]), sigs[:i], at.ns[:i], ones[:i]))):
                pass
        nodes, first = np.array([r[2] for r in rows]), np.unique(at.comp, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[first[1]][np.searchsorted(first[0], at.comp)])], names=["a", "b"])


def block_labels(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the components that the block rounds find, each named by one of its nodes; others are their own.

    Each round uses another order of the keys, and what one round has joined stands for itself in the next.
    """
    nodes, labels = sets, sets.select("node", F.col("node").alias("comp"))
    for r in range(ROUNDS):
        keyed = nodes.withColumn("key", F.array_min(F.expr(f"transform(keys, k -> xxhash64(k, {r}))")))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("sum")).where("size > 1")
        blocks = keyed.join(scratch.table(sizes, f"sizes-{r}"), "key").withColumn("block", F.expr(f"pmod(xxhash64(node), ceil(greatest(size / {BLOCK}, sum / {BLOCK_SHINGLES})))"))
        rows = blocks.select("key", "block", "node", "n", "shingles", "sig").repartition("key", "block").sortWithinPartitions("key", "block")
        joined = scratch.table(rows.mapInArrow(join_block, "a long, b long").where("a != b"), f"blocks-{r}")
        labels = scratch.table(labels.join(joined, labels.comp == joined.a, "left").select("node", F.coalesce("b", "comp").alias("comp")), f"labels-{r}")
        if r + 1 < ROUNDS:
            nodes = nodes.join(joined.select(F.col("a").alias("node")), "node", "left_anti")
    return labels


TILE = "key long, band int, low int, high int, own int, chunk int, node long, n long, comp long"


def pairs_in(band: int, low: int, high: int, own: np.ndarray, chunk: np.ndarray, ns: np.ndarray, i: int) -> np.ndarray:
    """The rows after row i (in order of size) that this tile compares with it."""
    part = slice(i + 1, np.searchsorted(ns, int(ns[i]) * 5 // 4, "right"))
    ok = (own[part] == band) | (own[i] == band)
    if low != high:
        ok &= chunk[part] != chunk[i]
    return np.flatnonzero(ok) + i + 1


def may_meet(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (TILE and sig) of each tile that could link with one of another component there, by bit counts."""
    names = [x.split()[0] for x in TILE.split(", ")]
    for (_, band, low, high), rows in streamed(it, 4):
        rows = sorted({r[6]: r for r in rows}.values(), key=lambda r: (r[7], r[6]))
        if len({r[8] for r in rows}) < 2:
            continue
        sigs, ones = signatures([r[9] for r in rows])
        own, chunk, ns, comp = (np.array([r[i] for r in rows]) for i in (4, 5, 7, 8))
        some = np.zeros(len(rows), bool)
        for i in range(len(rows)):
            at = pairs_in(band, low, high, own, chunk, ns, i)
            at = at[comp[at] != comp[i]]
            if len(at) and len(at := at[may_link(sigs[i], int(ns[i]), sigs[at], ns[at], ones[at])]):
                some[i] = some[at] = True
        if some.any():
            kept = list(zip(*(rows[i] for i in np.flatnonzero(some))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if 0 < i < 6 else pa.int64()) for i, c in enumerate(kept[:9])], names=names)


def tile_links(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): components of which a tile's rows (TILE, shingles, sig) link, by exact intersection, each of use once.

    What earlier tiles of the task have joined counts as joined.
    """
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := joined.get(c, c)) != c:
            joined[c] = c = joined.get(up, up)
        return c

    for (_, band, low, high), rows in streamed(it, 4):
        rows = sorted({r[6]: r for r in rows}.values(), key=lambda r: (r[7], r[6]))
        sigs, ones = signatures([r[10] for r in rows])
        own, chunk = (np.array([r[i] for r in rows]) for i in (4, 5))
        at, found = Meeting([r[7] for r in rows], [r[9] for r in rows], [root(r[8]) for r in rows]), []
        for i in range(len(rows)):
            near = pairs_in(band, low, high, own, chunk, at.ns, i)
            near = near[may_link(sigs[i], int(at.ns[i]), sigs[near], at.ns[near], ones[near])] if len(near) else near
            for j in at.links(i, near):
                found.append((rows[i][8], rows[j][8]))
        for a, b in found:
            joined[root(a)] = root(b)
        if len(joined) > CACHED:
            joined.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def tile_edges(sets: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links between components, from all tiles; enough of them to connect what is linked."""
    node = scratch.table(sets.select("node", "n", "keys").join(labels, "node").select("node", "n", "comp", F.explode("keys").alias("key")), "keyed")
    # Keys of several components. Shingles of one passage have the same nodes: of keys that agree in two hashes over
    # their nodes, one is enough.
    members = node.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q"))
    few = scratch.table(members.where("low < high").groupBy("c", "p", "q").agg(F.min("key").alias("key")).select("key"), "mixed")
    own = node.join(few, "key", "left_semi").withColumn("own", F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int"))
    banded = scratch.table(own.withColumn("band", F.explode(F.array("own", F.col("own") + 1))), "banded")
    home = F.max((F.col("own") == F.col("band")).cast("int"))
    sizes = banded.groupBy("key", "band").agg(F.count("*").alias("size"), F.sum("n").alias("sum"), home.alias("home")).where("size > 1 and home = 1").drop("home")
    tiles = banded.join(scratch.table(sizes, "tiles"), ["key", "band"]).withColumn("chunks", F.ceil(F.greatest(F.col("size") / (2 * BLOCK), F.col("sum") / (2 * BLOCK_SHINGLES))).cast("int"))
    tiles = tiles.withColumn("chunk", F.expr("cast(pmod(xxhash64(node), chunks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    tiles = tiles.select("key", "band", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "own", "chunk", "node", "n", "comp")
    by = ["key", "band", "low", "high"]
    signed = tiles.join(sets.select("node", "sig"), "node").select(*tiles.columns, "sig").repartition(*by).sortWithinPartitions(*by)
    may = scratch.table(signed.mapInArrow(may_meet, TILE), "may")
    scratch.drop("keyed", "banded")
    whole = may.join(sets.select("node", "shingles", "sig"), "node").select(*tiles.columns, "shingles", "sig").repartition(*by).sortWithinPartitions(*by)
    return scratch.table(whole.mapInArrow(tile_links, "a long, b long"), "edges")


def id_edges(info: DataFrame, owners: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): components of nodes that rows with one doc_id have, as such rows are one document."""
    several = info.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("doc_id is not null and low < high").select("doc_id", "low")
    pairs = info.join(several, "doc_id").where("node != low").select("low", "node").distinct()
    comp = owners.join(labels, "node", "left").select("hash", F.coalesce("comp", "node").alias("comp"))
    one, two = (comp.withColumnsRenamed({"hash": h, "comp": c}) for h, c in (("low", "a"), ("node", "b")))
    return pairs.join(one, "low").join(two, "node").select("a", "b")


def jaccard_components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id reachable by links.

    What is left in scratch afterwards is what the result reads: a row a document and a row a node.
    """
    with lean(docs.sparkSession):
        first = scratch.table(document_sets(docs), "first")
        info = scratch.table(first.drop("prefix"), "info")
        live = scratch.table(live_nodes(first), "live")
        scratch.drop("first")
        owners = info.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")).where("doc_id is not null")
        owners = scratch.table(owners.select(F.col("node").alias("hash"), F.monotonically_increasing_id().alias("node"), "n", "doc_id"), "owners")
        chosen = owners.join(live, short("hash") == F.col("x"), "left_semi")
        whole = scratch.table(live_sets(docs, chosen).dropDuplicates(["node"]), "whole")
        sets = scratch.table(whole.join(candidate_keys(whole), "node"), "sets")
        scratch.drop("whole", "live")
        labels = block_labels(sets, scratch)
        edges = tile_edges(sets, labels, scratch).union(scratch.table(id_edges(info, owners, labels), "same_id"))
        scratch.drop("sets", "may", "tiles", "mixed", *(f"{x}-{r}" for x in ("sizes", "blocks") for r in range(ROUNDS)))
        roots = components(edges, scratch, "tiles").withColumnsRenamed({"node": "comp"})
        nodes = owners.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(roots, "comp", "left").select("node", "doc_id", F.coalesce("root", "comp").alias("root"))
        lowest = scratch.table(nodes.groupBy("root").agg(F.min("doc_id").alias("least")), "lowest")
        least = scratch.table(nodes.select("node", "root").join(lowest, "root").select("node", "least"), "least")
        classes = owners.join(least, "node", "left").select(F.col("hash").alias("node"), F.coalesce("least", "doc_id").alias("component"))
        classes = scratch.table(classes, "classes")
        scratch.drop("owners", "lowest", "least", "edges", "same_id", *(f"labels-{r}" for r in range(ROUNDS)))
    return info.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs without the rows of documents that link with one of smaller doc_id; of rows with one doc_id, one stays."""
    heads = scratch.table(jaccard_components(docs, scratch).where("doc_id = component_id").select("doc_id").distinct(), "heads")
    scratch.drop("info", "classes")
    row = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = row.join(heads.select(F.col("doc_id").alias("_id")), "_id", "left_semi").groupBy("_id").agg(F.min_by("row", F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("row"))
    return kept.select("row.*").union(docs.where(F.col("doc_id").isNull()))
