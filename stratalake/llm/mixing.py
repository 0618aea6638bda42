"""Mixing sources to target weights: min-cost flow over membership patterns, then a seeded choice of documents.

Documents are summed up by *pattern*: the set of sources a document belongs to. Tokens flow from a pattern to the
sources it belongs to and on to the sources' quotas. A pattern's tokens can be used up to ``epochs`` times, and each
further use costs more (convex repetition costs), so the least costly flow meets the quotas with as few repetitions
as it can. Only the pattern table (a row a pattern) reaches the driver, which solves the flow exactly, in integers,
on each connected part. Documents are then chosen by a seeded hash: within a pattern they stand in the order of the
hash, and the flow says how far each epoch reaches. The running sums are made in buckets of the hash, so that no
pattern is one task's work, and rows that are equal in all that the mix reads are counted before, so that they are one
row of a bucket.

Defined cases: a null text has size 0; documents of size 0 are taken 0 times; null sources form a source of their own,
last in order; documents without any source get nothing; the hash is of doc_id and text, ties are ordered by doc_id and
then size, and rows that still tie are interchangeable; repeated rows are documents of their own; an empty table gives no rows;
columns beyond those named are kept by :func:`take` and not read elsewhere.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable
from fractions import Fraction
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
EPOCHS = 2
BUCKET_ROWS = 10_000
MAX_PATTERNS = 200_000  # of sources that documents belong to: what the driver holds
SEED = 20_240_229


def word_count(text: str = "text"):
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def quotas(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = EPOCHS) -> dict[str | None, Fraction]:
    """Targets of the sources: a share of all sizes dealt by weight, none above ``most`` times its source's size.

    Sources stand by code point, null last; what those at their limit leave is dealt again among the others.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] > most * sizes[s] * total}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def min_cost_flow(supply: dict[object, int], members: dict[object, Iterable[object]], quota: dict[object, int], epochs: int = EPOCHS) -> dict[tuple, list[int]]:
    """(pattern, source) -> tokens of each epoch: the largest flow within the quotas, at the least repetition cost.

    Use number e of a pattern's tokens costs e for each token. Successive shortest paths with potentials; a path moves
    as many tokens as its arcs let through, so that the work depends on the number of patterns and not of tokens.
    """
    arcs: list[list] = []  # to, capacity, cost
    out = defaultdict(list)

    def arc(a, b, capacity: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    uses = {}
    for p, n in supply.items():
        for e in range(epochs):
            uses[p, e] = arc("S", ("p", p), n, e)
        for s in members[p]:
            uses[p, s, "to"] = arc(("p", p), ("s", s), n * epochs, 0)
    for s, n in quota.items():
        arc(("s", s), "T", n, 0)
    potential = defaultdict(int)
    while True:
        distance, came, heap = {"S": 0}, {}, [(0, 0, "S")]
        tick = 0
        while heap:
            d, _, v = heapq.heappop(heap)
            if d > distance[v]:
                continue
            for i in out[v]:
                to, capacity, cost = arcs[i]
                if capacity and (new := d + cost + potential[v] - potential[to]) < distance.get(to, 1 << 60):
                    distance[to], came[to] = new, i
                    heapq.heappush(heap, (new, tick := tick + 1, to))
        if "T" not in distance:
            break
        far = max(distance.values())
        for v in list(out):
            potential[v] += distance.get(v, far)
        path, v = [], "T"
        while v != "S":
            path.append(came[v])
            v = arcs[came[v] ^ 1][0]
        amount = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= amount
            arcs[i ^ 1][1] += amount
    flow = {}
    for p, n in supply.items():
        left = [arcs[uses[p, e] ^ 1][1] for e in range(epochs)]
        for s in members[p]:
            need, parts = arcs[uses[p, s, "to"] ^ 1][1], [0] * epochs
            for e in range(epochs):
                parts[e] = min(need, left[e])
                need, left[e] = need - parts[e], left[e] - parts[e]
            flow[p, s] = parts
    return flow


def connected(members: dict[object, tuple]) -> list[list]:
    """Patterns by connected part (sharing sources), each solved on its own."""
    part: dict = {}

    def root(x):
        while part.setdefault(x, x) != x:
            part[x] = x = part[part[x]]
        return x

    for p, sources in members.items():
        for s in sources:
            part[root(("s", s))] = root(("p", p))
    groups = defaultdict(list)
    for p in members:
        groups[root(("p", p))].append(p)
    return list(groups.values())


def place(sized: DataFrame, scratch: Scratch, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix of rows with doc_id, size and members (array of sources), and perhaps ``spread`` (long), which tells rows of
    one doc_id apart: a row for ``n`` equal ones, with source_size, target and ``times``: how many of them each epoch takes.

    Equal rows are counted before they move, so they are one row of a bucket however many they are.
    """
    spark = sized.sparkSession
    members_of = F.sort_array(F.array_distinct(F.coalesce("members", F.array().cast("array<string>"))))
    spread = F.col("spread") if "spread" in sized.columns else F.lit(0).cast("long")
    rows = sized.select("doc_id", "size", members_of.alias("pattern"), spread.alias("spread"))
    groups = scratch.table(rows.groupBy("pattern", "doc_id", "size", "spread").agg(F.count("*").alias("n")), "groups")
    patterns = groups.groupBy("pattern").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: too many for one flow; class the sources first")
    members = {tuple(r.pattern): tuple(r.pattern) for r in patterns}
    supply, counts = {tuple(r.pattern): r["size"] for r in patterns}, {tuple(r.pattern): r.n for r in patterns}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, sources in members.items():
        for s in sources:
            sizes[s] += supply[p]
    # A document of several sources counts in each of them; the share is one of all documents' sizes.
    total = sum(sizes.values())
    goal = quotas(dict(sizes), weights, share * Fraction(sum(supply[p] for p in members if members[p]), total) if total else share, epochs)
    reach = {}
    for group in connected({p: s for p, s in members.items() if s}):
        sources = {s for p in group for s in members[p]}
        flow = min_cost_flow({p: supply[p] for p in group}, members, {s: floor(goal[s] + Fraction(1, 2)) for s in sources}, epochs)
        for p in group:
            reach[p] = [sum(flow[p, s][e] for s in members[p]) for e in range(epochs)]
    plan = [(list(p), max(1, -(-counts[p] // BUCKET_ROWS)), sum(sizes[s] for s in p), float(sum(goal[s] for s in p)), reach.get(p, [0] * epochs)) for p in members]
    schema = "pattern array<string>, buckets long, source_size long, target double, reach array<long>"
    limits = scratch.table(spark.createDataFrame(plan, schema), "limits").withColumn("key", pattern_key()).drop("pattern")
    placed = groups.withColumn("key", pattern_key()).drop("pattern").join(limits, "key").withColumn("u", place_of(seed, "spread" in sized.columns)).withColumn("bucket", F.floor(F.col("u") * F.col("buckets")))
    placed = scratch.table(placed, "placed")
    amount = F.col("size") * F.col("n")
    sums = placed.groupBy("key", "bucket").agg(F.sum(amount).alias("sum"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.table(sums.select("key", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start")), "starts")
    inside = Window.partitionBy("key", "bucket").orderBy("u", "doc_id", "size", "spread").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = ranked.join(starts.withColumnsRenamed({"key": "_key", "bucket": "_bucket"}), (F.col("key") == F.col("_key")) & (F.col("bucket") == F.col("_bucket")))
    # A row counts for an epoch if its middle lies within the epoch's reach: the sum ends nearest to it. The middles of
    # equal rows lie a size apart.
    first = (F.col("start") + F.col("inside")) * 2 + F.col("size")
    within = lambda r: F.greatest(F.lit(0), F.least(F.col("n"), F.floor((r * 2 - first) / (F.col("size") * 2)) + 1))
    times = F.transform("reach", lambda r: F.when((F.col("size") > 0) & (r > 0), within(r)).otherwise(0).cast("long"))
    return joined.select("key", "doc_id", "size", "spread", "u", "n", "source_size", "target", times.alias("times"))


def place_of(seed: int, told: bool):
    """A row's place in its pattern, from 0 to 1, by a seeded hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", *(["spread"] if told else [])), 33) / F.lit(float(1 << 31))


def repeated(n, columns: DataFrame) -> DataFrame:
    """Each row n times with its number ``copy``, in two steps, so that no array grows with n."""
    step = 1000
    out = columns.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / step).cast("long"))))
    return out.withColumn("copy", F.explode(F.sequence(F.col("_block") * step, F.least(n, (F.col("_block") + 1) * step) - 1))).drop("_block")


def choose(sized: DataFrame, scratch: Scratch, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of sized, as in :func:`place`."""
    rows = repeated(F.col("n"), place(sized, scratch, seed, weights, share, epochs))
    taken = F.aggregate("times", F.lit(0).cast("long"), lambda a, t: a + (F.col("copy") < t).cast("long")) * F.col("size")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def pattern_key():
    """A text that stands for the pattern in joins, with null and the empty source apart."""
    return F.concat_ws("\x01", F.transform("pattern", lambda s: F.when(s.isNull(), F.lit("\x02")).otherwise(F.concat(F.lit("\x03"), s))))


def text_hash():
    return F.xxhash64(F.col("text").cast("string")).alias("spread")


def mix(docs: DataFrame, scratch: Scratch, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each (doc_id, text, source) row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("size"), F.array(F.col("source").cast("string")).alias("members"), text_hash())
    return choose(scratch.table(rows, "sized"), scratch, seed).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame, scratch: Scratch, seed: int = SEED, epochs: int = EPOCHS) -> DataFrame:
    """docs as the mix has them: rows not taken go, rows taken n times come n times.

    Each pattern is cut in the order of its rows' places, an epoch at a place, and only these cuts (a row a pattern) are
    met with the documents, which do not move. Of equal rows at a cut, so many as the mix takes are left by chance, in
    proportion: by their number in the scan.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    members = F.array(F.col("source").cast("string"))
    sized = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("size"), members.alias("members"), text_hash())
    placed = place(sized.drop("row"), scratch, seed, epochs=epochs)
    order = lambda: F.struct("u", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size", "spread")
    last = [F.max(F.when(F.get("times", F.lit(e)) > 0, F.struct(order().alias("at"), F.get("times", F.lit(e)).alias("times"), "n"))).alias(f"cut{e}") for e in range(epochs)]
    cuts = scratch.table(placed.groupBy("key").agg(*last), "cuts")
    scratch.drop("groups", "placed", "starts", "limits")
    sized = sized.withColumn("pattern", F.sort_array("members")).withColumn("key", pattern_key()).withColumn("u", place_of(seed, True))
    sized = sized.withColumn("chance", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 33) / F.lit(float(1 << 31)))
    met = sized.where(F.col("size") > 0).withColumn("at", order()).join(cuts, "key")
    times = F.lit(0)
    for e in range(epochs):
        cut = F.col(f"cut{e}")
        times = times + F.when(F.col("at") < cut["at"], 1).when((F.col("at") == cut["at"]) & (F.col("chance") * cut["n"] < cut["times"]), 1).otherwise(0)
    return met.withColumn("times", times).where(F.col("times") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
