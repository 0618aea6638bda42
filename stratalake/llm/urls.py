"""URL filter by association rules: FP-growth over URL tokens of labelled URLs, matched through an inverted index.

URLs on which an operator's own rules (host and path) fit carry a label. Their tokens (labels and suffixes of the
host, path segments, query and fragment names, shapes) and the label are baskets; Spark's FP-growth mines frequent
combinations, and those that imply ``block`` or ``allow`` with enough support and confidence become rules, without
those that a part of them implies as surely. Rules are found through an index from their rarest token. On a URL that
no own rule fits, the rule of highest confidence decides; with none, the URL is allowed.

Frequent combinations double with each token that URLs share, so FP-growth gets as few as can matter: tokens of the
same labelled URLs are one *class* (more of them in a rule make it no surer), and classes with one label only are rules
by themselves, as is any single one. Rules may have any number of tokens, and all that support, confidence and the
smaller rules leave are kept. Where a URL still has more than WIDEST frequent classes of both labels, the same rules are
grown from conditional bases without the sets that can't lead to one: see ``grown``. Supports and confidences are the
same there; baskets, supports and confidences cover all labelled rows.

Defined cases: a null url, or one without ``://``, has an empty host and path, no tokens, and is allowed; ties between
rules go by confidence, support, then the rule's text; repeated rows are judged each; if no rows are labelled, or all
alike, what is mined says the same; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, slices

#: (verdict, host, path) of the operator's own rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8
#: FP-growth makes all frequent sets where no URL has more classes of both labels; the rules are grown where one has.
WIDEST = 20
#: Sets that a task extends before it hands the rest of its branches to the next round.
GROWN = 5000
BLOCK, ALLOW = "=block", "=allow"


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url or one without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def own_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: single and paired host labels, leading path segments, query names, shapes."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    words = F.filter(parts, lambda x: ~x.rlike("^[0-9]+$"))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    with_prefix = lambda c, p: F.transform(c, lambda x: F.concat(F.lit(p), x))
    pairs = F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x, i: F.concat(F.lit("h2:"), x, F.lit("."), F.get(labels, i + 1)))
    shapes = F.filter(
        F.array(
            F.concat(F.lit("depth:"), F.least(F.size(parts), F.lit(6)).cast("string")),
            F.when(F.size(parts) > F.size(words), F.lit("number in path")),
            F.when(F.instr(url, "#") > 0, F.lit("fragment")),
            F.concat(F.lit("scheme:"), ascii_lower(F.regexp_extract(url, "^([^:/]*)://", 1))),
        ),
        lambda x: x.isNotNull(),
    )
    made = F.concat(with_prefix(labels, "h:"), pairs, with_prefix(words, "p:"), with_prefix(names, "q:"), shapes)
    return F.when(host != "", F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


class Rules(NamedTuple):
    """(classes, verdict, confidence, support) of each rule, the surest first, and the class of each frequent token,
    which is named by its first token."""

    rules: list[tuple[tuple[str, ...], str, float, float]]
    classes: dict[str, str]


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> Rules:
    """Rules from rows with tokens and verdict.

    A rule is left out if a part of it is as sure: parts are frequent as well, so each size takes the best confidence
    of the parts one smaller and of theirs.
    """
    scratch = Scratch(labelled.sparkSession, "rules")
    rows = scratch.table(labelled.select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "verdict"), "rows")
    total = rows.count()
    if not total:
        return Rules([], {})
    each = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    least = math.ceil(min_support * total)
    told = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.sum((F.col("verdict") == BLOCK[1:]).cast("long")).alias("n_block"), *told).where(F.col("n") >= least)
    frequent = scratch.table(counts.withColumn("class", F.min("token").over(Window.partitionBy("n", "h0", "h1"))), "tokens")
    known = frequent.select("token", "class", "n", "n_block").collect()
    made, mixed = [], {}
    for r in known:
        if r["token"] == r["class"]:
            for label, n in ((BLOCK[1:], r.n_block), (ALLOW[1:], r.n - r.n_block)):
                if n >= least and n / r.n >= min_confidence:
                    made.append(((r["class"],), label, n / r.n, n / total))
            if 0 < r.n_block < r.n:
                mixed[r["class"]] = r.n
    if mixed:
        short = each.join(frequent.where("token = class and n_block between 1 and n - 1").select("token", "n"), "token")
        sets = scratch.table(short.groupBy("row").agg(F.first("verdict").alias("verdict"), F.collect_list(F.struct("n", "token")).alias("items")), "sets")
        if (sets.agg(F.max(F.size("items"))).first()[0] or 0) > WIDEST:
            made += grown(sets, {r["token"]: (r.n, r.n_block) for r in known if r["token"] in mixed}, least, min_confidence, total, scratch)
        else:
            # Rows without such a token are in no combination; supports stay counts over all rows.
            baskets = sets.select(F.array_append(F.transform("items", lambda x: x["token"]), F.concat(F.lit("="), "verdict")).alias("items"))
            n = baskets.count()
            if n >= least:
                made += combinations(baskets, least / n, min_confidence, total, scratch)
    scratch.drop("")
    return Rules(sorted(made, key=lambda r: (-r[2], -r[3], r[0])), {r["token"]: r["class"] for r in known})


def combinations(baskets: DataFrame, min_support: float, min_confidence: float, total: int, scratch: Scratch) -> list[tuple[tuple[str, ...], str, float, float]]:
    """The rules of two and more items, from all frequent sets."""
    # A hair below, so that a count that meets the support exactly is frequent.
    found = FPGrowth(itemsCol="items", minSupport=min_support * (1 - 1e-12), minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = found.withColumn("label", F.get(F.array_intersect("items", F.array(F.lit(BLOCK), F.lit(ALLOW))), 0))
    sets = scratch.table(sets.select(F.array_sort(F.array_except("items", F.array(F.lit(BLOCK), F.lit(ALLOW)))).alias("key"), "label", "freq"), "frequent")
    plain = sets.where("label is null").select("key", F.col("freq").alias("n"))
    sure = sets.where("label is not null and size(key) > 0").join(plain, "key").select("key", "label", "freq", (F.col("freq") / F.col("n")).alias("confidence"))
    sure = scratch.table(sure, "sure")
    smaller, made = None, []
    for size in range(1, (sure.agg(F.max(F.size("key"))).first()[0] or 0) + 1):
        level = sure.where(F.size("key") == size)
        if smaller is None:
            level = level.withColumn("part", F.lit(-1.0))
        else:
            parts = level.select("key", "label", F.explode("key").alias("t")).select("key", "label", F.array_except("key", F.array("t")).alias("sub"))
            best = smaller.select(F.col("key").alias("sub"), "label", F.greatest("confidence", "part").alias("part"))
            level = level.join(parts.join(best, ["sub", "label"]).groupBy("key", "label").agg(F.max("part").alias("part")), ["key", "label"])
        smaller = scratch.table(level, f"size{size}")
        if size > 1:
            rules = smaller.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("part"))).collect()
            made += [(tuple(r.key), r.label[1:], r.confidence, r.freq / total) for r in rules]
    return made


def grown(sets: DataFrame, single: dict[str, tuple[int, int]], least: int, min_confidence: float, total: int, scratch: Scratch) -> list[tuple[tuple[str, ...], str, float, float]]:
    """The rules of two and more items, from the sets that can lead to one.

    A set belongs to its rarest item, its head. Spark makes the base of each head: the rest of the rows that have it, as
    items that are more frequent, equal ones counted once. Tasks grow the sets of a head in its base; a branch ends as
    soon as none of its sets can be a rule (see ``Branch``), and branches that are left when a task has extended GROWN
    sets are dealt anew in the next round. What has a part as sure goes at the end, in a join of the rules with each other.
    """
    spark = sets.sparkSession
    order = {t: k for k, t in enumerate(sorted(single, key=lambda t: (single[t][0], t)))}
    rows = sets.select(F.transform(F.array_sort("items"), lambda x: x["token"]).alias("items"), "verdict")
    told = [F.sum((F.col("verdict") == v[1:]).cast("long")).alias(v[1:]) for v in (BLOCK, ALLOW)]
    each = rows.groupBy("items").agg(*told).select("*", F.posexplode("items").alias("at", "head"))
    rest = F.slice("items", F.col("at") + 2, F.size("items"))
    bases = scratch.table(each.select("head", rest.alias("rest"), "block", "allow").groupBy("head", "rest").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "bases")
    labels = F.explode(F.array(F.lit(BLOCK[1:]), F.lit(ALLOW[1:]))).alias("label")
    open_ = bases.select("head").distinct().select("head", labels, F.array().cast("array<string>").alias("more"), F.lit(0.0).alias("best"))
    most, schema = GROWN, "label string, head string, more array<string>, n long, n_label long, best double, open boolean"

    def grow(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        made = Branch(table, first, single, order, least, min_confidence).grow(most)
        return pa.Table.from_pylist([{"label": first["label"], "head": first["head"], **x} for x in made], arrow_schema)

    arrow_schema = pa.schema([("label", pa.string()), ("head", pa.string()), ("more", pa.list_(pa.string())), ("n", pa.int64()), ("n_label", pa.int64()), ("best", pa.float64()), ("open", pa.bool_())])
    unit, found, k = ["label", "head", "more"], None, 0
    while open_.take(1):
        # Rows without one item tell whether the item matters; those without two matter to no larger set.
        near = open_.join(bases, "head").where(F.size(F.array_except("more", "rest")) <= 1)
        done = scratch.table(near.repartition(4 * spark.sparkContext.defaultParallelism, *unit).groupBy(*unit).applyInArrow(grow, schema), f"round{k}")
        rules = done.where("not open").select("label", F.array_prepend("more", F.col("head")).alias("key"), "n_label", (F.col("n_label") / F.col("n")).alias("confidence"))
        found = rules if found is None else found.union(rules)
        open_, k = done.where("open").select(*unit, "best"), k + 1
    if found is None:
        return []
    found = scratch.table(found, "grown")
    # A part has the pair of its two rarest items in common with the rule.
    parts = found.select("label", F.col("key").alias("part"), F.col("confidence").alias("sure"), F.col("key")[0].alias("a"), F.col("key")[1].alias("b"))
    pairs = found.where(F.size("key") > 2).select("label", "key", "confidence", F.posexplode("key").alias("at", "a"))
    pairs = pairs.select("label", "key", "confidence", "a", F.explode(F.slice("key", F.col("at") + 2, F.size("key"))).alias("b"))
    within = (F.size("part") < F.size("key")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "key")) == 0)
    beaten = pairs.join(parts, ["label", "a", "b"]).where(within).select("label", "key").distinct()
    kept = found.join(beaten, ["label", "key"], "left_anti").select(F.array_sort("key").alias("key"), "label", "confidence", "n_label").collect()
    return [(tuple(r["key"]), r["label"], r["confidence"], r["n_label"] / total) for r in kept]


def packed(has: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of (items, rows), a row once for each binary digit of its weight, and the weight of a bit of each word."""
    parts, words = [np.zeros((len(has), 0), np.uint64)], [np.zeros(0, np.int64)]
    for digit in range(int(weights.max(initial=0)).bit_length()):
        at = np.flatnonzero(weights >> digit & 1)
        parts.append(np.ascontiguousarray(np.packbits(np.pad(has[:, at], ((0, 0), (0, -len(at) % 64))), axis=1)).view(np.uint64))
        words.append(np.full(parts[-1].shape[1], 1 << digit, np.int64))
    return np.concatenate(parts, axis=1), np.concatenate(words)


class Frame(NamedTuple):
    """A set and the items that can extend it: rows with the label and others that have both, by item, and the others
    that have all but one item of the set, by this item; how many they are, and the best confidence of a known part."""

    key: list[int]
    items: np.ndarray
    own: np.ndarray
    other: np.ndarray
    lone: np.ndarray
    n_own: np.ndarray
    n_other: np.ndarray
    best: np.ndarray


class Branch:
    """Sets of one head that extend ``more``, for one label.

    No set with an item whose removal leaves the rows of the other label the same is a rule, nor is any that extends it:
    without the item it has at least as many rows with the label. The same holds beyond a set that no other row has.
    A branch also ends where the rows with the label are too few, and where even the other rows that have all further
    items are so many that no set can be surer than a known part.
    """

    def __init__(self, table: pa.Table, first: dict, single: dict[str, tuple[int, int]], order: dict[str, int], least: int, min_confidence: float):
        self.least, self.min_confidence, self.made = max(least, 1), min_confidence, []
        block = first["label"] == BLOCK[1:]
        alone = lambda t: single[t][1] if block else single[t][0] - single[t][1]
        rest = table.column("rest").combine_chunks()
        names = sorted(set(rest.flatten().unique().to_pylist()), key=order.__getitem__)
        self.names, place = names, {t: k for k, t in enumerate(names)}
        has = np.zeros((len(names), len(rest)), bool)
        words = rest.flatten().dictionary_encode()
        at = np.array([place[t] for t in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
        has[at, np.repeat(np.arange(len(rest)), np.diff(rest.offsets.to_numpy()))] = True
        own, other = (table.column(c).to_numpy() for c in (("block", "allow") if block else ("allow", "block")))
        more = [place[t] for t in first["more"]]
        n = has[more].sum(axis=0)
        whole, lone = n == len(more), (n == len(more) - 1) & ~has[more]
        last = more[-1] if more else -1
        items = np.arange(last + 1, len(names))
        bits, self.own_words = packed(has[items][:, whole], own[whole])
        everything, self.other_words = packed(np.concatenate([whole[None], lone, has[items]]), other)
        others = everything[1 + len(more) :]
        n_other = self.count(everything[0] & others, self.other_words)
        sure = np.array([alone(t) / single[t][0] for t in names[last + 1 :]], np.float64)
        best = np.maximum(sure, max(first["best"], alone(first["head"]) / single[first["head"]][0]))
        # Of a pair, the head must matter as well.
        matter = n_other < np.array([single[t][0] - alone(t) for t in names[last + 1 :]], np.int64) if not more else True
        all_other = int(self.count(everything[:1], self.other_words)[0])
        self.root = self.checked(more, items, bits, everything[0] & others, everything[1 : 1 + len(more), None] & others, n_other, best, (n_other < all_other) & matter)

    @staticmethod
    def count(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.bitwise_count(bits) @ words

    def checked(self, key: list[int], items: np.ndarray, own: np.ndarray, other: np.ndarray, lone: np.ndarray, n_other: np.ndarray, best: np.ndarray, matter: np.ndarray) -> Frame:
        """The frame of what can be a rule or lead to one; rules are noted."""
        n_own = self.count(own, self.own_words)
        at = np.flatnonzero(matter & (n_own >= self.least) & lone.any(axis=2).all(axis=0))
        n_own, n_other, best = n_own[at], n_other[at], best[at]
        sure = n_own / (n_own + n_other)
        for k in np.flatnonzero((sure >= self.min_confidence) & (sure > best)):
            self.note([*key, items[at[k]]], n_own[k] + n_other[k], n_own[k], sure[k], False)
        go = n_other > 0
        at = at[go]
        return Frame(key, items[at], own[at], other[at], lone[:, at], n_own[go], n_other[go], np.maximum(best, sure)[go])

    def note(self, key: list[int], n: int, n_own: int, best: float, is_open: bool) -> None:
        self.made.append({"more": [self.names[k] for k in key], "n": int(n), "n_label": int(n_own), "best": float(best), "open": is_open})

    def hopeful(self, f: Frame) -> list[int]:
        """Items with which the set can lead to a rule, the first at the end."""
        if len(f.items) < 2:
            return []
        left = self.count(np.bitwise_and.accumulate(f.other[::-1], axis=0)[::-1], self.other_words)
        most = (f.n_own / (f.n_own + left))[:-1]
        return np.flatnonzero((most >= self.min_confidence) & (most > f.best[:-1]))[::-1].tolist()

    def grow(self, most: int) -> list[dict]:
        stack, done = [(self.root, self.hopeful(self.root))], 0
        while stack and done < most:
            f, todo = stack[-1]
            if not todo:
                stack.pop()
                continue
            i, done = todo.pop(), done + 1
            j = slice(i + 1, None)
            other = f.other[i] & f.other[j]
            n_other = self.count(other, self.other_words)
            lone = np.concatenate([f.lone[:, i, None] & f.lone[:, j], (f.other[j] & ~f.other[i])[None]])
            # The item before last matters if lone has rows of it, which checked() asks of all.
            child = self.checked([*f.key, f.items[i]], f.items[j], f.own[i] & f.own[j], other, lone, n_other, np.maximum(f.best[i], f.best[j]), n_other < f.n_other[i])
            stack.append((child, self.hopeful(child)))
        for f, todo in stack:
            for i in todo:
                self.note([*f.key, f.items[i]], 0, 0, f.best[i], True)
        return self.made


class RuleIndex:
    """Finds the surest rule whose classes a URL has tokens of, through each rule's rarest class."""

    def __init__(self, found: Rules):
        self.rules, self.classes = found
        seen = Counter(t for key, *_ in self.rules for t in key)
        self.index: dict[str, list[tuple[int, frozenset, str]]] = defaultdict(list)
        for rank, (key, verdict, *_) in enumerate(self.rules):
            self.index[min(key, key=lambda t: (seen[t], t))].append((rank, frozenset(key), verdict))

    def best(self, tokens: Iterable[str]) -> tuple[int, str] | None:
        have, best = {self.classes[t] for t in tokens if t in self.classes}, None
        for t in have:
            for rank, key, verdict in self.index.get(t, ()):
                if best is not None and rank > best[0]:
                    break
                if key <= have:
                    best = rank, verdict
        return best

    def text(self, rank: int, tokens: Iterable[str]) -> str:
        """The rule in the URL's own tokens, the first of each class."""
        own = {c: min(t for t in tokens if self.classes.get(t) == c) for c in self.rules[rank][0]}
        return " + ".join(own.values())


def apply_rules(rows: DataFrame, found: Rules) -> DataFrame:
    """Add mined_verdict, mined_rule and confidence (null where no mined rule fits) to rows with tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(found))
    at = rows.columns.index("tokens")

    def match(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RuleIndex(Rules(*shared.value))
        for batch in slices(it, 5000):
            tokens = [t or () for t in batch.column(at).to_pylist()]
            best = [model.best(t) for t in tokens]
            made = [pa.array([b and b[1] for b in best], pa.string()), pa.array([b and model.text(b[0], t) for b, t in zip(best, tokens)], pa.string()), pa.array([b and model.rules[b[0]][2] for b in best], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "mined_verdict", "mined_rule", "confidence"])

    schema = rows.select("*", F.lit(None).cast("string").alias("mined_verdict"), F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence")).schema
    return rows.mapInArrow(match, schema)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) of each (page_id, url) row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_path("url")
    rows = rows.withColumns({"host": host, "path": path})
    name, verdict = own_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "own": verdict, "tokens": tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))})
    mined = mine(rows.where("own is not null").select("tokens", F.col("own").alias("verdict")))
    out = apply_rules(rows.select("page_id", "host", "path", "rule", "own", "tokens"), mined)
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "mined_verdict", F.lit("allow")).alias("verdict"), "mined_rule", "confidence")
