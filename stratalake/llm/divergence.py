"""Source divergence audit: how far each source of a language is from the language and from its other sources.

Terms are runs of letters. A language keeps the terms of enough of its documents. A group (language and source) and the
language itself give each kept term a smoothed share of a milliard, ``p = 1 + floor(10^9 (count + 1) / (N + V))``; a
term's divergence from q is ``f = floor((p - q)^2 / q)``. All numbers are integers, so results are exact.

*Terms*: in a group, p depends on the count alone, so a group's terms fall into buckets by count. With the extreme
shares q of the language in a bucket, f is at most f(p, least q) there, and nothing counts where p is not above the
least q. Buckets are evaluated best bound first, in rounds that each reach GROWTH times as far as the one before; a
group is done once all bounds left are strictly below its k-th value.

*Pairs*: the sum of f over all kept terms of two groups has four parts: terms of the first alone and of the second
alone follow from the bucket counts of either, with the other's share of an absent term; terms of neither are a number
times a constant; and what terms of both change comes from the postings (a term's groups), summed up in tasks to a
number a pair of groups. So absent terms are never laid out, and the work is that of the postings and of the result.

Counts are summed up in each scan task before they move, so a source with a third of all rows moves no more rows than
others. A term's row holds its groups, which are no more than a row of the result has items.

Defined cases: null text, language and source are the empty text; a group without kept terms gives every term the share
of an absent one, and without any kept terms in its language has pairs of value 0; repeated rows are documents of their
own; equal values stand by the item's UTF-8; texts of any length are read in slices; an empty table gives no rows;
columns beyond text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, slices, utf8

MIN_DOCS, TOP, GROWTH, UNIT = 3, 200, 8, 10**9
#: Entries of a task's table of counts before it is handed on, bytes of a text at a time, pairs at a time.
ENTRIES, SLICE, PAIRS = 300_000, 1 << 22, 1 << 20
#: Bytes to bytes: letters A-Z to small ones, other ASCII to spaces; bytes of other characters stay.
TABLE = bytes(i if i >= 0x80 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))
ONE_DOC = 1 << 40


def words(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, a slice at a time."""
    if len(text) <= SLICE:
        yield text.translate(TABLE).split()
        return
    begin = 0
    while begin < len(text):
        part = text[begin : begin + SLICE].translate(TABLE)
        end = len(part) if begin + SLICE >= len(text) else part.rfind(b" ") + 1
        while not end:  # a term longer than a slice
            part = text[begin : begin + 2 * len(part)].translate(TABLE)
            end = len(part) if begin + len(part) >= len(text) else part.rfind(b" ") + 1
        yield part[:end].split()
        begin += end


def count_terms(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed up in the task."""
    from collections import Counter

    held: dict[tuple, dict[bytes, int]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            rows, packed = len(terms), np.fromiter(terms.values(), np.int64, len(terms))
            names = pa.array(list(terms), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), names, pa.array(packed % ONE_DOC), pa.array(packed // ONE_DOC)], names=["lang", "source", "term", "n", "docs"])

    for batch in slices(it):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            own: Counter = Counter()
            for part in words(text):
                own.update(part)
            terms = held.setdefault((lang, source), {})
            size -= len(terms)
            for w, n in own.items():
                terms[w] = terms.get(w, 0) + n + ONE_DOC
            size += len(terms)
            if size >= ENTRIES:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def share(n: str, size: str) -> str:
    """SQL: 1 + floor(10^9 (n + 1) / size), in two steps that stay within 64 bits."""
    return f"1 + (({n} + 1) * 100000 div {size}) * 10000 + (({n} + 1) * 100000 % {size}) * 10000 div {size}"


def apart(p: str, q: str) -> str:
    """SQL: floor((p - q)^2 / q)."""
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def meet(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): what terms that two groups share change in the sum of the pair, summed in the task."""
    total: dict[tuple, int] = {}
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in it:
        langs, posts = batch.column(0).to_pylist(), batch.column(1)
        entries = posts.flatten()
        sizes = np.diff(posts.offsets.to_numpy())
        names = entries.field("source").dictionary_encode()
        source, known = names.indices.to_numpy(), names.dictionary.to_pylist()
        p, none = entries.field("p").to_numpy(), entries.field("none").to_numpy()
        ids: dict[str, int] = {}
        lang = np.array([ids.setdefault(x, len(ids)) for x in langs], dtype=np.int64)
        spoken, begin, row = list(ids), np.concatenate(([0], np.cumsum(sizes))), 0
        while row < len(sizes):
            # Rows whose pairs fit; a row with more is taken by stretches of its entries.
            stop = row + max(1, int(np.searchsorted(np.cumsum(sizes[row:].astype(np.int64) ** 2), PAIRS, side="right")))
            first, last = begin[row], begin[stop]
            width = np.repeat(sizes[row:stop], sizes[row:stop]).astype(np.int64)
            start = np.repeat(begin[row:stop], sizes[row:stop])
            spoke = np.repeat(lang[row:stop], sizes[row:stop])
            at, most = first, max(1, PAIRS // max(1, int(sizes[row:stop].max()))) if stop == row + 1 else last - first
            while at < last:
                to = min(last, at + most)
                w = width[at - first : to - first]
                a = np.repeat(np.arange(at, to), w)
                b = np.repeat(start[at - first : to - first], w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
                apart_ = a != b
                a, b = a[apart_], b[apart_]
                value = f(p[a], p[b]) - f(p[a], none[b]) - f(none[a], p[b]) + f(none[a], none[b])
                key = (np.repeat(spoke[at - first : to - first], w)[apart_] * len(known) + source[a]) * len(known) + source[b]
                keys, where = np.unique(key, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, where, value)
                for k, v in zip(keys.tolist(), sums.tolist()):
                    rest, y = divmod(k, len(known))
                    z, x = divmod(rest, len(known))
                    name = spoken[z], known[x], known[y]
                    total[name] = total.get(name, 0) + v
                at = to
            row = stop
    if total:
        columns = [*zip(*total), list(total.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()])], names=["lang", "source", "item", "value"])


class Audit:
    """The tables of an audit: counts of kept terms by group, groups, and buckets of equal counts."""

    def __init__(self, docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS):
        self.spark, self.scratch = docs.sparkSession, scratch
        filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        rows = docs.select(filled("lang").alias("lang"), filled("source").alias("source"), utf8(filled("text")).alias("text"))
        with lean(self.spark):
            sums = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
            # One exchange by term: its groups, and then its documents, are summed up where they arrive.
            by_group = sums.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            kept = by_group.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("posts")).where(F.col("docs") >= min_docs)
            self.counts = scratch.table(kept.select("lang", "term", "total", F.posexplode("posts").alias("at", "post")).select("lang", "term", "total", "at", "post.*"), "counts")
            once = F.col("at") == 0
            langs = self.counts.groupBy("lang").agg(F.count_if(once).alias("v"), F.sum(F.when(once, F.col("total"))).alias("of_lang"))
            own = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
            groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "v", "of_lang"])
            d = groups.select("lang", "source", "v", "terms", F.greatest(F.col("size") + F.col("v"), F.lit(1)).alias("d"), F.greatest(F.col("of_lang") + F.col("v"), F.lit(1)).alias("d_lang"))
            self.groups = scratch.table(d.withColumn("none", F.expr(share("cast(0 as long)", "d"))), "groups")
        shares = self.counts.join(self.groups, ["lang", "source"]).withColumns({"p": F.expr(share("n", "d")), "q": F.expr(share("total", "d_lang"))})
        self.shares = shares.select("lang", "source", "term", "n", "p", "q", "none")
        with lean(self.spark):
            made = self.shares.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("terms"), F.min("q").alias("least"), F.max("q").alias("most"))
            self.buckets = scratch.table(made, "buckets")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): divergence of each group from each other one of its language."""
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none2"), F.col("terms").alias("terms2"))
        # Each pair once, with the terms of neither; a term of both is in this number with -1.
        base = self.groups.join(other, "lang").where("source != item").select("lang", "source", "item", F.expr(f"(v - terms - terms2) * ({apart('none', 'none2')})").alias("value"))
        met = self.buckets.join(other, "lang").where("source != item")
        first = met.select("lang", "source", "item", F.expr(f"terms * ({apart('p', 'none2')})").alias("value"))
        second = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"terms * ({apart('none2', 'p')})").alias("value"))
        posts = self.shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("posts")).where(F.size("posts") > 1)
        both = posts.select("lang", "posts").mapInArrow(meet, "lang string, source string, item string, value long")
        with lean(self.spark):
            summed = base.unionByName(first).unionByName(second).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
            return self.scratch.table(summed, "pairs")

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms that a group has more of than its language, most divergent first."""
        best = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), F.desc("n"))
        before = F.coalesce(F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = self.buckets.where("p > least").withColumn("bound", F.expr(apart("p", "least"))).withColumn("before", before)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        schema = "lang string, source string, item string, value long, rank int"
        found, reached, reach, step = self.spark.createDataFrame([], schema), 0, top, 0
        with lean(self.spark):
            ranked = self.scratch.table(ranked.select("lang", "source", "n", "p", "least", "most", "bound", "before"), "ranked")
            while True:
                kth = found.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
                open_ = ranked.where(F.col("before") >= reached).join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth")
                if open_.isEmpty():
                    return found
                step += 1
                now = self.scratch.table(open_.where(F.col("before") < reach).select("lang", "source", "n"), f"open-{step}")
                made = self.shares.join(now, ["lang", "source", "n"]).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
                merged = found.select("lang", "source", "item", "value").unionByName(made).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
                found = self.scratch.table(merged, f"top-{step}")
                reached, reach = reach, reach * GROWTH


def divergence(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): both parts of the audit; pairs in all ranks, terms down to ``top``."""
    audit = Audit(docs, scratch, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = audit.pairs().withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(audit.terms(top), "term"))
