"""Language identification by compression: per-language zstandard dictionaries, the smallest encoding wins.

A language's dictionary is raw content, text of that language. Each text is cut in chunks of CHUNK bytes and encoded
with every dictionary; the sum over all its chunks is the text's size in that language. The whole text counts, and
each chunk is short enough for the dictionary to matter. The smallest size wins; where the runner-up is within
``margin`` of it, the operator marks the answer as rejected.

The dictionaries are fitted on a bounded sample, as a documented parameter: about DOCS distinct pieces of each
language, those of least hash, of PIECE characters from the middle of a text. Copies count once, empty
texts never. All rows are encoded and counted.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if no language was
learnt; equal sizes go to the language first by code point; repeated rows are judged each; lang, source and doc_id
are never inputs of a prediction; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, least, slices

DOCS, PIECE, CHUNK, LEVEL = 256, 512, 2048, 3
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def dictionaries(labelled: DataFrame, docs: int = DOCS, piece: int = PIECE, seed: int = 7) -> dict[str, bytes]:
    """Raw-content dictionaries from (text, lang) rows; at most docs * piece characters a language reach the driver.

    The distinct hashes of a language's pieces are ranked, not its rows; only the pieces of the least are collected.
    """
    # From the middle of the text, where a title or a licence line is less likely.
    start = F.greatest(F.lit(1), F.floor((F.char_length("text") - piece) / 2)).cast("int")
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.select("lang", F.substr("text", start, F.lit(piece)).alias("piece")).where("piece != ''").withColumn("u", F.xxhash64(F.lit(seed), "piece"))
    bound = {r["lang"]: r["bound"] for r in least(rows, "lang", docs).collect()}
    if not bound:
        return {}
    top = F.element_at(F.create_map(*[F.lit(v) for kv in bound.items() for v in kv]), F.col("lang"))
    pieces = rows.where(F.col("u") <= top).dropDuplicates(["lang", "piece"])
    out: dict[str, list[str]] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.lang, -r.u, r.piece)):
        out.setdefault(r.lang, []).append(r.piece)
    return {k: "\n".join(v).encode() for k, v in out.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.coders = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the score is the language's share among all, at a bit for ten of its size."""
        if text is None or not self.coders or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text.encode())
        best = min(range(len(sizes)), key=sizes.__getitem__)
        share = 1 / sum(math.exp2(max(-60.0, (sizes[best] - s) * 0.8)) for s in sizes)
        rest = [s for i, s in enumerate(sizes) if i != best]
        return self.langs[best], share, (min(rest) - sizes[best]) / min(rest) if rest else 1.0


def identify(docs: DataFrame, labelled: DataFrame, margin: float = 0.01) -> DataFrame:
    """docs' (doc_id, text) rows with lang_pred, score, margin and rejected (the margin is narrow)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(dictionaries(labelled))

    def predict(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Classifier(model.value)
        for batch in slices(it):
            got = [coder.predict(t) for t in batch.column(1).to_pylist()]
            lang, score, gap = (list(x) for x in zip(*got)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array([g < margin for g in gap], pa.bool_())], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 4 is not 2, predict all; held_out marks the others."""
    labelled = docs.where(crc_mod("doc_id", 4) != 2).select("text", "lang")
    return identify(docs, labelled).withColumn("held_out", crc_mod("doc_id", 4) == 2)
