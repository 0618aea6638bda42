"""Token counts through a digest cache: only content that no earlier run has counted is encoded.

A row's key is the SHA-256 of its normalised content beside the *version* of the tokenizer, a digest of its file, its
library and that library's version. Keys are joined to the stored counts; of the keys without one, a text each is
encoded, and the counts are appended to the cache. In the end each row takes the count of its key. Equal texts are
encoded once, whatever number of rows they have, and a second run over the same texts encodes nothing.

Normalisation must not change a count. By default it only makes null the empty text; a tokenizer that, say, lower-cases
anyway may be given ``normalise=F.lower``, under a name that becomes part of the version.

Rows move as keys of 32 bytes. Texts move once, a text a key and task, and where Spark finds the table of missing keys
small it filters the scan with it, so that a run with few misses moves few texts.

Long texts: a vocabulary without a piece that goes on after a space (checked when it is loaded) never merges across
``x y``; there the encoder gets the text in parts of about PART bytes, cut at such single spaces, each space being the
prefix that the encoder puts before a text. Their counts add up to the whole text's. Other vocabularies take texts whole.

Defined cases: null and empty texts have 0 bytes and what the tokenizer makes of the empty text; a text that is no valid
UTF-8 is what its library makes of it; repeated rows and null doc_ids are rows of their own; two runs that append a key
at once leave two equal rows, of which one counts; a run that is lost leaves the cache as it was; an empty table gives
no rows; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.metadata
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, open_fs, slices, utf8

LIMIT, PART = 4096, 1 << 16
MAX_MODEL = 64 << 20
LIBRARIES = {"model": "sentencepiece", "json": "tokenizers", "tiktoken": "tiktoken"}
#: A space between two characters that are neither spaces nor parts of U+2581, by which pieces write a space.
CUT = re.compile(rb"(?<=[^ \x81]) (?=[^ \xe2])")


class Tokenizer:
    """A vocabulary file: its bytes, kind and version."""

    def __init__(self, path: str, pattern: str | None = None):
        self.kind, self.pattern = path.rpartition(".")[2], pattern
        if self.kind not in LIBRARIES:
            raise ValueError(f"no library for .{self.kind}; known are {', '.join(LIBRARIES)}")
        if self.kind == "tiktoken" and not pattern:
            raise ValueError("a rank file needs the pattern that splits texts before its merges")
        fs, at = open_fs(path if ":" in path else f"file:{path}")
        with fs.open_input_file(at) as f:
            if f.size() > MAX_MODEL:
                raise ValueError(f"the vocabulary has {f.size()} bytes; at most {MAX_MODEL} are broadcast")
            self.content = f.read()

    def version(self, normaliser: str = "") -> str:
        library = LIBRARIES[self.kind]
        told = "\n".join([library, importlib.metadata.version(library), self.pattern or "", normaliser, hashlib.sha256(self.content).hexdigest()])
        return hashlib.sha256(told.encode()).hexdigest()


def counter(kind: str, pattern: str | None, content: bytes) -> Callable[[bytes], int]:
    """Number of tokens of a text, without begin, end or added special tokens."""
    if kind == "json":
        import tokenizers

        coder = tokenizers.Tokenizer.from_str(content.decode())
        coder.no_truncation()
        coder.no_padding()
        return lambda text: len(coder.encode(text.decode(errors="replace"), add_special_tokens=False).ids)
    if kind == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(coder.encode_ordinary(text.decode(errors="replace")))
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_proto=content)
    if not separable(content, coder):
        return lambda text: len(coder.encode(text))
    return lambda text: len(coder.encode(text)) if len(text) <= PART else sum(len(coder.encode(x)) for x in parts(text))


def separable(content: bytes, coder) -> bool:
    """Whether a space before a character always starts a token, and parts of a text are read as the text is."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(content)
    rules = model.normalizer_spec
    plain = rules.name == "identity" and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    pieces = (coder.id_to_piece(i) for i in range(coder.get_piece_size()))
    return bool(plain and model.trainer_spec.byte_fallback and not any("▁" in p.lstrip("▁") for p in pieces))


def parts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, without the spaces at which it is cut."""
    begin = 0
    while found := CUT.search(text, begin + size):
        yield text[begin : found.start()]
        begin = found.end()
    yield text[begin:]


class TokenCache:
    """Stored counts, a Parquet folder that only grows: (digest, n_tokens) below ``version=...``."""

    SCHEMA = "digest binary, n_tokens long"

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    def folder(self, version: str) -> str:
        return f"{self.uri}/version={version}"

    def counts(self, version: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(version))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder(version))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("digest", "n_tokens").write.mode("append").parquet(self.folder(version))


def count_tokens(docs: DataFrame, cache: TokenCache, tokenizer: Tokenizer, scratch: Scratch, normalise: Callable[[Column], Column] | None = None, normaliser: str = "", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each (doc_id, text) row; encodes what the cache lacks and appends it."""
    spark = docs.sparkSession
    if normalise and not normaliser:
        raise ValueError("name the normaliser: it is part of the version")
    version = tokenizer.version(normaliser)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = normalise(text) if normalise else text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    with lean(spark):
        keys = scratch.table(rows.select("doc_id", "n_bytes", "digest"), "keys")
        wanted = keys.select("digest").distinct()
        missing = scratch.table(wanted.join(cache.counts(version), "digest", "left_anti"), "missing")
        if not missing.isEmpty():
            model = spark.sparkContext.broadcast((tokenizer.kind, tokenizer.pattern, tokenizer.content))

            def encode(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                count = counter(*model.value)
                for batch in slices(it):
                    numbers = [count(t.as_py()) for t in batch.column(1)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64())], names=["digest", "n_tokens"])

            # One text a key is chosen in each scan task, before it moves; the filter goes below it where it is broadcast.
            texts = rows.groupBy("digest").agg(F.first("content").alias("content")).join(missing, "digest", "left_semi")
            cache.append(texts.select("digest", utf8("content").alias("content")).mapInArrow(encode, cache.SCHEMA), version)
            model.unpersist()
        known = cache.counts(version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        counts = scratch.table(known.join(wanted, "digest", "left_semi"), "counts")
    # A plain join of two tables: where a key has a large part of all rows, Spark splits it.
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
