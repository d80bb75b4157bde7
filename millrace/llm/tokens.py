"""Token counts with a digest cache: equal content is encoded once, ever.

Content is normalised to what a tokenizer sees (null counts as empty) and digested
(sha256) together with the tokenizer's version, itself the digest of its vocabulary file.
Digests are looked up in the cache, Parquet files of (digest, n_tokens) in a shared
folder; only the distinct misses are encoded, by the library that belongs to the
file, and their counts are appended to the cache. Digests that one row alone holds are encoded where their row
is read; only texts that several rows share are shuffled, one copy from each input partition, so that each
is encoded once. A digest that many rows hold is joined back by broadcast, not in one task.

Defined cases: null and empty texts have 0 tokens; strings of special tokens inside a text
are handled as the library's default; a text of any length is whole; repeated rows share
one cache entry; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Tokens over which a text counts as long; UTF-8 bytes handed to the library at once; digests up to which they are broadcast.
LIMIT, SLICE, MOST_SENT = 1024, 2_000_000, 1_000_000


#: How a byte-level BPE splits text before its merges; and texts of long-settled Latin letters, for which all Unicode tables agree on it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLED, KNOWN = "[^\x00-\u024f]", 300_000


def by_pieces(count: Callable[[str], int], config: dict) -> Callable[[list[str]], list[int]]:
    """Counting with a memory: merges never cross the pieces of a split, so each distinct piece is encoded by the library once.

    Special strings are cut out first and count one token each, as in the library.
    """
    import re

    import regex

    split, odd = regex.compile(SPLIT), re.compile(SETTLED)
    special = [a["content"] for a in config.get("added_tokens", [])]
    marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    class Counts(dict):
        def __missing__(self, piece: str) -> int:
            if len(self) >= KNOWN:
                self.clear()
            n = self[piece] = count(piece)
            return n

    counts = Counts()

    def one(text: str) -> int:
        if odd.search(text):
            return count(text)
        parts = marks.split(text) if marks else [text]
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, split.findall(p))) for p in parts)

    return lambda texts: [one(x) for x in texts]


@lru_cache(maxsize=2)
def counter(name: str, raw: bytes) -> Callable[[list[str]], list[int]]:
    """texts -> token counts, by the library that reads this kind of file; once for each Python worker."""
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(raw.decode())
        t.no_truncation()
        t.no_padding()
        count = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        config = json.loads(raw)
        pre = config.get("pre_tokenizer") or {}
        plain = not config.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        bare = all(not a.get("lstrip") and not a.get("rstrip") and not a.get("single_word") for a in config.get("added_tokens", []))
        return by_pieces(lambda x: len(t.encode(x, add_special_tokens=False)), config) if plain and bare and config["model"]["type"] == "BPE" else count
    if name.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts: [len(x) for x in m.encode(texts, num_threads=1)]
    raise ValueError(f"no library is known for {name}")


def digest(text: Column, version: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(f"{version}\n"), F.coalesce(text, F.lit(""))).cast("binary"), 256))


def encoded(missing: DataFrame, name: str, raw: bytes) -> DataFrame:
    """digest, n_tokens of rows (digest, text)."""
    spark = missing.sparkSession
    C.ship(spark)
    sent = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(name, sent.value)
        for batch in batches:
            texts, out, part, size = batch.column("text").to_pylist(), [], [], 0
            for t in texts:
                part.append(t or "")
                size += len(part[-1])
                if size >= SLICE:
                    out += count(part)
                    part, size = [], 0
            if part:
                out += count(part)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.int64())], names=["digest", "n_tokens"])

    return missing.mapInArrow(run, "digest binary, n_tokens bigint")


def counted(docs: DataFrame, path: str, cache: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_bytes and n_tokens of every document; ``cache`` gains what it lacked."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        raw = f.read()
    version = hashlib.sha256(raw).hexdigest()
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"k{i}" for i in range(len(keep))]
    kept = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    keyed = C.written(docs.select(*kept, digest(text, version).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "token-digests")
    distinct = C.written(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "token-distinct")
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    stored = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    texts = docs.select(digest(text, version).alias("digest"), text.alias("text"))
    if stored:
        known = spark.read.schema("digest binary, n_tokens bigint").parquet(cache)
        misses = C.written(distinct.join(known.select("digest"), "digest", "left_anti"), "token-misses")
        alone = texts.join(few(misses.where("copies = 1").select("digest")), "digest", "left_semi")
    else:
        misses = distinct
        alone = texts.join(few(misses.where("copies > 1").select("digest")), "digest", "left_anti")
    shared = texts.join(few(misses.where("copies > 1").select("digest")), "digest", "left_semi").dropDuplicates(["digest"])
    encoded(alone.unionByName(shared), path, raw).write.mode("append").parquet(cache)
    counts = spark.read.schema("digest binary, n_tokens bigint").parquet(cache)
    counts = counts.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))  # another writer may have added the same
    found = C.written(distinct.join(counts, "digest"), "token-found")
    out = C.spread_join(keyed, found, "digest")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_bytes", "n_tokens")


def few(digests: DataFrame) -> DataFrame:
    """Digests (32 bytes each), broadcast if their number, counted, allows it."""
    return F.broadcast(digests) if digests.limit(MOST_SENT + 1).count() <= MOST_SENT else digests


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first, so that every run encodes everything it needs."""
    import public_tokenizers

    out = counted(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), C.work_path(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
