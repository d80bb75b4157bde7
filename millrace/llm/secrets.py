"""Secret scans: known forms by pattern, all others by what they cost a compressor that knows the surroundings.

A candidate is a run of letters, digits and signs that mixes kinds of characters and stands behind
a sensitive word on its line. Its novelty is the number of bytes that zstandard needs more for the
text around it with it than without it, at most its length, under a dictionary of common code names
and of the corpus's own identifiers. The names, words and paths that code around it uses cost little;
keys cost nearly their length. Other places of the same candidate are cut out
of its surroundings, so that a secret given twice does not explain itself.

The corpus's part holds the identifiers that save most (occurrences times length, counted over all documents), MOST_BYTES in
all, words of letters only, so that no secret of a usual form gets into it.

Defined cases: null and empty texts hold no secret; a text of any length is scanned whole; positions are in
code points, ends exclusive; repeated rows each get their spans; an empty table gives an empty result
(and an empty dictionary none); extra columns are not read.
"""

from __future__ import annotations

import builtins
import keyword
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

# The forms that are always reported. Group 2 of the first is the secret itself.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: What may be a secret of no known form, and what must stand before it, at most REACH characters away on its line.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-](?:[A-Za-z0-9+/_.-]{10,}[A-Za-z0-9+/_-])={0,2}")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|key|auth|bearer|credential|private|signature|signing|session|cookie|certificate|login|access", re.IGNORECASE | re.ASCII)
REACH = 64
DIGIT, LETTER, TURN = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[a-z](?=[A-Z])|[A-Z](?=[a-z])")
#: Code points of surroundings on each side; bytes a character and bytes in all from which a candidate is reported.
AROUND, BAR, LEAST_BYTES = 512, 0.75, 10
#: Identifiers of the dictionary: letters of their words, words and bytes at most; the compressor's level.
SHORTEST, LONGEST, MOST_WORDS, MOST_BYTES, LEVEL = 3, 24, 8192, 65_536, 19

SPANS = "array<struct<start:int,kind:string,end:int,novelty:double>>"


def base(text: str) -> list[tuple[int, str, int, float | None]]:
    """Leftmost matches of each kind; those too short are dropped after they are matched.

    Runs of 24 or more hexadecimal digits are the same whether short ones are matched first or not.
    """
    out = [(m.start(), "assign", m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out + [(m.start(), "hex", m.end(), None) for m in HEX.finditer(text)]


def mixed(s: str) -> bool:
    """Digits among letters, or case that turns every fourth character: more often than words written together do."""
    return bool(LETTER.search(s)) and bool(DIGIT.search(s) or 4 * len(TURN.findall(s)) >= len(s))


class Novelty:
    """Marginal compressed sizes under one dictionary."""

    def __init__(self, identifiers: bytes) -> None:
        import zstandard

        known = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(identifiers) >= 8 else None
        if known:
            known.precompute_compress(level=LEVEL)
        self.size = lambda data, c=zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False): len(c.compress(data))

    def marginal(self, text: str, start: int, end: int) -> int:
        found = text[start:end]
        before, after = text[max(0, start - AROUND) : start].replace(found, ""), text[end : end + AROUND].replace(found, "")
        cost = self.size(f"{before}{found}{after}".encode()) - self.size(f"{before}{after}".encode())
        return min(cost, end - start)

    def candidates(self, text: str) -> Iterator[tuple[int, int]]:
        sensitive = [m.end() for m in SENSITIVE.finditer(text)]
        if not sensitive:
            return
        k = 0
        for m in CANDIDATE.finditer(text):
            start = m.start()
            while k + 1 < len(sensitive) and sensitive[k + 1] <= start:
                k += 1
            if sensitive[k] <= start <= sensitive[k] + REACH and mixed(m[0]) and "\n" not in text[sensitive[k] : start]:
                yield start, m.end()

    def spans(self, text: str) -> list[tuple[int, str, int, float | None]]:
        out = []
        for start, end in self.candidates(text):
            n = self.marginal(text, start, end)
            if n >= LEAST_BYTES and n >= BAR * (end - start):
                out.append((start, "novel", end, n / (end - start)))
        return out


@lru_cache(maxsize=1)
def novelty(identifiers: bytes) -> Novelty:
    """Once for each Python worker."""
    return Novelty(identifiers)


def code_names() -> list[str]:
    """Keywords, built-in names, their methods and module names of this Python: what code of any kind says often."""
    methods = {n for kind in (str, bytes, dict, list, set, int) for n in dir(kind)}
    return sorted(n for n in {*keyword.kwlist, *dir(builtins), *methods, *sys.stdlib_module_names} if not n.startswith("_"))


def identifier_dictionary(docs: DataFrame) -> bytes:
    """Code names, then the identifiers of all texts that save most; those that save most of all come last, where offsets are short."""
    each = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"(?<![0-9A-Za-z])[A-Za-z]{{{SHORTEST},{LONGEST}}}(?![0-9A-Za-z])"), F.lit(0))).alias("word")
    saved = F.count(F.lit(1)) * F.length("word")
    counts = C.written(docs.select(each).groupBy("word").agg(saved.alias("saved")), "secret-words")
    sizes = counts.groupBy(F.length(F.bin("saved")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 rows
    bar, n = 0, 0
    for r in sorted(sizes, reverse=True):
        bar, n = 1 << (r.k - 1), n + r.n
        if n >= MOST_WORDS:
            break
    top = counts.where(F.col("saved") >= bar).orderBy(F.desc("saved"), "word").limit(MOST_WORDS)
    top = C.written(top, "secret-top").collect()  # stored first: partitions' candidates meet in a task, not on the driver
    out, left = [], MOST_BYTES
    for word in [r.word for r in sorted(top, key=lambda r: (-r.saved, r.word))] + code_names():
        left -= len(word) + 1
        if left < 0:
            break
        out.append(word)
    return " ".join(reversed(out)).encode()


def scanned(docs: DataFrame, identifiers: bytes, keep: str = "doc_id") -> DataFrame:
    """``keep`` and spans (start, kind, end, novelty) of every document, by start, then kind."""
    spark = docs.sparkSession
    C.ship(spark)
    sent = spark.sparkContext.broadcast(identifiers)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rank = novelty(sent.value), {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            out = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                found = sorted(base(text) + model.spans(text), key=lambda s: (s[0], rank[s[1]]))
                out.append([dict(zip(("start", "kind", "end", "novelty"), s, strict=True)) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(out, kind)], names=[keep, "spans"])

    return docs.select(keep, "text").mapInArrow(run, f"`{keep}` {docs.schema[keep].dataType.simpleString()}, spans {SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    number = lambda kind: F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    known = joined(F.filter(spans, lambda s: s.kind != "novel"))
    return scanned(docs, identifier_dictionary(docs)).select("doc_id", *map(number, KINDS[:3]), F.sha2(known.cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"), number("novel"))
