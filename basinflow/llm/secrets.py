"""Secrets in whole texts.

One Aho-Corasick automaton over the keywords finds where a secret can begin; only there anchored
regular expressions run; kinds with a checksum of their own are kept only if it holds. Runs of
hexadecimal digits have no keyword: one linear search finds those that are long enough.

Spans are in code points, end exclusive. Base kinds: assign, access, hex. Kinds that the method
adds: github and npm tokens, whose last six characters are the base-62 CRC-32 of the 30 before.
A null or empty text has no spans. Repeated rows and null ids keep their rows; of the columns,
only the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.bpe import text_slices
from basinflow.llm.common import small_batches

# Keywords, patterns and the kinds' order.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
TOKEN_WORDS = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out.rjust(width, "0")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        out.add_word(word, ("assign", len(word)))
    out.add_word(ACCESS_WORD, ("access", len(ACCESS_WORD)))
    for kind, words in TOKEN_WORDS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def find(text: str) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end), by start, then kind in the order of KINDS."""
    low = text.lower()
    if len(low) != len(text):  # a few letters become two; offsets must not move
        low = text.translate(ASCII_LOWER)
    out = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton().iter(low))
    behind = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < behind[kind]:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else TOKEN).match(text, start)
        if not m:
            continue
        behind[kind] = m.end()  # a match that fails the length still takes its characters
        if kind == "assign":
            good = len(m[2]) >= 6
        elif kind == "access":
            good = m.end() - start >= 20
        else:
            good = m[2] == base62(zlib.crc32(m[1].encode()))
        if good:
            out.append((start, kind, m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end) of the whole text."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                found = [[{"kind": k, "start": a, "end": b} for a, k, b in find(t or "")] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, by Spark's own functions."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by <kind>; overlapping spans become one, under
    the kind of the first. All rows and columns stay; a null text stays null."""
    small_batches(docs.sparkSession)

    def clean(text):
        if text is None:
            return None
        out, at = [], 0
        for start, kind, end in find(text):
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join(out) + text[at:] if out else text

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(clean)

    return docs.withColumn(text_col, masked(F.col(text_col).cast("string")))

