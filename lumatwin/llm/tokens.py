"""Encoding whole texts with a public byte-level tokenizer, and decoding.

Texts go through the tokenizers library in Arrow batches, a bounded number of characters at a time. Null and empty
texts have no tokens: an empty list, of size 0. Text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumatwin.stage import spread
from lumatwin.tables import table

#: The vocabulary, unless a caller or the session setting lumatwin.vocabulary names another. It's read where it lies, on each executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters that are encoded at once, unless one text alone is longer.
CHARS_AT_ONCE = 1_000_000


def vocabulary(spark: SparkSession) -> str:
    return spark.conf.get("lumatwin.vocabulary", None) or VOCABULARY


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    t, of = _tokenizer(path), byte_of_character()
    added = {k for k, x in t.get_added_tokens_decoder().items() if x.special}
    words = (t.id_to_token(k) for k in range(t.get_vocab_size()))
    return [w.encode() if k in added else bytes(of[c] for c in w) for k, w in enumerate(words)]


def decode(ids: list[int] | None, path: str = VOCABULARY) -> str:
    """The text of a list of ids. A character of which the list holds only some bytes becomes U+FFFD; unknown ids are an error."""
    table = _token_bytes(path)
    return b"".join(table[k] for k in ids or ()).decode("utf-8", errors="replace")


class Decoder:
    """Decodes ids as they come: bytes of a character that isn't whole yet are held back until its other ids arrive."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self._table, self._held = _token_bytes(path), codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        """The text that the ids complete; last: no more come, and bytes still held back become U+FFFD."""
        return self._held.decode(b"".join(self._table[k] for k in ids), final=last)


def _encoded(texts: list[str | None], path: str, offsets: bool) -> Iterator[list]:
    """Encodings of texts in bounded portions; an empty list stands for null and empty ones."""
    t = _tokenizer(path)
    run = t.encode_batch if offsets else getattr(t, "encode_batch_fast", t.encode_batch)
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHARS_AT_ONCE):
            chars += len(texts[end] or "")
            end += 1
        yield run([x or "" for x in texts[at:end]], add_special_tokens=False)
        at = end


def encode(df: DataFrame, text: str = "text", path: str = VOCABULARY, offsets: bool = False, out: str = "ids") -> DataFrame:
    """df without the text, with its ids in a column ``out`` (replacing one of that name).

    offsets: also the first and last+1 character of each token in the columns starts and ends. The tokens of a character that
    several tokens share all name that character.
    """
    keep = [c for c in df.columns if c not in (text, out, "starts", "ends")]
    names = [*keep, out, *(["starts", "ends"] if offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, starts, ends = [], [], []
            for part in _encoded(x[text].to_pylist(), path, offsets):
                ids += [e.ids for e in part]
                if offsets:
                    starts += [[a for a, _ in e.offsets] for e in part]
                    ends += [[b for _, b in e.offsets] for e in part]
            lists = [pa.array(v, pa.list_(pa.int32())) for v in ([ids, starts, ends] if offsets else [ids])]
            yield pa.RecordBatch.from_arrays([*[x[c] for c in keep], *lists], names)

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kinds, *[f"`{n}` array<int>" for n in names[len(keep) :]]])
    return spread(df.select(*keep, text)).mapInArrow(run, schema)


def sizes(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """df without the text, with its number of tokens in the column tokens."""
    keep = [c for c in df.columns if c not in (text, "tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n = [len(e) for part in _encoded(x[text].to_pylist(), path, False) for e in part]
            yield pa.RecordBatch.from_arrays([*[x[c] for c in keep], pa.array(n, pa.int64())], [*keep, "tokens"])

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "tokens long"])
    return spread(df.select(*keep, text)).mapInArrow(run, schema)


def decoded(df: DataFrame, ids: str = "ids", path: str = VOCABULARY, out: str = "text") -> DataFrame:
    """df without the ids, with their text in a column ``out``; null ids are the empty text."""
    keep = [c for c in df.columns if c not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([*[x[c] for c in keep], pa.array([decode(v, path) for v in x[ids].to_pylist()], pa.string())], [*keep, out])

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], f"`{out}` string"])
    return df.select(*keep, ids).mapInArrow(run, schema)


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path=vocabulary(spark))


def document_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path=vocabulary(spark), offsets=True)


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, same): whether each text comes back from its ids; null comes back as the empty text."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("was"))
    back = decoded(encode(docs, path=vocabulary(spark)).withColumn("tokens", F.size("ids")), path=vocabulary(spark))
    return back.select("doc_id", "tokens", (F.xxhash64("text") == F.col("was")).alias("same"))
