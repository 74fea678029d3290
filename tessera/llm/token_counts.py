"""Token counts attributed to sections by offset mapping.

A whole document is encoded once; its tokens' byte lengths give their byte offsets, and those the character spans. The
spans are joined with the sections' spans (an interval join of two sorted lists), and a token that crosses a boundary
is allocated by an explicit rule:
  start     to the section of its first character (the default);
  majority  to the section that holds most of its characters, the earlier one if equal;
  split     to all of them, in proportion to characters.
Sections are the lines of a text, each with its line break (`count`), or fields: columns that are joined by line breaks
and encoded as one document (`count_fields`); a field's span takes in the break after it. Both tile the document, so
counts add up to its own.

The vocabulary file is read on the driver and broadcast (under 1 MB for 50,000 entries). The path is a parameter.

Cases: null text is empty; an empty text is one section of no tokens; an empty last line (after a final break) is no
section; very long texts are encoded whole; bytes that are not UTF-8 are read as U+FFFD, as a decoder does, and places
count the characters of that reading; a token that holds part of a character counts from the character's place;
repeated rows each give their sections; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this family divides a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "split")


@lru_cache(1)
def encoding(vocabulary: bytes):
    """The encoder and the byte length of each token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("broadcast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def well_formed(text: bytes) -> bytes:
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


def token_spans(text: bytes, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of each token of the whole text."""
    encoder, sizes = encoding(vocabulary)
    size = sizes[encoder.encode_to_numpy(text.decode(), disallowed_special=())]
    ends = np.cumsum(size)
    first = ends - size
    if text.isascii():
        return first, ends
    inside = (np.frombuffer(text + b"\0", np.uint8) & 0xC0) == 0x80
    chars = np.r_[0, np.cumsum(~inside)]  # characters begun before each byte
    return chars[first] - inside[first], chars[ends]  # a token that begins within a character: that character's place


def line_spans(text: bytes) -> np.ndarray:
    """Character places at which lines begin, and the end of the text."""
    sizes = np.cumsum([0, *map(len, text.decode().split("\n"))])
    starts = sizes[:-1] + np.arange(len(sizes) - 1)  # one line break before each line but the first
    total = sizes[-1] + len(sizes) - 2
    return np.append(starts if starts[-1] < total or len(starts) == 1 else starts[:-1], total)


def attribute(first: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section between successive edges."""
    sections = len(edges) - 1
    at = np.clip(np.searchsorted(edges, first, "right") - 1, 0, sections - 1)
    if rule == "start" or not len(first):
        return np.bincount(at, minlength=sections).astype(float)
    to = np.clip(np.searchsorted(edges, np.maximum(end - 1, first), "right") - 1, 0, sections - 1)
    out = np.bincount(at[at == to], minlength=sections).astype(float)
    for i in np.flatnonzero(at != to):
        own = np.arange(at[i], to[i] + 1)
        share = np.minimum(edges[own + 1], end[i]) - np.maximum(edges[own], first[i])
        if rule == "split":
            out[own] += share / share.sum()
        else:
            out[own[share.argmax()]] += 1
    return out


def _attributed(rows: DataFrame, edges_of, section_type: str, vocabulary_path: str, rule: str) -> DataFrame:
    """Sections of rows (doc_id, bytes, ...); edges_of gives a row's text, section names and edges from its columns."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(vocabulary_path, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())
    kind = {"long": pa.int64(), "string": pa.string()}[section_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in S.blocks(batches, 1):
            ids, names, edges_, counts = part.column(0), [], [], []
            for row, text in zip(part.drop_columns(["doc_id", "bytes"]).to_pylist() if part.num_columns > 2 else repeat({}), texts):  # noqa: B905
                text, own, edges = edges_of(text, row)
                names += own
                edges_.append(edges)
                counts.append(attribute(*token_spans(text, held.value), edges, rule))
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(names, kind), pa.array(np.concatenate([e[:-1] for e in edges_])), pa.array(np.concatenate([e[1:] for e in edges_])), pa.array(np.concatenate(counts))], names=["doc_id", "section", "first_char", "end_char", "tokens"])

    return rows.mapInArrow(run, f"doc_id long, section {section_type}, first_char long, end_char long, tokens double")


def count(docs: DataFrame, vocabulary_path: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """doc_id, section (from 0), first_char, end_char and tokens of every line of every row."""

    def lines(text: bytes, row: dict) -> tuple[bytes, range, np.ndarray]:
        text = well_formed(text)
        edges = line_spans(text)
        return text, range(len(edges) - 1), edges

    rows = S.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), S.text_bytes().alias("bytes"))
    return _attributed(rows, lines, "long", vocabulary_path, rule)


def count_fields(docs: DataFrame, fields: list[str], vocabulary_path: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """doc_id, section (the field's name), first_char, end_char and tokens of every field of every row; null is empty."""

    def joined(text: bytes, row: dict) -> tuple[bytes, list[str], np.ndarray]:
        parts = [well_formed(x).decode() for x in row["fields"]]
        edges = np.cumsum([0, *(len(x) + 1 for x in parts)])
        edges[-1] -= 1
        return "\n".join(parts).encode(), fields, edges

    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")).cast("binary") for f in fields]
    rows = S.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*parts).alias("bytes"), F.array(*parts).alias("fields"))
    return _attributed(rows, joined, "string", vocabulary_path, rule)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(S.table(spark, sf_dir, "documents")).withColumn("tokens", F.col("tokens").cast("long"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
