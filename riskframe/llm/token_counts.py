"""Token counts without token ids.

The pieces of a byte-level BPE depend on the pre-token alone.  So pieces
are counted once for each distinct pre-token of the corpus, joined to the
pre-token frequencies of each document, and summed.

Defined results.  A null or empty text has 0 tokens.  Each input row gives
one row, also without an id or with a repeated one.  Strings of added tokens
inside a text are one token each, as the library reads them by default.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import materialise
from riskframe.llm.terms import document_terms, head_terms, term_counts

#: The pre-token pattern of byte-level BPE (a fixed value of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BATCH = 10_000
LINES = 20_000      # chunks that are cut together
#: A space followed by white space or nothing (bytes of UTF-8; control characters count).
JOINED = re.compile(rb" (?:[\x00-\x20]|\Z|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\xaf]|\xe2\x81\x9f|\xe3\x80\x80)")


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@functools.cache
def _splitter(path: str):
    import regex
    added = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return (regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None), added, regex.compile(PATTERN)


@functools.cache
def _added(path: str) -> list[bytes]:
    return [a.encode() for a in _splitter(path)[1]]


@functools.cache
def _newer_ranges() -> str:
    import sys
    from unicodedata import ucd_3_2_0
    known = [ucd_3_2_0.category(chr(c)) != "Cn" for c in range(sys.maxunicode + 1)]
    cuts = [c for c in range(1, len(known)) if known[c] != known[c - 1]] + [len(known)]
    ranges = [(a, b - 1) for a, b in zip(cuts, cuts[1:]) if not known[a]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@functools.cache
def _newer():
    """Characters that Unicode 3.2 did not have: libraries of other Unicode
    versions may class them differently."""
    return re.compile(f"[{_newer_ranges()}]")


@functools.cache
def _even():
    """Texts without these, control characters and white space but for
    spaces, tabs, line breaks and the vertical tab between chunks."""
    spaces = r"\x00-\x08\x0c\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    return re.compile(f"[^{spaces}{_newer_ranges()}]*")


def _cut(s: str, path: str, pattern) -> list[str]:
    if s.isascii() or not _newer().search(s):
        return pattern.findall(s)
    return [s[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(s)]


def pre_tokens(text: bytes, path: str) -> list[str]:
    """Pre-tokens of a text; an added token's string is one of its own."""
    cut, added, pattern = _splitter(path)
    s = text.decode("utf-8", "replace")
    if cut is None or not any(a in s for a in added):
        return _cut(s, path, pattern)
    out: list[str] = []
    for i, part in enumerate(cut.split(s)):
        out += [part] if i % 2 else _cut(part, path, pattern)
    return out


def chunks(text: bytes, path: str) -> list[bytes]:
    """The text in chunks that fall into pre-tokens each by itself.

    A pre-token begins at every space between two characters that are not
    white space, so what follows one is a chunk (without it).  The text's
    first chunk comes as pre-tokens marked by two spaces, and so does a whole
    text with a space before white space or with an added token's string."""
    if JOINED.search(text) or any(a in text for a in _added(path)):
        return [b"  " + x.encode() for x in pre_tokens(text, path)]
    first, *rest = text.split(b" ")
    return [b"  " + x.encode() for x in pre_tokens(first, path)] + rest


def parts(chunk: bytes, path: str) -> tuple[bytes, ...]:
    """The pre-tokens of a chunk."""
    if chunk.isalpha():         # letters of ASCII only
        return (b" " + chunk,)
    if chunk.startswith(b"  "):
        return (chunk[2:],)
    return tuple(x.encode() for x in _cut(" " + chunk.decode("utf-8", "replace"), path, _splitter(path)[2]))


def _cut_lines(chunks: list[bytes], path: str) -> list[tuple[bytes, ...]] | None:
    """The pre-tokens of chunks that white space neither begins nor ends, as
    parts of one string, each behind a space: a vertical tab between them is a pre-token.
    None if a chunk holds a character that ``_even`` leaves out."""
    s = b"\x0b".join([b" " + c for c in chunks]).decode("utf-8", "replace")
    if s.count("\x0b") != len(chunks) - 1 or s.count(" ") != len(chunks) or not _even().fullmatch(s):
        return None
    # no chunk holds a zero byte
    found = "\x00".join(_splitter(path)[2].findall(s)).encode()
    return [tuple(x.split(b"\x00")) for x in found.split(b"\x00\x0b\x00")]


def parts_of_all(chunks: list[bytes], path: str) -> list[tuple[bytes, ...]]:
    """``parts`` of many chunks, most of them cut together."""
    out: list = [None] * len(chunks)
    rest = []
    for i, c in enumerate(chunks):
        if c.isalpha():
            out[i] = (b" " + c,)
        elif c.startswith(b"  "):
            out[i] = (c[2:],)
        elif c[:1] <= b" " or c[-1:] <= b" ":
            out[i] = parts(c, path)
        else:
            rest.append(i)
    for at in range(0, len(rest), LINES):
        some = rest[at:at + LINES]
        cut = _cut_lines([chunks[i] for i in some], path)
        if cut is None:
            odd = [" " in s or "\x0b" in s or not _even().fullmatch(s) for s in (chunks[i].decode("utf-8", "replace") for i in some)]
            for i, o in zip(some, odd):
                if o:
                    out[i] = parts(chunks[i], path)
            some = [i for i, o in zip(some, odd) if not o]
            cut = _cut_lines([chunks[i] for i in some], path) if some else []
            if cut is None:
                cut = [parts(chunks[i], path) for i in some]
        for i, x in zip(some, cut, strict=True):
            out[i] = x
    return out


def count_pieces(terms: DataFrame, path: str) -> DataFrame:
    """``(term, n, pieces)`` for ``terms(term, n)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            words = [x.decode("utf-8", "replace") for x in b.column(0).to_pylist()]
            n: list[int] = []
            for i in range(0, len(words), BATCH):
                n += [len(e) for e in t.encode_batch_fast(words[i:i + BATCH], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["term", "n", "pieces"])
    return terms.select("term", "n").mapInArrow(run, "term binary, n long, pieces long")


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row."""
    def chunks_of(t: bytes) -> list[bytes]:
        return chunks(t, path)

    def parts_of(chunks: list[bytes]) -> list[tuple[bytes, ...]]:
        return parts_of_all(chunks, path)
    d = docs.select(F.lit(1).alias("w"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    table = materialise(count_pieces(term_counts(d, chunks_of, parts_of), path), "token-pieces")
    rows = document_terms(d, chunks_of, head_terms(table, ["pieces"]), 1, parts_of)
    joined = rows.join(table.select("term", "pieces"), "term", "left")
    tokens = F.sum(F.coalesce(F.col("s0").cast("long"), F.lit(0)) + F.col("tf") * F.coalesce("pieces", F.lit(0)))
    out = joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
