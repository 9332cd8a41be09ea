"""Packing: first-fit decreasing with a tournament tree of bin capacities.

Documents become token ids; a document longer than a sequence is cut into
full pieces and a rest.  Pieces are dealt at random into groups of about
``GROUP``; each group is packed on its own by first-fit decreasing, where a
tournament tree over the open bins' free room finds the first bin that fits
in O(log n).  Groups have equal expected size whatever the documents look
like, so one task never holds more than a group.

Defined results.  A null text counts as empty: its one piece is the end id.
Repeated rows and rows without an id are packed each on their own.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import materialise
from riskframe.llm.token_counts import tokenizer

GROUP = 2048            # pieces of a group, on average
CACHE = 800_000         # distinct chunks whose ids a worker keeps at most,
CACHE_BYTES = 1 << 26   # and their bytes
BATCH = 10_000
ROWS = 64               # rows whose chunks are tokenised together
WORDS = 300_000         # words of plain chunks whose ids a worker keeps, about,
WORD = 64               # and their length at most
LINE = 200              # words that are tokenised as one line

_ids: dict[str, dict[bytes, bytes]] = {}
_word_ids: dict[str, dict[str, bytes]] = {}
_kept_bytes: dict[str, int] = {}

#: What a tokenizer file must say for ``plain_words`` to cut as it does.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def plain_characters() -> tuple[re.Pattern, re.Pattern]:
    """A pattern of texts that any Unicode version lower-cases and classes
    alike, one character at a time (with spaces), and one of their words in
    lower case (a space is one, too)."""
    old = unicodedata.ucd_3_2_0
    letters, digits, others = [], [], []
    for c in map(chr, range(0x21, 0x20000)):
        kind, low = old.category(c)[0], c.lower()
        to = letters if kind == "L" else digits if kind == "N" else others
        # a capital sigma's lower case depends on what follows
        if (kind in "LNPS" and c != "\u03a3" and len(low) == 1
                and kind == unicodedata.category(c)[0] == unicodedata.category(low)[0]):
            to += [c, low]

    def ranges(chars: list[str]) -> str:
        at = sorted(set(map(ord, chars)))
        cuts = [i for i in range(1, len(at)) if at[i] != at[i - 1] + 1]
        return "".join(f"\\U{at[i]:08x}-\\U{at[j - 1]:08x}" for i, j in zip([0, *cuts], [*cuts, len(at)]))
    of, num = ranges(letters), ranges(digits)
    return (re.compile(f"[ {of}{num}{ranges(others)}]*"),
            re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of}]+|[{num}]|[^ {of}{num}]+| "))


@functools.cache
def words_tokenizer(path: str):
    """The file's model behind a split at spaces only, for words that are
    normalised and cut already, and which ids end a word; None for a file of
    another format."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    try:
        parts = spec["pre_tokenizer"]["pretokenizers"]
        known = (spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS} and len(parts) == 2
                 and parts[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
                 and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
                 and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>"
                 and not spec["truncation"] and not spec["padding"] and not spec["post_processor"])
    except (KeyError, TypeError):
        known = False
    if not known:
        return None
    from tokenizers import Tokenizer
    vocab = spec["model"]["vocab"]
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
    added = [t["content"].encode() for t in spec["added_tokens"]]
    spec |= {"normalizer": None, "added_tokens": [],
             "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, parts[1]]}}
    return Tokenizer.from_str(json.dumps(spec)), ends, added


def is_plain(text: bytes, added: list[bytes]) -> bool:
    try:
        s = text.decode()
    except UnicodeDecodeError:
        return False
    # NFC leaves it as it is, and no added token's string is in it
    return (s.isascii() or unicodedata.is_normalized("NFC", s)) and not any(a in text for a in added) \
        and plain_characters()[0].fullmatch(s) is not None


def plain_ids(chunks: list[bytes], path: str) -> list[bytes]:
    """Ids of plain chunks: cut into words all at once, each new word
    tokenised once, a line of many at a time (a word's last id says so)."""
    light, ends, _ = words_tokenizer(path)
    kept = _word_ids.setdefault(path, {" ": b""})
    words = plain_characters()[1].findall(b" ".join(chunks).decode().lower())
    new = list(set(words).difference(kept))
    lines = [new[i:i + LINE] for i in range(0, len(new), LINE)]
    found = {}
    for line, e in zip(lines, light.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
        ids = np.array(e.ids, dtype="<u4")
        at, b = (4 * (1 + np.flatnonzero(ends[ids]))).tolist(), ids.tobytes()
        found |= zip(line, (b[x:y] for x, y in zip([0, *at], at)), strict=True)
    of = [kept[w] if w in kept else found[w] for w in words]
    if len(kept) < WORDS:
        kept |= ((w, i) for w, i in found.items() if len(w) <= WORD)
    size = np.cumsum([0, *map(len, of)])
    gaps = [i for i, w in enumerate(words) if w == " "]
    cut, b = size[[0, *gaps, len(words)]].tolist(), b"".join(of)
    return [b[x:y] for x, y in zip(cut, cut[1:])]


def chunk_ids(chunks: set[bytes], path: str) -> dict[bytes, bytes]:
    """Ids (little-endian unsigned 32 bits) of chunks between ASCII spaces.

    The tokenizer drops spaces and merges within words only, so the ids of
    a text are those of its chunks in a row; frequent chunks are kept."""
    kept = _ids.setdefault(path, {})
    if len(kept) > CACHE or _kept_bytes.get(path, 0) > CACHE_BYTES:
        # what came first is what comes often
        for c in list(kept)[len(kept) // 2:]:
            del kept[c]
        _kept_bytes[path] = sum(map(len, kept))
    new = list(chunks.difference(kept))
    if not new:
        return kept
    _kept_bytes[path] = _kept_bytes.get(path, 0) + sum(map(len, new))
    light = words_tokenizer(path)
    if light is not None:
        plain = new if is_plain(b" ".join(new), light[2]) else [c for c in new if is_plain(c, light[2])]
        if plain:
            kept |= zip(plain, plain_ids(plain, path), strict=True)
            new = [c for c in new if c not in kept] if len(plain) < len(new) else []
    t = tokenizer(path)
    for i in range(0, len(new), BATCH):
        part = new[i:i + BATCH]
        got = t.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)
        for c, e in zip(part, got):
            kept[c] = array("I", e.ids).tobytes()
    return kept


def chunked(b: pa.RecordBatch, path: str) -> Iterator[tuple]:
    """``(doc_id, chunks, ids of chunks)`` of each row, tokenised some rows
    at a time."""
    for at in range(0, b.num_rows, ROWS):
        part = b.slice(at, ROWS)
        texts = [(t or b"").split() for t in part.column(1).to_pylist()]
        kept = chunk_ids(set().union(*texts), path)
        yield from ((doc_id, words, kept) for doc_id, words in zip(part.column(0).to_pylist(), texts))


def pieces(docs: DataFrame, path: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, salt)``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        row = 0
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, words, kept in chunked(b, path):
                row += 1
                buf = b"".join([kept[w] for w in words]) + end
                n = len(buf) // 4
                for start in range(0, n, length):
                    part = buf[4 * start:4 * (start + length)]
                    for c, v in zip(cols, (doc_id, start, len(part) // 4, zlib.crc32(part), n,
                                           xxhash.xxh64_intdigest(f"{doc_id}|{start}|{row}") >> 1)):
                        c.append(v)
            types = [b.column(0).type] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size (given in falling order).

    ``tree[1]`` is the largest free room of all bins, and each inner node
    the larger of its two children: going left whenever the left child fits
    leads to the first bin with enough room."""
    leaves = 1 << max(0, int(np.ceil(np.log2(max(1, len(sizes))))))
    tree = [room] * (2 * leaves)
    bins, offsets = [], []
    for s in sizes.tolist():
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < s:
                at += 1
        bins.append(at - leaves)
        offsets.append(room - tree[at])
        tree[at] -= s
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins, offsets


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  Sequences fill gaplessly from offset 0."""
    made = materialise(pieces(docs, path, length, end_id, id_col, text_col), "packing-pieces")
    groups = max(1, -(-made.count() // GROUP))
    dealt = made.withColumn("g", F.pmod(F.col("salt"), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("salt", "ascending")])
        bins, offsets = first_fit_decreasing(t["length"].to_numpy(), length)
        sequence = t["g"].to_numpy() * (1 << 32) + np.array(bins, dtype=np.int64)
        return (t.drop_columns(["g", "salt"]).append_column("sequence_id", pa.array(sequence, pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))
    kind = made.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("g").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, "
                                                "doc_tokens long, sequence_id long, offset long")
