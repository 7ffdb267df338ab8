"""Packing token sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import ranked, stored

SIZE = 2048
#: The word pieces a task keeps at most; beyond, it starts afresh (results do not depend on it).
REMEMBERED = 400_000
#: Pieces of a length are ranked in hash buckets of about so many at most.
PER_BUCKET = 200_000


class _Pieces(dict):
    """Word piece -> its ids as little-endian bytes; asks the encoder once for each."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[piece] = np.array(self.encode(piece), dtype="<u4").tobytes()
        return found


class Tokens:
    """Ids of the tokenizers file of the 50k byte-level vocabulary, its added token included; made with its rank file."""

    def __init__(self, ranks_path: str | None = None, file_path: str | None = None):
        import base64
        import json
        import re

        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(file_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip or normalise what is near them are not known here")
        self.added = {x["content"]: np.array([x["id"]], dtype="<u4").tobytes() for x in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = _Pieces(self.plain)
        self.odd = re.compile(r"\s [\s]|\s\s ").search

    def ids(self, text: str) -> bytes:
        """The text is cut at added tokens first, as the library does; each part between them is encoded by itself."""
        if any(x in text for x in self.added):
            return b"".join(self.added[x] if i % 2 else self._part(x) for i, x in enumerate(self.cut(text)))
        return self._part(text)

    def _part(self, text: str) -> bytes:
        """A single space between two that are not white space always begins a token, so words are encoded apart and remembered."""
        if "  " in text or self.odd(text) or len(text) > 1 << 24:
            return np.array(self.plain(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        got = self.pieces
        return got[first] + b"".join([got[" " + x] for x in rest]) if text else b""


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 1, ranks_path: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each text's ids and the end id, cut every `size` ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        tokens, end = Tokens(ranks_path), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tokens.ids(text.as_py() or "") + end
                n = len(ids) // 4
                out += [(i, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Shortest pack first: lengths longest first, each to the packs with the most room; (lengths in a pack, packs).

    Packs that hold the same lengths are one pattern with a count, so the work depends on the histogram alone.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, x in open_packs.items() if x), default=0)
            if room < length:
                open_packs.setdefault(size - length, []).append(((length,), left))
                break
            have, count = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
            used = min(left, count)
            open_packs.setdefault(room - length, []).append(((*have, length), used))
            if used < count:
                open_packs.setdefault(room, []).append((have, count - used))
            left -= used
    return [x for r in sorted(open_packs) for x in open_packs[r]]


def _places(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Columns: length, first rank, first sequence, offset; sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for lengths, count in found:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + count
            offset += n
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 1, ranks_path: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece in sequences of at most `size`.

    Texts are encoded once, and the pieces (no text) written; their histogram has at most `size` lengths, whatever
    the input, so it and the patterns are made on the driver. A piece then finds its pack by its rank among the
    pieces of its length. Null text counts as empty: its sole id is the end id. Rows with equal ids are packed
    each; an empty table gives no rows. Only id and text are read from docs.
    """
    cut = stored(pieces(docs, id_col, text_col, size, end_id, ranks_path), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(patterns(histogram, size))
    shared = cut.sparkSession.sparkContext.broadcast(places)
    numbered = ranked(cut, ["length"], ["id", "start", "ids_crc32"], "rank", max(1024, sum(histogram.values()) // PER_BUCKET))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        at = lambda n, r: n.astype(np.int64) * (1 << 50) + r
        i = np.searchsorted(at(table[:, 0], table[:, 1]), at(length.to_numpy(), rank.to_numpy()), side="right") - 1
        return pd.DataFrame({"sequence_id": table[i, 2] + rank.to_numpy() - table[i, 1], "offset": table[i, 3]})

    return numbered.withColumn("x", place("length", "rank")).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "x.sequence_id", "x.offset")
