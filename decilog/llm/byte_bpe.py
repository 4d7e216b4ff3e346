"""Byte-level BPE by dynamic programming over byte prefixes.

A BPE encoding is a chain of tokens in which every neighbouring pair is *valid*:
encoding the pair's bytes gives the pair back. So each prefix of a piece has exactly
one token that can come last. The table of those last tokens is all that is kept:
an append only extends it; after an edit it is kept up to the edit and filled again
from there until it agrees with the old one over the longest token's length, from
where on it is the old one. A text is a row of such pieces: an edit cuts the pieces
anew from a few before it up to the first border that was one before.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain
from os.path import commonprefix

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import need

#: Entries a worker keeps of pieces and of pairs before it starts afresh.
CACHE = 500_000

#: Text for which Python's classes agree with the pattern's Unicode classes: Latin
#: letters and punctuation without number signs (superscripts, fractions) and
#: without the separators U+001C to U+001F, which only Python takes for white space.
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]*")
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Splitter:
    """Cuts a text into the pieces of ``pattern``; plain text by an equal, quicker form."""

    def __init__(self, pattern: str) -> None:
        import public_tokenizers
        import regex

        self.exact = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.quick = pattern == public_tokenizers.PATTERN

    def __call__(self, text: str) -> list[str]:
        if self.quick and PLAIN.fullmatch(text):
            return QUICK.findall(text)
        return self.exact.findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a tiktoken vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixCoder:
    """Encodes pieces through prefix tables over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.token_of = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def merge(self, data: bytes, halves: bool = False) -> list[bytes]:
        """Plain BPE: join the neighbouring parts of the lowest rank until none can be joined.

        ``halves``: stop before the join that gives all of ``data``.
        """
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 2 - (not halves):
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join made ``token``; None for a single byte."""
        found = self.halves.get(token, 0)
        if found == 0:
            data = self.token_of[token]
            parts = self.merge(data, halves=True) if len(data) > 1 else []
            found = self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return found

    def valid(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded."""
        found = self.pairs.get(left << 32 | right)
        if found is None:
            if len(self.pairs) > 2 * CACHE:
                self.pairs.clear()
            found = self.pairs[left << 32 | right] = self.border_holds(left, right)
        return found

    def border_holds(self, left: int, right: int) -> bool:
        """Undo the joins at the border from the latest back, in search of one across it.

        Joins happen in order of rank, and of equal ranks the left one first. At each
        step the parts that touch the border are those of one moment of the merging;
        a join across the border that ranks before the next join of either side would
        have come first.
        """
        token_of, ranks = self.token_of, self.ranks
        before = 1 << 60  # joins across the border count if they rank below this
        while True:
            across = ranks.get(token_of[left] + token_of[right])
            if across is not None and across < before:
                return False
            in_left, in_right = self.half(left), self.half(right)
            if in_left is None and in_right is None:
                return True
            if in_right is None or in_left is not None and left > right:
                before, left = left, in_left[1]  # a left join of equal rank comes before one across
            else:
                before, right = right + 1, in_right[0]  # one across comes before a right join of equal rank

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` up to the length of ``data``; last[i - 1] ends the prefix of i bytes.

        An automaton over the vocabulary names the tokens that end at each byte. A
        table that is already filled to ``known`` bytes only needs matches that end later.
        """
        known, done = len(last), len(last)
        last += [-1] * (len(data) - known)  # -1: no encoding ends here (a vocabulary without some byte)
        pairs, valid = self.pairs, self.valid
        from_byte = max(0, known + 1 - self.longest)
        for at, (token, length) in self.automaton.iter(data[from_byte:].decode("latin-1")):
            end = at + from_byte
            if end < done:  # found, or filled before
                continue
            start = end - length
            if start >= 0:
                left = last[start]
                if left < 0:
                    continue
                held = pairs.get(left << 32 | token)
                if not (valid(left, token) if held is None else held):
                    continue
            last[end] = token
            done = end + 1
        return last

    def read(self, last: list[int]) -> list[int]:
        """The tokens of the whole table, from its end back."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(token)
            at -= len(self.token_of[token])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        return self.read(self.extend(data, []))


class PrefixTable:
    """One piece's bytes with their table; appends and edits fill only what changed."""

    def __init__(self, coder: PrefixCoder, data: bytes = b"") -> None:
        self.coder, self.data = coder, data
        self.last = coder.extend(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.coder.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of data[start:end]; returns how many entries were filled.

        An entry depends on the bytes and the entries of the longest token's length before
        it. So once that many entries behind the edit are the old ones, moved by the
        edit's change of length, all that follow are.
        """
        start, end = min(start, len(self.data)), min(end, len(self.data))
        old, moved, longest = self.last, len(new) - (end - start), self.coder.longest
        self.data = self.data[:start] + new + self.data[end:]
        last, upto, behind = old[:start], start, start + len(new)
        while upto < len(self.data):
            upto = min(len(self.data), max(upto, behind) + longest)
            self.coder.extend(self.data[:upto], last)
            if upto - longest >= behind and last[upto - longest :] == old[upto - longest - moved : upto - moved]:
                break
        self.last = last + old[upto - moved :] if upto < len(self.data) else last
        return upto - start

    def ids(self) -> list[int]:
        return self.coder.read(self.last)


class Pieces(dict):
    """piece -> ids, encoded when first asked for."""

    def __init__(self, coder: PrefixCoder) -> None:
        self.coder = coder

    def __missing__(self, piece: str) -> list[int]:
        ids = self.coder.encode(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class TextCoder:
    """Whole texts: split into pieces, each encoded once per worker while the cache holds it."""

    def __init__(self, path: str, pattern: str) -> None:
        self.coder, self.split = PrefixCoder(read_ranks(path)), Splitter(pattern)
        self.pieces = Pieces(self.coder)

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.coder.token_of.__getitem__, ids))


class TextTable:
    """A text with the ids of its pieces, and prefix tables of the long ones; an edit touches what lies near it."""

    #: Pieces before an edit that it can still change: a contraction's two, and white space that looks ahead.
    BACK = 3
    #: Characters from which a piece keeps its table.
    LONG = 64

    def __init__(self, coder: TextCoder, text: str = "") -> None:
        self.coder, self.text = coder, ""
        self.pieces: list[str] = []
        self.encoded: list[list[int]] = []
        self.tables: dict[int, PrefixTable] = {}  # by place
        self.starts: list[int] = []
        self.replace(0, 0, text)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in the place of text[start:end]; returns how many pieces were cut anew."""
        moved, behind = len(new) - (end - start), start + len(new)
        first = max(0, bisect_right(self.starts, start) - 1 - self.BACK)
        at = self.starts[first] if first < len(self.starts) else 0
        self.text = self.text[:start] + new + self.text[end:]
        made, stop = [], len(self.pieces)
        for m in self.coder.split.exact.finditer(self.text, at):
            if m.start() >= behind and (k := bisect_left(self.starts, m.start() - moved)) < len(self.starts) and self.starts[k] == m.start() - moved:
                stop = k
                break
            made.append(m.group())
        encoded, tables = [], {}
        for place, piece in enumerate(made, first):
            if len(piece) < self.LONG:
                encoded.append(self.coder.pieces[piece])
                continue
            tables[place] = self.of_long(piece, self.tables.get(place) if stop - first == len(made) else None)
            encoded.append(tables[place].ids())
        later = len(made) - (stop - first)
        self.tables = {k + later * (k >= stop): t for k, t in self.tables.items() if not first <= k < stop} | tables
        self.pieces[first:stop], self.encoded[first:stop] = made, encoded
        self.starts[first:] = accumulate(map(len, self.pieces[first:-1]), initial=at) if self.pieces else []
        return len(made)

    def of_long(self, piece: str, old: PrefixTable | None) -> PrefixTable:
        """The table of a long piece, from that of the piece that stood in its place if there is one."""
        data = piece.encode()
        if old is None:
            return PrefixTable(self.coder.coder, data)
        same = len(commonprefix([old.data, data]))
        tail = len(commonprefix([old.data[same:][::-1], data[same:][::-1]]))
        old.replace(same, len(old.data) - tail, data[same : len(data) - tail])
        return old

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.encoded))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every whole text (null: empty, no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextCoder(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [coder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of every id list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = {r: t for t, r in read_ranks(path).items()}
        for batch in batches:
            data = [b"".join(map(token_of.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    rows = need(tokens, id_col, ids_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids again.

    One row per row of ``docs``; null and empty texts have no tokens and the digest
    of nothing. Digests leave the worker, not the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextCoder(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
