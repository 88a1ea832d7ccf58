"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece the table holds the last token of that prefix's encoding. A token t that ends at
byte e is that last token if and only if the last token of the prefix before t, followed by t, is what BPE makes of
their joined bytes: an encoding is right exactly where each adjacent pair is. One token fits, so the table is unique,
a longer piece only extends it, and an edit leaves all entries before it as they are.

Texts: null counts as empty; an empty text has no tokens. Repeated rows each give their row, extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import os
from array import array

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import by_batch

#: Bytes that each of the two caches of a worker may hold, about; past it that cache starts anew.
CACHE = 40 << 20
#: What an entry of a cache takes beside the bytes of its key and value.
ENTRY = 160


class Vocabulary:
    """Ranks of a tiktoken file, with the checks that the table needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.sizes = [len(piece) for piece in self.bytes_of]
        self.longest = max(self.sizes)
        #: Finds the tokens that end at each byte, the longest first; bytes stand as the characters of their numbers.
        self.ends = ahocorasick.Automaton()
        for piece, rank in ranks.items():
            self.ends.add_word(piece.decode("latin-1"), rank)
        self.ends.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def merged(self, piece: bytes, down_to: int = 1) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, the leftmost first. Only for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.bytes_of)), i) for i in range(len(parts) - 1))
            if rank == len(self.bytes_of):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """What the last merge of a token joins; None for a byte."""
        if (found := self._halves.get(token, False)) is False:
            parts = self.merged(self.bytes_of[token], 2)
            found = self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right stay apart in their joined bytes.

        Undoes the merges of both sides from the last to the first. If the tokens that then meet could merge
        at a lower rank than the merge undone last, they would have done so before it."""
        key = left * len(self.bytes_of) + right
        if (found := self._pairs.get(key)) is None:
            if len(self._pairs) * ENTRY >= CACHE:
                self._pairs.clear()
            found = self._pairs[key] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        ranks, names, before = self.ranks, self.bytes_of, len(self.bytes_of)
        while True:
            if ranks.get(names[left] + names[right], before) < before:
                return False
            inner, outer = self.halves(left), self.halves(right)
            if inner is None and outer is None:
                return True
            if outer is None or inner is not None and left > right:
                before, left = left, inner[1]
            else:
                before, right = right + 1, outer[0]  # of equal ranks the left one merges first

    def stands(self, token: int) -> bool:
        if (found := self._alone.get(token)) is None:
            found = self._alone[token] = self.merged(self.bytes_of[token]) == [token]
        return found


class PrefixTable:
    """The last token of each prefix of one piece, four bytes each; bytes can be added, and changed anywhere.

    filled: how many entries the last change has worked out."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", array("i", (-1,))
        self.append(piece)

    def append(self, more: bytes) -> PrefixTable:
        at, self.piece = len(self.piece), self.piece + more
        self._fill(at)
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Bytes start to end become new. Entries before start stay as they are. An entry depends on as many bytes and entries
        before it as the longest token has: once that many past the edit are as before, so are all that follow."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[: start + 1]
        if (reached := self._fill(start, start + len(new), old, shift)) < len(self.piece):
            self.last.extend(old[reached - shift + 1 :])
        return self

    def _fill(self, at: int, past: int = 0, old: array | None = None, shift: int = 0) -> int:
        """Entries of the prefixes longer than at, up to the end or to where old, moved by shift, goes on alike; how far."""
        v, last = self.vocabulary, self.last
        sizes, pairs, many, longest = v.sizes, v._pairs, len(v.bytes_of), v.longest
        start, done, same = max(0, at - longest), at, 0
        for place, token in v.ends.iter(self.piece[start:].decode("latin-1")):
            end = start + place + 1
            if end <= done:
                continue
            if (n := sizes[token]) == end:
                if not v.stands(token):
                    continue
            elif n > 1:  # a byte alone ends what no longer token does
                before = last[end - n]
                if (fits := pairs.get(before * many + token)) is None:
                    fits = v.fits(before, token)
                if not fits:
                    continue
            last.append(token)
            done = end
            if old is not None:
                same = same + 1 if end > past and min(end, end - shift) > longest and old[end - shift] == token else 0
                if same > longest:
                    break
        self.filled = done - at
        return done

    def tokens(self) -> list[int]:
        last, sizes, out, end = self.last, self.vocabulary.sizes, [], len(self.piece)
        if end and (whole := self.vocabulary.ranks.get(self.piece)) is not None:
            return [whole]  # a piece that is itself in the vocabulary is one token
        while end:
            out.append(token := last[end])
            end -= sizes[token]
        return out[::-1]


class Encoder:
    """Texts to ids: pieces by the pattern, each by its table."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._packed: dict[str, bytes] = {}
        self._held = 0

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        cache, out = self._packed, []
        for piece in self.pattern.findall(text) if len(text) < 1 << 20 else (m[0] for m in self.pattern.finditer(text)):
            if (ids := cache.get(piece)) is None:
                ids = np.array(self.piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= 64:
                    self._held += ENTRY + 2 * len(piece) + len(ids)
                    if self._held > CACHE:
                        cache.clear()
                        self._held = 0
                    cache[piece] = ids
            out.append(ids)
        return b"".join(out)

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.vocabulary.ranks.get(data)) is not None:
            return [whole]
        return PrefixTable(self.vocabulary, data).tokens()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class EncodedText:
    """A text with the tables of its pieces, for appends and edits that encode again only what they touch."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> EncodedText:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> EncodedText:
        """Characters start to end become new. Pieces are cut again from two before the edit (the pattern looks one
        character ahead) until a cut falls, past the edit, where there was one before. A piece that starts where one did
        takes over its table and changes it only between the bytes that both have at their ends."""
        first = max(0, bisect.bisect_right(self.starts, start) - 3)
        at = self.starts[first] if self.starts else 0
        shift = len(new) - (end - start)
        old = {s + shift: i for i, s in enumerate(self.starts) if s > end}
        there = {s: i for i, s in enumerate(self.starts) if s <= start}
        self.text = self.text[:start] + new + self.text[end:]
        starts, tables, tail = [], [], len(self.starts)
        for m in self.encoder.pattern.finditer(self.text, at):
            if m.start() > start + len(new) and m.start() in old:
                tail = old[m.start()]
                break
            starts.append(m.start())
            tables.append(self._table(m[0].encode(), there.get(m.start())))
        else:
            tail = len(self.starts)
        self.tables[first:] = tables + self.tables[tail:]
        self.starts[first:] = starts + [s + shift for s in self.starts[tail:]]
        return self

    def _table(self, piece: bytes, like: int | None) -> PrefixTable:
        if like is None:
            return PrefixTable(self.encoder.vocabulary, piece)
        table = self.tables[like]
        before = table.piece
        head = len(os.path.commonprefix([piece, before]))
        rear = len(os.path.commonprefix([piece[head:][::-1], before[head:][::-1]]))
        return table.edit(head, len(before) - rear, piece[head : len(piece) - rear])

    def tokens(self) -> list[int]:
        return [x for table in self.tables for x in table.tokens()]


#: One for each vocabulary that this worker process has met.
_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process; the file is part of an installed package, found at the same place everywhere."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _encoders[path, pattern]


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _release() -> None:
    """At the end of a partition: the worker goes on to other work, and a vocabulary is loaded in a tenth of a second."""
    _encoders.clear()


def _encoded(columns: dict, path: str, pattern: str) -> dict:
    own = encoder(path, pattern)
    packed = [own.packed(t or "") for t in columns["text"]]
    return columns | {"ids": packed, "decoded": [own.decode(p) for p in packed]}


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded (the bytes that the ids stand for) of whole texts.

    No shuffle; a worker holds one batch of a few MB, and caches of CACHE bytes each until the end of a partition."""
    default = public_vocabulary()
    out = T.StructType([docs.select("doc_id").schema[0], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return by_batch(docs.select("doc_id", "text"), out, _encoded, path or default[0], pattern or default[1], done=_release)


def encoding_digests(docs: DataFrame) -> DataFrame:
    return encode_documents(docs).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
