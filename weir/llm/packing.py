"""Operator 11, packing: sum-of-squares online packing into windows of a fixed number of tokens.

Each task packs the documents that it reads, in one pass and without a shuffle. A level array holds, for each fill level,
how many partially filled windows have it. A document (what is left of it, where it is longer than a window: whole windows
of it are full at once) goes to the level, an empty window included, that makes the sum of the squared counts least; ties go
to the fullest. Levels that are met often are thus spread, and windows of a level wait for documents that just fill them.

At most `open_windows` windows are open: where one more would be needed and no open one has room, the document is cut at
the end of a window of the most frequent level. When a task's documents are over, its open windows are filled up: the emptiest
hand their pieces to the gaps of the fullest. All sequences but a task's last one are then full; that one is cut at powers of
two, so that nothing is padded.

State: `open_windows` windows of ids (2 MB by default) and the documents of one batch. A task that is lost is run again
whole; sequence ids hold the partition's number, so that tasks need not know of each other.

Cases: null and empty texts are documents of the end id alone; repeated rows are packed each for itself; rows without a doc_id
are packed, too; special strings inside a text are taken as the library does by default (one id each); other columns are not
read; very long texts are cut, never shortened; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_parts, text_rows
from .token_counts import byte_symbols


class Encoder:
    """The ids that the vocabulary's library gives, by a faster library with the same merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("byte-level BPE vocabularies without a normalizer are supported")
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of a vocabulary must follow the order of its merges")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = byte_symbols()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        #: The split of byte-level pre-tokenisers, a fixed value of the format.
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.path, self.fast, self.exact = path, tiktoken.Encoding("weir", pat_str=split, mergeable_ranks=ranks, special_tokens=special), None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run of white space too long for its pattern's stack
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
                self.exact.no_truncation(), self.exact.no_padding()
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@dataclass(slots=True)
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc, self.start + n, self.ids[n:], self.doc_tokens)


class Packer:
    """Packs pieces one after the other; add() and finish() give the sequences (lists of pieces) that are done."""

    def __init__(self, window: int, open_windows: int):
        if window < 2 or open_windows < 1:
            raise ValueError("a window has 2 tokens or more, and one window or more can be open")
        self.window, self.most = window, open_windows
        self.level = np.zeros(window + 1, dtype=np.int64)  # windows of each fill level
        self.at: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        rest = Piece(doc, 0, ids, len(ids))
        while len(rest.ids) >= self.window:
            full, rest = rest.cut(self.window)
            yield [full]
        while len(rest.ids):
            n = len(rest.ids)
            target = self._best(n)
            if target is None:  # no room: cut at the end of a window of the most frequent level
                target = int(self.window - 1 - np.argmax(self.level[self.window - 1 : 0 : -1]))
                n = self.window - target
            piece, rest = rest.cut(n)
            yield from self._put(target, piece)

    def _best(self, n: int) -> int | None:
        """The level that a piece of n tokens goes to; 0 for a new window."""
        held, then = self.level[1 : self.window - n + 1], self.level[n + 1 : self.window + 1]
        cost = 2 * (then - held) + 2  # of (then + 1)^2 - then^2 + (held - 1)^2 - held^2
        if len(cost):
            cost[-1] = 1 - 2 * held[-1]  # the window is full then and leaves the array
            cost[held == 0] = np.iinfo(np.int64).max
            best = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if held[best] and (self.n_open >= self.most or cost[best] <= 2 * self.level[n] + 1):
                return best + 1
        return 0 if self.n_open < self.most else None

    def _put(self, level: int, piece: Piece) -> Iterator[list[Piece]]:
        if level:
            pieces = self.at[level].pop()
            self.level[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += len(piece.ids)
        if level == self.window:
            yield pieces
        else:
            self.at.setdefault(level, []).append(pieces)
            self.level[level] += 1
            self.n_open += 1

    def finish(self) -> Iterator[list[Piece]]:
        """What is open: the emptiest windows fill the gaps of the fullest; the last one is cut at powers of two."""
        rows = [[level, pieces] for level in sorted(self.at, reverse=True) for pieces in self.at[level]]
        self.__init__(self.window, self.most)
        first, last = 0, len(rows) - 1
        while first < last:
            gap = self.window - rows[first][0]
            piece = rows[last][1].pop()
            if len(piece.ids) > gap:
                piece, kept = piece.cut(gap)
                rows[last][1].append(kept)
            for row, more in ((first, len(piece.ids)), (last, -len(piece.ids))):
                rows[row][0] += more
            rows[first][1].append(piece)
            if not rows[last][0]:
                last -= 1
            if rows[first][0] == self.window:
                yield rows[first][1]
                first += 1
        if first == last:
            yield from self._powers(rows[first][1], rows[first][0])

    @staticmethod
    def _powers(pieces: list[Piece], left: int) -> Iterator[list[Piece]]:
        pieces = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out = []
            while room:
                piece = pieces.pop()
                if len(piece.ids) > room:
                    piece, kept = piece.cut(room)
                    pieces.append(kept)
                out.append(piece)
                room -= len(piece.ids)
            yield out


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, open_windows: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start (its document's ids before it), length, ids (unsigned 32 bits each, little end
    first), doc_tokens (with the end id), sequence_id, offset (place in the sequence, without gaps from 0).

    vocabulary: a path that every executor can open.
    """
    rows = text_rows(docs, doc_id, text)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T._parse_datatype_string("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), Packer(window, open_windows)
        end, number = np.array([end_id], dtype=np.uint32), TaskContext.get().partitionId() << 33
        kind = None

        def table(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            doc, start, length, ids, of, sequence, offset = ([] for _ in range(7))
            for pieces in sequences:
                at = 0
                for p in pieces:
                    doc.append(p.doc), start.append(p.start), length.append(len(p.ids)), ids.append(p.ids.astype("<u4").tobytes()), of.append(p.doc_tokens), sequence.append(number), offset.append(at)
                    at += len(p.ids)
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(doc, kind), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (of, sequence, offset))], names=schema.names)

        for batch in batches:
            kind = batch.column("doc_id").type
            done = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                done += packer.add(i, np.concatenate([encode(t), end]) if t else end)
            yield table(done)
        if kind is not None:
            yield table(list(packer.finish()))

    return map_parts(rows, "text", run, schema)


def assemble(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (as in pack_documents), and documents: the doc_id, start and length of each piece in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens",
        F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["start"], p["length"])).alias("documents"),
    )
