"""Vector bin packing of token sequences.

Every example is a vector of three demands: tokens, segments and loss-bearing tokens. A bin (one
training sequence) has a capacity in each. Whole sequences are cut off a long example first. The
rest goes into the open bin, among those with room, for which the dot product of demand and free
capacity, both as shares of the limits, is largest; an example that fits nowhere is cut to fill
the bin that has the largest product, and what is left opens another. At most OPEN_BINS bins are
open; the fullest one leaves when another is opened. What leaves unfilled is cut again into a
stream: full sequences, and at the end of a partition the binary digits of what remains, as a
sequence whose length is a power of two needs no padding. Where the segment or loss limit binds
first, a sequence is padded.

Each partition is packed as it streams by, so nothing is shuffled and memory holds the open bins.
sequence_id is the partition's number times 2^33 plus a count, unique and the same when a lost
task runs again.

All tokens of a text bear loss unless loss_from says where its response starts, so for plain documents
the loss limit is the token limit; in a table of instructions all three can bind.

Defined results: a null or empty text is the single id 0 that ends each document. A text that spells
out a special token of the vocabulary has that token's id there, as the tokenizers library gives it.
Null doc_ids and repeated rows are packed as any other row. Columns besides doc_id and text are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 1024
MAX_SEGMENTS = 256
OPEN_BINS = 32
END = 0
PORTION = 8_000_000  # bytes of text encoded together
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# Fixed value: the published pre-tokenisation pattern of this byte-level BPE family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_of() -> dict[str, int]:
    """The byte that each character of the vocabulary file stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


# Fixed value: the white space of the pattern, as RE2 writes it.
WHITE = r"\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


class Encoder:
    """Token ids as little-endian bytes, by the vocabulary of a tokenizers file.

    The merges run in tiktoken on the file's vocabulary, whose ids are its merge ranks; the ids are those
    of the tokenizers library without added special tokens (tests compare them). A text that spells out a
    special token goes to that library itself, which gives the token's own id.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        self.path, self.library = path, None
        self.special = "|".join(re.escape(t) for t in sorted(special))
        self.spells = re.compile(self.special) if special else None
        to_byte = byte_of()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.model = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.after_space = np.zeros(max(ranks.values()) + 1, bool)
        self.after_space[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def encode(self, text: str) -> bytes:
        if self.spells and self.spells.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.model.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def portion(self, texts: pa.Array) -> list[bytes]:
        """encode() of each text, without nulls; each distinct word is encoded once.

        In byte-level BPE a single space between other characters always starts a token of its own word,
        and only there does a token start with a space. So the distinct words are encoded as one text and
        parted at those tokens. A text with other white space next to a space, or with a special token, is
        encoded whole.
        """
        words = pc.split_pattern(texts, " ")
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        odd = pc.match_substring_regex(distinct, f"^$|^[{WHITE}]|[{WHITE}]$").to_numpy(zero_copy_only=False)
        table = self.model.encode_to_numpy("".join(" " + w for w in distinct.filter(pa.array(~odd)).to_pylist()), disallowed_special=()).astype("<u4")
        first = np.flatnonzero(self.after_space[table])
        starts, sizes = np.zeros(len(odd), np.int64), np.zeros(len(odd), np.int64)
        starts[~odd], sizes[~odd] = first, np.diff(np.append(first, len(table)))
        whole = np.logical_or.reduceat(odd[codes], bounds[:-1])
        if self.spells:
            whole |= pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        # the first word has no space before it
        n = sizes[codes]
        n[bounds[:-1]] = 0
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = table[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[bounds]
        return [
            self.encode(texts[i].as_py()) if whole[i] else self.encode(distinct[int(codes[bounds[i]])].as_py()) + flat[at[i] : at[i + 1]].tobytes()
            for i in range(len(texts))
        ]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of each text, null as empty, in portions of bounded size (or of one text)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION, "right")))
            yield from self.portion(texts[at:end])
            at = end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Bin:
    __slots__ = ("pieces", "tokens", "loss")

    def __init__(self):
        self.pieces, self.tokens, self.loss = [], 0, 0


class Packer:
    """Places pieces (doc_id, start, ids as bytes, doc_tokens, loss-bearing tokens); emits finished sequences."""

    def __init__(self, emit, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, open_bins: int = OPEN_BINS):
        self.emit, self.max_tokens, self.max_segments, self.max_loss, self.open_bins = emit, max_tokens, max_segments, max_loss or max_tokens, open_bins
        self.bins: list[Bin] = []
        self.tail: list[tuple] = []
        self.tail_tokens = 0

    @staticmethod
    def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        """The first n tokens and the rest; loss-bearing tokens are the last ones of an example."""
        doc, start, ids, total, loss = piece
        size = len(ids) // 4
        rest = min(loss, size - n)
        return (doc, start, ids[: 4 * n], total, loss - rest), (doc, start + n, ids[4 * n :], total, rest)

    def room(self, b: Bin, piece: tuple) -> int:
        """How many of the piece's first tokens the bin takes."""
        size, loss = len(piece[2]) // 4, piece[4]
        if len(b.pieces) >= self.max_segments:
            return 0
        n = min(size, self.max_tokens - b.tokens)
        free = self.max_loss - b.loss
        return n if self.cut(piece, n)[0][4] <= free else min(n, size - loss + free)

    def product(self, b: Bin, piece: tuple) -> float:
        return (
            len(piece[2]) // 4 / self.max_tokens * (1 - b.tokens / self.max_tokens)
            + 1 / self.max_segments * (1 - len(b.pieces) / self.max_segments)
            + piece[4] / self.max_loss * (1 - b.loss / self.max_loss)
        )

    def add(self, piece: tuple) -> None:
        while len(piece[2]) // 4 >= self.max_tokens:
            n = self.room(Bin(), piece)
            head, piece = self.cut(piece, n)
            self.emit([head])
        if not piece[2]:
            return
        size = len(piece[2]) // 4
        rooms = [(self.room(b, piece), b) for b in self.bins]
        whole = [b for n, b in rooms if n == size]
        if whole:
            self.place(max(whole, key=lambda b: self.product(b, piece)), piece)
            return
        if len(self.bins) < self.open_bins:
            self.open(piece)
            return
        some = [(n, b) for n, b in rooms if n]
        if some:
            n, b = max(some, key=lambda x: self.product(x[1], piece))
            head, rest = self.cut(piece, n)
            self.place(b, head)
            self.add(rest)
        else:
            self.open(piece)

    def open(self, piece: tuple) -> None:
        if len(self.bins) >= self.open_bins:
            self.leave(max(self.bins, key=lambda b: b.tokens))
        b = Bin()
        self.bins.append(b)
        n = self.room(b, piece)
        head, rest = self.cut(piece, n)
        self.place(b, head)
        if rest[2]:
            self.add(rest)

    def place(self, b: Bin, piece: tuple) -> None:
        b.pieces.append(piece)
        b.tokens += len(piece[2]) // 4
        b.loss += piece[4]
        if b.tokens == self.max_tokens:
            self.bins.remove(b)
            self.emit(b.pieces)

    def leave(self, b: Bin) -> None:
        self.bins.remove(b)
        for piece in b.pieces:
            self.tail.append(piece)
            self.tail_tokens += len(piece[2]) // 4
        while self.tail_tokens >= self.max_tokens:
            self.drain(self.max_tokens)

    def drain(self, most: int) -> None:
        """A sequence of at most `most` tokens from the tail."""
        b = Bin()
        while self.tail and b.tokens < most:
            piece = self.tail.pop(0)
            n = min(self.room(b, piece), most - b.tokens)
            if not n:
                self.tail.insert(0, piece)
                break
            head, rest = self.cut(piece, n)
            b.pieces.append(head)
            b.tokens += n
            b.loss += head[4]
            if rest[2]:
                self.tail.insert(0, rest)
        self.tail_tokens -= b.tokens
        self.emit(b.pieces)

    def finish(self) -> None:
        for b in list(self.bins):
            self.leave(b)
        while self.tail_tokens:
            self.drain(1 << (self.tail_tokens.bit_length() - 1))


def pack(
    docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None, loss_from: str | None = None,
) -> DataFrame:
    """A row for each piece of docs(doc_id, text); `tokenizer` is the file's path on every executor.

    loss_from names a column with the character at which an example's loss-bearing part (the
    response) starts; without it all tokens bear loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(tokenizer)
        base, count, rows = TaskContext.get().partitionId() << 33, 0, []

        def emit(pieces: list[tuple]) -> None:
            nonlocal count
            offset = 0
            for doc, start, ids, total, _ in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, base + count, offset))
                offset += n
            count += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        packer = Packer(emit, max_tokens, max_segments, max_loss)
        for batch in batches:
            doc, text, at = (batch.column(c) for c in ("doc_id", "text", "at"))
            # a text with a loss-bearing part is encoded in two pieces, others in portions
            for i, ids in enumerate(held.encode_all(pc.if_else(pc.is_null(at), text, None))):
                k, before = at[i].as_py(), b""
                if k is not None:
                    t = text[i].as_py() or ""
                    before = held.encode(t[:k])
                    ids = before + held.encode(t[k:])
                ids += END.to_bytes(4, "little")
                n = len(ids) // 4
                packer.add((doc[i].as_py(), 0, ids, n, n - len(before) // 4))
            if len(rows) > 20_000:
                yield out()
        packer.finish()
        yield out()

    at = F.col(loss_from).cast("int") if loss_from else F.lit(None).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), at.alias("at")).mapInArrow(run, SCHEMA)
