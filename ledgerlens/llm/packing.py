"""Packing documents into sequences.

Documents are tokenised, end with an end id and are cut into pieces of at most the length of a sequence. Pieces are dealt to
groups at random; in each group the pieces go, longest first, to the first sequence with room (first-fit decreasing). A
tournament tree over the free room of the sequences finds it in a logarithmic number of steps.

The number of groups follows the number of pieces, so a group stays at about `group_pieces` pieces whatever the size of the
table; only lengths and checksums are grouped, never texts or ids.

Defined results: a missing or empty text is the end id alone; texts are tokenised whole, and long ones give many
pieces; rows that repeat are packed each; equal lengths go by doc_id and start; an empty table gives an empty
result; other columns are not read and cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import bytehash
from ledgerlens.llm.bytehash import tidy
from ledgerlens.llm.frames import materialise_lean, whole_text

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 5_000
SEED = 77
#: Bytes of text handled at once, and what a text that could hold a special token has in it.
SLICE, SPECIAL = 3 << 18, b"<|"
#: Chunks a worker keeps per generation; see Recent.
CACHE = 60_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_ENCODERS: dict[str, Encoder] = {}
#: Texts of small letters that are single characters in every normal form of composition.
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
#: Kinds of bytes: white space 0, sentence marks, ASCII letters and digits, anything else.
MARK, WORD_END = 2, 3
KINDS = np.ones(256, dtype=np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[list(b".,;:!?")] = MARK
KINDS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = WORD_END


class Recent:
    """A table of computed values with a bound: when the new generation is full it becomes the old one, and the one before it
    goes. Values still asked for move on. What has gone is computed again, so the bound costs time only."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> set:
        """The keys without a value; all others can be read from `new` after this."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        absent = keys - self.new.keys()
        again = absent & self.old.keys()
        self.new.update((k, self.old[k]) for k in again)
        return absent - again


class Encoder:
    """Ids of whole texts by a tokenizer that never joins characters across white space.

    A text is then the sequence of its chunks, and a chunk's ids can be kept. ASCII letters are lowered first, as
    the tokenizer does itself; a text that could hold one of its special tokens goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        # a task has one core, and each thread of the tokenizer's own would keep memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = letter_table(self.tokenizer)
        self.recent = Recent(CACHE)

    def plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, each row followed by `end`, and where the rows begin in it.

        A batch has each distinct chunk looked up once; the ids are gathered by places, not text by text.
        """
        words, counts = chunks(bytehash.lower(data), offsets)
        coded = words.dictionary_encode()
        distinct, code = listed(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
        found = self._ids(distinct)
        special = rows_with(data, offsets, SPECIAL)
        for r in special:  # such a text is one chunk, and its ids are those of the whole text
            found += self.plain([data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")])
        found.append(b"" if end is None else np.array([end], dtype="<u4").tobytes())
        if len(special):
            row = np.repeat(np.arange(len(counts)), counts)
            whole = np.zeros(len(counts), dtype=bool)
            whole[special] = True
            firsts = np.cumsum(counts) - counts
            code = np.insert(np.where(whole[row], -1, code), firsts[special], len(distinct) + np.arange(len(special)))
            inserted = counts + whole
            kept = code >= 0
            counts = np.bincount(np.repeat(np.arange(len(counts)), inserted)[kept], minlength=len(counts))
            code = code[kept]
        code = np.insert(code, np.cumsum(counts), len(found) - 1)
        size = np.array([len(f) >> 2 for f in found], dtype=np.int64)
        flat, begin = np.frombuffer(bytearray().join(found), dtype="<u4") if size.any() else np.zeros(0, dtype="<u4"), np.cumsum(size) - size
        each = size[code]
        upto = np.cumsum(each)
        places = np.repeat(begin[code] - (upto - each), each)
        places += np.arange(len(places))
        rows = np.concatenate([[0], upto[np.cumsum(counts + 1) - 1]]) if len(counts) else np.zeros(1, dtype=np.int64)
        return flat[places], rows

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        found = list(map(self.recent.new.get, distinct))
        absent = [i for i, f in enumerate(found) if f is None]
        if absent:
            missing = self.recent.missing({distinct[i] for i in absent})
            if missing:
                self._learn(list(missing))
            for i in absent:
                found[i] = self.recent.new[distinct[i]]
        return found

    def _learn(self, chunks: list[bytes]) -> None:
        """Chunks of nothing but small letters need no normalising and no splitting, so the model gets them at once."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        if self.letters is None:
            self.recent.new.update(zip(chunks, self.plain(texts)))
            return
        kept, rest, model = self.recent.new, [], self.tokenizer.model.tokenize
        for c, t in zip(chunks, texts):
            if LETTERS(t):
                kept[c] = array("I", [token.id for token in model(t.translate(self.letters))]).tobytes()
            else:
                rest.append((c, t))
        kept.update(zip([c for c, _ in rest], self.plain([t for _, t in rest])))


def letter_table(tokenizer) -> dict | None:
    """How a byte-level tokenizer writes the small letters of `LETTERS` for its model; None for one that is built otherwise."""
    from tokenizers.pre_tokenizers import ByteLevel

    parts = json.loads(tokenizer.to_str())
    norms, splits = ((parts[k] or {}).get(inner, []) for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    whole = any("[\\p{L}]+" in s.get("pattern", {}).get("Regex", "") for s in splits if s["type"] == "Split")
    if [n["type"] for n in norms] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or not whole or splits[1]["add_prefix_space"]:
        return None
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    return {code: level.pre_tokenize_str(chr(code))[0][0] for code in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))}


def chunks(low: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All white-space chunks of the rows in their order, and how many each row has. Sentence marks at the end of a chunk, after an
    ASCII letter or digit, are a chunk of their own, as they are tokens of their own."""
    kind = KINDS[low]
    solid = kind != 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(low))]
    first[inner] = solid[inner]  # a chunk ends with its row
    ends = solid.copy()
    ends[:-1] &= first[1:] | ~solid[1:]
    at, begin = np.flatnonzero(ends), np.flatnonzero(first)
    open_ = kind[at] == MARK
    at, begin = at[open_], begin[open_]
    while len(at):  # step back over the marks at the ends of chunks
        at = at - 1
        inside = at >= begin
        at, begin = at[inside], begin[inside]
        before = kind[at]
        first[at[before == WORD_END] + 1] = True
        at, begin = at[before == MARK], begin[before == MARK]
    start = np.flatnonzero(first)
    kept = np.cumsum(solid, dtype=np.int64)
    places = np.append(kept[start] - 1, kept[-1] if len(kept) else 0)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(low[solid])])
    return words, np.diff(np.searchsorted(start, offsets))


def listed(words: pa.LargeBinaryArray) -> list[bytes]:
    """The values, cut out of the buffer in one go."""
    places = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    whole = words.buffers()[2].to_pybytes() if words.buffers()[2] is not None else b""
    return [whole[a:b] for a, b in zip(places, places[1:])]


def rows_with(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> np.ndarray:
    """Rows that hold a string of two bytes."""
    at = np.flatnonzero((data[:-1] == mark[0]) & (data[1:] == mark[1]))
    row = np.searchsorted(offsets, at, side="right") - 1
    return np.unique(row[at + 1 < offsets[row + 1]])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def batches_of(texts: list[bytes], most: int = 4 << 20):
    """Runs of rows with at most `most` bytes, or one longer row."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE, kept: int = CACHE
) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens`. Smaller `slice_bytes` and fewer `kept` chunks take less
    memory of a worker and more of its time; the rows are the same."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        encode.recent = Recent(kept)
        for batch in batches:
            data, offsets = bytehash.column_bytes(batch.column(1))
            for first, last in bytehash.slices(offsets, slice_bytes):
                ids, begin = encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], end_id)
                n = np.diff(begin)
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), many)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                length = np.minimum(capacity, n[row] - start)
                at, whole = 4 * (begin[row] + start), memoryview(ids).cast("B")
                sums = [zlib.crc32(whole[a : a + 4 * b]) for a, b in zip(at.tolist(), length.tolist())]
                docs_ = batch.column(0).slice(first, last - first).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([docs_, pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(n[row])], names=names)
        encode.recent = Recent(kept)  # the worker's next task may be of another kind
        tidy()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t")).mapInArrow(cut, PIECE)


class Room:
    """A tournament tree over the free room of sequences; those not opened yet are whole. Finds the first with enough room."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def take(self, length: int) -> tuple[int, int]:
        """The first sequence with room for `length`, and its room before; the room is taken."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < length:
                at += 1
        room = tree[at]
        tree[at] = room - length
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
        return leaf, room


def first_fit_decreasing(lengths, capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; `lengths` must fall."""
    room = Room(len(lengths), capacity)
    placed = [room.take(int(n)) for n in lengths]
    return [s for s, _ in placed], [capacity - before for _, before in placed]


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """Adds `sequence_id` and `offset` to a table of pieces (their columns `doc_id, start, length` are needed)."""
    written = materialise_lean(cut.withColumn("at", F.monotonically_increasing_id()))
    groups = max(1, -(-written.count() // group_pieces))
    grouped = written.withColumn("box", F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(groups)))
    fields = [f for f in written.schema.fields if f.name != "at"]

    order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("at", "ascending")]

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        sequence, offset = first_fit_decreasing(part["length"].to_numpy(), capacity)
        box = np.int64(part["box"][0].as_py()) << 32
        part = part.select([f.name for f in fields])
        return part.append_column("sequence_id", pa.array(box + np.array(sequence, dtype="int64"))).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return grouped.groupBy("box").applyInArrow(fill, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, slice_bytes: int = SLICE, kept: int = CACHE
) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`."""
    return pack(pieces(docs, tokenizer, capacity, end_id, slice_bytes=slice_bytes, kept=kept), capacity, group_pieces)
