"""Token ids in length-delimited binary records, with a separate index of offsets for shuffled reads.

A record is: length of the payload (8 bytes), masked checksum of these 8 bytes (4), payload, masked checksum of the payload
(4). The payload is a flag (1: a doc_id follows, 0: it is null), doc_id (8), then the ids, 2 bytes each if the vocabulary
allows it and else 4. All numbers are little-endian. Checksums are CRC-32, rotated by 15 bits plus a constant, so that a
record that holds records doesn't pass for one. The index beside a file has, for each record, its offset (8) and the number
of ids before it in the file (8), and at the end both totals.

Documents are range-partitioned by doc_id, sorted, and each partition, of about ``FILE_BYTES`` of text, is one file. Every
attempt at a file has a name of its own, which the task hands back as its result: what Spark commits names the files that
count, so nothing is renamed, and a task that runs again, or twice at once, changes nothing. Readers get slices of the index
with about ``SLICE_BYTES`` of records, never whole files.

Ids are those that the library gives for the whole text, special tokens in it included. With a byte-level tokenizer a text is cut
before each blank or line feed that follows a character other than white space. Its own pattern never joins across such a
place, so the ids of a text are those of its pieces, and each distinct piece is encoded once in a task. A text that holds a
special token, and any text under another kind of tokenizer, is encoded whole.

Defined results
    null text: as an empty one, the end id alone. null doc_id: first in the order. Repeated rows: one record each. Rows that
    share a doc_id: ordered by a hash of the text, in several files if there are many. Empty table: no files, no rows. Other
    columns of the input, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from workloom.llm.runtime import materialize, returning_memory, scratch, small_batches

#: Bytes of text for a file, and of records that a reader takes at a time.
FILE_BYTES, SLICE_BYTES = 32 << 20, 4 << 20
#: Pieces whose ids a Python worker holds; beyond, those used least are forgotten.
CACHE = 1_000_000
#: Pieces that are encoded in one go.
TOGETHER = 20
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: White space, in the syntax of Arrow's expressions; a cut inside a run of it, but for the last place, divides what the
#: tokenizer takes together.
_SPACES = r"[\t-\r\x1c-\x20\x85\p{Z}]"
_ODD = rf"{_SPACES}[ \n](?:{_SPACES}|\z)|\x00"
#: One blank or line feed, then none.
_SIMPLE = rf"\A[ \n]{_SPACES.replace('[', '[^')}+\z"
#: Marks a piece that stands for itself.
_ALONE = "\0"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole record; ValueError if a checksum or the length doesn't fit."""
    if len(data) < 16 or struct.unpack_from("<I", data, 8)[0] != masked(data[:8]):
        raise ValueError("a record's length is damaged")
    (length,) = struct.unpack_from("<Q", data)
    payload = data[12 : 12 + length]
    if len(data) != length + 16 or struct.unpack_from("<I", data, 12 + length)[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


class _Pieces(dict):
    """Number of each distinct piece; pieces not seen before are noted.

    A key stands for a blank and the key, unless it begins with a line feed, which is its own, or with a mark, which is left out.
    """

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


def _text_of(key: str) -> str:
    return key[1:] if key[:1] == _ALONE else key if key[:1] == "\n" else " " + key


def _matching(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _keys(text: str) -> list[str]:
    """Keys of a text whose white space is not single."""
    keys = []
    for i, x in enumerate(_CUT.split(text)):
        plain = i and x[0] == " " and x[1:2] not in ("\n", _ALONE)
        keys.append(x[1:] if plain else x if i and x[0] == "\n" else _ALONE + x)
    return keys


class Encoder:
    """Ids of whole texts by a tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would hold memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        parts = json.loads(self.tokenizer.to_str())
        cut = parts["pre_tokenizer"] or {}
        self.by_piece = parts["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        added = [re.escape(x["content"]) for x in parts["added_tokens"]]
        self.special = "|".join(added)
        # of each id: whether its token begins with a blank or a line feed, as the vocabulary writes them
        self.begins = np.zeros(1 + max(self.tokenizer.get_vocab().values(), default=0), bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] in ("Ġ", "Ċ")]] = True
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.ids = _Pieces(), np.zeros(0, np.uint32)
        self.starts, self.lengths, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keeps the pieces used most, half as many as may be held."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: CACHE // 2])
        names, pieces = list(self.pieces), _Pieces()
        pieces.update({names[i]: j for j, i in enumerate(kept.tolist())})
        self.pieces, self.ids = pieces, self._gather(kept)
        self.lengths, self.used = self.lengths[kept], self.used[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these pieces, one after the other."""
        length = self.lengths[numbers]
        return self.ids[np.repeat(self.starts[numbers] - (np.cumsum(length) - length), length) + np.arange(length.sum())]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        new, self.pieces.new = [_text_of(x) for x in self.pieces.new], []
        starts, lengths, parts, held = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.ids], len(self.ids)
        # pieces with white space at their begin alone are encoded together: a token that begins with some begins a piece
        simple = _matching(pa.array(new, pa.large_string()), _SIMPLE)
        alone = [np.flatnonzero(~simple)]
        for some in np.array_split(np.flatnonzero(simple), simple.sum() // 10_000 + 1):
            texts = ["".join([new[i] for i in some[j : j + TOGETHER]]) for j in range(0, len(some), TOGETHER)]
            found = self._whole(texts)
            ids = np.concatenate([np.zeros(0, np.uint32), *found])
            begins = np.flatnonzero(self.begins[ids])
            of_text = np.searchsorted(begins, np.cumsum([len(x) for x in found]))
            if of_text.tolist() != [min(j + TOGETHER, len(some)) for j in range(0, len(some), TOGETHER)] or (len(some) and begins[0]):
                alone.append(some)
                continue
            starts[some], lengths[some] = held + begins, np.diff(np.append(begins, len(ids)))
            parts.append(ids)
            held += len(ids)
        for some in alone:
            for i, ids in zip(some, self._whole([new[i] for i in some]), strict=True):
                starts[i], lengths[i] = held, len(ids)
                parts.append(ids)
                held += len(ids)
        self.ids = np.concatenate(parts)
        self.starts, self.lengths = np.append(self.starts, starts), np.append(self.lengths, lengths)
        self.used = np.append(self.used, np.zeros(len(new), np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = np.ones(len(texts), bool)
        if self.by_piece:
            whole = _matching(texts, self.special) if self.special else ~whole
        if whole.any():
            at = np.flatnonzero(whole)
            by_text: list = [None] * len(texts)
            for i, ids in zip(at, self._whole(texts.take(pa.array(at)).to_pylist()), strict=True):
                by_text[i] = ids
            if len(rest := np.flatnonzero(~whole)):
                flat, counts = self._by_piece(texts.take(pa.array(rest)))
                for i, ids in zip(rest, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                    by_text[i] = ids
            return np.concatenate(by_text), np.array([len(x) for x in by_text], np.int64)
        return self._by_piece(texts)

    def _by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > CACHE:
            self._forget()
        odd = _matching(texts, _ODD)
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (_ALONE, texts, ""))), "\n", " \n"), " ")
        pieces, many = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)
        if odd.any():
            parts = [_keys(x) if o else None for x, o in zip(texts.to_pylist(), odd, strict=True)]
            ends = np.cumsum(many)
            flat = [pa.array(k, pa.large_string()) if k is not None else pieces[b - m : b] for k, b, m in zip(parts, ends.tolist(), many.tolist(), strict=True)]
            pieces = pa.concat_arrays([x.cast(pa.large_string()) for x in flat])
            many = np.array([len(x) for x in flat], np.int64)
        coded = pieces.dictionary_encode()
        numbers = np.fromiter(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))[np.asarray(coded.indices)]
        if self.pieces.new:
            self._learn()
        self.used += np.bincount(numbers, minlength=len(self.used))
        firsts = np.cumsum(many) - many
        return self._gather(numbers), np.add.reduceat(self.lengths[numbers], firsts)


#: By file: a Python worker keeps its encoder, and what that has learned, from task to task.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        out, index, slices, at, before = None, [], [0], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = _encoder(tokenizer)
            if out is None:
                files, root = pa.fs.FileSystem.from_uri(folder)
                out = files.open_output_stream(f"{root}/{name}.records")
            ids, counts = encoder.encode(batch.column("text"))
            ids = ids.astype("<u4" if encoder.wide else "<u2")
            end = np.array([end_id], ids.dtype).tobytes()
            ends = np.cumsum(counts)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                record = frame(struct.pack("<?q", doc_id is not None, doc_id or 0) + ids[a:b].tobytes() + end)
                out.write(record)
                if index and at - index[slices[-1]][0] >= SLICE_BYTES:
                    slices.append(len(index))
                index.append((at, before))
                at, before = at + len(record), before + b - a + 1
        if out is None:
            return
        out.close()
        with files.open_output_stream(f"{root}/{name}.index") as side:
            side.write(np.array([*index, (at, before)], "<u8").tobytes())
        row = {"file": [part], "name": [name], "records": [len(index)], "ids": [before], "width": [4 if encoder.wide else 2], "slices": [slices]}
        yield pa.RecordBatch.from_pydict(row)

    return write


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the files into a folder that all executors reach; returns one row for each: file (its place in the order), name,
    records, ids, width, slices (the records at which its slices begin), start (ids of all files before it)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(ceil(total / FILE_BYTES), spark.sparkContext.defaultParallelism)
    # rows alike in both may change places, so they can be parted at will
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_part": F.pmod(F.monotonically_increasing_id(), F.lit(64))})
    order = (F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_part"))
    ordered = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    store, root = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    kinds = "file long, name string, records long, ids long, width long, slices array<long>"
    written = materialize(ordered.mapInArrow(returning_memory(_writer(folder, tokenizer, end_id)), kinds))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return written.withColumn("start", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{root}/{row['name']}.index") as side:
                    index = np.frombuffer(side.read_at((row["count"] + 1) * 16, row["first"] * 16), "<u8").reshape(-1, 2).astype(np.int64)
                offsets, before = index[:, 0].tolist(), index[:-1, 1]
                with files.open_input_file(f"{root}/{row['name']}.records") as file:
                    data = memoryview(file.read_at(offsets[-1] - offsets[0], offsets[0]))
                doc_ids, counts, sums, whole = [], [], [], []
                for a, b in zip(offsets, offsets[1:], strict=False):
                    payload = unframe(data[a - offsets[0] : b - offsets[0]])
                    known, doc_id = struct.unpack_from("<?q", payload)
                    ids = np.frombuffer(payload, f"<u{row['width']}", offset=9).astype("<u4").tobytes()
                    doc_ids.append(doc_id if known else None)
                    counts.append(len(ids) // 4)
                    sums.append(zlib.crc32(ids))
                    whole.append(ids if row["whole"] else None)
                columns = [pa.array(doc_ids, pa.int64()), pa.array(before + row["start"]), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(whole, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return read


def read_records(spark: SparkSession, folder: str, written: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian, 4 bytes each) of each record."""
    after = F.coalesce(F.get("slices", F.col("_i") + 1), F.col("records"))
    slices = written.select("*", F.posexplode("slices").alias("_i", "first")).select(
        "name", "width", "start", "first", (after - F.col("first")).alias("count"), F.lit(whole).alias("whole")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = slices.repartition(parts, "name", "first").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return read if whole else read.drop("ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the records into the shared folder and returns what the files hold."""
    folder = scratch(docs.sparkSession)
    return read_records(docs.sparkSession, folder, write_records(docs, folder, tokenizer, end_id), whole=False)
