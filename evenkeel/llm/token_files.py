"""Token ids as Arrow stream files of equal-length sequences with masks, read in place."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.llm.pretokens import TextEncoder, chunks
from evenkeel.llm.shared import shared_folder

LENGTH = 2048
#: Sequences of one batch of a file, and about the bytes of text of one file.
BATCH, FILE_BYTES = 256, 64 << 20
END = 0
#: Ends a file whose batches can be read by number.
MAGIC = b"EKBATCH1"


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class LibraryEncoder(TextEncoder):
    """The library's ids of whole texts, from the ids of their distinct pieces.

    Texts are first cut at the tokenizer's added tokens, as the library does it. Where these strip blanks, want whole
    words or are matched in normalised text, the texts that hold one go to the library whole.
    """

    def __init__(self, path: str):
        self.library = tokenizer = _tokenizer(path)
        super().__init__(lambda pieces: [e.ids for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)])
        added = tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        longest = sorted(self.added, key=len, reverse=True)
        self.find = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.find is None or not any(map(self.find.search, texts)):
            return super().encode(texts)
        parts = [self.find.split(t) for t in texts]  # text, token, text, ..., text
        if not self.plain:
            whole = {i: self.library.encode(texts[i], add_special_tokens=False).ids for i, p in enumerate(parts) if len(p) > 1}
            flat, before = super().encode(["" if i in whole else t for i, t in enumerate(texts)])
            every = [np.array(whole[i], np.uint32) if i in whole else flat[before[i] : before[i + 1]] for i in range(len(texts))]
            return np.concatenate(every), np.concatenate(([0], np.cumsum(list(map(len, every)), dtype=np.int64)))
        flat, before = super().encode([x for p in parts for x in p[::2]])
        n_texts = np.array([len(p) // 2 + 1 for p in parts])
        first = np.concatenate(([0], np.cumsum(n_texts)))  # the first part of each text
        inner = np.setdiff1d(np.arange(1, first[-1]), first)
        tokens = [self.added[x] for p in parts for x in p[1::2]]
        ids = np.insert(flat, before[inner], np.array(tokens, flat.dtype))
        return ids, before[first] + np.concatenate(([0], np.cumsum(n_texts - 1)))


def piece_encoder(path: str) -> TextEncoder:
    """Whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""
    return LibraryEncoder(path)


def file_schema(length: int, dtype: pa.DataType) -> pa.Schema:
    """One row a sequence: ids, which of them count, and the documents that end in it with the place of their last id."""
    ends = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())]))
    return pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", ends)])


class StreamWriter:
    """Packs documents, each followed by the end id, into sequences of one Arrow stream file.

    The file is written under a name of its own try and moved into place when complete, so a repeated or lost task
    leaves no half file. The last sequence is padded with masked ids. All batches but the last have ``BATCH`` sequences;
    behind the stream's end mark, where readers of streams do not look, lie the batches' offsets.
    """

    def __init__(self, path: str, length: int, dtype: np.dtype, attempt: int):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.draft = f"{self.path}.{attempt}.draft"
        self.length, self.dtype = length, dtype
        self.schema = file_schema(length, pa.from_numpy_dtype(dtype))
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.sink = self.fs.open_output_stream(self.draft)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.ends: list[tuple[int | None, int]] = []
        self.n_ids = self.n_rows = 0
        self.offsets: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts += [ids.astype(self.dtype), np.array([END], self.dtype)]
        self.held += len(ids) + 1
        self.n_ids += len(ids) + 1
        self.ends.append((doc_id, self.held - 1))
        if self.held >= BATCH * self.length:
            self._flush(self.held // self.length // BATCH * BATCH)

    def _flush(self, rows: int) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        size = rows * self.length
        ids, rest = flat[:size], flat[size:]
        mask = np.arange(size) < len(ids)
        ids = np.concatenate([ids, np.zeros(size - len(ids), self.dtype)])
        done = [e for e in self.ends if e[1] < size]
        places = np.array([e[1] for e in done], np.int64)
        for a in range(0, rows, BATCH):
            b = min(rows, a + BATCH)
            cut = np.searchsorted(places, np.arange(a, b + 1) * self.length)
            mine = done[cut[0] : cut[-1]]
            values = pa.StructArray.from_arrays(
                [pa.array([d for d, _ in mine], pa.int64()), pa.array(places[cut[0] : cut[-1]] % self.length, pa.int32())], ["doc_id", "at"]
            )
            span = slice(a * self.length, b * self.length)
            self.offsets.append(self.sink.tell())
            self.n_rows += b - a
            self.out.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(ids[span]), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[span]), self.length),
                pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), values),
            ], schema=self.schema))
        self.parts, self.held = [rest], len(rest)
        self.ends = [(d, at - size) for d, at in self.ends[len(done) :]]

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.length))
        self.out.close()
        self.sink.write(np.array([*self.offsets, self.n_rows, BATCH, len(self.offsets)], "<i8").tobytes() + MAGIC)
        self.sink.close()
        self.fs.move(self.draft, self.path)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    length = batch.schema.field(0).type.list_size
    ids = batch.column(0).flatten().to_numpy().reshape(-1, length)
    mask = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    return ids, mask, batch.column(2)


class StreamReader:
    """A file of :class:`StreamWriter` in place: ids are views of the mapped (or streamed) file; masks are stored as bits
    and unpacked."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.open = lambda: pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)
        self.reader = pa.ipc.open_stream(self.open())
        self.source: pa.NativeFile | None = None

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """Ids and masks (sequences by places) and the ends of each batch."""
        yield from map(_arrays, self.reader)

    def _index(self) -> None:
        """Offsets of the batches, from the end of the file."""
        self.source = self.open()
        tail = 24 + len(MAGIC)
        self.source.seek(self.source.size() - tail)
        data = self.source.read(tail)
        if data[24:] != MAGIC:
            raise ValueError("the file has no offsets of batches")
        self.n_rows, self.per_batch, n = np.frombuffer(data[:24], "<i8").tolist()
        self.source.seek(self.source.size() - tail - 8 * n)
        self.offsets = np.frombuffer(self.source.read(8 * n), "<i8").tolist()

    def __len__(self) -> int:
        """Sequences of the file."""
        if self.source is None:
            self._index()
        return self.n_rows

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``; only its batch is read."""
        if not 0 <= i < len(self):
            raise IndexError(f"sequence {i} of {self.n_rows}")
        k, row = divmod(i, self.per_batch)
        self.source.seek(self.offsets[k])
        message = pa.ipc.read_message(self.source)
        if message.type == "schema":  # lies before the first batch
            message = pa.ipc.read_message(self.source)
        ids, mask, _ = _arrays(pa.ipc.read_record_batch(message, self.reader.schema).slice(row, 1))
        return ids[0], mask[0]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document of the file with all its ids and the end id."""
        held: list[np.ndarray] = []
        for ids, mask, ends in self.batches():
            flat, row = ids.reshape(-1), 0
            sizes = np.diff(ends.offsets.to_numpy())
            rows = np.repeat(np.arange(len(ids)), sizes) * ids.shape[1]
            values = ends.flatten()
            places = rows + values.field("at").to_numpy()
            for doc, at in zip(values.field("doc_id").to_pylist(), places.tolist()):
                piece = flat[row : at + 1]
                yield doc, np.concatenate([*held, piece]) if held else piece
                held, row = [], at + 1
            rest = flat[row:][mask.reshape(-1)[row:]]
            if len(rest):
                held.append(rest.copy())


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, length: int = LENGTH) -> DataFrame:
    """Write ``docs`` in ascending doc_id order (nulls first, ties by text) to files below ``folder``.

    Returns the table of files: ``part``, ``path``, ``n_docs``, ``n_ids``, ordered by part as the documents are by id.
    Parts are ranges of doc_id; Spark's sample sets their number by the bytes of text. A document is never split over
    files. ``folder`` is a URI that all executors reach; ``tokenizer_path`` must lie on every machine.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        encoder = piece_encoder(tokenizer_path)
        dtype = np.dtype(np.uint16 if _tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else np.uint32)
        path, writer, n = f"{folder}/part-{part:06d}.arrow", None, 0
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in chunks(texts):
                writer = writer or StreamWriter(path, length, dtype, task.taskAttemptId())
                flat, before = encoder.encode(texts[a:b])
                for i in range(a, b):
                    writer.add(ids[i], flat[before[i - a] : before[i - a + 1]])
                n += b - a
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([x]) for x in (part, path, n, writer.n_ids)], ["part", "path", "n_docs", "n_ids"])

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long")
    files.write.parquet(f"{folder}/files")  # the documents are read and encoded once
    return docs.sparkSession.read.schema(files.schema).parquet(f"{folder}/files")


def read_token_files(files: DataFrame, each: Callable[[np.ndarray], dict], fields: str) -> DataFrame:
    """``doc_id, start, n_tokens`` and what ``each`` makes of the ids of every document, read from the files.

    ``start`` counts the ids of all documents before: one running sum over the table of files, one row a file.
    """
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("path", before.alias("before")).repartition(files.count() or 1, "path")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*[c.to_pylist() for c in batch.columns]):
                rows: list[tuple] = []
                for doc, ids in StreamReader(path).documents():
                    rows.append((doc, start, len(ids), *each(ids).values()))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in rows], schema=schema)
                        rows.clear()
                yield pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in rows], schema=schema)

    columns = ["doc_id", "start", "n_tokens", *names]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, pa.int64()) for c in columns[:3]] + [(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {fields}")


def ids_crc32(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def token_round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents as token files and return what the files say of each. An empty table writes no file."""
    folder = shared_folder(spark, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, folder), ids_crc32, "ids_crc32 long")
