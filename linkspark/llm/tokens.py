"""Token ids in Arrow IPC files of fixed-size-list batches.

Each file holds a run of the global id stream: rows of `input_ids` and `mask`, both fixed-size lists of LENGTH, in
record batches of ROWS rows; the last row is padded with id 0 and mask 0. Its ids are 16-bit where the vocabulary fits.
The schema metadata has the file's number of ids; an index file beside it (same format) has one row per document: doc_id,
first (id offset in the file) and n_tokens. Buffers are not compressed, so a memory map gives any row without a copy.

Null and empty texts have the end id alone. Order: doc_id (null first), then a hash of the text; repeated rows follow
each other. Empty tables give no files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, slices, store

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
LENGTH, ROWS, END = 2048, 64, 0
CACHE = 1_000_000  # chunks whose ids a worker remembers
KEPT = 64  # bytes of a chunk that is remembered at most
BLOCK = 4_000_000  # bytes of text encoded at once
LINES = 1000  # chunks that the library takes as one text, a chunk a line
GRAPH = re.compile("[!-~¡-ᙿ]+")  # characters that are no white space, and what stands in a line of its own

# Kinds of bytes. Between two ASCII bytes of kinds in APART a piece of the byte-level vocabulary always ends.
OTHER, LETTER, DIGIT, SIGN, QUOTE = range(5)
KIND = np.zeros(256, np.uint8)
KIND[33:127] = SIGN
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[ord("'")] = QUOTE  # may start a piece such as 's
APART = np.zeros((5, 5), bool)
APART[LETTER, [DIGIT, SIGN, QUOTE]] = APART[DIGIT, [LETTER, SIGN, QUOTE]] = APART[SIGN, [LETTER, DIGIT]] = True
BLANK, LINE = 32, 10


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def visible(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character from ! to ~ or from U+00A1 to U+167F starts at each of the places (none of them is white space)."""
    padded = np.append(data, np.zeros(2, np.uint8))
    one, two = padded[at], padded[at + 1]
    return (one > 32) & (one < 127) | (one > 0xC2) & (one <= 0xE0) | (one == 0xC2) & (two >= 0xA1) | (one == 0xE1) & (two < 0x9A)


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where a piece of the byte-level vocabulary starts for certain, in texts that follow each other in data.

    A space before a visible character starts a piece; a line break between visible characters is one; letters, digits
    and other signs of ASCII are never in one piece, but for a quote before letters."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = KIND[data]
    inner = np.flatnonzero(APART[kind[:-1], kind[1:]]) + 1
    blank = np.flatnonzero(data[:-1] == BLANK)
    blank = blank[visible(data, blank + 1)]
    line = np.flatnonzero(data[:-1] == LINE)
    line = line[(line > 0) & visible(data, line + 1)]
    before = visible(data, line - 1)  # one byte long; else look for the start of a longer character
    for k in (2, 3):
        far = np.maximum(line - k, 0)
        before |= (line >= k) & (data[line - 1] >= 0x80) & (data[far] >= (0xC2, 0xE0)[k - 2]) & (data[far] < (0xE0, 0xF0)[k - 2]) & visible(data, far)
    line = line[before & ~np.isin(line, starts) & ~np.isin(line + 1, starts)]
    mark = np.zeros(len(data) + 1, bool)
    for at in (inner, blank, line, line + 1, starts):
        mark[at] = True
    return np.flatnonzero(mark[:-1])


class Encoder:
    """Ids of whole texts. A byte-level vocabulary splits a text into pieces before it merges bytes, so the ids of a text
    are those of its chunks in turn when chunks end where pieces end. Chunks are cut and numbered for many texts at
    once, the library encodes each different chunk once (many in one text with a chunk a line, as a line break between
    visible characters, or before a space and one, is a piece of its own), and a worker remembers up to `cache` short
    ones; when they are too many, the half used most often stays. Strings of special tokens in a text are taken for the
    tokens, as the library does. Tokenizers of other kinds encode each text whole."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        told = json.loads(self.tokenizer.to_str())
        cut, added = told["pre_tokenizer"] or {}, told["added_tokens"]
        self.special = [x["content"] for x in added]
        bare = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or not GRAPH.fullmatch(x["content"]) for x in added)
        self.any_special = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self.special, key=len, reverse=True)))
        line = self.encode(["\n"])[0]
        self.line = line[0] if len(line) else 0
        self.by_chunk = bool(bare and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not told["normalizer"] and len(line) == 1)
        self.forget()

    def forget(self, at: np.ndarray | None = None) -> None:
        """Drop all chunks, or all but those at the places."""
        if at is None:
            self.known: dict[bytes, int] = {}
            self.first = self.size = self.used = np.zeros(0, np.int64)
            self.pool, self.held = np.zeros(0, self.dtype), 0
            return
        names = list(self.known)
        at = at[[len(names[k]) <= KEPT for k in at.tolist()]]
        self.known = {names[k]: i for i, k in enumerate(at.tolist())}
        self.pool = gathered(self.pool, self.first[at], self.size[at])
        self.size, self.used = self.size[at], self.used[at] // 2
        self.first, self.held = np.cumsum(self.size) - self.size, sum(map(len, self.known))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.encode(texts)]

    def of_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has."""
        said = [c.decode("utf-8", "replace") for c in chunks]
        plain = np.array([bool(GRAPH.fullmatch(c, c[:1] == " ")) and c not in self.special for c in said], bool)
        lines = [c for c, p in zip(said, plain.tolist(), strict=True) if p]
        sizes = np.zeros(len(said), np.int64)
        got = self.encode(["\n".join(lines[i:i + LINES]) for i in range(0, len(lines), LINES)])
        sizes[plain] = np.concatenate([np.diff(np.concatenate([[-1], np.flatnonzero(x == self.line), [len(x)]])) - 1 for x in got] or [sizes[:0]])
        rest = self.encode([c for c, p in zip(said, plain.tolist(), strict=True) if not p])
        sizes[~plain] = list(map(len, rest))
        data = np.concatenate([*(x[x != self.line] for x in got), *rest, np.zeros(0, self.dtype)])
        first, order = np.zeros(len(said), np.int64), np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return gathered(data, first, sizes), sizes

    def chunk_starts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        at = cuts(data, starts)
        raw = data.tobytes() if self.special else b""
        if not any(x.encode() in raw for x in self.special):
            return at
        mark = np.zeros(len(data), bool)
        mark[at] = True
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(data)]):
            kept = low
            for m in self.any_special.finditer(raw, low, high):
                mark[max(m.start() - 1, kept):m.end()] = False  # white space before a token joins what stands before it
                mark[[kept, m.start()]] = True
                mark[m.end():min(m.end() + 1, high)] = True
                kept = m.end()
        return np.flatnonzero(mark)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts one after another, each with END behind it, and how many each text has with it."""
        column = pc.fill_null(texts.cast(pa.large_binary()), b"")
        if not self.by_chunk:
            got = self.encode([t.decode("utf-8", "replace") for t in column.to_pylist()])
            end = np.array([END], self.dtype)
            return np.concatenate([x for g in got for x in (g, end)] or [end[:0]]), np.array([len(g) + 1 for g in got], np.int64)
        _, offsets, body = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(body, np.uint8)[bounds[0]:bounds[-1]] if body else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        full = np.flatnonzero(np.diff(bounds))
        at = self.chunk_starts(data, bounds[full])
        chunks = pa.BinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        place = self.places(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        n_chunks = np.zeros(len(column), np.int64)
        n_chunks[full] = np.diff(np.append(np.searchsorted(at, bounds[full]), len(at)))
        ends = np.cumsum(n_chunks + 1) - 1  # the end token is one more chunk of each text
        first, size = np.zeros(len(at) + len(column), np.int64), np.ones(len(at) + len(column), np.int64)
        own = np.ones(len(size), bool)
        own[ends] = False
        first[own], size[own] = self.first[place], self.size[place]
        first[ends] = len(self.pool)
        n = np.diff(np.concatenate([[0], np.cumsum(size)[ends]])) if len(ends) else np.zeros(0, np.int64)
        return gathered(np.append(self.pool, np.array([END], self.dtype)), first, size), n

    def places(self, chunks: list[bytes]) -> np.ndarray:
        """Where each of the different chunks is remembered, after learning those that are new."""
        if len(self.known) > self.cache or self.held > KEPT * self.cache:
            self.forget(np.argsort(-self.used, kind="stable")[:self.cache // 2])
        new = [c for c in chunks if c not in self.known]
        if new:
            data, sizes = self.of_chunks(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.first = np.append(self.first, len(self.pool) + np.cumsum(sizes) - sizes)
            self.pool, self.size = np.append(self.pool, data), np.append(self.size, sizes)
            self.used, self.held = np.append(self.used, np.zeros(len(new), np.int64)), self.held + sum(map(len, new))
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self.used[at] += 1
        return at

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without END."""
        ids, n = self.column(pa.array(texts, pa.large_string()))
        last = np.cumsum(n)
        return [ids[b - m:b - 1].tobytes() for b, m in zip(last.tolist(), n.tolist(), strict=True)]


def gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs data[first:first + size] one after another."""
    total = int(size.sum())
    return data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int) -> Encoder:
    if (path, cache) not in _encoders:
        _encoders.clear()
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """One file of the id stream and its index, written as ids come."""

    def __init__(self, folder: str, id_type: pa.DataType, dtype: np.dtype):
        self.uri = f"{folder}/{uuid.uuid4().hex}"  # a task that is run again writes another file; only reported ones count
        system, path = place(self.uri)
        self.item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("input_ids", pa.list_(self.item, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.index = pa.schema([("doc_id", id_type), ("first", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [system.open_output_stream(path + x) for x in (".arrow", ".index.arrow")]
        self.rows, self.docs = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], self.index)
        self.dtype, self.rest, self.total, self.n_docs = dtype, np.zeros(0, dtype), 0, 0

    def batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        self.rows.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), LENGTH), pa.FixedSizeListArray.from_arrays(pa.array(mask), LENGTH)], schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        """Documents of n ids each, END included."""
        first = self.total + np.cumsum(n) - n
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(first), pa.array(n)], schema=self.index))
        self.total, self.n_docs = self.total + len(ids), self.n_docs + len(n)
        data, step = np.concatenate([self.rest, ids]), LENGTH * ROWS
        cut = len(data) // step * step
        for i in range(0, cut, step):
            self.batch(data[i:i + step], step)
        self.rest = data[cut:].copy()

    def close(self) -> None:
        if n := len(self.rest):
            padded = np.zeros(-(-n // LENGTH) * LENGTH, self.dtype)
            padded[:n] = self.rest
            self.batch(padded, n)
        for w in (self.rows, self.docs, *self.sinks):
            w.close()


def write(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, text: str = "text", key: str = "doc_id", cache: int = CACHE) -> DataFrame:
    """Encode docs in ascending order of key and write the files. Returns the manifest, one row per file in stream
    order: file, n_docs, n_tokens, start (ids before it)."""
    spark = docs.sparkSession
    path, folder = tokenizer or default_tokenizer(), folder or new_path(spark, "token-files")
    if spark.sparkContext._jvm is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))

    def run(batches):
        from pyspark import TaskContext

        out = None
        for big in batches:
            for b in slices(big, "text", BLOCK):
                code = encoder(path, cache)
                out = out or Writer(folder, b.schema.field("doc_id").type, code.dtype)
                out.add(b.column(0), *code.column(b.column(1)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [out.uri], "n_docs": [out.n_docs], "n_tokens": [out.total]})

    ranged = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = store(ranged.mapInArrow(run, "part bigint, file string, n_docs bigint, n_tokens bigint"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.select("part", "file", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


class Reader:
    """Random access to a written file."""

    def __init__(self, uri: str):
        system, path = place(uri + ".arrow")
        local = isinstance(system, fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))
        self.batches: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (no copy) and mask of sequence i."""
        b = self.file.get_batch(i // ROWS)
        ids, mask = (b.column(k)[i % ROWS].values for k in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids of a document; only the batches that hold them are read."""
        step, parts = LENGTH * ROWS, []
        for k in range(first // step, (first + n - 1) // step + 1):
            if self.batches[0] != k:
                self.batches = (k, self.file.get_batch(k).column(0).flatten().to_numpy())
            parts.append(self.batches[1][max(0, first - k * step):first + n - k * step])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    files = manifest.select("file", "start").repartition(shuffle_partitions(manifest.sparkSession))

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, path = place(uri + ".index.arrow")
                reader = Reader(uri)
                with system.open_input_file(path) as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        first, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        crc = [zlib.crc32(reader.ids(a, m).astype("<u4").tobytes()) for a, m in zip(first.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(first + start), docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def digest(docs: DataFrame, tokenizer: str | None = None, cache: int = CACHE) -> DataFrame:
    """The op10 contract. A smaller cache takes less memory and more time."""
    return read(write(docs, tokenizer, cache=cache), docs.schema["doc_id"].dataType.simpleString())
