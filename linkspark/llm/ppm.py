"""Language-model scoring by prediction by partial matching, beside a unigram base score.

Texts are lower-cased (A-Z) words without ASCII white space, joined by one space, and an end symbol. The model is a trie
of byte contexts of up to CONTEXT symbols with counts from all training texts. A symbol not yet seen after a context costs
an escape (method C: different symbols over occurrences plus different symbols) to the context one shorter, in which the
symbols seen after the longer one are excluded; the last resort is uniform. Every byte value and the end has a symbol.

The trie is a table of paths (context and symbol) with counts, dealt into parts by the last three symbols of the context,
so a part has all longer contexts of its own; contexts of up to two symbols are bounded and broadcast. Texts are taken in
lots; each lot asks the parts for the costs of its different paths and is summed when they are back. Words go the same way.
Parts that are asked far more than others (frequent contexts) are summed up by each task first and then by part, and the
lots that ask are dealt over several tasks with a copy of that sum each.

Null texts are empty: only the end is scored. Without training texts all symbols are alike. Repeated rows score alike.
Empty tables give empty results. Only doc_id and text are read; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, shuffle_partitions, slices, store, text_blocks

CONTEXT, BITS = 5, 9
CLASSES, ORDER = 56, 3  # of the dense table, which the tests compare with
LOT, BLOCK = 8_000_000, 1_000_000  # bytes of text asked for at once, and worked on at once
HEAVY, TIMES = 64_000_000, 8  # a part asked in more packed bytes than this, and more than so many times the average, is split
PENDING = 4_000_000  # keys summed up at once
DOCS, PATHS, TOKENS = 0, 1, 2  # kinds of rows
END = 4611686018427387903  # stands for the end token among the hashes of words


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def paths(symbols: np.ndarray) -> np.ndarray:
    """Trie path (three symbols of context, then the symbol) that ends at each symbol from the fourth on."""
    out = symbols[:-ORDER].astype(np.int32)
    for k in range(1, ORDER + 1):
        out = out * CLASSES + symbols[k:len(symbols) - ORDER + k]
    return out


def below(counts: np.ndarray, shorter: np.ndarray, escaped: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For contexts with counts by symbol (last axis): probabilities, and those after an escape from them.

    shorter: counts after the context one shorter; escaped: probabilities after an escape from that one."""
    seen = counts > 0
    n, d = counts.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
    if escaped is None:  # the empty context; past it all unseen symbols are alike
        rest = np.broadcast_to(1.0 / np.maximum(1, CLASSES - d), counts.shape)
    else:
        more = shorter > 0
        n_left = shorter.sum(-1, keepdims=True) - np.where(seen, shorter, 0).sum(-1, keepdims=True)
        d_left = np.where(more.all(-1, keepdims=True), 0, (more & ~seen).sum(-1, keepdims=True))
        total = n_left + d_left
        full = np.maximum(total, 1)
        rest = np.where(more, shorter / full, np.where(total > 0, d_left / full, 1.0) * escaped)
    d = np.where(seen.all(-1, keepdims=True), 0, d)
    all_ = np.maximum(n + d, 1)
    return np.where(seen, counts / all_, np.where(n > 0, d / all_, 1.0) * rest), rest


def compiled(at: np.ndarray, n: np.ndarray, rare_bytes: int) -> np.ndarray:
    """log10 probability of every path of a small alphabet in one dense table, from the paths that occur and their counts."""
    dense = np.zeros(CLASSES ** (ORDER + 1), np.float32)
    dense[at] = n
    dense = dense.reshape(CLASSES, CLASSES, CLASSES, CLASSES)
    two = dense.sum(0, dtype=np.float64)
    one = two.sum(0)
    zero = one.sum(0)
    _, u0 = below(zero, zero, None)
    _, u1 = below(one, np.broadcast_to(zero, one.shape), np.broadcast_to(u0, one.shape))
    _, u2 = below(two, np.broadcast_to(one, two.shape), np.broadcast_to(u1, two.shape))
    for a in range(CLASSES):  # one slice at a time, in place
        p, _ = below(dense[a].astype(np.float64), two, u2)
        dense[a] = np.log10(np.maximum(p, 1e-30))
    dense[..., CLASSES - 1] -= np.log10(max(1, rare_bytes))
    return dense.ravel()


def low(k: int) -> int:
    """Mask of the last k symbols of a path."""
    return (1 << BITS * k) - 1


def lot_paths(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Paths (CONTEXT symbols, then the symbol) of the texts of words in turn, and how many each text has."""
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    pad = b"\0" * CONTEXT
    symbols = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + CONTEXT)
    symbols[ends - 1] = 0
    real = np.ones(len(symbols), bool)
    for k in range(CONTEXT):
        symbols[ends - sizes - 1 - k] = 0
        real[ends - sizes - 1 - k] = False
    out = np.zeros(max(0, len(symbols) - CONTEXT), np.int64)
    for k in range(CONTEXT + 1):
        out <<= BITS
        out |= symbols[k:len(symbols) - CONTEXT + k]
    return out[real[CONTEXT:]], sizes


def lot_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different token hashes (sorted), the place among them of each token of the texts in turn, tokens of each text."""
    index: dict = {None: 0}
    ids: list[int] = []
    sizes = []
    for t in texts:
        said = t.split()
        ids += [index.setdefault(w, len(index)) for w in said]
        ids.append(0)
        sizes.append(len(said) + 1)
    hashes = np.array([END, *(xxhash.xxh64_intdigest(w) for w in list(index)[1:])], np.uint64).view(np.int64)
    different, place = np.unique(hashes, return_inverse=True)
    return different, place[np.array(ids, np.int64)], np.array(sizes, np.int64)


def packed(a: np.ndarray) -> bytes:
    return a.nbytes.to_bytes(8, "little") + pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd"), dtype)


def part_of(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    if kind == PATHS:
        keys = keys >> BITS & low(3)
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def costs(asked: np.ndarray, paths: np.ndarray, n: np.ndarray, short: np.ndarray, short_n: np.ndarray) -> np.ndarray:
    """log10 probability of the paths asked. paths and n: different paths and counts, all those that share three last
    symbols of context with a path asked; short and short_n: those of the paths of two symbols of context, of the whole corpus."""
    out, open_ = np.zeros(len(asked)), np.ones(len(asked), bool)
    left_n, left_d = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)  # excluded occurrences and symbols
    tables = [summed(short & low(k + 1), short_n) if k < 3 else summed(paths & low(k + 1), n) for k in range(CONTEXT + 1)]
    for k in range(CONTEXT, -1, -1):
        table, count = tables[k]
        if not len(table):
            continue
        contexts, first = np.unique(table >> BITS, return_index=True)
        total, different = np.add.reduceat(count, first), np.diff(np.append(first, len(table)))
        shorter = np.add.reduceat(tables[k - 1][1][np.searchsorted(tables[k - 1][0], table & low(k))], first) if k else total
        want = asked & low(k + 1)
        c, known = found(contexts, want >> BITS)
        at, seen = found(table, want)
        d = different[c] - left_d
        use = open_ & known & (d > 0)
        all_ = total[c] - left_n + np.where(different[c] > 256, 0, d)
        out += np.where(use, np.log10(np.where(use, np.where(seen, count[at], d), 1) / np.where(use, all_, 1)), 0)
        open_ &= ~seen
        left_n, left_d = np.where(known, shorter[c], 0), np.where(known, different[c], 0)
    return out - np.where(open_, np.log10(np.maximum(1, 257 - left_d)), 0)


ROW = "owner bigint, kind int, part int, a binary, b binary"
NAMES = ["owner", "kind", "part", "a", "b"]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = [*NAMES, "n", "v"][:len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)], names=names)


def asked(docs: DataFrame, parts: int) -> DataFrame:
    """Of each lot of docs (doc_id, held_out, text): the lot, and by part its different paths and tokens with their training counts."""
    def run(batches):
        owner = TaskContext.get().partitionId() << 32
        for big in batches:
            for b in slices(big, "text", LOT):
                texts = [b" ".join(words(t)) for t in b.column(2).cast(pa.binary()).to_pylist()]
                sink = pa.BufferOutputStream()
                lot = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.large_binary())], names=["doc_id", "held_out", "text"])
                with pa.ipc.new_stream(sink, lot.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(lot)
                yield batch([(owner, DOCS, -1, sink.getvalue().to_pybytes(), None)])
                train = ~b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                got = []
                for x, y in text_blocks(texts, BLOCK):
                    path, sizes = lot_paths(texts[x:y])
                    of_train = np.repeat(train[x:y], sizes)
                    got.append(np.unique(path[of_train], return_counts=True))
                    no = np.unique(path[~of_train])
                    got.append((no, np.zeros(len(no), np.int64)))
                keys, count = summed(*(np.concatenate(q) for q in zip(*got, strict=True)))
                count = count.astype(np.int32)
                token, place, sizes = lot_tokens(texts)
                t_count = np.bincount(place[np.repeat(train, sizes)], minlength=len(token)).astype(np.int32)
                for kind, k, c in ((PATHS, keys, count), (TOKENS, token, t_count)):
                    p = part_of(k, kind, parts)
                    order = np.argsort(p, kind="stable")
                    cuts = np.searchsorted(p[order], np.arange(parts + 1)).tolist()
                    k, c = k[order], c[order]
                    yield batch([(owner, kind, i, packed(np.diff(k[x:y], prepend=0)), packed(c[x:y])) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x])
                owner += 1

    return docs.mapInArrow(run, ROW)


def groups(batches, columns: tuple[int, ...]):
    """Runs of rows (tuples) that agree in the columns, of sorted batches."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and any(held[-1][k] != row[k] for k in columns):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def keys_of(row: tuple) -> np.ndarray:
    return np.cumsum(unpacked(row[3], np.int64))


class Sums:
    """Different keys and the sums of their counts, of packed rows that come one by one."""

    def __init__(self, counts=np.int32):
        self.keys, self.n, self.pending, self.size, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, counts

    def add(self, row: tuple) -> None:
        self.pending.append((keys_of(row), unpacked(row[4], self.counts).astype(np.int64)))
        self.size += len(self.pending[-1][0])
        if self.size > PENDING:
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if self.pending:
            keys, n = zip(*self.pending, strict=True)
            self.keys, self.n = summed(np.concatenate([self.keys, *keys]), np.concatenate([self.n, *n]))
            self.pending, self.size = [], 0
        return self.keys, self.n


def shortest(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Paths of two symbols of context and their counts: 257 ** 3 at most, whatever the input."""
    def run(batches):
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for k, c in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                k, c = summed(np.cumsum(unpacked(k, np.int64)) & low(3), unpacked(c, np.int32).astype(np.int64))
                key, n = summed(np.concatenate([key, k]), np.concatenate([n, c]))
        yield pa.RecordBatch.from_arrays([pa.array(key[n > 0]), pa.array(n[n > 0])], names=["path", "n"])

    got = rows.where(F.col("kind") == PATHS).mapInArrow(run, "path bigint, n bigint").groupBy("path").agg(F.sum("n").alias("n")).toPandas().sort_values("path")
    return got["path"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


MODEL = "owner bigint, kind int, part int, a binary, b binary, n bigint, v bigint"


def told_by(kind: int, every: np.ndarray, n: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What a part says of each of its keys: the cost of a path, the training count of a token."""
    return costs(every, every[n > 0], n[n > 0], *short).astype(np.float32) if kind == PATHS else n


def totals_of(kind: int, n: np.ndarray) -> tuple[int, int]:
    return (int(n.sum()), int((n > 0).sum())) if kind == TOKENS else (0, 0)


def heavy_parts(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """(kind, part, tasks to deal it over) of the parts that are asked far more than others: fewer than 2 parts / TIMES."""
    size = rows.groupBy("kind", "part").agg(F.sum(F.octet_length("a") + F.octet_length("b")).alias("size"))
    average = F.sum("size").over(Window.partitionBy("kind")) / parts  # a row per part
    most = size.withColumn("most", F.greatest(F.lit(HEAVY), average * TIMES)).where("size > most")
    return [(r["kind"], r["part"], -(-r["size"] // int(r["most"]))) for r in most.collect()]


def heavy_sums(rows: DataFrame) -> DataFrame:
    """One row of all keys and sums of each part of rows, summed by task before they are shuffled."""
    def partial(batches):
        held: dict[tuple[int, int], Sums] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(row[1:3], Sums()).add(row)
        for (kind, part), of in held.items():
            keys, n = of.done()
            yield batch([(0, kind, part, packed(np.diff(keys, prepend=0)), packed(n))])

    def whole(batches):
        now, of = None, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[1:3] != now:
                    if now:
                        yield model(now, of)
                    now, of = row[1:3], Sums(np.int64)
                of.add(row)
        if now:
            yield model(now, of)

    def model(now, of):
        keys, n = of.done()
        return batch([(-1, *now, packed(np.diff(keys, prepend=0)), packed(n), *totals_of(now[0], n))])

    dealt = rows.mapInArrow(partial, ROW).repartition(shuffle_partitions(rows.sparkSession), "kind", "part").sortWithinPartitions("kind", "part")
    return store(dealt.mapInArrow(whole, MODEL), "ppm-heavy")


def answered(rows: DataFrame, parts: int) -> tuple[DataFrame, int, int]:
    """For each row of keys the costs of paths (float) or training counts of tokens (long); training tokens and different ones."""
    spark = rows.sparkSession
    n_tasks = shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(shortest(rows))
    rows = rows.where(F.col("kind") != DOCS)

    def reply(row: tuple, every: np.ndarray, said: np.ndarray, n: int = 0, v: int = 0) -> pa.RecordBatch:
        return batch([(*row[:3], packed(said[np.searchsorted(every, keys_of(row))]), None, n, v)])

    def light(batches):
        for held in groups(batches, (1, 2)):
            of, kind = Sums(), held[0][1]
            for row in held:
                of.add(row)
            every, n = of.done()
            said = told_by(kind, every, n, shared.value)
            for i, row in enumerate(held):
                yield reply(row, every, said, *((0, 0) if i else totals_of(kind, n)))

    def heavy(batches):
        every = said = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] == -1:  # the sum of the part, before those that ask
                    every, n = keys_of(row), unpacked(row[4], np.int64)
                    said = told_by(row[1], every, n, shared.value)
                else:
                    yield reply(row, every, said)

    out = ROW + ", n bigint, v bigint"
    if not (split := heavy_parts(rows, parts)):
        told = rows.repartition(n_tasks, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(light, out)
        told, sums = store(told, "ppm-answers"), None
    else:
        split = F.broadcast(spark.createDataFrame(split, "kind int, part int, tasks bigint"))
        sums = heavy_sums(rows.join(split, ["kind", "part"], "left_semi").select(*NAMES))
        few = rows.join(split, ["kind", "part"], "left_anti").select(*NAMES)
        asking = rows.join(split, ["kind", "part"]).select(*NAMES, F.pmod(F.xxhash64("owner"), F.col("tasks")).alias("task"))
        copies = sums.join(split, ["kind", "part"]).select(*NAMES, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("task"))
        dealt = asking.unionByName(copies).repartition(n_tasks, "kind", "part", "task").sortWithinPartitions("kind", "part", "task", "owner").select(*NAMES)
        told = few.repartition(n_tasks, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(light, out)
        told = store(told.unionByName(dealt.mapInArrow(heavy, out)), "ppm-answers")
    n = v = 0
    for df in (told, *([sums] if sums is not None else [])):
        more = df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        n, v = n + more[0], v + more[1]
    return told, n, v


def filled(rows: list[tuple], kind: int, keys: np.ndarray, parts: int, dtype) -> np.ndarray:
    """Answers in the order of keys."""
    p, out = part_of(keys, kind, parts), np.zeros(len(keys), dtype)
    order = np.argsort(p, kind="stable")
    out[order] = np.concatenate([unpacked(r[3], dtype) for r in sorted((r for r in rows if r[1] == kind), key=lambda r: r[2])])
    return out


def digest(docs: DataFrame) -> DataFrame:
    """The op8 contract."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", bucket_of("doc_id", 5, 1).alias("held_out"), "text")
    parts = 4 * shuffle_partitions(spark)
    lots = store(asked(rows, parts), "ppm-lots")
    told, n, v = answered(lots, parts)

    def run(batches):
        for held in groups(batches, (0,)):
            lot = pa.ipc.open_stream(next(r[3] for r in held if r[1] == DOCS)).read_next_batch()
            texts = lot.column(2).to_pylist()
            blocks = []
            for x, y in text_blocks(texts, BLOCK):
                path, sizes = lot_paths(texts[x:y])
                different, place = np.unique(path, return_inverse=True)
                blocks.append((different, place.astype(np.int32), np.cumsum(sizes) - sizes))
            keys = np.unique(np.concatenate([b[0] for b in blocks]))
            cost = filled(held, PATHS, keys, parts, np.float32)
            score = np.concatenate([np.add.reduceat(cost[np.searchsorted(keys, different)][place], first, dtype=np.float64) for different, place, first in blocks])
            token, place, sizes = lot_tokens(texts)
            c = filled(held, TOKENS, token, parts, np.int64)
            first = np.cumsum(sizes) - sizes
            known = np.add.reduceat((c > 0)[place], first, dtype=np.int64)
            base = np.add.reduceat(np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[place], first)
            yield pa.RecordBatch.from_arrays(
                [lot.column(0), lot.column(1), pa.array(sizes), pa.array(known), pa.array(np.full(len(texts), n, np.int64)), pa.array(np.round(base, 6)), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = lots.where(F.col("kind") == DOCS).unionByName(told.select(*NAMES)).repartition(shuffle_partitions(spark), "owner").sortWithinPartitions("owner", "kind", "part")
    return both.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
