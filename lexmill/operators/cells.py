"""Counts of word pairs over a parallel corpus, as sorted arrays of numbers instead of a row for each pair of words.

The source words are dealt to buckets by their hash. A bucket gets, for each chunk of sentence pairs, its source words and
the target words of their sentences once, so what is shuffled is the sentences times the buckets they touch and
not the pairs of words. The number of buckets follows the counted pairs of words, so a bucket's table stays small."""

from __future__ import annotations

import pickle
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.session import cut

#: Pairs of words (of one sentence pair each) a bucket, sentence pairs a chunk, and pairs of words that wait to be merged.
BUCKET, CHUNK, WAITING = 8_000_000, 5000, 2_000_000
BLOCK = "b int, kind int, chunk long, data binary"


def sentences(pairs: DataFrame, src: str, ref: str) -> DataFrame:
    """s, t, m: the tokens of each different pair with tokens on both sides, and how often it occurs; written."""
    own = pairs.groupBy(F.col(src).alias("a"), F.col(ref).alias("b")).agg(F.count("*").alias("m"))
    return cut(own.select(T.tokens(F.col("a")).alias("s"), T.tokens(F.col("b")).alias("t"), "m").filter((F.size("s") > 0) & (F.size("t") > 0)))


def _dump(*values) -> bytes:
    return zlib.compress(pickle.dumps(values, 5), 1)


def _load(data: bytes) -> tuple:
    return pickle.loads(zlib.decompress(data))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values, and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def _distinct(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different values of the chunk; row, place of the value and count of each different value of a row, in that order."""
    values, row = _lists(column)
    known, at = np.unique(values, return_inverse=True)
    key, n = np.unique(row * len(known) + at, return_counts=True)
    return known, key // len(known), key % len(known), n


def blocks(own: DataFrame, texts: bool) -> tuple[DataFrame, int]:
    """BLOCK rows dealt by bucket and sorted by it, and the number of buckets. With texts also the tokens of each chunk, kind 0."""
    of = own.agg(F.sum(F.size(F.array_distinct("s")).cast("long") * F.size(F.array_distinct("t")))).first()[0] or 0
    buckets = max(1 + of // BUCKET, min(own.sparkSession.sparkContext.defaultParallelism, 1 + of // 1_000_000))
    hashed = own.select(F.transform("s", lambda x: F.xxhash64(x)).alias("hs"), F.transform("t", lambda x: F.xxhash64(x)).alias("ht"), "m", F.spark_partition_id().alias("pid"), *(["s", "t"] if texts else []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                chunk = (batch.column("pid")[0].as_py() << 32) + made
                made += 1
                m = batch.column("m").to_numpy()
                sk, sp, si, sn = _distinct(batch.column("hs"))
                tk, tp, ti, tn = _distinct(batch.column("ht"))
                if texts:
                    kept = _dump(*[batch.column(c).to_pylist() for c in ("s", "t")], *[[np.array(x) for x in batch.column(c).to_pylist()] for c in ("hs", "ht")])
                    yield pa.RecordBatch.from_pydict({"b": pa.array([chunk % buckets], pa.int32()), "kind": pa.array([0], pa.int32()), "chunk": [chunk], "data": [kept]})
                to = (sk % buckets)[si]
                for b in range(buckets):
                    mine = np.nonzero(to == b)[0]
                    if not len(mine):
                        continue
                    here = np.zeros(len(m), bool)
                    here[sp[mine]] = True
                    theirs = np.nonzero(here[tp])[0]
                    ids, at = np.unique(si[mine], return_inverse=True)
                    others, place = np.unique(ti[theirs], return_inverse=True)
                    data = _dump(sk[ids], _small(at), _small(sp[mine]), _small(sn[mine]), tk[others], _small(place), _small(tp[theirs]), _small(tn[theirs]), _small(m))
                    yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "kind": pa.array([1], pa.int32()), "chunk": [chunk], "data": [data]})

    return hashed.mapInArrow(pack, BLOCK).repartition(int(buckets), "b").sortWithinPartitions("b"), buckets


class Table:
    """Counts of one bucket's pairs of words."""

    def __init__(self) -> None:
        self.s, self.t, self.n = {}, {}, {}
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting, self.size = [], 0

    def expand(self, data: bytes) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Key and count of each pair of words of the block's sentences, source word by source word, and the block."""
        block = _load(data)
        sk, at, sp, sn, tk, place, tp, tn, m = block
        sid = np.array([self.s.setdefault(x, len(self.s)) for x in sk.tolist()], np.int64)[at]
        tid = np.array([self.t.setdefault(x, len(self.t)) for x in tk.tolist()], np.int64)[place]
        size = np.bincount(tp, minlength=len(m))
        first = np.cumsum(size) - size
        long = size[sp]
        one = np.repeat(np.arange(len(sp)), long)
        other = np.arange(len(one)) - np.repeat(np.cumsum(long) - long, long) + np.repeat(first[sp], long)
        return (sid[one] << 32) | tid[other], (sn.astype(np.int64) * m[sp])[one] * tn[other], block

    def add(self, data: bytes) -> None:
        keys, counts, (sk, at, sp, sn, *_, m) = self.expand(data)
        for x, n in zip(sk.tolist(), np.bincount(at, sn.astype(np.float64) * m[sp], len(sk)).tolist(), strict=True):
            self.n[x] = self.n.get(x, 0) + int(n)
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > WAITING:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0] if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[new], np.add.reduceat(counts[order], new) if len(new) else counts
        self.waiting, self.size = [], 0


def greatest(own: DataFrame, least_n: int, least_c: int, share: float, enough: int) -> DataFrame:
    """s, n, c, t, same: hashes of source words that pass the thresholds, how often they occur, and their greatest count, with a row for each
    target word that has it."""

    def best(table: Table) -> pa.RecordBatch:
        table.merge()
        s = table.keys >> 32
        first = np.nonzero(np.r_[True, s[1:] != s[:-1]])[0] if len(s) else np.empty(0, np.int64)
        top = np.zeros(len(table.s), np.int64)
        if len(first):
            top[s[first]] = np.maximum.reduceat(table.counts, first)
        words, others = np.fromiter(table.s, np.int64, len(table.s)), np.fromiter(table.t, np.int64, len(table.t))
        n = np.array([table.n[x] for x in table.s], np.int64)
        good = (n >= least_n) & (top >= least_c) & ((top >= share * n) | (top >= enough))
        at = np.nonzero((table.counts == top[s]) & good[s])[0]
        of = s[at]
        return pa.RecordBatch.from_pydict({"s": words[of], "n": n[of], "c": top[of], "t": others[table.keys[at] & 0xFFFFFFFF]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now = Table(), None
        for batch in batches:
            for b, data in zip(batch.column("b").to_pylist(), batch.column("data"), strict=True):
                if b != now:
                    yield best(table)
                    table, now = Table(), b
                table.add(data.as_py())
        yield best(table)

    return blocks(own, False)[0].mapInArrow(run, "s long, n long, c long, t long")


def aligned(own: DataFrame) -> DataFrame:
    """s, t, c: see corpus.bigram_alignment()."""
    dealt, _ = blocks(own, True)

    def answers(table: Table, spool) -> Iterator[pa.RecordBatch]:
        """Each block again, now with the counts of its pairs of words over the whole corpus."""
        table.merge()
        spool.seek(0)
        while True:
            try:
                b, chunk, data = pickle.load(spool)
            except EOFError:
                return
            keys, _, (sk, at, sp, *_) = table.expand(data)
            counts = table.counts[np.searchsorted(table.keys, keys)]
            yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "kind": pa.array([1], pa.int32()), "chunk": [chunk], "data": [_dump(sk[at], sp, _small(counts))]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now, spool = Table(), None, tempfile.TemporaryFile()  # the bucket's blocks, read twice
        for batch in batches:
            for i, (b, kind) in enumerate(zip(batch.column("b").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if b != now:
                    yield from answers(table, spool)
                    spool.close()
                    table, now, spool = Table(), b, tempfile.TemporaryFile()
                if kind == 0:
                    yield batch.slice(i, 1)
                    continue
                data = batch.column("data")[i].as_py()
                table.add(data)
                pickle.dump((b, batch.column("chunk")[i].as_py(), data), spool)
        yield from answers(table, spool)
        spool.close()

    def align(texts: bytes, found: list[bytes]) -> pa.RecordBatch:
        s, t, hs, ht = _load(texts)
        places = [np.unique(x, return_inverse=True) for x in ht]
        rows = [{} for _ in s]
        for data in found:
            words, sp, counts = _load(data)
            at = 0
            for w, p in zip(words.tolist(), sp.tolist(), strict=True):
                n = len(places[p][0])
                rows[p][w] = counts[at : at + n]
                at += n
        total = {}
        for p, known in enumerate(rows):
            if len(s[p]) < 2 or len(t[p]) < 2:
                continue
            m = np.stack([known[w] for w in hs[p].tolist()]).astype(np.int64)[:, places[p][1].ravel()]
            for i, j in enumerate((m[:-1, :-1] + m[1:, 1:]).argmax(axis=1).tolist()):
                pair = f"{s[p][i]} {s[p][i + 1]}", f"{t[p][j]} {t[p][j + 1]}"
                total[pair] = total.get(pair, 0) + 1
        return pa.RecordBatch.from_pydict({"s": pa.array([k[0] for k in total], pa.string()), "t": pa.array([k[1] for k in total], pa.string()), "c": pa.array(list(total.values()), pa.int64())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, found = None, None, []
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                if chunk != now:
                    if now is not None:
                        yield align(texts, found)
                    now, texts, found = chunk, None, []
                data = batch.column("data")[i].as_py()
                if batch.column("kind")[i].as_py() == 0:
                    texts = data
                else:
                    found.append(data)
        if now is not None:
            yield align(texts, found)

    met = dealt.mapInArrow(count, BLOCK).repartition("chunk").sortWithinPartitions("chunk")
    return met.mapInArrow(gather, "s string, t string, c long").groupBy("s", "t").agg(F.sum("c").alias("c"))
