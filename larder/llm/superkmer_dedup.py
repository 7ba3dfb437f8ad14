"""Substring dedup by super-k-mer partitioning.

A window is k consecutive words of one document.  A window's minimiser is the least hash of its m-word grams; windows of
one text that follow each other and share it travel together, as one packed string of words (a super-k-mer), to the
minimiser's bucket.  There the windows themselves are sorted and compared word by word, so hashes only decide who meets.

1. One pass gives the minimisers of each document.  Those of one document only can't hold a repeated window; a bitmap of
   fixed size remembers the others (a false hit costs some transport and nothing else).
2. A second pass writes the super-k-mers of remembered minimisers to the shared folder: where each one starts, and the string
   itself once for all the documents of a batch, with the smallest and the largest of them, so copies cost a bucket little.
3. Each bucket sorts its windows; a string learns, for each window, the smallest document that has it.  A bucket of more
   than ``hot`` strings is dealt out again by the windows themselves and summed on the way.
4. Documents drop the words covered by windows that a smaller document has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, new_path, partitions, runs, slices, texts
from larder.llm.ngram_jaccard import mixed, worker_words

BITS = 1 << 26
HOT = 20_000
BROADCAST_ROWS = 200_000
SUPERKMER = "v long, s1 long, s2 long, packed binary, doc long, own long, at int"
NAMES = [x.split()[0] for x in SUPERKMER.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
P = np.uint64(0x9E3779B97F4A7C15)


def minimisers(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """For each k-word window of the hashes h, the least mixed hash of its m-word grams."""
    gram, have, p = h, 1, P
    while have < m:
        step = min(have, m - have)  # grams of have + step words from two that overlap
        q = np.uint64(pow(int(P), step, 1 << 64))
        gram = gram[: len(gram) - step] + gram[step:] * (p if step == have else q)
        have += step
        p = np.uint64(pow(int(P), have, 1 << 64))
    low, span, width = mixed(gram), 1, k - m + 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return low


def repeated_minimisers(docs: DataFrame, k: int, m: int) -> np.ndarray:
    """A bitmap of BITS bits: those of minimisers that two documents or more have."""

    def run(batches):
        words = worker_words()
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            ids, found = [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws = t.encode("utf-8", "surrogatepass").split()
                if i is not None and len(ws) >= k:
                    found.append(np.unique(minimisers(np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws)), k, m)).view(np.int64))
                    ids.append(np.full(len(found[-1]), i, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], ["doc", "v"])

    each = docs.mapInArrow(run, "doc long, v long")
    twice = each.groupBy("v").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    # The low bits of a least hash are as even as those of any.
    cells = twice.select(F.col("v").bitwiseAND(F.lit(BITS - 1)).alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(BITS >> 5, np.uint32)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def bucket(rows: dict[str, list], k: int) -> list[tuple[int, int, list[int]]]:
    """Of one minimiser's strings: for each that is in two documents, or has a window that a smaller one has, its windows' smallest documents."""
    strings: dict[tuple[int, int], list] = {}
    for s1, s2, packed, lo, hi in zip(*(rows[c] for c in ("s1", "s2", "packed", "lo", "hi")), strict=True):
        x = strings.setdefault((s1, s2), [packed, lo, hi])
        x[1], x[2] = min(x[1], lo), max(x[2], hi)
    windows = []
    for r, (packed, lo, _) in enumerate(strings.values()):
        ends = [-1]
        while (e := packed.find(b" ", ends[-1] + 1)) >= 0:
            ends.append(e)
        ends.append(len(packed))
        windows += [(packed[ends[j] + 1 : ends[j + k]], lo, r) for j in range(len(ends) - k)]
    order = sorted(windows)
    least: list[list[int]] = [[] for _ in strings]
    first: dict[bytes, int] = {}
    for w, lo, _ in order:
        first.setdefault(w, lo)
    for w, _, r in windows:
        least[r].append(first[w])
    return [(*sid, x) for (sid, (_, _, hi)), x in zip(strings.items(), least, strict=True) if min(x) < hi]


def remove_repeats(docs: DataFrame, k: int = 50, m: int = 8, hot: int = HOT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs(doc_id, text, ...); kept is the text of the words that stay, joined by one space.

    A word goes if a k-word window that covers it also starts in a document of a smaller doc_id; windows are judged on
    the input.  Null texts count as empty, texts of fewer than k words stay whole, a row of a null doc_id neither loses
    words nor takes any, rows that share a doc_id take none from each other.  Other columns are left behind.
    """
    spark = docs.sparkSession
    docs = texts(docs).withColumn("own", F.xxhash64("text"))  # tells rows of one doc_id apart
    bitmap = spark.sparkContext.broadcast(repeated_minimisers(docs, k, m))

    def cut_up(batches):
        words = worker_words()
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            places, strings = [], {}
            for i, own, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "own", "text")), strict=True):
                ws = t.encode("utf-8", "surrogatepass").split()
                if i is None or len(ws) < k:
                    continue
                low = minimisers(np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws)), k, m).view(np.int64)
                ends = np.append(np.flatnonzero(low[1:] != low[:-1]) + 1, len(low))
                starts = np.concatenate([[0], ends[:-1]])
                v = low[starts]
                bit = v & (BITS - 1)
                shared = np.flatnonzero(bitmap.value[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1))
                for at, end, own_v in zip(starts[shared].tolist(), ends[shared].tolist(), v[shared].tolist(), strict=True):
                    packed = b" ".join(ws[at : end + k - 1])
                    d = xxhash.xxh3_128_digest(packed)
                    sid = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                    places.append((i, own, at, *sid))
                    if sid in strings:
                        x = strings[sid]
                        x[4], x[5] = min(x[4], i), max(x[5], i)
                    else:
                        strings[sid] = [own_v, *sid, packed, i, i]
            if places:
                doc, own, at, s1, s2 = zip(*places, strict=True)
                none = [None] * len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((none, s1, s2, none, doc, own, at), KINDS, strict=True)], NAMES)
                v, s1, s2, packed, lo, hi = zip(*strings.values(), strict=True)
                none = [None] * len(v)
                # A string's smallest and largest document stand in doc and own.
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((v, s1, s2, packed, lo, hi, none), KINDS, strict=True)], NAMES)

    path = new_path(spark, "superkmers")
    docs.mapInArrow(cut_up, SUPERKMER).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(SUPERKMER).parquet(path)
    strings = stored.where("v is not null").select("v", "s1", "s2", "packed", F.col("doc").alias("lo"), F.col("own").alias("hi"))
    crowded = cut(strings.groupBy("v").count().where(F.col("count") > hot).select("v"))
    few = crowded.count()
    if few <= 1_000_000:
        crowded = F.broadcast(crowded)

    def sort_windows(batches):
        out = []
        for _, rows in runs(batches, "v"):
            if len(rows["packed"]) > 1 or rows["lo"][0] < rows["hi"][0]:
                out += bucket(rows, k)
            if len(out) > 2000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["s1", "s2", "least"])

    cold = (strings.join(crowded, "v", "left_anti") if few else strings).repartition(partitions(spark), "v").sortWithinPartitions("v")
    learned = cold.mapInArrow(sort_windows, "s1 long, s2 long, least array<long>")
    apart = strings.join(crowded, "v", "left_semi").withColumn("w", F.split(F.col("packed").cast("string"), " "))
    windows = apart.select("s1", "s2", "lo", "hi", F.posexplode(F.expr(f"transform(sequence(1, size(w) - {k - 1}), i -> array_join(slice(w, i, {k}), ' '))")).alias("j", "window"))
    least = windows.groupBy("window").agg(F.min("lo").alias("least"))
    dealt = windows.join(least, "window").groupBy("s1", "s2").agg(F.max("hi").alias("hi"), F.array_sort(F.collect_set(F.struct("j", "least"))).alias("all"))
    if few:
        learned = learned.union(dealt.select("s1", "s2", F.col("all.least").alias("least")))

    def cover(batches):
        for batch in (s for b in batches for s in slices(b, 8 << 20)):
            out = []
            for doc, own, at, least in zip(*(batch.column(c).to_pylist() for c in ("doc", "own", "at", "least")), strict=True):
                spans = []
                for j in np.flatnonzero(np.array(least) < doc).tolist():
                    if spans and at + j <= spans[-1]:
                        spans[-1] = at + j + k
                    else:
                        spans += [at + j, at + j + k]
                if spans:
                    out.append((doc, own, spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["doc", "own", "spans"])

    covered = stored.where("v is null").select("doc", "own", "at", "s1", "s2").join(learned, ["s1", "s2"]).mapInArrow(cover, "doc long, own long, spans array<int>")
    # A document's spans are no more than its words.
    path = new_path(spark, "covered")
    covered.groupBy(F.col("doc").alias("doc_id"), "own").agg(F.flatten(F.collect_list("spans")).alias("spans")).write.parquet(path)
    covered = spark.read.schema("doc_id long, own long, spans array<int>").parquet(path)
    if covered.count() <= broadcast_rows:
        covered = F.broadcast(covered)

    def keep(batches):
        for batch in (s for b in batches for s in slices(b, 16 << 20)):
            ids, texts_, owns, spans = (batch.column(c).to_pylist() for c in ("doc_id", "text", "own", "spans"))
            counts, gone, kept = [], [], []
            for t, own, s in zip(texts_, owns, spans, strict=True):
                ws = t.encode("utf-8", "surrogatepass").split()
                n = len(ws)
                if s:
                    stay = np.ones(n, bool)
                    for a, b in zip(s[::2], s[1::2], strict=True):
                        stay[a:b] = False
                    ws = [ws[i] for i in np.flatnonzero(stay)]
                counts.append(n)
                gone.append(n - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    marked = docs.join(covered, ["doc_id", "own"], "left")
    return marked.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")
