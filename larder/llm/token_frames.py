"""Token ids in binary files of independent zstandard frames.

A file is a sequence of zstandard frames, one a document, each decompressible alone and with its own checksum; then a
skippable frame with the documents' ids, and a skippable frame with the seek table of the public "zstd seekable format":
for each frame its compressed size, its decompressed size and the low half of the XXH64 of its content.  A reader fetches the
tables at the end of the file and then only the frames it is asked for.  Ids are little-endian unsigned 32-bit integers.

Spark orders documents by id and deals them out; a task writes the file of its range under a name of its own and moves it
into place when it is whole, so that a repeated task leaves one whole file.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import Remembered, new_path, own, partitions, slices, texts

# Fixed values of the zstd seekable format.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
LEVEL = 3
#: Marks that may close a word; the apostrophe may begin a part of its own.
MARKS = ".,;:!?()*#$%&|<>-"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of texts whose words are looked up together.
BATCH = 8 << 20
#: Bytes of a generation of words.
WORDS = 140 << 20
NULL_ID = -(1 << 63)


class Encoder:
    """The tokens of texts by a tokenizer that never looks across ASCII white space, so that words are encoded once.

    Arrow cuts texts into words and finds the distinct ones; only these are looked up, and Arrow puts their ids in place.  New
    words go to the library many at a time, as one text, with a special token between them, at which the library cuts texts
    before anything else.  Words that hold a special token go alone.  Where the tokenizer marks the ends of what it splits
    texts into and splits closing marks off, as it says of itself, words are put together from what is known of their
    letters, in lower case if it writes ASCII so, and their marks; letters are joined by blanks and told apart by the ends.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the library's own would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids of cores, and of whole words, which stand under a blank before them: no core holds one.
        self.words = Remembered(WORDS)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(x.content) for x in added.values()) or "(?!)")
        self.between = next(((i, x.content) for i, x in added.items() if x.special and not (x.normalized or x.lstrip or x.rstrip or x.single_word)), None)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True

        split = self.tokenizer.pre_tokenizer and self.tokenizer.pre_tokenizer.pre_tokenize_str("az" + MARKS)
        #: Whether marks are split off the letters before them, and whether ASCII letters are written in lower case.
        self.apart = bool(split) and [x for _, x in split] == [(0, 2), (2, 2 + len(MARKS))] and self.last.any()
        self.folds = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(UPPER) == UPPER.lower()
        #: Characters whose normal form is letters, and others.
        self.safe: set[str] = set()
        self.unsafe: set[str] = set()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def letters(self, core: str) -> bool:
        """Whether core is letters alone, before and after the tokenizer normalises it: no mark joins what follows it then.

        Each character is tried by itself, once: letters that a normal form composes are letters again.
        """
        if not core.isalpha():
            return False
        if self.tokenizer.normalizer is None or self.safe.issuperset(core):
            return True
        if len(self.unsafe) > 100_000:
            self.unsafe.clear()
        for c in set(core) - self.safe - self.unsafe:
            (self.safe if self.tokenizer.normalizer.normalize_str(c).isalpha() else self.unsafe).add(c)
        return self.safe.issuperset(core)

    def cores(self, cores: list[bytes]) -> list[bytes]:
        """Ids of words of letters that the tokenizer takes as one piece each; nothing for others."""
        out = [b""] * len(cores)
        fit = [i for i, c in enumerate(cores) if c.isalpha() or not c.isascii() and self.letters(c.decode("utf-8", "surrogatepass"))]  # of bytes: ASCII letters
        text = b" ".join([cores[i] for i in fit]).decode("utf-8", "surrogatepass")
        ids = self.ids(text)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(fit) and (not fit or ends[-1] == len(ids)) and not self.special.search(text):
            self.place(out, fit, ids, np.append(0, ends)[:-1], ends)
        else:
            for i, own in zip(fit, self.whole([cores[i] for i in fit]), strict=True):
                last = self.last[np.frombuffer(own, "<u4")]
                if last.sum() == 1 and last[-1] and not self.special.search(cores[i].decode("utf-8", "surrogatepass")):
                    out[i] = own
        return out

    def whole(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word by itself."""
        out, left = [b""] * len(words), []
        for i, w in enumerate(words):
            text = w.decode("utf-8", "surrogatepass")
            if self.between is None or self.special.search(text):
                out[i] = self.ids(text).tobytes()
            else:
                left.append((i, text))
        if left:
            ids = self.ids(self.between[1].join([t for _, t in left]))
            ends = np.flatnonzero(ids == self.between[0])
            self.place(out, [i for i, _ in left], ids, np.append(0, ends + 1), np.append(ends, len(ids)))
        return out

    @staticmethod
    def place(out: list, which: list[int], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        for i, a, b in zip(which, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
            out[i] = raw[a:b]

    def known(self, words: pa.Array, learn: Callable[[list[bytes]], list[bytes]], before: bytes = b"") -> pa.Array:
        """learn's ids of distinct words, kept under what stands before them; null where there are none."""
        keys = objects(words)
        if before:
            keys = [before + k for k in keys]

        def some(new: list[bytes]) -> list[bytes]:
            return [ids for i in range(0, len(new), 10_000) for ids in learn([k[len(before) :] for k in new[i : i + 10_000]])]

        return pa.array([ids or None for ids in self.words.values(keys, some)], pa.large_binary())

    def known_whole(self, words: pa.Array) -> pa.Array:
        return self.known(words, self.whole, b" ").fill_null(b"")

    def distinct(self, words: pa.StringArray) -> pa.Array:
        """The ids of distinct words."""
        if not self.apart:
            return self.known_whole(words)
        cores = pc.ascii_rtrim(words, MARKS)
        marks = np.asarray(pc.binary_length(words)) - np.asarray(pc.binary_length(cores))
        with_marks = np.flatnonzero(marks)
        cores = (pc.ascii_lower(cores) if self.folds else cores).dictionary_encode()
        ids = self.known(cores.dictionary, self.cores).take(cores.indices)
        tails = endings(words, with_marks, marks[with_marks]).dictionary_encode()
        which = np.zeros(len(words), np.int32)
        which[with_marks] = np.asarray(tails.indices) + 1
        tails = pa.concat_arrays([pa.array([b""], pa.large_binary()), self.known_whole(tails.dictionary)]).take(pa.array(which))
        ids = pc.binary_join_element_wise(ids, tails, pa.scalar(b"", pa.large_binary()))
        rest = ids.is_null()
        return pc.replace_with_mask(ids, rest, self.known_whole(words.filter(rest))) if ids.null_count else ids

    def encode(self, texts: list[str | bytes] | pa.Array) -> list[bytes]:
        """Each text's ids, as they stand in the files; a text may be given as its UTF-8, texts as Arrow's array without nulls."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts], pa.binary())
        words = pc.ascii_split_whitespace(strings(texts.cast(pa.binary())))
        coded = words.flatten().dictionary_encode()
        # Many new strings and no cycle among them: the collector would walk all that is remembered, again and again.
        on = gc.isenabled()
        gc.disable()
        try:
            ids = self.distinct(coded.dictionary)
        finally:
            if on:
                gc.enable()
        # Arrow cuts at each end of a text too; such empty words have no ids.
        ids = ids.take(coded.indices)
        _, at, raw = ids.buffers()
        ends = np.frombuffer(at, "<i8")[np.asarray(words.offsets)] if len(ids) else np.zeros(len(texts) + 1, int)
        raw = memoryview(raw or b"")
        return [bytes(raw[a:b]) for a, b in pairwise(ends.tolist())]


def strings(binary: pa.BinaryArray) -> pa.StringArray:
    """The same bytes as Arrow's strings, whether or not they are UTF-8."""
    return pa.StringArray.from_buffers(len(binary), *binary.buffers()[1:], offset=binary.offset)


def objects(words: pa.StringArray) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def endings(words: pa.StringArray, which: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """The last bytes of some of the words, as many as lengths say."""
    _, at, raw = words.buffers()
    ends = np.frombuffer(at, "<i4")[words.offset + 1 + which]
    offsets = np.append(0, np.cumsum(lengths, dtype=np.int64))
    places = np.repeat(ends - lengths - offsets[:-1], lengths) + np.arange(offsets[-1])
    data = np.frombuffer(raw or b"", np.uint8)[places]
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(data))


def gathered(batches: Iterable[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of some bytes or more, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= at_least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Writer:
    def __init__(self, out):
        self.out, self.entries, self.ids = out, [], []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(NULL_ID if doc_id is None else doc_id)

    def finish(self) -> None:
        ids = np.array(self.ids, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        table = b"".join(self.entries)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC))


class Reader:
    """Documents of one file; only the tables and the frames asked for are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table of this format")
        begin = size - 9 - 12 * n - 8
        table = np.frombuffer(self.at(begin + 8, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.lengths, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.ids = np.frombuffer(self.at(begin - 8 * n, 8 * n), "<i8")
        self.decompressor = zstandard.ZstdDecompressor()

    def at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, i: int) -> np.ndarray:
        raw = self.decompressor.decompress(self.at(int(self.offsets[i]), int(self.sizes[i])), max_output_size=max(1, int(self.lengths[i])))
        if len(raw) != self.lengths[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        a, b = np.searchsorted(self.ids, (doc_id, doc_id + 1))
        return [self.document(i) for i in range(a, b)]


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Writes docs(doc_id, text, ...) to files under folder, and returns their manifest: (file, part, docs, tokens).

    Files and what is in them go in ascending doc_id order (null ids first, as the least; rows of one id as they come).  Every
    document ends with end_id.  Null texts count as empty; other columns are left behind; an empty table gives no file.
    """
    spark = docs.sparkSession
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    ordered = texts(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        from pyspark import TaskContext

        mine = stream = None
        tokens, end = 0, struct.pack("<I", end_id)
        store, base = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        try:
            for batch in gathered((s for b in batches for s in slices(b, BATCH)), BATCH):
                if mine is None:
                    encoder = own(("frames", tokenizer), lambda: Encoder(tokenizer))
                    mine = f"{base}/.{part}-{uuid.uuid4().hex}"
                    stream = store.open_output_stream(mine)
                    writer = Writer(stream)
                for i, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                    writer.add(i, ids + end)
                    tokens += len(ids) // 4 + 1
            if mine is None:
                return
            writer.finish()
            stream.close()
            name = f"part-{part:05d}.zst"
            store.move(mine, f"{base}/{name}")
        except BaseException:  # a task that fails or is stopped leaves nothing behind; its repetition writes a file of its own
            if stream is not None:
                stream.close()
                store.delete_file(mine)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([len(writer.ids)], pa.int64()), pa.array([tokens], pa.int64())], ["file", "part", "docs", "tokens"])

    path = new_path(spark, "manifest")
    ordered.mapInArrow(run, "file string, part int, docs long, tokens long").write.parquet(path)
    return spark.read.schema("file string, part int, docs long, tokens long").parquet(path)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document of the files: ids as they stand there, start counting those of all documents before it."""
    # A row for each file, so one task can hold the running total.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0))).select("file", "base")

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{file}") as source:
                    r = Reader(source)
                    for at in range(0, len(r), 500):
                        ids = [r.document(i).tobytes() for i in range(at, min(at + 500, len(r)))]
                        starts = start + np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                        start = int(starts[-1])
                        doc = [None if i == NULL_ID else int(i) for i in r.ids[at : at + len(ids)]]
                        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return files.repartition(partitions(manifest.sparkSession), "file").mapInArrow(run, "doc_id long, start long, ids binary")


def summary(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read() gives."""
    return documents.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
