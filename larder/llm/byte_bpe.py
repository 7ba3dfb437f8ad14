"""Byte-level BPE by recursive SQL, in a DuckDB of each task.

A piece of text falls apart where two bytes meet that stand together in no token, since no contraction crosses such a
place.  Each part is rows (word, position, token), one for each byte at first.  A recursive query joins neighbours with the
merge table and contracts each word's leftmost pair of least rank, until no word has a pair left; parts of more than ``WIDE``
bytes contract all places of that pair in a round where nothing of a lesser rank can come of it, so that long runs of one
character take few rounds.  A query goes a bounded number of rounds and the next one goes on from there, so that only
``ROWS`` rows are held.  Decoding joins tokens with the vocabulary and puts their bytes together by an ordered aggregation.

Equal parts of texts are encoded once a worker as long as they are remembered, and equal runs of tokens of a batch are decoded
once; Spark deals out the documents.
"""

from __future__ import annotations

import base64
import heapq

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Remembered, own, slices, texts
from larder.llm.ngram_jaccard import mixed

#: White space as the pattern's \s has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MEMORY = "250MB"
#: Bytes of a batch of words, and rows of all rounds of a query, of short parts and of wide ones.
BATCH, ROWS, WIDE_ROWS = 200_000, 2_000_000, 800_000
#: Bytes of a part from which on all places of its least pair are contracted at once.
WIDE = 64
#: Rows of one part that the queries hold within MEMORY; a longer part is contracted by whole arrays until so few are left.
LONG = 400_000
#: Bytes of texts whose parts a worker holds at a time.  Parts come from memory, so smaller slices take no more time.
SLICE = 512 << 10
#: k is the word's number and, in its low 20 bits, the position; a contraction drops the left token, puts the new one in
#: place of the right, and moves what stands before it one to the right, so positions stay next to each other.
CONTRACT = """
WITH RECURSIVE step(round, k, id, after) AS (
  SELECT 0, k, id, after FROM start
  UNION ALL
  SELECT n.round + 1, n.k + CASE WHEN n.k < b.k THEN 1 ELSE 0 END, CASE WHEN n.k = b.k + 1 THEN b.id ELSE n.id END, CASE WHEN n.k = b.k - 1 THEN b.id ELSE n.after END
  FROM step n JOIN (
    SELECT w, least & ((CAST(1 AS BIGINT) << 40) - 1) AS k, CAST(least >> 40 AS INTEGER) AS id
    FROM (
      SELECT x.k >> 20 AS w, min((CAST(m.id AS BIGINT) << 40) | x.k) AS least
      FROM step x JOIN merges m ON m.l = x.id AND m.r = x.after GROUP BY 1)) b ON b.w = n.k >> 20
  WHERE n.k <> b.k AND n.round < $rounds)
SELECT w, k & 1048575 AS pos, id, round
FROM (SELECT *, k >> 20 AS w FROM step) JOIN (SELECT k >> 20 AS w, max(round) AS round FROM step GROUP BY 1) USING (w, round) ORDER BY w, pos
"""
#: All places of a word's least pair in a round, from the left: of places that overlap every second one, up to the first after
#: which a pair of a lesser rank stands there, with what is before the new token or behind it.  ``alone``: no pair that holds the
#: new token has a lesser rank, so there is nothing to look up.
CONTRACT_ALL = """
WITH RECURSIVE step(round, w, pos, id) AS (
  SELECT 0, w, pos, id FROM start
  UNION ALL
  SELECT round + 1, w, pos, CASE WHEN taken THEN new ELSE id END
  FROM (
    SELECT round, w, pos, id, new, taken, lag(taken, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
    FROM (
      SELECT round, w, pos, c.id, new, chosen AND n <= min(CASE WHEN chosen AND (p.id < new OR q.id < new) THEN n ELSE 2147483647 END) OVER (PARTITION BY w) AS taken
      FROM (
        SELECT *, CASE WHEN chosen AND NOT alone THEN CASE WHEN lag(chosen, 2, false) OVER (PARTITION BY w ORDER BY pos) THEN new ELSE lag(id) OVER (PARTITION BY w ORDER BY pos) END END AS before,
          CASE WHEN chosen AND NOT alone THEN lead(id, 2) OVER (PARTITION BY w ORDER BY pos) END AS behind
        FROM (
          SELECT round, w, pos, id, n, best >> 1 AS new, best & 1 = 1 AS alone, least AND (n - coalesce(max(CASE WHEN NOT least THEN n END) OVER (PARTITION BY w ORDER BY pos), 0)) % 2 = 1 AS chosen
          FROM (
            SELECT *, coalesce(pair = best, false) AS least
            FROM (
              SELECT x.*, m.id * 2 + m.alone AS pair, min(m.id * 2 + m.alone) OVER (PARTITION BY w) AS best
              FROM (SELECT *, lead(id) OVER (PARTITION BY w ORDER BY pos) AS after, CAST(row_number() OVER (PARTITION BY w ORDER BY pos) AS INTEGER) AS n FROM step WHERE round < $rounds) x
              LEFT JOIN merges m ON m.l = x.id AND m.r = x.after)
            WHERE best IS NOT NULL))) c
      LEFT JOIN merges p ON p.l = c.before AND p.r = c.new
      LEFT JOIN merges q ON q.l = c.new AND q.r = c.behind))
  WHERE NOT gone)
SELECT w, pos, id, round FROM step JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round) ORDER BY w, pos
"""

#: Tokens of a group of the ordered aggregation that decodes.
STRETCH = 256
DECODE = "SELECT d, string_agg(hex, '' ORDER BY pos) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY d ORDER BY d"


class Coder:
    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.texts = Remembered()
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.met = np.zeros((256, 256), bool)
        for token in self.ranks:
            at = np.frombuffer(token, np.uint8)
            self.met[at[:-1], at[1:]] = True
        #: Tokens that begin with a blank; runs of tokens are cut before them.
        self.leads = np.zeros(max(self.ranks.values()) + 1, bool)
        self.leads[[i for b, i in self.ranks.items() if b[0] in b" \n"]] = True
        #: Bytes of each token; the last is that of no token, where ids below 0 and beyond the others look.
        self.lengths = np.zeros(len(self.leads) + 1, np.int64)
        self.lengths[list(self.ranks.values())] = [len(b) for b in self.ranks]
        # A worker writes nothing to the disk of its machine: without a folder for it, what doesn't fit is an error.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        words = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [b.hex() for b in self.ranks]})
        self.db.register("words", words)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM words")
        self.db.execute("""
            CREATE TABLE merges AS
            WITH pair AS (
              SELECT a.id AS l, b.id AS r, v.id
              FROM (SELECT id, hex, unnest(range(2, len(hex), 2)) AS cut FROM vocabulary) v
              JOIN vocabulary a ON a.hex = left(v.hex, cut) JOIN vocabulary b ON b.hex = substr(v.hex, cut + 1)),
            less AS (SELECT l AS id FROM pair WHERE id < l UNION SELECT r FROM pair WHERE id < r)
            SELECT pair.*, CASE WHEN less.id IS NULL THEN 1 ELSE 0 END AS alone FROM pair LEFT JOIN less USING (id)""")
        self.db.unregister("words")
        self.pairs: tuple | None = None

    def from_heap(self, piece: bytes) -> list[int]:
        """The same contractions one by one from a heap, for checks of the queries."""
        parts: list[bytes | None] = [bytes([b]) for b in piece]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < len(parts) and (r := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.ranks[p] for p in parts if p is not None]

    def query(self, sql: str, start: pa.Table, rounds: int) -> dict[str, np.ndarray]:
        self.db.register("start", start)
        found = self.db.sql(sql, params={"rounds": rounds}).to_arrow_table()
        self.db.unregister("start")
        return {c: found.column(c).to_numpy() for c in found.column_names}

    def fixpoint(self, w: np.ndarray, pos: np.ndarray, ids: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (word, position, token), ordered, until no word has a pair left."""
        done = []
        if wide and len(w) > LONG:  # a part alone in its batch
            pos, ids, open_ = self.shortened(pos, ids)
            w = np.zeros(len(ids), w.dtype)
            if not open_:
                return w, pos, ids
        while len(w):
            rounds = max(1, (WIDE_ROWS if wide else ROWS) // len(w))
            if wide:
                start, sql = pa.table({"w": w.astype(np.int32), "pos": pos.astype(np.int32), "id": ids}), CONTRACT_ALL
            else:
                after = np.append(ids[1:], -1).astype(np.int32)
                after[np.append(w[1:] != w[:-1], True)] = -1
                pos = np.arange(len(w)) - np.repeat(*_starts(w))
                start, sql = pa.table({"k": (w << 20) | pos, "id": ids, "after": after}), CONTRACT
            found = self.query(sql, start, rounds)
            more = found["round"] >= rounds
            w, pos, ids = found["w"], found["pos"], found["id"]
            done.append((w[~more], pos[~more], ids[~more]))
            w, pos, ids = w[more], pos[more], ids[more]
        w, pos, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((pos, w)) if len(done) > 1 else slice(None)
        return w[order], pos[order], ids[order]

    def shortened(self, pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Places and tokens of one part after rounds as CONTRACT_ALL has them, until LONG are left, and whether a pair may be left."""
        if self.pairs is None:
            m = self.db.sql("SELECT (CAST(l AS BIGINT) << 32) | r AS k, id, alone FROM merges ORDER BY k").to_arrow_table()
            self.pairs = tuple(m.column(c).to_numpy() for c in ("k", "id", "alone"))
        keys, new, alone = self.pairs
        none = np.int64(1 << 62)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            k = (left.astype(np.int64) << 32) | right.astype(np.int64)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            return np.where((keys[at] == k) & (left >= 0) & (right >= 0), new[at], none)

        while len(ids) > LONG:
            rank = ranks(ids[:-1], ids[1:])
            best = rank.min()
            if best == none:
                return pos, ids, False
            at = np.flatnonzero(rank == best)
            order = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), order, 0))
            at = at[(order - run) % 2 == 0]
            if not alone[new == best].all():
                padded = np.concatenate([[-1], ids, [-1, -1]])
                before = np.where(np.append(False, at[1:] == at[:-1] + 2), best, padded[at])
                less = (ranks(before, np.full(len(at), best)) < best) | (ranks(np.full(len(at), best), padded[at + 3]) < best)
                at = at[: int(less.argmax()) + 1] if less.any() else at
            ids[at] = best
            pos, ids = np.delete(pos, at + 1), np.delete(ids, at + 1)
        return pos, ids, True

    def contracted(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces one after another, and how many each has."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        lens = np.array([len(p) for p in pieces], np.int64)
        piece = np.repeat(np.arange(len(pieces)), lens)
        begins = np.append(True, ~self.met[flat[:-1], flat[1:]] | (piece[1:] != piece[:-1]))
        part = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, len(flat)))
        alone = np.flatnonzero(size[part] == 1)
        kept = [(part[alone], self.single[flat[alone]], alone)]
        for wide, chosen in ((False, (size > 1) & (size <= WIDE)), (True, size > WIDE)):
            part_of, rows = np.flatnonzero(chosen), np.flatnonzero(chosen[part])
            ends = np.cumsum(size[part_of])
            for a, b in _batches(ends, BATCH):
                at = rows[ends[a] - size[part_of[a]] : ends[b - 1]]
                w, pos, ids = self.fixpoint(np.repeat(np.arange(b - a), size[part_of[a:b]]), at - first[part[at]], self.single[flat[at]], wide)
                kept.append((part_of[a:b][w], ids, first[part_of[a:b][w]] + pos))
        part, ids, place = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((place, part))
        return ids[order].astype(np.int32), np.bincount(piece[first[part]], minlength=len(pieces))

    def contract(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of each piece, by the recursive queries."""
        ids, n = self.contracted(pieces)
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]

    def learn(self, parts: list[str]) -> list[bytes]:
        """The tokens of parts of texts.  A piece that is a token is that token, before any contraction, as in the library."""
        cut = [[p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(c)] for c in parts]
        pieces = {p for ps in cut for p in ps}
        known = {p: self.ranks[p].to_bytes(4, "little") for p in pieces if p in self.ranks}
        new = [p for p in pieces if p not in known]
        for a, b in _batches(np.cumsum([len(p) for p in new]), 4 * BATCH):
            ids, n = self.contracted(new[a:b])
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            known.update(zip(new[a:b], (raw[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True))
        return [known[ps[0]] if len(ps) == 1 else b"".join(map(known.__getitem__, ps)) for ps in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.texts.joined([chunks(t) for t in texts], self.learn)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of tokens; an id that is not in the vocabulary adds none."""
        lens = np.array([len(x) for x in ids], np.int64)
        if not lens.sum():
            return [b""] * len(ids)
        flat = np.concatenate(ids).astype(np.int64)
        # Tokens are cut before those that begin with a blank: such runs recur.
        begins = self.leads[np.clip(flat, 0, len(self.leads) - 1)]
        begins[(np.cumsum(lens) - lens)[lens > 0]] = True
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, len(flat)))
        pos = np.arange(len(flat)) - np.repeat(first, size)
        _, one, same = np.unique(np.add.reduceat(mixed(flat.astype(np.uint64) + mixed(pos.astype(np.uint64) + np.uint64(1))), first), return_index=True, return_inverse=True)
        if (size[one][same] != size).any() or (flat[np.repeat(first[one][same], size) + pos] != flat).any():
            one = same = np.arange(len(first))  # two runs of one hash: each is decoded by itself
        shift = np.repeat(first[one] - (np.cumsum(size[one]) - size[one]), size[one])
        runs = flat[shift + np.arange(len(shift))]
        long = np.add.reduceat(self.lengths[np.clip(runs, -1, len(self.lengths) - 1)], np.cumsum(size[one]) - size[one])
        part = np.frombuffer(b"".join(self.joined(runs[a : a + BATCH]) for a in range(0, len(runs), BATCH)), np.uint8)
        at, n, out = (np.cumsum(long) - long)[same], long[same], []
        for a, b in _batches(np.cumsum(n), 32 * BATCH):
            ends = np.cumsum(n[a:b])
            out.append(part[np.repeat(at[a:b] - ends + n[a:b], n[a:b]) + np.arange(ends[-1])].tobytes())
        raw = b"".join(out)
        ends = np.append(0, np.cumsum(n))[np.searchsorted(first, np.cumsum(lens))].tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of tokens, by the ordered aggregation over stretches of it."""
        pos = np.arange(len(ids))
        self.db.register("tokens", pa.table({"d": pos // STRETCH, "pos": pos, "id": ids}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        return bytes.fromhex("".join(found.column("bytes").to_pylist()))


def _starts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    return first, np.diff(np.append(first, len(w)))


def _batches(ends: np.ndarray, most: int):
    """Ranges of what ends at these running totals, each of about ``most``, one at least."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def chunks(text: str) -> list[str]:
    """The text in parts between which the pattern never matches: it is cut before a single space between two words, and around
    a single line feed between two words.  Parts recur, so most are known already."""
    out: list[str] = []
    glue = False  # the last part may go on: white space stands at its end, or at the start of what follows
    for n, line in enumerate(text.split("\n")):
        if n:
            if out and not glue and line and line[0] not in SPACE:
                out.append("\n")
            else:
                out.append((out.pop() if out else "") + "\n")
                glue = True
        for k, word in enumerate(line.split(" ")):
            part = " " + word if k else word
            if glue or k and (not word or word[0] in SPACE):
                out.append((out.pop() if out else "") + part)
            elif part:
                out.append(part)
            if part:
                glue = part[-1] in SPACE
    return out


def coder(path: str, pattern: str) -> Coder:
    """One for a Python worker, which runs one task at a time."""
    return own(("bpe", path, pattern), lambda: Coder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, ids): each text's tokens, as the rank file at path and the pattern have them.

    Null texts count as empty and have no token; repeated rows and null ids are rows like any other; other columns are left
    behind; an empty table gives an empty result.
    """

    def run(batches):
        c = coder(path, pattern)
        for batch in (s for b in batches for s in slices(b, SLICE)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in c.encode(batch.column("text").to_pylist())], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded), decoded being the bytes of the tokens; null ids count as none."""

    def run(batches):
        c = coder(path, pattern)
        for batch in (s for b in batches for s in slices(b, SLICE)):
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(c.decode(ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, ids, decoded): encode() and decode() in one worker, ids as little-endian unsigned
    32-bit integers.  Nulls, repeated rows and empty tables are treated as there.
    """

    def run(batches):
        c = coder(path, pattern)
        for batch in (s for b in batches for s in slices(b, SLICE)):
            ids = c.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(c.decode(ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def little_endian(ids: Column) -> Column:
    """An array of ids as the bytes of little-endian unsigned 32-bit integers."""
    turned = lambda i: F.shiftleft(i.bitwiseAND(255), 24).bitwiseOR(F.shiftleft(F.shiftright(i, 8).bitwiseAND(255), 16)).bitwiseOR(F.shiftleft(F.shiftright(i, 16).bitwiseAND(255), 8)).bitwiseOR(F.shiftright(i, 24).bitwiseAND(255))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(turned(i.cast("long"))), 8, "0")), ""))


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what decode() or round_trip() gives."""
    ids = F.col("ids") if decoded.schema["ids"].dataType.typeName() == "binary" else little_endian(F.col("ids"))
    out = decoded.select("doc_id", ids.alias("ids"), "decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
