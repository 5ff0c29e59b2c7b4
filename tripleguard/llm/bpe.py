"""Byte-level BPE: encoding and decoding by DuckDB queries inside each partition.

A text is split by the tokenizer's pattern. Pieces that the task has not met yet go to a
recursive DuckDB query: each piece is a set of (piece, position, token) rows, joined with the table of
merges, and in each round the leftmost pair of minimum rank in each piece is contracted, until
no piece has a pair left. Decoding joins tokens with the vocabulary and
concatenates their bytes by an ordered aggregation.

Spark deals out the texts; a worker keeps the pieces of one slice of texts, or at most CACHE pieces of CACHED code points
(then it starts anew), and hands at most ROUND pieces to a query, so memory doesn't grow with the partition. No special tokens are known:
their strings are ordinary text. Defined results: null and empty texts have no ids; repeated rows each
get a row; further columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleguard.llm.shared import slices

CACHE, CACHED, ROUND = 600_000, 16_000_000, 40_000
#: Bytes of a piece that the recursive query takes at most. Each of its rounds contracts one pair of a piece, so longer ones, such
#: as a megabyte of letters without a break, are contracted over a heap of their pairs instead.
LONG = 2_000

#: One row for each way to cut a token into two tokens; rank is the id of the whole.
MERGES = """
create table merges as
select a.id::bigint * 4294967296 + b.id as pair, t.id as rank
from (select id, bytes, unnest(range(1, octet_length(bytes))) as cut from vocab) t
join vocab a on a.hex = hex(t.bytes)[:2 * t.cut]
join vocab b on b.hex = hex(t.bytes)[2 * t.cut + 1:]
"""

#: Each round unfolds the words into token-position rows, joins them with the merges and contracts the pair of
#: the smallest key (rank, then position) of each word. A word without such a pair leaves; the last row by word stays.
CONTRACT = """
with recursive state(piece, tokens) using key (piece) as (
    select piece, tokens from pieces
    union
    select s.piece, s.tokens[:best % 4294967296 - 1] || [(best // 4294967296)::int] || s.tokens[best % 4294967296 + 2:]
    from state s
    join (
        select piece, min(m.rank::bigint * 4294967296 + p.pos) as best
        from (select piece, unnest(tokens[:-2])::bigint * 4294967296 + unnest(tokens[2:]) as pair, generate_subscripts(tokens[2:], 1) as pos from state) p
        join merges m on m.pair = p.pair
        group by piece
    ) using (piece)
)
select piece, tokens from state
"""

DECODE = """
select seq, string_agg(v.hex, '' order by pos) as hex
from tokens t join vocab v on v.id = t.token group by seq
"""


class Codec:
    """Encodes and decodes with one vocabulary; made once in a Python worker."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, ranks.splitlines()) if a]
        self.find = regex.compile(pattern).findall
        self.of_byte = np.zeros(256, np.int32)
        for token, rank in pairs:
            if len(token) == 1:
                self.of_byte[token[0]] = rank
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "180MB", "preserve_insertion_order": False})
        vocab = pa.table({"id": pa.array([r for _, r in pairs], pa.int32()), "bytes": pa.array([t for t, _ in pairs], pa.binary())})
        self.db.register("given", vocab)
        self.db.execute("create table vocab as select id, bytes, hex(bytes) as hex from given").complete()
        self.db.unregister("given")
        self.db.execute(MERGES).complete()
        self.pairs: dict[int, int] = {}  # merges, once a long piece has asked for them
        self.ids: dict[str, bytes] = {}
        self.back: dict[bytes, bytes] = {}
        self.held = 0  # code points of the pieces that are kept

    def contract(self, raw: bytes) -> bytes:
        """The ids of one piece: the same contraction, leftmost minimum-rank pair first, in n log n steps."""
        if not self.pairs:
            self.pairs.update(self.db.execute("select pair, rank from merges").fetchall())
        merge = self.pairs.get
        tokens: list[int] = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        end = len(tokens)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(rank, i) for i in range(end - 1) if (rank := merge(tokens[i] << 32 | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j == end or merge(tokens[i] << 32 | tokens[j]) != rank:
                continue  # one of the two has gone into another pair since
            tokens[i], tokens[j], after[i] = rank, -1, after[j]
            if after[j] < end:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < end and (new := merge(tokens[left] << 32 | tokens[right])) is not None:
                    heapq.heappush(heap, (new, left))
        return np.array([t for t in tokens if t >= 0], "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces and decodes what they became."""
        self.held += sum(map(len, pieces))
        for piece in [p for p in pieces if len(p) * 4 > LONG and len(p.encode()) > LONG]:
            self.ids[piece] = ids = self.contract(piece.encode())
            self.back[ids] = self.decode([ids])[0]
        pieces = [p for p in pieces if p not in self.ids]
        for at in range(0, len(pieces), ROUND):
            some = pieces[at : at + ROUND]
            raw = [p.encode() for p in some]
            sizes = np.array([len(r) for r in raw])
            tokens = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
            self.db.register("pieces", pa.table({"piece": np.arange(len(some)), "tokens": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), tokens)}))
            done = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("pieces")
            lists = done.column("tokens").combine_chunks()
            flat, ends = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy()
            ids = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for i, x in zip(done.column("piece").to_pylist(), ids, strict=True):
                self.ids[some[i]] = x
            self.back.update(zip(ids, self.decode(ids), strict=True))

    def decode(self, sequences: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of little-endian unsigned 32-bit ids."""
        sizes = np.array([len(s) // 4 for s in sequences], np.int64)
        self.db.register("tokens", pa.table({
            "seq": np.repeat(np.arange(len(sequences)), sizes),
            "pos": np.arange(sizes.sum()),
            "token": np.frombuffer(b"".join(sequences), "<u4"),
        }))
        out = [b""] * len(sequences)
        for seq, text in self.db.execute(DECODE).fetchall():
            out[seq] = bytes.fromhex(text)
        self.db.unregister("tokens")
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, bytes decoded from those ids) of each text."""
        split = [self.find(t) if t else [] for t in texts]
        wanted = dict.fromkeys(p for pieces in split for p in pieces)
        new = [p for p in wanted if p not in self.ids]
        if len(self.ids) + len(new) > CACHE or self.held + sum(map(len, new)) > CACHED:
            self.ids.clear()
            self.back.clear()
            self.held, new = 0, list(wanted)
        if new:
            self.learn(new)
        for pieces in split:
            ids = [self.ids[p] for p in pieces]
            yield b"".join(ids), b"".join([self.back[x] for x in ids])


@lru_cache(maxsize=2)
def codec(name: str, pattern: str) -> Codec:
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(f.read(), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary) for each row.

    ranks_path: a rank file that the driver can read; Spark hands it to the executors.
    """
    return _mapped(docs, ranks_path, pattern, doc_id, text, "ids binary, decoded binary", lambda ids, back: (ids, back))


def digests(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() without moving the ids themselves."""
    return _mapped(
        docs, ranks_path, pattern, doc_id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, back: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()),
    )


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str, text: str, columns: str, make) -> DataFrame:
    docs.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rpartition("/")[2]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("doc_id", pa.int64()), *((c.split()[0], kinds[c.split()[1]]) for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [make(ids, back) for ids, back in codec(name, pattern).encode(part.column(1).to_pylist())]
                columns = [pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(len(schema) - 1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *columns], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {columns}")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, decoded (binary) of each row of ids as encode() gives them; null ids give empty bytes."""
    tokens.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rpartition("/")[2]
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 500_000):
                back = codec(name, pattern).decode([x or b"" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(back, pa.binary())], schema=schema)

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
