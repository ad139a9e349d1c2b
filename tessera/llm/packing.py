"""Cost-balanced packing of tokenized documents into sequences.

A piece of n tokens is taken to cost LINEAR * n + QUADRATIC * n * n (attention stays within a document). Documents in
descending order go to the lowest-cost sequence with remaining capacity, whole where it fits, cut where it does not. Each
task packs its own input in blocks of bounded size, so nothing is shuffled and no group is gathered; the block's last
tokens fill sequences of powers of two, so that there is no padding.

Defined cases: a null or empty text is the end token alone; repeated rows are documents of their own; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

LENGTH = 2048
END_ID = 1
#: The added tokens of the tokenizers file, which are no pieces of the rank file.
ADDED = {"<|endoftext|>": 50256}
#: Tokens that a block holds in a task's memory.
BLOCK_TOKENS = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Pieces whose ids a task keeps for reuse.
CACHE = 400_000


class Encoder:
    """The ids of the byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    No token reaches over a space but at its start, so a text that has single spaces only is the chain of its pieces
    between spaces, each with the space before it; their ids are kept for reuse. Any other text is encoded as a whole.
    With added, the added tokens of the tokenizers file are found in texts and take their own ids, as that file has it.
    """

    def __init__(self, vocabulary: str | None = None, pattern: str | None = None, added: bool = False):
        import public_tokenizers
        import tiktoken

        path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte-level", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED if added else {})
        self.added = set(ADDED) if added else set()
        self.opens = np.zeros(max(*ranks.values(), *ADDED.values()) + 1, bool)
        for token, i in ranks.items():
            self.opens[i] = token.startswith(b" ")
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode(text, allowed_special=self.added, disallowed_special=()), "<u4")

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces)
        ids = self.encode(" " + " ".join(new))
        at = np.flatnonzero(self.opens[ids]) if len(ids) else ids
        if len(at) == len(new):
            data, edges = ids.tobytes(), [*(at * 4).tolist(), 4 * len(ids)]
            self.known.update((p, data[a:b]) for p, a, b in zip(new, edges[:-1], edges[1:], strict=True))
        else:
            self.known.update((p, self.encode(" " + p).tobytes()) for p in new)

    def batch(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            pieces = text.split(" ")
            plain = len(pieces) > 1 and all(pieces[1:]) and not any(p[0].isspace() or p[-1].isspace() for p in pieces[1:]) and not pieces[0][-1:].isspace()
            split.append(pieces if plain else None)
        if len(self.known) > CACHE:
            self.known.clear()
        lack = {p for pieces in split if pieces for p in pieces[1:] if p not in self.known}
        if lack:
            self.learn(lack)
        get = self.known.__getitem__
        return [self.encode(t).tobytes() if s is None else self.encode(s[0]).tobytes() + b"".join(map(get, s[1:])) for t, s in zip(texts, split, strict=True)]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(document, start, length, sequence, offset) for each piece, and the number of sequences. Their room is the sum of lengths."""
    out, rest, used = [], [], 0
    for k, n in enumerate(lengths):
        whole = n // length
        out += [(k, i * length, length, used + i, 0) for i in range(whole)]
        used += whole
        if n % length:
            rest.append((n % length, k, whole * length))
    total = sum(r[0] for r in rest)
    room = [length] * (total // length)
    room += [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]
    filled = [0] * len(room)
    heap = [(0.0, used + i) for i in range(len(room))]
    for n, k, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            # the lowest-cost sequence; of the eight lowest, the first that holds the piece whole
            tried = [heapq.heappop(heap) for _ in range(min(8, len(heap)))]
            at = next((i for i, (_, s) in enumerate(tried) if room[s - used] - filled[s - used] >= n), 0)
            so_far, s = tried.pop(at)
            for other in tried:
                heapq.heappush(heap, other)
            part = min(n, room[s - used] - filled[s - used])
            out.append((k, start, part, s, filled[s - used]))
            filled[s - used] += part
            if filled[s - used] < room[s - used]:
                heapq.heappush(heap, (so_far + cost(part), s))
            n, start = n - part, start + part
    return out, used + len(room)


def packed(documents: DataFrame, length: int = LENGTH, vocabulary: str | None = None, added: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary).

    added: texts that hold an added token's content get its id, as tokenizers gives them unless told to encode special tokens.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = Encoder(vocabulary, added=added), TaskContext.get().partitionId() << 32
        held, keys, tokens = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, keys, tokens
            pieces, n = assign([len(x) // 4 for x in held], length)
            ids = pa.concat_arrays(keys)
            for lo in range(0, len(pieces), 5000):
                doc, start, size, seq, offset = (np.array(x, np.int64) for x in zip(*pieces[lo : lo + 5000], strict=True))
                data = [held[k][4 * a : 4 * (a + m)] for k, a, m in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
                whole = np.array([len(held[k]) // 4 for k in doc.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *map(pa.array, (start, size, np.array([zlib.crc32(x) for x in data], np.int64), whole, seq + first, offset)), pa.array(data, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            first, held, keys, tokens = first + n, [], [], 0

        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo in range(0, len(texts), 256):
                new = [x + end for x in encoder.batch(texts.slice(lo, 256).to_pylist())]
                held += new
                keys.append(batch.column(0).slice(lo, 256))
                tokens += sum(map(len, new)) // 4
                if tokens >= BLOCK_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    key = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"), added=True).drop("ids")
