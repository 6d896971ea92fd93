"""Byte-level BPE: every distinct word of the corpus is encoded once."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import whole

#: Pre-tokens that share a list of distinct words (a longer document is a block alone).
BLOCK_TOKENS = 3_000_000
#: Pre-tokens in one shipped row, and bytes of words that a worker remembers before it
#: starts afresh.
ROW_CODES, MEMORY = 200_000, 64 << 20


def java_pattern(pattern: str) -> str:
    """The pattern for Java's engine, whose \\s and \\S know ASCII only."""
    return pattern.replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}")


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f)}


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four byte planes, compressed: small numbers cost little."""
    return _zip(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw) if n else b"", np.uint8).reshape(4, n).T).view("<u4").reshape(-1)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each stretch, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Block:
    """Pre-tokens of the documents of one block: distinct words and their uses."""

    def __init__(self) -> None:
        self.words, self.uses, self.sizes, self.ids = [], [], [], []

    def add(self, tokens: pa.ListArray, ids: pa.Array) -> None:
        coded = tokens.flatten().dictionary_encode()
        self.words.append(coded.dictionary.cast(pa.large_binary()))
        self.uses.append(coded.indices.to_numpy(zero_copy_only=False))
        self.sizes.append(tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        self.ids.append(ids)

    def close(self, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words in order of (bucket, bytes), their buckets, and the position of each
        token's word. The order depends on the block's texts alone."""
        all_ = pa.chunked_array(self.words).combine_chunks().dictionary_encode()
        words = all_.dictionary
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words.to_pylist()), np.int64, len(words))
        order = pc.sort_indices(pa.table({"b": bucket, "w": words}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
        place = np.empty(len(order), np.int32)  # a block has far fewer words than 2^31
        place[order] = np.arange(len(order), dtype=np.int32)
        at = np.cumsum([0] + [len(w) for w in self.words])
        first = place[all_.indices.to_numpy(zero_copy_only=False)] if len(words) else place
        uses = np.concatenate([first[a:][u] for a, u in zip(at, self.uses, strict=False)] or [place[:0]])
        self.words, self.uses = [], []
        return words.take(pa.array(order)), bucket[order], uses


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, _Block]]:
    """(number, block) of a partition's documents in their order. A block is given out as
    soon as it is full; its bounds depend on the rows alone, not on the batches."""
    import regex
    find = regex.compile(pattern).findall
    block, held, number = _Block(), 0, None
    for b in batches:
        tokens, odd = b.column("tokens"), b.column("odd")
        if odd.null_count < len(odd):  # letters newer than Java's tables
            rows = tokens.to_pylist()
            for i, t in enumerate(odd.to_pylist()):
                if t is not None:
                    rows[i] = find(t)
            tokens = pa.array(rows, pa.list_(pa.string()))
        if number is None and len(tokens):
            number = b.column("part")[0].as_py() << 32
        ends = np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = sent = 0
        while at < len(tokens):
            to = min(len(tokens), int(np.searchsorted(ends, sent + BLOCK_TOKENS - held)) + 1)
            block.add(tokens.slice(at, to - at), b.column("doc_id").slice(at, to - at))
            held += int(ends[to - 1]) - sent
            at, sent = to, int(ends[to - 1])
            if held >= BLOCK_TOKENS:
                yield number, block
                block, held, number = _Block(), 0, number + 1
        del b, tokens
    if block.ids:
        yield number, block


def _scanned(docs: DataFrame, doc_id: str, text: str, pattern: str) -> DataFrame:
    """part, doc_id, tokens, odd: pre-tokens in the order of the table's partitions."""
    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    odd = F.col("text").rlike(r"\p{Cn}")
    return t.select(F.spark_partition_id().cast("long").alias("part"), "doc_id",
                    F.when(~odd, F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))).alias("tokens"),
                    F.when(odd, F.col("text")).alias("odd"))


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", staged: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of each row's text, without
    special tokens; null text counts as empty; repeated rows repeat; a very long text is a
    block alone; only doc_id and text are read; an empty table gives no rows.

    Words go out as rows of (block, bucket of the word's hash): one compressed row for
    the distinct words of a block that fall into a bucket, never one per occurrence, so
    a word that is everywhere costs a bucket one entry per block. The shuffle by bucket
    brings all uses of a word to one task, which encodes it once; the ids return to the
    blocks, where the documents arrive as positions in the block's word list, and each
    document is put together by position. ``docs`` is read twice and must give the same
    partitions and order both times: a table on disk does; pass ``staged=False`` for a frame
    that is computed, to have it written first. A retried task rebuilds the same rows,
    as they depend on the texts of the partition alone; a mismatch raises an error.
    """
    spark = docs.sparkSession
    if not staged:
        docs = stage_table(docs.select(doc_id, text))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = _scanned(docs, doc_id, text, pattern)

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in _blocks(batches, pattern):
            words, bucket, _ = block.close(n)
            lens = pc.binary_length(words).to_numpy(zero_copy_only=False).astype("<u4")
            cuts = np.searchsorted(bucket, np.arange(n + 1))
            full = [i for i in range(n) if cuts[i] < cuts[i + 1]]
            rows = [_zip(lens[cuts[i]:cuts[i + 1]], np.frombuffer(b"".join(words[cuts[i]:cuts[i + 1]].to_pylist()), np.uint8)) for i in full]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(full), pa.int64()), pa.array(full, pa.int32()),
                                              pa.array([int(cuts[i + 1] - cuts[i]) for i in full], pa.int64()), pa.array(rows, pa.binary())],
                                             ["block", "bucket", "n", "body"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        table = ranks_of(ranks)
        single = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        size = 0
        for b in batches:
            bodies = []
            for m, body in zip(b.column("n").to_pylist(), b.column("body").to_pylist(), strict=True):
                raw = zstandard.decompress(body)
                ends = np.cumsum(np.frombuffer(raw, "<u4", m)).tolist()
                at, ids, text = 0, [], raw[4 * m:]
                for e in ends:
                    w = text[at:e]
                    at = e
                    got = known.get(w)
                    if got is None:
                        if size >= MEMORY:
                            known.clear()
                            size = 0
                        r = table.get(w)
                        got = known[w] = [r] if r is not None else single(w)
                        size += len(w) + 40 * len(got) + 200
                    ids.append(got)
                sizes = np.fromiter(map(len, ids), np.uint32, m)
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
                bodies.append(np.array([len(flat)], "<u4").tobytes() + len(z := _planes(sizes)).to_bytes(4, "little") + z + _planes(flat))
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array([0] * len(bodies), pa.int32()), b.column("bucket").cast(pa.int64()),
                                              b.column("n"), pa.array(bodies, pa.binary())], ["block", "kind", "part", "n", "body"])

    def list_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in _blocks(batches, pattern):
            words, _, uses = block.close(n)
            # frequent words get small numbers
            often = np.argsort(-np.bincount(uses, minlength=len(words)), kind="stable")
            number = np.empty(len(often), np.int32)
            number[often] = np.arange(len(often), dtype=np.int32)
            uses, sizes = number[uses], np.concatenate(block.sizes) if block.sizes else np.zeros(0, np.int64)
            ids = pa.chunked_array(block.ids).combine_chunks()
            known = np.asarray(ids.is_valid())
            value = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            ends = np.cumsum(sizes)
            parts, bodies, counts = [0], [_planes(often)], [len(often)]
            at = done = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, done + ROW_CODES, side="right")))
                m = to - at
                codes = uses[done:ends[to - 1]]
                head = np.array([m], "<u4").tobytes() + known[at:to].astype(np.uint8).tobytes() + value[at:to].tobytes() + sizes[at:to].astype("<u4").tobytes()
                parts.append(len(parts))
                bodies.append(head + _planes(codes))
                counts.append(len(codes))
                at, done = to, int(ends[to - 1])
            for i in range(len(parts)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([1], pa.int32()), pa.array([parts[i]], pa.int64()),
                                                  pa.array([counts[i]], pa.int64()), pa.array([bodies[i]], pa.binary())],
                                                 ["block", "kind", "part", "n", "body"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sizes, ids = None, [], []
        for b in batches:
            for i in range(b.num_rows):
                k, kind, part, m, body = (b.column(j)[i].as_py() for j in range(5))
                if k != block:
                    block, sizes, ids = k, [], []
                if kind == 0:  # ids of the block's words, in the order of buckets
                    total = int.from_bytes(body[:4], "little")
                    cut = 8 + int.from_bytes(body[4:8], "little")
                    sizes.append(_unplanes(body[8:cut], m))
                    ids.append(_unplanes(body[cut:], total))
                elif part == 0:
                    often = _unplanes(body, m).astype(np.int64)
                    size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
                    if len(size) != m:
                        raise RuntimeError("the two reads of the documents differ; pass staged=False")
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                    start = (np.cumsum(size) - size)[often]
                    size = size[often]
                else:
                    d = int.from_bytes(body[:4], "little")
                    known = np.frombuffer(body, np.uint8, d, 4).astype(bool)
                    value = np.frombuffer(body, "<i8", d, 4 + d)
                    length = np.frombuffer(body, "<u4", d, 4 + 9 * d)
                    codes = _unplanes(body[4 + 13 * d:], m)
                    own = size[codes]
                    out = flat[ragged(start[codes], own)].astype("<u4").tobytes()
                    ends = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(length)]).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value, pa.int64(), mask=~known), pa.array(np.diff(ends), pa.int64()),
                         pa.Array.from_buffers(pa.large_binary(), d, [None, pa.py_buffer((ends * 4).astype("<i8").tobytes()), pa.py_buffer(out)]).cast(pa.binary())],
                        ["doc_id", "n_tokens", "ids"])

    shipped = "block long, kind int, part long, n long, body binary"
    by_word = scanned.mapInArrow(list_words, "block long, bucket int, n long, body binary").repartition(n, "bucket").mapInArrow(merge, shipped)
    by_block = by_word.union(scanned.mapInArrow(list_documents, shipped)).repartition(n, "block").sortWithinPartitions("block", "kind", "part")
    return by_block.mapInArrow(assemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds ``bytes``: the bytes of the ids, from the token-byte table (as many rows as
    the vocabulary has, so every task holds it). An unknown id raises an error."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks_of(ranks)
        token = [b""] * (max(table.values()) + 1)
        for t, r in table.items():
            token[r] = t
        size = np.array([len(t) for t in token], np.int64)
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(token), np.uint8)
        for b in batches:
            out = []
            for x in b.column("ids"):
                ids = np.frombuffer(x.as_py(), "<u4")
                out.append(flat[ragged(start[ids], size[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "bytes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(join, f"{schema}, bytes binary")
