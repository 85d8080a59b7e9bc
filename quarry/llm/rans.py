"""Token ids of documents as binary blocks, coded by a static range asymmetric numeral system.

The texts are tokenised once; blocks of token ids go to the shared folder. Their symbol counts, over all documents,
give one frequency table that all blocks share. Each block is then coded on its own, by as many interleaved coders as
it has lanes, one lane for every place modulo that number, which numpy steps through together. A block holds
checkpoints: the coders' states and the place in the payload at every ``EVERY`` steps, with a CRC of the ids from
there, so that parts of a block can be decoded in parallel and are verified by themselves.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _runtime as rt

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the pattern counts as white space.
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
BLOCK = 1 << 18
LANES = 512
EVERY = 128
SCALE = 22
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_ENCODERS: dict[str, object] = {}

_IDS = "block_id long, doc_ids array<long>, doc_offsets array<int>, lengths array<int>, n_tokens int, ids binary"
SCHEMA = (
    "block_id long, doc_ids array<long>, doc_offsets array<int>, lengths array<int>, n_tokens int, lanes int, "
    "steps array<int>, words array<int>, crcs array<long>, states binary, payload binary"
)


def encoder(path: str, lines: bytes | None = None):
    """The byte-pair encoder of a file of ranks, made once in a process; ``lines`` are what the file holds."""
    if path not in _ENCODERS:
        import tiktoken

        raw = Path(path).read_bytes() if lines is None else lines
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _ENCODERS[path] = tiktoken.Encoding(
            "quarry", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=len(ranks)
        )
    return _ENCODERS[path]


def _kind(c: str) -> str:
    return " " if c in SPACES else unicodedata.category(c)[0]


def _ends_at(text: str, i: int) -> bool:
    """Whether a piece of the pattern surely ends before character i, and those before and after it are split alike if
    the text is cut there: before white space that follows something else, as white space only begins a piece; and after
    a letter or number, unless more of its kind follow."""
    before, after = _kind(text[i - 1]), _kind(text[i])
    return before != after and (after == " " or before in "LN") and before != " "


def _parts(text: str, most: int) -> Iterator[str]:
    at = 0
    while at < len(text):
        to = at + most
        if to < len(text):
            to = next((i for i in range(to, at, -1) if _ends_at(text, i)), 0) or next(
                (i for i in range(to + 1, len(text)) if _ends_at(text, i)), len(text)
            )
        yield text[at:to]
        at = to


def ids_of(text: str | None, path: str, most: int = 1 << 18, blank: int = 1 << 14) -> np.ndarray:
    """The token ids of a text.

    Longer texts go to the tokeniser in parts, cut where the pattern ends a piece whatever stands around (``_ends_at``):
    at the last such place before ``most`` characters, or else at the first one after them. So the ids are always those
    of the whole text; a single piece that is longer is not cut. Runs of more than ``blank`` white spaces, which exhaust
    the tokeniser's pattern, are given to it as the piece that the pattern makes of them: all but the last one, which
    goes with what follows.
    """
    coder = encoder(path)
    if not text:
        return np.zeros(0, np.uint32)
    out, at = [], 0

    def put(upto: int) -> None:
        for part in _parts(text[at:upto], most):
            out.append(coder.encode_to_numpy(part, allowed_special=set(), disallowed_special=()))

    if len(text) > blank:
        for m in re.finditer(f"[{''.join(SPACES)}]{{{blank + 1},}}", text):
            put(m.start())
            at = m.end() - (m.end() < len(text))
            out.append(np.array(coder._encode_single_piece(text[m.start() : at]), np.uint32))
    put(len(text))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [field.strip().split(" ") for field in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields]
    )


def _tokenise(path: str, ranks, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder(path, ranks.value)
        task, number = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        docs: list[tuple] = []
        full = 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, docs, full, number
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            ids = ids.astype(np.uint32)
            row = ((task << 32) + number, *map(list, zip(*docs, strict=True)), len(ids), _narrow(ids))
            parts, docs, full, number = [], [], 0, number + 1
            return _packed([row], _IDS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py(), path)
                at = 0
                while True:
                    take = min(len(ids) - at, block - full)
                    if take or not len(ids):
                        docs.append((doc_id, at, take))
                        parts.append(ids[at : at + take])
                        full, at = full + take, at + take
                    if full >= block:
                        yield flush()
                    if at >= len(ids):
                        break
        if docs:
            yield flush()

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, four otherwise, told apart by the first byte."""
    small = not len(ids) or ids.max() < 1 << 16
    return bytes([2 if small else 4]) + ids.astype(np.uint16 if small else np.uint32).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1) if len(raw) > 1 else np.zeros(0, np.uint16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            found = np.bincount(_wide(raw.as_py()), minlength=len(counts)).astype(np.int64)
            found[: len(counts)] += counts
            counts = found
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["symbol", "n"])


def table_of(symbols: np.ndarray, counts: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies) in order of symbol; the frequencies are at least 1 and add up to ``2 ** scale``."""
    order = np.argsort(symbols)
    symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
    if not len(symbols):
        return symbols, np.zeros(0, np.uint32)
    if len(symbols) > 1 << scale:
        raise ValueError("more symbols than the table's scale can hold")
    freq = np.maximum(1, np.floor(counts * ((1 << scale) / counts.sum()))).astype(np.int64)
    while (over := int(freq.sum()) - (1 << scale)) > 0:  # small symbols that were raised to 1
        shrink = np.minimum(freq - 1, np.maximum(1, (freq * over) // int(freq.sum())))
        largest = np.argsort(-freq, kind="stable")
        cut = np.minimum(np.cumsum(shrink[largest]), over)
        freq[largest] -= np.diff(cut, prepend=0)
    freq[np.argmax(freq)] += (1 << scale) - int(freq.sum())
    return symbols, freq.astype(np.uint32)


def encode_block(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray, lanes: int = LANES, every: int = EVERY, scale: int = SCALE):
    """(lanes, steps, words, crcs, states, payload) of a block."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    place = np.searchsorted(symbols, ids)
    f = freq[place].astype(np.uint64)
    c = (np.cumsum(freq, dtype=np.uint64) - freq.astype(np.uint64))[place]
    limit = f << np.uint64(63 - scale)
    x = np.full(lanes, _LOW)
    out, emitted, marks = [], 0, []
    shift = np.uint64(scale)
    for t in range((n + lanes - 1) // lanes - 1, -1, -1):
        s = slice(t * lanes, min(n, (t + 1) * lanes))
        k = s.stop - s.start
        now, ft = x[:k], f[s]
        full = now >= limit[s]
        spilt = now[full].astype(np.uint32)
        if len(spilt):
            out.append(spilt)
            emitted += len(spilt)
            now = np.where(full, now >> _WORD, now)
        q = now // ft
        x[:k] = (q << shift) + (now - q * ft) + c[s]
        if t % every == 0:
            marks.append((t, emitted, x.copy()))
    marks.reverse()
    cuts = [t * lanes for t, _, _ in marks] + [n]
    return (
        lanes,
        [t for t, _, _ in marks],
        [emitted - e for _, e, _ in marks],
        [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)],
        b"".join(m.tobytes() for _, _, m in marks),
        b"".join(o.tobytes() for o in reversed(out)),
    )


def decode_segment(row: dict, k: int, symbols: np.ndarray, freq: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The ids from a block's k-th checkpoint to its next, verified by their CRC."""
    lanes, n = row["lanes"], row["n_tokens"]
    start = row["steps"][k]
    stop = row["steps"][k + 1] if k + 1 < len(row["steps"]) else (n + lanes - 1) // lanes
    x = np.frombuffer(row["states"], np.uint64)[k * lanes : (k + 1) * lanes].copy()
    words = np.frombuffer(row["payload"], np.uint32)
    at = row["words"][k]
    ends = np.cumsum(freq, dtype=np.uint64)
    begins = ends - freq.astype(np.uint64)
    mask, shift = np.uint64((1 << scale) - 1), np.uint64(scale)
    out = []
    for t in range(start, stop):
        width = min(n - t * lanes, lanes)
        now = x[:width]
        slot = now & mask
        place = np.searchsorted(ends, slot, side="right")
        out.append(symbols[place])
        now = freq[place].astype(np.uint64) * (now >> shift) + slot - begins[place]
        low = now < _LOW
        need = int(low.sum())
        now[low] = (now[low] << _WORD) | words[at : at + need].astype(np.uint64)
        x[:width] = now
        at += need
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != row["crcs"][k]:
        raise ValueError(f"block {row['block_id']}: checksum of segment {k} differs")
    return ids


def _encode(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, freq = (np.frombuffer(x, np.uint32) for x in table.value)
        for batch in batches:
            for row in batch.to_pylist():
                coded = encode_block(_wide(row["ids"]), symbols, freq)
                head = [row[c] for c in ("block_id", "doc_ids", "doc_offsets", "lengths", "n_tokens")]
                yield _packed([(*head, *coded)], SCHEMA)

    return run


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """Blocks of coded token ids, and one row with block_id -1 that holds the frequency table.

    Columns: block_id; doc_ids, doc_offsets and lengths (the documents in the block, the token of the document at which
    its part in this block starts, and the part's tokens); n_tokens; lanes; steps, words, crcs and states (checkpoints:
    first step, first word of the payload, CRC-32 of the ids up to the next, coder states); payload. The table's row
    has the symbols in ``states`` and their frequencies in ``payload``, four bytes each.

    Defined cases: a null text counts as empty, and an empty one as a document of no tokens. A null id stays null. Rows
    that repeat an id, or that tie in anything, are coded each. A very long text is tokenised whole, and where it is
    longer than a block it continues in the next. An empty table gives only the table's row, without symbols. Other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())  # the file need be on the driver's machine only
    blocks = rt.written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(tokenizer, ranks, block), _IDS),
        "rans-ids",
    )
    # As many rows reach the driver as the vocabulary has symbols.
    counts = (
        blocks.select("ids").mapInArrow(_count, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    )
    symbols, freq = table_of(counts["symbol"].to_numpy(), counts["n"].to_numpy())
    shared = (symbols.tobytes(), freq.tobytes())
    table = spark.createDataFrame([(-1, [], [], [], 0, 0, [], [], [], *map(bytearray, shared))], SCHEMA)
    return blocks.mapInArrow(_encode(spark.sparkContext.broadcast(shared)), SCHEMA).unionByName(table)


def decoded(blocks: DataFrame) -> DataFrame:
    """(doc_id, doc_offset, ids): the documents' parts back from ``encoded``, each segment verified."""
    table = blocks.where("block_id = -1").select("states", "payload").first()
    shared = blocks.sparkSession.sparkContext.broadcast((bytes(table[0]), bytes(table[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, freq = (np.frombuffer(x, np.uint32) for x in shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                segments = [decode_segment(row, k, symbols, freq) for k in range(len(row["steps"]))]
                ids = np.concatenate(segments) if segments else np.zeros(0, np.uint32)
                ends = np.cumsum([0, *row["lengths"]])
                lists = [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["doc_offsets"], pa.int32()),
                        pa.array(lists, pa.list_(pa.int32())),
                    ],
                    ["doc_id", "doc_offset", "ids"],
                )

    return blocks.where("block_id >= 0").mapInArrow(run, "doc_id long, doc_offset int, ids array<int>")


def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(rt.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The coded blocks of all documents, in their order; see ``encoded`` for the columns.

    Defined cases are those of ``encoded``: null and empty texts are documents of no tokens, null ids stay null, rows that
    repeat an id or tie are coded each, very long texts go on from block to block, an empty table gives the frequency
    table's row alone, and further columns, whatever their names, are not read.
    """
    return encoded(docs)


QUERIES = {"op8_rans": op8_rans}
SQL: dict[str, str] = {}
