"""Token-ID output: canonical length-limited Huffman coding of token ids.

File format. A corpus is a folder of part files, in ascending document order by part number. Every
part is a run of records; each record is ``kind (1 byte) | length of body (u32 LE) | body`` and is
followed by the eight bytes of ``MARK`` (they let Spark's own line writer put the records on any
file system with its commit protocol; a reader checks and skips them):

* ``H`` header: magic ``TIDH``, version (u16), longest code (u16), part number (u32), size of the
  vocabulary (u32), then one byte per id: the length of its code, 0 for ids that never occur. The
  canonical code follows from the lengths alone: codes are dealt by (length, id).
* ``B`` block: documents (u32), ids (u32), ids per checkpoint (u32), bytes of the bit string (u32);
  per document its id (i64), whether it has one (u8), and its number of ids (u32); per checkpoint
  the bit offset (u32) at which every ``step``-th id begins; then the bit string.

A block holds whole documents and can be decoded without any other block. Inside it all
checkpoints are decoded in step: each round reads one window of bits per checkpoint and looks up
symbol and length in a table of 2^longest entries.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, byte_rows, id_and_text, saved, small_batches

MARK = "\n=TIDS=\n"
LONGEST = 16
STEP = 64
BLOCK_IDS = 1 << 16


# ---------------------------------------------------------------- tokenizing

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Printable ASCII but the apostrophe, and white space; Latin-1 letters as UTF-8.
_PLAIN = bytes([9, 10, 11, 12, 13, *(c for c in range(32, 127) if c != 39)])
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_LETTERS = re.compile(rb"(?:" + _LATIN + rb")*")
#: The pieces of a folded run of these.
_PIECE = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


@lru_cache(maxsize=1)
def _encoder(path: str) -> Callable[[bytes], bytes]:
    """Text bytes -> its ids as little-endian u16, equal to the tokenizer's ids of the whole text.

    The tokenizer normalises (NFC, white space, lower case), splits at white space and where letters,
    digits and other signs meet, and merges inside the pieces. So equal pieces have equal ids: each is
    taken through the library once and looked up afterwards, in a table that is emptied when full.
    Where a piece ends is only decided here for printable ASCII and Latin-1 letters; a run between
    blanks with anything else in it (an apostrophe may begin a contraction, marks may combine, the
    special tokens' brackets) is one piece and left to the library whole.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    split = lambda s: [part for part, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(s))]
    merge, known = tok.model.tokenize, {}
    letters = {c: split(chr(c))[0] for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}  # as the vocabulary spells them

    def plain(text: bytes) -> bool:
        return b"<|" not in text and _LETTERS.fullmatch(text.translate(None, _PLAIN)) is not None

    def ids_of(piece: bytes) -> bytes:
        if not plain(piece):
            ids = tok.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        elif piece.isascii():
            ids = [t.id for t in merge(piece.decode())]
        else:
            ids = [t.id for t in merge(piece.decode().translate(letters))]
        return struct.pack(f"<{len(ids)}H", *ids)

    def encode(text: bytes) -> bytes:
        folded = text.translate(_LOWER)
        if plain(folded):
            pieces = _PIECE.findall(folded)
        else:
            pieces = []
            for run, low in zip(text.split(), folded.split()):
                pieces += _PIECE.findall(low) if plain(low) else [run]
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = ids_of(p)
        return b"".join([known[p] for p in pieces])

    return encode


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (u16 LE bytes, ``end_id`` last) of every whole text; null texts are empty."""

    def run(batches):
        encode, end = _encoder(tokenizer), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode(t.tobytes()) + end for t in byte_rows(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return arrow_map(id_and_text(docs, id_col, text_col), run, "doc_id long, ids binary")


# ---------------------------------------------------------------- the code

def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 for ids with count 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes longer than {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(object)
    coins = [(int(w), i) for i, w in enumerate(weight)]
    levels, packages = [], []
    for _ in range(longest):
        row = list(heapq.merge(coins, packages, key=lambda c: c[0]))
        levels.append(row)
        packages = [(row[i][0] + row[i + 1][0], -1) for i in range(0, len(row) - 1, 2)]
    take = 2 * (len(used) - 1)
    for row in reversed(levels):
        chosen = [i for _, i in row[:take] if i >= 0]
        out[used[chosen]] += 1  # each coin occurs once in a level
        take = 2 * (take - len(chosen))
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: numbers dealt in the order (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def decoding_table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``longest`` bits: the id that it begins with and its code's length."""
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used].astype(np.uint64) << (longest - lengths[used]).astype(np.uint64), kind="stable")]
    spans = 1 << (longest - lengths[used].astype(np.int64))
    ids, sizes = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
    ids[:spans.sum()] = np.repeat(used, spans)
    sizes[:spans.sum()] = np.repeat(lengths[used], spans)
    return ids, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The bit string of ids (most significant bit first) and the bit offset of every ``step``-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    begins = ends - n
    word, room = begins >> 4, 32 - (begins & 15) - n
    value = codes[ids].astype(np.int64) << room  # two 16-bit words hold any code of 16 bits
    size = (int(ends[-1]) >> 4) + 2 if len(ids) else 1
    bits = np.bincount(word, value >> 16, size) + np.bincount(word + 1, value & 0xFFFF, size)
    return bits.astype(">u2").tobytes(), begins[::step].astype("<u4")


def unpack(bits: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], step: int = STEP) -> np.ndarray:
    """The ids of a bit string; all checkpoints advance together."""
    ids, sizes = table
    raw = np.frombuffer(bits + b"\0" * 6, np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = offsets.astype(np.int64)
    out = np.empty((step, len(at)), np.uint32)
    last = len(window) - 1
    for i in range(step):
        bit = (window[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[i] = ids[bit]
        at = at + sizes[bit]
    return out.T.reshape(-1)[:n]


# ---------------------------------------------------------------- files

def _record(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body


def _block(rows: list[tuple[int | None, bytes]], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    ids = np.frombuffer(b"".join(x for _, x in rows), "<u2")
    bits, offsets = pack(ids, codes, lengths)
    return b"".join([
        struct.pack("<IIII", len(rows), len(ids), STEP, len(bits)),
        np.array([i or 0 for i, _ in rows], "<i8").tobytes(), np.array([i is not None for i, _ in rows], "u1").tobytes(),
        np.array([len(x) // 2 for _, x in rows], "<u4").tobytes(), offsets.tobytes(), bits])


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: counted per task, summed by Spark, one number per id brought here."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            rows = list(byte_rows(batch.column("ids")))
            for at in range(0, len(rows), 128):  # one walk over the vocabulary per 128 rows
                total += np.bincount(np.concatenate(rows[at:at + 128]).view("<u2"), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    got = arrow_map(tokens.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def write_ids(tokens: DataFrame, path: str, vocabulary: int, part_ids: int) -> None:
    """Write (doc_id, ids) in ascending doc_id order as part files of about ``part_ids`` ids (null ids first)."""
    counts = count_ids(tokens, vocabulary)
    parts = max(1, round(int(counts.sum()) / part_ids))
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    sent = tokens.sparkSession.sparkContext.broadcast((lengths, codes))  # a byte and a word per id of the vocabulary

    def run(batches):
        lengths, codes = sent.value
        head = b"TIDH" + struct.pack("<HHII", 1, LONGEST, TaskContext.get().partitionId(), vocabulary) + lengths.tobytes()
        waiting, size, begun = [], 0, False
        for batch in batches:
            out = [] if begun else [_record(b"H", head)]
            begun = True
            for i, ids in zip(batch.column("doc_id").to_pylist(), byte_rows(batch.column("ids"))):
                waiting.append((i, ids.tobytes()))
                size += len(ids) // 2
                if size >= BLOCK_IDS:
                    out.append(_record(b"B", _block(waiting, codes, lengths)))
                    waiting, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([_record(b"B", _block(waiting, codes, lengths))], pa.binary())], names=["value"])

    ordered = tokens.repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    arrow_map(ordered, run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", MARK).text(path)
    sent.destroy()


def _records(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    view, at, mark = memoryview(data), 0, MARK.encode()
    while at < len(view):
        n = struct.unpack_from("<I", view, at + 1)[0]
        body = view[at + 5:at + 5 + n]
        if len(body) != n or view[at + 5 + n:at + 5 + n + len(mark)] != mark:
            raise ValueError(f"broken record at byte {at}")
        yield bytes(view[at:at + 1]), body
        at += 5 + n + len(mark)


def read_blocks(data: bytes) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """part number, document ids, first place of each document's ids (and the end), ids of every block."""
    table, part = None, 0
    for kind, body in _records(data):
        if kind == b"H":
            if body[:4] != b"TIDH":
                raise ValueError("not a token-id file")
            _, longest, part, _ = struct.unpack_from("<HHII", body, 4)
            table = decoding_table(np.frombuffer(body, np.uint8, offset=16), longest)
            continue
        docs, n, step, size = struct.unpack_from("<IIII", body)
        at = 16
        keys = np.frombuffer(body, "<i8", docs, at)
        has = np.frombuffer(body, "u1", docs, at + 8 * docs)
        sizes = np.frombuffer(body, "<u4", docs, at + 9 * docs)
        offsets = np.frombuffer(body, "<u4", -(-n // step), at + 13 * docs)
        bits = bytes(body[at + 13 * docs + 4 * len(offsets):])
        if len(bits) != size or int(sizes.sum()) != n:
            raise ValueError("broken block")
        yield part, [int(k) if h else None for k, h in zip(keys, has)], np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), unpack(bits, offsets, n, table, step)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files at ``path``: part, seq (its place in the part), doc_id, before (ids
    ahead of it in the part), n_tokens, ids_crc32 and, if asked for, ids (u32 LE bytes)."""
    fields = ["part int", "seq long", "doc_id long", "before long", "n_tokens long", "ids_crc32 long"] + ["ids binary"] * with_ids
    names = [f.split()[0] for f in fields]

    def run(batches):
        for batch in batches:
            for data in byte_rows(batch.column("content")):
                seq = before = 0
                for part, keys, places, ids in read_blocks(data.tobytes()):
                    raw = [ids[places[i]:places[i + 1]].astype("<u4").tobytes() for i in range(len(keys))]
                    k = len(keys)
                    columns = [pa.array([part] * k, pa.int32()), pa.array(range(seq, seq + k), pa.int64()), pa.array(keys, pa.int64()),
                               pa.array(before + places[:-1], pa.int64()), pa.array(np.diff(places), pa.int64()),
                               pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    if with_ids:
                        columns.append(pa.array(raw, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    seq, before = seq + k, before + len(ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow_map(files, run, ", ".join(fields))


def token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, vocabulary: int = 49408,
                part_ids: int = 8_000_000) -> DataFrame:
    """Tokenize ``docs``, write the files to ``path``, read them back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; rows of one id follow one another in the order
    of their ids' hash, null ids come first. Empty and null texts have the end id alone. An empty
    table gives no rows. Each part holds about ``part_ids`` ids.
    """
    spark = docs.sparkSession
    with small_batches(spark):  # whole texts: fewer rows at once in the JVM and in Python
        tokens = saved(tokenize(docs, tokenizer, end_id), "token-ids")
        write_ids(tokens, path, vocabulary, part_ids)
    found = saved(read_ids(spark, path, with_ids=False), "token-rows")
    per_part = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part").alias("p"), F.coalesce(F.sum("n").over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return found.join(per_part, F.col("part") == F.col("p")).select(
        "doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
