"""Token-ID / binary output with fixed-width bit packing.

A segment is one packed file image; it is written as one row of a Parquet table in the shared folder, so Spark's own commit
protocol covers lost executors and any store that Spark writes to will do. All numbers are little-endian:

    magic "TLB1" | width u32 | n_docs u64 | n_ids u64 | n_blocks u64 | doc offsets u64[n_docs + 1] (in ids)
    | block offsets u64[n_blocks + 1] (bytes into the payload) | payload

A block has BLOCK ids (the last one fewer), each in `width` bits, the least that holds the vocabulary, lowest bit first.
As a block starts on a byte, blocks are unpacked alone: ``ids(a, b)`` reads only the blocks that hold ids a to b.

Documents are dealt by range of doc_id and sorted, so shard k holds smaller ids than shard k + 1, and (shard, segment) is
the order of the files. Texts are dealt and not ids: they are the smaller of the two. Encoding splits a text as the byte-level
tokenizer does and looks words and pieces up in tables of bounded size; pieces not met before go through the library's model,
and every text in which the two regex engines could differ goes through the library whole.

Defined results: null text is empty: the end id alone. Null doc_ids come first; rows with the same doc_id are kept, each
with its own ids, in the order of their text's hash.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memory, batch, id_and_text, partitions, shared_dir, slices, table, to_arrow

MAGIC, HEAD = b"TLB1", "<4sIQQQ"
BLOCK = 4096
#: A segment is closed when it holds this many ids.
SEGMENT = 1 << 20
#: Places for words, and as many for pieces, that a worker remembers.
REMEMBERED = 900_000


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def pack(docs: list[np.ndarray], width: int, ids: np.ndarray | None = None) -> bytes:
    """The file image of the documents' ids; ids: all of them in one, if at hand."""
    if ids is None:
        ids = np.concatenate([*docs, np.zeros(0, np.uint32)]).astype(np.uint32)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u8")
    blocks = [pack_bits(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return struct.pack(HEAD, MAGIC, width, len(docs), len(ids), len(blocks)) + offsets.tobytes() + at.tobytes() + b"".join(blocks)


def pack_bytes(docs: list[bytes], width: int) -> bytes:
    """The same of ids that are little-endian 32-bit numbers already."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    return pack(np.split(ids, np.cumsum([len(d) // 4 for d in docs])[:-1]), width, ids)


class Packed:
    """Random access to a file image."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_ids, self.n_blocks = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        at = struct.calcsize(HEAD)
        self.offsets = np.frombuffer(data, "<u8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.blocks = np.frombuffer(data, "<u8", self.n_blocks + 1, at)
        self.data, self.start = memoryview(data), at + 8 * (self.n_blocks + 1)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK
        parts = [unpack_bits(self.data[self.start + int(self.blocks[k]) : self.start + int(self.blocks[k + 1])], min(BLOCK, self.n_ids - k * BLOCK), self.width) for k in range(first, last + 1)]
        return np.concatenate(parts)[a - first * BLOCK : b - first * BLOCK]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))


#: Characters that Python's re could split otherwise than the tokenizer: numbers that \d lacks, unassigned characters, and
#: white space that only one of the two takes for such.
RARE = 0x20000  # characters from here on aren't looked at one by one
ODD_ASCII, ODD = bytes(range(28, 32)), bytes(c == 133 or c > 127 and unicodedata.category(chr(c)) in ("No", "Nl", "Cn") for c in range(RARE))
ASCII = bytes(range(128))
#: White space that words are not parted at.
BLANK_ASCII, BLANKS = b"\t\r\x0b\x0c", frozenset(chr(c) for c in range(128, RARE) if chr(c).isspace())


def kind(raw: bytes, text: str) -> str:
    """odd, if the library must split the text; plain, if single spaces and single new lines are all its white space; else other."""
    others = () if raw.isascii() else set(raw.translate(None, ASCII).decode())
    if len(raw.translate(None, ODD_ASCII)) != len(raw) or any(ord(c) >= RARE or ODD[ord(c)] for c in others):
        return "odd"
    uneven = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or len(raw.translate(None, BLANK_ASCII)) != len(raw)
    return "other" if uneven or not BLANKS.isdisjoint(others) else "plain"


#: Fixed value: the tokenizer's pattern of pieces in the terms of Python's re.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

def byte_letters() -> dict[int, str]:
    """The tokenizer's letter for each byte: printable bytes stand for themselves, the others for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteEncoder:
    """Ids of byte-level BPE as the tokenizers library gives them, as little-endian 32-bit numbers. Words (what single spaces
    and new lines part, with the one before them) are remembered, and so are the pieces that words are made of."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.tokens = self.t.model.tokenize
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.words, self.pieces = Memory(REMEMBERED, self.learn_words), Memory(REMEMBERED, self.learn)
        self.letters = byte_letters()
        self.vocabulary = self.t.get_vocab_size()

    def exact(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, raw: bytes) -> bytes:
        text = raw.decode()
        found = kind(raw, text)
        if found == "odd" or any(s in text for s in self.special):
            return self.exact(text)
        if found == "other":
            return self.parts(text)
        first, *words = text.replace("\n", " \n").split(" ")
        return self.parts(first) + b"".join(self.words.values(words))

    def parts(self, text: str) -> bytes:
        return b"".join(self.pieces.values(SPLIT.findall(text)))

    def learn_words(self, words: list[str]) -> list[bytes]:
        found = [SPLIT.findall(w if w[:1] == "\n" else " " + w) for w in words]
        got = iter(self.pieces.values(list(chain.from_iterable(found))))
        return [b"".join(islice(got, len(x))) for x in found]

    def learn(self, pieces: list[str]) -> list[bytes]:
        of, letters = self.tokens, self.letters
        return [array("I", [x.id for x in of(p.encode().decode("latin-1").translate(letters))]).tobytes() for p in pieces]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


FILES = "shard int, segment int, before long, n_ids long, doc_ids array<long>, content binary"


def write_ids(docs: DataFrame, out: str, path: str | None = None, end_id: int = 0) -> None:
    """Write the packed ids of all documents, in ascending doc_id order, to the table `out`: shard, segment, before (ids of the
    shard's earlier segments), n_ids, doc_ids, content (the file image)."""
    at, end = path or tokenizer_path(), np.array([end_id], "<u4").tobytes()
    arrow = to_arrow(docs.sparkSession, FILES)

    def run(batches):
        from pyspark import TaskContext

        e, shard, k = byte_encoder(at), TaskContext.get().partitionId(), 0
        width, ids, held, n, before = width_of(e.vocabulary), [], [], 0, 0

        def segment():
            return batch({"shard": [shard], "segment": [k], "before": [before], "n_ids": [n], "doc_ids": [ids], "content": [pack_bytes(held, width)]}, arrow)

        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                held.append(e.encode(t or b"") + end)
                n += len(held[-1]) // 4
                if n >= SEGMENT:
                    yield segment()
                    k, before, ids, held, n = k + 1, before + n, [], [], 0
        if ids:
            yield segment()

    by = ("doc_id", F.xxhash64("text"))
    dealt = id_and_text(docs).repartitionByRange(partitions(docs.sparkSession), *by).sortWithinPartitions(*by)
    dealt.mapInArrow(run, FILES).write.parquet(out)


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files of write_ids."""
    schema = "shard int, at long, doc_id long, n_tokens long, ids_crc32 long"
    arrow = to_arrow(spark, schema)

    def run(batches):
        for b in slices(batches, 1):
            shard, before, ids, content = (c[0].as_py() for c in b.columns)
            p = Packed(content)
            n = np.diff(p.offsets.astype(np.int64))
            raw = memoryview(p.ids(0, p.n_ids).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(p.offsets[:-1].tolist(), n.tolist(), strict=True)]
            yield batch({"shard": np.full(len(n), shard, np.int32), "at": p.offsets[:-1].astype(np.int64) + before, "doc_id": ids, "n_tokens": n, "ids_crc32": crc}, arrow)

    files = spark.read.schema(FILES).parquet(at)
    rows = files.select("shard", "before", "doc_ids", "content").mapInArrow(run, schema)
    # one row for each shard, of which there are as many as write_ids had partitions: a bounded table
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), out)
    return read_ids(spark, out)
