"""Token-id files: fixed-size id blocks transposed into planes, each compressed alone.

File format (all integers little-endian)::

    magic   8 bytes  b"LTPLANE1"
    body    chunks: each plane of an id block, compressed with zstandard, end to end
    footer  zstandard of: document table, then chunk index
              int64 n_docs, n_chunks
              n_docs   x (int64 doc_id, int64 n_tokens)
              n_chunks x (int64 offset, int32 n_ids, uint8 plane_bits, uint8 n_planes)
                         with n_planes x int32 compressed size after each
    tail    int64 footer size, 8 bytes magic

``plane_bits`` is 8 for byte planes and 1 for bit planes; planes that are all zero have
size 0. Ids are unsigned 32-bit. The chunk index lets a reader seek to any id of a file.

Rows are range-partitioned and sorted by doc_id; each partition writes consecutive
files of bounded size whose names sort in document order, then a manifest row per file.
A file is written under a temporary name and renamed, so a repeated task leaves the
same files.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.text import as_strings, chunks
from lattica.llm.workspace import Workspace

MAGIC = b"LTPLANE1"
BLOCK_IDS = 1 << 16
#: Ids after which a partition starts its next file; one document is never split.
FILE_IDS = 4 << 20
END_ID = 1
#: Stands for a null id in the files.
NO_ID = -(1 << 63)
#: Pieces that a worker's cache holds before it starts anew (about 150 bytes each).
CACHE_WORDS = 400_000
_MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"


# ---- planes -----------------------------------------------------------------


def to_planes(ids: np.ndarray, plane_bits: int) -> np.ndarray:
    """The planes of one id block as rows of bytes: 4 byte planes or 32 bit planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        return np.ascontiguousarray(raw.T)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, plane_bits: int) -> np.ndarray:
    """The ids of :func:`to_planes`."""
    if plane_bits == 8:
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, bitorder="little")[:, :n]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_file(doc_ids: list[int], counts: list[int], ids: np.ndarray, plane_bits: int = 8, block: int = BLOCK_IDS, level: int = 1) -> bytes:
    """One file of whole documents."""
    pack, out, at, index = zstandard.ZstdCompressor(level=level), [MAGIC], len(MAGIC), []
    for begin in range(0, len(ids), block):
        part = ids[begin : begin + block]
        planes = to_planes(part, plane_bits)
        packed = [pack.compress(p.tobytes()) if p.any() else b"" for p in planes]
        index.append(struct.pack("<qiBB", at, len(part), plane_bits, len(packed)) + struct.pack(f"<{len(packed)}i", *map(len, packed)))
        out += packed
        at += sum(map(len, packed))
    table = np.empty((len(doc_ids), 2), "<i8")
    table[:, 0], table[:, 1] = doc_ids, counts
    footer = pack.compress(struct.pack("<qq", len(doc_ids), len(index)) + table.tobytes() + b"".join(index))
    return b"".join([*out, footer, struct.pack("<q", len(footer)), MAGIC])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all ids of a file."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a token-id file")
    unpack = zstandard.ZstdDecompressor()
    (size,) = struct.unpack("<q", data[-16:-8])
    footer = unpack.decompress(data[-16 - size : -16])
    n_docs, n_chunks = struct.unpack_from("<qq", footer)
    table = np.frombuffer(footer, "<i8", 2 * n_docs, 16).reshape(-1, 2)
    at, parts = 16 + 16 * n_docs, []
    for _ in range(n_chunks):
        offset, n, plane_bits, n_planes = struct.unpack_from("<qiBB", footer, at)
        sizes = struct.unpack_from(f"<{n_planes}i", footer, at + 14)
        at += 14 + 4 * n_planes
        planes = np.zeros((n_planes, n if plane_bits == 8 else (n + 7) // 8), np.uint8)
        for k, s in enumerate(sizes):
            if s:
                planes[k] = np.frombuffer(unpack.decompress(data[offset : offset + s]), np.uint8)
            offset += s
        parts.append(from_planes(planes, n, plane_bits))
    return table[:, 0], table[:, 1], np.concatenate(parts) if parts else np.zeros(0, "<u4")


# ---- ids of texts -----------------------------------------------------------


_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: A text of these characters only is composed already, and the pattern below splits its
#: lower-cased form as the tokenizer does.
_UNSAFE = re.compile("[^\t\n\r -~\u00a1\u00ab\u00bb\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
#: What a tokenizer file must say for the short way above; any other goes the long way.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def splits_by_words(rules: dict) -> bool:
    """Whether a tokenizer file lower-cases and splits texts as :class:`WordEncoder` does itself."""
    model, steps = rules["model"], (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        (rules.get("normalizer") or {}).get("normalizers") == _NORMALIZER
        and len(steps) == 2 and steps[0] == _SPLIT and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and rules.get("post_processor") is None and rules.get("truncation") is None
        and all(t["content"].startswith("<|") and not t["normalized"] for t in rules["added_tokens"])
    )


class WordEncoder(dict):
    """Ids of texts as little-endian uint32 bytes, piece by piece, with a bounded cache.

    The tokenizer lower-cases a text, splits it into pieces and encodes each on its own.
    Texts of Latin letters, digits and plain marks are split here by the same pattern,
    and pieces not yet known go to the tokenizer's model together. Any other text goes
    through the whole tokenizer, its space-separated words likewise cached, since white
    space always ends a piece. A tokenizer file of other rules encodes whole texts.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.by_words = splits_by_words(json.loads(self.tokenizer.to_str()))
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_level = str.maketrans({chr(b): as_bytes.pre_tokenize_str(chr(b))[0][0] for b in range(0xA1, 0x100)})
        self.words: dict[str, bytes] = {"": b""}

    def learn(self, pieces: list[str]) -> None:
        for begin in range(0, len(pieces), 20_000):
            part = pieces[begin : begin + 20_000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part).translate(self.byte_level)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw = ids.tobytes()
            self.update(zip(part, (raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end id."""
        if not self.by_words:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        split = [None if "<|" in t or _UNSAFE.search(t) else _PIECE.findall(t.lower()) for t in texts]
        every = set().union(*filter(None, split))
        missing = every - self.keys()
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = every
        self.learn(list(missing))
        find = self.__getitem__
        return [b"".join(map(find, s)) if s is not None else self.other(t) for s, t in zip(split, texts, strict=True)]

    def other(self, text: str) -> bytes:
        if len(self.words) > self.limit // 4:
            self.words = {"": b""}
        words = text.replace("\n", " ").split(" ")
        for w in set(words) - self.words.keys():
            self.words[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---- writing and reading ----------------------------------------------------


def _put(folder: str, name: str, data: bytes) -> None:
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{zlib.crc32(data):08x}.{np.random.default_rng().integers(1 << 62):x}"
    with fs.open_output_stream(temporary) as f:
        f.write(data)
    fs.move(temporary, f"{base}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, plane_bits: int = 8, partitions: int | None = None) -> DataFrame:
    """Encode every whole text into files under ``folder`` (a URI all executors reach).

    Returns the manifest: part, seq, file, n_docs, n_tokens; files sort by (part, seq) in
    ascending doc_id order. A null id is stored as the smallest integer, comes first and
    is read back as null. Equal ids are ordered by text. A null text is an empty one: its
    end id alone. An empty table writes no file. Running the plan again, or Spark
    repeating a task, writes the same files again.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = _encoder(tokenizer_path), struct.pack("<I", end_id)
        part, seq = TaskContext.get().partitionId(), 0
        ids, counts, body, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, counts, body, size, seq
            name = f"tokens-{part:06d}-{seq:06d}.ltp"
            _put(folder, name, encode_file(ids, counts, np.frombuffer(b"".join(body), "<u4"), plane_bits))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), pa.array([len(ids)]), pa.array([size])], names=["part", "seq", "file", "n_docs", "n_tokens"])
            ids, counts, body, size, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, piece in chunks(as_strings(batch.column(1))):
                for k, raw in enumerate(encoder.encode(piece.to_pylist())):
                    raw += end
                    if size and size + len(raw) // 4 > FILE_IDS:
                        yield close()
                    ids.append(doc_ids[first + k])
                    counts.append(len(raw) // 4)
                    body.append(raw)
                    size += len(raw) // 4
        if ids:
            yield close()

    return rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(run, _MANIFEST)


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Spark's own reader fetches the files, whole and one at a time in a task; the
    manifest gives the ids before each file (a running sum over one row per file).
    """
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.select("file", before.cast("long").alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ltp").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, counts, ids = decode_file(data.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(np.ascontiguousarray(ids).tobytes())
                sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.record_batch([pa.array([name] * len(doc_ids)), pa.array(doc_ids), pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())], names=["file", "doc_id", "local", "n_tokens", "ids_crc32"])

    spans = files.mapInArrow(run, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    return spans.join(starts, "file").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write all documents to ``folder``, then report what its files hold.

    Without a folder the files are temporary and go once they were read.
    """
    ws = Workspace(docs.sparkSession, "tokens")
    folder = folder or ws.path("files")
    manifest = ws.stage(write_tokens(docs, folder, tokenizer_path, **options), "manifest")
    if manifest.isEmpty():
        return ws.finish(docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long"))
    return ws.finish(read_tokens(docs.sparkSession, folder, manifest))


def token_frame(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """A decoded file as one row per document with its ids, for inspection."""
    cuts = np.cumsum(counts)[:-1]
    return pd.DataFrame({"doc_id": doc_ids, "ids": [x.tolist() for x in np.split(ids, cuts)]})
