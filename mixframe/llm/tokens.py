"""Token ids in binary shards, compressed document by document.

A shard is one row of a Parquet table: its documents in ascending ``doc_id``,
and a binary value that starts with a header (magic, width of an id, number of
documents, SHA-256 of the dictionary), goes on with the offset index (one
64-bit offset per document and the end) and holds one zstandard frame per
document. All frames share a dictionary trained on serialized ids, so that a
short document compresses well and is read alone: its offsets, its frame."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import mapped
from .text import byte_set, pieces, runs, same_spans
from .text import words as split_words

MAGIC = b"TIDS"
HEADER = struct.Struct("<4sHHI32s")
END_ID = 0
SHARD_TOKENS = 1 << 20
DICTIONARY_BYTES = 64 << 10
#: Documents that the dictionary is trained on, about, and the longest of them in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 20_000
#: Words that a worker remembers, about; it forgets all of them beyond.
CACHE_WORDS = 1_000_000
BLANK = byte_set([0x20])
VISIBLE = byte_set(range(0x21, 0x7F))
SHARDS = "shard bigint, part bigint, n_docs bigint, n_tokens bigint, doc_ids array<bigint>, blob binary"
SHARD_FIELDS = pa.schema(
    [(x, pa.int64()) for x in ("shard", "part", "n_docs", "n_tokens")]
    + [("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())]
)
DOCS = "doc_id bigint, shard bigint, place bigint, part bigint, in_shard bigint, n_tokens bigint, ids_crc32 bigint"
DOC_FIELDS = pa.schema([(x.split()[0], pa.int64()) for x in DOCS.split(", ")])

class Encoder:
    """``encode`` of a byte-level BPE tokenizer, as bytes of little-endian ids.
    A blank between two characters that are not white space always starts a new
    piece, so a text may be cut there. Each distinct word of a batch is encoded
    once, many to a call (a token that begins with a blank then begins a word),
    and remembered; the texts are put together from them. Texts that hold an
    added token, or a blank beside other white space, are encoded as a whole.
    A word is looked up by its hash and compared byte by byte; a text with one
    that differs from the word remembered under its hash is encoded as a whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith(blank) for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        """Remembered words, ascending by hash: where their ids begin and how many there are."""
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.kind)
        self.bytes, self.spelt = np.zeros(0, np.uint8), np.zeros((2, 0), np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind) for x in found]

    def _plain(self, word: str) -> bool:
        return not (word[0].isspace() or word[-1].isspace() or any(a in word for a in self.added))

    def _all_plain(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, spelt: bytes) -> np.ndarray:
        """``_plain`` of each word; one that begins and ends with a visible ASCII
        character is read only where the words, side by side, hold an added token."""
        ends = VISIBLE[data[start]] & VISIBLE[data[start + size - 1]]
        if any(a.encode() in spelt for a in self.added):
            ends[:] = False
        for at in np.flatnonzero(~ends).tolist():
            ends[at] = self._plain(data[start[at] : start[at] + size[at]].tobytes().decode())
        return ends

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Remember words, spans of ``data``, as they are encoded after a blank;
        those that may not be cut off get nothing."""
        if not len(keys):
            return
        width = end - start
        spelt = data[np.repeat(start, width) + runs(width)]
        plain = self._all_plain(data, start, width, spelt.tobytes())
        # the plain words, each after a blank
        wide = width[plain] + 1
        first = np.cumsum(wide) - wide
        text = data[np.maximum(np.repeat(start[plain] - 1, wide) + runs(wide), 0)]
        text[first] = 0x20
        text, first = text.tobytes(), [*first.tolist(), len(text)]
        groups = range(0, len(wide), 1000)
        ends = [min(k + 1000, len(wide)) for k in groups]
        made, counts = [self.ids], []
        for lo, hi, ids in zip(groups, ends, self._ids([text[first[i] : first[j]].decode() for i, j in zip(groups, ends)])):
            cut = np.flatnonzero(self.begins[ids])
            if len(cut) != hi - lo:
                raise ValueError("the tokenizer does not start a piece at each blank")
            made.append(ids)
            counts.append(np.diff(np.append(cut, len(ids))))
        size = np.zeros(len(keys), np.int32)
        size[plain] = np.concatenate(counts) if counts else 0
        at = np.searchsorted(self.keys, keys)
        self.begin = np.insert(self.begin, at, len(self.ids) + np.cumsum(size) - size)
        self.keys, self.size = np.insert(self.keys, at, keys), np.insert(self.size, at, size)
        ends = len(self.bytes) + np.cumsum(width)
        self.spelt = np.insert(self.spelt, at, np.array([ends - width, ends]), axis=1)
        self.bytes = np.concatenate([self.bytes, spelt])
        self.ids = np.concatenate(made)

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow column without nulls."""
        found = split_words(texts, BLANK)
        n, first = len(found.first) - 1, found.first
        keys, at, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
        raw = found.data.tobytes()
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self._forget()
        at_known = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at_known < len(self.keys)
        new[inside] = self.keys[at_known[inside]] != keys[inside]
        self._learn(keys[new], found.data, found.start[at[new]], found.end[at[new]])
        known = np.searchsorted(self.keys, keys)
        sizes, begin = self.size[known].astype(np.int64), self.begin[known]
        spelt = self.spelt[:, known[inverse]]
        right = same_spans(found.data, found.start, found.end, self.bytes, *spelt)

        # texts that may be cut: single blanks between plain words, none at the ends
        some = np.flatnonzero(np.diff(first))
        single = np.ones(len(found.start), bool)
        single[1:] = found.start[1:] == found.end[:-1] + 1
        single[first[some]] = found.start[first[some]] == found.offset[some]
        good = single & right & (sizes[inverse] > 0)
        cut = np.zeros(n, bool)
        cut[some] = np.logical_and.reduceat(good, first[some]) & (found.end[first[some + 1] - 1] == found.offset[some + 1]) if len(some) else False
        # the first word of each such text, and the other texts, as they stand
        offset, end = found.offset.tolist(), found.offset[1:].copy()
        end[cut] = found.end[first[:-1][cut]]
        heads = self._ids([raw[i:j].decode() for i, j in zip(offset, end.tolist())])

        entries = np.concatenate([self.ids, *heads])
        own = np.array([len(x) for x in heads], np.int64)
        sizes, begin = np.concatenate([sizes, own]), np.concatenate([begin, len(self.ids) + np.cumsum(own) - own])
        which = inverse.copy()
        which[first[:-1][cut]] = len(keys) + np.flatnonzero(cut)
        used = np.repeat(cut, np.diff(first))
        which, owner = which[used], found.of_text()[used]
        lengths = sizes[which]
        ids = entries[np.repeat(begin[which], lengths) + runs(lengths)].tobytes()
        ends = np.cumsum(np.bincount(owner, weights=lengths, minlength=n).astype(np.int64)) * self.kind.itemsize
        parts = zip([0, *ends[:-1].tolist()], ends.tolist(), cut.tolist(), heads)
        return [ids[i:j] if ok else head.tobytes() for i, j, ok, head in parts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process; it outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train_dictionary(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the ids of about ``rows`` documents of up to 20,000
    characters, drawn by a hash of the text. Empty if there is too little."""
    n = docs.count()  # from the footers, no text is read
    known = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("text")
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = [r["text"] for r in known.where(draw < min(1.0, rows / max(n, 1))).limit(4 * rows).collect()]
    samples = encoder(path).encode(pa.array(sorted(chosen), pa.string()))
    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data is not None:
        data.precompute_compress(level=1)
    return zstandard.ZstdCompressor(level=1, dict_data=data), zstandard.ZstdDecompressor(dict_data=data)


def _shard(frames: list[bytes], width: int, digest: bytes) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).astype("<u8")
    start = HEADER.size + offsets.nbytes
    return HEADER.pack(MAGIC, 1, width, len(frames), digest) + (offsets + start).astype("<u8").tobytes() + b"".join(frames)


def read_frame(blob, place: int, decompressor, digest: bytes) -> np.ndarray:
    """Ids of one document of a shard; only its offsets and frame are touched."""
    view = memoryview(blob)
    magic, _, width, n, made_with = HEADER.unpack(view[: HEADER.size])
    if magic != MAGIC or made_with != digest:
        raise ValueError("not a shard of this dictionary")
    if not 0 <= place < n:
        raise IndexError(place)
    begin, end = np.frombuffer(view, "<u8", 2, HEADER.size + 8 * place)
    return np.frombuffer(decompressor.decompress(view[int(begin) : int(end)]), f"<u{width}")


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode the texts of ``docs`` (``doc_id``, ``text``) and write them to
    ``folder`` in ascending ``doc_id``, null ids first: ``shards`` and
    ``dictionary``. ``end_id`` follows every document. A null text counts as
    empty; rows that share an id follow one another, repeated rows are all
    written; an empty table gives a table without shards; other columns are
    ignored. ``folder`` must be one that all executors reach."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(rows, tokenizer_path)
    digest = hashlib.sha256(dictionary).digest()

    def write(batches):
        task, seq = TaskContext.get().partitionId(), 0
        made, compressor = encoder(tokenizer_path), _codec(dictionary)[0]
        end = np.array([end_id], made.kind).tobytes()
        ids, frames, held = [], [], 0

        def shard():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(((task << 32) + seq, task, len(ids), held, ids, _shard(frames, made.kind.itemsize, digest)), SHARD_FIELDS)],
                schema=SHARD_FIELDS,
            )

        for batch in batches:
            for part in pieces(batch, 2 << 20):
                for doc_id, coded in zip(part.column("doc_id").to_pylist(), made.encode(part.column("text"))):
                    ids.append(doc_id)
                    frames.append(compressor.compress(coded + end))
                    held += len(coded) // made.kind.itemsize + 1
                    if held >= shard_tokens:
                        yield shard()
                        seq, ids, frames, held = seq + 1, [], [], 0
        if ids:
            yield shard()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    mapped(ordered, write, SHARDS).write.option("compression", "none").parquet(f"{folder}/shards")
    spark = docs.sparkSession
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, dictionary binary").write.parquet(f"{folder}/dictionary")


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return dictionary


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the files have it: ``doc_id``, ``shard``, ``place``,
    ``start`` (ids of all documents before it), ``n_tokens`` with the end id,
    and ``ids_crc32``, the CRC of all its ids as 32-bit numbers."""
    dictionary = _dictionary(spark, folder)
    digest = hashlib.sha256(dictionary).digest()

    def read(batches):
        decompressor = _codec(dictionary)[1]
        for batch in batches:
            for row in range(len(batch)):
                blob = batch.column("blob")[row].as_buffer()
                ids, shard, part = (batch.column(x)[row].as_py() for x in ("doc_ids", "shard", "part"))
                sizes, sums = [], []
                for place in range(len(ids)):
                    found = read_frame(blob, place, decompressor, digest)
                    sizes.append(len(found))
                    sums.append(zlib.crc32(found.astype("<u4").tobytes()))
                before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                n = len(ids)
                columns = (ids, [shard] * n, range(n), [part] * n, before, sizes, sums)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=DOC_FIELDS)

    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    found = mapped(shards.select("doc_ids", "shard", "part", "blob"), read, DOCS)
    # starts: running sums of the shards of a part, and of the parts
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("part_"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_part"))
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.col("shard").alias("shard_"), F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("before_shard"))
    starts = starts.join(parts, F.col("part") == F.col("part_")).select("shard_", (F.col("before_part") + F.col("before_shard")).alias("before"))
    joined = found.join(starts, F.col("shard") == F.col("shard_"))
    return joined.select("doc_id", "shard", "place", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, folder: str, shard: int, place: int) -> list[int]:
    """Ids of one document, end id included, found through the index."""
    dictionary = _dictionary(spark, folder)
    row = spark.read.schema(SHARDS).parquet(f"{folder}/shards").where(F.col("shard") == shard).select("blob").first()
    return read_frame(bytes(row["blob"]), place, _codec(dictionary)[1], hashlib.sha256(dictionary).digest()).tolist()


def new_folder(shared: str) -> str:
    return f"{shared}/tokens-{uuid.uuid4().hex}"
