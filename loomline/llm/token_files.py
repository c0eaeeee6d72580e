"""Token-id files: one zstandard frame per document, all by one trained dictionary.

File: ``TOKZ1``, the dictionary's SHA-256, the frames, the index, and a footer (index place, number of
documents). The index has for each document its id, frame place and size, and number of ids, so a short document is
read by one seek. The dictionary lies beside the files as ``dictionary``; a reader refuses files of another one.

The dictionary is trained on stretches of about ``SAMPLE_DOCS`` documents, long ones too, those with the smallest hashes
of id and text; a table of too few texts gets an empty one, with a warning. Everything else covers all rows. Documents are in ascending id order over the files.

Defined cases: a null text is an empty one and holds the end id alone; a null id comes first and stays null; rows of
one id follow each other; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import warnings

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.files import locate, written_whole
from loomline.llm.tokens import default_tokenizer, encoder
from loomline.session import shuffle_width

MAGIC = b"TOKZ1\n"
FOOTER = "<QQ"
INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("place", "<u8"), ("size", "<u4"), ("n", "<u8")])
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEAST_DICTIONARY_BYTES = 1000, 4096, 32 << 10, 1 << 10
BATCH_BYTES = 8 << 20


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary of serialized id arrays; empty, with a warning, when there are too few texts for one.

    The sample: texts chosen by hash of id and text, equal ones once, of each a stretch of at most ``SAMPLE_CHARS``
    characters from a place that its hash names. So it holds at most ``2 * SAMPLE_DOCS * SAMPLE_CHARS`` characters.
    """
    filled = docs.filter(F.length("text") > 0)
    share = SAMPLE_DOCS / max(1, filled.count())
    border = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1))
    chosen = filled.filter(F.xxhash64("doc_id", "text") <= border)
    some = chosen.select(F.substring("text", place.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text")).distinct().limit(2 * SAMPLE_DOCS).collect()
    encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
    samples = [encode(text) + end for text in sorted(r.text for r in some)]
    size = min(DICTIONARY_BYTES, max(LEAST_DICTIONARY_BYTES, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError) as error:
        warnings.warn(f"token files get no dictionary: {len(samples)} sampled texts train none ({error})", stacklevel=2)
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, level: int = 3,
                      id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Writes the files; returns (file, documents, ids) of each, in order (one for each shuffle partition at most)."""
    path = tokenizer or default_tokenizer()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    trained = train_dictionary(picked, path, end_id)
    with written_whole(f"{folder}/dictionary") as out:
        out.write(trained)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = picked.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    end = end_id.to_bytes(4, "little")

    def write(batches):
        part = TaskContext.get().partitionId()
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        encode = encoder(path)
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(trained), write_content_size=True)
        index, total, name = [], 0, f"{folder}/part-{part:07d}.tokz"
        with written_whole(name) as out:
            out.write(MAGIC + hashlib.sha256(trained).digest())
            place = len(MAGIC) + 32
            while batch is not None:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    ids = encode(text.as_py()) + end
                    frame, own = pack.compress(ids), doc.as_py()
                    index.append((own is not None, own or 0, place, len(frame), len(ids) // 4))
                    out.write(frame)
                    place += len(frame)
                    total += len(ids) // 4
                batch = next(batches, None)
            out.write(np.array(index, INDEX).tobytes())
            out.write(struct.pack(FOOTER, place, len(index)))
        yield pa.record_batch([[part], [name], [len(index)], [total]], names=["part", "file", "docs", "ids"])

    made = ordered.mapInArrow(write, "part long, file string, docs long, ids long").collect()
    return [(r.file, r.docs, r.ids) for r in sorted(made, key=lambda r: r.part)]


class TokenFile:
    """One file, opened for reading."""

    def __init__(self, uri: str):
        store, path = locate(uri)
        with store.open_input_stream(path.rpartition("/")[0] + "/dictionary", compression=None) as own:
            trained = own.read()
        self.stream = store.open_input_file(path)
        head = self.stream.read_at(len(MAGIC) + 32, 0)
        if head[:len(MAGIC)] != MAGIC or head[len(MAGIC):] != hashlib.sha256(trained).digest():
            raise ValueError(f"{uri}: no token file, or one of another dictionary")
        size = self.stream.size()
        place, n = struct.unpack(FOOTER, self.stream.read_at(16, size - 16))
        self.index = np.frombuffer(self.stream.read_at(n * INDEX.itemsize, place), INDEX)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(trained))

    def ids(self, row: int) -> bytes:
        entry = self.index[row]
        return self.unpack.decompress(self.stream.read_at(int(entry["size"]), int(entry["place"])))

    def find(self, doc_id: int) -> list[bytes]:
        """The ids of the document(s) of this id, by the index."""
        first = int((self.index["known"] == 0).sum())
        known = self.index["doc_id"][first:]
        lo, hi = np.searchsorted(known, doc_id, "left"), np.searchsorted(known, doc_id, "right")
        return [self.ids(first + i) for i in range(lo, hi)]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ``start`` counts the ids of all documents before."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    rows, start = [], 0
    for name, _, n in files:
        rows.append((name, start))
        start += n
    if not rows:
        return spark.createDataFrame([], schema)
    names = ["doc_id", "start", "n_tokens", "ids"]

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file, at, held, out = TokenFile(name), first, 0, []
                for row, entry in enumerate(file.index):
                    ids = file.ids(row)
                    if len(ids) != 4 * int(entry["n"]):
                        raise ValueError(f"{name}: document {row} has another number of ids than its index says")
                    out.append((int(entry["doc_id"]) if entry["known"] else None, at, len(ids) // 4, ids))
                    at += len(ids) // 4
                    held += len(ids)
                    if held > BATCH_BYTES or len(out) >= 5000:
                        yield _batch(out, names)
                        held, out = 0, []
                if out:
                    yield _batch(out, names)

    return spark.createDataFrame(rows, "file string, first long").repartition(len(rows)).mapInArrow(read, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
