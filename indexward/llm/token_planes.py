"""Token ids in binary files of bit or byte planes.

Ids are cut into blocks of fixed size. A block is transposed into planes (one
per byte or bit of the ids), each plane is compressed with zstandard, and a
chunk index at the end of the file holds the place of every plane, so that any
block can be read alone.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from indexward.sources.scratch import materialize, qualified, scratch_path

from .common import Batches, one_task_each, remembers, slices
from .files import new_file, open_file

MAGIC = b"BITPLN01"
BLOCK_IDS = 1 << 16
#: New pieces that are encoded in one call.
LINES = 512
#: Pieces whose ids a Python process keeps (up to twice as many); bounds memory only.
REMEMBERED = 400_000


class BytePairIds:
    """Ids of whole texts by the tokenizers library.

    A byte-level tokenizer encodes the pieces of its pattern one by one. Texts of characters whose class does not depend on
    the Unicode version are cut here, and the library encodes each new piece once; all other texts go to it as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        state = json.loads(self.library.to_str())
        split = state["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.cuttable = bool(plain and state["normalizer"] is None)
        added = [t["content"] for t in state["added_tokens"]]
        sure = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xA0, 0x250))]
        one = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in chars)
        letter = [c for c in sure if unicodedata.category(c)[0] == "L"]
        number = [c for c in sure if unicodedata.category(c)[0] == "N"]
        space = [c for c in sure if c.isspace()]
        body = "'(?:s|t|re|ve|m|ll|d)| ?[{0}]+| ?[{1}]+| ?[^{2}{0}{1}]+|"
        # The same pieces twice: for the arrow library, of texts without two white spaces in a row, and for any text.
        self.single = body.format(one(letter), one(number), one(space)) + f"[{one(space)}]"
        plain = [re.escape("".join(chars)) for chars in (letter, number, space)]
        self.pieces = re.compile(body.format(*plain) + f"[{plain[2]}]+(?![^{plain[2]}])|[{plain[2]}]+").findall
        self.crowded = re.compile(f"[{plain[2]}](?:[{plain[2]}]|\\Z)").search
        self.special = re.compile("|".join([*map(re.escape, added), f"[^{re.escape(''.join(sure))}]"])).search
        line = self.library.encode("\n", add_special_tokens=False).ids if self.cuttable else []
        self.line = line[0] if len(line) == 1 else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _kind(self, text: str) -> int:
        """How a text is cut: 0 by the arrow library, 1 by the pattern, 2 not here: the tokenizers library must see it whole."""
        if not self.cuttable or self.special(text):
            return 2
        return int(self.crowded(text) is not None)

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = [self.known.get(p) for p in pieces]
        new = [p for p, f in zip(pieces, found) if f is None]
        if not new:
            return found
        fresh = {p: self.older[p] for p in new if p in self.older}
        rest = [p for p in new if p not in fresh]
        words = [p for p in rest if self.line is not None and not p.isspace()]
        for k in range(0, len(words), LINES):
            fresh.update(self._lines(words[k : k + LINES]))
        left = [p for p in rest if p not in fresh]
        fresh.update(zip(left, self._library(left)))
        self.known.update(fresh)
        return [fresh[p] if f is None else f for p, f in zip(pieces, found)]

    def _lines(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are no white space, encoded as the lines of one text and cut at the id of the line feed.

        The pattern takes a single line feed before them as a piece of its own.
        """
        data = self._library(["\n" + "\n".join(pieces)])[0]
        at = np.append(np.flatnonzero(np.frombuffer(data, "<u4") == self.line), len(data) // 4)
        if len(at) != len(pieces) + 1:
            return {}
        return {p: data[4 * a + 4 : 4 * b] for p, a, b in zip(pieces, at.tolist(), at[1:].tolist())}

    def _by_arrow(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of kind 0: pieces are cut and coded in columns, each distinct one is looked up once, ids are gathered by place."""
        marked = pc.replace_substring_regex(pa.array(texts, pa.large_string()), self.single, "\\0\x01")
        pieces = pc.split_pattern(marked, "\x01")
        coded = pieces.flatten().dictionary_encode()
        place, bounds = coded.indices.to_numpy(), pieces.offsets.to_numpy()
        ids = self._look_up(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        all_ids, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        many = size[place]
        ends = np.cumsum(many)
        out = all_ids[np.repeat(start[place] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[bounds]
        return [out[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        kinds = [self._kind(t) for t in texts]
        at = [[i for i, k in enumerate(kinds) if k == kind] for kind in range(3)]
        out: list[bytes] = [b""] * len(texts)
        if at[0]:
            for i, ids in zip(at[0], self._by_arrow([texts[i] for i in at[0]])):
                out[i] = ids
        for i in at[1]:
            cut = self.pieces(texts[i])
            distinct = list(dict.fromkeys(cut))
            known = dict(zip(distinct, self._look_up(distinct)))
            out[i] = b"".join([known[p] for p in cut])
        for i, ids in zip(at[2], self._library([texts[i] for i in at[2]])):
            out[i] = ids
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        return out


_encoders: dict[str, BytePairIds] = {}


def _encoder(path: str) -> BytePairIds:
    remembers("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = BytePairIds(path)
    return _encoders[path]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of a block of 32-bit ids."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block."""
    if kind == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(n)


class PlaneWriter:
    """Writes one file: blocks, documents, chunk index."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK_IDS, level: int = 1):
        self.out, self.kind, self.block = out, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.pending, self.n_pending, self.at, self.n_ids = [], 0, len(MAGIC), 0
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.docs: list[pa.RecordBatch] = []
        out.write(MAGIC)

    def add(self, ids: list[bytes], docs: pa.RecordBatch) -> None:
        """Documents in order: their ids, and a batch of ``doc_id, n_tokens``."""
        self.docs.append(docs)
        self.pending += ids
        self.n_pending += sum(map(len, ids)) // 4
        if self.n_pending >= self.block:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        end = len(ids) if rest else len(ids) - len(ids) % self.block
        for start in range(0, end, self.block):
            part = ids[start : min(start + self.block, end)]
            planes = [self.pack(p) for p in to_planes(part, self.kind)]
            self.chunks.append((self.at, len(part), list(map(len, planes))))
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.n_ids += end
        self.pending, self.n_pending = ([ids[end:].tobytes()] if end < len(ids) else []), len(ids) - end

    def close(self) -> int:
        """Number of ids in the file."""
        if self.n_pending:
            self._flush(True)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, self.docs[0].schema) as stream:
            for d in self.docs:
                stream.write_batch(d)
        docs = self.pack(sink.getvalue())
        index = self.pack(json.dumps({"kind": self.kind, "block": self.block, "chunks": self.chunks}).encode())
        self.out.write(docs)
        self.out.write(index)
        self.out.write(struct.pack("<QQ", len(docs), len(index)) + MAGIC)
        self.out.close()
        return self.n_ids


class PlaneReader:
    """Reads one file, by block or by document."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 24)
        tail = source.read(24)
        if tail[16:] != MAGIC:
            raise ValueError("not a token file")
        n_docs, n_index = struct.unpack("<QQ", tail[:16])
        self.unpack = zstandard.ZstdDecompressor().decompress
        source.seek(size - 24 - n_index - n_docs)
        both = source.read(n_docs + n_index)
        state = json.loads(self.unpack(both[n_docs:]))
        self.kind, self.block, self.chunks = state["kind"], state["block"], state["chunks"]
        self._docs = both[:n_docs]

    def docs(self) -> Iterator[pa.RecordBatch]:
        """Batches of ``doc_id, n_tokens``."""
        yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().stream_reader(self._docs).read())

    def chunk(self, k: int) -> np.ndarray:
        """Ids of block ``k``."""
        at, n, lengths = self.chunks[k]
        self.source.seek(at)
        data = self.source.read(sum(lengths))
        planes, p = [], 0
        for length in lengths:
            planes.append(self.unpack(data[p : p + length]))
            p += length
        return from_planes(planes, n, self.kind)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file, from the blocks that hold them."""
        parts = [self.chunk(k) for k in range(start // self.block, (start + n - 1) // self.block + 1)] if n else []
        return np.concatenate(parts)[start % self.block : start % self.block + n] if parts else np.zeros(0, "<u4")


def write_tokens(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 0, folder: str | None = None,
    kind: str = "byte", block: int = BLOCK_IDS,
) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id``, and write files in ascending order of ``doc_id``.

    Returns the written files as rows ``path, part, n_docs, n_ids, base`` (``base``: ids in all files before). The ranges of
    ids become the files; null ids come first, and repeated ids are ordered by their text. Without documents there are no files.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "tokens"))
    ranged = (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text")
    )
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Batches) -> Batches:
        coder, writer, place, n_docs = _encoder(path), None, "", 0
        part = TaskContext.get().partitionId()
        for batch in slices(batches, 1024):
            if writer is None:
                out, place = new_file(folder, f"ids-{part:06d}", ".planes")
                writer = PlaneWriter(out, kind, block)
            ids = [i + end for i in coder.batch(batch.column("_text").to_pylist())]
            n_docs += len(ids)
            lengths = pa.array([len(i) // 4 for i in ids], pa.int64())
            writer.add(ids, pa.RecordBatch.from_arrays([batch.column("doc_id"), lengths], ["doc_id", "n_tokens"]))
        if writer:
            row = [[place], [part], [n_docs], [writer.close()]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["path", "part", "n_docs", "n_ids"])

    files = materialize(ranged.mapInArrow(write, "path string, part bigint, n_docs bigint, n_ids bigint"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint")))


def read_tokens(files: DataFrame, id_type: str = "bigint", with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids`` per document, from the files alone."""

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for place, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with open_file(place) as source:
                    reader = PlaneReader(source)
                    start, held, k = base, b"", 0
                    for docs in reader.docs():
                        lengths = docs.column("n_tokens").to_pylist()
                        out: list[bytes] = []
                        for n in lengths:
                            need, parts = 4 * n - len(held), [held]
                            while need > 0:
                                parts.append(reader.chunk(k).tobytes())
                                k, need = k + 1, need - len(parts[-1])
                            held = b"".join(parts) if len(parts) > 1 else held
                            out.append(held[: 4 * n])
                            held = held[4 * n :]
                        starts = start + np.concatenate([[0], np.cumsum(lengths)])
                        start = int(starts[-1])
                        columns = [docs.column("doc_id"), pa.array(starts[:-1], pa.int64()), docs.column("n_tokens"), pa.array([zlib.crc32(o) for o in out], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.array([np.frombuffer(o, "<u4").astype(np.int32) for o in out], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return one_task_each(files.select("path", "base"), "path").mapInArrow(read, schema)


def tokens_roundtrip(spark: SparkSession, docs: DataFrame, path: str, end_id: int | None = 0, with_ids: bool = False, **options) -> DataFrame:
    """Write the ids of all documents and read them back."""
    files = write_tokens(docs, path, end_id=end_id, **options)
    return read_tokens(files, dict(docs.dtypes)[options.get("doc_id", "doc_id")], with_ids)
