"""Token ids in binary files, entropy coded with a static range asymmetric numeral system (rANS).

All ids of a corpus share one frequency table.  A file holds groups of whole documents, and a group
one or more independent blocks; a block interleaves ``LANES`` rANS states, so that a step codes as
many ids at once.  The footer has a checkpoint per block (offset, ids, documents, checksum): a reader
can start at any group, and ranges of groups are decoded in parallel.

File, little-endian: magic, frequency table (n, then symbol and frequency pairs), groups (documents'
ids and lengths as a compressed Arrow stream, then blocks), footer (checkpoints as a compressed Arrow
stream), footer's length and crc, magic.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

#: Fixed values of the file format.
MAGIC = b"CLRANS02"
SCALE_BITS = 20
LANES = 4096
LOW = np.uint64(1 << 31)

#: Ids in a block, and in a group unless a document has more; ids after which a file is closed.
BLOCK_IDS = 1 << 19
FILE_IDS = 1 << 28
#: Bytes of documents that are encoded at a time, so that words that repeat in them are looked up once.
ENCODE_BYTES = 8 << 20
#: Words whose ids a worker keeps, and their characters; beyond it the more frequent half stays.
CACHE_WORDS, CACHE_CHARS = 600_000, 16_000_000

MANIFEST = "path string, part int, at long, docs long, ids long, bytes long"
_MASK = np.uint64((1 << SCALE_BITS) - 1)
_S = np.uint64(SCALE_BITS)
_32 = np.uint64(32)


class Frequencies:
    """A table of frequencies that add up to 2**SCALE_BITS, every counted symbol at least 1."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray) -> None:
        self.symbols, self.freqs = symbols.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.freqs)[:-1]]).astype(np.uint64)
        top = int(self.symbols.max()) + 1
        self.f, self.c = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.f[self.symbols], self.c[self.symbols] = self.freqs, self.starts
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The symbol of each of the 2**SCALE_BITS slots."""
        if self._slots is None:
            self._slots = np.repeat(self.symbols, self.freqs.astype(np.int64))
        return self._slots

    @classmethod
    def counted(cls, symbols: np.ndarray, counts: np.ndarray) -> Frequencies:
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order].astype(np.float64)
        if len(symbols) > 1 << (SCALE_BITS - 1):
            raise ValueError("too many symbols for the table")
        f = np.maximum(1, np.floor(counts / counts.sum() * ((1 << SCALE_BITS) - len(symbols)))).astype(np.int64)
        f[f.argmax()] += (1 << SCALE_BITS) - f.sum()
        return cls(symbols, f)

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.symbols)) + np.stack([self.symbols, self.freqs.astype(np.uint32)], 1).astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Frequencies:
        pairs = np.frombuffer(data, "<u4", offset=4).reshape(-1, 2)
        return cls(pairs[:, 0], pairs[:, 1])


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    """The final states of the lanes, then 32-bit words in the order in which a decoder takes them."""
    x = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    for at in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
        s = ids[at : at + LANES]
        n = len(s)
        f, c, y = table.f[s], table.c[s], x[:n]
        full = y >= f << np.uint64(63 - SCALE_BITS)
        if full.any():
            words.append(y[full].astype("<u4"))
            y = np.where(full, y >> _32, y)
        q = y // f
        x[:n] = (q << _S) + (y - q * f) + c
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, table: Frequencies) -> np.ndarray:
    x = np.frombuffer(data, "<u8", LANES).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * LANES)
    slots, out, w = table.slots, np.empty(n, np.uint32), 0
    for at in range(0, n, LANES):
        y = x[: min(LANES, n - at)]
        low = y & _MASK
        s = slots[low]
        out[at : at + len(y)] = s
        y = table.f[s] * (y >> _S) + low - table.c[s]
        short = y < LOW
        if short.any():
            k = int(short.sum())
            y[short] = (y[short] << _32) | words[w : w + k]
            w += k
        x[: len(y)] = y
    if w != len(words) or not (x == LOW).all():
        raise ValueError("a block doesn't decode to its start")
    return out


#: White space besides blanks and line ends, and white space in runs: where a text may be split otherwise
#: than before each blank and line end.
_APART = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  | \n|\n\n|\n "


class _Numbers(dict):
    """Numbers of words in order of arrival; new ones are also put on a list."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    A byte-level BPE splits a text before each blank or line end that stands alone, so the ids of a
    text are those of its words, each with the white space before it.  The library encodes each word
    once while the worker remembers it.  Texts where that may not hold (other white space, white
    space in runs, special tokens) and vocabularies of other kinds are encoded whole.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit in 16 bits")
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        self.apart = "|".join([_APART, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.starts, self.lengths, self.seen = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars = 0

    def _trim(self) -> None:
        """Keep the more frequent half of the words, if they fit in half of the space."""
        order = np.argsort(-self.seen, kind="stable")[: CACHE_WORDS // 2]
        words, kept, seen, flat = list(self.numbers), np.sort(order), self.seen, self.flat
        starts, lengths = self.starts[kept], self.lengths[kept]
        self._forget()
        if sum(len(words[i]) for i in kept) > CACHE_CHARS // 2:
            return
        for n, i in enumerate(kept):
            self.numbers[words[i]] = n
            self.chars += len(words[i])
        self.flat, self.starts, self.lengths, self.seen = _gather(flat, starts, lengths), np.cumsum(lengths) - lengths, lengths, seen[kept] // 2

    def _learn(self) -> None:
        """Encode the new words in bulk."""
        new, ids, lengths = self.numbers.new, [self.flat], []
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            got = self.tokenizer.encode([w[1:] if w[:1] == "\r" else w if w[:1] == "\n" else " " + w for w in some], is_pretokenized=True, add_special_tokens=False)  # "\r" alone has no ids
            ids.append(np.array(got.ids, np.uint16))
            lengths.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
            self.chars += sum(map(len, some))
        self.flat = np.concatenate(ids)
        self.lengths = np.concatenate([self.lengths, *lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.numbers.new = []

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The 16-bit ids of all texts, one after the other, and each text's number of ids; null is empty."""
        if len(self.numbers) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._trim()
        texts = pc.fill_null(texts, "")
        apart = pc.match_substring_regex(texts, self.apart) if self.plain else pa.array(np.ones(len(texts), bool))
        whole = {i: np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint16) for i in np.flatnonzero(apart)}
        # a word stands for itself with a blank before it; one after a line end begins with that, and the
        # first one, which has nothing before it, begins with a return, which no text here has
        marked = pc.binary_join_element_wise("\r", pc.if_else(apart, "", texts), "")
        parts = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.new:
            self._learn()
        every = numbers[coded.indices.to_numpy()]
        self.seen[numbers] += np.bincount(coded.indices, minlength=len(words))
        lengths = self.lengths[every]
        out = _gather(self.flat, self.starts[every], lengths)
        upto = np.concatenate([[0], np.cumsum(lengths)])[parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()]
        counts = np.diff(upto, prepend=0)
        if whole:
            pieces, at = [], 0
            for i, ids in whole.items():
                pieces += [out[at : upto[i]], ids]
                at, counts[i] = upto[i], len(ids)
            out = np.concatenate([*pieces, out[at:]])
        return out, counts


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """The stretches of ``flat`` from ``starts`` with ``lengths``, one after the other."""
    out, at = np.empty(int(lengths.sum()), flat.dtype), 0
    for i in range(0, len(lengths), step):
        n = lengths[i : i + step]
        ends = np.cumsum(n)
        out[at : at + ends[-1]] = flat[np.repeat(starts[i : i + step] - (ends - n), n) + np.arange(ends[-1])]
        at += int(ends[-1])
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(tokenizer_file: str) -> Encoder:
    """The worker's one encoder for a file."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _no_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.Array]]:
    """The columns of batches, put together until they have ``size`` bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield [pa.concat_arrays(x) for x in zip(*(h.columns for h in held))]
            held, n = [], 0
    if held:
        yield [pa.concat_arrays(x) for x in zip(*(h.columns for h in held))]


#: Rows of the table of groups: documents as an Arrow stream (doc, n), ids as 16-bit numbers.  The last
#: row of a part has the counts of its ids instead.
GROUPS = "part int, at long, docs binary, ids binary, counts binary"


def tokenized(docs: DataFrame, tokenizer_file: str, end_id: int, partitions: int) -> DataFrame:
    """Groups (see ``GROUPS``) of whole documents in ascending doc_id order over parts and rows of a part;
    null first, ties by text.  A null text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder_of(tokenizer_file), TaskContext.get().partitionId(), 0
        total = np.zeros(1 << 16, np.int64)
        names, lengths, ids, held = [], [], [], 0

        def row(*values) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["part", "at", "docs", "ids", "counts"])

        def group() -> pa.RecordBatch:
            table = pa.table({"doc": pa.chunked_array(names), "n": np.concatenate(lengths)})
            return row(part, at, _ipc(table), np.concatenate(ids).astype("<u2").tobytes(), None)

        for docs_, texts in _gathered(batches, ENCODE_BYTES):
            got, n = encode(texts)
            got, n = np.insert(got, np.cumsum(n), end_id), n + 1
            total += np.bincount(got, minlength=1 << 16)
            ends, first, pos = np.cumsum(n), 0, 0
            while first < len(n):  # up to the document that fills the group
                last = min(len(n), int(np.searchsorted(ends, pos + BLOCK_IDS - held)) + 1)
                names.append(docs_.slice(first, last - first))
                lengths.append(n[first:last])
                ids.append(got[pos : ends[last - 1]])
                held += int(ends[last - 1]) - pos
                first, pos = last, int(ends[last - 1])
                if held >= BLOCK_IDS:
                    yield group()
                    names, lengths, ids, held = [], [], [], 0
                    at += 1
        if held:
            yield group()
        if total.any():
            yield row(part, -1, None, None, total.astype("<i8").tobytes())

    common.bounded_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id", F.crc32("text")).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, GROUPS)


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encode the texts of ``docs`` and write files of ids under ``path``; the manifest says in which order.

    Texts are tokenized once, into a table in the shared folder, and counted as they are; each stretch
    of that table that a task reads becomes a file, or several of ``FILE_IDS`` ids.  ``partitions`` is
    the number of tasks that tokenize; memory doesn't hang on it.
    """
    spark = docs.sparkSession
    partitions = partitions or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = common.shared_dir(spark, "token-ids")
    tokenized(docs, tokenizer_file, end_id, partitions).write.option("compression", "zstd").parquet(base)
    rows = spark.read.schema(GROUPS).parquet(base)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counts = rows.select("counts").filter("counts IS NOT NULL").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = counts.toArrow().sort_by("id")  # one row per id of the vocabulary, at most 65,536
    if not got.num_rows:
        return spark.createDataFrame([], MANIFEST)
    freq_bytes = spark.sparkContext.broadcast(Frequencies.counted(got["id"].to_numpy(), got["n"].to_numpy()).to_bytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task reads one or more stretches of the table, each in order: a file or more for each
        freqs, manifest = Frequencies.from_bytes(freq_bytes.value), []
        groups = (tuple(x.as_py() for x in row) for b in batches for row in zip(*b.columns))
        row = next(groups, None)
        while row is not None:
            part, first = row[0], row[1]
            # with the number of the try, so that a try never moves a file over another's; the manifest names one try's
            name = f"{path}/ids-{part:06d}-{first:012d}-{TaskContext.get().taskAttemptId()}.rans"
            made = (0, 0)

            def put(out) -> None:
                nonlocal row, made
                writer, at = FileWriter(out, freqs), first
                while row is not None and row[:2] == (part, at) and writer.ids < FILE_IDS:
                    writer.add(row[2], np.frombuffer(row[3], "<u2"))
                    row, at = next(groups, None), at + 1
                made = writer.close()

            size = common.publish(name, put)
            manifest.append((name, part, first, *made, size))
        if manifest:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*manifest), (pa.string(), pa.int32(), *[pa.int64()] * 4))], ["path", "part", "at", "docs", "ids", "bytes"]
            )

    rows.filter("counts IS NULL").select("part", "at", "docs", "ids").mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


#: Checkpoints: a block that opens a group has its documents' stream (``head`` bytes) before it.
_BLOCKS = pa.schema([("offset", pa.int64()), ("head", pa.int64()), ("bytes", pa.int64()), ("ids", pa.int64()), ("docs", pa.int64()), ("crc", pa.int64())])


class FileWriter:
    """Writes groups to a file, in blocks of ``BLOCK_IDS`` ids and a last one of up to twice as many."""

    def __init__(self, out, table: Frequencies) -> None:
        self.out, self.table = out, table
        head = table.to_bytes()
        out.write(MAGIC + struct.pack("<I", len(head)) + head)
        self.docs = self.ids = 0
        self.blocks: list[dict] = []

    def add(self, docs: bytes, ids: np.ndarray) -> None:
        n = _no_ipc(docs).num_rows
        for at in range(0, max(1, len(ids) // BLOCK_IDS) * BLOCK_IDS, BLOCK_IDS):
            part = ids[at : at + BLOCK_IDS if at + 2 * BLOCK_IDS <= len(ids) else None]
            head = b"" if at else docs
            data = head + encode_block(part, self.table)
            self.blocks.append({"offset": self.out.tell(), "head": len(head), "bytes": len(data), "ids": len(part), "docs": 0 if at else n, "crc": zlib.crc32(data)})
            self.out.write(data)
        self.docs += n
        self.ids += len(ids)

    def close(self) -> tuple[int, int]:
        footer = _ipc(pa.Table.from_pylist(self.blocks, schema=_BLOCKS))
        self.out.write(footer + struct.pack("<II", len(footer), zlib.crc32(footer)) + MAGIC)
        return self.docs, self.ids


def open_file(source) -> tuple[Frequencies, list[dict]]:
    """The table and the checkpoints of a file."""
    size = source.size()
    source.seek(0)
    if source.read(8) != MAGIC:
        raise ValueError("not a file of ids")
    table = Frequencies.from_bytes(source.read(struct.unpack("<I", source.read(4))[0]))
    source.seek(size - 16)
    length, crc = struct.unpack("<II", source.read(8))
    source.seek(size - 16 - length)
    footer = source.read(length)
    if zlib.crc32(footer) != crc:
        raise ValueError("checksum of the footer")
    return table, _no_ipc(footer).to_pylist()


def decode_groups(source, first: int = 0, last: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(documents (doc, n), ids) of the groups in blocks ``first`` to ``last`` - 1; ``first`` must open one."""
    table, blocks = open_file(source)
    docs, parts = None, []
    for k, b in enumerate(blocks[first:last], first):
        source.seek(b["offset"])
        data = source.read(b["bytes"])
        if zlib.crc32(data) != b["crc"]:
            raise ValueError(f"checksum of block {k}")
        if b["head"]:
            if parts:
                yield docs, np.concatenate(parts)
            docs, parts = _no_ipc(data[: b["head"]]), []
        parts.append(decode_block(data[b["head"] :], b["ids"], table))
    if parts:
        yield docs, np.concatenate(parts)


READ = "start long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, manifest: DataFrame, doc_id_type: str, blocks_per_task: int = 32, ids: bool = False) -> DataFrame:
    """Per document of the files in the manifest: doc_id, start, n_tokens, ids_crc32, and with ``ids`` the ids
    themselves, in no order.  Tasks get ranges of groups, so that large files are decoded by several.

    The driver holds a path and a number for each file of the manifest.
    """
    schema = f"doc_id {doc_id_type}, {READ}" + (", ids array<int>" if ids else "")
    per_part = manifest.orderBy("part", "at").select("path", "ids").toArrow().to_pylist()  # a row per file
    starts, total = [], 0
    for r in per_part:
        starts.append((r["path"], total))
        total += r["ids"]
    if not starts:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(starts, "path string, base long").repartition(min(len(starts), 4096))
    spans_schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64())])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, inner = common.filesystem(path)
                with fs.open_input_file(inner) as source:
                    blocks = open_file(source)[1]
                cuts = [k for k, x in enumerate(blocks) if x["head"]]
                cuts = [k for i, k in enumerate(cuts) if i == 0 or k // blocks_per_task != cuts[i - 1] // blocks_per_task]
                before = np.concatenate([[0], np.cumsum([x["ids"] for x in blocks])])
                rows = [{"path": path, "first": k, "last": e, "start": base + int(before[k])} for k, e in zip(cuts, [*cuts[1:], len(blocks)])]
                yield pa.RecordBatch.from_pylist(rows, schema=spans_schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, inner = common.filesystem(r["path"])
                start = r["start"]
                with fs.open_input_file(inner) as source:
                    for docs, got in decode_groups(source, r["first"], r["last"]):
                        n = docs["n"].to_numpy()
                        ends = np.cumsum(n)
                        data = memoryview(got.astype("<u4")).cast("B")
                        crcs = [zlib.crc32(data[4 * a : 4 * e]) for a, e in zip((ends - n).tolist(), ends.tolist())]
                        made = [docs["doc"].combine_chunks(), pa.array(start + ends - n), pa.array(n), pa.array(crcs, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if ids:
                            made.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), got.astype(np.int32)))
                            names.append("ids")
                        start += len(got)
                        yield pa.RecordBatch.from_arrays(made, names)

    spans = files.mapInArrow(ranges, "path string, first long, last long, start long")
    return spans.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(decode, schema)
