"""Token ids of a corpus as Arrow stream files of equal-length sequences.

Documents are put in ascending id order over range partitions; each partition encodes its texts, appends the end id to each,
and packs the ids into sequences of ``LENGTH`` as fixed-size lists with a mask of the places that hold an id. A partition
writes two streams: the sequences, and the ids and lengths of its documents. The batches are uncompressed, so a reader that
maps a file gets every sequence in place, without copying, by its number alone.

Files are written under a name of the attempt and then renamed, so a task that runs again after a lost executor leaves the same
file. Null ids come first and equal ids are ordered by text. A null text is empty: only its end id. An empty table gives no rows.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import texts as T

LENGTH = 1024
END = 2
#: Sequences in a batch of a file; pieces of text whose ids a worker keeps, of those met again and of those met once.
BATCH = 512
KEPT = 200_000
FRESH = 100_000
#: Short pieces between letters (marks, line ends, digits) whose ids a worker keeps.
MARKS, MARK = 10_000, 8

_PAIR = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s)(?= )")
_ENDED = re.compile(r"([^\W\d_]+)([^\w\s'’].*|[ \t-\r].*)", re.S)
_FINE = re.compile(r"(?<=[^\W\d_])(?=[^\w\s'’])|(?<=\S)(?=[ \t-\r])|(?<=\S\n)(?=\S)")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b if b in plain else 256 + others.index(b)) for b in range(256)}


class Encoder:
    """Ids of whole texts, as the tokenizer's plain call gives them.

    Texts are first cut at the literals of added tokens, as the tokenizer does. A blank after a character that is none always
    begins a new piece of its pre-tokenization, so what lies between is cut there and the ids of pieces are kept. Pieces met in one
    call only are forgotten when there are ``FRESH`` of them; ``KEPT`` of those met again stay. A piece that is not kept is cut further
    where pre-tokenization certainly cuts: after a letter before a mark, before white space, after a lone line end. What remains as
    letters alone goes to the tokenizer's model directly, anything else through the whole tokenizer.

    Pieces are kept by what follows their leading blank; a text's first piece, which has none, as a tuple.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = re.compile("|".join(re.escape(t.content) for t in added)) if added else None
        self.kept: dict = {}
        self.fresh: set = set()
        self.marks: dict = {}

    def pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All pieces one after another without their leading blanks, and where each text's begin; its first has none."""
        def apart(text: str) -> list[str]:
            first, *rest = _CUT.split(text)
            return [first, *(x[1:] for x in rest)]

        plain = [not _PAIR.search(x) for x in texts]
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        if not all(plain):
            others = [None if p else apart(x) for p, x in zip(plain, texts, strict=True)]
            lists = pc.if_else(pa.array(plain), lists, pa.array(others, lists.type))
        return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])

    def _model(self, letters: str, blank: bool) -> bytes:
        """Ids of letters, with or without a blank before them; they are one piece of the pre-tokenization."""
        plain = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(self.letters[32] + plain if blank else plain)]).tobytes()

    def encode_pieces(self, lacking: list) -> None:
        """Puts pieces among those kept."""
        kept, marks, letters, ended, whole = self.kept, self.marks, self._model, _ENDED.fullmatch, set()
        cut: dict = {}
        for x in lacking:
            if x.__class__ is str:
                if x.isalpha():
                    if x not in kept:  # as another's letters
                        kept[x] = letters(x, True)
                    continue
                if (parted := ended(x)) and (mark := marks.get(parted[2])) is not None and parted[1].isalpha():
                    body = parted[1]
                    found = kept.get(body)
                    if found is None:
                        found = kept[body] = letters(body, True)
                        self.fresh.add(body)
                    kept[x] = found + mark
                    continue
            cut[x] = parts = []
            for y in _FINE.split(" " + x if x.__class__ is str else x[0]):
                if not y:
                    continue
                blank = y[0] == " "
                key = y[1:] if blank else (y,)
                parts.append((y, key))
                if y in marks or key in kept:
                    continue
                if (key if blank else y).isalpha():
                    kept[key] = letters(key if blank else y, blank)
                    self.fresh.add(key)
                else:
                    whole.add(y)
        texts, own = list(whole), {}
        for i in range(0, len(texts), 1000):
            part = texts[i : i + 1000]
            for y, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                own[y] = array("H", e.ids).tobytes()
        for x, parts in cut.items():
            kept[x] = b"".join([marks[y] if y in marks else own[y] if y in own else kept[key] for y, key in parts])
        if len(marks) < MARKS:
            marks.update((y, e) for y, e in own.items() if len(y) <= MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Nothing here refers to itself, and passes of the collector over all kept pieces would cost a fifth of the time."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        cut, ends = [], []
        for text in texts:
            if self.added is not None and (marks := self.added.findall(text)):
                for mark, between in zip([None, *marks], self.added.split(text), strict=True):
                    if mark is not None:
                        cut.append((mark, True))
                    cut.append((between, False))
            else:
                cut.append((text, False))
            ends.append(len(cut))
        ids = iter(self._between([x for x, mark in cut if not mark]))
        number = lambda mark: np.array([self.tokenizer.token_to_id(mark)], np.uint16)
        made = [number(x) if mark else next(ids) for x, mark in cut]
        return [made[a] if b == a + 1 else np.concatenate(made[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _between(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens. Arrow numbers their pieces, so that each unlike piece is looked up once."""
        if not texts:
            return []
        flat, starts = self.pieces(texts)
        coded = flat.dictionary_encode()
        at, used = coded.indices.to_numpy().copy(), np.zeros(len(coded.dictionary), bool)
        firsts = flat.take(pa.array(starts[:-1])).to_numpy(zero_copy_only=False).tolist()
        at[starts[:-1]] = -1
        used[at[at >= 0]] = True
        words = coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        at[at >= 0] = (np.cumsum(used) - 1)[at[at >= 0]]
        at[starts[:-1]] = np.arange(len(words), len(words) + len(firsts))
        keys = [*words, *((x,) for x in firsts)]
        self.fresh.difference_update(keys)
        if len(self.fresh) > FRESH:
            for x in self.fresh:
                del self.kept[x]
            self.fresh = set()
        if len(self.kept) > FRESH + KEPT:
            self.kept, self.fresh = {}, set()
        made = list(map(self.kept.get, keys))
        lacking = {x: None for x, ids in zip(keys, made, strict=True) if ids is None}
        self.fresh.update(lacking)
        self.encode_pieces(list(lacking))
        made = [self.kept[x] if ids is None else ids for x, ids in zip(keys, made, strict=True)]
        taken = pa.array(made, pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // 2
        ids = np.frombuffer(taken.buffers()[2], np.uint16)
        return [ids[a:b] for a, b in zip(ends[starts[:-1]].tolist(), ends[starts[1:]].tolist(), strict=True)]


def encoder_of(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    store = T.worker_store()
    if f"encoder {path}" not in store:
        store[f"encoder {path}"] = Encoder(path)
    return store[f"encoder {path}"]


def drop_encoders() -> None:
    """When files are read, the encoders that wrote them are over; later steps share the memory with this worker."""
    store = T.worker_store()
    for name in [x for x in store if x.startswith("encoder ")]:
        del store[name]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def file_schema(length: int = LENGTH) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """The two streams of one partition, published under their names when they are whole."""

    def __init__(self, folder: str, part: int, length: int):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base)
        self.names = [f"{base}/part-{part:05d}.{kind}.arrows" for kind in ("seq", "doc")]
        self.temp = [f"{x}.{uuid.uuid4().hex}" for x in self.names]
        self.sinks = [self.fs.open_output_stream(x) for x in self.temp]
        self.schema, self.length = file_schema(length), length
        self.streams = [pa.ipc.new_stream(s, schema) for s, schema in zip(self.sinks, (self.schema, DOCS), strict=True)]
        self.waiting, self.n, self.total, self.docs = [], 0, 0, 0

    def add(self, doc_ids: list, ids: list[np.ndarray]):
        self.streams[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in ids], pa.int64())], schema=DOCS))
        self.waiting += ids
        self.n += sum(map(len, ids))
        self.total += sum(map(len, ids))
        self.docs += len(ids)
        if self.n >= BATCH * self.length:
            self._put(False)

    def _put(self, last: bool):
        flat = np.concatenate([np.zeros(0, np.uint16), *self.waiting])
        size, at = self.length, 0
        while len(flat) - at >= BATCH * size or last and at < len(flat):
            part = flat[at : at + BATCH * size]
            rows = -(-len(part) // size)
            full = np.zeros(rows * size, np.uint16)
            full[: len(part)] = part
            mask = pa.array(np.arange(rows * size) < len(part))
            lists = [pa.FixedSizeListArray.from_arrays(x, size) for x in (pa.array(full), mask)]
            self.streams[0].write_batch(pa.record_batch(lists, schema=self.schema))
            at += len(part)
        self.waiting, self.n = [flat[at:]], len(flat) - at

    def close(self):
        self._put(True)
        for stream, sink in zip(self.streams, self.sinks, strict=True):
            stream.close()
            sink.close()
        for temp, name in zip(self.temp, self.names, strict=True):
            self.fs.move(temp, name)


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, length: int = LENGTH) -> tuple[str, DataFrame]:
    """Writes the files; returns their folder and a row for each file: part, docs, ids."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/crossweave/tokens-{uuid.uuid4().hex}"
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = re.sub(r"^file:/+", "file:///", uri)
    path = path or default_path()

    def run(batches):
        encoder, writer = encoder_of(path), None
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(1), 4 * T.SLICE):
                if writer is None:
                    writer = _Writer(uri, TaskContext.get().partitionId(), length)
                texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                end = np.array([END], np.uint16)
                writer.add(batch.column(0).slice(lo, hi - lo).to_pylist(), [np.concatenate([x, end]) for x in encoder.encode(texts)])
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([writer.docs], pa.int64()), pa.array([writer.total], pa.int64())], names=["part", "docs", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with T.small_batches(spark):
        made = T.over_batches(ordered, run, "part long, docs long, ids long").toArrow()  # one row a file
    return uri, spark.createDataFrame(made)  # as Arrow: rows would start other workers


def sequences(file, length: int = LENGTH):
    """The record batches of a stream that is mapped into memory; each batch but the last has ``BATCH`` rows."""
    return pa.ipc.open_stream(file)


def read(folder: str, files: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches):
        from pyarrow import fs

        drop_encoders()
        where, base = fs.FileSystem.from_uri(folder)
        local = isinstance(where, fs.LocalFileSystem)

        def opened(name):
            return pa.memory_map(name) if local else where.open_input_file(name)

        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(f"{base}/part-{part:05d}.seq.arrows") as seq, opened(f"{base}/part-{part:05d}.doc.arrows") as doc:
                    held, runs = np.zeros(0, np.uint16), (np.asarray(b.column(0).flatten()) for b in pa.ipc.open_stream(seq))
                    for rows in pa.ipc.open_stream(doc):
                        lengths = rows.column(1).to_numpy()
                        pieces, have, need = [held], len(held), int(lengths.sum())
                        while have < need:
                            pieces.append(next(runs))
                            have += len(pieces[-1])
                        ids = np.concatenate(pieces) if len(pieces) > 1 else held
                        ends = np.cumsum(lengths)
                        sums = [zlib.crc32(ids[e - n : e].astype("<u4")) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                        yield pa.record_batch([rows.column(0), pa.array(start + ends - lengths, pa.int64()), rows.column(1), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        held, start = ids[need:], start + need

    at = files.select("part", before.alias("start")).repartition(max(1, files.count()), "part")
    return T.over_batches(at, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read(*write(docs, path=path))
