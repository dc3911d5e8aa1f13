"""Token ids of documents in packed binary files, and the way back.

A file holds the documents of one range of ids, in order:

    magic, bits, ids per block, documents, ids      header, 32 bytes
    blocks of ids                                   each id in ``bits`` bits, low bit first
    null flags, document ids, starts, block offsets trailer
    place of the trailer, magic                     footer, 16 bytes

``bits`` is the least that the vocabulary needs. A block starts on a byte, and its
offset is in the trailer, so any document is read by unpacking only its blocks, with
numpy. Numbers are little-endian.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from presswork.llm import common as C
from presswork.session import scratch_path

MAGIC = b"TOKPACK1"
BLOCK = 4096
HEADER, FOOTER = 32, 16
END_ID = 0
# Words whose ids a worker remembers.
REMEMBERED = 1_000_000


# -- bits -----------------------------------------------------------------------

def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Unsigned 32-bit ids, each in ``bits`` bits, low bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(flat[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


# -- files ----------------------------------------------------------------------

class TokenWriter:
    """Writes one file; ids arrive document by document."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.system, self.path = fs.FileSystem.from_uri(uri)
        self.bits, self.block = bits, block
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.starts, self.offsets = [0], [HEADER]
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.out = self.system.open_output_stream(self.path)
        self.out.write(self._header(0, 0))

    def _header(self, docs: int, ids: int) -> bytes:
        return MAGIC + np.array([self.bits, self.block], "<u4").tobytes() + np.array([docs, ids], "<u8").tobytes()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * self.block:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate([np.zeros(0, "<u2"), *self.pending])
        ready = len(ids) if whole else len(ids) - len(ids) % self.block
        for i in range(0, ready, self.block):
            data = pack(ids[i:min(i + self.block, ready)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.pending, self.waiting = [ids[ready:]], len(ids) - ready

    def close(self) -> tuple[int, int]:
        """Finish the file; its number of documents and ids."""
        self._flush(whole=True)
        trailer = self.offsets[-1]
        counts = np.array([len(self.doc_ids), self.starts[-1]], "<u8").tobytes()
        self.out.write(counts + np.array(self.nulls, np.uint8).tobytes() + np.array(self.doc_ids, "<i8").tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([trailer], "<u8").tobytes() + MAGIC)
        self.out.close()
        return len(self.doc_ids), self.starts[-1]


class TokenFile:
    """Reads one file, in whole or at any document."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        head, foot = self.file.read_at(HEADER, 0), self.file.read_at(FOOTER, size - FOOTER)
        if head[:8] != MAGIC or foot[8:] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.bits, self.block = map(int, np.frombuffer(head, "<u4", 2, 8))
        trailer = int(np.frombuffer(foot, "<u8", 1)[0])
        data = self.file.read_at(size - FOOTER - trailer, trailer)
        self.docs, self.n_ids = map(int, np.frombuffer(data, "<u8", 2))
        at = 16
        self.nulls = np.frombuffer(data, np.uint8, self.docs, at)
        self.doc_ids = np.frombuffer(data, "<i8", self.docs, at := at + self.docs)
        self.starts = np.frombuffer(data, "<u8", self.docs + 1, at := at + 8 * self.docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", -(-self.n_ids // self.block) + 1, at + 8 * self.docs + 8).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; only their blocks are read."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, -(-end // self.block)
        data = self.file.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        base, parts = int(self.offsets[first]), []
        for k in range(first, last):
            count = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(data[self.offsets[k] - base:self.offsets[k + 1] - base], count, self.bits))
        return np.concatenate(parts)[start - first * self.block:end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document: id, start in the file, ids. Reads about ``most`` ids at once."""
        first = 0
        while first < self.docs:
            last = int(np.searchsorted(self.starts, self.starts[first] + most, "right")) - 1
            last = min(max(last, first + 1), self.docs)
            base = int(self.starts[first])
            ids = self.ids(base, int(self.starts[last]))
            for i in range(first, last):
                start, end = int(self.starts[i]), int(self.starts[i + 1])
                yield (None if self.nulls[i] else int(self.doc_ids[i])), start, ids[start - base:end - base]
            first = last


# -- encoding ---------------------------------------------------------------------

# A single space between two characters that are no white space is a border of the
# tokenizer's words, so what stands between such spaces is encoded on its own.
_BORDER = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r" \s|\s |\A | \Z")
# White space beside " " and "\n".
_RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
# So is a single line end between such characters, itself a word; and a point or comma
# behind letters starts a word.
_LINE_END = re.compile(r"(?<=\S)\n(?=\S)")
_MARKS = (".", ",")
# Words given to the tokenizer at once.
_AT_ONCE = 4096


def _single_spaced(text: str) -> bool:
    """Whether each space of a text is a border; the pattern is only asked where plain searches can't tell."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text:
        return False
    for c in _RARE_SPACES:
        if c in text:
            return not _OTHER_SPACE.search(text)
    return True


class WordEncoder:
    """Ids of whole texts; the ids of words seen before are looked up.

    The ids are exactly those of ``Tokenizer.encode`` on the whole text, for byte-level
    BPE files whose word pattern takes one leading space into a word. A worker process
    keeps its encoder from task to task and remembers the first ``REMEMBERED`` words;
    others are encoded each time.
    """

    _of_worker: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.bits = bits_for(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.kind = "H" if self.bits <= 16 else "I"
        self.known: dict[str, bytes] = {}   # by the word behind a space
        self.bare: dict[str, bytes] = {}    # by the word without one
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin with a space
        self.spaced[[i for token, i in vocabulary.items() if token[:1] == "Ġ"]] = True
        self.fixed = {word: self._one(word) for word in ("\n", *_MARKS)}
        line_end = np.frombuffer(self.fixed["\n"], self._dtype())
        self.line_end = int(line_end[0]) if len(line_end) == 1 else None

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        if path not in cls._of_worker:
            cls._of_worker[path] = cls(path)
        return cls._of_worker[path]

    def _dtype(self) -> str:
        return f"<u{array(self.kind).itemsize}"

    def _one(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _encoded(self, words: list[str], behind: bool) -> dict[str, bytes]:
        """Ids of each word, behind a space or not.

        Words without white space are given to the tokenizer as one text, between borders
        where its ids are cut again: before ids that begin with a space, at line ends.
        """
        out, whole = {}, []
        for word in words:
            if (behind or self.line_end is not None) and word.split() == [word]:
                whole.append(word)
            else:
                out[word] = self._one(" " + word if behind else word)
        for i in range(0, len(whole), _AT_ONCE):
            out.update(self._together(whole[i:i + _AT_ONCE], behind))
        return out

    def _together(self, words: list[str], behind: bool) -> dict[str, bytes]:
        text = " " + " ".join(words) if behind else "\n".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self._dtype())
        if behind:
            starts = np.flatnonzero(self.spaced[ids])
            ends = np.append(starts[1:], len(ids))
        else:
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            starts = np.append(0, ends[:-1] + 1)
        if len(starts) != len(words) or starts[0]:  # white space of the tokenizer that Python doesn't know
            return {word: self._one(" " + word if behind else word) for word in words}
        data, size = ids.tobytes(), ids.itemsize
        return {word: data[a:b] for word, a, b in zip(words, (starts * size).tolist(), (ends * size).tolist())}

    def _learnt(self, words: set[str], spaced: bool) -> dict[str, bytes]:
        """Ids of words that were not found, put together from smaller ones where borders allow."""
        own, parts = self.known if spaced else self.bare, {}
        wanted: dict[bool, set[str]] = {False: set(), True: set()}
        for word in words:
            if "\n" in word or word[-1:] in _MARKS:
                parts[word] = [
                    (part[:-1], part[-1]) if part[-1:] in _MARKS and part[:-1].isalpha() else (part, "")
                    for part in _LINE_END.split(word)]
            elif word not in own:
                wanted[spaced].add(word)
        for rows in parts.values():
            for i, (base, _) in enumerate(rows):
                behind = spaced and i == 0
                if base not in (self.known if behind else self.bare):
                    wanted[behind].add(base)
        new = {behind: self._encoded(list(bases), behind) for behind, bases in wanted.items()}
        if len(self.bare) + len(new[False]) <= REMEMBERED // 4:
            self.bare.update(new[False])

        def code(base: str, behind: bool) -> bytes:
            got = new[behind].get(base)
            return (self.known if behind else self.bare)[base] if got is None else got

        out = dict(new[True])
        for word in words:
            if word not in parts:
                out[word] = code(word, spaced)
        for word, rows in parts.items():
            run = []
            for i, (base, mark) in enumerate(rows):
                if i:
                    run.append(self.fixed["\n"])
                run.append(code(base, spaced and i == 0))
                if mark:
                    run.append(self.fixed[mark])
            out[word] = b"".join(run)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned and as wide as the vocabulary needs."""
        split = [t.split(" ") if _single_spaced(t) else _BORDER.split(t) for t in texts]
        heads = self._learnt({words[0] for words in split}, spaced=False)
        known, out, late, unknown = self.known, [], [], set()
        for row, words in enumerate(split):
            got = list(map(known.get, words))
            got[0] = heads[words[0]]
            try:
                out.append(b"".join(got))
            except TypeError:  # a word that is not known yet
                out.append(b"")
                late.append((row, got))
                unknown.update(w for w, g in zip(words, got) if g is None)
        fresh = self._learnt(unknown, spaced=True)
        for row, got in late:
            out[row] = b"".join([fresh[w] if g is None else g for w, g in zip(split[row], got)])
        if len(known) + len(fresh) <= REMEMBERED:
            known.update((w, c) for w, c in fresh.items() if "\n" not in w)
        return [np.frombuffer(ids, self._dtype()) for ids in out]


def _writer(folder: str, path: str, end_id: int, block: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, encoder = TaskContext.get().partitionId(), None, None
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            _, offsets = C.utf8(batch.column(1))
            for first, last in C.slices(offsets):
                if out is None:
                    encoder = WordEncoder.of_worker(path)
                    uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                    out = TokenWriter(uri, encoder.bits, block)
                texts = [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]
                for doc_id, ids in zip(doc_ids[first:last], encoder.encode(texts)):
                    out.add(doc_id, np.append(ids, ids.dtype.type(end_id)))
        if out is not None:
            docs, ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [uri], "n_docs": [docs], "n_ids": [ids]})
    return write


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None,
                 end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into token files; the manifest of the files.

    Documents stand in ascending order of ``doc_id``, nulls first, rows with one id in
    a fixed order; each ends with ``end_id``. A null text is empty. Manifest columns:
    ``part`` (order of the files), ``file``, ``n_docs``, ``n_ids``. A task that runs
    again writes another file; only files of the manifest count. An empty table has an
    empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text")
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc(), tie).sortWithinPartitions(F.col("doc_id").asc(), tie)
    return C.staged(ordered.mapInArrow(
        _writer(folder, tokenizer_path, end_id, block), "part long, file string, n_docs long, n_ids long"),
        "token-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = [(doc_id, base + start, len(ids), zlib.crc32(ids.tobytes()))
                    for doc_id, start, ids in TokenFile(file).documents()]
            doc_id, start, n, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (doc_id, start, n, crc)],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(manifest: DataFrame) -> DataFrame:
    """Read all files back: ``doc_id, start, n_tokens, ids_crc32`` for each document.

    ``start`` counts the ids of all documents before it. Only the manifest, a row for
    each file, is ordered in one place.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
