"""Token-id files: ids of many documents in one array, document bounds in Elias-Fano code.

File (little-endian): the ids of all documents one after another (2 bytes each if the vocabulary fits, else 4), then the
Elias-Fano sections of the document bounds and of the document ids, then a fixed footer. An Elias-Fano section of n
values up to u keeps floor(log2(u/n)) low bits of each value packed, the high parts in unary in a bit vector of at most
3n bits, and a 32-bit sample of the place of every ``SAMPLE``-th value, from which ``select`` scans on. Offsets within
a file fit 32 bits, as a file is closed with the document that reaches ``SHARD_TOKENS`` tokens, or ``SHARD_DOCS`` documents.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import struct
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quayside.llm.common import local_path, scratch, store, table

MAGIC = b"QSTOKEN1"
SAMPLE = 256
SHARD_TOKENS = 1 << 25
SHARD_DOCS = 1 << 20
PIECE = 1 << 16  # values packed at once
CACHE_WORDS = 250_000  # words kept by a worker, twice over, of CACHED_LENGTH characters at most
CACHED_LENGTH = 64
END_ID = 1


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    HEAD = struct.Struct("<QBxxxxxxxQQ")  # n, low bits, bytes of low part, bytes of high part

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        # A piece of a multiple of 8 values fills whole bytes.
        pieces = (v[i : i + PIECE] for i in range(0, n if bits else 0, PIECE))
        low = b"".join(np.packbits(((p[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for p in pieces)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        flags[at] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little").tobytes(), at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        return cls(n, bits, data[at : at + a], data[at + a : at + a + b], np.frombuffer(data, np.uint32, -(-n // SAMPLE), at + a + b))

    def _places(self, i: int, j: int) -> np.ndarray:
        """Bit places of the values i..j-1: from the sample before i, a window of bytes at a time."""
        k = i // SAMPLE
        at, skip, need, found = int(self.samples[k]), i - k * SAMPLE, j - k * SAMPLE, []
        byte, have = at // 8, 0
        while have < need:
            chunk = np.frombuffer(self.high, np.uint8, min(1 + (need - have) // 2 + 64, len(self.high) - byte), byte)
            if not len(chunk):
                raise ValueError("the high part ends before its values do")
            hit = np.nonzero(np.unpackbits(chunk, bitorder="little"))[0] + byte * 8
            hit = hit[hit >= at] if not found else hit
            found.append(hit)
            have += len(hit)
            byte += len(chunk)
        return np.concatenate(found)[skip:need]

    def slice(self, i: int, j: int) -> np.ndarray:
        """The values i..j-1 as uint64."""
        if i >= j:
            return np.zeros(0, np.uint64)
        high = self._places(i, j) - np.arange(i, j)
        if not self.low_bits:
            return high.astype(np.uint64)
        first, end = i * self.low_bits, j * self.low_bits
        raw = np.unpackbits(np.frombuffer(self.low, np.uint8)[first // 8 : -(-end // 8)], bitorder="little")[first % 8 :][: end - first]
        low = (raw.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | low

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


FOOT = struct.Struct("<QQqQQIB3x8s")  # documents, null ids, smallest id, bytes of bounds, bytes of ids, crc of both, id width


class Writer:
    """Documents in ascending id order, null ids first."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.bounds, self.ids, self.nulls, self.total = array.array("q", [0]), array.array("q"), 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.total += len(ids) // self.width
        self.bounds.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> None:
        base = self.ids[0] if self.ids else 0
        a = EliasFano.of(self.bounds).to_bytes()
        b = EliasFano.of(np.asarray(self.ids, np.int64) - base).to_bytes()
        self.out.write(a + b + FOOT.pack(len(self.bounds) - 1, self.nulls, base, len(a), len(b), zlib.crc32(a + b), self.width, MAGIC))
        self.out.close()


class Reader:
    """Random access to a token file: ``bounds`` and ``doc_ids`` by position, ``tokens`` of a range of documents."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOT.size)
        self.n, self.nulls, self.base, a, b, crc, self.width, magic = FOOT.unpack(source.read(FOOT.size))
        source.seek(size - FOOT.size - a - b)
        tail = source.read(a + b)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a whole token file")
        self.bounds, self.keys = EliasFano.from_bytes(tail[:a]), EliasFano.from_bytes(tail[a:])

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        own = self.keys.slice(max(i, self.nulls) - self.nulls, max(j, self.nulls) - self.nulls)
        return [None] * (min(j, self.nulls) - min(i, self.nulls)) + [self.base + int(x) for x in own]

    def tokens(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds i..j of documents i..j-1 in the file and the ids between the first and the last."""
        at = self.bounds.slice(i, j + 1).astype(np.int64)
        self.source.seek(int(at[0]) * self.width)
        raw = self.source.read(int(at[-1] - at[0]) * self.width)
        return at, np.frombuffer(raw, f"<u{self.width}")


class Words(dict):
    """Packed ids by word: a missing one is taken from the dictionary before this one, or worked out."""

    def __init__(self, make, before):
        super().__init__()
        self.make, self.before = make, dict(before)

    def __missing__(self, word):
        got = self.before.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = got
        return got


class WordEncoder:
    """Ids of a text by a tokenizers file whose pieces never span white space.

    Each word between white space is encoded once and kept, by its pieces, each of which goes through the model once.
    This takes the file's normalizer (NFC, lower case) and splitter (as in ``SPLIT``) to be those that it checks for, and
    only characters of ``BLOCKS`` that the library itself lowers and splits as Python does, which is tried for each. A text
    with other characters, with one of the tokenizer's special strings, or not in NFC is encoded in one piece by the
    library.
    """

    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed value: the file's own pattern

    BLOCKS = [(0, 0x3100), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xFE00, 0xFE10), (0xFF00, 0xFFF0), (0x1F300, 0x1FB00)]
    BY_PLACE = {0x130, 0x3A3}  # their lower case depends on the characters around

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        steps = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        split = own["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        if own["normalizer"]["normalizers"] != steps or split != self.SPLIT:
            raise ValueError("a tokenizer with another normalizer or splitter")
        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        specials = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.split = regex.compile(self.SPLIT)
        # Byte-level pieces: printable bytes stand for themselves, the others for the characters from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.chars = [rest.get(b) or chr(b) for b in range(256)]
        self.pieces, self.words = Words(self._piece, {}), Words(self._word, {})
        same = [c for a, b in self.BLOCKS for c in range(a, b) if c not in self.BY_PLACE and self._as_python(chr(c))]
        starts = [c for k, c in enumerate(same) if not k or same[k - 1] != c - 1]
        ends = [c for k, c in enumerate(same) if k + 1 == len(same) or same[k + 1] != c + 1]
        others = "[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends)) + "]"
        self.odd = re.compile("|".join([others, *specials]))

    def _as_python(self, c: str) -> bool:
        """Whether the library normalizes and splits a character as this class does, between others and beside itself."""
        text = f"a{c}{c}1{c}"
        mine = text.lower().split()
        theirs = self.tok.normalizer.normalize_str(text)
        pieces = ["".join([self.chars[b] for b in p.encode()]) for w in mine for p in self.split.findall(w)]
        return theirs.split(" ") in (mine, [*mine, ""]) and [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(theirs)] == pieces

    def pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def whole(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        return self.pack([t.id for t in self.tok.model.tokenize("".join([self.chars[b] for b in piece.encode()]))])

    def _word(self, word: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.split.findall(word)])

    def encode(self, texts):
        """Packed ids of each text (None: empty), in order."""
        for t in texts:
            if not isinstance(t, str) or not t:
                yield b""
            elif self.odd.search(t) or not unicodedata.is_normalized("NFC", t):
                yield self.whole(t)
            else:
                if len(self.words) > CACHE_WORDS:
                    self.words = Words(self._word, self.words)
                if len(self.pieces) > CACHE_WORDS:
                    self.pieces = Words(self._piece, self.pieces)
                yield b"".join(map(self.words.__getitem__, t.lower().split()))


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, with the words that its earlier tasks have met."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files below ``folder`` in ascending id order; part, seq, path, n_docs, n_tokens, start of each file.

    A null text is empty; null ids come first; rows that repeat an id come in the order of their text's hash. Only files
    of tasks that ended well are listed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, base = local_path(folder)
        enc = word_encoder(tokenizer_path)
        end, w, seq, done = enc.pack([end_id]), None, 0, []

        def close():
            w.close()
            done.append((ctx.partitionId(), seq, path, len(w.bounds) - 1, w.total))

        for pdf in batches:
            for i, ids in zip(pdf["id"], enc.encode(pdf["text"])):
                if w is None:
                    name = f"tokens-{ctx.partitionId():06d}-{seq:04d}-{ctx.taskAttemptId()}.bin"
                    path = f"{folder}/{name}"
                    fs.create_dir(base, recursive=True)
                    w = Writer(fs.open_output_stream(f"{base}/{name}", compression=None), enc.width)
                w.add(None if i is None else int(i), ids + end)
                if w.total >= SHARD_TOKENS or len(w.bounds) > SHARD_DOCS:
                    close()
                    w, seq = None, seq + 1
        if w is not None:
            close()
        yield pd.DataFrame(done, columns=["part", "seq", "path", "n_docs", "n_tokens"])

    listed = ordered.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(write, "part int, seq int, path string, n_docs long, n_tokens long")
    listed = store(listed, "token-manifest")
    # One row a file, so this one running sum stays small however large the files are.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, block_docs: int = 2048) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for path, n_docs, start in zip(pdf["path"], pdf["n_docs"], pdf["start"]):
                fs, at = local_path(path)
                with fs.open_input_file(at) as source:
                    r = Reader(source)
                    if r.n != n_docs:
                        raise ValueError(f"{path} has {r.n} documents, not {n_docs}")
                    for i in range(0, r.n, block_docs):
                        j = min(r.n, i + block_docs)
                        bounds, ids = r.tokens(i, j)
                        wide = ids.astype("<u4")
                        cut = bounds - bounds[0]
                        crc = [zlib.crc32(wide[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                        yield pd.DataFrame({"doc_id": pd.array(r.doc_ids(i, j), "Int64"), "start": int(start) + bounds[:-1], "n_tokens": np.diff(bounds), "ids_crc32": np.array(crc, np.int64)})

    files = max(1, min(manifest.count(), 10_000))
    return manifest.select("path", "n_docs", "start").repartition(files, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of ``documents``, written and read back."""
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(manifest)
