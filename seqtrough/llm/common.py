"""Helpers shared by the corpus operators: tables, shared scratch space, word hashing and tokenizing."""

from __future__ import annotations

import contextlib
import gc
import json
import re
import tempfile
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Word separators: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and the session is local is a folder of this machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    made = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for listener in _RECORDS:
        listener.append(made)
    return made


_RECORDS: list[list[str]] = []


@contextlib.contextmanager
def recorded():
    """A list that gets every folder that ``shared_dir`` names meanwhile."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def removed(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of the shared store, whichever file system it is."""
    for uri in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors recompute nothing."""
    at = at or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def unlike(df: DataFrame, name: str) -> str:
    """``name``, or a name made from it, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, nulls as empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batches, rows: int = 512):
    """Smaller record batches, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_words(text: str) -> list[bytes]:
    """Words as UTF-8 bytes, A-Z lower-cased; ``bytes.split`` separates at exactly the characters of SPACE."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words in place order; a shorter text is one shingle, an empty one has none."""
    k = min(k, len(words))
    if not k:
        return words
    last = len(words) - k + 1
    h = np.full(last, np.uint64(k))
    for j in range(k):
        h = h * _MIX[0] + words[j : j + last]
        h ^= h >> np.uint64(29)
    return mixed(h)


#: Fixed value: how a byte-level tokenizer of this family cuts text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = ".,;:!?"
WORD_SPACE = re.compile(r" (?=\S)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Memo(dict):
    """What ``make`` gives for a key, kept in two generations of at most ``most`` keys: those not used in one generation go."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class _OddSpace(Exception):
    """A space that no word follows."""


class Encoder:
    """Whole texts to token ids with the ``tokenizers`` library, repeated work done once.

    A byte-level tokenizer never merges across a space that a non-space follows, so a text may be
    cut before each such space. The chunks repeat, and their ids come from a bounded memo; new ones
    go through the library's merge model. Other kinds of tokenizer encode each text as it is.
    """

    CHUNKS, PIECES = 800_000, 100_000  # keys of a generation of each memo, about 150 bytes a key

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        cutter = told.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in told.get("added_tokens") or []]
        self.by_chunk = (
            cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space")
            and not told.get("normalizer")
            and not told.get("truncation")
            and not any(" " in x for x in self.added)
        )
        self.cut = regex.compile(PIECES)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.alone = not any(x.rstrip(MARKS).isalpha() for x in self.added)  # no added token is a plain word
        self.pieces = _Memo(self._piece, self.PIECES)
        self.memo = _Memo(self._spaced, self.CHUNKS)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece, by the tokenizer's own merge model."""
        spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize(spelled)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if any(x in chunk for x in self.added):
            return self.whole(chunk)
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(chunk)))

    def _spaced(self, word: str) -> bytes:
        """Ids of a word after a space. Letters alone are one piece, and a mark after them is another."""
        if self.alone:
            if word.isalpha():
                return self._piece(" " + word)
            if word[-1:] in MARKS and word[:-1].isalpha():
                return self.memo[word[:-1]] + self.pieces[word[-1]]
        if not word or word[0].isspace():  # never kept, so that a text with runs of spaces always comes here
            raise _OddSpace
        return self._chunk(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_chunk:
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return self._chunk(first) + b"".join(map(self.memo.__getitem__, rest))
        except _OddSpace:
            first, *rest = WORD_SPACE.split(text)
            return self._chunk(first) + b"".join([self._chunk(" " + y) for y in rest])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def unburdened() -> None:
    """Let go of the encoders, with all that they remember, which tasks of another stage have left in this worker."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
