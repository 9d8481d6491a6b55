"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

Texts are cut into marked words (a space becomes the mark, a new word starts at
each run of marks). The distinct words of a batch are sorted, which lays them
out as the depth-first order of their trie: going from one word to the next,
the forward table is kept up to their common prefix and only the new suffix is
computed.

Forward step at a prefix of length i: for each piece that ends there and starts
at j, the best path to i through that piece is the best path to j plus the
piece. For a unigram model the path's score is the sum of the piece scores. A
BPE model's scores are merge ranks, not log-probabilities, and the highest sum
is not the segmentation that its merges make; there the lattice has a
transition from piece a to piece b only where the merges of the text a+b leave
exactly (a, b), and the forward value is that such a path exists. A sequence is
the merges' result exactly when each of its neighbours are, so one path per
prefix survives and the ids are those of the model (the tests compare them with
the library's, for both kinds).

Characters without a piece become their UTF-8 bytes' pieces, as the model asks.
Decoding gathers the bytes of all pieces of a batch through offsets into one
buffer and turns marks into spaces.

The model file is a parameter. ``load_pieces`` reads it on the driver; the
pieces (a fixed-size vocabulary) are broadcast.

Defined results: null text has null ids and null decoded text; an empty text
has no ids. The mark character itself in a text decodes as a space, as the
model defines. Repeated rows repeat; other columns are carried along.
"""

from __future__ import annotations

import hashlib
import os
import re
from contextlib import contextmanager
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, prepare

MODEL_FILE = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
MAX_WORDS = 250_000  # words remembered in a task
MAX_PAIRS = 250_000
UNIGRAM, BPE = 1, 2


@dataclass
class Pieces:
    """A vocabulary: id and score per piece, ids of the 256 byte pieces, the bytes each id decodes to."""

    kind: int
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    id_bytes: list[bytes]
    unknown: int = 0
    _pairs: dict[tuple[str, str], bool] = field(default_factory=dict)

    def __post_init__(self):
        # All pieces that end at each position of a string, longest first.
        self.matches = ahocorasick.Automaton()
        for p in self.ids:
            self.matches.add_word(p, p)
        self.matches.make_automaton()
        self.longest = max(map(len, self.ids), default=1)
        # Characters inside no piece of several characters end a word: no merge crosses them.
        self.joined = set("".join(p for p in self.ids if len(p) > 1))
        self.word = re.compile(f"{MARK}+[^{MARK}\\n\\t]*|[^{MARK}\\n\\t]+|[\\n\\t]" if not {"\n", "\t"} & self.joined else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        sizes = np.array([len(b) for b in self.id_bytes], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.bytes = np.frombuffer(b"".join(self.id_bytes), dtype=np.uint8)

    def merged(self, text: str) -> list[str]:
        """The symbols that BPE merges leave of a text: best score first, leftmost among equals."""
        s = list(text)
        while len(s) > 1:
            best, at = -np.inf, -1
            for i in range(len(s) - 1):
                v = self.scores.get(s[i] + s[i + 1])
                if v is not None and v > best:
                    best, at = v, i
            if at < 0:
                break
            s[at:at + 2] = [s[at] + s[at + 1]]
        return s

    def apart(self, a: str, b: str) -> bool:
        """Whether the merges of ``a + b`` leave exactly (a, b); with an empty ``a``, whether they make ``b``."""
        key = (a, b)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[x] for x in piece.encode("utf-8", "surrogatepass")]


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message; values are ints, floats' bytes or byte strings."""
    i = 0

    def varint(i):
        shift = value = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i:i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = data[i:i + n], i + n
        yield key >> 3, value


def load_pieces(data: bytes) -> Pieces:
    """Read a serialized model (identity normalizer, leading mark, no white space removed)."""
    kind, ids, scores, byte_ids, id_bytes, unknown = UNIGRAM, {}, {}, [0] * 256, [], 0
    has_bytes = False
    for number, value in _fields(data):
        if number == 1:
            piece, score, sort = "", 0.0, 1
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = float(np.frombuffer(v, dtype="<f4")[0])
                elif n == 3:
                    sort = v
            i = len(id_bytes)
            if sort in (1, 4):  # ordinary and user-defined pieces
                ids[piece], scores[piece] = i, score
                id_bytes.append(piece.replace(MARK, " ").encode("utf-8"))
            elif sort == 6:
                byte_ids[int(piece[3:5], 16)] = i
                has_bytes = True
                id_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                unknown = i if sort == 2 else unknown
                id_bytes.append(" ⁇ ".encode("utf-8") if sort == 2 else b"")
        elif number == 2:
            kind = next((v for n, v in _fields(value) if n == 3), UNIGRAM)
    return Pieces(kind, ids, scores, byte_ids if has_bytes else [], id_bytes, unknown)


class TrieViterbi:
    """Encodes sorted words; the forward table of a prefix is shared by all words that begin with it."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.floor = min(pieces.scores.values(), default=0.0) - 10.0  # an unknown character, as the library scores it

    def encode_sorted(self, words: list[str]):
        """Yields (word, pieces) for words in ascending order."""
        pieces, bpe = self.pieces, self.pieces.kind == BPE
        scores, pairs, find, reach = pieces.scores, pieces._pairs, pieces.matches.iter, pieces.longest - 1
        last: list[str] = [""]  # last piece of the best path to each prefix
        score = [0.0]
        before = ""
        for word in words:
            keep = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                keep += 1
            del last[keep + 1:], score[keep + 1:]
            done = keep  # prefixes up to here have their forward value
            at = max(0, keep - reach)
            for end, piece in find(word, at) if at else find(word):
                i = end + 1
                if i <= done and (bpe or i <= keep):
                    continue
                while done < i - 1:  # characters that end no allowed piece
                    self._unknown(word, done + 1, last, score)
                    done += 1
                j = i - len(piece)
                if j < at:
                    continue
                if bpe:  # at most one path is allowed
                    ok = pairs.get((last[j], piece))
                    if pieces.apart(last[j], piece) if ok is None else ok:
                        last.append(piece)
                        score.append(score[j] + scores[piece])
                        done = i
                elif done < i:
                    last.append(piece)
                    score.append(score[j] + scores[piece])
                    done = i
                elif score[j] + scores[piece] > score[i]:
                    last[i], score[i] = piece, score[j] + scores[piece]
            while done < len(word):
                self._unknown(word, done + 1, last, score)
                done += 1
            before = word
            path, i = [], len(word)
            while i:
                path.append(last[i])
                i -= len(last[i])
            yield word, path[::-1]

    def _unknown(self, word: str, i: int, last: list[str], score: list[float]) -> None:
        """The prefix of length i ends in a character without a piece of its own."""
        last.append(word[i - 1])
        score.append(score[i - 1] + self.floor)


class Codec:
    """Encodes and decodes batches of texts; remembers words across batches until told to forget."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.trie = pieces, TrieViterbi(pieces)
        self._packed = {p: i.to_bytes(4, "little") for p, i in pieces.ids.items()}
        self._words: dict[str, bytes] = {}

    def forget(self) -> None:
        self._words.clear()
        self.pieces._pairs.clear()

    def _learn(self, words: set[str]) -> None:
        packed, known = self._packed, self._words
        for word, path in self.trie.encode_sorted(sorted(words)):
            try:
                known[word] = b"".join([packed[p] for p in path])
            except KeyError:
                known[word] = b"".join([np.array(self.pieces.piece_ids(p), dtype="<i4").tobytes() for p in path])

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = self.pieces.word.findall
        marked = [None if t is None else cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self._words
        if len(known) > MAX_WORDS:
            known.clear()
        new: set[str] = set()
        for words in marked:
            if words:
                new.update(words)
        self._learn(new - known.keys())
        return [None if w is None else np.frombuffer(b"".join([known[x] for x in w]), dtype="<i4") for w in marked]

    def decode(self, ids: list[np.ndarray | None]) -> list[str | None]:
        p = self.pieces
        every = np.concatenate([i for i in ids if i is not None]) if any(i is not None for i in ids) else np.zeros(0, np.int32)
        size = p.starts[every + 1] - p.starts[every]
        end = np.r_[0, np.cumsum(size)]
        data = p.bytes[np.arange(end[-1]) + np.repeat(p.starts[every] - end[:-1], size)].tobytes()
        out, at = [], 0
        for i in ids:
            if i is None:
                out.append(None)
                continue
            text = data[end[at]:end[at + len(i)]].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
            at += len(i)
        return out


_codecs: dict[int, Codec] = {}
_SLICE = 200  # texts encoded at a time


@contextmanager
def _codec_of(var):
    """The codec for one task: the worker keeps the vocabulary, not the words, as it goes on to other stages."""
    key = hash(var.value)
    if key not in _codecs:
        _codecs[key] = Codec(load_pieces(var.value))
    try:
        yield _codecs[key]
    finally:
        _codecs[key].forget()
        give_back()


def _int_lists(ids: list[np.ndarray | None]) -> pa.Array:
    off = np.r_[0, np.cumsum([0 if i is None else len(i) for i in ids])].astype(np.int32)
    some = [i for i in ids if i is not None]
    values = pa.array(np.concatenate(some) if some else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(off), values, mask=pa.array([i is None for i in ids], pa.bool_()))


def _encode(var, names: list[str]):
    def run(batches):
        with _codec_of(var) as codec:
            for b in batches:
                for a in range(0, len(b), _SLICE):
                    s = b.slice(a, _SLICE)
                    ids = codec.encode(s.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([s.column(n) for n in names] + [_int_lists(ids)], names=[*names, "ids"])
    return run


def _decode(var, names: list[str]):
    def run(batches):
        with _codec_of(var) as codec:
            for b in batches:
                for a in range(0, len(b), _SLICE):
                    s = b.slice(a, _SLICE)
                    ids = [None if x is None else np.array(x, dtype=np.int32) for x in s.column("ids").to_pylist()]
                    yield pa.RecordBatch.from_arrays([s.column(n) for n in names] + [pa.array(codec.decode(ids), pa.string())], names=[*names, "decoded"])
    return run


def _model(spark: SparkSession, model_file: str):
    with open(model_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, docs: DataFrame, model_file: str = MODEL_FILE, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of ``text``."""
    prepare(spark)
    docs = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    names = [c for c in docs.columns if keep_text or c != "text"]
    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encode(_model(spark, model_file), names), schema)


def decode(spark: SparkSession, tokens: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """``tokens`` with ``decoded``, the text of ``ids``."""
    prepare(spark)
    tokens = tokens.drop("decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())])
    return tokens.mapInArrow(_decode(_model(spark, model_file), tokens.columns), schema)


_REPORT = "doc_id bigint, ids array<int>, n_pieces bigint, ids_sha256 string, round_trip boolean"


def _report(var):
    def run(batches):
        with _codec_of(var) as codec:
            for b in batches:
                for a in range(0, len(b), _SLICE):
                    s = b.slice(a, _SLICE)
                    texts = s.column("text").to_pylist()
                    ids = codec.encode(texts)
                    same = [None if t is None else d == t.replace(MARK, " ") for t, d in zip(texts, codec.decode(ids))]
                    yield pa.RecordBatch.from_arrays(
                        [s.column("doc_id"), _int_lists(ids), pa.array([None if i is None else len(i) for i in ids], pa.int64()),
                         pa.array([None if i is None else hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                         pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_pieces", "ids_sha256", "round_trip"])
    return run


def round_trip_report(spark: SparkSession, docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """Per document the ids, their number, their digest (little-endian 32-bit) and whether decoding gives the text back."""
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_report(_model(spark, model_file)), _REPORT)
