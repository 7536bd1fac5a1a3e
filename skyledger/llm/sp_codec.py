"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once; at each position it follows its output links through every piece that ends there and
relaxes the best score of that position. A piece never goes on over the start of a word (this is checked when the model
is read), so words are encoded apart and the words met before are looked up. Characters that no piece covers cost ten
less than the worst score and become their UTF-8 bytes (or the unknown piece, in models without byte pieces). Of equal
scores the longer last piece wins. Scores are the model file's; nothing is trained.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words whose pieces a task remembers; beyond that it starts anew.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: text and score of those that can be matched, bytes that each id stands for, ids of bytes."""

    matched: tuple[tuple[str, int, float], ...]
    shown: tuple[bytes, ...]
    of_byte: tuple[int, ...]
    unknown: int
    worst: float
    words_apart: bool


def read_model(spark: SparkSession, path: str = MODEL) -> Pieces:
    """The pieces of a SentencePiece model file: on the driver's disk, or by Spark where the path names a store."""
    import sentencepiece

    if "://" in path:
        proto = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as file:
            proto = file.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    matched, shown, of_byte = [], [], {}
    for id_ in range(model.get_piece_size()):
        piece = model.id_to_piece(id_)
        if model.is_byte(id_):
            of_byte[int(piece[1:-1], 16)] = id_
            shown.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(id_) or model.is_unknown(id_) or model.is_unused(id_):
            shown.append(b"")
        else:
            matched.append((piece, id_, model.get_score(id_)))
            shown.append(piece.replace(SPACE, " ").encode())
    bytes_ = tuple(of_byte[b] for b in range(256)) if len(of_byte) == 256 else ()
    apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in matched)
    return Pieces(tuple(matched), tuple(shown), bytes_, model.unk_id(), min(s for _, _, s in matched), apart)


class _Words(dict):
    """Ids of words met before, by the word without its first mark; others are segmented on the way."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.codec.viterbi(SPACE + word)
        if len(word) <= 64:
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for piece, id_, score in pieces.matched:
            self.automaton.add_word(piece, (len(piece), id_, score))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in pieces.matched if len(p) == 1}
        self.known = _Words(self)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if pieces.words_apart else "(?s).+").findall

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Ids of the best segmentation of a text whose spaces are marked."""
        n, worst = len(text), float("-inf")
        best, back = [worst] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(text):
            for last, (size, id_, score) in self.automaton.iter(text):
                value = best[last + 1 - size] + score
                if value > best[last + 1]:
                    best[last + 1], back[last + 1] = value, (size, id_)
        else:
            unknown = self.pieces.worst - 10
            ends: dict[int, list] = {}
            for last, found in self.automaton.iter(text):
                ends.setdefault(last, []).append(found)
            for last in range(n):
                for size, id_, score in ends.get(last, ()):
                    value = best[last + 1 - size] + score
                    if value > best[last + 1]:
                        best[last + 1], back[last + 1] = value, (size, id_)
                if text[last] not in self.single and best[last] + unknown > best[last + 1]:
                    best[last + 1], back[last + 1] = best[last] + unknown, (1, -1)
        ids, at = [], n
        while at:
            size, id_ = back[at]
            at -= size
            if id_ >= 0:
                ids.append(id_)
            elif self.pieces.of_byte:
                ids += [self.pieces.of_byte[b] for b in reversed(text[at].encode("utf-8", "replace"))]
            else:
                ids.append(self.pieces.unknown)
        return tuple(reversed(ids))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if self.pieces.words_apart and not (text[0] == " " or text[-1] == " " or "  " in text or SPACE in text):
            words = text.split(" ")  # single spaces: each word has one mark before it
        else:
            words = [w[1:] for w in self.words(SPACE + text.replace(" ", SPACE))]  # each begins with a mark
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int32)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.pieces.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _udf(spark: SparkSession, pieces: Pieces, kind: str, run):
    """A function over Arrow columns that has one Codec for each task process."""
    shared = spark.sparkContext.broadcast(pieces)

    def call(column: pa.Array) -> pa.Array:
        codec = _codecs.get(id(shared.value))
        if codec is None:
            _codecs.clear()
            codec = _codecs[id(shared.value)] = Codec(shared.value)
        return run(codec, column)

    return F.arrow_udf(call, kind).asNondeterministic()


_codecs: dict[int, Codec] = {}


def encoded(docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text: null for null, empty for empty texts. ``ids_col`` is replaced.

    Repeated rows stay, texts of any length are encoded whole, an empty table gives an empty one.
    """

    def run(codec: Codec, texts: pa.Array) -> pa.Array:
        ids = [None if t is None else codec.encode(t) for t in texts.to_pylist()]
        sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in ids], pa.bool_()))

    return docs.withColumn(ids_col, _udf(docs.sparkSession, pieces, "array<int>", run)(F.col(text_col).cast("string")))


def decoded(docs: DataFrame, pieces: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids: the encoded text itself, but for U+2581 in it, which reads as a space.

    Null stays null. ``text_col`` is replaced. Bytes that are no UTF-8 become replacement characters. Repeated rows stay,
    lists of any length are decoded whole, an empty table gives an empty one.
    """

    def run(codec: Codec, lists: pa.Array) -> pa.Array:
        # One list of numbers at a time: those of a whole batch would be hundreds of MB as Python objects.
        values, ends, valid = lists.values.to_numpy(), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
        return pa.array([codec.decode(values[a:b].tolist()) if ok else None for ok, a, b in zip(valid, ends, ends[1:])], pa.string())

    return docs.withColumn(text_col, _udf(docs.sparkSession, pieces, "string", run)(F.col(ids_col)))
