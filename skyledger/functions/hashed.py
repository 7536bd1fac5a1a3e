"""Hashed random numbers for many names of a row at once: those of ``columns.normal``, by numpy over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# MD5's rotations, constants and start.
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
#: Texts that are hashed at once: enough to hide the cost of a call, few enough for the cache.
AT_ONCE = 32_768
#: Numbers of the index that a row stands for: a batch of rows holds so many times its own size.
RUN = 25


def md5_52(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """The first 13 hex digits of the MD5 of ``n`` padded texts, as numbers in [0, 1).

    ``words`` are the texts' words of four bytes: an array of one for each text, or a number if all texts have the same.
    """
    state = [np.full(n, s, np.uint32) for s in _START]
    turned = np.empty(n, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for k in range(64):
            if k < 16:
                f, g = np.bitwise_xor(c, d), k
                f &= b
                f ^= d
            elif k < 32:
                f, g = np.bitwise_xor(b, c), 5 * k + 1
                f &= d
                f ^= c
            elif k < 48:
                f, g = np.bitwise_xor(b, c), 3 * k + 5
                f ^= d
            else:
                f, g = np.bitwise_not(d), 7 * k
                f |= b
                f ^= c
            word, same = words[at + g % 16], _SINES[k]
            if isinstance(word, int):
                same = (same + word) % 2**32
            else:
                f += word
            f += np.uint32(same)
            f += a
            np.right_shift(f, np.uint32(32 - _TURNS[k]), out=turned)
            f <<= np.uint32(_TURNS[k])
            f |= turned
            f += b
            a, b, c, d = d, f, b, c
        for s, x in zip(state, (a, b, c, d), strict=True):
            s += x
    first, second = (s.astype("<u4").view(">u4").astype(np.uint64) for s in state[:2])
    return ((first << np.uint64(20)) | (second >> np.uint64(12))) / 2.0**52


def _columns(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as columns of bytes, zeros after their end, and their lengths."""
    return np.array(texts, "S").view(np.uint8).reshape(len(texts), -1).T, np.array([len(x) for x in texts])


def _words(head: np.ndarray, name: bytes, tail: np.ndarray) -> list[int | np.ndarray]:
    """MD5's words of head + name + tail + 'u' for each column of bytes of head and tail, then of those with 'v'."""
    ends, size = np.repeat(np.frombuffer(b"uv", np.uint8), head.shape[1]), len(head) + len(name) + len(tail) + 1
    text = [*np.tile(head, 2), *name, *np.tile(tail, 2), ends, 128]
    text += [0] * (-(len(text) + 8) % 64) + [*(8 * size).to_bytes(8, "little")]
    words = []
    for at in range(0, len(text), 4):
        same, word = 0, None
        for k, byte in enumerate(text[at : at + 4]):
            if isinstance(byte, int):
                same |= byte << 8 * k
            elif word is None:
                word = byte.astype(np.uint32) << np.uint32(8 * k)
            else:
                word |= byte.astype(np.uint32) << np.uint32(8 * k)
        words.append(same if word is None else word | np.uint32(same))
    return words


def _together(parts: list[tuple]) -> Iterator[list[tuple]]:
    """The (name, rows, words) in lists of as many blocks each and of ``AT_ONCE`` texts or, if one has more, of that one."""
    held, texts = [], 0
    for part in parts:
        n = 2 * len(part[1])
        if held and (texts + n > AT_ONCE or len(part[2]) != len(held[0][2])):
            yield held
            held, texts = [], 0
        held.append(part)
        texts += n
    if held:
        yield held


def _joined(parts: list[tuple]) -> list[int | np.ndarray]:
    """The words of all parts, one part after the other."""
    sizes, of = [2 * len(own) for _, own, _ in parts], list(zip(*[words for *_, words in parts], strict=True))
    return [w[0] if all(isinstance(x, int) and x == w[0] for x in w) else np.concatenate([np.full(n, x, np.uint32) if isinstance(x, int) else x for n, x in zip(sizes, w, strict=True)]) for w in of]


def _drawn(before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, wanted: np.ndarray, names: list[bytes]) -> np.ndarray:
    """(names, rows): the normal numbers of before + name + after; 0 where bit k of ``wanted`` isn't set for name k."""
    out = np.zeros((len(names), len(wanted)))
    for n in np.unique(n_before):
        for m in np.unique(n_after):
            alike, parts = np.flatnonzero((n_before == n) & (n_after == m)), []
            for k, name in enumerate(names):
                own = alike[wanted[alike] >> k & 1 == 1]
                if len(own):
                    parts.append((k, own, _words(before[:n, own], name, after[:m, own])))
            for some in _together(parts):
                found, at = md5_52(_joined(some), sum(2 * len(own) for _, own, _ in some)), 0
                for k, own, _ in some:
                    u, v = found[at : at + 2 * len(own)].reshape(2, -1)
                    out[k, own] = np.sqrt(-2.0 * np.log(np.maximum(u, 1e-12))) * np.cos(2.0 * np.pi * v)
                    at += 2 * len(own)
    return out


def drawn(heads: pa.Array, tails: pa.Array, firsts: pa.Array, wanted: pa.Array, names: list[bytes], n: int) -> pa.Array:
    """For each row the normal numbers of its run of indices from its first, below ``n``: of head + name + ':' + index + tail."""
    heads, tails = (x.cast(pa.binary()).dictionary_encode() for x in (heads, tails))
    before, n_before = _columns(heads.dictionary.to_pylist())
    first, asked, seeds = firsts.to_numpy(), wanted.to_numpy(), tails.dictionary.to_pylist()
    sizes = np.clip(n - first, 0, RUN)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    index = first[row] + np.arange(len(row)) - (ends - sizes)[row]
    codes, tail = np.unique(index * len(seeds) + tails.indices.to_numpy()[row], return_inverse=True)
    after, n_after = _columns([b":%d" % (code // len(seeds)) + seeds[code % len(seeds)] for code in codes.tolist()])
    head, out = heads.indices.to_numpy()[row], np.empty((len(row), len(names)))
    for at in range(0, len(row), AT_ONCE // 2):
        h, t = head[at : at + AT_ONCE // 2], tail[at : at + AT_ONCE // 2]
        out[at : at + len(h)] = _drawn(before[:, h], n_before[h], after[:, t], n_after[t], asked[row[at : at + len(h)]], names).T
    each = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * len(names), pa.int32()), pa.array(out.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), each)


def bits(flags: list[Column]) -> Column:
    """A long with bit k set where flag k is true."""
    return sum((F.when(x, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, x in enumerate(flags)), F.lit(0).cast("long"))


def normals(df: DataFrame, names: list[str], n: int, key: Column, seed: Column, wanted: Column, index: str, out: str) -> DataFrame:
    """``n`` rows of each row, with ``index`` from 0 and ``out``: normal(key, name, index, seed) of each name, as an array.

    ``wanted`` has a bit for each name whose number the row needs; 0 stands for the others. As columns each number is two
    texts, two hashes and two numbers parsed from texts, at several times the cost.
    """
    encoded = [x.encode() for x in names]

    def run(heads: pa.Array, tails: pa.Array, firsts: pa.Array, asked: pa.Array) -> pa.Array:
        return drawn(heads, tails, firsts, asked, encoded, n)

    first, head, tail = F.sequence(F.lit(0), F.lit(n - 1), F.lit(RUN)), F.coalesce(F.concat(key.cast("string"), F.lit(":")), F.lit("")), F.concat_ws(":", F.lit(""), seed.cast("string"), F.lit(""))
    runs = df.withColumns({"_head": head, "_tail": tail, "_asked": wanted}).withColumn("_first", F.explode(first))
    runs = runs.withColumn("_run", F.arrow_udf(run, "array<array<double>>").asNondeterministic()("_head", "_tail", "_first", "_asked"))
    return runs.select(*df.columns, "_first", F.posexplode("_run").alias("_k", out)).withColumn(index, F.col("_first") + F.col("_k")).drop("_first", "_k")
