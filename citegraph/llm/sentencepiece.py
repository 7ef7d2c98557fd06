"""SentencePiece encoding and decoding with batched numpy.

A text is cut into words at its spaces (no piece crosses a space, which is checked when a model is
read). Distinct words of equal length are encoded together: their substrings' hashes are
probed in the sorted hashes of the pieces, position after position for all words at once.

* Unigram models: Viterbi. At each position the vectorised maximum over the pieces that end there
  stores the best score and a backpointer. A model file of another kind can be read as a unigram model: its pieces, with
  the log-probabilities that Zipf's law gives to their order in the file (which is one of falling frequency).
* BPE models: the additive scores of a Viterbi search do not give the segmentation these models define
  (their scores are merge ranks), so here the vectorised maximum picks the pair to merge next in every
  word, leftmost on ties. The ids equal those of the sentencepiece library.

Words seen before in a task come from a bounded cache. Decoding joins the pieces' bytes.
"""

from __future__ import annotations

import heapq
import re
import struct
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citegraph.llm.common import per_batch, released

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Types of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words encoded together are at most this long; longer ones are encoded one by one.
LONG = 48
#: Bytes of words and ids that a task keeps.
CACHED_BYTES = 48 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def fields(data: bytes):
    """(field number, value) of a protocol buffer message: ints, 4-byte floats or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            at += 8
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            n = varint()
            yield tag >> 3, data[at:at + n]
            at += n


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool = False,
                 dummy_prefix: bool = True, squeeze: bool = True):
        self.kind, self.byte_fallback, self.dummy_prefix, self.squeeze = kind, byte_fallback, dummy_prefix, squeeze
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(t in (USER_DEFINED, UNUSED) for _, _, t in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.scores = np.array([s for _, s, _ in pieces], np.float32)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode()
                        if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.sizes = np.array(list(map(len, self.surface)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.key = xxhash.xxh3_128_hexdigest(repr((pieces, kind, byte_fallback, dummy_prefix, squeeze)))
        self.longest = max(map(len, self.ids), default=1)
        # a newline in no piece stands alone, which keeps words apart that a line end joins
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        inside = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.word = re.compile("(?s).+" if inside else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|\n")
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(LONG, self.longest) + 1, BASE)]), dtype=np.uint64)
        keys = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int64)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("piece hashes collide")
        self.lowest = float(self.scores[list(self.ids.values())].min()) if self.ids else 0.0

    @classmethod
    def read(cls, path: str, unigram: bool = False) -> Model:
        """A model file without a character map (identity normalisation); with ``unigram`` as a unigram model, whatever its
        kind: the normal pieces get the log-probabilities of Zipf's law by their order."""
        pieces, kind, fallback, prefix, squeeze = [], UNIGRAM, False, True, True
        for n, value in fields(open(path, "rb").read()):
            if n == 1:
                f = dict(fields(value))
                pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif n == 2:
                f = dict(fields(value))
                kind, fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif n == 3:
                f = dict(fields(value))
                if f.get(2):
                    raise ValueError("models with a character map are not supported")
                prefix, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if unigram and kind != UNIGRAM:
            order = [i for i, x in enumerate(pieces) if x[2] == NORMAL]
            score = -np.log(np.arange(1, len(order) + 1))
            score -= np.log(np.exp(score).sum())
            for i, x in zip(order, score.astype(np.float32).tolist()):
                pieces[i] = (pieces[i][0], x, NORMAL)
            kind = UNIGRAM
        return cls(pieces, kind, fallback, prefix, squeeze)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each substring hash, -1 for none."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.key_ids[at], -1)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(filter(None, text.split(" ")))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    def unknown(self, c: str) -> list[int]:
        if self.byte_fallback:
            return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return [self.unk]

    def surface_ids(self, word: str, cuts: list[int]) -> list[int]:
        """Ids of a word cut at these positions. Neighbouring unknown characters become one unknown id."""
        out: list[int] = []
        for s, e in zip(cuts, cuts[1:]):
            k = self.ids.get(word[s:e])
            if k is not None:
                out.append(k)
            elif self.byte_fallback or not out or out[-1] != self.unk or not fused:
                out += self.unknown(word[s:e])
            fused = k is None
        return out

    # -- equal-length words together

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of every word, as bytes of int32."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            if n > LONG:
                cut = self._merge_long if self.kind == BPE else self._viterbi_long
                for i in at:
                    out[i] = np.array(self.surface_ids(words[i], cut(words[i])), np.int32).tobytes()
                continue
            code = np.array([words[i] for i in at], f"<U{n}").view(np.uint32).reshape(len(at), n)
            prefix = np.zeros((len(at), n + 1), np.uint64)
            for j in range(n):
                prefix[:, j + 1] = prefix[:, j] * BASE + code[:, j] + np.uint64(1)
            bound = self._viterbi(prefix) if self.kind == UNIGRAM else self._merge(prefix)
            size = np.diff(bound, axis=1)
            rows = np.arange(len(at))[:, None]
            found = self.probe(prefix[rows, bound[:, 1:]] - prefix[rows, bound[:, :-1]] * self.powers[size])
            used = size > 0  # a row's symbols, then empty ones
            flat = found[used].astype(np.int32).tobytes()
            ends = np.cumsum(used.sum(1)).tolist()
            known = ((found >= 0) | ~used).all(1).tolist()
            start = 0
            for r, (i, end, whole) in enumerate(zip(at, ends, known)):
                if whole:
                    out[i] = flat[4 * start:4 * end]
                else:
                    cuts = [0, *bound[r, 1:][used[r]].tolist()]
                    out[i] = np.array(self.surface_ids(words[i], cuts), np.int32).tobytes()
                start = end
        return out

    def _viterbi(self, prefix: np.ndarray) -> np.ndarray:
        """Boundaries of the best cut of every word, the last one repeated up to the matrix' width."""
        words, n = prefix.shape[0], prefix.shape[1] - 1
        best = np.full((words, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((words, n + 1), np.int64)
        for e in range(1, n + 1):
            for size in range(min(e, self.longest), 0, -1):
                found = self.probe(prefix[:, e] - prefix[:, e - size] * self.powers[size])
                score = np.where(found >= 0, self.scores[found], self.lowest - 10 if size == 1 else -np.inf)
                total = best[:, e - size] + score
                more = total > best[:, e]
                best[more, e] = total[more]
                back[more, e] = e - size
        bound = np.full((words, n + 2), n)
        at, left = np.full(words, n), np.arange(words)
        steps = []
        while len(left):  # all words walk back together
            steps.append((left, at[left]))
            at[left] = back[left, at[left]]
            left = left[at[left] > 0]
        count = np.zeros(words, np.int64)
        for rows, _ in steps:
            count[rows] += 1
        for k, (rows, end) in enumerate(steps):
            bound[rows, count[rows] - k] = end
        bound[:, 0] = 0
        return bound

    def _viterbi_long(self, word: str) -> list[int]:
        """The same cut of one long word: the scores of all its substrings are probed first."""
        n, width = len(word), min(self.longest, len(word))
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        score = np.full((n + 1, width), -np.inf)  # of the piece that ends here and begins width - k before
        h = np.zeros(n, np.uint64)  # hash of the substring of this size that begins here
        for size in range(1, width + 1):
            h = h[:n - size + 1] * BASE + code[size - 1:]
            found = self.probe(h)
            score[size:, width - size] = np.where(found >= 0, self.scores[found], self.lowest - 10 if size == 1 else -np.inf)
        best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
        best[0] = 0
        for e in range(1, n + 1):
            first = max(0, e - width)
            total = best[first:e] + score[e, width - (e - first):]
            k = int(total.argmax())
            best[e], back[e] = total[k], first + k
        cuts = [n]
        while cuts[-1]:
            cuts.append(int(back[cuts[-1]]))
        return cuts[::-1]

    def _pair_scores(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Score of the piece made of the characters from start to end, -inf for none."""
        size = end - start
        ok = (size > 0) & (size <= self.longest)
        rows = np.arange(len(prefix)).reshape(-1, *[1] * (start.ndim - 1))
        h = prefix[rows, end] - prefix[rows, start] * self.powers[np.where(ok, size, 0)]
        found = np.where(ok, self.probe(h), -1)
        return np.where(found >= 0, self.scores[found], -np.inf)

    def _merge(self, prefix: np.ndarray) -> np.ndarray:
        """Boundaries of every word's symbols after all merges, the last one repeated up to the matrix' width."""
        words, n = prefix.shape[0], prefix.shape[1] - 1
        bound = np.tile(np.arange(n + 2), (words, 1))
        bound[:, n + 1] = n  # after the last symbol only empty ones follow
        out = bound.copy()
        left = np.arange(words)
        score = self._pair_scores(prefix, bound[:, :-2], bound[:, 2:])
        score[:, n - 1] = -np.inf  # the last symbol has no partner
        step = np.arange(n + 2)
        while True:
            pick = score.argmax(1)
            done = score[np.arange(len(left)), pick] == -np.inf
            out[left[done]] = bound[done]
            go = ~done
            if not go.any():
                return out
            left, bound, score, pick, prefix = left[go], bound[go], score[go], pick[go], prefix[go]
            at = np.minimum(step + (step > pick[:, None]), n + 1)
            bound = np.take_along_axis(bound, at, 1)
            at = np.minimum(step[:n] + (step[:n] > pick[:, None]), n - 1)
            score = np.take_along_axis(score, at, 1)
            score[:, n - 1] = -np.inf
            rows = np.arange(len(left))
            for k in (pick - 1, pick):
                near = np.maximum(k, 0)
                fresh = self._pair_scores(prefix, bound[rows, near], bound[rows, np.minimum(near + 2, n + 1)])
                fresh[bound[rows, near + 1] >= n] = -np.inf
                score[rows, near] = np.where(k < 0, score[rows, near], fresh)

    def _merge_long(self, word: str) -> list[int]:
        """The same merges for one long word, with a heap of pairs."""
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        alive = [True] * n
        heap: list[tuple[float, int, int]] = []

        def push(i: int) -> None:
            if end[i] < n and end[end[i]] - i <= self.longest:
                k = self.ids.get(word[i:end[end[i]]])
                if k is not None:
                    heapq.heappush(heap, (-float(self.scores[k]), i, end[end[i]]))

        for i in range(n):
            push(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != e:
                continue
            alive[end[i]] = False
            end[i] = e
            if e < n:
                before[e] = i
            push(i)
            if i:
                push(before[i])
        return [i for i in range(n) if alive[i]] + [n]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _encoder(bc, text_col: str, out_col: str, decoded_col: str | None):
    names = [out_col] + [decoded_col] * (decoded_col is not None)

    def run(batches):
        m, cache, held = bc.value, {}, 0

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal held
            texts = batch.column(text_col).to_pylist()
            words = [m.word.findall(m.normalise(t)) if t else [] for t in texts]
            distinct = set().union(*words)
            new = [w for w in distinct if w not in cache]
            if held > CACHED_BYTES:
                cache.clear()
                held, new = 0, list(distinct)
            ids = m.encode_words(new)
            cache.update(zip(new, ids))
            held += sum(map(sys.getsizeof, new)) + sum(map(sys.getsizeof, ids))
            values = [b"".join(map(cache.__getitem__, row)) for row in words]
            offsets = np.cumsum([0, *(len(v) // 4 for v in values)])
            flat = pa.array(np.frombuffer(b"".join(values), np.int32))
            cols = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([t is None for t in texts]))]
            if decoded_col is not None:
                cols.append(pa.array([None if t is None else decode_ids(m, np.frombuffer(v, np.int32)) for t, v in zip(texts, values)], pa.string()))
            return pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

        yield from per_batch(one, 256)(batches)
        cache.clear()
        released()

    return run


def encode(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of the text (array of int; null for a null text, empty for an empty one), and in ``decoded_col``, if
    named, the text of these ids (see :func:`decode`), in one pass. Columns that are already called so are replaced."""
    docs = docs.drop(out_col, *[decoded_col] * (decoded_col is not None))
    bc = docs.sparkSession.sparkContext.broadcast(model)
    schema = _with(docs, out_col, T.ArrayType(T.IntegerType()))
    if decoded_col is not None:
        schema = schema.add(decoded_col, T.StringType())
    return docs.mapInArrow(_encoder(bc, text_col, out_col, decoded_col), schema)


def decode_ids(model: Model, ids: np.ndarray) -> str:
    """The text of the ids: the bytes of all pieces, gathered at once."""
    if not len(ids):
        return ""
    size = model.sizes[ids]
    end = np.cumsum(size)
    at = np.arange(end[-1]) + np.repeat(model.starts[ids] - (end - size), size)
    text = model.flat[at].tobytes().decode("utf-8", "replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def _decoder(bc, ids_col: str, out_col: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, col = bc.value, batch.column(ids_col)
        values = col.values.to_numpy(zero_copy_only=False)
        offsets = col.offsets.to_numpy()
        text = [None if null else decode_ids(m, values[a:b])
                for a, b, null in zip(offsets, offsets[1:], col.is_null().to_numpy(zero_copy_only=False))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, out_col])

    return per_batch(run, 256)


def decode(rows: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids; null for null. A text that holds U+2581 comes back with a space in its
    place, and one whose extra spaces the model squeezes without them; all others come back as they were."""
    rows = rows.drop(out_col)
    bc = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_decoder(bc, ids_col, out_col), _with(rows, out_col, T.StringType()))
