"""Benchmark decontamination with a generalised suffix automaton.

The benchmark items are tokenised into words and inserted into one suffix automaton. Every
document streams its words through it, which gives at each word the length of the longest
suffix that occurs in some item. A length of ``window`` words (or the whole of a shorter
item) is a hit. Words outside the items' vocabulary, and runs of word pairs that no
item holds, cannot carry a match of that length; they are found with numpy and skipped.

The items are broadcast in blocks of about ``block_bytes`` of text. A larger benchmark is searched block after block: one
block's automaton is built, its pass over the documents is written, and it is given up before the next one is built, so
neither driver nor workers hold more than one. Where texts are cut, the passes go round until no block finds anything more.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import Stored, byte_table, free_names, per_batch

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Words: everything but ASCII that is neither a digit nor a letter; A-Z are lower-cased.
WORDS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


class Automaton:
    """Suffix automaton of word sequences, with the items of every window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        for _, ws in items:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        self.shortest = min((min(len(ws), window) for _, ws in items), default=0)
        size = len(self.vocab)
        self.pairs = np.unique(np.array(
            [a * size + b for _, ws in items for a, b in zip(ws, ws[1:])], np.int64))
        # ancestor whose class holds the suffix of exactly ``window`` words
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.at_window = list(range(len(self.next)))
        for v in order:
            if self.length[self.link[v]] >= window:
                self.at_window[v] = self.at_window[self.link[v]]
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for item, ws in items:
            v = n = 0
            for c in ws:
                v, n = self.step(v, n, c)
                if n >= window:
                    self.items.setdefault(self.at_window[v], set()).add(item)
            if len(ws) < window:
                self.short.setdefault(v, {}).setdefault(len(ws), set()).add(item)
        # nearest class on the suffix path, itself included, that ends a short item
        self.marked = [0] * len(self.next)
        for v in order:
            self.marked[v] = v if v in self.short else self.marked[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        k = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        self.link[q] = k
        return k

    def step(self, v: int, n: int, c: int) -> tuple[int, int]:
        """State and longest matching length after word ``c``."""
        nxt = self.next
        while v and c not in nxt[v]:
            v = self.link[v]
            n = self.length[v]
        return (nxt[v][c], n + 1) if c in nxt[v] else (0, 0)

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """(start, end) word ranges that may hold a match of ``shortest`` words."""
        known = ids >= 0
        if self.shortest > 1:
            if len(ids) < 2:
                return np.empty((0, 2), np.int64)
            both = np.flatnonzero(known[1:] & known[:-1])
            key = ids[both] * len(self.vocab) + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            flag = np.zeros(len(ids) - 1, np.int8)
            flag[both[self.pairs[at] == key]] = 1
            extra = 1
        else:
            flag, extra = known.astype(np.int8), 0
        edge = np.diff(flag, prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + extra
        long = ends - starts >= self.shortest
        return np.stack([starts[long], ends[long]], 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans (first word, word after the last) and the items hit."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()

        def add(a: int, b: int) -> None:
            while spans and spans[-1][1] >= a:
                a = min(a, spans.pop()[0])
            spans.append((a, b))

        for a, b in self.runs(ids).tolist():
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                v, n = self.step(v, n, c)
                if n >= self.window:
                    add(i - self.window + 1, i + 1)
                    found |= self.items[self.at_window[v]]
                u = self.marked[v]
                while u:
                    for k, its in self.short[u].items():
                        if k <= n:
                            add(i - k + 1, i + 1)
                            found |= its
                    u = self.marked[self.link[u]]
        return spans, found


class Blocks:
    """Items in blocks, and the broadcast automaton of one of them. Items without an id or a text are left out."""

    def __init__(self, items: DataFrame, window: int, block_bytes: int, id_col: str, text_col: str):
        self.window = window
        self.items = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).dropna()
        total = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(1, math.ceil(total / block_bytes))

    def automaton(self, block: int):
        rows = self.items.where(F.pmod(F.xxhash64("item"), F.lit(self.n)) == block).collect()  # about block_bytes
        return self.items.sparkSession.sparkContext.broadcast(
            Automaton(sorted((r.item, words_of(r.text)) for r in rows), self.window))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"


def _finder(bc, carry: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        n_words, n_hit, items, spans = [], [], [], []
        for text, had, its in zip(texts, old_spans, old_items):
            words = words_of(text)
            got, found = bc.value.scan(words)
            if had:
                got = merged(got + [(x["start"], x["end"]) for x in had])
            n_words.append(len(words))
            n_hit.append(sum(b - a for a, b in got))
            items.append(sorted(found.union(its or ())))
            spans.append([{"start": a, "end": b} for a, b in got])
        cols = {"id": batch.column("id"), "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.int64())),
                "spans": pa.array(spans, SPANS)}
        if carry:
            cols["text"] = batch.column("text")
        return pa.RecordBatch.from_pydict(cols)

    return per_batch(run)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col, n_words, n_hit, items, spans`` for every document, rows and order of rows as given.

    A word is hit when it lies in an occurrence of ``window`` consecutive item words, or
    of a whole item of fewer. ``spans`` are the merged hits in words. A null text has no words. Items
    without id or text are left out; repeated items and ids count once. No items: nothing is hit.
    Columns other than id and text are not read.
    """
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                      F.lit(None).cast("array<long>").alias("items"),
                      F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"))
    blocks, store = Blocks(items, window, block_bytes, item_col, "text"), Stored(docs.sparkSession)
    for k in range(blocks.n):
        bc, carry = blocks.automaton(k), k < blocks.n - 1
        out = out.mapInArrow(_finder(bc, carry), FOUND + ", text string" * carry)
        if blocks.n > 1:
            out = store.put(out, f"found{k}")
            bc.destroy()
            if k:
                store.drop(f"found{k - 1}")
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans")


def cut(text: str, automaton: Automaton, span_limit: int) -> str:
    """``text`` without its hit spans of more than ``span_limit`` words. Cutting can
    bring words together that form a new window, so it is repeated until none is left."""
    while True:
        spans = [s for s in automaton.scan(words_of(text))[0] if s[1] - s[0] > span_limit]
        if not spans:
            return text
        at = [m.span() for m in WORD.finditer(text)]
        kept, end = [], 0
        for a, b in spans:
            kept.append(text[end:at[a][0]])
            end = at[b - 1][1]
        text = "".join(kept) + text[end:]


def _cutter(bc, span_limit: int, text_col: str, count_col: str, blocks: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.schema.get_field_index(text_col)
        texts = batch.column(k).to_pylist()
        state = batch.column(count_col).to_pylist()
        clean = [text if text is None or (x and not x["left"]) else cut(text, bc.value, span_limit) for text, x in zip(texts, state)]
        first = [len(words_of(t)) if x is None else x["before"] for t, x in zip(texts, state)]
        after = [x["after"] if x and c == t else len(words_of(c)) for t, c, x in zip(texts, clean, state)]
        # blocks still to pass: all others after a cut, one less otherwise
        left = [blocks - 1 if c != t else (x["left"] if x else blocks) - 1 for t, c, x in zip(texts, clean, state)]
        batch = batch.set_column(k, batch.schema.field(k), pa.array(clean, pa.string()))
        k = batch.schema.get_field_index(count_col)
        counts = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(after, pa.int64()), pa.array(left, pa.int32())],
                                            names=["before", "after", "left"])
        return batch.set_column(k, pa.field(count_col, counts.type), counts)

    return per_batch(run)


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, span_limit: int = 0,
                         coverage_limit: float = 0.5, text_col: str = "text", item_col: str = "item_id",
                         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every hit span of more than ``span_limit`` words cut out of the text; a document
    that would lose more than ``coverage_limit`` of its words goes as a whole.

    A cut can bring words together that form a window of another block of items, so a text goes round the blocks until all
    have passed it unchanged; each pass is written, and reads only texts that are not done. All columns of ``docs`` are kept as
    they are, whatever their names. Documents without hits, null and empty texts stay unchanged.
    """
    count_col, = free_names(docs.columns, "words")
    rest = docs.withColumn(count_col, F.lit(None).cast("struct<before:long,after:long,left:int>"))
    blocks, store, done, k = Blocks(items, window, block_bytes, item_col, "text"), Stored(docs.sparkSession), [], 0
    left = F.col(f"{count_col}.left")
    while True:
        bc = blocks.automaton(k % blocks.n)
        out = rest.mapInArrow(_cutter(bc, span_limit, text_col, count_col, blocks.n), rest.schema)
        if blocks.n == 1:  # a text is cut until this block finds nothing
            done.append(out)
            break
        out = store.put(out, f"cut{k}")
        bc.destroy()
        if 0 < k < blocks.n:  # the former pass has no text that is done
            store.drop(f"cut{k - 1}")
        k += 1
        if k >= blocks.n:
            done.append(out.where(left <= 0))
            out = out.where(left > 0)
            if out.isEmpty():
                break
        rest = out
    out = reduce(DataFrame.unionByName, done)
    before, after = F.col(f"{count_col}.before"), F.col(f"{count_col}.after")
    return out.where((before - after) <= before * coverage_limit).drop(count_col)
