"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The benchmark is indexed: postings per word by item, in blocks with the largest BM25 contribution of each.  Item lengths and document
frequencies are those of the benchmark.  Every text is cut into passages of ``PASSAGE`` words with half of that as step, and each passage is a
query (its distinct words) that retrieves *all* items with a score of at least ``SCORE`` of the item's own score against itself (less for items longer than a passage).
Block-max WAND evaluates an item only where the block maxima of the words present can reach the lowest threshold.  Before it, passages that can
reach no item's threshold are set aside by whole arrays: per item the most frequent words, up to ``FREE`` of its threshold, are taken as
present, and the passage must hold enough of the others.  What is retrieved is verified against the text around, so that edited and clipped copies count too.  Items have no marked answer, so an item is held
where ``ALIGNED`` of its words stand in the text in order, or ``ALIGNED`` of the 5-word shingles of the item or of its question (all but the last
``ANSWER`` words); or, with less of the question (``QUESTION_SHARE``), where ``ANSWER_SHARE`` of the last words stand in order, with gaps, in twice their length.

An item without words is never found; equal items are both reported.  A text without words, or null, is clean.  Rows are
independent, so repeated rows get equal results; an empty table or benchmark gives no hits; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Words, column, documents, raw, slices

PASSAGE = 64
SCORE = 0.5
QUESTION_SHARE = 0.6
ANSWER = 8
ANSWER_SHARE = 0.6
ALIGNED = 0.8
BLOCK = 16
FREE = 0.6
K1, B = 1.2, 0.75
MAX_ITEM_BYTES = 64 << 20


def lowered(buf: np.ndarray) -> np.ndarray:
    """Capitals of the two-byte Latin letters in lower case; those of ASCII fold with the word hash."""
    second = buf[1:]
    capital = (buf[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    if not capital.any():
        return buf
    out = buf.copy()
    out[1:][capital] += 0x20
    return out


@dataclass
class Index:
    """Postings of the benchmark: per word (sorted hashes) items in rising order with impacts, and block maxima."""

    ids: list
    words: np.ndarray
    start: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    need: np.ndarray
    bound: np.ndarray
    blocks: dict
    texts: list[np.ndarray]
    rest: np.ndarray
    rare: np.ndarray
    rare_start: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: list[str], score: float) -> Index:
        data = [Words(lowered(np.frombuffer(t.encode(), np.uint8)), np.array([0, len(t.encode())])).hash for t in texts]
        pairs = [np.unique(h, return_counts=True) for h in data]
        length = np.array([len(h) for h in data], float)
        mean = max(1.0, length.mean()) if len(data) else 1.0
        word = np.concatenate([u for u, _ in pairs]) if pairs else np.zeros(0, np.uint64)
        tf = np.concatenate([c for _, c in pairs]).astype(float) if pairs else np.zeros(0)
        item = np.repeat(np.arange(len(pairs)), [len(u) for u, _ in pairs])
        order = np.lexsort((item, word))
        word, tf, item = word[order], tf[order], item[order]
        words, start = np.unique(word, return_index=True)
        start = np.append(start, len(word))
        df = np.diff(start)
        idf = np.log(1 + (len(data) - df + 0.5) / (df + 0.5))
        impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))
        own = np.bincount(item, impact, minlength=len(data))
        reach = np.minimum(1.0, 0.75 * PASSAGE / np.maximum(length, 1))  # what a passage is sure to hold of a longer item
        need = np.where(length > 0, score * own * reach, np.inf)
        blocks = {}
        for k in range(len(words)):
            for at in range(start[k], start[k + 1], BLOCK):
                stop = min(at + BLOCK, start[k + 1])
                blocks.setdefault(k, []).append((int(item[stop - 1]), float(impact[at:stop].max())))
        bound = np.maximum.reduceat(impact, start[:-1]) if len(words) else impact
        # per item the words of most items come first and are given away while they stay within FREE of the need
        number = np.repeat(np.arange(len(words)), df)
        order = np.lexsort((-df[number], item)) if len(words) else number
        sums = np.cumsum(impact[order])
        first = np.searchsorted(item[order], np.arange(len(data)))
        given = sums - np.append(0.0, sums)[first[item[order]]] <= FREE * need[item[order]]
        rest = np.where(length > 0, need, 0) - np.bincount(item[order][given], impact[order][given], minlength=len(data))
        rare = np.sort(order[~given])
        return cls(ids, words, start, item, impact, need, bound, blocks, data, np.where(length > 0, rest, np.inf), rare, np.searchsorted(rare, start))

    def floor(self) -> float:
        return float(self.need.min(initial=np.inf))

    def retrieve(self, terms: np.ndarray) -> list[int]:
        """All items whose summed impacts over the distinct ``terms`` (word numbers) reach their need."""
        least = self.floor()
        cursors = [[int(self.start[t]), int(t), 0] for t in terms]  # posting, word, block
        out = []
        while cursors:
            cursors.sort(key=lambda c: self.item[c[0]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.bound[c[1]]
                if total >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return out
            at = int(self.item[cursors[pivot][0]])
            while pivot + 1 < len(cursors) and self.item[cursors[pivot + 1][0]] == at:
                pivot += 1
            most, ends = 0.0, []
            for c in cursors[:pivot + 1]:  # blocks that hold the pivot item
                blocks = self.blocks[c[1]]
                while blocks[c[2]][0] < at:
                    c[2] += 1
                    if c[2] == len(blocks):
                        break
                if c[2] < len(blocks):
                    most += blocks[c[2]][1]
                    ends.append(blocks[c[2]][0])
            if most >= least - 1e-9:
                score = 0.0
                for c in cursors[:pivot + 1]:
                    self._advance(c, at)
                    if c[0] < self.start[c[1] + 1] and self.item[c[0]] == at:
                        score += self.impact[c[0]]
                if score >= self.need[at] - 1e-9:
                    out.append(at)
                to = at + 1
            else:  # nothing up to the nearest block end can reach the threshold
                to = min(ends, default=at) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, int(self.item[cursors[pivot + 1][0]]))
                to = max(to, at + 1)
            for c in cursors[:pivot + 1]:
                self._advance(c, to)
            cursors = [c for c in cursors if c[0] < self.start[c[1] + 1] and c[2] < len(self.blocks[c[1]])]
        return out

    def _advance(self, c: list, to: int) -> None:
        blocks, end = self.blocks[c[1]], int(self.start[c[1] + 1])
        while c[2] < len(blocks) and blocks[c[2]][0] < to:
            c[2] += 1
        c[0] = max(c[0], int(self.start[c[1]]) + c[2] * BLOCK)
        while c[0] < end and self.item[c[0]] < to:
            c[0] += 1

    def verified(self, item: int, text: np.ndarray, lo: int, hi: int) -> bool:
        """Shingles and words in order of ``item`` in words lo to hi of the text and around."""
        own = self.texts[item]
        near = text[max(0, lo - len(own)):hi + len(own)]
        answer = min(ANSWER, len(own) // 3)
        question, answer = own[:len(own) - answer], own[len(own) - answer:]
        held = share(question, near)
        if max(held, share(own, near)) >= ALIGNED or aligned(own, near) >= ALIGNED * len(own):
            return True
        if held < QUESTION_SHARE:
            return False
        at = np.flatnonzero(np.isin(near, answer))
        return any(aligned(answer, near[k:k + 2 * len(answer)]) >= ANSWER_SHARE * len(answer) for k in at)


def share(part: np.ndarray, text: np.ndarray, k: int = 5) -> float:
    """Share of the distinct k-word shingles of ``part`` that are in ``text``."""
    k = min(k, len(part))
    if not k or len(text) < k:
        return float(not k)
    a, b = (np.unique(np.lib.stride_tricks.sliding_window_view(x, k), axis=0) for x in (part, text))
    both = np.unique(np.concatenate([a, b]), axis=0)
    return (len(a) + len(b) - len(both)) / len(a)


def aligned(part: np.ndarray, text: np.ndarray) -> int:
    """Words of ``part`` that stand in ``text`` in order, with gaps (longest common subsequence, one bit per word of ``part``)."""
    masks: dict[int, int] = {}
    for k, w in enumerate(part.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(part)) - 1
    row = full
    for w in text[np.isin(text, part)].tolist():
        both = row & masks[w]
        row = ((row + both) | (row - both)) & full
    return len(part) - row.bit_count()


def hopeful(ix: Index, quick: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and first half of the passages that may reach some item's threshold."""
    step, n = PASSAGE // 2, len(ix.ids)
    at = np.flatnonzero(quick[(words.hash >> np.uint64(48)).astype(np.int64)])
    number = np.searchsorted(ix.words, words.hash[at])
    known = ix.words[np.minimum(number, len(ix.words) - 1)] == words.hash[at]
    at, number = at[known], number[known]
    lo = ix.rare_start[number]
    size = ix.rare_start[number + 1] - lo
    doc = np.searchsorted(words.offsets, at, side="right") - 1
    base = words.offsets // step + np.arange(len(words.offsets))  # numbers the halves of all texts with a gap between texts
    half = base[doc] + (at - words.offsets[doc]) // step
    posting = ix.rare[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)]
    key = np.repeat(half, size) * n + ix.item[posting]
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    if not len(key):
        return key, key
    total = np.add.reduceat(ix.impact[posting][order], first)
    after = np.searchsorted(key, key + n)
    hit = np.minimum(after, len(key) - 1)
    both = total + np.where(key[hit] == key + n, total[hit], 0.0)
    halves = np.unique(key[both >= ix.rest[key % n] - 1e-9] // n)
    # a passage that holds its words in its second half alone begins a half later
    doc = np.searchsorted(base, halves, side="right") - 1
    return doc, halves - base[doc]


def searched(index, name: str):
    def run(batches):
        ix = index.value
        step = PASSAGE // 2
        quick = np.zeros(1 << 16, bool)  # most words of a text are in no item
        some = np.flatnonzero(np.diff(ix.rare_start))
        quick[(ix.words[some] >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            buf, offsets = raw(column(batch, "text"))
            found: dict[int, set] = {}
            for a, b in slices(offsets) if len(ix.words) else ():
                words = Words(lowered(buf[offsets[a]:offsets[b]]), offsets[a:b + 1] - offsets[a])
                for row, cell in zip(*hopeful(ix, quick, words)):
                    text = words.hash[words.offsets[row]:words.offsets[row + 1]]
                    lo = int(cell) * step
                    terms = np.intersect1d(ix.words, text[lo:lo + PASSAGE], return_indices=True)[1]
                    for item in ix.retrieve(terms):
                        if ix.verified(item, text, lo, lo + PASSAGE):
                            found.setdefault(a + int(row), set()).add(ix.ids[item])
            hits = [sorted(found.get(r, ()), key=lambda x: (x is None, x)) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.int64()))], [*batch.schema.names, name])
    return run


def build(benchmark: DataFrame, score: float = SCORE) -> Index:
    """The index; a benchmark is small, and one beyond ``MAX_ITEM_BYTES`` of text is refused rather than cut."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"the benchmark holds {size} bytes of text; an index that every executor keeps is bounded by {MAX_ITEM_BYTES}")
    rows = items.collect()
    return Index.build([r["item_id"] for r in rows], [r["text"] for r in rows], score)


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, name: str = "items") -> DataFrame:
    """``docs`` with a column ``name``: the benchmark items each text holds."""
    index = docs.sparkSession.sparkContext.broadcast(build(benchmark, score))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(searched(index, name), f"{names}, `{name}` array<long>")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), (F.size("items") > 0).alias("contaminated"))
