"""Problem 7: passages of held-out items inside a corpus, by pigeonhole edit matching."""

from __future__ import annotations

import re
from collections.abc import Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.wikitext import plain_words

#: Words of a passage, and the edits (words changed, put in or left out) it may have; it is split into budget + 1 pieces.
PASSAGE, BUDGET = 12, 1
#: Bytes of item texts that one index holds; more are taken in blocks, each a pass over the corpus.
INDEX_BYTES = 32 << 20
_HITS = "doc_id bigint, item_id bigint, edits bigint, run bigint"


def myers_distance(pattern: Sequence[Hashable], text: Sequence[Hashable], limit: int) -> int:
    """Least edits that turn the pattern into some stretch of the text, limit + 1 if more than the limit.

    Myers' bit-parallel automaton: one column of the edit matrix is a pair of bit vectors (where
    the next cell is one more, one less); Python's integers give them any width. Works on
    characters and on words.
    """
    m = len(pattern)
    if not m:
        return 0
    masks: dict[Hashable, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            best = min(best, score)
        # the text may begin anywhere, so the first row stays zero
        more <<= 1
        up = ((less << 1) | (full & ~(diagonal | more))) & full
        down = more & diagonal & full
    return min(best, limit + 1)


class PassageIndex:
    """The passages of all items by their pieces. Equal passages are kept once, with the items that have them."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.size = PASSAGE // (BUDGET + 1)
        self.passages: list[list[str]] = []
        self.owners: list[list[int]] = []
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        numbers: dict[str, int] = {}
        for item, text in items:
            w = plain_words(text)
            for p in dict.fromkeys(" ".join(w[i : i + PASSAGE]) for i in range(len(w) - PASSAGE + 1)):
                n = numbers.setdefault(p, len(numbers))
                if n == len(self.passages):
                    words = p.split(" ")
                    self.passages.append(words)
                    self.owners.append([])
                    for at in range(0, PASSAGE, self.size):
                        self.pieces.setdefault(" ".join(words[at : at + self.size]), []).append((n, at))
                self.owners[n].append(item)
        self.known = frozenset(c for p in self.passages for c in p)
        self.stretch = re.compile(b"\1{%d,}" % self.size)

    def search(self, words: list[str]) -> dict[int, tuple[int, int]]:
        """item -> (least edits of a passage, words of the longest stretch whose every passage is the item's)."""
        flags = bytes(map(self.known.__contains__, words))
        edits: dict[tuple[int, int], int] = {}
        for m in self.stretch.finditer(flags):
            for i in range(m.start(), m.end() - self.size + 1):
                for n, at in self.pieces.get(" ".join(words[i : i + self.size]), ()):
                    lo = i - at
                    if (lo, n) in edits:
                        continue
                    near, passage = words[max(0, lo - BUDGET) : lo + PASSAGE + BUDGET], self.passages[n]
                    # a passage word that is nowhere near takes an edit at least
                    missing = len(set(passage).difference(near))
                    edits[lo, n] = myers_distance(passage, near, BUDGET) if missing <= BUDGET else BUDGET + 1
        best: dict[int, int] = {}
        exact: dict[int, set[int]] = {}
        for (lo, n), e in edits.items():
            if e <= BUDGET:
                for item in self.owners[n]:
                    best[item] = min(best.get(item, e), e)
                    if not e and words[lo : lo + PASSAGE] == self.passages[n]:
                        exact.setdefault(item, set()).add(lo)
        return {item: (e, _longest(exact[item]) if item in exact else 0) for item, e in best.items()}


def _longest(starts: set[int]) -> int:
    """Words from the first of the most successive passage starts to the end of the last."""
    longest = 0
    for s in starts:
        if s - 1 not in starts:
            n = 1
            while s + n in starts:
                n += 1
            longest = max(longest, n)
    return longest + PASSAGE - 1


_cache: dict[str, PassageIndex] = {}


def _digest(items: list[tuple[int, str]]) -> str:
    import xxhash

    h = xxhash.xxh3_128()
    for i, t in items:
        b = t.encode("utf-8", "surrogatepass")
        h.update(b"%d %d " % (i, len(b)))
        h.update(b)
    return h.hexdigest()


def _searcher(items: list[tuple[int, str]]):
    mark = _digest(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _cache.get(mark)
        if index is None:
            _cache.clear()
            index = _cache[mark] = PassageIndex(items)
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            if index.passages:
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if text:
                        out.extend((doc, item, e, n) for item, (e, n) in index.search(plain_words(text)).items())
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "run"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, run): documents that hold a passage of PASSAGE successive words of an item.

    A passage is split into BUDGET + 1 pieces of whole words, so one of them survives BUDGET edits: the
    documents are searched for the exact pieces of all items at once, and every hit's passage is decided
    by Myers' distance over words, exact ones (0 edits) too. Each passage is tried once per place, so the work
    grows with the copied length. edits is the least distance; run counts the words of the longest stretch
    of the document whose every passage is one of the item's (0 if no passage is exact). Whole texts are read in place:
    there is no shuffle of the corpus. Null and empty texts and items shorter than a passage match
    nothing; a repeated row is searched like any other.

    Items are evaluation sets: INDEX_BYTES of their texts are sent to the tasks at a time, and beyond that
    the corpus is read once for each such block of items, so neither a task nor the driver holds them all.
    """
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = known.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // INDEX_BYTES))
    out = None
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for k in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        hits = docs.mapInArrow(_searcher(sorted((r[0], r[1]) for r in part.collect())), _HITS)
        out = hits if out is None else out.unionByName(hits)
    # texts of one item in two blocks
    return out if blocks == 1 else out.distinct()
