"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with an error budget of k edits. Cut into k+1 pieces, at least one piece of any such occurrence is
unchanged; one Aho-Corasick pass finds all piece hits of a block of items, and Myers' bit-parallel algorithm measures the
edit distance of the item within the windows around them. Items come in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Edits allowed per character of a normalised item; shortest piece; items and characters of a block.
RATE, PIECE, BLOCK_ITEMS, BLOCK_CHARS = 0.08, 8, 5000, 4_000_000
_WORD = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    """Lower-cased runs of word characters with single spaces between them."""
    return " ".join(_WORD.findall((text or "").lower()))


def budget(length: int, rate: float = RATE) -> int:
    """Edits allowed for an item; pieces of fewer than PIECE characters would hit everywhere."""
    return max(0, min(int(rate * length), length // PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k+1 pieces of about equal length."""
    ends = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def myers(pattern: str, text: str) -> int:
    """Least edit distance between the pattern and any substring of the text, by Myers' bit vectors in one large integer."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        best = min(best, score)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(vertical | plus) & full, plus & vertical
    return best


class ItemMatcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, places = [], {}
        for item_id, text in items:
            if text:
                k = budget(len(text), rate)
                for offset, piece in pieces(text, k):
                    places.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, text, k))
        self.finder = ahocorasick.Automaton()
        for piece, where in places.items():
            self.finder.add_word(piece, (len(piece), where))
        if places:
            self.finder.make_automaton()

    def matches(self, text: str, first: bool = False) -> list[tuple[int, int, int]]:
        """(item id, distance, budget) of items that occur within their budget, or the first one found."""
        if not self.items or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (n, where) in self.finder.iter(text):
            for i, offset in where:
                starts.setdefault(i, []).append(end - n + 1 - offset)
        out = []
        for i, at in starts.items():
            item_id, item, k = self.items[i]
            distance, at = k + 1, sorted(at)
            low = high = None
            for start in [*at, None]:
                if low is not None and (start is None or start - k > high):
                    window = text[max(low, 0) : high]
                    distance = min(distance, 0 if item in window else myers(item, window))
                    low = None
                    if not distance:
                        break
                if start is not None:
                    low = start - k if low is None else low
                    high = start + len(item) + k
            if distance <= k:
                out.append((item_id, distance, k))
                if first:
                    break
        return out


def _matched(items: list[tuple[int, str]], rate: float):
    def run(batches):
        matcher = ItemMatcher(items, rate)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in matcher.matches(normalise(text.as_py()))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc", "item", "distance", "budget"])

    return run


def _blocks(benchmark: DataFrame):
    """Blocks of normalised items of bounded number and length, so that each automaton has a bounded size."""
    block, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().toLocalIterator():
        block.append((row[0], normalise(row[1])))
        chars += len(block[-1][1])
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    yield block


def _clean(items: list[tuple[int, str]], rate: float, place: int):
    """Batches without the rows whose text, the column at `place`, holds an item."""

    def run(batches):
        matcher = ItemMatcher(items, rate)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.matches(normalise(text.as_py()), first=True) for text in batch.column(place)], pa.bool_()))

    return run


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item occurs within its edit budget. Block after block of items works on what the one before left, in one pass over the texts."""
    small_batches(docs.sparkSession)
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(_clean(block, rate, docs.columns.index(text_col)), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Benchmark items that occur in documents within their error budget: (id, item_id, distance, budget), one row per pair of a row and an item.

    Both sides are lower-cased and reduced to words; a budget counts characters of that form. Null, empty and punctuation-only texts and items match nothing;
    items with a null id are left out; repeated rows give repeated matches; texts of any length are searched whole; an empty table on either side gives no rows.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    parts = [source.mapInArrow(_matched(block, rate), "doc long, item long, distance int, budget int") for block in _blocks(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), "distance", "budget")
