"""Unigram encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

White space becomes a marker, each text gets one marker in front, and characters that no piece covers fall back to byte pieces. As no
piece runs from another character into a marker, texts are cut before markers into segments; each task encodes every distinct
segment of a batch once, all of them at the same time: the trie is walked for all positions together, and the
best paths grow one offset at a time for all segments together.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The white-space marker and the score of an uncovered character below the lowest piece score.
MARKER, UNKNOWN_PENALTY = "▁", 10.0
#: Distinct segments a task remembers before it starts anew.
REMEMBERED = 150_000
_SEGMENT = re.compile(r" *[^ \n▁]+| +|\n|▁")


def load_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) of a sentencepiece model file, in the order of ids; kind: piece, byte, unknown or control."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "piece"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class DoubleArray:
    """A trie over bytes: the child of state s by byte c is base[s] + c if check[] of that place is s; value holds ids."""

    def __init__(self, words: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        values = {0: -1}
        for word, value in words:
            node = 0
            for c in word:
                if c not in children[node]:
                    children.append({})
                    children[node][c] = len(children) - 1
                    values[len(children) - 1] = -1
                node = children[node][c]
            values[node] = value
        size = 4 * len(children) + 4096
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free, todo = np.ones(size, bool), [(0, 0)]
        free[0] = False
        self.check[0] = 0
        one, many = 1, 1  # where the search begins for nodes with one child and with more
        for node, state in todo:
            self.value[state] = values[node]
            codes = np.fromiter(children[node], np.int64, len(children[node]))
            if not len(codes):
                continue
            low, at = int(codes.min()), max(one if len(codes) == 1 else many, int(codes.min()) + 1)
            while True:
                places = np.flatnonzero(free[at : at + 1024]) + at - low
                fits = np.flatnonzero(free[places[:, None] + codes].all(axis=1))
                if len(fits):
                    break
                at += 1024
            base = int(places[fits[0]])
            if len(codes) == 1:
                one = base + low
            elif len(fits) < 8:
                many = max(many, at)
            self.base[state] = base
            free[base + codes] = False
            self.check[base + codes] = state
            todo.extend((children[node][int(c)], base + int(c)) for c in codes)
        used = int(np.flatnonzero(self.check >= 0)[-1]) + 257
        self.base, self.check, self.value = self.base[:used], self.check[:used], self.value[:used]


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        plain = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"]
        if any(MARKER in p.lstrip(MARKER) or " " in p or "\n" in p for p, _, _ in plain):
            raise ValueError("a piece runs from another character into white space")
        self.trie = DoubleArray([(p.encode(), i) for p, _, i in plain])
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown = min((s for _, s, _ in plain), default=0.0) - UNKNOWN_PENALTY
        self.bytes = np.zeros(256, np.int32)
        forms = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.bytes[int(p[3:5], 16)] = i
            forms.append(bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(MARKER, " ").encode() if kind == "piece" else b"")
        self.form = np.frombuffer(b"".join(forms), np.uint8)
        self.form_at = np.concatenate(([0], np.cumsum([len(f) for f in forms])))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _solve(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, their n+1 offsets)."""
        # A marker in the text itself isn't white space: NUL, which no piece holds, stands in its place on the trie.
        encoded = [s.replace(" ", MARKER).encode() for s in segments]
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        lengths = np.array([len(e) for e in encoded], np.int64)
        ends = np.cumsum(lengths)
        starts, n = ends - lengths, len(raw)
        literal = np.repeat(np.array([s == MARKER for s in segments], bool), lengths)
        last = np.repeat(ends, lengths)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        width = np.diff(np.append(heads, n))
        found, state, at, covered = [], np.zeros(len(heads), np.int32), heads, np.zeros(n, bool)
        char = np.zeros(n, np.int64)
        char[heads] = width
        keep = ~literal[heads]
        state, at, depth = state[keep], at[keep], 0
        while len(at):
            going = at + depth < last[at]
            at, state = at[going], state[going]
            place = self.trie.base[state] + raw[at + depth]
            hit = (self.trie.check[place] == state) & (self.trie.base[state] > 0)
            at, state = at[hit], place[hit]
            depth += 1
            ids = self.trie.value[state]
            whole = ids >= 0
            found.append((at[whole], np.full(whole.sum(), depth), ids[whole]))
            covered[at[whole & (char[at] == depth)]] = True
        lone = heads[~covered[heads]]
        found.append((lone, char[lone], np.full(len(lone), -1)))
        begin, span, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        gain = np.where(piece >= 0, self.scores[piece], self.unknown)
        offset = begin - np.repeat(starts, lengths)[begin]
        order = np.lexsort((begin, offset))
        begin, span, piece, gain, offset = begin[order], span[order], piece[order], gain[order], offset[order]
        # Node p + segment number is the state before byte p of the segment; one more node ends each segment.
        segment = np.repeat(np.arange(len(segments)), lengths)[begin]
        source, target = begin + segment, begin + segment + span
        best = np.full(n + len(segments), -np.inf)
        best[starts + np.arange(len(segments))] = 0
        back = np.full(n + len(segments), -1, np.int64)
        for a, b in _runs(offset):
            score, to = best[source[a:b]] + gain[a:b], target[a:b]
            better = score > best[to]
            best[to[better]] = score[better]
            back[to[better]] = np.arange(a, b)[better]
        # Follow all paths back at once.
        place, owner, steps = ends + np.arange(len(segments)), np.arange(len(segments)), []
        while len(place):
            edge = back[place]
            going = edge >= 0
            owner, edge = owner[going], edge[going]
            steps.append((owner, edge))
            place = source[edge]
        owner, edge = (np.concatenate(x) for x in zip(*steps, strict=True))
        depth = np.concatenate([np.full(len(o), -i) for i, (o, _) in enumerate(steps)])
        order = np.lexsort((depth, owner))
        owner, edge = owner[order], edge[order]
        # Uncovered characters become their bytes.
        size = np.where(piece[edge] >= 0, 1, span[edge])
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        each = np.repeat(edge, size)
        ids = np.where(piece[each] >= 0, piece[each], self.bytes[raw[np.minimum(begin[each] + inner, n - 1)]]).astype(np.int32)
        return ids, np.concatenate(([0], np.cumsum(np.bincount(owner, weights=size, minlength=len(segments)).astype(np.int64))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their n+1 offsets); an empty text gives no ids."""
        split = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self._forget()
        fresh = list({s for words in split for s in words} - self.known.keys())
        if fresh:
            ids, at = self._solve(fresh)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.at = np.concatenate((self.at, at[1:] + self.at[-1]))
            self.ids = np.concatenate((self.ids, ids))
        known = self.known
        which = np.fromiter((known[s] for words in split for s in words), np.int64, sum(map(len, split)))
        size = self.at[which + 1] - self.at[which]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out = self.ids[np.repeat(self.at[which], size) + inner]
        per_text = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)
        return out, np.concatenate(([0], np.cumsum(size)))[per_text]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of ids: byte pieces give their bytes, markers spaces, and the first space goes."""
        size = self.form_at[ids + 1] - self.form_at[ids]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        raw = self.form[np.repeat(self.form_at[ids], size) + inner].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[at]
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _runs(x: np.ndarray):
    cuts = np.flatnonzero(np.diff(x)) + 1
    yield from zip(np.append(0, cuts), np.append(cuts, len(x)), strict=True) if len(x) else ()


def _grouped(texts: list[str], limit: int = 1_000_000):
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= limit:
            yield group
            group, chars = [], 0
    if group:
        yield group


def _encoded(pieces):
    def run(batches):
        model = pieces.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts, same = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
            for group in _grouped(texts):
                out, at = model.encode(group)
                ids.append(out)
                counts.append(np.diff(at))
                same += [a == b for a, b in zip(model.decode(out, at), group, strict=True)]
            counts = np.concatenate(counts)
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed, pa.array(counts), pa.array(same, pa.bool_())], names=["id", "token_ids", "n_tokens", "round_trip"])

    return run


def _decoded(pieces):
    def run(batches):
        model = pieces.value
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                lists = [np.array(x or [], np.int64) for x in part.column(1).to_pylist()]
                texts = model.decode(np.concatenate([np.zeros(0, np.int64), *lists]), np.concatenate(([0], np.cumsum([len(x) for x in lists]))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text: (id, token_ids, n_tokens, round_trip).

    round_trip tells whether decoding gives the text back, which holds for every text. Null and empty texts give no ids; a
    marker character in a text falls back to bytes; a null id is kept; an empty table gives no rows. The vocabulary is
    broadcast; its size is that of the model file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = spark.sparkContext.broadcast(Unigram(load_pieces(model_path)))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(_encoded(pieces), "id long, token_ids array<int>, n_tokens long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Decode every list of ids: (id, text). Null and empty lists give empty texts."""
    spark = rows.sparkSession
    small_batches(spark)
    pieces = spark.sparkContext.broadcast(Unigram(load_pieces(model_path)))
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(_decoded(pieces), "id long, text string").withColumnRenamed("id", id_col)
