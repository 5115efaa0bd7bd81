"""Token similarity of two normalised texts for use inside grouped Python steps; the Column version is in `text`."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=1 << 18)
def _fit(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 5 and short in long:
        return 0.85
    if len(short) >= 2 and long.startswith(short):
        return 0.8 if len(short) >= 4 else 0.55
    letters = iter(long)
    taken = 0
    for c in letters:
        taken += taken < len(short) and c == short[taken]
    return 0.72 if len(short) >= 4 and 2 * len(short) >= len(long) and taken == len(short) else 0.0


def similarity(a: str, b: str) -> float:
    """Both texts already normalised."""
    if not a or not b or a == b:
        return float(bool(a) and a == b)
    left, right = ([t for t in x.split(" ") if len(t) > 1] for x in (a, b))
    if not left or not right:
        return 0.0
    total, free_left, free_right = 0.0, set(range(len(left))), set(range(len(right)))
    for score, i, j in sorted((-_fit(x, y), i, j) for i, x in enumerate(left) for j, y in enumerate(right)):
        if score < 0 and i in free_left and j in free_right:
            total -= score
            free_left.discard(i)
            free_right.discard(j)
    return max(2 * total / (len(left) + len(right)), 0.92 * total / min(len(left), len(right)))


#: Length of the pieces by which tokens that contain one another are found.
PIECE = 5


def alike(a: str, b: str, least: float) -> bool:
    """Whether similarity(a, b) reaches `least`; decided by a bound where that suffices: no token can give more than its best partner."""
    if a == b:
        return bool(a) and least <= 1
    left, right = sorted(([t for t in x.split(" ") if len(t) > 1] for x in (a, b)), key=len)
    if not left:
        return least <= 0
    wanted = min(least * (len(left) + len(right)) / 2, least / 0.92 * len(left))
    open_ = len(left)
    for t in left:
        # What the tokens so far fall short of the most that they could give.
        open_ -= 1 - max(_fit(t, u) if len(t) <= len(u) else _fit(u, t) for u in right)
        if open_ < wanted - 1e-9:
            return False
    return similarity(a, b) >= least


def pieces(text: str) -> set[str]:
    """Keys of which two texts share at least one if their similarity reaches 0.78.

    The token scores of such texts average at least 0.78 over the text with fewer tokens, so some pair of tokens scores 0.8 or more: equal tokens, one of five letters and more within the other, and then with
    all its pieces, or one of four letters at the start of the other.
    """
    tokens = {t for t in text.split(" ") if len(t) > 1}
    return tokens | {t[i : i + PIECE] for t in tokens for i in range(len(t) - PIECE + 1)} | {f"^{t[:4]}" for t in tokens if len(t) > 3}


class Anchors:
    """The anchors of one key in their order, found by shared pieces."""

    def __init__(self, least: float):
        self._least, self._held, self._by_piece = least, [], {}

    def place(self, text: str, name: str) -> str:
        """The name of the first anchor that the text is like, or its own as a new anchor."""
        own = pieces(text)
        for n in sorted({n for p in own for n in self._by_piece.get(p, ())}):
            if alike(self._held[n][0], text, self._least):
                return self._held[n][1]
        for p in own:
            self._by_piece.setdefault(p, []).append(len(self._held))
        self._held.append((text, name))
        return name
