"""One-to-one assignment over adjacency lists: memory follows the edges of a component, not its rows times its columns.

Every row has a place of its own that counts as an edge of weight zero, so a row may stay free. Shortest augmenting paths run over a heap and touch only the columns they reach.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np


@dataclass(frozen=True)
class Graph:
    """Edges by row: those of row i stand at start[i] to start[i + 1]. Column m + i is the free place of row i; costs are the largest weight less the weight."""

    n: int
    m: int
    start: np.ndarray
    columns: np.ndarray
    cost: np.ndarray


def graph(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, n: int, m: int) -> Graph:
    """The graph of n rows and m columns with the given edges; of parallel edges the heaviest counts, edges without a positive weight don't."""
    good = np.asarray(weights) > 0
    places = np.arange(n)
    r, c = np.concatenate((np.asarray(rows)[good], places)), np.concatenate((np.asarray(columns)[good], m + places))
    w = np.concatenate((np.asarray(weights, float)[good], np.zeros(n)))
    order = np.lexsort((-w, c, r))
    r, c, w = r[order], c[order], w[order]
    first = np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1]))) if len(r) else np.zeros(0, bool)
    r, c, w = r[first], c[first], w[first]
    return Graph(n, m, np.searchsorted(r, np.arange(n + 1)), c, (w.max() if len(w) else 0.0) - w)


def optimum(g: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row potentials, column potentials, row that holds each column or -1) of a largest total weight. Of equal optima the one that favours earlier rows."""
    size = g.m + g.n
    u, v, owner = np.zeros(g.n), np.zeros(size), np.full(size, -1)
    reach, came, done = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool)
    # Of equally near columns free ones come first, and of free places those of later rows, so that later rows give way.
    rank = np.concatenate((np.arange(g.m), np.arange(size - 1, g.m - 1, -1)))
    for row in range(g.n):
        heap, touched, closed, at, column, base = [], [], [], row, -1, 0.0
        while True:
            near = g.columns[g.start[at] : g.start[at + 1]]
            step = base + g.cost[g.start[at] : g.start[at + 1]] - u[at] - v[near]
            closer = (step < reach[near]) & ~done[near]
            near, step = near[closer], step[closer]
            reach[near], came[near] = step, column
            touched.append(near)
            for entry in zip(step.tolist(), (owner[near] >= 0).tolist(), rank[near].tolist(), strict=True):
                heappush(heap, entry)
            while True:
                base, _, place = heappop(heap)
                column = int(rank[place])
                if not done[column]:
                    break
            done[column] = True
            if owner[column] < 0:
                break
            closed.append(column)
            at = owner[column]
        u[row] += base
        for j in closed:
            u[owner[j]] += base - reach[j]
            v[j] -= base - reach[j]
        done[closed], done[column] = False, False
        path = column
        while path >= 0:
            before = came[path]
            owner[path] = row if before < 0 else owner[before]
            path = before
        reach[np.concatenate(touched)] = np.inf
    return u, v, owner


def chosen(g: Graph, owner: np.ndarray) -> np.ndarray:
    """The column of each row, or -1 where it keeps its free place."""
    out = np.full(g.n, -1)
    held = np.flatnonzero(owner[: g.m] >= 0)
    out[owner[held]] = held
    return out


def _nearest(start: np.ndarray, to: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shortest distances over a graph by row when each row may be entered at the cost `first`."""
    reach, done = first.copy(), np.zeros(len(first), bool)
    heap = [(d, i) for i, d in enumerate(first.tolist()) if d < np.inf]
    heapify(heap)
    while heap:
        d, i = heappop(heap)
        if done[i]:
            continue
        done[i] = True
        near, step = to[start[i] : start[i + 1]], d + length[start[i] : start[i + 1]]
        closer = step < reach[near]
        # Two columns never have one holder, so no row occurs twice here.
        reach[near[closer]] = step[closer]
        for entry in zip(step[closer].tolist(), near[closer].tolist(), strict=True):
            heappush(heap, entry)
    return reach


def _circles(start: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A number for each row that two rows share if and only if each can reach the other."""
    n = len(start) - 1
    low, index, label, at = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1), start[:-1].copy()
    pending, count, labels = [], 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path = [root]
        while path:
            i = path[-1]
            if index[i] < 0:
                index[i] = low[i] = count
                count += 1
                pending.append(i)
            while at[i] < start[i + 1] and index[to[at[i]]] >= 0:
                j = to[at[i]]
                if label[j] < 0:
                    low[i] = min(low[i], index[j])
                at[i] += 1
            if at[i] < start[i + 1]:
                path.append(int(to[at[i]]))
                at[i] += 1
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[i])
            if low[i] == index[i]:
                while True:
                    j = pending.pop()
                    label[j] = labels
                    if j == i:
                        break
                labels += 1
    return label


def _circle_through(i: int, start: np.ndarray, to: np.ndarray, length: np.ndarray, circle: np.ndarray, limit: float) -> float:
    """Length of the shortest way from row i back to itself within its circle, or the limit if none is shorter."""
    reach, heap, done = {}, [(0.0, i)], set()
    while heap:
        d, r = heappop(heap)
        if d >= limit:
            break
        if r in done:
            continue
        done.add(r)
        for s, step in zip(to[start[r] : start[r + 1]].tolist(), (d + length[start[r] : start[r + 1]]).tolist(), strict=True):
            if step >= limit or circle[s] != circle[i]:
                continue
            if s == i:
                limit = step
            elif step < reach.get(s, np.inf):
                reach[s] = step
                heappush(heap, (step, s))
    return limit


def margins(g: Graph, u: np.ndarray, v: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How much total weight the best assignment without a row's pair loses, for each row that has one.

    The best assignment without a pair differs from the optimum by one alternating walk through it. Among rows, a step leads from a row to the holder of a column that it could take instead, at the reduced
    cost. The walk either comes back to the row, or it ends on a column that nobody holds while another row, or nobody, takes over the column given up: the ends of the second kind are two shortest path
    trees for all rows at once. Walks that come back are looked for only in circles of rows, and not at all where a circle of cost zero passes.
    """
    row = np.repeat(np.arange(g.n), np.diff(g.start))
    reduced = np.maximum(g.cost - u[row] - v[g.columns], 0.0)
    holder = owner[g.columns]
    leave = np.minimum.reduceat(np.where(holder < 0, reduced, np.inf), g.start[:-1]) if g.n else np.zeros(0)
    enter = np.full(g.n, np.inf)
    held = np.flatnonzero(owner >= 0)
    enter[owner[held]] = -v[held]
    on = (holder >= 0) & (holder != row)
    row, to, length = row[on], holder[on], reduced[on]
    start = np.searchsorted(row, np.arange(g.n + 1))
    back = np.argsort(to, kind="stable")
    leave = _nearest(np.searchsorted(to[back], np.arange(g.n + 1)), row[back], length[back], leave)
    loss = leave + _nearest(start, to, length, enter)
    circle, still = _circles(start, to), length == 0
    level = _circles(np.searchsorted(row[still], np.arange(g.n + 1)), to[still])
    several, flat = np.bincount(circle, minlength=g.n) > 1, np.bincount(level, minlength=g.n) > 1
    for i in np.flatnonzero(chosen(g, owner) >= 0):
        if loss[i] > 0 and several[circle[i]]:
            loss[i] = 0.0 if flat[level[i]] else _circle_through(int(i), start, to, length, circle, float(loss[i]))
    return loss


def transport(g: Graph, supply: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[dict[int, int]]]:
    """optimum() for rows and columns that stand for several: (row potentials, column potentials, how much each column holds of each row). A path carries as much as it can at once."""
    size = g.m + g.n
    u, v, hold = np.zeros(g.n), np.zeros(size), [{} for _ in range(size)]
    spare = np.concatenate((room, np.full(g.n, supply.sum() + 1)))
    reach, came, done, seen = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool), np.zeros(g.n, bool)
    rank = np.concatenate((np.arange(g.m), np.arange(size - 1, g.m - 1, -1)))
    for row in range(g.n):
        left = int(supply[row])
        while left:
            heap, touched, closed, rows, through, base, fresh = [], [], [], [(row, 0.0)], {}, 0.0, [row]
            seen[row] = True
            while True:
                for at in fresh:
                    near = g.columns[g.start[at] : g.start[at + 1]]
                    step = base + g.cost[g.start[at] : g.start[at + 1]] - u[at] - v[near]
                    closer = (step < reach[near]) & ~done[near]
                    near, step = near[closer], step[closer]
                    reach[near], came[near] = step, at
                    touched.append(near)
                    for entry in zip(step.tolist(), (spare[near] == 0).tolist(), rank[near].tolist(), strict=True):
                        heappush(heap, entry)
                while True:
                    base, _, place = heappop(heap)
                    column = int(rank[place])
                    if not done[column]:
                        break
                done[column] = True
                if spare[column]:
                    break
                closed.append(column)
                fresh = [i for i in hold[column] if not seen[i]]
                for i in fresh:
                    seen[i], through[i] = True, column
                    rows.append((i, base))
            for i, d in rows:
                u[i] += base - d
                seen[i] = False
            for j in closed:
                v[j] -= base - reach[j]
            done[closed], done[column] = False, False
            path, at = [], column
            while True:
                i = int(came[at])
                path.append((i, at))
                if i == row:
                    break
                at = through[i]
            much = min([left, int(spare[column]), *(hold[through[i]][i] for i, _ in path if i != row)])
            for i, j in path:
                hold[j][i] = hold[j].get(i, 0) + much
                if i != row:
                    before = hold[through[i]]
                    before[i] -= much
                    if not before[i]:
                        del before[i]
            spare[column] -= much
            left -= much
            reach[np.concatenate(touched)] = np.inf
    return u, v, hold


def flows(g: Graph, supply: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, float]]:
    """A largest assignment of rows and columns that stand for several: (row, column, number of pairs, margin of such a pair), by row and the heavier first. Margins as in margins(); they are zero where row or column stands for several."""
    u, v, hold = transport(g, supply, room)
    used = np.array([sum(h.values()) for h in hold], dtype=np.int64)
    row = np.repeat(np.arange(g.n), np.diff(g.start))
    reduced = np.maximum(g.cost - u[row] - v[g.columns], 0.0)
    # Nodes are rows and then columns: a row may move to each of its columns, a column frees each row that it holds.
    pairs = np.array([(i, j) for j, h in enumerate(hold) for i in h], dtype=np.int64).reshape(-1, 2)
    tail, head = np.concatenate((row, g.n + pairs[:, 1])), np.concatenate((g.n + g.columns, pairs[:, 0]))
    length, nodes = np.concatenate((reduced, np.zeros(len(pairs)))), 2 * g.n + g.m
    out, back = np.argsort(tail, kind="stable"), np.argsort(head, kind="stable")
    start, to, length_out = np.searchsorted(tail[out], np.arange(nodes + 1)), head[out], length[out]
    free, held = np.full(nodes, np.inf), np.full(nodes, np.inf)
    spare = np.concatenate((used[: g.m] < room, np.ones(g.n, bool)))
    free[g.n :][spare] = 0.0
    held[g.n :][used > 0] = -v[used > 0]
    single = [(i, j) for i, j in pairs.tolist() if j < g.m and supply[i] == 1 and room[j] == 1]
    loss = {}
    if single:
        leave, enter = _nearest(np.searchsorted(head[back], np.arange(nodes + 1)), tail[back], length[back], free), _nearest(start, to, length_out, held)
        for i, j in single:
            limit = float(leave[i] + enter[g.n + j])
            loss[i, j] = _way_back(i, g.n + j, start, to, length_out, limit) if limit > 0 else 0.0
    # Of alike rows the earlier ones take the heavier pairs.
    cost = dict(zip(zip(row.tolist(), g.columns.tolist(), strict=True), g.cost.tolist(), strict=True))
    return [(i, j, n, loss.get((i, j), 0.0)) for i, _, j, n in sorted((i, cost[i, j], j, n) for j, h in enumerate(hold[: g.m]) for i, n in h.items())]


def _way_back(i: int, j: int, start: np.ndarray, to: np.ndarray, length: np.ndarray, limit: float) -> float:
    """Length of the shortest way from row i to the column j that holds it without the pair itself, or the limit if none is shorter."""
    reach, heap, done = {}, [(0.0, i)], set()
    while heap:
        d, at = heappop(heap)
        if d >= limit:
            break
        if at in done:
            continue
        done.add(at)
        for node, step in zip(to[start[at] : start[at + 1]].tolist(), (d + length[start[at] : start[at + 1]]).tolist(), strict=True):
            if step >= limit or at == i and node == j:
                continue
            if node == j:
                limit = step
            elif step < reach.get(node, np.inf):
                reach[node] = step
                heappush(heap, (step, node))
    return limit


def _from_matrix(weights: np.ndarray) -> Graph:
    rows, columns = np.nonzero(weights > 0)
    return graph(rows, columns, weights[rows, columns], *weights.shape)


def solve(weights: np.ndarray) -> tuple[float, list[int]]:
    """Largest total weight of a one-to-one assignment in which rows may stay free: (total, column of each row or -1)."""
    g = _from_matrix(weights)
    pairs = chosen(g, optimum(g)[2]).tolist()
    return float(sum(weights[i, j] for i, j in enumerate(pairs) if j >= 0)), pairs


def solve_with_margins(weights: np.ndarray) -> tuple[list[int], list[float]]:
    """The column of each row as in solve(), and how much total weight the best assignment without that pair loses (0 for a row without one)."""
    g = _from_matrix(weights)
    found = optimum(g)
    pairs = chosen(g, found[2])
    return pairs.tolist(), np.where(pairs >= 0, margins(g, *found), 0.0).tolist()
