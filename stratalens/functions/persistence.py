"""Persistence of one filtered complex inside a task: homology, cohomology, vines, zigzags, forests that change.

Cells are (value, vertices); everything is over the field of two elements. Bars are
(dimension, birth, death) by value, or by index where the order itself is the parameter.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np

INF = math.inf


def combinatorial_index(vertices: tuple[int, ...]) -> int:
    """A number for each set of vertices: sum of binomials of the sorted vertices."""
    return sum(math.comb(v, k + 1) for k, v in enumerate(sorted(vertices)))


def faces(v: tuple[int, ...]) -> list[tuple[int, ...]]:
    return [v[:k] + v[k + 1 :] for k in range(len(v))] if len(v) > 1 else []


class Filtration:
    """Cells ordered by (value, dimension, combinatorial index); every face must come no later than its cell."""

    def __init__(self, cells: list[tuple[float, tuple[int, ...]]]):
        rows = [(float(x), tuple(sorted(v))) for x, v in cells]
        rows.sort(key=lambda c: (c[0], len(c[1]), combinatorial_index(c[1]) if c[1] and c[1][0] >= 0 else 0, c[1]))
        self.value = [x for x, _ in rows]
        self.vertices = [v for _, v in rows]
        self.dim = [len(v) - 1 for v in self.vertices]
        self.index = {v: i for i, v in enumerate(self.vertices)}
        if len(self.index) != len(rows):
            raise ValueError("a cell stands twice")
        self.boundary: list[list[int]] = []
        for i, v in enumerate(self.vertices):
            b = []
            for f in faces(v):
                j = self.index.get(f)
                if j is None or j > i:
                    raise ValueError(f"a face of {v} is missing or later")
                b.append(j)
            self.boundary.append(sorted(b))
        self.coboundary: list[list[int]] = [[] for _ in rows]
        for j, b in enumerate(self.boundary):
            for i in b:
                self.coboundary[i].append(j)

    def __len__(self) -> int:
        return len(self.value)


def full_rips(points: np.ndarray, threshold: float = INF, top: int = 2) -> Filtration:
    """All simplices up to a dimension whose points are pairwise within ``threshold``, at their greatest distance."""
    x = np.asarray(points, float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    cells = [(0.0, (i,)) for i in range(len(x))]
    for k in range(2, top + 2):
        for v in itertools.combinations(range(len(x)), k):
            w = max(d[a, b] for a, b in itertools.combinations(v, 2))
            if w <= threshold:
                cells.append((float(w), v))
    return Filtration(cells)


def reduce(f: Filtration, chains: bool = False) -> tuple[list[tuple[int, int]], list[int], dict[int, set[int]]]:
    """(pairs, unpaired, cycles): by boundary columns from left to right, skipping columns known to be births (clearing).

    With ``chains``, cycles[i] are the cells of a cycle born at cell i: the reduced column that
    kills it, or for one that never dies the cells added up to make its column vanish.
    """
    low: dict[int, int] = {}
    columns: dict[int, set[int]] = {}
    took: dict[int, set[int]] = {}
    cycles: dict[int, set[int]] = {}
    births: set[int] = set()
    order = sorted(range(len(f)), key=lambda j: (-f.dim[j], j)) if not chains else range(len(f))
    for j in order:
        if j in births and not chains:
            continue
        col, own = set(f.boundary[j]), {j}
        while col and max(col) in low:
            k = low[max(col)]
            col ^= columns[k]
            if chains:
                own ^= took[k]
        if col:
            i = max(col)
            low[i], columns[j] = j, col
            births.add(i)
            cycles[i] = col
        elif chains:
            cycles.setdefault(j, own)
        if chains:
            took[j] = own
    pairs = sorted((i, j) for i, j in low.items())
    dead = {i for p in pairs for i in p}
    return pairs, [i for i in range(len(f)) if i not in dead], cycles


def homology(f: Filtration, cutoff: float | None = None, representatives: bool = False) -> list[tuple]:
    """(dimension, birth, death[, cycle as vertex tuples]) bars; ``cutoff`` drops those no longer than it."""
    pairs, ever, cycles = reduce(f, representatives)
    out = []
    for i, death in [*((i, f.value[j]) for i, j in pairs), *((i, INF) for i in ever)]:
        if cutoff is None or death - f.value[i] > cutoff:
            bar = (f.dim[i], f.value[i], death)
            out.append((*bar, sorted(f.vertices[k] for k in cycles.get(i, ()))) if representatives else bar)
    return sorted(out)


def cohomology(f: Filtration, cutoff: float | None = None) -> list[tuple[int, float, float]]:
    """The same bars by coboundary columns from right to left, dimension by dimension, with deaths cleared."""
    low: dict[int, int] = {}  # first cell of a reduced column -> its column
    columns: dict[int, set[int]] = {}
    killed: set[int] = set()
    ever = []
    for d in range(max(f.dim, default=0) + 1):
        for i in sorted((k for k in range(len(f)) if f.dim[k] == d and k not in killed), reverse=True):
            col = set(f.coboundary[i])
            while col and min(col) in low:
                col ^= columns[low[min(col)]]
            if col:
                j = min(col)
                low[j], columns[i] = i, col
                killed.add(j)
            else:
                ever.append(i)
    bars = [(f.dim[i], f.value[i], f.value[j]) for j, i in low.items()] + [(f.dim[i], f.value[i], INF) for i in ever]
    return sorted(b for b in bars if cutoff is None or b[2] - b[1] > cutoff)


def relative(f: Filtration, inside: set[tuple[int, ...]]) -> list[tuple[int, float, float]]:
    """Bars of the pair: cells of the subcomplex ``inside`` count as nothing."""
    keep = [i for i in range(len(f)) if f.vertices[i] not in inside]
    at = {i: k for k, i in enumerate(keep)}
    low: dict[int, int] = {}
    columns: dict[int, set[int]] = {}
    for k, i in enumerate(keep):
        col = {at[b] for b in f.boundary[i] if b in at}
        while col and max(col) in low:
            col ^= columns[low[max(col)]]
        if col:
            low[max(col)], columns[k] = k, col
    dead = {x for p in low.items() for x in p}
    bars = [(f.dim[keep[i]], f.value[keep[i]], f.value[keep[j]]) for i, j in low.items()] + [(f.dim[keep[i]], f.value[keep[i]], INF) for i in range(len(keep)) if i not in dead]
    return sorted(bars)


def cycle_edges(cycle: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """A one-cycle's edges."""
    return sorted(v for v in cycle if len(v) == 2)


def loops(cycle: list[tuple[int, ...]]) -> list[list[int]]:
    """A one-cycle's edges as closed walks, one for each part."""
    near = defaultdict(list)
    for a, b in cycle_edges(cycle):
        near[a].append(b)
        near[b].append(a)
    out = []
    while any(near.values()):
        start = min(v for v, n in near.items() if n)
        walk = [start]
        while True:
            v = walk[-1]
            w = min(near[v])
            near[v].remove(w)
            near[w].remove(v)
            if w == start and not (near[start]):
                break
            if w == start:
                break
            walk.append(w)
        out.append(walk)
    return out


class Vineyard:
    """A reduced boundary matrix D V = R whose order changes by swaps of neighbours, each repaired where it breaks."""

    def __init__(self, f: Filtration):
        self.order = list(range(len(f)))
        self.f = f
        self._all()

    def _all(self) -> None:
        at = {c: k for k, c in enumerate(self.order)}
        self.r = [{at[b] for b in self.f.boundary[c]} for c in self.order]
        self.v = [{k} for k in range(len(self.order))]
        self.low: dict[int, int] = {}
        for j in range(len(self.order)):
            while self.r[j] and max(self.r[j]) in self.low:
                k = self.low[max(self.r[j])]
                self._add(k, j)
            if self.r[j]:
                self.low[max(self.r[j])] = j

    def _add(self, k: int, j: int) -> None:
        self.r[j] = self.r[j] ^ self.r[k]
        self.v[j] = self.v[j] ^ self.v[k]

    def pairs(self) -> list[tuple[int, int]]:
        return sorted(self.low.items())

    def swap(self, i: int) -> bool:
        """Cells at places i and i + 1 change places; returns whether the pairing of cells changed. A cell cannot pass its face."""
        a, b = self.order[i], self.order[i + 1]
        if a in self.f.boundary[b]:
            raise ValueError("a cell cannot come before its face")
        before = {(self.order[x], self.order[y]) for x, y in self.low.items()}
        if i in self.v[i + 1] and self.f.dim[a] == self.f.dim[b]:
            self._add(i, i + 1)  # columns are added from the left only: free the later one of the earlier
        turn = {i: i + 1, i + 1: i}
        move = lambda s: {turn.get(x, x) for x in s}
        self.order[i], self.order[i + 1] = b, a
        self.r = [move(s) for s in self.r]
        self.v = [move(s) for s in self.v]
        self.r[i], self.r[i + 1] = self.r[i + 1], self.r[i]
        self.v[i], self.v[i + 1] = self.v[i + 1], self.v[i]
        # at most a few columns share a lowest row now: reduce from left to right what clashes
        self.low = {}
        for j in range(len(self.order)):
            while self.r[j] and max(self.r[j]) in self.low:
                self._add(self.low[max(self.r[j])], j)
            if self.r[j]:
                self.low[max(self.r[j])] = j
        return before != {(self.order[x], self.order[y]) for x, y in self.low.items()}


# Zigzags: steps (True, cell) to add and (False, cell) to remove

def zigzag(steps: list[tuple[bool, tuple[int, ...]]]) -> list[tuple[int, int, int]]:
    """(dimension, first, last) bars over complexes 1 .. n after each step, by one ordinary filtration.

    Every addition is a cell of its own (a cell that comes again is a new one); all of them come
    first, then cones over what is left in the order of removal from the last to the first.
    What still stands at the end is removed behind it. The bars of that filtration are
    the zigzag's, read off from the steps that its pairs stand for.
    """
    n = len(steps)
    live: dict[tuple[int, ...], int] = {}
    cells: list[tuple[int, list[int], int]] = []  # dimension, boundary by cell numbers, step of addition
    gone: dict[int, int] = {}
    for t, (add, c) in enumerate(steps, 1):
        c = tuple(sorted(c))
        if add:
            if c in live:
                raise ValueError(f"{c} is there already")
            live[c] = len(cells)
            cells.append((len(c) - 1, [live[x] for x in faces(c)], t))
        else:
            if any(c in faces(x) for x in live):
                raise ValueError(f"{c} is the face of another cell")
            gone[live.pop(c)] = t
    t = n
    for c in sorted(live, key=lambda x: (-len(x), x)):
        t += 1
        gone[live[c]] = t
    m = len(cells)
    # 0: the cone's tip; 1 .. m: additions; then cones over cells, the last removed first
    down = sorted(range(m), key=lambda c: -gone[c])
    place = {c: m + 1 + k for k, c in enumerate(down)}
    boundary = [[]] + [[b + 1 for b in cells[c][1]] for c in range(m)]
    for c in down:
        boundary.append([c + 1, *(([place[b] for b in cells[c][1]]) or [0])])
    low: dict[int, int] = {}
    columns: dict[int, set[int]] = {}
    for j, b in enumerate(boundary):
        col = set(b)
        while col and max(col) in low:
            col ^= columns[low[max(col)]]
        if col:
            low[max(col)], columns[j] = j, col
    bars = []
    cell_of = {p: c for c, p in place.items()}
    for i, j in low.items():
        if i == 0 or j == 0:
            continue
        if i <= m and j <= m:  # born and dead by additions
            a, b, d = cells[i - 1][2], cells[j - 1][2] - 1, cells[i - 1][0]
        elif i <= m:  # born by an addition, dead by a removal, or the other way round a dimension lower
            add, cut, d = cells[i - 1][2], gone[cell_of[j]], cells[i - 1][0]
            a, b, d = (add, cut - 1, d) if add < cut else (cut, add - 1, d - 1)
        else:  # both by removals: the one removed first opens the bar
            x, y = gone[cell_of[i]], gone[cell_of[j]]
            a, b, d = min(x, y), max(x, y) - 1, cells[cell_of[i]][0]
        if a <= min(b, n):
            bars.append((d, a, min(b, n)))
    return sorted(bars)


def _rank(rows: list[int]) -> int:
    """Of bit rows over two elements."""
    basis: dict[int, int] = {}
    for r in rows:
        while r:
            h = r.bit_length()
            if h not in basis:
                basis[h] = r
                break
            r ^= basis[h]
    return len(basis)


def zigzag_plain(steps: list[tuple[bool, tuple[int, ...]]], top: int) -> list[tuple[int, int, int]]:
    """The same bars from ranks: of all cycles at hand over an interval modulo all boundaries there, for small complexes only.

    How many bars span [a, b] is the rank of the map from the limit to the colimit of the
    homology groups over it; inclusion and exclusion leave those that are no longer.
    """
    states, now = [], set()
    for add, c in steps:
        now = now | {tuple(sorted(c))} if add else now - {tuple(sorted(c))}
        states.append(now)
    n, out = len(states), []
    for d in range(top + 1):
        names = {c: k for k, c in enumerate(sorted({c for s in states for c in s if len(c) == d + 1}))}

        def space(s, names=names, d=d):
            """(basis of cycles, basis of boundaries) of one complex as bit rows."""
            own = [c for c in s if len(c) == d + 1]
            kernel, basis = [], {}
            for c in own:
                row, mark = 0, 1 << names[c]
                for x in faces(c):
                    row ^= 1 << (combinatorial_index(x) if d else 0)
                while row and row.bit_length() in basis:
                    r, m = basis[row.bit_length()]
                    row, mark = row ^ r, mark ^ m
                if row:
                    basis[row.bit_length()] = (row, mark)
                else:
                    kernel.append(mark)
            return kernel, [sum(1 << names[x] for x in faces(c)) for c in s if len(c) == d + 2]

        spaces = [space(s) for s in states]

        def spans(a: int, b: int) -> int:
            if a < 0 or b >= n:
                return 0
            # limit: compatible families of classes; colimit: all classes with every arrow's ends identified
            offset, width = [0], len(names)
            for t in range(a, b + 1):
                offset.append(offset[-1] + len(spaces[t][0]))
            rows = []  # equations: neighbours' cycles differ by a boundary of the larger one
            gens = offset[-1]
            extra = gens
            for t in range(a, b):
                bigger = t if len(states[t]) > len(states[t + 1]) else t + 1
                for bit in range(width):
                    row = 0
                    for k, z in enumerate(spaces[t][0]):
                        row |= (z >> bit & 1) << (offset[t - a] + k)
                    for k, z in enumerate(spaces[t + 1][0]):
                        row ^= (z >> bit & 1) << (offset[t + 1 - a] + k)
                    for k, z in enumerate(spaces[bigger][1]):
                        row ^= (z >> bit & 1) << (extra + k)
                    rows.append(row)
                extra += len(spaces[bigger][1])
            family = _null(rows, extra)
            # relations of the colimit, on generators: boundaries anywhere, and equal cycles at neighbours
            relations = []
            for t in range(a, b + 1):
                for z in spaces[t][1]:
                    relations.append(_write(z, spaces[t][0]) << offset[t - a])
            for t in range(a, b):
                small, large = (t + 1, t) if len(states[t]) > len(states[t + 1]) else (t, t + 1)
                for k, z in enumerate(spaces[small][0]):
                    relations.append(1 << (offset[small - a] + k) ^ (_write(z, spaces[large][0]) << offset[large - a]))
            first = [(x & ((1 << offset[1]) - 1)) for x in family]
            return _rank([*relations, *first]) - _rank(relations)

        r = {(a, b): spans(a, b) for a in range(-1, n + 1) for b in range(max(a, 0), n + 1) if a < n}
        get = lambda a, b, r=r: r.get((a, b), 0) if 0 <= a <= b < n else 0
        for a in range(n):
            for b in range(a, n):
                out += [(d, a + 1, b + 1)] * (get(a, b) - get(a - 1, b) - get(a, b + 1) + get(a - 1, b + 1))
    return sorted(out)


def _null(rows: list[int], width: int) -> list[int]:
    """A basis of the vectors that all equations vanish on."""
    basis: dict[int, int] = {}
    for r in rows:
        while r:
            low = (r & -r).bit_length() - 1
            if low not in basis:
                basis[low] = r
                break
            r ^= basis[low]
    for low in sorted(basis, reverse=True):  # leave each pivot in its own row only
        for other in basis:
            if other != low and basis[other] >> low & 1:
                basis[other] ^= basis[low]
    out = []
    for free in range(width):
        if free not in basis:
            out.append((1 << free) | sum(1 << p for p, r in basis.items() if r >> free & 1))
    return out


def _write(z: int, basis: list[int]) -> int:
    """Coordinates of a vector in a basis, as bits."""
    rows: dict[int, tuple[int, int]] = {}
    for k, b in enumerate(basis):
        m = 1 << k
        while b:
            h = b.bit_length()
            if h not in rows:
                rows[h] = (b, m)
                break
            b, m = b ^ rows[h][0], m ^ rows[h][1]
    out = 0
    while z:
        b, m = rows[z.bit_length()]
        z, out = z ^ b, out ^ m
    return out


# Smaller complexes with the same homotopy type

def strong_core(maximal: list[tuple[int, ...]]) -> tuple[list[tuple[int, ...]], dict[int, int]]:
    """(maximal simplices, where each vertex went): vertices whose every maximal simplex holds another vertex go into it, until none is left."""
    simplices = {frozenset(s) for s in maximal}
    simplices = {s for s in simplices if not any(s < t for t in simplices)}
    went: dict[int, int] = {v: v for s in simplices for v in s}
    while True:
        vertices = sorted({v for s in simplices for v in s})
        hit = None
        for v in vertices:
            around = frozenset.intersection(*[s for s in simplices if v in s]) - {v}
            if around:
                hit = v, min(around)
                break
        if hit is None:
            return sorted(tuple(sorted(s)) for s in simplices), went
        v, w = hit
        went = {x: (w if y == v else y) for x, y in went.items()}
        simplices = {s - {v} for s in simplices}
        simplices = {s for s in simplices if s and not any(s < t for t in simplices)}


# Forests that change

class LinkCut:
    """A forest under links and cuts, with the heaviest edge on a path: edges are nodes of splayed paths between their ends."""

    def __init__(self):
        self.up: dict = {}
        self.kids: dict = {}
        self.weight: dict = {}
        self.best: dict = {}
        self.turned: dict = {}

    def _new(self, x, weight=(-INF,)) -> None:
        if x not in self.up:
            self.up[x], self.kids[x], self.weight[x], self.best[x], self.turned[x] = None, [None, None], weight, x, False

    def _root(self, x) -> bool:
        p = self.up[x]
        return p is None or x not in self.kids[p]

    def _push(self, x) -> None:
        if self.turned[x]:
            self.kids[x].reverse()
            for k in self.kids[x]:
                if k is not None:
                    self.turned[k] = not self.turned[k]
            self.turned[x] = False

    def _pull(self, x) -> None:
        self.best[x] = max([x, *(self.best[k] for k in self.kids[x] if k is not None)], key=lambda y: self.weight[y])

    def _rotate(self, x) -> None:
        p = self.up[x]
        g, side = self.up[p], self.kids[p].index(x)
        if not self._root(p):
            self.kids[g][self.kids[g].index(p)] = x
        inner = self.kids[x][1 - side]
        self.kids[p][side] = inner
        if inner is not None:
            self.up[inner] = p
        self.kids[x][1 - side], self.up[p], self.up[x] = p, x, g
        self._pull(p)
        self._pull(x)

    def _splay(self, x) -> None:
        path = [x]
        while not self._root(path[-1]):
            path.append(self.up[path[-1]])
        for y in reversed(path):
            self._push(y)
        while not self._root(x):
            p = self.up[x]
            if not self._root(p):
                g = self.up[p]
                self._rotate(p if (self.kids[g].index(p) == self.kids[p].index(x)) else x)
            self._rotate(x)

    def _access(self, x) -> None:
        last, y = None, x
        while y is not None:
            self._splay(y)
            self.kids[y][1] = last
            self._pull(y)
            last, y = y, self.up[y]
        self._splay(x)

    def _evert(self, x) -> None:
        self._access(x)
        self.turned[x] = not self.turned[x]
        self._push(x)

    def connected(self, u, v) -> bool:
        self._new(u)
        self._new(v)
        if u == v:
            return True
        self._access(u)
        self._access(v)
        return self.up[u] is not None

    def link(self, u, v, weight) -> None:
        e = ("edge", min(u, v), max(u, v))
        self._new(u)
        self._new(v)
        self._new(e, weight)
        for x in (u, v):
            self._evert(x)
            self.up[x] = e
            if x == u:
                self._evert(e)

    def heaviest(self, u, v):
        """(weight, ends) of the heaviest edge between two nodes of one tree."""
        self._evert(u)
        self._access(v)
        e = self.best[v]
        return self.weight[e], e[1:]

    def cut(self, u, v) -> None:
        e = ("edge", min(u, v), max(u, v))
        for x in (u, v):
            self._evert(e)
            self._access(x)
            self.up[e] = None
            self.kids[x][0] = None
            self._pull(x)
        for d in (self.up, self.kids, self.weight, self.best, self.turned):
            del d[e]


class DynamicForest:
    """A minimum spanning forest while edges come and go; ties by ends."""

    def __init__(self):
        self.tree, self.edges, self.used = LinkCut(), {}, set()

    def connected(self, u, v) -> bool:
        return self.tree.connected(u, v)

    def insert(self, u, v, w: float) -> None:
        e = (min(u, v), max(u, v))
        self.edges[e] = (w, *e)
        self._offer(e)

    def _offer(self, e) -> None:
        if self.tree.connected(*e):
            most, ends = self.tree.heaviest(*e)
            if most <= self.edges[e]:
                return
            self.tree.cut(*ends)
            self.used.discard(ends)
        self.tree.link(*e, self.edges[e])
        self.used.add(e)

    def delete(self, u, v) -> None:
        """The lightest edge across the gap takes its place; it is looked for among all others."""
        e = (min(u, v), max(u, v))
        del self.edges[e]
        if e in self.used:
            self.tree.cut(*e)
            self.used.discard(e)
            for f in sorted(self.edges, key=self.edges.get):
                if f not in self.used and not self.tree.connected(*f):
                    self._offer(f)
                    break

    @property
    def weight(self) -> float:
        return sum(self.edges[e][0] for e in self.used)
