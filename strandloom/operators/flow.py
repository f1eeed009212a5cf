"""Flow networks on components: feasible flows, bounds on each edge's flow, strong components.

A component is small enough for one task once long unique edges are cut, so the
kernels are local and ``edge_bounds`` runs one for each component in Arrow.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame


class Network:
    """Edges with a least and a most flow; sources and sinks are edges from and to the outside."""

    def __init__(self) -> None:
        self.edges: list[tuple[int, int, int, int]] = []  # from, to, least, most
        self.flow: list[int] = []

    def add(self, a: int, b: int, least: int, most: int) -> int:
        self.edges.append((a, b, least, most))
        self.flow.append(0)
        return len(self.edges) - 1

    def _residual(self, least: bool) -> dict[int, list[tuple[int, int, int]]]:
        """node -> (node, edge, direction) along which flow can still move."""
        out = defaultdict(list)
        for k, (a, b, lo, hi) in enumerate(self.edges):
            if self.flow[k] < hi:
                out[a].append((b, k, 1))
            if self.flow[k] > (lo if least else 0):
                out[b].append((a, k, -1))
        return out

    def _room(self, k: int, way: int, least: bool) -> int:
        _, _, lo, hi = self.edges[k]
        return hi - self.flow[k] if way > 0 else self.flow[k] - (lo if least else 0)

    def _path(self, a: int, b: int, least: bool, skip: int = -1) -> list[tuple[int, int]] | None:
        if a == b:
            return []
        res, came = self._residual(least), {a: None}
        queue = deque([a])
        while queue:
            v = queue.popleft()
            for w, k, way in res[v]:
                if k != skip and w not in came:
                    came[w] = (v, k, way)
                    if w == b:
                        path = []
                        while came[w] is not None:
                            v, k, way = came[w]
                            path.append((k, way))
                            w = v
                        return path[::-1]
                    queue.append(w)
        return None

    def feasible(self) -> bool:
        """Find a circulation within all bounds; lower bounds are met one by one through residual paths."""
        for k, (a, b, lo, hi) in enumerate(self.edges):
            if lo > hi:
                return False
            while self.flow[k] < lo:
                path = self._path(b, a, True, k)
                if path is None:
                    return False
                step = min([lo - self.flow[k], *(self._room(e, way, True) for e, way in path)])
                if step <= 0:
                    return False
                self.flow[k] += step
                for e, way in path:
                    self.flow[e] += way * step
        return True

    def bounds(self, k: int) -> tuple[int, int]:
        """Least and most flow of the edge over all feasible circulations (after ``feasible``)."""
        a, b, lo, hi = self.edges[k]
        keep = list(self.flow)
        out = []
        for way in (-1, 1):
            self.flow = list(keep)
            while (self.flow[k] > lo) if way < 0 else (self.flow[k] < hi):
                path = self._path(a, b, True, k) if way < 0 else self._path(b, a, True, k)
                if path is None:
                    break
                room = self.flow[k] - lo if way < 0 else hi - self.flow[k]
                step = min([room, *(self._room(e, w, True) for e, w in path)])
                self.flow[k] += way * step
                for e, w in path:
                    self.flow[e] += w * step
            out.append(self.flow[k])
        self.flow = keep
        return out[0], out[1]


def strong_components(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Node -> number of its strong component; numbers are in topological order."""
    out, inn = defaultdict(list), defaultdict(list)
    nodes = sorted({v for e in edges for v in e})
    for a, b in edges:
        out[a].append(b)
        inn[b].append(a)
    done, order = set(), []
    for s in nodes:
        stack = [(s, iter(out[s]))] if s not in done else []
        done.add(s)
        while stack:
            v, it = stack[-1]
            w = next((x for x in it if x not in done), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                done.add(w)
                stack.append((w, iter(out[w])))
    comp: dict[int, int] = {}
    for n, s in enumerate(x for x in reversed(order)):
        if s not in comp:
            stack = [s]
            comp[s] = n
            while stack:
                for w in inn[stack.pop()]:
                    if w not in comp:
                        comp[w] = n
                        stack.append(w)
    rank = {c: i for i, c in enumerate(sorted(set(comp.values())))}
    return {v: rank[c] for v, c in comp.items()}


def heaviest_path(edges: list[tuple[int, int, int, float]]) -> list[int]:
    """Edge ids of the heaviest path of an acyclic component: (eid, from, to, weight)."""
    comp = strong_components([(a, b) for _, a, b, _ in edges])
    best: dict[int, tuple[float, list[int]]] = defaultdict(lambda: (0.0, []))
    for eid, a, b, w in sorted(edges, key=lambda e: (comp[e[1]], e[0])):
        total = best[a][0] + w
        if total > best[b][0]:
            best[b] = (total, [*best[a][1], eid])
    return max(best.values(), key=lambda x: x[0])[1] if best else []


OUTSIDE = -1
_BOUNDS = "comp long, eid long, mult_lo long, mult_hi long"


def edge_bounds(edges: DataFrame, most: int = 1000) -> DataFrame:
    """Copy number bounds of each component's edges: (comp, eid, mult_lo, mult_hi); null where no flow exists.

    ``edges``: comp, eid, src, dst, unique. Unique edges carry exactly one copy. Vertices
    without a way in (out) are fed from (drained to) the outside.
    """

    def solve(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["eid"])
        net = Network()
        ids = [net.add(r["src"], r["dst"], 1, 1 if r["unique"] else most) for r in rows]
        srcs, dsts = {r["src"] for r in rows}, {r["dst"] for r in rows}
        for v in sorted(srcs - dsts):
            net.add(OUTSIDE, v, 0, most * len(rows))
        for v in sorted(dsts - srcs):
            net.add(v, OUTSIDE, 0, most * len(rows))
        ok = net.feasible()
        found = [net.bounds(k) if ok else (None, None) for k in ids]
        return pa.table({"comp": pa.array([r["comp"] for r in rows], pa.int64()), "eid": pa.array([r["eid"] for r in rows], pa.int64()), "mult_lo": pa.array([x for x, _ in found], pa.int64()), "mult_hi": pa.array([x for _, x in found], pa.int64())})

    return edges.select("comp", "eid", "src", "dst", "unique").groupBy("comp").applyInArrow(solve, _BOUNDS)
