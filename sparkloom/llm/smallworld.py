"""Navigable small-world graph over unit vectors, built and walked in blocks with numpy.

A search starts at entry nodes and opens, round by round, the best node of its beam that is not open yet, until all
of the beam are: no search compares its query with the whole set. Only ``tune`` does, for the probes by which the
beam of a graph is chosen, once, when the graph is built.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Links per node at insertion, and most links kept per node.
LINKS, MOST = 10, 32
#: Nodes looked at to choose where a search starts (at least; else the root of their number).
ENTRIES = 64
#: The narrowest beam, the share of the probes that must find their best match, and the number of probes.
BEAM, TARGET, PROBES = 32, 1.0, 512
#: Queries walked at a time.
ROWS = 512


class Graph(NamedTuple):
    """links: n x MOST node numbers (-1: none); entries: where searches start; beam: its tuned width."""

    links: np.ndarray
    entries: np.ndarray
    beam: int


def _top(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries of each row, best first."""
    k = min(k, sim.shape[1])
    c = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < sim.shape[1] else np.tile(np.arange(k), (len(sim), 1))
    return np.take_along_axis(c, np.argsort(-np.take_along_axis(sim, c, 1), axis=1, kind="stable"), 1)


def walk(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best nodes found for each query (-1: none) and their cosines, best first."""
    beam = max(beam, k)
    out, val = np.full((len(q), k), -1), np.full((len(q), k), -2, np.float32)
    if not len(entries):
        return out, val
    for a in range(0, len(q), ROWS):
        qq = q[a : a + ROWS]
        m = len(qq)
        s = qq @ x[entries].T
        c = _top(s, beam)
        node, sim = np.full((m, beam), -1, np.int32), np.full((m, beam), -2, np.float32)
        node[:, : c.shape[1]], sim[:, : c.shape[1]] = entries[c], np.take_along_axis(s, c, 1)
        closed, live = node < 0, np.arange(m)
        seen = np.zeros((m, len(x)), bool)
        seen[:, entries] = True
        while len(live):
            best = np.where(closed[live], np.float32(-3), sim[live])
            at = best.argmax(1)
            todo = best[np.arange(len(live)), at] > -3
            live, at = live[todo], at[todo]
            if not len(live):
                break
            closed[live, at] = True
            near = links[node[live, at]].astype(np.int32)  # rows x MOST
            r, c = np.nonzero((near >= 0) & ~seen[live[:, None], near])
            at = near[r, c]
            seen[live[r], at] = True
            new = np.full(near.shape, -2, np.float32)
            new[r, c] = np.einsum("id,id->i", qq[live[r]], x[at])
            all_n, all_s = np.concatenate([node[live], near], 1), np.concatenate([sim[live], new], 1)
            all_c = np.concatenate([closed[live], new <= -2], 1)
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            node[live], sim[live], closed[live] = (np.take_along_axis(z, keep, 1) for z in (all_n, all_s, all_c))
        node[sim <= -2] = -1
        o = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        w = o.shape[1]
        out[a : a + m, :w], val[a : a + m, :w] = np.take_along_axis(node, o, 1), np.take_along_axis(sim, o, 1)
    return out, val


def search(x: np.ndarray, graph: Graph, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``walk`` with the tuned beam of the graph."""
    return walk(x, graph.links, graph.entries, q, graph.beam, k)


def _spaced(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(n, max(ENTRIES, round(n**0.5)))).astype(np.int64)) if n else np.zeros(0, np.int64)


def build(x: np.ndarray) -> Graph:
    """The tuned graph. Nodes come in blocks: each links to its best matches among the nodes before it (found by a
    walk of the graph so far) and within its block; links run both ways, the closest are kept. Nodes that no walk can
    reach become entries themselves."""
    n = len(x)
    links, sims = np.full((n, MOST), -1, np.int64), np.full((n, MOST), -2, np.float32)
    done = 0
    while done < n:
        size = min(n - done, 2048)
        q = x[done : done + size]
        inner = q @ q.T
        np.fill_diagonal(inner, -2)
        c = _top(inner, LINKS)
        far, near = c + done, np.take_along_axis(inner, c, 1)
        if done:
            f, s = walk(x, links, _spaced(done), q, 24, LINKS)
            far, near = np.concatenate([far, f], 1), np.concatenate([near, s], 1)
            o = np.argsort(-near, axis=1, kind="stable")[:, : LINKS + LINKS // 2]
            far, near = np.take_along_axis(far, o, 1), np.take_along_axis(near, o, 1)
        src = np.repeat(np.arange(done, done + size), far.shape[1])
        dst, val = far.ravel(), near.ravel()
        ok = (dst >= 0) & (val > -2)
        src, dst, val = src[ok], dst[ok], val[ok]
        a, b, v = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([val, val])
        touched = np.unique(a)
        old = links[touched]
        r, k = np.nonzero(old >= 0)
        a, b, v = np.concatenate([touched[r], a]), np.concatenate([old[r, k], b]), np.concatenate([sims[touched][r, k], v])
        _, first = np.unique(a * np.int64(n) + b, return_index=True)
        a, b, v = a[first], b[first], v[first]
        o = np.lexsort((-v, a))
        a, b, v = a[o], b[o], v[o]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
        place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
        keep = place < MOST
        links[touched], sims[touched] = -1, -2
        links[a[keep], place[keep]], sims[a[keep], place[keep]] = b[keep], v[keep]
        done += size
    entries = _reaching(links, _spaced(n))
    return Graph(links, entries, tune(x, links, entries))


def _reaching(links: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries from which every node can be reached."""
    seen = np.zeros(len(links), bool)
    front = entries
    while True:
        while len(front):
            seen[front] = True
            front = np.unique(links[front])
            front = front[front >= 0]
            front = front[~seen[front]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return entries
        entries, front = np.append(entries, lost[0]), lost[:1]


def tune(x: np.ndarray, links: np.ndarray, entries: np.ndarray) -> int:
    """The narrowest beam, doubling from BEAM, by which TARGET of the probes find what exhaustive search finds. Probes are
    nodes moved to a cosine of about 0.9, as an edited copy is."""
    n, beam = len(x), BEAM
    if not n:
        return beam
    moved = x[np.unique(np.linspace(0, n - 1, min(n, PROBES)).astype(int))]
    moved = moved + np.random.default_rng(n).standard_normal(moved.shape).astype(np.float32) * (0.48 / np.sqrt(x.shape[1]))
    moved = (moved / np.linalg.norm(moved, axis=1)[:, None]).astype(np.float32)
    best = (moved @ x.T).max(1)
    while beam < n:
        _, s = walk(x, links, entries, moved, beam, 1)
        if (s[:, 0] >= best - 1e-5).mean() >= TARGET:
            break
        beam *= 2
    return beam
