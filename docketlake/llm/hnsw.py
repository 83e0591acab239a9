"""Hierarchical navigable small-world graphs as flat neighbour arrays: bulk build and search of many queries in step."""

from __future__ import annotations

import numpy as np

#: Links of a node on the layers above, and on the ground layer.
LINKS, GROUND = 12, 24
#: Nearest nodes that compete for a node's links.
NEAREST = 32


def levels(keys: np.ndarray, ratio: int = LINKS) -> np.ndarray:
    """Top layer of each node: exponentially distributed, drawn from a hash of its key, so that a rebuild is equal."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    return np.floor(-np.log(1 - u + 1e-18) / np.log(ratio)).astype(int)


def _nearest(x: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other nodes of each node, best first, and their similarities."""
    n = len(x)
    k = min(k, n - 1)
    at, sims = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for i in range(0, n, block):
        s = x[i : i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        got = np.argpartition(s, n - k, axis=1)[:, n - k :] if k < n else np.tile(np.arange(n), (len(s), 1))
        v = np.take_along_axis(s, got, 1)
        order = np.argsort(-v, axis=1)
        at[i : i + block], sims[i : i + block] = np.take_along_axis(got, order, 1), np.take_along_axis(v, order, 1)
    return at, sims


def _links(x: np.ndarray, most: int, block: int = 1024) -> np.ndarray:
    """Flat neighbour array (len(x), most), -1 where there is none.

    Of its nearest nodes a node links those that are nearer to it than to any node it linked before (so that links lead
    in all directions), then the nearest ones left over; half its places are kept for links back from other nodes.
    """
    n = len(x)
    if n < 2:
        return np.full((n, most), -1, np.int32)
    near, sims = _nearest(x, NEAREST)
    k = near.shape[1]
    out = max(2, most // 2)
    chosen = np.zeros((n, k), bool)
    for i in range(0, n, block):
        c = x[near[i : i + block]]
        gram = c @ c.transpose(0, 2, 1)
        pick, s = chosen[i : i + block], sims[i : i + block]
        pick[:, 0] = True
        for j in range(1, k):
            shadow = ((gram[:, j, :j] > s[:, j : j + 1]) & pick[:, :j]).any(1)
            pick[:, j] = ~shadow & (pick[:, :j].sum(1) < out)
    rank = np.argsort(~chosen, axis=1, kind="stable")[:, :out]
    dst = np.take_along_axis(near, rank, 1)
    val = np.take_along_axis(sims, rank, 1)
    src = np.repeat(np.arange(n, dtype=np.int64), dst.shape[1])
    # Own links first, then links back, the nearest first; each once.
    a = np.concatenate([src, dst.ravel().astype(np.int64)])
    b = np.concatenate([dst.ravel().astype(np.int64), src])
    v = np.concatenate([val.ravel() + 4, val.ravel()])
    order = np.lexsort((-v, b, a))
    a, b, v = a[order], b[order], v[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    a, b, v = a[first], b[first], v[first]
    order = np.lexsort((-v, a))
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - start[a]
    flat = np.full((n, most), -1, np.int32)
    keep = place < most
    flat[a[keep], place[keep]] = b[keep]
    return flat


class Graph:
    """A graph over unit vectors x; keys only fix the layers. Build cost grows as len(x) squared: keep shards bounded."""

    def __init__(self, x: np.ndarray, keys: np.ndarray) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        top = levels(keys)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes and links (in places among the nodes), from the top
        level = 1
        while (nodes := np.flatnonzero(top >= level)).size > 1:
            self.layers.append((nodes, _links(self.x[nodes], LINKS)))
            level += 1
        self.layers.reverse()
        self.ground = _links(self.x, GROUND)

    def search(self, q: np.ndarray, k: int, ef: int, start: np.ndarray | None = None, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of about the k nearest nodes of each query, best first; -1 where there are fewer.

        start: a node per query to begin at on the ground layer, in place of the way down from the top.
        """
        parts = [self._block(q[i : i + block], k, ef, None if start is None else start[i : i + block]) for i in range(0, len(q), block)]
        if not parts:
            return np.zeros((0, k), np.int32), np.zeros((0, k), np.float32)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _block(self, q: np.ndarray, k: int, ef: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if start is not None:
            entry = start[:, None].astype(np.int64)
        elif self.layers:
            nodes, _ = self.layers[0]
            entry = np.argsort(-(q @ self.x[nodes].T), axis=1)[:, :2]
            for i, (nodes, links) in enumerate(self.layers):
                if i:
                    above = self.layers[i - 1][0]
                    entry = np.searchsorted(nodes, above[entry])
                entry, _ = _beam(self.x[nodes], links, q, entry, max(4, ef // 8))
            entry = self.layers[-1][0][np.maximum(entry[:, :4], 0)]
        else:
            entry = np.zeros((len(q), 1), np.int64)
        at, sims = _beam(self.x, self.ground, q, entry, max(ef, k))
        return at[:, :k], sims[:, :k]


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: each step opens the `wide` best unopened nodes of every beam that has any."""
    n_q, n = len(q), len(x)
    beam = np.full((n_q, ef), -1, np.int64)
    sims = np.full((n_q, ef), -np.inf, np.float32)
    opened = np.ones((n_q, ef), bool)
    seen = np.zeros((n_q, n + 1), bool)
    rows = np.arange(n_q)
    entry = entry[:, :ef]
    entry = np.where(np.sort(entry, 1) == np.roll(np.sort(entry, 1), 1, 1), -1, np.sort(entry, 1)) if entry.shape[1] > 1 else entry
    beam[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("qd,qkd->qk", q, x[entry]), -np.inf)
    opened[:, : entry.shape[1]] = entry < 0
    seen[rows[:, None], entry] = True
    seen[:, n] = True
    # Row n of the links, and place n of what was seen, stand for no node.
    wide_links = np.concatenate([np.where(links < 0, n, links), np.full((1, links.shape[1]), n, links.dtype)])
    live = rows
    flat_seen = seen.reshape(-1)
    w = min(wide, ef)
    # The beams of live queries are kept together, so that a step takes whole rows and no scattered places.
    b_n, b_s, b_o, q_l = beam, sims, opened, q
    while len(live):
        s = np.where(b_o, -np.inf, b_s)
        pick = np.argpartition(-s, w - 1, axis=1)[:, :w] if w < ef else np.tile(np.arange(ef), (len(live), 1))
        best = np.take_along_axis(s, pick, 1)
        some = best.max(1) > -np.inf
        if not some.all():
            beam[live[~some]], sims[live[~some]] = b_n[~some], b_s[~some]
            live, pick, best, b_n, b_s, b_o, q_l = (t[some] for t in (live, pick, best, b_n, b_s, b_o, q_l))
            if not len(live):
                break
        nodes = np.where(best > -np.inf, np.take_along_axis(b_n, pick, 1), n)
        np.put_along_axis(b_o, pick, True, 1)
        nxt = wide_links.take(nodes, axis=0).reshape(len(live), -1)
        nxt.sort(axis=1)
        nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = n
        places = live[:, None] * (n + 1) + nxt
        new_at = np.flatnonzero(~flat_seen.take(places))
        flat_seen[places.reshape(-1).take(new_at)] = True
        # Only nodes not seen before are compared, in one flat list over all queries.
        to = nxt.reshape(-1).take(new_at)
        new = np.full(nxt.size, -np.inf, np.float32)
        new[new_at] = np.einsum("id,id->i", q_l.take(new_at // nxt.shape[1], axis=0), x.take(to, axis=0))
        new = new.reshape(nxt.shape)
        all_s = np.concatenate([b_s, new], 1)
        keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        b_s = np.take_along_axis(all_s, keep, 1)
        b_n = np.take_along_axis(np.concatenate([b_n, nxt], 1), keep, 1)
        b_o = np.take_along_axis(np.concatenate([b_o, new == -np.inf], 1), keep, 1)
    beam[sims == -np.inf] = -1
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(beam, order, 1), np.take_along_axis(sims, order, 1)
