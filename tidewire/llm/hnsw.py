"""Hierarchical navigable small-world graphs over unit vectors, in numpy.

Searches run for many queries at once: every step expands the best unexpanded
candidates of each query and merges their neighbours into its beam.
"""

from __future__ import annotations

import numpy as np

#: Flags of visited nodes that a search may hold at once, in bytes.
VISITED = 32 << 20
#: Pairs of rows that are gathered at once.
GATHER = 2048


class Graph:
    """An index of the rows of x (unit vectors, float32)."""

    def __init__(self, x: np.ndarray, m: int = 12, ef: int = 40, seed: int = 5) -> None:
        self.x, self.m, self.ef, n = x, m, ef, len(x)
        self.flags = np.zeros(0, bool)
        rng = np.random.default_rng(seed)
        self.level = np.minimum(8, (-np.log(1 - rng.random(n)) / np.log(m)).astype(np.int64))
        self.links = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(int(self.level.max(initial=0)) + 1)]
        self.entry, self.top, at, step = 0, int(self.level[0]) if n else 0, 1, 1
        while at < n:
            self._insert(np.arange(at, min(n, at + step)))
            at += step
            step = min(256, at)

    def state(self) -> dict[str, np.ndarray]:
        """What restore needs besides the vectors."""
        return {"level": self.level, "at": np.array([self.entry, self.top, self.m, self.ef]), **{f"links{k}": x for k, x in enumerate(self.links)}}

    def restore(self, x: np.ndarray, state: dict[str, np.ndarray]) -> None:
        self.x, self.level, self.flags = x, state["level"], np.zeros(0, bool)
        self.entry, self.top, self.m, self.ef = map(int, state["at"])
        self.links = [state[f"links{k}"] for k in range(len(state) - 2)]

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ef best found for each query, best first, -1 where fewer."""
        out = [self._descend(q[k : k + step], ef) for step in [max(1, min(1024, VISITED // max(1, len(self.x))))] for k in range(0, len(q), step)]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def _descend(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.full((len(q), 1), self.entry, np.int64)
        for level in range(self.top, 0, -1):
            near = self._layer(q, near, 1, level)[0]
        return self._layer(q, near, ef, 0)

    def _dots(self, q: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The products of the rows of q with those of x, some at a time, so that what is gathered stays in the cache."""
        out = np.empty(len(row), np.float32)
        for k in range(0, len(row), GATHER):
            out[k : k + GATHER] = np.einsum("kd,kd->k", q.take(row[k : k + GATHER], axis=0), self.x.take(at[k : k + GATHER], axis=0))
        return out

    def _layer(self, q: np.ndarray, start: np.ndarray, ef: int, level: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        links, n = self.links[level], len(self.x)
        ids = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -4.0, np.float32)
        fresh = np.zeros((len(q), ef), bool)
        k = min(ef, start.shape[1])
        ids[:, :k] = start[:, :k]
        sims[:, :k] = np.where(start[:, :k] >= 0, self._dots(q, np.repeat(np.arange(len(q)), k), start[:, :k].ravel()).reshape(-1, k), -4.0)
        fresh[:, :k] = start[:, :k] >= 0
        # one buffer of flags for all searches, of which each clears what it has set
        if len(self.flags) < len(q) * n:
            self.flags = np.zeros(len(q) * n, bool)
        base = np.arange(len(q)) * n
        touched = [(base[:, None] + ids)[ids >= 0]]
        self.flags[touched[0]] = True
        wide = min(max(wide, ef // 8), ef)  # a wide beam moves in as many steps as a narrow one, about
        while True:
            act = np.flatnonzero(fresh.any(1))
            if not len(act):
                break
            best = np.where(fresh[act], sims[act], -9.0)
            pick = np.argpartition(-best, wide - 1, axis=1)[:, :wide] if wide < ef else np.broadcast_to(np.arange(ef), (len(act), ef))
            row, col = np.nonzero(np.take_along_axis(fresh[act], pick, 1))
            near = np.full((len(act), wide, links.shape[1]), -1, np.int32)
            near[row, col] = links[ids[act[row], pick[row, col]]]
            near = near.reshape(len(act), -1)
            fresh[act[:, None], pick] = False
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            # from here on only those that were not met before, then only those that enter the beam
            row, col = np.nonzero(new)
            cand = near[row, col].astype(np.int64)
            at = base[act[row]] + cand
            unseen = ~self.flags[at]
            row, cand, at = row[unseen], cand[unseen], at[unseen]
            self.flags[at] = True
            touched.append(at)
            s = self._dots(q, act[row], cand)
            enter = s > sims[act].min(1)[row]
            row, cand, s = row[enter], cand[enter], s[enter]
            if not len(row):
                continue
            some, row, size = np.unique(row, return_inverse=True, return_counts=True)
            act, place = act[some], np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            more = np.full((len(act), int(size.max())), -1, np.int64)
            ms = np.full(more.shape, -4.0, np.float32)
            more[row, place], ms[row, place] = cand, s
            every, es = np.concatenate([ids[act], more], 1), np.concatenate([sims[act], ms], 1)
            ef_fresh = np.concatenate([fresh[act], more >= 0], 1)
            keep = np.argpartition(-es, ef - 1, axis=1)[:, :ef]
            ids[act], sims[act] = np.take_along_axis(every, keep, 1), np.take_along_axis(es, keep, 1)
            fresh[act] = np.take_along_axis(ef_fresh, keep, 1) & (ids[act] >= 0)
        for at in touched:
            self.flags[at] = False
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _select(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates (best first): those nearer to the node than
        to any chosen before, then the best of the rest."""
        c = self.x.take(cand, axis=0)
        among = c @ c.transpose(0, 2, 1)
        chosen = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            clash = (chosen & (among[:, j, :] > sims[:, j, None])).any(1)
            chosen[:, j] = ~clash & (cand[:, j] >= 0) & (chosen.sum(1) < most)
        rank = np.argsort(np.where(cand < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(cand, rank, 1)
        return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        near = np.full((len(new), 1), self.entry, np.int64)
        among = q @ q.T
        np.fill_diagonal(among, -4.0)
        for level in range(int(max(self.top, self.level[new].max())), -1, -1):
            mine = self.level[new] >= level
            if level <= self.top:
                far = np.flatnonzero(~mine)
                if len(far):
                    near[far] = self._layer(q[far], near[far, :1], 1, level)[0]
            at = np.flatnonzero(mine)
            if not len(at):
                continue
            if level <= self.top:
                ids, sims = self._layer(q[at], near[at, :1], self.ef, level)
                near[at, :1] = np.where(ids[:, :1] >= 0, ids[:, :1], near[at, :1])
            else:
                ids, sims = np.zeros((len(at), 0), np.int64), np.zeros((len(at), 0), np.float32)
            # nodes of the same batch are candidates of one another
            own = among[np.ix_(at, at)]
            best = np.argsort(-own, axis=1)[:, : self.m]
            ids = np.concatenate([ids, np.where(np.take_along_axis(own, best, 1) > -2, new[at][best], -1)], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, best, 1)], 1)
            order = np.argsort(-sims, axis=1)[:, : self.ef]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            if not ids.shape[1]:
                continue
            picked = self._select(ids, sims, self.m)
            self.links[level][new[at], : self.m] = picked
            self._back(new[at], picked, level)
        high = int(new[np.argmax(self.level[new])])
        if self.level[high] > self.top:
            self.entry, self.top = high, int(self.level[high])

    def _back(self, nodes: np.ndarray, picked: np.ndarray, level: int) -> None:
        """Link the picked nodes back, pruning the lists that get too long."""
        src, dst = np.repeat(nodes, picked.shape[1]), picked.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        ends, first, size = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, size)
        extra = np.full((len(ends), int(size.max())), -1, np.int64)
        extra[np.repeat(np.arange(len(ends)), size), place] = src
        links = self.links[level]
        for k in range(0, len(ends), 256):
            e = ends[k : k + 256]
            cand = np.concatenate([links[e].astype(np.int64), extra[k : k + 256]], 1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = np.where(cand >= 0, self._dots(self.x, np.repeat(e, cand.shape[1]), cand.ravel()).reshape(cand.shape), -4.0)
            best = np.argsort(-sims, axis=1)[:, : links.shape[1] + 2 * self.m]
            links[e] = self._select(np.take_along_axis(cand, best, 1), np.take_along_axis(sims, best, 1), links.shape[1])
