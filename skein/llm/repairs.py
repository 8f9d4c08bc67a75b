"""Least edits of a short sequence of lexemes for all names of a grammar at once, without a bound on them.

Over each span of the sequence, shortest first, every name, terminal and beginning of a rule has the least number of
edits with which it yields the span. Lexemes that are left out belong to the terminal beside them. A value is the
number of edits times ``wide`` plus how far before the end the first edit lies, so that of equally cheap repairs the
one counts whose first edit comes last.
"""

from __future__ import annotations

import numpy as np

FAR = 10**6


class Repairs:
    """The rules of a grammar in pairs: beginnings of rules that are equal are one symbol."""

    def __init__(self, rules: dict[str, list[int]], body: dict[int, list[str]], least: dict[str, int], weight: dict[str, int], not_at: dict[str, frozenset]) -> None:
        names = sorted(rules)
        self.terminals = sorted(weight)
        symbols: dict[object, int] = {w: k for k, w in enumerate([*self.terminals, *names])}
        raw = {n: symbols.setdefault((n, "raw"), len(symbols)) for n in not_at}  # what they are before any place is barred
        pairs, ones = set(), set()
        for name, own in rules.items():
            into = raw.get(name, symbols[name])
            for s in own:
                words = body[s]
                held = symbols[words[0]] if words else None
                for k in range(1, len(words)):
                    target = into if k == len(words) - 1 else symbols.setdefault(tuple(words[: k + 1]), len(symbols))
                    pairs.add((target, held, symbols[words[k]]))
                    held = target
                if len(words) == 1:
                    ones.add((into, held))
        size = self.size = len(symbols)
        cost = [FAR] * size
        for w, k in symbols.items():
            if isinstance(w, str):
                cost[k] = weight[w] if k < len(self.terminals) else least[w]
            elif w[-1] == "raw":
                cost[k] = least[w[0]]
            else:
                cost[k] = sum(least[x] if x in least else weight[x] for x in w)
        self.least = np.array(cost)
        self.empty = np.array([symbols[n] for n in names if any(not body[s] for s in rules[n])])
        self.barred = [(symbols[n], raw[n], bar) for n, bar in not_at.items()]
        self.column = {n: symbols[n] for n in names}
        edges = [(z, y, 0, 0) for z, y in ones] + [(z, y, cost[x], 1) for z, x, y in pairs] + [(z, x, cost[y], 2) for z, x, y in pairs]
        edges = sorted({(z, s, u, side if u else 0) for z, s, u, side in edges if z != s and u < FAR})
        # what costs nothing goes from low levels to high ones, so that few rounds are needed
        level = [0] * size
        for _ in range(40):
            for z, s, u, _side in edges:
                if not u:
                    level[z] = max(level[z], min(40, level[s] + 1))
            for n, r, _bar in self.barred:
                level[n] = max(level[n], min(40, level[r] + 1))
        self.levels = []
        for rank in sorted(set(level)):
            own = [e for e in edges if level[e[0]] == rank]
            zs = [e[0] for e in own]
            starts = [k for k, z in enumerate(zs) if not k or z != zs[k - 1]]
            bars = [b for b in self.barred if level[b[0]] == rank]
            if own or bars:
                self.levels.append((np.array([e[1] for e in own], int), np.array([e[2] for e in own], int), np.array([e[3] for e in own], int), np.array(starts, int), np.array([zs[k] for k in starts], int), bars))
        ordered = sorted(pairs)
        self.lefts, self.rights = np.array([p[1] for p in ordered]), np.array([p[2] for p in ordered])
        self.starts = np.array([k for k, p in enumerate(ordered) if not k or p[0] != ordered[k - 1][0]])
        self.targets = np.array([ordered[k][0] for k in self.starts])

    def least_edits(self, kept: list[np.ndarray], weights: list[np.ndarray], looks: list[list[frozenset]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of some sequences (edits, place of the first) with which each symbol yields all of it.

        ``kept``: edits with which each lexeme stands for each terminal. ``weights``: edits that leave it out.
        Sequences do not meet; they go together since a span by itself is little work for a call.
        """
        order = sorted(range(len(weights)), key=lambda q: -len(weights[q]))
        lengths = np.array([len(weights[q]) for q in order])
        count, longest = len(self.terminals), int(lengths[0])
        wide = 1 << (longest + 2).bit_length()
        far = max(int(w.sum()) for w in weights) + int(self.least.max()) + 1  # all lexemes left out and new ones put in cost less
        kind = np.int32 if 3 * far * wide < 2**31 else np.int64
        mask = kind(wide - 1)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        own = (np.minimum(np.concatenate([kept[q] for q in order]), far) * wide).astype(kind)
        heavy = (np.concatenate([weights[q] for q in order]) * wide).astype(kind)
        sums = np.concatenate([[0], np.cumsum(heavy, dtype=np.int64)])
        bar = {z: np.array([not b.isdisjoint(x) for q in order for x in looks[q]], bool) for z, _, b in self.barred}
        insert = (self.least * wide).astype(kind)
        steps = [(src, (u * wide).astype(kind)[:, None], side, starts, zs, bars) for src, u, side, starts, zs, bars in self.levels]
        out: list = [None] * len(order)
        before, offsets, lefts, rights = None, [], [None], [None]
        for d in range(longest + 1):
            active = int(np.searchsorted(-lengths, -d, side="right"))
            rows = lengths[:active] - d + 1
            offsets.append(np.concatenate([[0], np.cumsum(rows)])[:-1])
            seq = np.repeat(np.arange(active), rows)
            i = np.arange(len(seq)) - offsets[d][seq]
            first = (lengths[seq] - i).astype(kind)  # how far its begin lies before the end
            if d == 0:
                here = insert[:, None] + np.where(insert[:, None] > 0, first, kind(0))
            else:
                here = np.full((self.size, len(seq)), far * wide, kind)
                end, at = first - kind(d), begin[seq] + i
                behind = offsets[d - 1][seq] + i
                # terminals: the lexeme itself, or one more left out behind or before
                ta, tb = before[:count].take(behind, 1), before[:count].take(behind + 1, 1)
                t = np.minimum((ta & ~mask) + heavy[at + d - 1] + np.maximum(ta & mask, end + kind(1)), (tb & ~mask) + heavy[at] + first)
                if d == 1:
                    mine = own[at].T
                    t = np.minimum(t, mine + np.where(mine > 0, first, kind(0)))
                here[:count] = t
                here[self.empty] = (sums[at + d] - sums[at]).astype(kind) + first
                if d > 1:
                    best = None
                    for k in range(1, d):
                        x, y = lefts[k][offsets[k][seq] + i], rights[d - k][offsets[d - k][seq] + i + k]
                        v = x + y
                        x &= mask
                        y &= mask
                        v -= np.minimum(x, y, out=x)
                        best = v if best is None else np.minimum(best, v, out=best)
                    here[self.targets] = np.minimum(here[self.targets], np.minimum.reduceat(np.ascontiguousarray(best.T), self.starts))
                penalties = {}
                for z, _, _ in self.barred:  # without the lexeme that bars it
                    penalties[z] = bar[z][at]
                    here[z] = np.minimum(here[z], np.where(penalties[z], (before[z, behind + 1] & ~mask) + heavy[at] + first, kind(far * wide)))
                self._close(here, steps, first, end, penalties, mask)
                lefts.append(np.ascontiguousarray(here[self.lefts].T))
                rights.append(np.ascontiguousarray(here[self.rights].T))
            for q in np.flatnonzero(lengths[:active] == d):
                value = here[:, offsets[d][q]]
                out[order[q]] = value // wide, d - (value & mask)
            before = here
        return out

    @staticmethod
    def _close(here: np.ndarray, steps: list, first: np.ndarray, end: np.ndarray, penalties: dict[int, np.ndarray], mask) -> None:
        """Rules of which one symbol yields the whole span and the others are put in, again until nothing gets cheaper."""
        none = np.zeros_like(first)
        floors = [np.stack([none, first, end])[side] for _, _, side, _, _, _ in steps]
        rows, part = np.arange(here.shape[1]), here
        while len(rows):
            changed = np.zeros(len(rows), bool)
            for (src, u, _, starts, zs, bars), floor in zip(steps, floors):
                if len(src):
                    v = part[src]
                    e = floor - (v & mask)
                    v += u
                    v += np.maximum(e, 0, out=e)
                    new = np.minimum.reduceat(v, starts)
                    old = part[zs]
                    better = (new < old).any(0)
                    if better.any():
                        changed |= better
                        part[zs] = np.minimum(new, old)
                for z, r, _ in bars:
                    v = np.minimum(part[z], np.where(penalties[z], (part[r] & ~mask) + (mask + 1) + first, part[r]))
                    changed |= v < part[z]
                    part[z] = v
            if part is not here:
                here[:, rows] = part
            if changed.all():
                continue
            rows = rows[changed]
            part, first, floors = here[:, rows], first[changed], [f[:, changed] for f in floors]
            penalties = {z: b[changed] for z, b in penalties.items()}
