"""Directed graphs small enough for one task: successor and predecessor sets by vertex.

Everything is deterministic: ties go by vertex id and random choices come from a
seeded generator.
"""

from __future__ import annotations

import heapq
import math
import random
import time
from collections.abc import Iterable, Iterator
from itertools import combinations as choose

import numpy as np

from acyclica.functions.sequence import SPAN, Sequence


class LocalGraph:
    def __init__(self, edges: Iterable[tuple[int, int]] = ()):
        self.out: dict[int, set[int]] = {}
        self.into: dict[int, set[int]] = {}
        for a, b in edges:
            self.link(a, b)

    def link(self, a: int, b: int) -> None:
        for v in (a, b):
            self.out.setdefault(v, set())
            self.into.setdefault(v, set())
        self.out[a].add(b)
        self.into[b].add(a)

    def unlink(self, a: int, b: int) -> None:
        self.out[a].discard(b)
        self.into[b].discard(a)

    def drop(self, v: int) -> None:
        for w in self.out.pop(v):
            if w != v:
                self.into[w].discard(v)
        for w in self.into.pop(v):
            if w != v:
                self.out[w].discard(v)

    def bypass(self, v: int) -> None:
        """v goes; every predecessor gets v's successors."""
        before, after = self.into[v] - {v}, self.out[v] - {v}
        self.drop(v)
        for p in before:
            for s in after:
                self.link(p, s)

    def copy(self) -> LocalGraph:
        g = LocalGraph()
        g.out = {v: set(s) for v, s in self.out.items()}
        g.into = {v: set(s) for v, s in self.into.items()}
        return g

    def part(self, ids: set[int]) -> LocalGraph:
        g = LocalGraph()
        g.out = {v: self.out[v] & ids for v in ids}
        g.into = {v: self.into[v] & ids for v in ids}
        return g

    def without(self, ids: set[int]) -> LocalGraph:
        return self.part(set(self.out) - ids)

    def size(self) -> tuple[int, int]:
        return len(self.out), sum(map(len, self.out.values()))

    def product(self, v: int) -> int:
        return len(self.into[v]) * len(self.out[v])


def strong_components(out: dict[int, set[int]]) -> Iterator[list[int]]:
    """Strongly connected components, by one depth-first search with low links on an explicit stack."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    path: list[int] = []
    waiting: set[int] = set()
    for start in sorted(out):
        if start in number:
            continue
        number[start] = low[start] = len(number)
        path.append(start)
        waiting.add(start)
        calls = [(start, iter(sorted(out[start])))]
        while calls:
            v, rest = calls[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    path.append(w)
                    waiting.add(w)
                    calls.append((w, iter(sorted(out[w]))))
                    break
                if w in waiting:
                    low[v] = min(low[v], number[w])
            else:
                calls.pop()
                if calls:
                    low[calls[-1][0]] = min(low[calls[-1][0]], low[v])
                if low[v] == number[v]:
                    found = []
                    while not found or found[-1] != v:
                        found.append(path.pop())
                        waiting.discard(found[-1])
                    yield found


def weighted_levels(edges: list[tuple[int, int, int]], root: int) -> dict[int, int]:
    """The weight of the heaviest way from the root to each vertex that no cycle leads to; the root leads to all that no other edge enters."""
    out: dict[int, list[tuple[int, int]]] = {}
    waiting: dict[int, int] = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
        waiting[b] = waiting.get(b, 0) + 1
    level, ready = {root: 0}, [root]
    best: dict[int, int] = {}
    while ready:
        a = ready.pop()
        for b, w in out.get(a, ()):
            best[b] = max(best.get(b, 0), level[a] + w)
            waiting[b] -= 1
            if not waiting[b]:
                level[b] = best[b]
                ready.append(b)
    return level


#: Vertices whose reach is kept in one number at a time.
REACH_BITS = 4_096


def reach_count(g: LocalGraph, weights: dict[int, int] | None = None) -> int:
    """How many pairs (a, b) have a way of at least one edge, or the sum of weights[a] * weights[b] over them: sets of the components' vertices, last component first, a block of vertices at a time."""
    comps = [sorted(c) for c in strong_components(g.out)]
    at = {v: i for i, c in enumerate(comps) for v in c}
    after = [{at[w] for v in c for w in g.out[v]} for c in comps]
    order = [v for c in comps for v in c]
    place = {v: i for i, v in enumerate(order)}
    weights = dict.fromkeys(order, 1) if weights is None else weights
    total = 0
    for first in range(0, len(order), REACH_BITS):
        block = order[first : first + REACH_BITS]
        # a mask for each binary digit of the weights
        digits = max(weights[v] for v in block).bit_length()
        masks = [sum(1 << i for i, v in enumerate(block) if weights[v] >> k & 1) for k in range(digits)]
        sets: list[int] = []
        for i, c in enumerate(comps):
            own = sum(1 << (place[v] - first) for v in c if first <= place[v] < first + REACH_BITS)
            reached = own if i in after[i] else 0
            for j in after[i] - {i}:
                reached |= sets[j]
            if reached:
                total += sum((reached & mask).bit_count() << k for k, mask in enumerate(masks)) * sum(weights[v] for v in c)
            sets.append(reached | own)
    return total


def levels(g: LocalGraph) -> dict[int, int]:
    """Level of each vertex that no cycle leads to: the edges on the longest way to it."""
    degree = {v: len(p) for v, p in g.into.items()}
    level = {v: 0 for v, d in degree.items() if not d}
    ready = sorted(level)
    while ready:
        v = ready.pop()
        for w in g.out[v]:
            degree[w] -= 1
            level[w] = max(level.get(w, 0), level[v] + 1)
            if not degree[w]:
                ready.append(w)
    return {v: k for v, k in level.items() if degree[v] == 0}


def acyclic(g: LocalGraph) -> bool:
    return len(levels(g)) == len(g.out)


def topological(g: LocalGraph) -> list[int]:
    """The vertices that no cycle leads to, predecessors first."""
    return [v for _, v in sorted((k, v) for v, k in levels(g).items())]


def reaches_itself(g: LocalGraph, v: int, blocked: set[int]) -> bool:
    """v is on a cycle whose other vertices aren't blocked."""
    seen, todo = set(), [v]
    while todo:
        for w in g.out[todo.pop()]:
            if w == v:
                return True
            if w not in seen and w not in blocked:
                seen.add(w)
                todo.append(w)
    return False


def reached(g: LocalGraph, v: int, blocked: set[int]) -> set[int]:
    """What v leads to by at least one edge, passing through no blocked vertex."""
    seen, todo = set(), [v]
    while todo:
        for w in g.out[todo.pop()]:
            if w not in seen:
                seen.add(w)
                if w not in blocked:
                    todo.append(w)
    return seen


# Reductions: what they take is in some smallest answer.


def reduce_degrees(g: LocalGraph, taken: set[int]) -> None:
    """Loops are taken; vertices without predecessor or successor go; those with one of either are bypassed."""
    todo = sorted(g.out)
    while todo:
        again: set[int] = set()
        for v in todo:
            if v not in g.out:
                continue
            before, after = g.into[v], g.out[v]
            if v in after:
                taken.add(v)
            elif len(before) > 1 and len(after) > 1:
                continue
            again |= before | after
            if v in taken or not before or not after:
                g.drop(v)
            else:
                g.bypass(v)
        todo = sorted(v for v in again if v in g.out)


def mutual(g: LocalGraph, v: int) -> set[int]:
    return g.out[v] & g.into[v]


def cut_one_way(g: LocalGraph) -> bool:
    """One-way edges between components of the one-way graph lie on no shortest cycle: they go."""
    one_way = {v: g.out[v] - g.into[v] for v in g.out}
    comp = {v: i for i, c in enumerate(strong_components(one_way)) for v in c}
    gone = [(v, w) for v, s in one_way.items() for w in s if comp[v] != comp[w]]
    for v, w in gone:
        g.unlink(v, w)
    return bool(gone)


def take_core(g: LocalGraph, taken: set[int]) -> bool:
    """The neighbours of a vertex that has mutual edges only, in a clique, are taken."""
    hit = False
    for v in sorted(g.out, key=lambda v: (len(g.out[v]), v)):
        if v not in g.out or not g.out[v] or g.out[v] != g.into[v] or v in g.out[v]:
            continue
        around = set(g.out[v])
        if all(around - {w} <= mutual(g, w) for w in around):
            taken |= around
            for w in [v, *around]:
                g.drop(w)
            hit = True
    return hit


def cut_dominated(g: LocalGraph) -> bool:
    """One-way edges that every cycle could pass by: all of one snapshot go."""
    gone = []
    for v in g.out:
        for w in g.out[v] - g.into[v]:
            if (g.into[v] - g.out[v]) <= g.into[w] or (g.out[w] - g.into[w]) <= g.out[v]:
                gone.append((v, w))
    for v, w in gone:
        g.unlink(v, w)
    return bool(gone)


def reduce_all(g: LocalGraph, taken: set[int], dominated: bool = True) -> None:
    """All rules, cheap ones first, until nothing changes."""
    reduce_degrees(g, taken)
    while g.out:
        if cut_one_way(g) | take_core(g, taken) or (dominated and cut_dominated(g)):
            reduce_degrees(g, taken)
        else:
            return


# Solvers


def greedy(g: LocalGraph, fraction: int = 150) -> set[int]:
    """By component: reduce, take the vertices of highest degree product, again until nothing is left."""
    taken: set[int] = set()
    g = g.copy()
    reduce_all(g, taken)
    stack = [g]
    while stack:
        g = stack.pop()
        for comp in strong_components(g.out):
            if len(comp) < 2:
                continue
            part = g.part(set(comp))
            best = sorted(part.out, key=lambda v: (-part.product(v), -v))[: max(1, len(comp) // fraction)]
            for v in best:
                taken.add(v)
                part.drop(v)
            reduce_all(part, taken)
            if part.out:
                stack.append(part)
    return taken


def minimal(g: LocalGraph, solution: Iterable[int]) -> set[int]:
    """The solution without vertices that no cycle needs, tried in the order given."""
    order = list(solution)
    kept = set(order)
    for v in order:
        kept.discard(v)
        if reaches_itself(g, v, kept):
            kept.add(v)
    return kept


def improve(g: LocalGraph, solution: set[int], rounds: int, seed: int, until: float | None = None) -> set[int]:
    """Puts random vertices into the answer and takes out what isn't needed, as long as rounds and time last; never gets worse."""
    rng = np.random.default_rng(seed)
    best = minimal(g, sorted(solution, key=lambda v: (g.product(v), v)))
    rest = len(g.out) - len(best)
    for i in range(rounds):
        if not best or rest <= 0 or (until is not None and time.monotonic() >= until):
            break
        others = sorted(set(g.out) - best)
        n = max(1, min(len(others), len(best)) // (2 + i % 9))
        more = rng.choice(others, min(n, len(others)), replace=False).tolist()
        order = rng.permutation(sorted(best)).tolist()
        new = minimal(g, [*order, *more])
        if len(new) <= len(best):
            best = new
        rest = len(g.out) - len(best)
    return best


def anneal(g: LocalGraph, seed: int, start: set[int] | None = None, heat: float = 0.6, cooling: float = 0.99, moves: int | None = None, fails: int = 50, until: float | None = None) -> set[int]:
    """Simulated annealing on acyclic sequences: an unplaced vertex enters behind its last placed predecessor or before its first placed successor; what it contradicts leaves.

    A move costs the vertex's edges. The best answer so far is what is placed
    now but for what has changed since; it stands when time is up.
    """
    # one number of a plain generator a draw: an attempt costs little more than it, and there are millions
    draw = random.Random(seed).random
    loops = {v for v in g.out if v in g.out[v]}
    sequence = Sequence(topological(g.without(loops | (start or set(g.out)))) if start is not None else [])
    rest = sorted(v for v in g.out if v not in loops and v not in sequence)
    label, most, changed = sequence.label, len(sequence), set()
    near = {v: (list(g.into[v]), list(g.out[v])) for v in sorted(g.out)}
    place = label.get
    moves = 5 * len(g.out) if moves is None else moves
    failed, tried = 0, 0
    while failed < fails and rest:
        better, accepted = False, 0
        for _ in range(4 * moves):  # attempts are bounded too
            tried += 1
            if accepted >= moves or not rest or (until is not None and tried % 256 == 0 and time.monotonic() >= until):
                break
            k = int(draw() * len(rest))
            v = rest[k]
            into, out = near[v]
            first = draw() < 0.5
            if first:
                at = max([place(p, -1) for p in into], default=-1)
                clash = [s for s in out if place(s, SPAN) <= at]
            else:
                at = min([place(s, SPAN) for s in out], default=SPAN)
                clash = [p for p in into if place(p, -1) >= at]
            loss = len(clash) - 1
            if loss <= 0 or draw() < math.exp(-loss / heat):
                if first:
                    behind = None if at < 0 else next(p for p in into if place(p) == at)
                else:
                    behind = sequence.before[None if at == SPAN else next(s for s in out if place(s) == at)]
                sequence.insert(v, behind)
                changed ^= {v}
                rest[k] = rest[-1]
                rest.pop()
                if clash:
                    clash.sort()
                    for x in clash:
                        sequence.remove(x)
                    rest += clash
                    changed.symmetric_difference_update(clash)
                accepted += 1
                if len(label) > most:
                    most, better = len(label), True
                    changed.clear()
        failed = 0 if better else failed + 1
        heat *= cooling
        if until is not None and time.monotonic() >= until:
            break
    return set(g.out) - (set(label) ^ changed)


def anneal_block(edges: Iterable[tuple[int, int]], labels: dict[int, int], own: set[int], seed: int, heat: float, moves: int) -> dict[int, int]:
    """Labels of the placed ones among a block's own vertices after so many attempts; those of other vertices stand.

    Along an edge between placed vertices labels rise. A vertex enters behind its
    last placed predecessor or before its first placed successor; own vertices
    that it contradicts leave, and it doesn't enter where another's would have to.
    """
    rng = np.random.default_rng(seed)
    out: dict[int, list[int]] = {}
    into: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    label = dict(labels)
    rest = sorted(v for v in own if v not in label and v not in out.get(v, ()))
    for _ in range(moves):
        if not rest:
            break
        k = int(rng.integers(len(rest)))
        v = rest[k]
        before, after = ([label[x] for x in near.get(v, ()) if x in label] for near in (into, out))
        if rng.random() < 0.5:
            low = max(before, default=None)
            low = min(after, default=0) - 2 if low is None else low
            high = min((x for x in after if x > low), default=low + SPAN)
            at = (low + high) // 2 if not after or min(after) > low else low + 1
        else:
            high = min(after, default=None)
            high = max(before, default=0) + 2 if high is None else high
            low = max((x for x in before if x < high), default=high - SPAN)
            at = (low + high) // 2 if not before or max(before) < high else high - 1
        clash = {x for x in into.get(v, ()) if label.get(x, at - 1) >= at} | {x for x in out.get(v, ()) if label.get(x, at + 1) <= at}
        loss = len(clash) - 1
        if clash <= own and (loss <= 0 or rng.random() < math.exp(-loss / heat)):
            label[v] = at
            for x in clash:
                del label[x]
            rest[k] = rest[-1]
            rest.pop()
            rest += sorted(clash)
    return {v: label[v] for v in own if v in label}


def shortest_cycle(g: LocalGraph, v: int) -> list[int] | None:
    """The vertices of a shortest cycle through v."""
    back, todo = {v: v}, [v]
    while todo:
        after = []
        for x in todo:
            for y in g.out[x]:
                if y == v:
                    found = [x]
                    while found[-1] != v:
                        found.append(back[found[-1]])
                    return found
                if y not in back:
                    back[y] = x
                    after.append(y)
        todo = after
    return None


def cycle_bound(g: LocalGraph) -> int:
    """A number of cycles without shared vertices, shortest ones first: no answer is smaller."""
    g, n, queue = g.copy(), 0, []

    def look(v: int) -> None:
        found = shortest_cycle(g, v)
        if found is None:
            g.drop(v)
        else:
            heapq.heappush(queue, (len(found), g.product(v), v, found))

    for v in sorted(g.out):
        look(v)
    while queue:
        _, _, v, found = heapq.heappop(queue)
        if v not in g.out:
            continue
        if all(x in g.out for x in found):
            n += 1
            for x in found:
                g.drop(x)
        else:
            look(v)
    return n


def exact(g: LocalGraph) -> set[int]:
    """A smallest answer, by branching: a vertex is taken, or kept and bypassed; both sides are reduced, split and bounded."""

    def search(g: LocalGraph, most: int) -> set[int] | None:
        """A smallest answer of at most so many vertices."""
        taken: set[int] = set()
        g = g.copy()
        reduce_all(g, taken)
        for comp in sorted((c for c in strong_components(g.out) if len(c) > 1), key=len):
            part = branch(g.part(set(comp)), most - len(taken))
            if part is None:
                return None
            taken |= part
        return taken if len(taken) <= most else None

    def branch(g: LocalGraph, most: int) -> set[int] | None:
        if cycle_bound(g) > most:
            return None
        v = max(g.out, key=lambda v: (g.product(v), -v))
        rest = g.copy()
        rest.drop(v)
        best = search(rest, most - 1)
        best = None if best is None else best | {v}
        rest = g.copy()
        rest.bypass(v)
        other = search(rest, most if best is None else len(best) - 1)
        return other if other is not None else best

    upper = minimal(g, sorted(greedy(g), key=lambda v: (g.product(v), v)))
    better = search(g, len(upper) - 1) if upper else None
    return upper if better is None else better


def remainder(g: LocalGraph, taken: set[int], kept: set[int]) -> LocalGraph:
    """The graph of a subproblem: g without what is taken, and what is kept bypassed. A kept vertex that has a loop by its turn stays."""
    rest = g.without(taken)
    for v in sorted(kept - taken):
        if v not in rest.out[v]:
            rest.bypass(v)
    return rest


#: Components of at most so many vertices that split off a subproblem are finished on the spot.
SPLIT_OFF = 30


def explore(g: LocalGraph, taken: set[int], kept: set[int], most: int, budget: int) -> tuple[set[int] | None, list[tuple[set[int], set[int]]]]:
    """Depth-first below a subproblem of g for so many nodes: an answer smaller than ``most``, if one was met, and the subproblems that are left.

    A subproblem is what is taken and what is kept on the way to it. Its graph is
    made anew from g when its turn comes, so one that waits takes no more room
    than its vertices.
    """
    stack, best, ahead = [(taken, kept)], None, None
    for _ in range(budget):
        if not stack:
            break
        taken, kept = stack.pop()
        rest, ahead = remainder(g, taken, kept) if ahead is None else ahead, None
        taken = set(taken)
        reduce_all(rest, taken)
        for comp in sorted((c for c in strong_components(rest.out) if len(c) > 1), key=len)[:-1]:
            if len(comp) <= SPLIT_OFF:
                taken |= exact(rest.part(set(comp)))
                for v in comp:
                    rest.drop(v)
        if not rest.out:
            if len(taken) < most:
                best, most = taken, len(taken)
            continue
        if len(taken) + cycle_bound(rest) >= most:
            continue
        v = max(rest.out, key=lambda v: (rest.product(v), -v))
        rest.drop(v)
        stack += [(taken, kept | {v}), (taken | {v}, kept)]
        ahead = rest
    return best, stack


def exact_by_size(g: LocalGraph, ternary: bool = False) -> set[int]:
    """A smallest answer by trying all sets of a size: sizes upwards, or halving the range of sizes (an answer can always be made larger)."""
    ids = sorted(g.out)

    def of_size(k: int) -> set[int] | None:
        return next((set(c) for c in choose(ids, k) if acyclic(g.without(set(c)))), None)

    if not ternary:
        return next(s for k in range(len(ids) + 1) if (s := of_size(k)) is not None)
    low, high, best = 0, len(ids), set(ids)
    while low < high:
        for k in sorted({low + (high - low) // 3, low + 2 * (high - low) // 3}):
            found = of_size(k) if low <= k < high else None
            if found is not None:
                best, high = found, k
                break
            low = max(low, k + 1)
    return best


def acyclic_masks(n: int, successors: list[int], masks: np.ndarray) -> np.ndarray:
    """For each subset of vertices 0 .. n-1, as bits: what is left without it has no cycle. Sinks are peeled for all masks at once."""
    left = ~masks & ((1 << n) - 1)
    while True:
        gone = np.zeros_like(left)
        for v in range(n):
            gone |= np.where((left >> v & 1 == 1) & (left & successors[v] == 0), np.int64(1 << v), np.int64(0))
        if not gone.any():
            return left == 0
        left = left & ~gone


def park_miller(seed: int = 123459876) -> Iterator[int]:
    """x -> 16807 x modulo 2^31 - 1 (fixed values of the minimal standard generator)."""
    x = seed
    while True:
        x = x * 16807 % 2147483647
        yield x
