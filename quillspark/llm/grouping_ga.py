"""Grouping genetic algorithm for bins of equal size.

Documents of one length are interchangeable, so a genome holds its bins as
patterns with a number of copies: {(lengths, largest first): copies}.  Its size
follows the number of distinct lengths, not the number of documents, and the
same code packs a thousand documents or a billion.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections import Counter

Genome = dict[tuple[int, ...], int]
#: Share of children that are mutated.
MUTATION = 0.25


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Bins that any packing needs: by total length, and by items over half a bin."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // size)
    return max(best, sum(c for n, c in counts.items() if 2 * n > size))


def fitness(genome: Genome, size: int) -> tuple[int, float]:
    """Fewer bins are better; of as many bins, well-filled ones beside empty ones."""
    bins = sum(genome.values())
    return (-bins, sum(c * (sum(p) / size) ** 2 for p, c in genome.items()) / max(1, bins))


def fill(counts: Counter, size: int, rng: random.Random | None, genome: Genome) -> None:
    """Pack all of ``counts`` into new bins, largest first, completing each bin.

    A bin is completed with the longest lengths that fit; with ``rng``, at times
    by a random one.  The last gap is closed by one or two lengths that fill it
    exactly where there are such.  As many copies of a pattern are made as the
    counts allow, so each step uses a length up.
    """
    left = sorted(n for n, c in counts.items() if c > 0)
    while left:
        pattern, used = [left[-1]], Counter({left[-1]: 1})
        gap = size - left[-1]
        while left and gap >= left[0]:
            pick = _closing(left, counts, used, gap)
            if not pick:
                at = bisect_right(left, gap) - 1
                if rng and at > 0 and rng.random() < 0.3:
                    at = rng.randrange(max(0, at - 40), at + 1)
                while at >= 0 and counts[left[at]] <= used[left[at]]:
                    at -= 1
                if at < 0:
                    break
                pick = (left[at],)
            for n in pick:
                pattern.append(n)
                used[n] += 1
                gap -= n
        copies = min(counts[n] // u for n, u in used.items())
        key = tuple(sorted(pattern, reverse=True))
        genome[key] = genome.get(key, 0) + copies
        for n, u in used.items():
            counts[n] -= u * copies
            if not counts[n]:
                del left[bisect_left(left, n)]


def _closing(left: list[int], counts: Counter, used: Counter, gap: int) -> tuple[int, ...]:
    """One or two available lengths that fill ``gap`` exactly, or none."""
    if counts.get(gap, 0) > used[gap]:
        return (gap,)
    tries = 0
    for at in range(bisect_right(left, gap) - 1, -1, -1):
        a, b = left[at], gap - left[at]
        if 2 * a < gap or tries > 60:
            break
        tries += 1
        if b and counts[a] > used[a] and counts.get(b, 0) > used[b] + (a == b):
            return (a, b)
    return ()


class _Rooms:
    """Bins of a genome by the room they have left."""

    def __init__(self, genome: Genome, size: int):
        self.genome, self.size = genome, size
        self.rooms: dict[int, list[tuple[int, ...]]] = {}
        self.order: list[int] = []
        for p in genome:
            if room := size - sum(p):
                self.rooms.setdefault(room, []).append(p)
        self.order = sorted(self.rooms)

    def open(self, p: tuple[int, ...], copies: int) -> None:
        """So many more bins of a pattern."""
        if p in self.genome:
            self.genome[p] += copies
            return
        self.genome[p] = copies
        if room := self.size - sum(p):
            if room not in self.rooms:
                self.rooms[room] = []
                insort(self.order, room)
            self.rooms[room].append(p)

    def put(self, n: int, copies: int) -> int:
        """Documents of length ``n`` go where the least room is left over; how many fit nowhere."""
        while copies and (at := bisect_left(self.order, n)) < len(self.order):
            room = self.order[at]
            p = self.rooms[room].pop()
            if not self.rooms[room]:
                del self.rooms[room], self.order[at]
            some = min(copies, self.genome[p])
            rest = self.genome.pop(p) - some
            if rest:
                self.open(p, rest)
            copies -= some
            self.open(tuple(sorted((*p, n), reverse=True)), some)
        return copies


def best_fit(displaced: Counter, genome: Genome, size: int) -> None:
    """Put displaced documents, longest first, where the least room is left over; the rest stays in ``displaced``."""
    rooms = _Rooms(genome, size)
    for n in sorted(displaced, reverse=True):
        displaced[n] = rooms.put(n, displaced[n])


def random_best_fit(counts: dict[int, int], size: int, rng: random.Random) -> Genome:
    """Documents in random order, in portions of a length, each by best fit: what islands start from."""
    portions = []
    for n in sorted(counts):
        cuts = sorted(rng.randrange(counts[n] + 1) for _ in range(2))
        portions += [(n, c) for c in (cuts[0], cuts[1] - cuts[0], counts[n] - cuts[1]) if c]
    rng.shuffle(portions)
    genome: Genome = {}
    rooms = _Rooms(genome, size)
    for n, c in portions:
        if rest := rooms.put(n, c):
            rooms.open((n,), rest)
    return genome


def crossover(a: Genome, b: Genome, counts: dict[int, int], size: int, rng: random.Random) -> Genome:
    """Inject whole well-filled bins of ``b`` into ``a``.

    Bins of ``a`` that hold a document injected already are duplicates and are
    taken apart; what they displace is put back by best fit, and what fits
    nowhere fills new bins.
    """
    well = sorted(b, key=lambda p: -sum(p))
    cut = rng.randint(len(well) // 3, max(1, 2 * len(well) // 3))
    child: Genome = {}
    left = Counter(counts)
    for p in well[:cut]:
        if rng.random() < 0.8:
            child[p] = b[p]
            for n in p:
                left[n] -= b[p]
    for p in sorted(a, key=lambda p: -sum(p)):
        need = Counter(p)
        copies = min(a[p], min(left[n] // u for n, u in need.items()))
        # The worst bins are taken apart too at times, which is the mutation.
        if copies > 0 and (sum(p) == size or rng.random() < 0.9):
            child[p] = child.get(p, 0) + copies
            for n in p:
                left[n] -= copies
    left = +left
    best_fit(left, child, size)
    fill(+left, size, rng, child)
    return child


def mutate(a: Genome, size: int, rng: random.Random) -> Genome:
    """Take the bins with room apart, and some full ones, and pack what they held anew."""
    child: Genome = {}
    left: Counter = Counter()
    for p, copies in a.items():
        if sum(p) == size and rng.random() < 0.9:
            child[p] = copies
        else:
            for n in p:
                left[n] += copies
    fill(left, size, rng, child)
    return child


def evolve(population: list[Genome], counts: dict[int, int], size: int, generations: int, members: int, rng: random.Random) -> list[Genome]:
    """Best ``members`` genomes after ``generations``; starts with random best-fit ones if there are too few.

    Stops early at the lower bound, which nothing can beat.
    """
    population = list(population)
    while len(population) < members:
        population.append(random_best_fit(counts, size, rng))
    ranked = sorted(((fitness(g, size), k, g) for k, g in enumerate(population)), key=lambda r: (r[0], -r[1]), reverse=True)[:members]
    least = lower_bound(counts, size)
    for k in range(generations):
        if -ranked[0][0][0] <= least:
            break
        # Parents by tournament; the injected bins come from the better one.
        one, two = (min(rng.randrange(len(ranked)), rng.randrange(len(ranked))) for _ in range(2))
        child = crossover(ranked[max(one, two)][2], ranked[min(one, two)][2], counts, size, rng)
        if rng.random() < MUTATION:
            child = mutate(child, size, rng)
        ranked.append((fitness(child, size), len(population) + k, child))
        ranked.sort(key=lambda r: (r[0], -r[1]), reverse=True)
        del ranked[members:]
    return [g for _, _, g in ranked]
