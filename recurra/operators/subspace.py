"""Subspace motif sets: lists of occurrences, each with its own interval in every dim of the set; merging under constraints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: One occurrence: dim -> (start, end exclusive).
Occurrence = dict[int, tuple[int, int]]


@dataclass
class MotifSet:
    occurrences: list[Occurrence] = field(default_factory=list)

    @property
    def dims(self) -> tuple[int, ...]:
        return tuple(sorted(self.occurrences[0])) if self.occurrences else ()

    def start(self, k: int) -> int:
        return min(a for a, _ in self.occurrences[k].values())

    def end(self, k: int) -> int:
        return max(z for _, z in self.occurrences[k].values())


def rate(a: tuple[int, int], b: tuple[int, int]) -> float:
    """Intersection over hull of two intervals."""
    return max(0, min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0]))


def linkage(a: Occurrence, b: Occurrence, complete: bool = False) -> float:
    """Mean (complete: least) rate over all pairs of dims."""
    rates = [rate(x, y) for x in a.values() for y in b.values()]
    return min(rates) if complete else sum(rates) / len(rates)


def match(a: MotifSet, b: MotifSet, delta: float, complete: bool = False) -> tuple[MotifSet, MotifSet, MotifSet]:
    """What joins, and what is left of both: in order, each occurrence takes the first free one whose linkage exceeds delta (reaches it, if delta is 1)."""
    free = list(range(len(b.occurrences)))
    joined, rest = MotifSet(), MotifSet()
    for x in a.occurrences:
        for k in free:
            s = linkage(x, b.occurrences[k], complete)
            if s > delta or (delta == 1 and s == 1):
                joined.occurrences.append(x | b.occurrences[k])
                free.remove(k)
                break
        else:
            rest.occurrences.append(x)
    return joined, rest, MotifSet([b.occurrences[k] for k in free])


def merge(left: list[MotifSet], right: list[MotifSet], delta: float, complete: bool = False, keep_right: bool = True) -> list[MotifSet]:
    """Pairwise joins of two lists; a join of two occurrences or more is a set of its own, what it leaves of one or none vanishes, sets that joined nothing stay."""
    out: list[MotifSet] = []
    kept: list[MotifSet] = []
    rests = list(right)
    for a in left:
        for k, b in enumerate(rests):
            if not a.occurrences:
                break
            if set(a.dims) & set(b.dims) or not b.occurrences:
                continue
            joined, a_rest, b_rest = match(a, b, delta, complete)
            if len(joined.occurrences) >= 2:
                out.append(joined)
                a, rests[k] = (x if len(x.occurrences) > 1 else MotifSet() for x in (a_rest, b_rest))
        kept.append(a)
    return out + [x for x in kept if x.occurrences] + [b for b in rests if keep_right and b.occurrences]


def plan(n_dims: int, include: list[int | str] = (), exclude: list[int | str] = (), together: list[list[int | str]] = (), names: list[str] | None = None) -> list[list[int]]:
    """Groups of dims to search, in order: the included jointly first, then those that must occur together, then single dims except excluded and grouped ones (the included ones too, so that what is left of them can join). Dims by number, or all of a constraint by name where names are given."""

    def numbers(dims: list[int | str]) -> list[int]:
        if all(isinstance(d, str) for d in dims) and dims:
            if unknown := [d for d in dims if d not in (names or ())]:
                raise ValueError(f"no dim is named {', '.join(unknown)}")
            return [names.index(d) for d in dims]
        if not all(isinstance(d, int) for d in dims):
            raise ValueError(f"dims of one constraint are all numbers or all names: {dims}")
        if dims and not 0 <= min(dims) <= max(dims) < n_dims:
            raise ValueError(f"dims are numbered from 0 to {n_dims - 1}: {dims}")
        return list(dims)

    include, exclude, together = numbers(include), numbers(exclude), [numbers(g) for g in together]
    grouped = {d for g in together for d in g}
    return ([include] if include else []) + together + [[d] for d in range(n_dims) if d not in grouped and d not in exclude]


def apply(groups: list[list[int]], discover: Callable[[list[int]], list[MotifSet]], delta: float, complete: bool = False, included: bool = False, least_dims: int = 1) -> list[MotifSet]:
    """Discovers motif sets per group of dims and folds the lists from left to right; sets with enough dims stay. included: the first group must be in every set, so sets of later groups only join."""
    found = [[s for s in discover(g) if s.occurrences] for g in groups]
    out = found[0] if found else []
    for more in found[1:]:
        out = merge(out, more, delta, complete, keep_right=not included)
    return [s for s in out if len(s.dims) >= least_dims]
