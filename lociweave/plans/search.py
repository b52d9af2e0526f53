"""Planning an external similarity search: which sequence sets to search against which. Driver-side and
tiny: it works on genome names and file sizes only."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations


def all_pairs(names: list[str], wanted: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Wanted pairs, trimmed, without self pairs and repeats; all pairs by default."""
    if wanted is None:
        return list(combinations(names, 2))
    out = []
    for a, b in wanted:
        if a is None or b is None or not a.strip() or not b.strip():
            raise ValueError("a pair needs two names")
        pair = tuple(sorted((a.strip(), b.strip())))
        if pair[0] != pair[1] and pair not in out:
            out.append(pair)
    unknown = {x for p in out for x in p} - set(names)
    if unknown:
        raise ValueError(f"unknown genomes: {', '.join(sorted(unknown))}")
    return out


def groups(pairs: list[tuple[str, str]]) -> list[list[str]]:
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(b)] = find(a)
    found: dict[str, list[str]] = {}
    for x in sorted(root):
        found.setdefault(find(x), []).append(x)
    return sorted(found.values())


@dataclass(frozen=True)
class Job:
    queries: tuple[str, ...]
    database: tuple[str, ...]


def plan(pairs: list[tuple[str, str]], size: dict[str, int]) -> list[Job]:
    """For each group the cheaper of: all against all (S + S^2), or one hub against the rest, both ways
    (S + 2*hub*rest), allowed if no wanted pair lies in the rest."""
    jobs = []
    wanted = {frozenset(p) for p in pairs}
    for group in groups(pairs):
        total = sum(size[x] for x in group)
        best, hub = total + total**2, None
        for h in group:
            rest = [x for x in group if x != h]
            if any(frozenset(p) in wanted for p in combinations(rest, 2)):
                continue
            r = sum(size[x] for x in rest)
            if (cost := size[h] + r + 2 * size[h] * r) < best:
                best, hub = cost, h
        if hub is None:
            jobs.append(Job(tuple(group), tuple(group)))
        else:
            rest = tuple(x for x in group if x != hub)
            jobs += [Job((hub,), rest), Job(rest, (hub,))]
    return jobs


def chunks(genomes: list[str], size: dict[str, int], limit: int) -> list[list[str]]:
    """In order, each as large as the limit allows, one genome at least."""
    out: list[list[str]] = []
    total = 0
    for g in genomes:
        if out and total + size[g] <= limit:
            out[-1].append(g)
            total += size[g]
        else:
            out.append([g])
            total = size[g]
    return out


def pending(jobs: list[Job], done: set[tuple[str, tuple[str, ...]]]) -> list[Job]:
    """Jobs without the queries that are finished against their database."""
    left = [Job(tuple(q for q in j.queries if (q, j.database) not in done), j.database) for j in jobs]
    return [j for j in left if j.queries]
