"""Plain versions of shared steps, for comparison."""

from __future__ import annotations


def least_reachable(nodes, linked) -> dict:
    """For each node the least node reached over the pairs in linked."""
    near = {n: set() for n in nodes}
    for a, b in linked:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for n in sorted(near):
        if n in root:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = n
                todo.extend(near[x] - root.keys())
    return root
