"""Plain graph definitions to hold results against."""

from collections import defaultdict


def roots(nodes, links):
    """Least reachable node of each node."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo, seen = [n], {n}
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        for m in seen:
            out[m] = n
    return out
