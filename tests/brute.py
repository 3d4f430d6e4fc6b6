"""Slow, obvious versions of the operators, for comparison on small inputs."""

import math
import zlib
from collections import Counter, defaultdict

from evenkeel.functions.hashing import COEFFICIENTS, PRIME


def cw(key, k, member=0):
    a, b = COEFFICIENTS[member]
    if isinstance(key, str):
        key = zlib.crc32(key.encode())
    return (a * key + b) % PRIME % k


def two_choice(keys, k, source_of):
    """Worker of each key, loads kept per source; a tie goes to the second candidate."""
    loads = defaultdict(lambda: [0] * k)
    out = []
    for i, key in enumerate(keys):
        mine = loads[source_of(i, key)]
        a, b = cw(key, k, 0), cw(key, k, 1)
        worker = a if mine[a] < mine[b] else b
        mine[worker] += 1
        out.append(worker)
    return out


def online(keys, k, s, m, theta, order="key", flush=False):
    """(routing tables per period, workers of the routed keys)."""
    loads = [0] * k
    tables, workers = {}, []
    size = s * m
    for start in range(0, len(keys), size):
        rows = keys[start : start + size]
        if len(rows) < size and not flush:
            break
        heavy = Counter()
        for source in range(s):
            mine = rows[source::s]
            for key, cnt in Counter(mine).items():
                if cnt >= math.ceil(theta * len(mine)):
                    heavy[key] += cnt
                else:
                    loads[cw(key, k)] += cnt
        items = sorted(heavy.items(), key=(lambda e: e[0]) if order == "key" else (lambda e: (-e[1], e[0])))
        table = {}
        for key, cnt in items:
            worker = loads.index(min(loads))
            loads[worker] += cnt
            table[key] = worker
        tables[start // size + 1] = table
        workers += [table.get(key, cw(key, k)) for key in rows]
    return tables, workers


def lpt(items, k):
    """Loads of (id, amount) placed largest first."""
    loads = [0] * k
    for amount in sorted((a for _, a in items), reverse=True):
        loads[loads.index(min(loads))] += amount
    return loads


def space_saving(keys, counters):
    kept = {}
    for key in keys:
        if key in kept:
            kept[key][0] += 1
        elif len(kept) < counters:
            kept[key] = [1, 0]
        else:
            victim = min(kept, key=lambda x: (kept[x][0], x))
            floor = kept.pop(victim)[0]
            kept[key] = [floor + 1, floor]
    return kept


def skewed(n, keys=50, hot=7, every=3):
    """A stream in which one key holds a third of all rows."""
    return [hot if i % every == 0 else (i * 7919 + i // 11) % keys for i in range(n)]
