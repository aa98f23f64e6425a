"""The conversation trie in plain Python, straight from its contract."""

import hashlib
import math
import zlib
from collections import defaultdict


def trie(rows):
    turns = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            said = ((r["role"] or ""), (r["text"] or ""))
            turns[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest(), said))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
            if d:
                children[tuple(made[c][: d - 1])].add(tuple(made[c][:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = {}
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(made[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out[(convs[0], len(node))] = (parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return out
