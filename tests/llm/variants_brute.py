"""Spelling variants in plain Python, straight from their contract."""

import re
import zlib
from collections import Counter, defaultdict


def variants(docs):
    counts = Counter()
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d["text"] or "") if d["doc_id"] is not None else ():
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{d['doc_id']}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    gaps, near = defaultdict(set), defaultdict(set)
    for w in words:
        for p in range(len(w)):
            gaps[(p, w[:p] + w[p + 1 :])].add(w)
            if (rest := w[:p] + w[p + 1 :]) in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in gaps.values():
        for w in group if len(group) > 1 else ():
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out
