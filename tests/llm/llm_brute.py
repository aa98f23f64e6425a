"""The registered queries in plain Python, straight from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORD, ALNUM_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    w = SPACE_WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(docs):
    sets, has = {d["doc_id"]: shingles(d["text"]) for d in docs}, defaultdict(set)
    for i, s in sets.items():
        for x in s:
            has[x].add(i)
    links = defaultdict(set)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in has[x] if j != i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links[i].add(j)
    out = {}
    for i in sorted(sets):
        if i not in out:
            todo, seen = [i], {i}
            while todo:
                todo += (new := links[todo.pop()] - seen)
                seen |= new
            out |= dict.fromkeys(seen, i)
    return {i: (len(sets[i]), out[i], len(links[i])) for i in sets}


def contamination(docs, items):
    windows = defaultdict(set)
    for item in items:
        w = ALNUM_WORD.findall(lower(item["text"]))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(str(item["item_id"]))
    out = {}
    for d in docs:
        w, found = ALNUM_WORD.findall(lower(d["text"])), set()
        hit = [False] * len(w)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if names := windows.get(tuple(w[k : k + size])):
                    hit[k : k + size] = [True] * size
                    found |= names
        out[d["doc_id"]] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit))
    return out


def substrings(docs):
    words, first = {d["doc_id"]: SPACE_WORD.findall(d["text"] or "") for d in docs}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def base_scores(docs):
    held, tokens = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs}, lambda d: [*SPACE_WORD.findall(lower(d["text"])), None]
    c = Counter(t for d in docs if not held[d["doc_id"]] for t in tokens(d))
    n, v = sum(c.values()), len(c)
    return {d["doc_id"]: (held[d["doc_id"]], len(tokens(d)), sum(c[t] > 0 for t in tokens(d)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(d)), 5)) for d in docs}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def personal(docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = {}
    for d in docs:
        spans, n = [], []
        for order, (kind, pattern) in enumerate(patterns.items()):
            found = []
            for m in re.finditer(pattern, d["text"] or ""):
                digits = re.sub("[^0-9]", "", m.group())
                if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                    found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
            spans += found
            n.append(len(found))
        out[d["doc_id"]] = (*n, sha(",".join(x[2] for x in sorted(spans))))
    return out


def media(docs):
    out = {}
    for d in docs:
        data = (d["text"] or "").encode()
        padded = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        out[d["doc_id"]] = (len(data), len(padded), sha(padded), zlib.crc32(padded[-32:]))
    return out


def encoded(docs):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for d in docs:
        ids = made.encode_ordinary(d["text"] or "")
        out[d["doc_id"]] = (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((d["text"] or "").encode()))
    return out


def line_chunks(text):
    """Lists of lines: boundaries by the rolling hash outside runs of equal lines, runs in pairs, no chunk of one line among several."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    ends, i = {len(lines)}, 0
    while i < len(lines):
        j = i
        while j + 1 < len(lines) and h[j + 1] == h[i]:
            j += 1
        if j > i:
            ends |= {i, *range(i + 2, j, 2), j + 1}
        elif ((h[i - 2] if i > 1 else 0) * 1103515245 + (h[i - 1] if i else 0) * 1664525 + h[i] * 69069) % 2147483647 % 4 == 0:
            ends.add(i + 1)
        i = j + 1
    kept = sorted(e for e in ends if e == len(lines) or e > 1 and e + 1 not in ends)
    return [lines[a:b] for a, b in zip([0, *kept], kept)]


def deduped_lines(docs):
    """doc_id to the text left; documents of equal doc_id must have equal texts."""
    chunks = {d["doc_id"]: line_chunks(d["text"]) for d in docs if d["text"] is not None and d["doc_id"] is not None}
    first = {}
    for i in sorted(chunks):
        for k, c in enumerate(chunks[i]):
            first.setdefault(tuple(c), (i, k))
    return {i: "\n".join("\n".join(c) for k, c in enumerate(own) if c == [""] or first[tuple(c)] == (i, k)) for i, own in chunks.items()}
