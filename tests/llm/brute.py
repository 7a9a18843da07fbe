"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))}


def components(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def ngram_join(docs, width=5, percent=80):
    """docs: (id, text) with distinct ids; doc_id to (n_shingles, component_id, n_links)."""
    sets = {i: shingles(t, width) for i, t in docs}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    links, degree = set(), defaultdict(int)
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                shared[j] += 1
        for j, n in shared.items():
            if i != j and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.add((i, j))
                degree[i] += 1
    root = components(sets, links)
    return {i: (len(s), root[i], degree[i]) for i, s in sets.items()}


def repeated_bytes(docs, window=200):
    """doc_id to (n_bytes, n_removed, n_spans, kept bytes)."""
    data = {i: (t or "").encode() for i, t in docs}
    seen = defaultdict(int)
    for b in data.values():
        for s in range(len(b) - window + 1):
            seen[b[s : s + window]] += 1
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\x01" * window
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def line_keys(text, brief=True, width=8):
    """(position, line) of every judged line of a text."""
    for pos, line in enumerate((text or "").split("\n")):
        if len(line) >= width or (brief and line.strip(" \t\n\r\v\f")):
            yield pos, line


def repeated_lines(docs, percent=80, width=8):
    """docs: (id, text) with distinct ids; doc_id to the positions of lines that another one stands for, and the pairs of texts that link."""
    spots = defaultdict(list)
    for i, t in docs:
        for pos, line in line_keys(t):
            spots[line].append((i, pos))
    sets = {x: {x[k : k + width] for k in range(len(x) - width + 1)} for x in spots if len(x) >= width}
    links = set()
    names = sorted(sets)
    for k, x in enumerate(names):
        for y in names[k + 1 :]:
            n = len(sets[x] & sets[y])
            if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                links.add((x, y))
    root = components(spots, links)
    classes = defaultdict(list)
    for x, where in spots.items():
        classes[root[x]] += where
    gone = defaultdict(list)
    for where in classes.values():
        for i, pos in sorted(where)[1:]:
            gone[i].append(pos)
    return {i: sorted(p) for i, p in gone.items()}, links


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: source to words; source to its target, by resharing until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done, left = {}, sum(sizes.values())
    while len(done) < len(order):
        open_ = [s for s in order if s not in done]
        all_weights = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] >= most * sizes[s] * all_weights]
        if not over:
            return done | {s: float(left * weight[s]) / all_weights for s in open_}
        for s in over:
            done[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in over)
    return done


def mix(docs, seed="mix-1", levels=(2, 6, 20), most=3):
    """docs: (id, text, source) with distinct ids; id to copies, one source after the other, without any strata."""
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    members = defaultdict(list)
    for i, _, s in docs:
        members[s].append(i)
    sizes = {s: sum(words[i] for i in m) for s, m in members.items()}
    goal, copies = targets(sizes), {}
    for s, m in members.items():
        u = int(hashlib.md5(f"{seed}:{'none' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) / 2**32
        level = {i: next((k for k, x in enumerate(levels) if words[i] * x > goal[s]), len(levels)) for i in m}
        rest, wanted = sizes[s], goal[s]
        for k in range(len(levels) + 1):
            here = [i for i in m if level[i] == k]
            if k == len(levels):
                here.sort(key=lambda i: (len(f"{words[i]:b}") * 4 + (int(f"{words[i]:b}"[1:3], 2) if words[i] >= 4 else 0), int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16) % 64, words[i], i))
            else:
                here.sort(key=lambda i: (words[i], i))
            at = [math.floor(n * wanted / rest + u) if rest else 0 for n in range(len(here) + 1)]
            for n, i in enumerate(here):
                copies[i] = min(most, at[n + 1] - at[n])
            rest -= sum(words[i] for i in here)
            wanted = max(0.0, min(wanted - sum(copies[i] * words[i] for i in here), float(most * rest)))
    return copies


def language(model, text):
    """(language, probability) of a text, gram by gram; None if it has no letter."""
    if not any(c.isalpha() for c in text or ""):
        return None
    raw = b"".join(b if b[0] > 127 or chr(b[0]).isalpha() else b" " for b in (c.encode("utf-8", "replace") for c in text.lower()))
    raw, mask = b" " + raw + b" ", 2**64 - 1
    total, n = [0.0] * len(model.langs), 0
    for order in (1, 2, 3, 4):
        for k in range(len(raw) - order + 1):
            x = int.from_bytes(raw[k : k + order], "big") * 8 + order
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> shift)) * factor & mask
            x = (x ^ (x >> 31)) % model.scores.shape[1]
            n += 1
            for c in range(len(total)):
                total[c] += float(model.scores[c, x])
    z = [(t / n + float(b)) / model.temperature for t, b in zip(total, model.bias)]
    p = [math.exp(v - max(z)) for v in z]
    best = max(range(len(p)), key=p.__getitem__)
    return model.langs[best], p[best] / sum(p)


def pipeline(docs, items, model):
    """docs: (id, text, source) with distinct ids; what each stage keeps, and id to copies."""
    kept = []
    found = {i: language(model, t) for i, t, _ in docs}
    docs = [d for d in docs if found[d[0]] and found[d[0]][1] >= model.reject_below]
    kept.append(docs)
    gone, _ = repeated_lines([d[:2] for d in docs])
    lines = [(i, [x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(i, ()))], s) for i, t, s in docs]
    docs = [(i, "\n".join(x), s) for i, x, s in lines if x]
    kept.append(docs)
    joined = ngram_join([d[:2] for d in docs])
    docs = [d for d in docs if joined[d[0]][1] == d[0]]
    kept.append(docs)
    tests = [x for x in map(shingles, items) if x]
    docs = [d for d in docs if not any(5 * len(x & s) >= 4 * len(x) for s in (shingles(d[1]),) for x in tests)]
    kept.append(docs)
    return kept, mix(docs)


def linked_texts(texts, width=8, percent=80):
    """Pairs (i, j), i < j, of texts whose character shingles have that similarity: exact, by prefixes of rare shingles."""
    sets = [{x[k : k + width] for k in range(len(x) - width + 1)} for x in texts]
    often = defaultdict(int)
    for s in sets:
        for x in s:
            often[x] += 1
    met, pairs = defaultdict(list), set()
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s = sets[i]
        found = set()
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]:
            found.update(met[x])
            met[x].append(i)
        for j in found:
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                pairs.add((min(i, j), max(i, j)))
    return pairs
