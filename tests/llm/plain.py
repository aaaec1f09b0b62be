"""Plain versions of the corpus operators: short, quadratic and without Spark."""

import re

WHITE = re.compile(r"[^\x20\x09-\x0d]+")
ASCII_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    ws = WHITE.findall((text or "").translate(FOLD))
    if not ws:
        return set()
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}


def near_components(docs):
    """id -> smallest id reachable over links, for a dict of texts."""
    sets = {i: shingles(t) for i, t in docs.items()}
    names = {i: i for i in docs}

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                names[high] = low
    return {i: root(i) for i in ids}


def without_repeats(docs, size=13):
    """id -> (words, kept words)."""
    words = {i: WHITE.findall(t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(docs):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - size + 1):
            if first[tuple(ws[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (ws, [w for k, w in enumerate(ws) if k not in gone])
    return out


def contaminated(docs, items, size=10):
    """id -> (words, hit words, item ids as sorted strings)."""
    windows = {}
    for item, text in items.items():
        ws = ASCII_WORD.findall((text or "").translate(FOLD))
        n = min(size, len(ws))
        for k in range(len(ws) - n + 1) if ws else ():
            windows.setdefault(tuple(ws[k : k + n]), set()).add(str(item))
    lens = {len(w) for w in windows}
    out = {}
    for i, text in docs.items():
        ws = ASCII_WORD.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for k in range(len(ws)):
            for n in lens:
                held = windows.get(tuple(ws[k : k + n])) if k + n <= len(ws) else None
                if held:
                    hit.update(range(k, k + n))
                    found |= held
        out[i] = (len(ws), len(hit), sorted(found))
    return out


def merkle(docs, arity=8):
    """doc_id -> (leaf, subroot, root, proof digest, folded root) for rows of unique ids."""
    import hashlib
    import zlib

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            row = levels[-1]
            levels.append([sha("".join(row[i : i + arity])) for i in range(0, len(row), arity)])
        return levels

    def path(levels, at):
        found = []
        for row in levels[:-1]:
            run = at // arity * arity
            found.append((row[run : run + arity], at - run))
            at //= arity
        return found

    langs = sorted({d[2] for d in docs}, key=lambda v: (v is not None, (v or "").encode()))
    of = {v: sorted((d for d in docs if d[2] == v), key=lambda d: d[0]) for v in langs}
    trees = {v: tree([sha("".join(map(part, d))) for d in of[v]]) for v in langs}
    top = tree([trees[v][-1][0] for v in langs])
    out = {}
    for k, v in enumerate(langs):
        for i, d in enumerate(of[v]):
            way = path(trees[v], i) + path(top, k)
            proof = "".join(x for run, at in way for j, x in enumerate(run) if j != at)
            text = d[4].translate(FOLD) if d[4] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 else d[4]
            now = sha("".join(map(part, (*d[:4], text))))
            for run, at in way:
                now = sha("".join(now if j == at else x for j, x in enumerate(run)))
            out[d[0]] = (trees[v][0][i], trees[v][-1][0], top[-1][0], sha(proof), now)
    return out
