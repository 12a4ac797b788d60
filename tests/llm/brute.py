"""Plain restatements of what the operators compute, for small inputs."""

import numpy as np
import xxhash


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(texts):
    """texts: id -> text."""
    fp = {i: simhash(t) for i, t in texts.items()}
    ids, v = list(fp), np.array(list(fp.values()), np.uint64)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4) if j > i]
    return fp, components(ids, links)


def vector_links(rows, threshold=0.93):
    """rows: (id, label, vector) -> id -> (n_links, component); ids are distinct."""
    ids = [r[0] for r in rows]
    good = [r for r in rows if r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    links = []
    for label, width in {(r[1], len(r[2])) for r in good}:
        mine = [r for r in good if r[1] == label and len(r[2]) == width]
        v = np.array([r[2] for r in mine], np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(v @ v.T >= threshold, 1))
        links += [(mine[i][0], mine[j][0]) for i, j in zip(a, b, strict=True)]
    n = dict.fromkeys(ids, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = components(ids, links)
    return {i: (n[i], comp[i]) for i in ids}
