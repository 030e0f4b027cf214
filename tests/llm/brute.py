"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def dedup_lines(docs):
    """{doc_id: (lines, removed, text)} of (doc_id, text) rows with different ids."""
    docs = sorted((d, t) for d, t in docs if t is not None)
    seen, by_length, out = set(), defaultdict(list), {}
    for d, text in docs:
        kept, lines = [], text.split("\n")
        for line in lines:
            if line == "":
                kept.append(line)
                continue
            near = any(within_one_edit(line, x) for n in (-1, 0, 1) for x in by_length[len(line) + n])
            if line not in seen and not near:
                kept.append(line)
            if line not in seen:
                seen.add(line)
                by_length[len(line)].append(line)
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def simhash(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, distance=3):
    """{id: smallest id reachable} of {id: fingerprint}."""
    ids, root = sorted(values), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (values[a] ^ values[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {a: find(a) for a in ids}


def dedup_windows(docs, window=50):
    """{doc_id: (words, removed, kept words)}."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(ws, gone) if not g]
        out[d] = (len(ws), sum(gone), kept)
    return out


def dedup_bytes(texts, window=200):
    """[(bytes, removed, runs, kept)] of a list of texts."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if count[r[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), runs, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def check_packing(rows, texts, ids_of, size=4096):
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) hold every id once, in gapless sequences."""
    import numpy as np

    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids = np.array(ids_of(texts[d] or "") + [2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def spelling(docs, least_chars=5, least_count=3, slip_every=97):
    """Rows (word, form, root, n, n_near, form_n) of (doc_id, text) rows."""
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if slip_every and doc is not None and h % slip_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_count}
    near, by = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            by[i, cut].add(w)
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: x if x and n[x] >= 2 * n[w] else None for w, x in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), k, len(near[w]), n[form[w]] if form[w] else None) for w, k in n.items()]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def _way(levels, i):
    for now in levels[:-1]:
        a = i // 3 * 3
        yield now[a:i], now[i + 1 : a + 3]
        i //= 3


def merkle(docs):
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""

    def leaf(values):
        return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for row in docs:
        d, text = row[0], row[4]
        cut = d is not None and text is not None and zlib.crc32(str(d).encode()) % 2 == 0
        groups[row[1]].append((d is not None, d or 0, leaf(row), leaf((*row[:4], text.replace("\n", "") if cut else text)), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(groups[s], key=lambda x: x[:4])]) for s in names}
    top, rows = _levels([trees[s][-1][0] for s in names]), []
    for j, s in enumerate(names):
        for i, (*_, original, node, d) in enumerate(sorted(groups[s], key=lambda x: x[:4])):
            path = [*_way(trees[s], i), *_way(top, j)]
            for a, b in path:
                node = _sha("".join([*a, node, *b]))
            proof = _sha("".join(h for a, b in path for h in [*a, *b]))
            rows.append((d, original, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return rows


def similar(docs, width=4, part=85, of=100):
    """Rows (doc_id, n_shingles, component_id) of (doc_id, text) rows with different ids."""
    sets = {}
    for d, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    root, by = {d: d for d in sets}, defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(sets):
        for other, k in Counter(x for s in sets[d] for x in by[s]).items():
            if of * k >= part * (len(sets[d]) + len(sets[other]) - k):
                a, b = find(d), find(other)
                root[max(a, b)] = min(a, b)
        for s in sets[d]:
            by[s].append(d)
    return [(d, len(sets[d]), find(d)) for d in sorted(sets)]
