"""Plain versions of the contracts, for small inputs: whole tables in Python, every pair compared."""

import hashlib
import re

import numpy as np
import xxhash


def lower(data: bytes) -> bytes:
    return data.lower()


def simhash(rows, words=4, seed=42, radius=4):
    """{doc_id: (fingerprint in hex, component_id)} of rows (doc_id, text)."""
    prints = {}
    for doc, text in rows:
        parts = re.findall(rb"[^\x20\x09-\x0D]+", lower((text or "").encode()))
        shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
        value = 0
        hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
        for bit in range(64):
            value |= (2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit
        prints[doc] = value if hashes else 0
    distinct = sorted(set(prints.values()))
    root = {v: v for v in distinct}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for doc, value in prints.items():
        least[find(value)] = min(least.get(find(value), doc), doc)
    return {doc: (f"{value:016x}", least[find(value)]) for doc, value in prints.items()}


def repeats(rows, size=200):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] of rows (doc_id, text), distinct rows."""
    seen = {}
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    for doc, text in texts:
        for i in range(len(text) - size + 1):
            seen[text[i : i + size]] = seen.get(text[i : i + size], 0) + 1
    out = []
    for doc, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - size + 1):
            if seen[text[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.append((doc, len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def lines(rows, least=10):
    """[(doc_id, n_lines, n_dropped, kept)] of rows (doc_id, text)."""
    blank = " \t\n\v\f\r"
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    keys = lambda text: [x.strip(blank).translate(fold) for x in (text or "").split("\n")]
    holders = {}
    for doc, text in rows:
        for key in keys(text):
            holders.setdefault(key, set()).add(doc)
    out = []
    for doc, text in rows:
        kept = [x for x, k in zip((text or "").split("\n"), keys(text), strict=True) if len(k) < least or min(holders[k]) == doc]
        n = (text or "").count("\n") + 1
        out.append((doc, n, n - len(kept), "\n".join(kept)))
    return out


def decontaminate(rows, items, window=13, share=20):
    """[(doc_id, n_words, n_hit, items, contaminated)] of rows (doc_id, text) and items (item_id, text)."""
    words = lambda text: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower((text or "").encode()))
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for doc, text in rows:
        w, hit, names = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    names |= {str(x) for x in found if x is not None}
        out.append((doc, len(w), len(hit), sorted(names), bool(hit) and share * len(hit) >= len(w)))
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in reversed(re.sub("[^0-9]", "", value))]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def personal(text):
    """Base spans 'kind:start:end' of a text, in order."""
    fits = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": luhn,
        "phone": lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in BASE.items() for m in re.finditer(pattern, text or "") if fits[kind](m[0])]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def areas(image, rows, columns):
    """The means of rows x columns equal areas, each summed over the parts of samples that it covers."""
    def shares(size, parts):
        edge = np.arange(parts + 1) * size / parts
        at = np.arange(size)
        return np.clip(np.minimum(at + 1, edge[1:, None]) - np.maximum(at, edge[:-1, None]), 0, 1) / (size / parts)

    return shares(image.shape[0], rows) @ image.astype(float) @ shares(image.shape[1], columns).T
