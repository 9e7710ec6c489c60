"""Plain one-text-at-a-time versions of what the contracts fix."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def held_out(doc_id, mod: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % mod == 2


def op2(docs, items):
    windows: dict[tuple, set] = {}
    for item, text in items:
        if text is None:
            continue
        w = WORD.findall(text.translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, own = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (got := windows.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    own |= got
        out.append((doc_id, len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit)))
    return out


#: kind -> (pattern, group whose length counts, least length)
SECRETS = {
    "assign": (re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def op4(docs):
    out = []
    for doc_id, text in docs:
        spans = []
        for rank, (kind, (rx, g, least)) in enumerate(SECRETS.items()):
            spans += [(m.start(), rank, m.end(), kind) for m in rx.finditer(text or "") if len(m[g]) >= least]
        spans.sort()
        n = [sum(s[3] == k for s in spans) for k in SECRETS]
        out.append((doc_id, *n, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))))
    return out


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op5(docs):
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        found = []
        for phrase, label in PHRASES.items():
            p = phrase.split()
            found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        at = sorted(i for i, _ in found)
        out.append((doc_id, len(w), len(found), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))))
    return out


def op6(docs):
    prints = []
    for doc_id, text in docs:
        w = SOLID.findall((text or "").translate(LOWER))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, f in enumerate(prints):
        parent[top(i)] = top(first.setdefault(f, i))
    for a, b in combinations(first, 2):
        if (a ^ b).bit_count() <= 2:
            parent[top(first[a])] = top(first[b])
    least: dict[int, object] = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            r = top(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(doc_id, f"{prints[i]:016x}", least.get(top(i))) for i, (doc_id, _) in enumerate(docs)]


def near_kept(docs):
    """Least ids of the groups that fingerprints link."""
    return sorted({g for _, _, g in op6(docs)})


def op7(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        w = SOLID.findall(text)
        lines = [x for x in text.split("\n") if SOLID.search(x)]
        grams: dict[tuple, list] = {}
        for i in range(len(w) - 4):
            grams.setdefault(tuple(w[i : i + 5]), []).append(i)
        repeat = {k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed))
    return out


def op8(docs, tokenizer):
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def op9(docs, tokenizer):
    out = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return out


def op1(docs):
    import math
    from collections import Counter

    def tokens(text):
        return [*SOLID.findall((text or "").translate(LOWER)), None]

    def out_of(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    seen = Counter(t for i, text in docs if not out_of(i) for t in tokens(text))
    n, v = sum(seen.values()), len(seen)
    return [
        (i, out_of(i), len(t), sum(x in seen for x in t), n, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in t))
        for i, t in ((i, tokens(text)) for i, text in docs)
    ]


def op11(pages):
    """Rows that repeat the least id of a payload are responses; a null id is never the least."""
    least: dict[str, int] = {}
    for page, _, html in pages:
        if page is not None:
            least[html or ""] = min(least.get(html or "", page), page)
    out = []
    for page, _, html in pages:
        data, first = (html or "").encode(), least.get(html or "")
        again = first is not None and page != first
        sha1 = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), sha1, "revisit" if again else "response", first if again else None))
    return out


def op12(rows, fan=8):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return sha("".join(field(v) for v in r))

    def tree(hashes):
        """(top, siblings and places of each leaf from its run to the top)."""
        ways = [[] for _ in hashes]
        under = [[i] for i in range(len(hashes))]
        while len(hashes) > 1:
            above, over = [], []
            for a in range(0, len(hashes), fan):
                run = hashes[a : a + fan]
                for k in range(len(run)):
                    for i in under[a + k]:
                        ways[i].append((run[:k], run[k + 1 :]))
                above.append(sha("".join(run)))
                over.append([i for k in range(len(run)) for i in under[a + k]])
            hashes, under = above, over
        return hashes[0], ways

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
        built[g] = tree([leaf(r) for r in groups[g]])
    if not order:
        return []
    root, up = tree([built[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for r, way in zip(groups[g], built[g][1], strict=True):
            changed = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and r[4] is not None
            folded = leaf((*r[:4], r[4].translate(LOWER))) if changed else leaf(r)
            proof = ""
            for left, right in way + up[k]:
                proof += "".join(left + right)
                folded = sha("".join([*left, folded, *right]))
            out.append((r[0], leaf(r), built[g][0], root, sha(proof), folded, folded == root))
    return out


def op13(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        n = len(text)
        h = sha("1:" + ("" if doc_id is None else str(doc_id)))
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        pre, mid, suf = text[:a], text[a:b], text[b:]
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out.append((doc_id, n, "plain", None, None, sha(text), sha(text)))
        elif h4 % 100 < 20:
            out.append((doc_id, n, "spm", a, b - a, sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text)))
        else:
            out.append((doc_id, n, "psm", a, b - a, sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)))
    return out
