"""Plain Python versions of the operators, for small tables."""
import collections
import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rules(text):
    w, text = words(text), text or ""
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?a:(?i:", "(?:(?ai:"))


def base_spans(text):
    text, out = text or "", []
    for no, (kind, pattern, group, least) in enumerate([("assign", ASSIGN, 1, 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]):
        out += [(m.start(), no, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    grams = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) > 3 else [w] if w else []
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(prints, most=2):
    """prints: list of (doc_id, fingerprint); smallest reachable id of each row."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= most:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(prints))]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return max(len(a), len(b)) - p - s <= 1


def dedup(docs, least=20):
    """docs: list of (doc_id, text) with distinct ids; {doc_id: (text, removed)}."""
    seen, out = [], {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        if text is None:
            out[doc] = (None, 0)
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            if len(line) >= least and words(line):
                if any(one_edit(line, x) for x in seen if abs(len(x) - len(line)) < 2):
                    gone += 1
                    seen.append(line)
                    continue
                seen.append(line)
            kept.append(line)
        out[doc] = ("\n".join(kept), gone)
    return out


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_parts(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def warc(pages):
    out, first = [], {}
    for page, html in pages:
        b = (html or "").encode()
        if len(b) >= 100 and page is not None:
            first[b] = min(page, first.get(b, page))
    for page, html in pages:
        b = (html or "").encode()
        again = b in first and page != first[b]
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return out


def mixing(rows):
    """rows: (doc_id, source, text); {doc_id: (size, source_size, target)}."""
    size = collections.Counter()
    for _, source, text in rows:
        size[source] += len(words(text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        free -= over
    return {d: (len(words(t)), size[s], target.get(s, 0.0)) for d, s, t in rows}


def leaks(docs, items):
    """Pairs whose document holds the item's text word for word."""
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    return {(d, i) for d, t in docs if t for i, x in items if plain(x) in plain(t)}


def _mix(x):
    m = (1 << 64) - 1
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & m
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & m
    return x ^ (x >> 33)


def gram_buckets(text, buckets=10_000):
    """Buckets of a text's words and word pairs, byte by byte."""
    from metrospan.llm.words import _BASE, LOWER
    m, hashes = (1 << 64) - 1, []
    for w in words(text):
        total, power = 0, 1
        for byte in w.encode():
            total, power = (total + int(LOWER[byte]) * power) & m, power * _BASE & m
        hashes.append(_mix((total + len(w.encode())) & m))
    return [_mix(h) % buckets for h in hashes] + [_mix((a * _BASE + b) & m) % buckets for a, b in zip(hashes, hashes[1:])]


def log_weights(docs, good, buckets=10_000):
    """Per document the log of target over raw probability of its n-grams."""
    raw, target = (collections.Counter(b for d, t in docs if keep(d) for b in gram_buckets(t, buckets)) for keep in (lambda d: True, lambda d: d in good))
    n, m = sum(target.values()) + buckets, sum(raw.values()) + buckets
    return {d: sum(math.log((target[b] + 1) / n) - math.log((raw[b] + 1) / m) for b in gram_buckets(t, buckets)) for d, t in docs}
