"""Brute-force versions in plain Python."""

import collections
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _spans(text, kinds):
    found = []
    for rank, (kind, pattern, ok) in enumerate(kinds):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(found)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m.group())) <= 15),
)
_ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
SECRETS = (
    ("assign", _ASSIGN, lambda m: len(m.group(2)) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
)


def pii(text):
    return _spans(text or "", PII)


def secrets(text):
    return _spans(text or "", SECRETS)


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = collections.Counter(windows)
    covered = {j for k, x in enumerate(windows) if count[x] > 1 for j in range(k, k + 5)}
    n = len(w)
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 10 or 100 * len(covered) > 20 * n,
    }


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def components(ids, prints, radius=2):
    """Smallest reachable id by comparing all pairs of distinct fingerprints."""
    up = {p: p for p in prints}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    distinct = list(up)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for p in prints]
