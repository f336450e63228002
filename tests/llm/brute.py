"""Plain versions of the operators over lists, without Spark, hashes of sequences or any sharing of code with them."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(places)


def without_lines(docs):
    """Texts after line dedup; ``docs`` is a list of (id, text), ids without nulls."""
    key = lambda line: line.strip(SPACES).translate(LOWER)
    first = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), i), i)
    return [
        (i, [x for x in (text or "").split("\n") if first.get(key(x), i) == i], (text or "").split("\n")) for i, text in docs
    ]


def without_repeats(docs, depth):
    """(n_words, kept words) after cutting word sequences that start anywhere else too."""
    lists = [WORD.findall(text or "") for _, text in docs]
    seen = {}
    for words in lists:
        for i in range(len(words) - depth + 1):
            k = tuple(words[i : i + depth])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for words in lists:
        gone = {i + j for i in range(len(words) - depth + 1) if seen[tuple(words[i : i + depth])] > 1 for j in range(depth)}
        out.append((len(words), [w for i, w in enumerate(words) if i not in gone]))
    return out


def without_copies(docs, depth):
    """(n_bytes, n_spans, kept bytes) after cutting strings that start in a document with a smaller id; null ids are last."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, text in docs:
        raw = (text or "").encode()
        for s in range(len(raw) - depth + 1):
            k = raw[s : s + depth]
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - depth + 1):
            if first[raw[s : s + depth]] < order(i):
                gone[s : s + depth] = True
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(raw), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, bits=3):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def distance(passage, text):
    """Edits from a passage to the substring of a text that is nearest to it."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, row[j - 1] + (c != x), new[-1] + 1))
        row = new
    return min(row)


SECRETS = [
    (
        "assign",
        re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        lambda m: len(m[1]) >= 12,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def secrets(text):
    found = [
        (m.start(), k, m.end())
        for k, (_, pattern, good) in enumerate(SECRETS)
        for m in pattern.finditer(text or "")
        if good(m)
    ]
    return ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def shingle_set(text, n=5):
    words = _ascii_words(text)
    if not words:
        return frozenset()
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def _ascii_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", lower) if w]


def copy_components(texts, similarity=0.8):
    """Component number of each text, where sets of five-word shingles link at that similarity; equal sets are linked."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 10 * both >= 8 * either:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]
