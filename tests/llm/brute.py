"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import xxhash

SPACE = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACE.findall(text or "")


def quality_counts(text):
    w, lines, seen, again = words(text), (text or "").split("\n"), set(), 0
    for x in lines:
        if SPACE.search(x):
            again += x in seen
            seen.add(x)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def fingerprint(text):
    w = words((text or "").translate(FOLD))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """rows: (doc_id, fingerprint)."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[top(b)] = top(a)
    least = {}
    for d, f in rows:
        least[top(f)] = min(d, least.get(top(f), d))
    return {(d, f): least[top(f)] for d, f in rows}


BENCH = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def overlap(text, items):
    """items: (item_id, text)."""
    w, hit, found = BENCH.findall((text or "").translate(FOLD)), set(), set()
    places = {}
    for k in {min(8, len(x)) for _, t in items if (x := BENCH.findall((t or "").translate(FOLD)))}:
        for i in range(len(w) - k + 1):
            places.setdefault(tuple(w[i : i + k]), []).append(i)
    for item, t in items:
        x = BENCH.findall((t or "").translate(FOLD))
        k = min(8, len(x))
        for i in range(len(x) - k + 1) if x else ():
            for at in places.get(tuple(x[i : i + k]), ()):
                hit.update(range(at, at + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


def holds_a_window(text, items, n=8):
    w = BENCH.findall((text or "").translate(FOLD))
    own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return any(tuple(x[i : i + n]) in own for _, t in items for x in [BENCH.findall((t or "").translate(FOLD))] for i in range(len(x) - n + 1))


def repeats(rows):
    """rows: (doc_id, text) in corpus order; per row n_bytes, n_removed, n_spans, sha256 of the rest."""
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            x = b[i : i + 100]
            if x in seen:
                gone[i : i + 100] = b"\x01" * 100
            else:
                seen.add(x)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


KINDS = {
    "assign": re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    spans = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= {"access": 18, "hex": 16}[kind]:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


def battery(token, alphabet):
    """The p-values of the three tests, from first principles, and Fisher's of all."""
    n, k = len(token), len(alphabet)
    v = [alphabet.index(c) + 1 for c in token]
    chi = (sum((token.count(c) - n / k) ** 2 / (n / k) for c in alphabet) - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [x > k // 2 for x in v]
    ones, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    half = 2 * ones * (n - ones) / n
    z = 9.0 if half <= 1 else abs(runs - half - 1) / math.sqrt(half * (half - 1) / (n - 1))
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    serial = 9.0 if not spread else abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / spread) * math.sqrt(n)
    tail = lambda z: 1 / (1 + math.exp(min(1.5976 * z + 0.070566 * z**3, 700)))
    half = -sum(math.log(max(p, 1e-300)) for p in (tail(chi), 2 * tail(z), 2 * tail(serial)))
    return math.exp(-half) * (1 + half + half * half / 2)


def discoveries(rows, rules):
    """doc_id: spans that the battery adds, for rows (doc_id, text); rules: the module with the fixed values."""
    pairs = Counter()
    for _, t in rows:
        for w in re.findall("[A-Za-z0-9+/_-]+", t or ""):
            if len(w) < rules.MIN_TOKEN:
                pairs.update(zip("." + w, w))
    total = Counter()
    for (a, _), n in pairs.items():
        total[a] += n
    cost = lambda a, b: math.log((total[a] + 0.5 * len(rules.SYMBOLS)) / (pairs[a, b] + 0.5))
    tokens = []
    for d, t in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in secrets(t)]
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}", t or ""):
            if any(a < m.end() and m.start() < b for a, b in base):
                continue
            alphabet = next(a for _, p, a in rules.ENCODINGS if re.search(p, m[0]))
            evidence = sum(cost(a, b) for a, b in zip("." + m[0], m[0])) - len(m[0]) * math.log(len(alphabet))
            evidence = max(evidence, 0.0) if battery(m[0], alphabet) >= rules.ALPHA else 0.0
            tokens.append((max(k for k, n in enumerate(rules.LENGTHS) if len(m[0]) >= n), evidence, d, f"random:{m.start()}:{m.end()}"))
    out = {}
    for kind in range(len(rules.LENGTHS)):
        own = [x for x in tokens if x[0] == kind]
        steps = [min(math.floor(x[1] * rules.STEPS), 100 * rules.STEPS) for x in own]
        good = [s for s in set(steps) if math.exp(-s / rules.STEPS) * len(own) <= rules.RATE * sum(x >= s for x in steps)]
        for (_, evidence, d, span) in own:
            if good and evidence >= min(good) / rules.STEPS:
                out.setdefault(d, []).append(span)
    return out


class Article(HTMLParser):
    """The article of a page by the standard library's parser: blocks joined by spaces, inline elements within words."""

    INLINE = set("a abbr b bdi bdo cite code data em font i kbd mark q s samp small span strong sub sup time u var".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in self.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in self.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article(html):
    p = Article()
    p.feed(html or "")
    p.close()
    return " ".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)


def crc(text):
    return zlib.crc32((text or "").encode())
