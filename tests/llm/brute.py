"""Plain versions of the operators over lists of dicts, without Spark."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"[^\x20\x09-\x0D]+"


def low(text):
    return (text or "").translate(_LOW)


def words(text, pattern=ALNUM):
    return re.findall(pattern, low(text))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def contamination(docs, items, span=10):
    """(doc_id, n_words, n_hit, sorted item ids as text) for each document."""
    windows = defaultdict(set)
    for item in items:
        if item["item_id"] is None or item["text"] is None:
            continue
        w = words(item["text"])
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item["item_id"]))
    sizes = {len(k) for k in windows}
    out = []
    for d in docs:
        w, hit, found = words(d["text"]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    found |= got
                    hit.update(range(i, i + n))
        out.append((d["doc_id"], len(w), len(hit), sorted(found)))
    return out


def fingerprint(text):
    w = words(text, BLANK)
    if not w:
        return 0
    k = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_classes(docs, limit=4):
    """(doc_id, fingerprint, smallest reachable doc_id) by comparing all pairs."""
    prints = [fingerprint(d["text"]) for d in docs]
    union, different = Union(), sorted(set(prints))
    for i, a in enumerate(different):
        union.find(a)
        for b in different[:i]:
            if (a ^ b).bit_count() <= limit:
                union.join(a, b)
    low_id = {}
    for d, p in zip(docs, prints):
        root = union.find(p)
        if d["doc_id"] is not None:
            low_id[root] = min(low_id.get(root, d["doc_id"]), d["doc_id"])
    return [(d["doc_id"], f"{p:016x}", low_id.get(union.find(p))) for d, p in zip(docs, prints)]


def repeated_words(w, n=5):
    times = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    again = set()
    for i in range(len(w) - n + 1):
        if times[tuple(w[i : i + n])] > 1:
            again.update(range(i, i + n))
    return len(again)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept)."""
    text = text or ""
    w = re.findall(BLANK, text)
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    n, chars = len(w), sum(map(len, w))
    symbols, dups = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    again, capitals = repeated_words(w), sum("A" <= c <= "Z" for c in text)
    stutter = sum(a == b for a, b in zip(w, w[1:]))
    bad = (
        n < 10 or again > 0.2 * n or chars < 2.5 * n or chars > 15 * n or symbols > 0.1 * n
        or dups > 0.4 * len(lines) or capitals > 0.3 * chars or stutter > 0.2 * n
    )
    return n, chars, symbols, dups, again, not bad


def mixture(docs, weights=(1, 2, 3), epochs=3, seed=20240601):
    """(doc_id, size, source_size, target, times) for each document."""
    size = [len(re.findall(BLANK, d["text"] or "")) for d in docs]
    by = defaultdict(int)
    for d, s in zip(docs, size):
        by[d["source"]] += s
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    clamped, total = set(), sum(by.values())
    while True:
        open_weight = sum(w for s, w in weight.items() if s not in clamped)
        level = (total - sum(epochs * by[s] for s in clamped)) / open_weight if open_weight else math.inf
        over = {s for s in names if s not in clamped and epochs * by[s] <= weight[s] * level}
        if not over:
            break
        clamped |= over
    target = {s: float(epochs * by[s]) if s in clamped else weight[s] * level for s in names}
    whole = {s: epochs if s in clamped else int(target[s] // by[s]) for s in names}

    def key(d):
        told = "" if d["doc_id"] is None else str(d["doc_id"])
        inner = hashlib.md5((d["text"] or "").encode()).hexdigest()
        return hashlib.md5(f"{seed}|{told}|{inner}".encode()).hexdigest()

    extra = set()
    for s in names:
        sums = defaultdict(int)
        for d, n in zip(docs, size):
            if d["source"] == s:
                sums[key(d)] += n
        run, want = 0, target[s] - whole[s] * by[s]
        for k in sorted(sums):
            if 2 * run + sums[k] <= 2 * want:
                extra.add((s, k))
            run += sums[k]
    return [
        (d["doc_id"], n, by[d["source"]], target[d["source"]],
         min(epochs, whole[d["source"]] + ((d["source"], key(d)) in extra)))
        for d, n in zip(docs, size)
    ]


def token_rows(docs, tokenizer, end_id=1):
    """(doc_id, start, n_tokens, crc32) in ascending order of id (null first) and text hash."""
    import numpy as np

    out, at = [], 0
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [end_id]
        out.append((d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def license_base(text, phrases):
    """(n_words, places, first, last, labels) of the fixed phrases."""
    w = words(text)
    at, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def license_rules(text, rules):
    """(labels, words covered) of the rules after suppression, scanning all rules."""
    norm = f" {' '.join(words(text))} "
    keyed = set(norm.split())
    found = []
    for rank, r in enumerate(rules):
        if r["keyword"] in keyed:
            for m in re.finditer(r["pattern"], norm):
                begin = norm[: m.start()].count(" ")
                found.append((begin, -(begin + m.group().count(" ")), -r["priority"], rank, r["label"]))
    kept = []
    for begin, past, below, _, label in sorted(found):
        if not kept or begin >= kept[-1][1]:
            kept.append((begin, -past, below, label))
        elif -past > kept[-1][1] and below < kept[-1][2]:
            kept[-1] = (begin, -past, below, label)
    return {k[3] for k in kept}, sum(k[1] - k[0] for k in kept)


def passage_classes(docs, least=50, similarity=0.8):
    """Smallest id reached by shared exact runs of ``least`` words: a lower bound of the links."""
    union, seen = Union(), {}
    for d in docs:
        w = words(d["text"])
        union.find(d["doc_id"])
        for i in range(len(w) - least + 1):
            union.join(seen.setdefault(tuple(w[i : i + least]), d["doc_id"]), d["doc_id"])
    return {d["doc_id"]: union.find(d["doc_id"]) for d in docs}


BLOCKS = (
    "address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul"
).split()


def visible_text(page):
    """Lines of the text outside of scripts and the like, by a parser; for well-formed pages."""
    import html.parser

    class Text(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.unseen = [], 0

        def handle_starttag(self, tag, attrs):
            self.unseen += tag in ("script", "style", "template", "noscript")
            self.parts.append("\n" if tag in BLOCKS else "")

        def handle_endtag(self, tag):
            self.unseen -= tag in ("script", "style", "template", "noscript")
            self.parts.append("\n" if tag in BLOCKS else "")

        def handle_data(self, data):
            if not self.unseen:
                self.parts.append(data.replace("\n", " ").replace("\r", " "))

    reader = Text()
    reader.feed(page)
    reader.close()
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(reader.parts).split("\n"))
    return "\n".join(line for line in lines if line)
