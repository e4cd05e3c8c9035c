"""A small table of awkward documents, and plain versions of the operators."""

import random
import re
from collections import Counter, defaultdict

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def low(x):
    return (x or "").translate(LOW)


def words(x, pattern=LETTERS):
    return pattern.findall(low(x))


def documents(seed=3, n=60):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared
    passages, nulls, empty and long texts, repeated rows, odd characters."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("aeioustrnlé") for _ in range(rnd.randint(2, 7))) for _ in range(120)]

    def prose(k):
        return " ".join(rnd.choice(vocab) + rnd.choice(["", "", "", ",", ".", "\n"]) for _ in range(k))

    passage = prose(60)
    texts = [prose(rnd.randint(1, 150)) for _ in range(n)]
    texts += texts[:4]  # exact copies
    base = prose(120)
    for i in range(8):  # near copies
        w = base.split(" ")
        w[i * 3] = f"changed{i}"
        texts.append(" ".join(w))
    texts += [prose(20) + "\n" + passage + "\n" + prose(20) for _ in range(3)]
    texts += [None, "", " \n ", "x", "one two", "One TWO", prose(3000), "ab" * 80, "ab" * 90, "😀é" * 30, "😀é" * 40 + "end", "a\x1cb c"]
    rnd.shuffle(texts)
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[6], None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text, size):
    w = words(text, SPACED)
    if 0 < len(w) < size:
        return {tuple(w)}
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(rows, size, percent=80):
    """doc_id -> smallest doc_id reachable, comparing all pairs."""
    nodes = [(i, shingle_set(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(nodes):
        for j, t in nodes[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in nodes}


def without_repeats(rows, length=50):
    """[(doc_id, bytes, removed flags)] of all rows."""
    first = {}
    raws = [(2**63 - 1 if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, raw in raws:
        for p in range(len(raw) - length + 1):
            gram = raw[p : p + length]
            first[gram] = min(key, first.get(gram, key))
    out = []
    for key, i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < key:
                gone[p : p + length] = b"\1" * length
        out.append((i, raw, gone))
    return out


def hits(text, items, window=13):
    """(words, hit words, item ids) of one text."""
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        v = words(t)
        k = min(window, len(v))
        grams = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if v else set()
        for p in range(len(w) - k + 1):
            if k and tuple(w[p : p + k]) in grams:
                hit |= set(range(p, p + k))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            again |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again)


def distance_one(a, b):
    """Whether two words are at most one edit apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out
