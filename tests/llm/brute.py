"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Groups:
    def __init__(self, ids):
        self.parent = {i: i for i in ids}

    def find(self, i):
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def contamination(docs, items, size=13):
    """(id, words, hit words, items) per document."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i:i + size])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for p, owners in windows.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i:i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    names |= owners
        out.append((doc, len(w), len(hit), sorted(names)))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def near_duplicates(docs, size=3, percent=90):
    """id -> (set size, component)."""
    sets = {i: shingles(t, size) for i, t in docs}
    groups = Groups(sets)
    ids = [i for i in sets if sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                groups.union(i, j)
    return {i: (len(sets[i]), groups.find(i)) for i in sets}


def near_vectors(rows, threshold=0.9):
    """Sorted (id, links, component); null ids as -1."""
    def proper(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    groups, links = Groups({i for i, _ in rows}), [0] * len(rows)
    unit = {k: np.array(v) / np.abs(v).max() for k, (i, v) in enumerate(rows) if proper(i, v)}
    for a in unit:
        for b in unit:
            if a != b and len(unit[a]) == len(unit[b]):
                cosine = unit[a] @ unit[b] / np.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b]))
                if cosine >= threshold:
                    links[a] += 1
                    groups.union(rows[a][0], rows[b][0])
    return sorted((-1, 0, -1) if i is None else (i, links[k], groups.find(i)) for k, (i, _) in enumerate(rows))


def katz(docs, discounts, fold=1):
    """id -> (held out, tokens, known, training tokens, base, score), and the sums of next-word
    probabilities after some histories."""
    parsed = [(i, zlib.crc32(str(i).encode()) % 5 == fold, WORD.findall((t or "").translate(LOWER)) + [None]) for i, t in docs]
    words, pairs = Counter(), Counter()
    for _, held, t in parsed:
        if not held:
            words.update(t)
            pairs.update(zip([0, *t], t))
    total, types = sum(words.values()), len(words)
    d1, d2 = (discounts(np.array([0] + [sum(v == r for v in c.values()) for r in range(1, 7)])) for c in (words, pairs))

    def cut(d, r):
        return d[r] * r if r < len(d) else r

    unknown = 1 - sum(cut(d1, v) for v in words.values()) / total

    def p1(w):
        return cut(d1, words[w]) / total if w in words else unknown

    after = defaultdict(dict)
    for (h, w), v in pairs.items():
        after[h][w] = v
    weight, divisor = {}, {}
    for h, seen in after.items():
        n = sum(seen.values())
        left = 1 - sum(cut(d2, v) for v in seen.values()) / n
        if left <= 1e-9:
            n += 1
            left = 1 / n
        divisor[h], weight[h] = n, left / (1 - sum(p1(w) for w in seen))

    def p2(h, w):
        if h not in after:
            return p1(w)
        return cut(d2, after[h][w]) / divisor[h] if w in after[h] else weight[h] * p1(w)

    sums = [sum(p2(h, w) for w in words) + weight[h] * unknown for h in list(after)[:10]]
    out = {}
    for i, held, t in parsed:
        base = sum(math.log10((words.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))) for w in t)
        score = sum(math.log10(p2(h, w)) for h, w in zip([0, *t], t))
        out[i] = (held, len(t), sum(w in words for w in t), total, base, score)
    return out, sums


def remove_repeats(docs, length):
    """Sorted (id, bytes, removed, spans, sha256 of what stays)."""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[s:s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """source -> target by repeated resharing; sizes: source -> size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: level * w[s] for s in free}}
        fixed.update({s: cap * sizes[s] for s in over})


def damaged(rows):
    """(conv, turn, role, text) rows after damage."""
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def repair(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of one conversation's (turn, role, text)."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in turns:
        kept = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}  # state -> least (cost, audit, lines)

    def put(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                role = {"u": "user", "a": "assistant"}[after[state]]
                put(table, after[state], (cost + 3, audit + "I", (*lines, role + ":")))
        return table

    for (_, role, text), fault in zip(turns, faults):
        table = {}
        for state, (cost, audit, lines) in inserted(best).items():
            put(table, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra, first = 3 * (fault == "truncated"), role[:1]
            new = {"u": "user", "a": "assistant"}[after[state]]
            put(table, after[state], (cost + 3 + extra, audit + "R", (*lines, new + ":" + text)))
            if first == after[state] or first == "s" and state == "":
                put(table, first, (cost + extra, audit + "K", (*lines, role + ":" + text)))
        best = table
    best = inserted(best)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda e: e[:2])
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, list(lines))


def repaired(rows):
    """conv -> the columns of the query, from undamaged rows."""
    out = {conv: [] for conv, _, _, _ in rows}
    for conv, *turn in damaged(rows):
        out[conv].append(tuple(turn))
    found = {conv: repair(turns) for conv, turns in out.items()}
    return {c: (*f[:-1], hashlib.sha256("\n".join(f[-1]).encode()).hexdigest()) for c, f in found.items()}


def trie(rows):
    """Sorted node rows of rebuilt conversations from (conv, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ended[tuple(turns)].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node, ids in members.items():
        if node:
            children[node[:-1]] += 1
    for node, ids in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(ids) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(((ids[0], len(node), members[node[:-1]][0] if node else -1, len(ids), children[node], leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ended[node])).encode()).hexdigest()) for node, ids in members.items()))


def text_stats(text):
    """(words, their characters, symbols, repeated lines, words in repeated 3-word windows)."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def robust_shape(x, floors, alpha, steps, near, consistency, quantile):
    """(centre, covariance) by concentration steps over whole sorted distances, from the starts
    of the operator but its medians, and the reweighting step."""
    def shape(rows, factor):
        return rows.mean(0), factor * np.cov(rows.T, bias=True) + np.diag(floors ** 2)

    def distances(centre, cov):
        d = x - centre
        return np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T)

    p, h, best = x.shape[1], math.ceil(alpha * len(x)), None
    for rows in (x, x[::2], x[1::2]):
        found = shape(rows, 1.0)
        for _ in range(steps):
            found = shape(x[np.argsort(distances(*found), kind="stable")[:h]], consistency(alpha, p))
        if best is None or np.linalg.det(found[1]) < np.linalg.det(best[1]):
            best = found
    return shape(x[distances(*best) <= quantile(near, p)], consistency(near, p))


def quality_score(text, weight, bias, bits=18, sizes=(3, 4, 5)):
    """Probability of label 1, one occurrence of one feature after the other."""
    words = WORD.findall(text or "")
    found = []
    for i, word in enumerate(words):
        found.append(zlib.crc32(word.encode()) % 2 ** bits)
        marked = [1, *word.encode(), 2]
        for k in sizes:
            for at in range(len(marked) - k + 1):
                code = k
                for byte in marked[at:at + k]:
                    code = (code * 0x100000001B3 + byte) % 2 ** 64
                found.append(code * 0x9E3779B97F4A7C15 % 2 ** 64 >> (64 - bits))
        if i and word == words[i - 1]:
            found.append(zlib.crc32(b"\0again") % 2 ** bits)
    mean = sum(weight[b] for b in found) / max(1, len(found))
    return 1 / (1 + math.exp(-(mean + bias)))


class PageTexts(HTMLParser):
    """[(path of block elements, text, number of the article or 0)] of a page whose links
    all stand in skipped elements; a p or li without its end ends at the next one."""

    SKIPPED = {"head", "nav", "footer", "aside", "form", "script", "style", "title"}
    INLINE = {"b", "i", "em", "span", "a"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.text, self.articles = [], [], "", 0
        self.feed(page)
        self.close()
        self.block()

    def block(self):
        text = " ".join(self.text.split())
        if text and not any(t in self.SKIPPED or "ad" in c for t, c, _ in self.open):
            path = tuple(".".join([t, *c[:1]]) for t, c, _ in self.open)
            self.found.append((path, text, max([n for _, _, n in self.open], default=0)))
        self.text = ""

    def handle_data(self, data):
        self.text += data

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        if tag in self.INLINE or tag in ("br", "meta"):
            return
        self.block()
        if self.open and self.open[-1][0] == "p" or tag == "li" and self.open and self.open[-1][0] == "li":
            self.open.pop()
        self.articles += tag == "article"
        self.open.append((tag, (dict(attrs).get("class") or "").split(), self.articles if tag == "article" else 0))

    def handle_endtag(self, tag):
        if tag in self.INLINE:
            return
        self.block()
        names = [t for t, _, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag):]


def main_text(page, share=0.25, prior=4.0, textual="h1 h2 h3 p ul ol li blockquote section"):
    """The page's article by the ratios of its paths, each step on its own."""
    blocks = PageTexts(page).found if page else []
    if not blocks:
        return ""
    paths = {p for p, _, _ in blocks}
    marks = [sum(c in ",.;:!?、。，！？；：…" for c in t) for _, t, _ in blocks]

    def ratio(values):
        of = {p: np.mean([v for v, b in zip(values, blocks) if b[0] == p]) for p in paths}
        line = [of[b[0]] for b in blocks]
        near = [0.2 * line[max(0, i - 1)] + 0.6 * line[i] + 0.2 * line[min(len(line) - 1, i + 1)] for i in range(len(line))]
        return {p: np.mean([v for v, b in zip(near, blocks) if b[0] == p]) for p in paths}

    length, dots = ratio([len(t) for _, t, _ in blocks]), ratio(marks)
    inside = {p: any(e.split(".")[0] in ("article", "main") for e in p) for p in paths}
    fused = {p: (prior if inside[p] else 1) * length[p] * (1 + dots[p]) for p in paths}
    chosen = {p for p in paths if fused[p] >= share * max(fused.values())}
    if any(inside[p] for p in chosen):
        chosen = {p for p in chosen if inside[p]}
    tags = set(textual.split())
    articles = {n for p, _, n in blocks if p in chosen and n}

    def keeps(path, number):
        for i in range(len(path)):
            if any(path[:i] == c[:-1] for c in chosen) and all(e.split(".")[0] in tags for e in path[i:]):
                return True
        return path in chosen or number in articles and path[-1].split(".")[0] in tags

    return "\n".join(t for p, t, n in blocks if keeps(p, n))
