"""Plain versions of operators, for the tests: dictionaries and loops over all texts."""

import math
from collections import Counter, defaultdict

from tidewire.llm import decontamination, line_dedup, quality


def kneser_ney(texts, order=quality.ORDER):
    """probability(context and character) of an interpolated modified Kneser-Ney model of these texts."""
    pad = quality.PAD * (order - 1)
    counts = {order: Counter()}
    for t in texts:
        whole = pad + t
        counts[order].update(whole[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    drops, totals, dropped = {}, defaultdict(int), defaultdict(float)
    for k, of in counts.items():
        n1, n2, n3, n4 = (max(1, sum(c == i for c in of.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        drops[k] = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        for g, c in of.items():
            totals[k, g[:-1]] += c
            dropped[k, g[:-1]] += drops[k][min(c, 3) - 1]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        total = totals.get((k, gram[:-1]))
        if not total:
            return p(gram[1:])
        c = counts[k].get(gram, 0)
        return (c - drops[k][min(c, 3) - 1] if c else 0) / total + dropped[k, gram[:-1]] / total * p(gram[1:])

    return p


def qualities(rows, labels, quantile=quality.QUANTILE, order=quality.ORDER):
    """(perplexity, rejected) of each row (doc_id, text, lang, print)."""
    said = defaultdict(list)
    for i, q, t in labels:
        if i is not None:
            said[i].append((q == 1 and t == 0, t == 1))
    trusted = {i for i, x in said.items() if all(a for a, _ in x)}
    toxic = {i for i, x in said.items() if any(b for _, b in x)}
    out = {}
    for lang in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == lang and r[1]]
        train = [r[1] for r in mine if r[0] in trusted and r[3] % 2 == 0]
        unseen = [r[1] for r in mine if r[0] in trusted and r[3] % 2 == 1]
        foul = [r[1] for r in mine if r[0] in toxic and r[3] % 2 == 0]
        if not train or not unseen:
            continue
        p, pad = kneser_ney(train, order), quality.PAD * (order - 1)
        seen, fine = Counter(m for t in foul for m in quality.marks(t)), Counter(m for t in train for m in quality.marks(t))
        weights = {m: math.log((c + 0.5) / (len(foul) + 1)) - math.log((fine[m] + 0.5) / (len(train) + 1)) for m, c in seen.items() if c >= quality.SEEN}
        log_sum = lambda t: sum(math.log(p((pad + t)[i : i + order])) for i in range(len(t)))  # noqa: B023, E731
        worst = lambda t: max([0.0, *(weights[m] for m in quality.marks(t) if m in weights)])  # noqa: B023, E731
        mean = sum(map(log_sum, unseen)) / sum(map(len, unseen))
        perplexity = lambda t: math.exp(-(log_sum(t) + quality.PRIOR * mean) / (len(t) + quality.PRIOR))  # noqa: B023, E731
        at = lambda xs: sorted(xs)[max(1, math.ceil(quantile * len(xs))) - 1]
        limit, most = at([perplexity(t) for t in unseen]), at([worst(t) for t in unseen])
        for r in mine:
            out[r[0], r[1]] = perplexity(r[1]), perplexity(r[1]) > limit * (1 + 1e-9) or worst(r[1]) > most
    return [out.get((r[0], r[1]), (None, False)) for r in rows]


def common_ends(a, b):
    """How many lines at the head, and of the rest at the tail, are equal."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


def longest(a, b):
    """The length of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y))
    return best[-1][-1]


def lines(texts, align=line_dedup.patience, min_words=line_dedup.MIN_WORDS):
    """The texts without the blocks of lines aligned with any earlier text."""
    rows, out = [[(p, x.strip()) for p, x in enumerate((t or "").split("\n")) if x.strip()] for t in texts], []
    for k, t in enumerate(texts):
        hit = set()
        for before in rows[:k]:
            both = {x for _, x in before} & {x for _, x in rows[k]}
            here = [(r, x) for r, (_, x) in enumerate(rows[k]) if x in both]
            hit |= {here[j][0] for _, j in align([x for _, x in before if x in both], [x for _, x in here])}
        gone, block = set(), []
        for r in [*sorted(hit), -9]:
            if block and r != block[-1] + 1:
                if sum(len(rows[k][x][1].split()) for x in block) >= min_words:
                    gone |= {rows[k][x][0] for x in block}
                block = []
            block.append(r)
        out.append(t if t is None or not gone else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone))
    return out


def groups(texts, words=5, percent=80):
    """The smallest place reachable over near duplicates."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and top[i] != top[j]:
                lo, hi = sorted((top[i], top[j]))
                top = [lo if x == hi else x for x in top]
    return top


def contaminated(text, items, window=decontamination.WINDOW):
    w = [x.decode() for x in decontamination.words(text)]
    for t in items:
        v = [x.decode() for x in decontamination.words(t)]
        n = min(window, len(v))
        if n and any(w[p : p + n] == v[k : k + n] for k in range(len(v) - n + 1) for p in range(len(w) - n + 1)):
            return True
    return False
