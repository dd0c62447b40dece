"""Plain re-computations of the training-data operators for small inputs (rows are (doc_id, text, lang, source))."""

import hashlib
import re
from collections import Counter

import xxhash

from tabula.llm import mixing, quality, secrets


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ── decontamination ──
def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def decontamination(docs, bench):
    wins = {}
    for item, text in bench:
        w = bench_words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k:k + 13]), set()).add("" if item is None else str(item))
    out = []
    for d in docs:
        w, hit, items = bench_words(d[1]), set(), set()
        for win, ids in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    items |= ids
        out.append((d[0], len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


# ── quality rules ──
def quality_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if n[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(again)


def quality_rows(docs):
    per, flags, hosts = [], [], {}
    for d in docs:
        n, chars, sym, lines, dup, rep = quality_measures(d[1])
        base = n < 10 or 100 * rep > 20 * n
        soft = (sym * 100 > n * quality.SYMBOL_PCT, dup * 100 > lines * quality.DUP_LINE_PCT,
                n > 0 and not quality.WORD_LEN[0] <= chars / n <= quality.WORD_LEN[1])
        per.append((d[0], n, chars, sym, dup, rep, base))
        flags.append(soft)
        hosts.setdefault(d[3], []).append(soft)
    marked = {h: [False] * 3 for h in hosts}
    for r in range(3):
        total = sum(len(v) for v in hosts.values())
        m = sum(s[r] for v in hosts.values() for s in v) / total if total else 0
        spread = sum(len(v) / total * (sum(s[r] for s in v) / len(v) - m) ** 2 for v in hosts.values()) if total else 0
        low, high = (len(hosts) - 1) / max(total, 1), 1 - sum((len(v) / max(total, 1)) ** 2 for v in hosts.values())
        rho = min(1, max(0, (spread / (m * (1 - m)) - low) / (high - low))) if 0 < m < 1 and high > low else 0
        for h, v in hosts.items():
            bad = sum(x[r] for x in v)
            marked[h][r] = bad > 0 and (bad * rho + m * (1 - rho)) / (len(v) * rho + 1 - rho) >= quality.HOST_RATE
    return [(*p, not p[6] and not any(a and b for a, b in zip(f, marked[d[3]]))) for p, f, d in zip(per, flags, docs)]


# ── SimHash ──
def fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def simhash_rows(docs):
    fps = [fingerprint(d[1]) for d in docs]
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[root(i)] = root(j)
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[root(i)] = min(least.get(root(i), d[0]), d[0])
    return [(d[0], f"{fps[i]:016x}", least.get(root(i))) for i, d in enumerate(docs)]


# ── secrets ──
def secret_base(text):
    t, out = text or "", []
    for kind, rx in enumerate((r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                               r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(rx, t):
            v = m[2] if kind == 0 else m[0]
            if len(v) >= (12, 18, 16)[kind]:
                out.append((m.start(), kind, m.end(), v))
    return sorted(out)


def secret_spans(docs):
    """Per document: base spans, and all (start, kind, end, live)."""
    found, owners = [], {}
    for d in docs:
        base = secret_base(d[1])
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9_-]{20,}", d[1] or "")
                if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")) and not any(b[0] < m.end() and m.start() < b[2] for b in base)]
        found.append((base, more))
        for x in base + more:
            owners.setdefault(x[3], set()).add((d[3] or "", d[2] or ""))
    copied = lambda v: len({o for o, _ in owners[v]}) >= secrets.EXAMPLE_OWNERS or len(owners[v]) >= secrets.EXAMPLE_REPOS
    live = lambda v: not copied(v) and len(set(v)) >= secrets.MIN_DISTINCT and "example" not in v.lower()
    return [(base, sorted({(a, k, z, live(v), copied(v)) for a, k, z, v in base + more})) for base, more in found]


def _names(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z, *_ in spans)


def secret_rows(docs):
    return [(d[0], *[sum(x[1] == k for x in base) for k in range(3)], sha(_names(base)),
             _names([x for x in every if x[1] < 3 or x[3]]), sum(x[3] for x in every), sum(x[4] for x in every)) for d, (base, every) in zip(docs, secret_spans(docs))]


def redacted(docs):
    out = []
    for d, (_, every) in zip(docs, secret_spans(docs)):
        cuts = []
        for a, _, z, live, _ in every:
            if live and cuts and cuts[-1][1] > a:
                cuts[-1][1] = max(cuts[-1][1], z)
            elif live:
                cuts.append([a, z])
        t = d[1]
        for a, z in reversed(cuts):
            t = t[:a] + "[REDACTED]" + t[z:]
        out.append((d[0], t, *d[2:]))
    return out


# ── mixing ──
def _domain(source):
    c = hashlib.md5((source or "(none)").encode()).hexdigest()[0]
    return "d0" if c < "6" else "d1" if c < "b" else "d2"


def _share(budget, kids):
    """kids: (name, weight, cap); shortages go to siblings in proportion to weight."""
    out, open_ = {}, sorted(kids, key=lambda k: (k[2] / k[1], k[0]))
    while open_:
        total = sum(k[1] for k in open_)
        name, w, cap = open_[0]
        if cap * total > w * budget:
            break
        out[name] = cap
        budget -= cap
        open_.pop(0)
    total = sum(k[1] for k in open_)
    return out | {name: w * budget // total for name, w, _ in open_}


def mixed(docs):
    """(index of the document, epoch) for every use."""
    size = lambda t: (len((t or "").encode()) + 3) // 4
    leaf = [(_domain(d[3]), d[2] or "(none)", d[3] or "(none)") for d in docs]
    total = Counter()
    for p, d in zip(leaf, docs):
        total[p] += size(d[1])
    node = {(): min(sum(total.values()) * mixing.BUDGET[0] // mixing.BUDGET[1], sum(total.values()) * mixing.MAX_EPOCHS)}
    for depth, level in enumerate(mixing.LEVELS):
        below = {}
        for parent, budget in node.items():
            caps = Counter()
            for p, n in total.items():
                if p[:depth] == parent:
                    caps[p[depth]] += n * mixing.MAX_EPOCHS
            kids = [(k, mixing.WEIGHTS.get(level, {}).get(k, 1), c) for k, c in caps.items()]
            below |= {(*parent, k): b for k, b in _share(budget, kids).items()}
        node = below
    out = []
    for p, budget in node.items():
        if not total[p]:
            continue
        mine = [i for i, q in enumerate(leaf) if q == p]
        whole, part = divmod(budget, total[p])
        out += [(i, e) for i in mine for e in range(whole)]
        hashes = {}
        for i in mine:
            h = hashlib.md5(f"{mixing.SEED}:{whole}:{'' if docs[i][0] is None else docs[i][0]}".encode()).hexdigest()
            hashes.setdefault(h, []).append(i)
        upto = 0
        for h in sorted(hashes):
            upto += sum(size(docs[i][1]) for i in hashes[h])
            if part == 0 or upto > part:
                break
            out += [(i, whole) for i in hashes[h]]
    return out


# ── substrings ──
def substring_rows(docs, span=400):
    texts = [(d[1] or "").encode() for d in docs]
    n = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for d, t in zip(docs, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if n[t[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d[0], len(t), sum(gone), runs, sha(bytes(x for x, g in zip(t, gone) if not g))))
    return out


# ── the pipeline ──
def pipeline(docs, bench):
    docs = [d for d, q in zip(docs, quality_rows(docs)) if q[-1]]
    groups, first = simhash_rows(docs), {}
    fps = [g[1] for g in groups]
    roots = {}
    for i, g in enumerate(groups):  # groups are known by their least id, or by position if they have none
        key = ("id", g[2]) if g[2] is not None else ("fp", min(f for f, x in zip(fps, groups) if x[2] is None and (int(f, 16) ^ int(g[1], 16)).bit_count() <= 3))
        roots.setdefault(key, []).append(i)
    for key, members in roots.items():
        first[key] = min((i for i in members if docs[i][0] == key[1] or key[0] == "fp"), default=members[0])
    docs = [docs[i] for i in sorted(first.values())]
    docs = [d for d, c in zip(docs, decontamination(docs, bench)) if not c[-1]]
    docs = redacted(docs)
    return [(*docs[i], e) for i, e in mixed(docs)]
