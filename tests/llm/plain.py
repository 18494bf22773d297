"""Plain Python versions that the operators are held against, and small inputs."""

import random
import re


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^ \t\n\x0b\x0c\r]+", lowered)


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def components(count, linked, ids):
    """Smallest non-null id in the component of each of ``count`` rows."""
    root = list(range(count))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(count):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [None if i is None else least[find(k)] for k, i in enumerate(ids)]


def jaccard(rows, width, percent):
    sets = [shingles(text, width) for _, text in rows]

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)

    comp = components(len(rows), linked, [i for i, _ in rows])
    return sorted(((i, len(s), c) for (i, _), s, c in zip(rows, sets, comp)), key=str)


def near_copies(seed, count, hot=0.5, sizes=(3, 8, 40, 120), edits=(0, 0, 1, 2, 4, 8)):
    """Texts in groups of edited copies, one group holding a share of ``hot`` of all."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice(sizes))] for _ in range(max(5, count // 15))]
    out = []
    for k in range(count):
        own = list(base[0] if rnd.random() < hot else rnd.choice(base))
        if rnd.random() < 0.2:
            own += base[1][:20]
        for _ in range(rnd.choice(edits)):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        out.append((k, " ".join(own)))
    return out


def url_templates(paths, rare_share=0.02, rare_least=5, similar=2.0, shape=0.25, smoothing=10.0):
    """``{(host, segs): (template, purity)}`` from ``{(host, segs): (n, labelled, bad)}``, node by node."""
    total = [sum(x) for x in zip(*((lab, bad) for _, lab, bad in paths.values()))] or [0, 0]
    smooth = lambda lab, bad, above: (bad + smoothing * above) / (lab + smoothing)
    out = {}

    def kind(segs, k):
        after = segs[k] if len(segs) > k else ""
        return 0 if after == "" else 1 if after[0] == "#" else 2 if after == "@" else 3

    def grow(host, own, level, template, above):
        groups = {}
        for segs in own:
            groups.setdefault(segs[level] if len(segs) > level else "", []).append(segs)
        count = {s: [sum(paths[host, p][k] for p in g) for k in range(3)] for s, g in groups.items()}
        shapes = {s: [sum(paths[host, p][0] for p in g if kind(p, level + 1) == k) for k in range(4)] for s, g in groups.items()}
        size, names, free = sum(c[0] for c in count.values()), {}, []
        for s in groups:
            if s in ("", "@") or s[0] == "#" or len(groups) == 1:
                names[s] = s
            elif count[s][0] < max(rare_least, rare_share * size):
                names[s] = "*"
            else:
                free.append(s)
        branches = []
        for s in sorted(free, key=lambda s: (count[s][2] / count[s][1] if count[s][1] else -1, s)):
            n, lab, bad = count[s]
            place = None
            for k, (_, bn, bl, bb, bs) in enumerate(branches):
                if (lab > 0) != (bl > 0) or sum(abs(x / n - y / bn) for x, y in zip(shapes[s], bs)) > 2 * shape:
                    continue
                pooled = (bad + bb) / (lab + bl) if lab else 0
                if not lab or abs(bad / lab - bb / bl) < similar * (max(1e-9, pooled * (1 - pooled)) * (1 / lab + 1 / bl)) ** 0.5:
                    place = k
            if place is None:
                branches.append(([s], n, lab, bad, shapes[s]))
            else:
                members, bn, bl, bb, bs = branches[place]
                branches[place] = (members + [s], bn + n, bl + lab, bb + bad, [x + y for x, y in zip(bs, shapes[s])])
        for k, (members, *_) in enumerate(branches):
            names |= {s: f"+{k}" if len(members) > 1 else s for s in members}
        grown = {}
        for s, g in groups.items():
            grown.setdefault(template + ("/" + names[s] if s else ""), []).append((s, g))
        for name, parts in grown.items():
            lab, bad = sum(count[s][1] for s, _ in parts), sum(count[s][2] for s, _ in parts)
            rate = above if parts[0][0] == "" and len(groups) == 1 else smooth(lab, bad, above)
            for p in (p for _, g in parts for p in g if len(p) <= level):
                out[host, p] = name, rate
            on = [p for _, g in parts for p in g if len(p) > level]
            if on:
                grow(host, on, level + 1, name, rate)

    base = total[1] / total[0] if total[0] else 0
    for host in {h for h, _ in paths}:
        own = [p for h, p in paths if h == host]
        grow(host, own, 0, "", smooth(*(sum(paths[host, p][k] for p in own) for k in (1, 2)), base))
    return out
