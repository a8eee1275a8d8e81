"""Plain versions of the operators, one document at a time."""

import collections
import functools
import hashlib
import re
import unicodedata

KINDS = ("email", "ip", "card", "phone")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def pii(text):
    """Sorted (start, kind, end) of base spans."""
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PII[kind], text or "") if passes(kind, m[0]))


def shown(spans):
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text, spans=None):
    """text with its spans, or its base spans, replaced by their kinds."""
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in pii(text) if spans is None else spans:
        if a >= at:
            out += [text[at:a], f"<{ALL_KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


# --- bootstrapped extraction, word by word --------------------------------------

ALL_KINDS = (*KINDS, "secret")
SPACE = "[^\x20\t-\r]+"


def secrets(text):
    """(start, 4, end) of values of named secrets and of key formats."""
    from veridane.llm.pii_bootstrap import KEY_FORMATS, SECRET_NAME  # fixed values

    value = r"(?P<v>(?=[A-Za-z+/=_.-]*[0-9])[A-Za-z0-9+/=_.-]{16,})"
    named = rf"(?<![A-Za-z0-9])(?i:{SECRET_NAME})[\"']?[ \t]*[:=][ \t]*[\"']?{value}"
    key = rf"(?<![A-Za-z0-9])(?P<w>{KEY_FORMATS})"
    return [(m.start(m.lastgroup), 4, m.end(m.lastgroup)) for m in re.finditer(f"{named}|{key}", text)]


def cue(w):
    bare = re.sub("[0-9]+", "0", w.lstrip("([{\"'").rstrip(".,;!?)]}\"'"))
    return bare or w


def units(w):
    m = re.fullmatch(r"(.+?)[\"']?([:=#]+)", w)
    return [cue(m[1]), m[2]] if m else [cue(w)]


def shape(t):
    s = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", t))
    return s if len(s) <= 16 else "x"


def whole(t):
    return next((k for k, kind in enumerate(KINDS) if re.fullmatch(PII[kind], t, re.A) and passes(kind, t)), None)


def allowed(t):
    """Kinds that a candidate's form allows."""
    d = re.sub("[^0-9]", "", t)
    base = lambda k: re.fullmatch(PII[k], t) is not None
    out = []
    if len(re.split(r"@|\(at\)|\[at\]", t)) >= 2 and t.count("@") <= 1 and re.fullmatch(r"[^@]+(@|\(at\)|\[at\])[^@]+", t):
        out.append(0)
    part = r"[0-9]{1,3}"
    dot = r"(\.|\[\.\]|\(\.\))"
    if (t.count(":") >= 2 and set(t) <= set("0123456789abcdefABCDEF:.")) or (re.fullmatch(part + (dot + part) * 3, t) and set(t) - set("0123456789.")):
        out.append(1)
    if set(t) <= set("0123456789 ./_-") and t[0].isdigit() and t[-1].isdigit() and 12 <= len(d) <= 19 and luhn(d) and not base("card"):
        out.append(2)
    if set(t) <= set("0123456789+() ./-") and t[0] in "0123456789+(" and t[-1].isdigit() and 6 <= len(d) <= 15 and len(t) > 2 and not base("phone") and not re.fullmatch(r"[0-9]+(\.[0-9]+)+", t) and not (len(d) >= 14 and d == t):
        out.append(3)
    if len(t) >= 8 and " " not in t and "@" not in t and re.search("[A-Za-z]", t) and not re.fullmatch("[A-Za-z]+[0-9]{1,4}", t):
        out.append(4)
    return out


def mentions(text):
    """[(start, stop, instance, kind, own, kinds, patterns)] of a text."""
    text = text or ""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(SPACE, text)]
    spans = [*pii(text), *secrets(text)]
    low = lambda w: hashlib.md5(w.lower().encode()).hexdigest() if len(w) > 64 else w.lower()
    said = lambda k: "<s>" if k < 0 else "</s>" if k >= len(words) else low(words[k][2])
    at = lambda p: next(k for k, (a, b, _) in enumerate(words) if a <= p < b)
    groups, tokens = [], [k for k, w in enumerate(words) if re.search("[0-9@]", w[2])]
    marks = r"(?:[\[<{\"']|\((?![0-9+]+\).))*"
    label = rf"{marks}(?:[A-Za-z][A-Za-z_-]{{1,40}}[\"']?[:=#]+)?{marks}"
    number = lambda w: re.fullmatch(r"[(+]*[0-9][0-9()/.+-]*[.,;:!?]*", w) is not None
    alone = lambda w: number(w) and whole(w.rstrip(".,;:!?)]>}\"'*$%&#")) is not None
    for k in tokens:
        a, b, w = words[k]
        begun = sorted((x, kind, text[x:y], y) for x, kind, y in spans if a <= x < b)
        if begun:
            groups.append((k, k, begun[0]))
        elif not any(x < a < y for x, _, y in spans):
            last = groups[-1] if groups else None
            if last and last[2] is None and last[1] == k - 1 and text[words[k - 1][1] : a] == " " and number(w) and number(re.sub(f"^{label}", "", words[k - 1][2])) and words[k - 1][2][-1] not in ".,;:!?" and not alone(w) and not alone(words[k - 1][2]):
                groups[-1] = (last[0], k, None)
            else:
                groups.append((k, k, None))
    out = []
    for i, j, seed in groups:
        a, b = words[i][0], words[j][1]
        if seed:
            head, t, stop = text[a : seed[0]], seed[2], seed[3]
            behind = at(stop - 1) + 1
        else:
            m = " ".join(w for _, _, w in words[i : j + 1])
            head = re.match(label, m)[0]
            t = m[len(head) :].rstrip(".,;:!?)]>}\"'*$%&#")
            stop, behind = a + len(head) + len(t), j + 1
        if not t:
            continue
        own = None if seed else whole(t)
        kind = seed[1] if seed else own
        name = re.sub(r"[\"'(\[<{]+$", "", head.lower().lstrip("([<{\"'"))
        before = [u for w in [said(i - 2), said(i - 1), *([name] if name else [])] for u in units(w)]
        u2, u1 = before[-2:]
        patterns = (f"2 {u2} {u1}", f"1 {u1} _ {cue(said(behind))}", f"s {u1} {shape(t)}")
        instance = hashlib.md5(t.encode()).hexdigest() if len(t) > 64 else t
        out.append((a + len(head), stop, instance, kind, own is not None, None if kind is not None else allowed(t), patterns))
    return out


def all_spans(texts, support=3, rounds=3, confidence=0.6):
    """Sorted (start, kind, end) of all spans of each text, by plain scoring of the whole graph."""
    found = [mentions(t) for t in texts]
    kind_of, kinds_of = {}, {}
    for ms in found:
        for _, _, instance, kind, _, kinds, patterns in ms:
            for p in patterns:
                key = p, instance
                kind_of[key] = min((k for k in (kind_of.get(key), kind) if k is not None), default=None)
                kinds_of[key] = max(kinds_of.get(key) or [], kinds or [])
    sizes = collections.Counter(p for p, _ in kind_of)
    seeds = [(p, k, 1.0) for (p, _), k in kind_of.items() if k is not None]
    known, scores = seeds, {}
    for _ in range(rounds):
        total, lent = collections.Counter(), collections.Counter()
        for p, k, s in known:
            total[p, k] += s
            lent[p, k] += s >= confidence
        scores = {(p, k): total[p, k] / (sizes[p] + 1) for p, k in total if lent[p, k] >= support}
        best = {}
        for (p, i), k in kind_of.items():
            if k is None:
                for of in kinds_of[p, i]:
                    if (p, of) in scores:
                        best[i, of] = max(best.get((i, of), 0), scores[p, of])
        known = seeds + [(p, of, best[i, of]) for (p, i), k in kind_of.items() if k is None for of in range(5) if (i, of) in best]
    out = []
    for t, ms in zip(texts, found, strict=True):
        spans = [*pii(t or ""), *secrets(t or "")]
        for a, b, _, kind, own, kinds, patterns in ms:
            good = [(scores[p, k], k) for p in patterns for k in kinds or () if scores.get((p, k), 0) >= confidence]
            if own:
                spans.append((a, kind, b))
            elif kind is None and good:
                spans.append((a, max(good)[1], b))
        out.append(sorted(spans))
    return out


def quality(text, least=5, fraction=0.3, longest=50):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)

    def covered(k):
        seen = collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        inside = {j for i in range(n - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        return len(inside)

    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = covered(3)
    failed = n < 50 or 100 * repeat > 50 * n
    some = covered(least)
    kept = not failed and some <= fraction * n and covered(longest + 1) == 0
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, some, failed, kept


def fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """For each fingerprint its component's number."""
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {p: root(p) for p in distinct}


def component_ids(rows):
    """component_id of each (id, text)."""
    prints = [fingerprint(t) for _, t in rows]
    of = components(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    return [(i, f"{p:016x}", least.get(of[p])) for (i, _), p in zip(rows, prints, strict=True)]


def edits(rows):
    """(id, n_chars, edited digest, text, edited, next) with rows of distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + after[:n]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, after))
    return out


def grams(text, buckets):
    """Buckets of all n-grams of 1 to 3 characters with a letter, one by one."""
    points = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in text.lower()]
    out = []
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            if any(points[i : i + n]):
                m = 0
                for p in points[i : i + n]:
                    m = m * 0x100000001B3 + (p or 0x20) + 1
                out.append((((m + n) * 0x9E3779B97F4A7C15) % (1 << 64) >> 40) % buckets)
    return out


@functools.cache
def leaves(text):
    """Leaves of a text, cut character by character."""

    def ends_here(t):
        rolled = 0
        for k, c in enumerate(reversed(t[-8:])):
            mixed = ord(c) * 0x9E3779B1 & 0xFFFFFFFF
            rolled += (mixed ^ mixed >> 15) * pow(0x01000193, k, 1 << 32)
        return (rolled * 0x85EBCA6B & 0xFFFFFFFF) < 1 << 27

    out = []
    for line in (text or "").split("\n"):
        leaf = ""
        for c in line:
            leaf += c
            if len(leaf) >= 96 or (len(leaf) >= 16 and ends_here(leaf)):
                out.append(leaf)
                leaf = ""
        out += [leaf] if leaf else []
    return out


def likeness(a, b):
    """Share of leaves in common, with counts."""
    x, y = collections.Counter(leaves(a)), collections.Counter(leaves(b))
    return 1.0 if (a or "") == (b or "") else 2 * (x & y).total() / ((x + y).total() or 1)


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


def phrases(text):
    w = license_words(text)
    at, labels = [], set()
    for label, p in (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])):
        for k in range(len(w)):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def voted(text, templates, least=0.7, shift=3):
    """(labels, score) of a text by diagonal voting, template by template."""
    w, labels, best = license_words(text), set(phrases(text)[4].split(",")) - {""}, 0.0
    score = 0.5 if labels else 0.0
    where = collections.defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    for label, notice in templates:
        t = license_words(notice)
        votes = collections.defaultdict(set)
        for j in range(len(t) - 2):
            for i in where.get(tuple(t[j : j + 3]), []):
                votes[i - j].add(j)
        chains = []
        for d in sorted(votes):
            if not chains or d - chains[-1][-1] > shift:
                chains.append([])
            chains[-1].append(d)
        for chain in chains:
            middle = max((len(votes[d]), d) for d in chain)[1]
            width = max(len(t), 2 * shift)
            parts = collections.defaultdict(set)
            for d in chain:
                parts[(d - middle + width // 2) // width] |= {j + k for j in votes[d] for k in range(3)}
            for inside in parts.values():
                if len(inside) / len(t) >= least:
                    labels.add(label)
                    best = max(best, len(inside) / len(t))
    return ",".join(sorted(labels)), max(score, best)


def maximal_chats(rows):
    """{id: copies} of conversations that are no proper prefix of another; a row without an id is one of its own."""
    chats = collections.defaultdict(set)
    for conv, turn, role, text in rows:
        said = (-1 if turn is None else turn, "\0" if role is None else role, "\0" if text is None else text)
        chats[conv if conv is not None else ("none", said)].add(said)
    shaped = {}
    for conv, turns in chats.items():
        first = min(t for t, *_ in turns)
        by = collections.defaultdict(list)
        for t, *said in sorted(turns):
            by[t - first].append(tuple(said))
        shaped[conv] = tuple((t, tuple(x)) for t, x in sorted(by.items()))
    classes = collections.defaultdict(list)
    for conv, s in shaped.items():
        classes[s].append(conv)
    least = lambda convs: min(convs, key=lambda c: (0, 0) if isinstance(c, tuple) else (1, c))
    return collections.Counter((None if isinstance(least(c), tuple) else least(c), len(c)) for s, c in classes.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in classes))
