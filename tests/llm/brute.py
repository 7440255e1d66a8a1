"""Plain versions of the pipeline operators for small fixtures."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            hit |= set(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def contamination(text, items, window=10):
    words, hit, found = BENCH_WORD.findall((text or "").translate(LOWER)), set(), set()
    for item, body in items:
        own = BENCH_WORD.findall((body or "").translate(LOWER))
        size = min(window, len(own))
        parts = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in parts:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def shingles(words, size):
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)] if words else [])


def similar(a, b, percent):
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def near(rows, size, percent):
    """(doc_id, text) rows -> {doc_id: (set size, component, links)}"""
    sets = {i: shingles(WORD.findall((t or "").translate(LOWER)), size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if similar(sets[i], sets[j], percent):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines_kept(rows, percent=80, size=5):
    """(doc_id, text) rows -> {doc_id: (lines with words, places of those that stay)}"""
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        kept, n = [], 0
        for place, line in enumerate((t or "").split("\n")):
            own = shingles(WORD.findall(line), size)
            if own:
                n += 1
                if not any(similar(own, s, percent) for s in seen):
                    kept.append(place)
                seen.append(own)
        out[i] = (n, kept)
    return out


def unigram(rows):
    """(doc_id, text) rows -> {doc_id: (held, tokens, known, train tokens, score)}"""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    score = lambda w: math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1)))
    return {i: (held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(map(score, ws))) for i, ws in tokens.items()}


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return m[1].translate(LOWER), m[2]


def url_rule(host, path, rules):
    best = (None, None)
    for verdict, rule_host, rule_path in rules:
        fits = (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path)
        if fits and (best[0] is None or len(rule_host + rule_path) > len(best[0])):
            best = (rule_host + rule_path, verdict)
    return best


def urls(pages, rules, link, rounds=20):
    """(page_id, url, html) rows -> {page_id: (host, path, rule, verdict)}"""
    parts = [(i, *url_parts(u)) for i, u, _ in pages]
    net, edges = Counter(), Counter()
    for _, h, p in parts:
        if h:
            net[h] += {"allow": 1, "block": -1, None: 0}[url_rule(h, p, rules)[1]]
    for _, u, html in pages:
        for d in re.findall(link, html or ""):
            if (s := url_parts(u)[0]) and s != (d := d.translate(LOWER)):
                edges[s, d] += 1
    for h in list(net):
        for k in range(1, len(h.split(".")) - 1):
            if (q := ".".join(h.split(".")[k:])) in net:
                edges[h, q] += 1
                edges[q, h] += 1
    out, into = Counter(), Counter()
    for (s, d), n in edges.items():
        out[s] += n
        into[d] += n

    def walk(seeds, turn):
        total = sum(seeds.values()) or 1
        start = {h: v / total for h, v in seeds.items()}
        now = dict(start)
        for _ in range(rounds):
            new = {h: 0.15 * v for h, v in start.items()}
            for (s, d), n in edges.items():
                a, b, w = (s, d, n / out[s]) if turn else (d, s, n / into[d])
                new[b] = new.get(b, 0) + 0.85 * now.get(a, 0) * w
            now = new
        return now

    trust, distrust = walk({h: max(n, 0) for h, n in net.items()}, True), walk({h: max(-n, 0) for h, n in net.items()}, False)
    of_host = lambda h: "block" if round(distrust.get(h, 0), 12) > round(trust.get(h, 0), 12) else "allow"
    return {i: (h, p, url_rule(h, p, rules)[0], url_rule(h, p, rules)[1] or of_host(h)) for i, h, p in parts}


def licences(text, sentences, rules):
    known = {f: n for n, forms in sentences.items() for f in forms}
    ids = []
    low = (text or "").lower()
    for _ in range(3):
        low = re.sub(r"(spdx-license-identifier:)[ \t]*\(?([a-z0-9.+-]+)[ \t]+(?:or|and)[ \t]+\(?([a-z0-9.+-]+)\)?", r"\1 \2\n\1 \3", low)
    low = re.sub(r",\s+(all rights reserved)", r"\n\1", low)
    for s in re.split(r"\n+|(?<=[.!?;])[ \t\n\x0b\f\r]+", low):
        s = re.sub("[^a-z0-9]+", " ", s).strip(" ")
        if s and ((n := known.get(s, "?")) != "?" or not ids or ids[-1] != "?"):
            ids.append(n)
    if not any(i != "?" for i in ids):
        return "", "", ""
    rest, names, kinds = ids[:], [], []
    for rule, name, kind in rules:
        rule, out, i = rule.split(","), [], 0
        while i < len(rest):
            hit = rest[i : i + len(rule)] == rule
            out.append("." if hit else rest[i])
            i += len(rule) if hit else 1
        if "." in out and out != rest:
            names += [name] if name not in names else []
            kinds += [kind] if kind not in kinds else []
        rest = out
    return ",".join(ids), ",".join(names), ",".join(kinds)


# --- pseudonyms -----------------------------------------------------------------------------

PII = [
    ("email", r"(?<![^\W_]|[._%+-])[^\W_](?:[^\W_]|[._%+-]){0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    ("date", r"(?<![0-9])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])"),
    ("ssn", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+[1-9][0-9]{9,14}(?![0-9])|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])"),
]
PII_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PII))


def draw(key, kind, i, other):
    return hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()


def feistel(key, kind, left, right, a, b):
    for i in range(1, 9):
        if i % 2 == 0:
            left = (left + int(draw(key, kind, i, right)[:15], 16)) % a
        else:
            right = (right + int(draw(key, kind, i, left)[:15], 16)) % b
    return left, right


def luhn_check(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def moved_digits(key, kind, digits):
    half = len(digits) // 2
    rest = len(digits) - half
    left, right = feistel(key, kind, int(digits[:half] or 0), int(digits[half:]), 10**half, 10**rest)
    return (f"{left:0{half}}" if half else "") + f"{right:0{rest}}"


def refill(value, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in value)


def moved_signs(key, signs):
    half = len(signs) // 2
    left, right = signs[:half], signs[half:]

    def shift(text, i, other):
        h = draw(key, "email", i, other)
        out = ""
        for k, c in enumerate(text):
            first, size = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
            out += chr(first + (ord(c) - first + int(h[2 * k : 2 * k + 2] or "0", 16)) % size)
        return out

    for i in range(1, 9):
        if i % 2 == 0:
            left = shift(left, i, right)
        else:
            right = shift(right, i, left)
    return left + right


def pseudonym(kind, value, key):
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        if luhn_check(digits):
            return value
        body = digits[0] + moved_digits(key, "card", digits[1:-1])
        return refill(value, body + str((10 - luhn_check(body + "0")) % 10))
    if kind == "phone":
        return refill(value, digits[:-9] + moved_digits(key, "phone", digits[-9:]))
    if kind == "ip":
        o = list(map(int, value.split(".")))
        if max(o) > 255:
            return value
        return ".".join(str(x) for n in feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536) for x in divmod(n, 256))
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return value
        left, right = feistel(key, "ssn", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        area = left // 99 + 1
        return f"{area + (area >= 666):03}-{left % 99 + 1:02}-{right + 1:04}"
    if kind == "email":
        local, domain = value.split("@")
        plain = "[A-Za-z0-9]"
        signs = iter(moved_signs(key, "".join(re.findall(plain, local))))
        return "".join(next(signs) if re.match(plain, c) else c for c in local) + "@" + domain
    parts, mark = re.split("[-/.]", value), re.search("[-/.]", value)[0]
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]
    for order in orders:
        own = dict(zip(order, map(int, parts)))
        try:
            datetime.date(own["y"], own["m"], own["d"])
        except ValueError:
            continue
        if not 1900 <= own["y"] <= 2099:
            return value
        month, months = (10, 3) if own["m"] >= 10 else (1, 9)
        day, days = (1, 9) if own["d"] < 10 else (10, 3) if own["d"] <= 12 else (13, 19)
        left, right = (own["y"] - 1900) * months + own["m"] - month, own["d"] - day
        while True:
            left, right = feistel(key, "date", left, right, 200 * months, days)
            new = {"y": 1900 + left // months, "m": month + left % months, "d": day + right}
            try:
                datetime.date(new["y"], new["m"], new["d"])
                break
            except ValueError:
                continue
        return mark.join(str(new[c]).rjust(len(p), "0") for c, p in zip(order, parts))
    return value


def pseudonymised(text, key):
    changed = 0

    def put(m):
        nonlocal changed
        new = pseudonym(m.lastgroup, m[0], key)
        changed += new != m[0]
        return new

    return PII_ANY.sub(put, text), changed
