"""Personal data: exact base patterns plus a semi-Markov conditional random field over candidate segments.

The base patterns (email, ip, card, phone) are reported as they match. Around digits, ``@`` and spelled-out separators a
window of tokens is decoded jointly: bounded-length segments are scored by whole-span features, and dynamic programming
picks boundaries and types at once. Entities that the base patterns leave out (spelled-out addresses, numbers without a
country code, spaced cards) are added; base spans stay.

The field is trained here, once per session, by gradient ascent on the conditional log-likelihood of seeded, generated
sentences with known spans; no corpus text is needed, so results do not depend on how the corpus is laid out.

Defined cases: null text counts as empty; rows are judged one by one, so repeated rows each report; only the named columns
are read; an empty table gives an empty result. Offsets are code points, the end exclusive. Time is linear in the text:
a window's decoding costs its tokens times ``MAX_TOKENS`` times the types.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.sql import DataFrame

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")
#: Longest entity in tokens; tokens of context on either side of an anchor.
MAX_TOKENS, CONTEXT = 16, 8
_REGION = re.compile(r"\+?[0-9][\x20().0-9-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|[0-9]+|[^\sA-Za-zÀ-ɏ0-9]")
_DIGITS, _DOT = re.compile(r"[0-9]+"), re.compile(r"[\[(]at[\])]|\bdot\b", re.I)
_CUES = {"email": 0, "mail": 0, "contact": 0, "write": 0, "reach": 0, "ip": 1, "host": 1, "server": 1, "address": 1, "card": 2, "visa": 2, "credit": 2, "mastercard": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "telephone": 3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: from each @ back over the local part, at most to the end of the last match."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        # text up to the next @ that no local part can use again is not looked at twice
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns; every number pattern lies inside one region of number characters."""
    spans = [(0, s, e) for s, e in _emails(text)]
    for r in _REGION.finditer(text):
        a, b = r.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                spans.append((1, *m.span()))
        for m in _CARD.finditer(text, a, b):
            digits = re.sub(r"[\x20-]", "", m.group()) if m.end() - m.start() < 64 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
        m = _PHONE.match(text, a, b)
        if m and 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append((3, *m.span()))
    return sorted(spans)


# ---- the field

Tok = tuple[int, int, str]


def _tokens(text: str, a: int, b: int) -> list[Tok]:
    return [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text, a, b)]


def _may_start(toks: list[Tok], i: int) -> bool:
    t = toks[i][2]
    return t[0].isalnum() or t in "+(" and i + 1 < len(toks) and toks[i + 1][2].isdigit()


def _features(text: str, toks: list[Tok], i: int, j: int) -> list[str]:
    """Whole-span features of the candidate segment ``toks[i:j]``."""
    span = [t[2] for t in toks[i:j]]
    whole = text[toks[i][0] : toks[j - 1][1]]
    low = whole.lower()
    digits = "".join(c for c in whole if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in whole)
    seps = "".join(sorted({t for t in span if not t[0].isalnum()} | ({" "} if " " in whole else set())))
    groups = [len(t) for t in span if t.isdigit()]
    f = [f"nd={min(len(digits), 20)}", f"let={min(letters, 1)}", f"seps={seps}", f"groups={groups if len(groups) < 7 else 'many'}:{int(letters > 0)}"]
    if not letters and 13 <= len(digits) <= 19:
        f.append(f"luhn={luhn(digits)}:{len(digits) >= 15}")
    if not letters and len(groups) == 4:
        f.append(f"octets={all(int(t) <= 255 for t in span if t.isdigit() and len(t) < 9) and max(groups) <= 3}:{seps}")
    if letters:
        at = "@" in low or " at " in low or "[at]" in low or "(at)" in low
        dot = "." in low or " dot " in low or "[dot]" in low or "(dot)" in low
        f.append(f"mail={at}{dot}:{span[-1].isalpha() and 2 <= len(span[-1]) <= 4}:{low.count(' at ') + low.count('@') + low.count('[at]') + low.count('(at)') == 1}")
        f.append(f"odd={any(not t[0].isalnum() and t not in '@.[]()-_+' for t in span)}:{' ' in re.sub(r'[ ]?[(\[]?(at|dot)[)\]]?[ ]?', '', low)}")
    if whole.startswith("+"):
        f.append(f"plus:{8 <= len(digits) <= 15}")
    before = [t[2].lower() for t in toks[max(0, i - 3) : i]]
    cue = {_CUES[t] for t in before if t in _CUES}
    f += [f"cue={c}" for c in cue] or ["nocue"]
    # an entity does not stop inside a number or a word glued to it
    if i and toks[i - 1][1] == toks[i][0]:
        f.append(f"glued<{toks[i - 1][2] if not toks[i - 1][2][0].isalnum() else 'w'}")
    if j < len(toks) and toks[j][0] == toks[j - 1][1]:
        f.append(f"glued>{toks[j][2] if not toks[j][2][0].isalnum() else 'w'}")
    more = j < len(toks) and toks[j][2].isdigit()
    f.append(f"more={more}")
    f.append(f"last={'d' if span[-1].isdigit() else 'w' if span[-1][0].isalnum() else span[-1]}")
    return f


def _candidates(text: str, toks: list[Tok]) -> list[list[tuple[int, list[str]]]]:
    """For each token, the segments that may start there: (end, features)."""
    out: list[list[tuple[int, list[str]]]] = []
    n = len(toks)
    for i in range(n):
        own: list[tuple[int, list[str]]] = []
        if _may_start(toks, i):
            digits = mail = 0
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                t = toks[j - 1][2]
                digits += len(t) if t.isdigit() else 0
                mail |= t == "@" or t.lower() == "dot" or t.lower() == "at" and j > 1 and toks[j - 2][2] in "(["
                if j > i + 1 and toks[j - 1][0] - toks[j - 2][1] > 2:
                    break
                if (digits >= 7 or mail and j - i >= 4) and (t[0].isalnum()) and digits <= 24:
                    own.append((j, _features(text, toks, i, j)))
        out.append(own)
    return out


Weights = dict[tuple[str, int], float]


def _score(w: Weights, feats: list[str], k: int) -> float:
    return w.get(("bias", k), 0.0) + sum(w.get((f, k), 0.0) for f in feats)


def decode(w: Weights, text: str, toks: list[Tok]) -> list[tuple[int, int, int]]:
    """The best segmentation: (kind, first token, end token) of its entities; other tokens score 0."""
    cand, n = _candidates(text, toks), len(toks)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        for j, feats in cand[i]:
            for k in range(len(KINDS)):
                s = _score(w, feats, k) + best[j]
                if s > best[i]:
                    best[i], back[i] = s, (k, i, j)
    out, i = [], 0
    while i < n:
        if back[i]:
            out.append(back[i])
            i = back[i][2]
        else:
            i += 1
    return out


def _gradient(w: Weights, text: str, toks: list[Tok], gold: set[tuple[int, int, int]], rate: float) -> None:
    """One step up the log-likelihood of one sentence, by forward and backward sums over segmentations."""
    cand, n, kinds = _candidates(text, toks), len(toks), range(len(KINDS))
    scored = [[(j, f, [_score(w, f, k) for k in kinds]) for j, f in own] for own in cand]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    after = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        total = after[i + 1]
        for j, _, s in scored[i]:
            for k in kinds:
                total = add(total, s[k] + after[j])
        after[i] = total
    ahead = [0.0] + [-1e9] * n
    for i in range(n):
        ahead[i + 1] = add(ahead[i + 1], ahead[i])
        for j, _, s in scored[i]:
            for k in kinds:
                ahead[j] = add(ahead[j], ahead[i] + s[k])
    for i in range(n):
        for j, feats, s in scored[i]:
            for k in kinds:
                g = ((k, i, j) in gold) - math.exp(min(0.0, ahead[i] + s[k] + after[j] - after[0]))
                if abs(g) > 1e-4:
                    for f in ("bias", *feats):
                        w[f, k] = w.get((f, k), 0.0) * (1 - rate * 1e-3) + rate * g


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence and its entities (kind, start, end)."""
    word = lambda: "".join(r.choice("abdefghilmnoprstuvw") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def email() -> str:
        at, dot = r.choice([("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot ")])
        mid = r.choice(["", ".", "_"]) if at == "@" else ""
        return f"{word()}{mid}{r.choice(['', num(2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'io', 'de'])}"

    def card() -> str:
        body = r.choice("3456") + num(14)
        digits = next(body + d for d in "0123456789" if luhn(body + d))
        sep = r.choice(["", " ", "-", ".", "  "])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return r.choice(["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "+1 ({a}) {b}-{c}", "+1-{a}-{b}-{c}", "1-{a}-{b}-{c}", "00 44 {a} {b} {c}"]).format(a=r.choice("23456789") + num(2), b=r.choice("23456789") + num(2), c=num(4))

    def ip() -> str:
        parts = [str(r.randint(1, 254)) for _ in range(4)]
        return r.choice([".", ".", " . ", "[.]"]).join(parts)

    def noise() -> str:
        bad = r.choice("3456") + num(14)
        bad += next(d for d in "0123456789" if not luhn(bad + d))
        return r.choice([num(r.randint(2, 6)), f"{num(1)}.{num(1)}", f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{num(2)}.{num(2)}.{r.randint(1900, 2099)}", f"{r.randint(100, 999)},{num(3)},{num(3)}", num(r.randint(8, 13)), bad, num(r.randint(20, 24)), f"{word()} at {word()} {word()}", f"{word()} dot {word()}", f"{num(3)}.{num(3)}.{num(3)}.{r.randint(300, 999)}", f"v{num(1)}.{num(2)}.{num(1)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 20, 32, 40]))), f"{num(4)} {num(4)} {word()}", f"{num(3)} {num(2)} {num(3)} {num(2)} {num(3)}", f"{num(2)}:{num(2)}:{num(2)}", f"AKIA{num(4)}{word().upper()}{num(6)}", f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"])

    text, gold, makers = "", [], (email, ip, card, phone)
    for _ in range(r.randint(1, 3)):
        text += " ".join(word() for _ in range(r.randint(2, 6))) + " "
        k = r.randrange(4)
        if r.random() < 0.45:
            text += noise()
        else:
            if r.random() < 0.3:
                text += r.choice([c for c, v in _CUES.items() if v == k]) + r.choice([" ", ": "])
            value = makers[k]()
            gold.append((k, len(text), len(text) + len(value)))
            text += value
        text += r.choice([" ", ". ", ", "])
    return text + word(), gold


@functools.lru_cache(maxsize=1)
def model(sentences: int = 450, rounds: int = 3, seed: int = 7) -> Weights:
    """The trained weights; the same on every run."""
    r = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = _sentence(r)
        toks = _tokens(text, 0, len(text))
        first, last = {t[0]: i for i, t in enumerate(toks)}, {t[1]: i + 1 for i, t in enumerate(toks)}
        data.append((text, toks, {(k, first[s], last[e]) for k, s, e in gold if s in first and e in last}))
    w: Weights = {}
    for n in range(rounds):
        for text, toks, gold in data:
            _gradient(w, text, toks, gold, 0.3 / (1 + n))
    return {k: v for k, v in w.items() if abs(v) > 1e-3}


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches around anchors, cut at white space; those that touch are one."""
    out: list[tuple[int, int]] = []
    low = text.lower()
    spelled = _DOT.finditer(text) if " dot" in low or "dot]" in low or "dot)" in low or "(at)" in low or "[at]" in low else ()
    for m in sorted((*_DIGITS.finditer(text), *spelled), key=lambda m: m.start()) if spelled else _DIGITS.finditer(text):
        a, b = max(0, m.start() - 8 * CONTEXT), min(len(text), m.end() + 8 * CONTEXT)
        while a > 0 and a > m.start() - 12 * CONTEXT and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b < m.end() + 12 * CONTEXT and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], w: Weights) -> list[tuple[int, int, int]]:
    """Entities of the field that overlap no base span."""
    spans = []
    taken = sorted((s, e) for _, s, e in base)
    for a, b in _windows(text):
        toks = _tokens(text, a, b)
        for k, i, j in decode(w, text, toks):
            s, e = toks[i][0], toks[j - 1][1]
            if not any(s < y and x < e for x, y in taken):
                spans.append((k, s, e))
    return spans


def report(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _scan(row: tuple, w: Weights) -> list[tuple]:
    key, text = row
    text = text or ""
    base = base_spans(text)
    added = added_spans(text, base, w)
    counts = [sum(1 for s in base if s[0] == k) for k in range(4)]
    found = [{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for k, s, e in sorted(base + added, key=lambda x: x[1])]
    return [(key, *counts, report(base), report(base + added), found)]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone, base (spans), spans (all), found (kind, start, end, value)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, found array<struct<kind:string,start:long,end:long,value:string>>"
    return arrow_map(docs.select(key, text), _scan, schema, model())


def redact(text: str, spans: list[dict]) -> str:
    """``text`` with the found spans replaced by their kinds."""
    out, at = [], 0
    for s in sorted(spans, key=lambda x: x["start"]):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
            at = s["end"]
    return "".join(out) + text[at:]
