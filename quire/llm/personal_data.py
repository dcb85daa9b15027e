"""Personal data by a skip-chain conditional random field on top of four base patterns.

The words around digits, at signs and written-out addresses form chains; words of one document that repeat or resemble
each other (equal letters and digits, equal local parts or domains, numbers with the same end or with one half in
common) are joined by skip edges, each to its next occurrence, and share a potential on their kinds. Loopy message
passing over both sorts of edges gives every word its belief. What the base patterns find is observed and pulls its
repetitions along: a number written without its plus sign, an address with "at" in it, a card with a digit mistaken.

Weights are fitted by pseudo-likelihood on a bounded sample of what the base patterns find and leave out, together
with the other ways of writing it that are made from the sample by rule.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone")
#: Windows of each kind, and of none, that the fit learns from at most; characters of a window on each side.
SAMPLE, WINDOW = 400, 48
#: Words on each side of a word worth looking at, rounds of message passing, the old message's share, and the belief from which a word is of a kind.
CONTEXT, ROUNDS, DAMPING, BELIEF = 2, 30, 0.5, 0.9
FIT_STEPS, FIT_RATE, RIDGE = 200, 0.2, 1e-4

# A run of local characters is tried once: where no address follows, none does from later in the run. The same holds for digits.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]+(\.[0-9]+\.[0-9]+\.[0-9]+)?")
CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^ \t-\r]+")
HIT = re.compile(r"[0-9@]|[A-Za-z]\.[A-Za-z]|[\[({](?:at|dot)[\])}]|(?<![^ \t-\r])dot(?![^ \t-\r])")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the base patterns find, by kind and start; a match that fails its rule is dropped and not tried again."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text) if m[1]]
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if m[1] and all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# features

SHAPES = {
    "number": r"[0-9]+", "numeric": r"[+(]*[0-9][0-9().-]*", "plus": r"\+[0-9].*", "area": r"\([0-9]{3}\)", "line": r"[0-9]{3}[.-][0-9]{4}", "whole": r"\(?[0-9]{3}\)?[.-][0-9]{3}[.-][0-9]{4}",
    "code": r"1[.-]\(?[0-9]{3}\)?[.-][0-9]{3}[.-][0-9]{4}", "four": r"[0-9]{4}", "fours": r"[0-9]{4}(?:[.-][0-9]{2,6}){2,4}", "date": r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}",
    "decimal": r"[0-9]+[.,][0-9]+", "clock": r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?", "version": r"v?[0-9]+\.[0-9]+\.[0-9]+", "at": r"at", "at mark": r"[\[({<]at[\])}>]", "dot": r"dot", "dot mark": r"[\[({<]dot[\])}>]",
    "domain": r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "local": r"[A-Za-z0-9._%+-]+", "letters": r"[A-Za-z]+", "address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "any at": r".*@.*",
    "at inside": r"[A-Za-z0-9._%+-]+[\[({]at[\])}][A-Za-z0-9-]+(?:(?:\.|[\[({]dot[\])}])[A-Za-z0-9-]+)+", "hex": r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}",
}
MATCHES = [re.compile(p, re.S).fullmatch for p in SHAPES.values()]
OCTETS = re.compile(r"([0-9]{1,3})(\.|-|\[\.\]|\(dot\)|\[dot\])([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})").fullmatch
COUNTS = (0, 1, 2, 3, 4, 5, 7, 8, 10, 11, 12, 13, 20)
N_WORD = len(SHAPES) + len(COUNTS) + 6
#: Of a word and its two neighbours, and of the run of numbers that it is in.
N_FEATURES = 3 * N_WORD + 3 + len(COUNTS) + 5
LABELS = 1 + 2 * len(KINDS)
KIND_OF = np.array([0, *[1 + k for k in range(len(KINDS)) for _ in range(2)]])


def trim(word: str) -> str:
    """A word without the punctuation around it; brackets stay where the word closes them itself."""
    w = word.strip("\"'`,;:!?|<>=*#$%&~/\\")
    w = w.rstrip(".,;:!?")
    if w[:1] == "(" and ")" not in w:
        w = w.lstrip("(")
    return w.rstrip(")") if "(" not in w else w


@functools.lru_cache(1 << 14)
def seen(word: str) -> tuple[tuple[int, ...], str, bool, tuple[str, ...]]:
    """A word's features, its digits, whether it can be a part of a longer number, and the keys that tie it to words like it."""
    w = trim(word)
    if len(w) > 400:  # no address and no number is that long: only its digits count
        digits = NOT_DIGIT.sub("", w)
        return (len(SHAPES) + bisect_right(COUNTS, len(digits)) - 1,), digits, False, (w,) if digits else ()
    digits = NOT_DIGIT.sub("", w)
    own = [i for i, f in enumerate(MATCHES) if f(w)]
    own.append(len(SHAPES) + bisect_right(COUNTS, len(digits)) - 1)
    octets = OCTETS(w)
    numeric = bool(MATCHES[1](w))
    check = luhn(digits) if 13 <= len(digits) <= 19 and numeric else None
    fits = octets and all(int(octets[i]) < 256 for i in (1, 3, 4, 5))
    flags = (fits and octets[2] == ".", fits and octets[2] != ".", octets and not fits, check is True, check is False, len(set(digits)) < 3 and len(digits) > 6)
    own += [len(SHAPES) + len(COUNTS) + i for i, f in enumerate(flags) if f]
    keys = []
    plain = re.sub(r"[^0-9A-Za-z]+", "", w).lower()
    if digits and len(plain) >= 5:
        keys.append(f"w{plain}")
    if check is not None:
        half = len(digits) // 2
        keys += [f"a{len(digits)} {digits[:half]}", f"b{len(digits)} {digits[half:]}"]
    mail = re.match(r"([A-Za-z0-9._%+-]+)(?:@|[\[({]at[\])}])([A-Za-z0-9-]+[A-Za-z0-9.-]*)", w)
    if mail and len(mail[1]) > 2:
        keys += [f"l{mail[1].lower()}", f"m{mail[2].lower()}"]
    elif "." in w or digits:
        keys += [f"l{w.lower()}", f"m{w.lower()}"] if MATCHES[18](w) and not numeric and len(w) > 2 else []
    return tuple(own), digits, numeric and len(w) < 24, tuple(keys)


def chains(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Places of the words worth looking at, their features, and the chain and skip edges between them."""
    hits = [m.start() for m in HIT.finditer(text)]
    if not hits:
        return [], [], [], []
    words = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in words]
    core = sorted({bisect_right(starts, h) - 1 for h in hits})
    chosen = sorted({j for i in core for j in range(max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1))})
    at = {j: n for n, j in enumerate(chosen)}
    facts = {j: seen(text[words[j][0] : words[j][1]]) for i in chosen for j in (i - 1, i, i + 1) if 0 <= j < len(words)}
    none: tuple[int, ...] = (N_WORD,)  # there is no such word
    features = [[x + o * (N_WORD + 1) for o, k in enumerate((j, j - 1, j + 1)) for x in (facts[k][0] if k in facts else none)] for j in chosen]
    chain = [(at[j], at[j + 1]) for j in chosen if j + 1 in at]
    skip: set[tuple[int, int]] = set()
    last: dict[tuple[str, int], int] = {}

    def tie(key: tuple[str, int], n: int) -> None:
        if key in last and last[key] != n:
            skip.add((last[key], n))
        last[key] = n

    run_at = 3 * (N_WORD + 1)
    i = 0
    while i < len(chosen):
        for key in facts[chosen[i]][3]:
            tie((key, 0), i)
        j = i
        while j < len(chosen) and chosen[j] - chosen[i] == j - i and facts[chosen[j]][2]:
            j += 1
        if j > i:  # a run of numbers side by side
            for n in range(i + 1, j):
                for key in facts[chosen[n]][3]:
                    tie((key, 0), n)
            digits = "".join(facts[chosen[n]][1] for n in range(i, j))
            long = 13 <= len(digits) <= 19 and j - i > 1
            shared = [run_at + bisect_right(COUNTS, len(digits)) - 1] + [run_at + len(COUNTS) + k for k, f in enumerate((j - i > 1, long and luhn(digits), long and not luhn(digits))) if f]
            for n in range(i, j):
                features[n] += shared
            features[i].append(run_at + len(COUNTS) + 3)
            features[j - 1].append(run_at + len(COUNTS) + 4)
            if 7 <= len(digits) <= 40:
                tie((f"d{digits[-10:]}", 0), i)
                tie((f"d{digits[-10:]}", 1), j - 1)
        i = max(j, i + 1)
    places = [words[j] for j in chosen]
    return places, features, chain, sorted(skip - set(chain))


def labelled(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each word by the spans: -1 for none, else the first or a later word of a kind."""
    out = np.full(len(places), -1)
    ends = [b for _, b in places]
    for kind, start, end in reversed(spans):
        i = bisect_right(ends, start)
        first = True
        while i < len(places) and places[i][0] < end:
            out[i] = 1 + 2 * kind + (not first)
            first = False
            i += 1
    return out


# fitting


def _rewritten(kind: int, span: str, rng: random.Random) -> list[tuple[str, bool]]:
    """Other ways of writing what a span says, and whether one can tell it by itself; else only its likeness to the span tells it."""
    digits = NOT_DIGIT.sub("", span)
    if kind == 0:
        local, domain = span.split("@")
        if rng.random() < 0.5:  # names and hosts of another make
            name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
            local = rng.choice((name(), f"{name()}.{name()}", f"{name()}_{rng.randint(1, 99)}"))
            domain = ".".join([name() for _ in range(rng.randint(1, 2))] + [rng.choice(("com", "org", "net", "de", "fr", "es", "io", "edu"))])
            span = f"{local}@{domain}"
        spelled = domain.replace(".", " dot ")
        return [(f"{local} at {domain}", True), (f"{local} [at] {domain}", True), (f"{local}[at]{domain}", True), (f"{local}(at){domain}", True), (f"{local} at {spelled}", True), (f"{local} (at) {domain.replace('.', ' (dot) ')}", True)]
    if kind == 1:
        return [(span.replace(".", x), alone) for x, alone in (("[.]", True), ("(dot)", True), ("-", False))]
    i = rng.randrange(len(digits))
    mistaken = digits[:i] + str((int(digits[i]) + rng.randrange(1, 10)) % 10) + digits[i + 1 :]
    if kind == 2:
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return [(mistaken, False), (".".join(fours), True), ("-".join(mistaken[k : k + 4] for k in range(0, len(digits), 4)), False)]
    area, middle, line = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [(f"({area}) {middle}-{line}", True), (f"{digits[:-10] or 1} ({area}) {middle}-{line}", True), (f"{area}-{middle}-{line}", True), (f"{area}.{middle}.{line}", True), (digits[-10:], False), (digits, False)]


def _other_numbers(rng: random.Random) -> str:
    """Numbers and names that are no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    made = (
        lambda: f"{rng.randint(1000, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 31):02d}", lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02d}", lambda: f"{n(3)}.{n(2)}", lambda: str(rng.randint(1, 3000)), lambda: n(rng.randint(5, 12)),
        lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 32, 40)))), lambda: f"{n(3)}-{n(4)}", lambda: f"at {rng.randint(1, 99)}", lambda: f"@{rng.choice(('anna', 'news', 'x1'))}",
        lambda: f"at {rng.choice(('home', 'www.example.org', 'the end'))}", lambda: f"{n(4)} {n(4)}", lambda: f"{n(2)}/{n(2)}/{n(4)}", lambda: f"({rng.randint(1, 99)})", lambda: f"{n(1)}-{n(3)}-{n(5)}-{n(1)}", lambda: f"ab{n(2)}-{n(4)}", lambda: f"{n(3)} of {n(3)}", lambda: f"({n(3)}) pages",
    )
    out = rng.choice(made)()
    if rng.random() < 0.3:
        while luhn(out := n(rng.randint(13, 19))):
            pass
    return out


def examples(samples: list[tuple[int, str, str, str]], seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Small texts and their spans: sampled windows, rewritings of their spans beside them and alone, and other numbers."""
    rng = random.Random(seed)
    plain = [" ".join(w for part in (s[1], s[3]) for w in part.split() if not HIT.search(w)) or "and so on" for s in samples]
    cards = [s[2] for s in samples if s[0] == 2]
    out = []
    for kind, before, span, after in samples:
        parts: list[tuple[str, int | None]] = [(before, None), (span, kind if kind >= 0 else None), (after, None)]
        if kind >= 0:
            ways = _rewritten(kind, span, rng)
            for way, alone in rng.sample(ways, 2):
                x, y, z = (rng.choice(plain) for _ in range(3))
                linked = [*parts, (x, None), (f"{_other_numbers(rng)} and", None), (way, kind), (z, None)]
                single = [(before, None), (way, kind if alone else None), (after, None), (_other_numbers(rng), None), (y, None), (z, None)]
                out += [linked[4:] + linked[:4] if rng.random() < 0.5 else linked, single]
            if kind == 2:  # two numbers side by side
                out += [[(before, None), (span, 2), (rng.choice(cards), 2), (after, None)], [(before, None), (str(rng.randrange(10**5)), None), (span, 2), (after, None)]]
        else:  # what repeats is not personal for that alone
            other = _other_numbers(rng)
            out += [[*parts, (other, None), *parts, (rng.choice(plain), None), (other, None)], [(before, None), (_other_numbers(rng), None), (rng.choice(plain), None), (_other_numbers(rng), None)]]
    made = []
    for parts in out:
        text, spans = "", []
        for part, kind in parts:
            if part and text:
                text += " "
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part
        made.append((text, spans))
    return made


def fit(samples: list[tuple[int, str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Weights of features, chain edges and skip edges by pseudo-likelihood: each word's label given its neighbours' labels."""
    if not any(s[0] >= 0 for s in samples):
        return None
    rows, cols, labels, left, right, ties, n = [], [], [], [], [], [], 0
    for text, spans in examples(samples):
        places, features, chain, skip = chains(text)
        y = np.maximum(labelled(places, sorted(spans)), 0)
        for i, f in enumerate(features):
            rows += [n + i] * len(f)
            cols += f
        before, after = np.full(len(places), -1), np.full(len(places), -1)
        for i, j in chain:
            before[j], after[i] = y[i], y[j]
        ties += [(n + i, KIND_OF[y[j]]) for i, j in skip] + [(n + j, KIND_OF[y[i]]) for i, j in skip]
        labels.append(y), left.append(before), right.append(after)
        n += len(places)
    x = np.zeros((n, N_FEATURES), np.float32)
    x[rows, cols] = 1
    y, prev, foll = np.concatenate(labels), np.concatenate(left), np.concatenate(right)
    kinds = 1 + len(KINDS)
    near = np.zeros((n, kinds), np.float32)
    if ties:
        np.add.at(near, tuple(np.array(ties).T), 1)
    one = lambda v, k: (v[:, None] == np.arange(k)).astype(np.float32)
    prev1, foll1, y1, group = one(prev, LABELS), one(foll, LABELS), one(y, LABELS), one(KIND_OF, kinds)
    params = [np.zeros((N_FEATURES, LABELS), np.float32), np.zeros((LABELS, LABELS), np.float32), np.zeros((kinds, kinds), np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, FIT_STEPS + 1):
        w, t, s = params
        z = x @ w + prev1 @ t + foll1 @ t.T + (near @ (s + s.T)) @ group.T
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - y1) / n
        g_kind = near.T @ (d @ group)
        grads = [x.T @ d, prev1.T @ d + (foll1.T @ d).T, g_kind + g_kind.T]
        for i, g in enumerate(grads):  # steps of Adam
            g = g + RIDGE / 100 * params[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - FIT_RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    w, t, s = (np.round(p.astype(np.float64), 5) for p in params)
    return w, t, group_pairs(s + s.T)


def group_pairs(s: np.ndarray) -> np.ndarray:
    """A table of kinds by kinds as one of labels by labels."""
    return s[KIND_OF][:, KIND_OF]


# inference


def beliefs(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, t: np.ndarray, s: np.ndarray, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """Sum-product message passing over all edges at once: rounds of damped messages, then each word's distribution of labels."""
    pairs = np.concatenate([chain, chain[:, ::-1], skip, skip[:, ::-1]])
    n, e, k = len(unary), len(chain), len(skip)
    back = np.concatenate([np.arange(e) + e, np.arange(e), np.arange(k) + 2 * e + k, np.arange(k) + 2 * e])
    source, target = pairs[:, 0], pairs[:, 1]
    parts = ((slice(0, e), np.exp(t)), (slice(e, 2 * e), np.exp(t.T)), (slice(2 * e, None), np.exp(s)))
    message = np.zeros((len(pairs), LABELS))
    node = unary.copy()
    for _ in range(rounds):
        out = node[source] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        for part, table_ in parts:
            out[part] = out[part] @ table_
        out = np.log(np.maximum(out / out.sum(1, keepdims=True), 1e-30))
        message = damping * message + (1 - damping) * out
        node = unary.copy()
        np.add.at(node, target, message)
    p = np.exp(node - node.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added(texts: list[str], bases: list[list[tuple[int, int, int]]], model) -> list[list[tuple[int, int, int]]]:
    """The spans of each text that the model finds beside the base ones, which they never touch."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    w, t, s = model
    graphs = [(d, g) for d, text in enumerate(texts) if (g := chains(text))[0]]
    if not graphs:
        return out
    sizes = [len(g[0]) for _, g in graphs]
    offset = np.cumsum([0, *sizes])
    rows = np.repeat(np.arange(offset[-1]), [len(f) for _, g in graphs for f in g[1]])
    cols = np.array([x for _, g in graphs for f in g[1] for x in f])
    unary = np.zeros((offset[-1], LABELS))
    np.add.at(unary, rows, w[cols])
    fixed = np.concatenate([labelled(g[0], bases[d]) for d, g in graphs])
    held = np.flatnonzero(fixed >= 0)
    unary[held] = -60.0
    unary[held, fixed[held]] = 0.0
    edges = [np.array([(i + o, j + o) for (_, g), o in zip(graphs, offset) for i, j in g[k]], np.int64).reshape(-1, 2) for k in (2, 3)]
    p = beliefs(unary, *edges, t, s)
    first, later = p[:, 1::2], p[:, 2::2]
    kind = np.where((first + later).max(1) >= BELIEF, (first + later).argmax(1), -1)
    begins = np.take_along_axis(first > later, np.maximum(kind, 0)[:, None], 1)[:, 0]
    follows = np.zeros(len(kind), bool)
    follows[edges[0][:, 1]] = True
    for (d, g), o in zip(graphs, offset):
        open_: list[int] | None = None  # kind, first word, last word
        found = []
        for i in range(len(g[0])):
            k = int(kind[o + i])
            if open_ and k == open_[0] and follows[o + i] and not begins[o + i]:
                open_[2] = i
                continue
            if open_:
                found.append(open_)
            open_ = [k, i, i] if k >= 0 else None
        if open_:
            found.append(open_)
        taken = sorted((a, b) for _, a, b in bases[d])
        for k, i, j in found:
            if not begins[o + i]:  # the rest of something whose beginning is not believed
                continue
            start, end = g[0][i][0], g[0][j][1]
            text = texts[d][start:end]
            inner = trim(text)
            start += text.index(inner)
            end = start + len(inner)
            at = bisect_right(taken, (end,))
            if inner and not any(b > start for _, b in taken[max(0, at - len(KINDS)) : at]):
                out[d].append((k, start, end))
    return out


def _sampled(docs: DataFrame, text_col: str, size: int) -> list[tuple[int, str, str, str]]:
    """Up to `size` distinct windows of each base kind and of none, those of the least hashes: (kind or -1, before, span, after)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found = set()
            for t in batch.column(0).to_pylist():
                if not t or not HIT.search(t):
                    continue
                spans = base_spans(t)
                taken = sorted((a, b) for _, a, b in spans)
                for k, a, b in spans:  # what lies around a span, up to the next ones
                    at = bisect_right(taken, (a, b))
                    low = max([y for x, y in taken[max(0, at - 1 - len(KINDS)) : at] if y <= a], default=0)
                    high = min([x for x, _ in taken[at : at + len(KINDS)] if x >= b], default=len(t))
                    if b - a < 4 * WINDOW:
                        found.add((k, t[max(low, a - WINDOW) : a], t[a:b], t[b : min(high, b + WINDOW)]))
                seen_to = 0
                for m in HIT.finditer(t):
                    a, b = m.span()
                    if a < seen_to:  # one window a word
                        continue
                    seen_to = WORD.match(t, a).end()
                    at = bisect_right(taken, (a, len(t)))
                    before = [y for _, y in taken[max(0, at - len(KINDS)) : at]]
                    if not any(y > a for y in before):
                        end = min([b + WINDOW, *[x for x, _ in taken[at : at + 1]]])
                        found.add((-1, t[max(a - WINDOW, max(before, default=0)) : end], "", ""))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3)]], names=["kind", "before", "span", "after"])

    windows = table(docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "kind int, before string, span string, after string").distinct())
    out = []
    for kind in range(-1, len(KINDS)):
        some = windows.where(F.col("kind") == kind).orderBy(F.xxhash64("before", "span", "after"), "before", "span", "after").limit(size)
        # whole words only: what the window cuts off is left out
        for r in some.collect():
            before, after = r["before"], r["after"]
            if kind < 0:
                out.append((kind, before.partition(" ")[2].rpartition(" ")[0], "", ""))
            else:
                out.append((kind, before.partition(" ")[2] if len(before) == WINDOW else before, r["span"], after.rpartition(" ")[0] if len(after) == WINDOW else after))
    return out


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one for each row of docs.

    The counts and base_sha256 are those of the base patterns; spans has these and the ones the field adds, by kind and
    start, in code points. Null and empty texts have none; repeated rows and null ids keep their rows; a table without
    any base span has no model and gets nothing added; an empty table gives no rows; other columns are not read. The
    fit sees at most `sample` windows of each kind. No text is shuffled.
    """
    model = fit(_sampled(docs, text_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) if HIT.search(t) else [] for t in texts]
            more = added(texts, bases, model)
            counts = [pa.array([sum(k == i for k, _, _ in b) for b in bases], pa.int64()) for i in range(len(KINDS))]
            shas = [hashlib.sha256(_text(b).encode()).hexdigest() for b in bases]
            spans = [_text(sorted(b + m)) for b, m in zip(bases, more)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kinds = ", ".join(f"n_{k} bigint" for k in KINDS)
    return narrow.mapInArrow(run, f"id {narrow.schema[0].dataType.simpleString()}, {kinds}, base_sha256 string, spans string").withColumnRenamed("id", id_col)
