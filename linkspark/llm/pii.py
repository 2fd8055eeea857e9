"""Personal data by rules and a semi-Markov conditional random field.

The rules give the base spans of each kind, leftmost and non-overlapping. The text between them is cut into tokens; the
semi-Markov model scores every segment of up to LONGEST tokens that can be an entity of some kind by features of the whole
segment and its neighbours, and dynamic programming picks the best cut into entities and single other tokens. Its entities
are added. What can be an entity is fixed by `Sequence.legal` alone, wherever it stands. A token in no such segment stands
alone in every cut, so only the stretches that hold one (`zones`) are cut in fact, with the same result. Weights come from
conditional likelihood on sequences drawn from the templates below, with a fixed seed, once on the driver; no corpus is
read.

Null texts count as empty. Whole texts of any length are searched, also digit runs and lists of numbers of any length;
the work of a text is in proportion to its length. Repeated rows get the same spans. Empty tables give empty results;
only the key and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The base patterns. A match that starts inside a run of digits would also start at its first digit.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > last and text[low - 1] in LOCAL:
            low -= 1
        m = DOMAIN.match(text, at) if low < at else None
        if m:
            out.append((low, m.end(), "email"))
            last = m.end()
        else:
            last = max(last, at + 1)  # a local part never holds an @, so none starts before this one
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGIT.findall(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# The model ----------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}(?![0-9])")
LABELS = ("other", *KINDS)
LONGEST = 21  # tokens of an entity at most
STEP = 500  # tokens whose segments are held at once
EXACT = 1 << 30  # scores are rounded to this part of one, so that sums are exact and cuts of equal score are told apart anywhere alike
AT = frozenset(("at", "arroba", "arobase", "ät"))
DOT = frozenset(("dot", "punkt", "punto", "point"))
CUES = {
    "email": frozenset("mail email e contact contacto kontakt courriel correo write".split()),
    "ip": frozenset("ip host server address adresse addr node".split()),
    "card": frozenset("card visa mastercard amex credit karte carte tarjeta kreditkarte cc".split()),
    "phone": frozenset("tel telephone phone call fax mobile telefon téléphone teléfono handy cell ring sms".split()),
}
# Frequent words that stand before or after an AT or DOT word in running text, and common top-level domains.
RUNNING = frozenset("the a an this that these those some any all each no one us him her them it me you look looked in of is to le la les un une ce cet el los las un una este der die das den dem ein eine".split())
ENDINGS = frozenset("com org net edu gov mil info biz io co de fr es it nl at ch eu uk us ca mx ar br pt pl se no dk fi be ie au nz jp in".split())
N_FEATURES = 41
SIGNS = frozenset("@._%+-()[]{}<>")  # of an address
DOTTED = r"(?:\s*(?:\.|[(\[]\s*(?:\.|dot|punkt|punto|point)\s*[)\]])\s*|\s+(?:dot|punkt|punto|point)\s+)"
PARTS = re.compile(DOTTED, re.I)


def running(flags) -> np.ndarray:
    """How many of the flags (or what sum of numbers) stand before each place."""
    return np.concatenate([[0], np.cumsum(np.asarray(flags, np.int64))])


class Sequence:
    """Tokens (start, end, text) of a text, with what the features of its segments are made of: for each property of a
    token how many tokens before it have it, so that any segment is told by two places."""

    def __init__(self, tokens: list[tuple[int, int, str]], text: str):
        said = [t for _, _, t in tokens]
        lower = [t.lower() for t in said]
        self.n, self.text, self.tokens = len(tokens), text, tokens
        self.start, self.end = (np.array([t[k] for t in tokens], np.int64) for k in (0, 1))
        number, alpha = [t.isdigit() for t in said], [t.isalpha() for t in said]
        ascii_ = [d and t.isascii() for d, t in zip(number, said, strict=True)]
        size = [len(t) for t in said]
        at, dot, word = [w in AT and a for w, a in zip(lower, alpha, strict=True)], [w in DOT and a for w, a in zip(lower, alpha, strict=True)], alpha
        self.count = {
            "digits": running([z * d for z, d in zip(size, ascii_, strict=True)]), "groups": running(number), "words": running(word),
            "barred": running([not (d or t in "()+-./") for d, t in zip(number, said, strict=True)]),
            "long": running([d and z > 4 for d, z in zip(number, size, strict=True)]), "four": running([d and z == 4 for d, z in zip(number, size, strict=True)]),
            "wide": running([d and z > 3 for d, z in zip(number, size, strict=True)]),
            "at": running([x or t == "@" for x, t in zip(at, said, strict=True)]), "dot": running([x or t == "." for x, t in zip(dot, said, strict=True)]),
            "open": running([t == "(" for t in said]), "close": running([t == ")" for t in said]), "slash": running([t == "/" for t in said]),
            "plain": running([a and not (x or y) for a, x, y in zip(word, at, dot, strict=True)]),
            "running": running([a and w in RUNNING for a, w in zip(word, lower, strict=True)]),
        }
        flag = lambda it: np.array(list(it), bool)
        self.alnum, self.number = flag(t[0].isalnum() for t in said), flag(number)
        self.starts_off = flag(w in AT or w == "@" for w in lower)
        self.ends_off = flag(w in AT or w in DOT or w in "@." for w in lower)
        self.opens = flag(t in "(+" for t in said)
        self.ending = flag(a and w in ENDINGS for a, w in zip(word, lower, strict=True))
        self.run_word, self.of = flag(a and w in RUNNING for a, w in zip(word, lower, strict=True)), flag(w == "of" for w in lower)
        self.last_word = np.maximum.accumulate(np.where(flag(word), np.arange(self.n), -1))
        cue = np.stack([running([w in CUES[kind] for w in lower]) for kind in KINDS])
        here = np.arange(self.n)
        self.cue = cue[:, here] > cue[:, np.maximum(here - 3, 0)]
        touch = self.start[1:] == self.end[:-1]
        self.after = np.append(False, touch & flag(t.isalnum() or t in "@.-+_$€£#" for t in said[:-1]))
        self.before = np.append(touch & flag(t.isalnum() or t in "@-+_%€$:" for t in said[1:]), False)
        groups = [t for t, d in zip(tokens, number, strict=True) if d]
        between = {}
        kinds = [between.setdefault(text[a[1]:b[0]], len(between)) for a, b in zip(groups, groups[1:])]
        self.turns = running([a != b for a, b in zip(kinds, kinds[1:])] + [0, 0, 0])
        self.sizes = np.array([len(t) for _, _, t in groups] + [0] * 4, np.int64)
        self.one = np.array([t == "1" for _, _, t in groups] + [False] * 4, bool)
        gap = running([ch in " \n" for ch in text])
        self.gap = gap[self.start], gap[self.end]
        dates = [(m.end() if (m := DATE.match(text, a)) else -1) if d else -1 for (a, _, _), d in zip(tokens, ascii_, strict=True)]
        self.date = np.array(dates, np.int64)
        digits = np.array([int(ch) for t, d in zip(said, ascii_, strict=True) if d for ch in t], np.int64)
        twice = np.where(digits > 4, 2 * digits - 9, 2 * digits)
        even = np.arange(len(digits)) % 2 == 0
        self.luhn = [(running(np.where(even == keep, digits, 0)), running(np.where(even == keep, 0, twice))) for keep in (False, True)]
        # For legal()
        is_at, is_dot = (np.diff(self.count[k]) > 0 for k in ("at", "dot"))
        self.ascii, self.plain = flag(ascii_), self.alnum & ~is_at & ~is_dot
        self.goes_on = np.append(touch & flag(t[0].isalnum() or t[0] == "_" for t in said[1:]), False)
        self.letters = running([t[0].isalnum() and not t[0].isdecimal() for t in said])
        aside = np.append(False, ~touch)  # white space before it
        stop = flag(t == "." for t in said) & ~aside & np.append(aside[1:], False)
        self.broken = running(stop | flag(not (a or t in SIGNS) for t, a in zip(said, self.alnum.tolist(), strict=True)))
        self.beside = running(aside & self.plain & np.append(False, self.plain[:-1]))
        here = np.arange(self.n)
        self.last_at = np.maximum.accumulate(np.where(is_at, here, -1))
        firm = self.plain | is_at | is_dot
        after = np.append(np.minimum.accumulate(np.where(firm, here, self.n)[::-1])[::-1][1:], self.n)
        before = np.append(-1, np.maximum.accumulate(np.where(firm, here, -1))[:-1])
        held = np.append(self.plain, False)  # also at -1
        self.joins = is_at & held[after] & held[before]

    def quads(self, i: np.ndarray, last: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Which of the segments from token i to token last that may be one are four parts of up to 255 with a DOT between them."""
        out = may & self.number[i] & self.number[last]
        for k in np.flatnonzero(out).tolist():
            parts = PARTS.split(self.text[self.start[i[k]]:self.end[last[k]]])
            out[k] = len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
        return out

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the segments from token i to token j (exclusive), one row each."""
        c = {k: v[j] - v[i] for k, v in self.count.items()}
        n, last = c["digits"], j - 1
        f = np.zeros((len(i), N_FEATURES))
        solid = self.gap[1][last] == self.gap[0][i]
        allowed = c["barred"] == 0
        low, high = self.count["digits"][i], self.count["digits"][j]
        odd = (high - 1) % 2 == 0  # the last digit and each second one before it count once
        total = np.where(odd, *(sum(x[high] - x[low] for x in self.luhn[k]) for k in (1, 0)))
        card = (n >= 13) & (n <= 19)
        quad = self.quads(i, last, (c["groups"] == 4) & (c["wide"] == 0))
        f[:, 0], f[:, 1], f[:, 2] = 1, j - i == 1, (j - i) / LONGEST
        for k, (x, y) in enumerate(((0, 0), (1, 6), (7, 9), (10, 11), (12, 13), (14, 19))):
            f[:, 3 + k] = (n >= x) & (n <= y)
        f[:, 9], f[:, 10], f[:, 11] = n > 19, c["words"] > 0, allowed
        f[:, 12], f[:, 13] = card & (total % 10 == 0), card & (total % 10 != 0)
        f[:, 14], f[:, 15] = quad, quad & solid
        f[:, 16], f[:, 17] = c["at"] > 0, c["dot"] > 0
        f[:, 18] = (c["at"] > 0) & (c["dot"] > 0) & self.alnum[i] & self.alnum[last]
        f[:, 19] = (c["at"] == 1) & ~self.starts_off[i] & ~self.ends_off[last]
        f[:, 20] = self.opens[i]
        f[:, 21] = allowed & (c["groups"] >= 3) & (c["groups"] <= 4) & (c["long"] == 0) & (n >= 9) & (n <= 11)
        f[:, 22] = allowed & (c["groups"] == 4) & (c["four"] == 4)
        f[:, 23] = c["groups"] == 1
        f[:, 24:28] = self.cue[:, i].T
        f[:, 28], f[:, 29], f[:, 30] = self.after[i], self.before[last], ~self.alnum[last]
        f[:, 31], f[:, 32] = c["slash"] > 0, f[:, 21].astype(bool) & (c["open"] > 0) & (c["close"] > 0)
        f[:, 33] = (n >= 7) & (c["plain"] > 0)
        f[:, 34] = (self.date[i] >= 0) & (self.date[i] <= self.end[last])
        f[:, 35] = f[:, 18].astype(bool) & self.ending[last]
        word = self.last_word[last]
        held = word >= i
        f[:, 36] = (c["running"] - (held & self.run_word[word]) > 0) | held & self.of[word]
        a, b = self.count["groups"][i], self.count["groups"][j]
        long_one = (b - a == 4) & self.one[a]
        at = np.minimum(a + long_one, len(self.sizes) - 3)
        shape = allowed & (b - at == 3) & (self.sizes[at] == 3) & (self.sizes[at + 1] == 3) & (self.sizes[at + 2] == 4)
        f[:, 37], f[:, 38] = shape & ~long_one, shape & long_one
        f[:, 39] = (b - a >= 3) & (self.turns[np.maximum(b - 2, a)] == self.turns[a])  # one kind of separator throughout
        f[:, 40] = ~self.alnum[i] & ~self.opens[i]
        return f


    def legal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which KINDS the segments from token i to token j (exclusive) can be. None goes on as a word. A card or phone number
        has 13 to 19 or 7 to 15 digits, no letter, and starts with a digit, ( or +. An ip has four parts of up to 255 with a
        DOT between them. An address is name, AT and domain with a DOT, of words joined by SIGNS, AT or DOT (no two words with
        just white space between them), without the full stop of a sentence."""
        c, last = {k: self.count[k][j] - self.count[k][i] for k in ("digits", "groups", "wide", "at", "dot")}, j - 1
        n = c["digits"]
        number = (self.letters[j] == self.letters[i]) & (self.ascii[i] | self.opens[i]) & self.ascii[last]
        at = self.last_at[last]
        address = (c["at"] == 1) & self.plain[i] & self.plain[last] & (self.broken[j] == self.broken[i]) & (self.beside[j] == self.beside[i + 1])
        address &= self.joins[at] & (self.count["dot"][j] > self.count["dot"][at + 1])
        quad = self.quads(i, last, (c["groups"] == 4) & (c["wide"] == 0) & (c["dot"] == 3))
        out = np.stack([address, quad, number & (n >= 13) & (n <= 19), number & (n >= 7) & (n <= 15)], axis=1)
        out[self.goes_on[last]] = False
        return out


def segments(first: int, past: int, low: int = 1, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All segments of the tokens from first to past whose end is the low-th to high-th token, by end, then start."""
    j = np.arange(first + low, first + (past - first if high is None else high) + 1)
    sizes = np.minimum(j - first, LONGEST)
    ends = np.repeat(j, sizes)
    return ends - np.repeat(sizes, sizes) + (np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes)), ends


def score(i: np.ndarray, j: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = x @ w
    out[j - i > 1, 0] = -np.inf  # other tokens stand alone
    return out


def gradient(i: np.ndarray, j: np.ndarray, x: np.ndarray, gold: list[tuple[int, int, int]], w: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of the gold segments (first, past, label) of a whole sequence: observed less expected features."""
    s = score(i, j, x, w)
    best = np.logaddexp.reduce(s, axis=1)
    n = int(j[-1])
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0
    ends = np.searchsorted(j, np.arange(1, n + 2))
    for k in range(1, n + 1):
        own = slice(ends[k - 1], ends[k])
        forward[k] = np.logaddexp.reduce(forward[i[own]] + best[own])
    order = np.argsort(i, kind="stable")
    starts = np.searchsorted(i[order], np.arange(n + 1))
    for k in range(n - 1, -1, -1):
        own = order[starts[k]:starts[k + 1]]
        backward[k] = np.logaddexp.reduce(backward[j[own]] + best[own])
    p = np.exp(forward[i, None] + s + backward[j, None] - forward[n])
    seen = np.zeros_like(p)
    for a, b, label in gold:
        seen[ends[b - 1] + np.searchsorted(i[ends[b - 1]:ends[b]], a), label] = 1
    return x.T @ (seen - p)


def decode(tokens: list, text: str, w: np.ndarray, first: int = 0, past: int | None = None, legal: bool = False) -> list[tuple[int, int, str]]:
    """Best cut of the tokens from first to past; the others are context. The entities, as (start, end, kind). With `legal`
    only those that can be of their kind."""
    past = len(tokens) if past is None else past
    return entities(tokens, first, best_cuts(tokens, text, w, first, past, legal), past - first)


def best_cuts(tokens: list, text: str, w: np.ndarray, first: int, past: int, legal: bool) -> list[tuple[int, int]]:
    """For each number of tokens from first on, the start and label of the last segment of their best cut."""
    n, sequence = past - first, Sequence(tokens, text)
    best, back = np.full(n + 1, -np.inf), [(0, 0)] * (n + 1)
    best[0] = 0
    for low in range(1, n + 1, STEP):
        i, j = segments(first, past, low, min(n, low + STEP - 1))
        if legal:
            can = sequence.legal(i, j)
            kept = can.any(axis=1) | (j - i == 1)
            i, j, can = i[kept], j[kept], can[kept]
        s = np.rint(score(i, j, sequence.features(i, j), w) * EXACT) / EXACT
        if legal:
            s[:, 1:][~can] = -np.inf
        label, value, i = s.argmax(axis=1), s.max(axis=1), i - first
        ends = np.searchsorted(j - first, np.arange(low, min(n, low + STEP - 1) + 2))
        for k in range(low, min(n, low + STEP - 1) + 1):
            a, b = ends[k - low], ends[k - low + 1]
            reached = best[i[a:b]] + value[a:b]
            top = int(reached.argmax())
            best[k], back[k] = reached[top], (int(i[a + top]), int(label[a + top]))
    return back


def shared(back: list[tuple[int, int]]) -> int:
    """The last place that the best cuts of all later tokens have in common, whatever these are."""
    places = set(range(max(0, len(back) - LONGEST), len(back)))
    while len(places) > 1:
        top = max(places)
        places = places - {top} | {back[top][0]}
    return places.pop()


def entities(tokens: list, first: int, back: list[tuple[int, int]], k: int) -> list[tuple[int, int, str]]:
    """Those of the best cut of k tokens from first on."""
    out = []
    while k:
        i, kind = back[k]
        if kind:
            out.append((tokens[first + i][0], tokens[first + k - 1][1], LABELS[kind]))
        k = i
    return out[::-1]


PHONES = ("({}) {}-{}", "({}){}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "{}/{}-{}", "({}) {} {}", "1-{}-{}-{}", "1 ({}) {}-{}", "1.{}.{}.{}", "+1 {} {} {}", "+1 ({}) {}-{}")
SYLLABLES = ("an", "er", "tion", "que", "ca", "le", "sch", "o", "ri", "ma", "bel", "ton", "ü", "né", "st")


def example(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence drawn from templates, and its entities."""
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def word() -> str:
        said = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))
        return r.choice((said, said, said, said.capitalize()))

    def name() -> str:
        return "".join(r.choice(SYLLABLES[:-3]) for _ in range(r.randint(1, 3)))

    def card() -> str:
        body = num(r.choice((14, 15, 15, 15)))
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        sep = r.choice(("", " ", "-", ".", "/"))
        cut = (4, 6, 5) if len(whole) == 15 and r.random() < 0.5 else (4, 4, 4, 4)
        return sep.join(whole[sum(cut[:k]):sum(cut[:k + 1])] for k in range(len(cut))) if sep else whole

    def entity(kind: str) -> str:
        if kind == "email":
            at = r.choice((" at ", " (at) ", "(at)", " [at] ", "[at]", " @ ", "@", " AT ", " arroba ", " arobase ", " (arroba) ", " ät "))
            dot = r.choice((" dot ", ".", " (dot) ", "(dot)", " [dot] ", ".", " DOT ", " punto ", " punkt ", " point "))
            return name() + r.choice(("", num(2), "." + name(), "_" + name(), dot + name())) + at + name() + r.choice(("", "", "-" + name(), dot + name())) + dot + r.choice(("com", "com", "org", "net", "edu", "gov", "io", "co", "de", "es", "fr", "uk", "eu", "ch"))
        if kind == "ip":
            return r.choice((" . ", "(dot)", " (dot) ", ".", ".", " dot ", "[dot]", "[.]", "(.)", " punto ")).join(str(r.choice((r.randint(0, 255), r.randint(0, 9)))) for _ in range(4))
        if kind == "card":
            return card()
        return r.choice(PHONES).format(num(3), num(3), num(4))

    def other() -> str:
        return r.choice((
            word, word, word, word, lambda: f"{word()} {word()}, {word()}", lambda: num(r.randint(1, 5)), lambda: f"{num(4)}-{num(2)}-{num(2)}",
            lambda: f"{r.choice((19, 20))}{num(2)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", lambda: f"{num(2)}.{num(2)}.20{num(2)} {num(2)}.{num(2)}",
            lambda: f"{num(2)}/{num(2)}/{r.choice((19, 20))}{num(2)}", lambda: f"{num(1)}.{num(1)}", lambda: f"{num(3)},{num(3)},{num(3)}", lambda: num(r.randint(20, 30)),
            lambda: f"v{num(1)}.{num(2)}.{num(1)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: "look at " + word() + ".",
            lambda: f"{word()} at the {r.choice(('point', 'dot'))} of {word()}", lambda: f"{word()} at {r.choice(('this', 'that', 'some', 'any', 'the'))} point in {word()}",
            lambda: f"{word()} at {r.choice(('this', 'that', 'some', 'any', 'the', 'a', 'one'))} {r.choice(('point', 'dot'))} {r.choice(('in', 'it', 'is', 'no', 'of', 'at', 'us'))} {word()}",
            lambda: f"look at {word()}. {word()}", lambda: f"{word()} at {word()} point {word()}", lambda: f"{word()} at {word()}. {word()}",
            lambda: f"{word()} at {num(2)}.{num(2)}", lambda: f"#{num(8)}", lambda: num(8), lambda: f"page {num(3)}-{num(3)}", lambda: f"{num(2)} {num(2)} {num(2)} {num(2)}",
            lambda: next(x for x in iter(lambda: num(16), None) if not luhn(x)), lambda: f"{num(3)}.{num(3)}.{r.randint(256, 999)}.{num(2)}",
            lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"${num(7)}.{num(2)}", lambda: f"{num(3)} {num(3)} {num(3)} {num(3)} {num(3)} {num(3)} {num(3)}",
            lambda: " ".join(num(r.choice((2, 5))) for _ in range(r.randint(3, 6))), lambda: f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}"))()

    text, spans = "", []
    for _ in range(r.randint(2, 4)):
        if r.random() < 0.45:
            kind = r.choice(KINDS)
            text += f"{r.choice(sorted(CUES[kind]))}{r.choice((':', ''))} " if r.random() < 0.4 else ""
            for k in range(r.choice((1, 1, 1, 2))):  # numbers also come in lists
                said = entity(kind)
                text += (r.choice((" ", ", ", " or ", " / ")) if kind in ("phone", "card") else ", ") if k else ""
                spans.append((len(text), len(text) + len(said), kind))
                text += said
        else:
            text += other()
        text += r.choice((" ", " ", ", ", ". "))
    return text, spans


def drawn(examples: int, seed: int):
    """Sequences from the templates: tokens, text and gold segments (first, past, label)."""
    r, n = random.Random(seed), 0
    while n < examples:
        text, spans = example(r)
        tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
        first, past = {t[0]: k for k, t in enumerate(tokens)}, {t[1]: k + 1 for k, t in enumerate(tokens)}
        if any(a not in first or b not in past or past[b] - first[a] > LONGEST for a, b, _ in spans):
            continue
        gold = [(first[a], past[b], LABELS.index(k)) for a, b, k in spans]
        held = {k for i, j, _ in gold for k in range(i, j)}
        yield tokens, text, gold + [(k, k + 1, 0) for k in range(len(tokens)) if k not in held]
        n += 1


@cache
def weights(examples: int = 800, epochs: int = 6, seed: int = 11) -> np.ndarray:
    """Trained once in a process (about two seconds); features x labels."""
    r, held = random.Random(seed), []
    for tokens, text, gold in drawn(examples, seed):
        i, j = segments(0, len(tokens))
        held.append((i, j, Sequence(tokens, text).features(i, j), gold))
    w = np.zeros((N_FEATURES, len(LABELS)))
    pace = np.full_like(w, 1e-6)
    for _ in range(epochs):
        r.shuffle(held)
        for i, j, x, gold in held:
            g = gradient(i, j, x, gold, w) - 0.002 * w
            pace += g * g
            w += 0.5 * g / np.sqrt(pace)
    return w


# Each segment that can be an entity lies in one of these: a stretch without letters from a digit, ( or + on, a chain of
# numbers with a DOT between them, or what is joined on to an AT (chain()).
RUN = re.compile(r"[0-9(+][\W\d_]{6,}+")
QUAD = re.compile(rf"(?<!\d)\d++(?:{DOTTED}\d++){{3,}}+", re.I)
ATS = re.compile(r"[@aAäÄ](?:(?<=@)|(?<![^\W\d_].)(?:(?<=[aA])(?:[tT]|(?i:rroba|robase))|(?<=[äÄ])[tT])(?![^\W\d_]))", re.S)
LETTER = re.compile(r"[^\W\d_]")
MARGIN = 40  # characters of context after a stretch; stretches no further apart are cut as one
CONTEXT = 4  # tokens of context before it
CHUNK = 100_000  # characters of a stretch that are cut at once; what later ones can't change is then settled


def gaps(base: list[tuple[int, int, str]], n: int):
    """Stretches of a text of n characters outside the base spans."""
    at = 0
    for s, e, _ in base:
        if s > at:
            yield at, s
        at = max(at, e)
    if n > at:
        yield at, n


def token_before(text: str, at: int, low: int) -> int:
    """Start of the token that ends before `at`, no less than low; -1 if there is none."""
    at -= 1
    while at >= low and text[at].isspace():
        at -= 1
    if at < low:
        return -1
    same = LETTER.match if LETTER.match(text[at]) else DIGIT.match if DIGIT.match(text[at]) else None
    while same and at > low and same(text[at - 1]):
        at -= 1
    return at


def chain(text: str, at: int, end: int, low: int, high: int) -> tuple[int, int] | None:
    """The stretch between low and high with each address whose AT stands from `at` to `end`; None if there is no such."""
    dotted, past, last, plain = False, -1, end, False
    for k, m in enumerate(TOKEN.finditer(text, end, high)):
        said, alnum = m[0], m[0][0].isalnum()
        known = alnum and said.lower()
        dot = said == "." or known in DOT
        if k == LONGEST or said == "@" or known in AT or not (alnum or said in SIGNS) or dot and past < 0 and not plain:
            break
        if said == "." and last == m.start() and text[m.end():m.end() + 1].isspace():
            break
        if alnum and not dot:
            if plain and last < m.start() and solid:
                break
            past = m.end() if dotted else past
        plain, dotted, solid, last = plain or alnum and not dot, dotted or dot, alnum and not dot, m.end()
    if past < 0:
        return None
    first, behind, solid = -1, at, False
    for _ in range(LONGEST):
        start = token_before(text, behind, low)
        if start < 0:
            break
        said = TOKEN.match(text, start, behind)[0]
        alnum = said[0].isalnum()
        known = alnum and said.lower()
        if said == "@" or known in AT or not (alnum or said in SIGNS):
            break
        word = alnum and known not in DOT
        if word:
            if solid and start + len(said) < behind:
                break
            first = start
        solid, behind = word, start
    return None if first < 0 else (first, past)


def zones(text: str, base: list[tuple[int, int, str]]) -> list[list[int]]:
    """Stretches outside the base spans that hold each segment that can be an entity, those near each other as one."""
    out: list[list[int]] = []
    digits, ats = DIGIT.search(text), ATS.search(text)
    for low, high in gaps(base, len(text)) if digits or ats else ():
        found: list[tuple[int, int]] = []
        if digits:
            found += (m.span() for m in RUN.finditer(text, low, high) if len(DIGIT.findall(m[0])) >= 7)
            found += (m.span() for m in QUAD.finditer(text, low, high))
        if ats:
            found += filter(None, (chain(text, m.start(), m.end(), low, high) for m in ATS.finditer(text, low, high)))
        own: list[list[int]] = []
        for a, b in sorted(found):
            if own and a <= own[-1][1] + MARGIN:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
        out += own
    return out


def found_spans(text: str, base: list[tuple[int, int, str]], w: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """Entities of the model that don't meet a base span: those of the best cut of all tokens outside the base spans."""
    w = weights() if w is None else w
    out: list[tuple[int, int, str]] = []
    for a, b in zones(text, base):
        size = CHUNK
        while a < b:
            low, stop = a, min(b, a + size)
            for _ in range(CONTEXT):
                start = token_before(text, low, 0)
                low = low if start < 0 else start
            part = text[low:stop + MARGIN]
            tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(part)]
            first = next((i for i, t in enumerate(tokens) if t[0] >= a - low), len(tokens))
            past = max((i for i, t in enumerate(tokens) if t[1] <= stop - low), default=-1) + 1
            back = best_cuts(tokens, part, w, first, past, True) if past > first else [(0, 0)]
            k = len(back) - 1 if stop == b else shared(back)
            out += [(s + low, e + low, kind) for s, e, kind in entities(tokens, first, back, k)]
            a, size = (b, size) if stop == b else (tokens[first + k - 1][1] + low, CHUNK) if k else (a, 2 * size)
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The op2 contract: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all)."""
    rows, w = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), weights()

    def run(batches):
        for big in batches:
            for b in slices(big, "text", 8_000_000):
                texts = [t or "" for t in b.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                every = [s + found_spans(t, s, w) for t, s in zip(texts, base, strict=True)]
                n = [pa.array([sum(k == kind for _, _, k in s) for s in base], pa.int64()) for kind in KINDS]
                digests = [hashlib.sha256(joined(s).encode()).hexdigest() for s in base]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *n, pa.array(digests, pa.string()), pa.array([joined(s) for s in every], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    ddl = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ddl}, base_sha256 string, spans string")
