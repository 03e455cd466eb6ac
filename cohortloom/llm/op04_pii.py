"""Personal data and secrets by a semi-Markov conditional random field.

Segments of at most MAX_TOKENS tokens are scored as wholes: their shape, length, digit count, checksum, octet range,
character spread, key words and the word before are features of the span, not of its tokens. Dynamic programming
over segments of bounded length chooses boundaries and types together; neighbouring entities have transition
weights. The weights are fitted here by maximum likelihood (forward-backward over segments) on invented examples.

Words (between blanks) are candidates if they have a digit, "@" or "=", touch an "=" word, have or follow a key word such as
"password", begin like an access key, or are groups of at most four capitals behind a candidate, as in IBANs. Texts fall
apart into runs of such words, cut at signs and changes of script, and runs are decoded one by one: the result is the
optimum over the candidates, all other words being outside by rule. A secret of letters alone that no key word precedes
and that begins like none is not a candidate, nor is one of several words without "=" or quotes.

Defined cases: null and empty texts and texts without such words have no rows; whole texts are read, a run of
any length is decoded in time linear in its length; repeated rows have rows each; an empty table gives none; other
columns are never looked at. start and end count characters (code points).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "secret")
#: Tokens of the longest legal form of each kind: name, sign and domain in another script, a country code, (0) and 13 digits by twos, 19 digits of a card
#: by fours, 34 characters of an IBAN by fours, name = "value".
LONGEST = {"email": 7, "phone": 11, "ip": 1, "card": 5, "iban": 9, "ssn": 3, "secret": 5}
MAX_TOKENS = max(LONGEST.values())
#: No legal form but a secret's is longer (e-mail addresses: 64 + 1 + 255).
LONGEST_CHARS = 320
_TRIGGER = re.compile(r"[0-9@=]")
_OPEN = re.compile(r"[0-9@=]|(?P<key>(?i:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential)s?(?![^\W_]))|(?<![^\W_])(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|AIza|eyJ)")
_BEHIND = re.compile(r"(?:\s+[:=]+(?!\S))?\s+\S+")
_LATIN = r"0-9A-Za-z_\u00c0-\u024f"
_GROUP = re.compile(rf"\s+[A-Z]{{1,4}}(?![{_LATIN}_])")
#: Words of one script with the signs that are inside entities; every other sign is a token.
_TOKEN = re.compile(rf"\+?[{_LATIN}][{_LATIN}.@%+-]*|[^\W{_LATIN}]+|[^\w\s]")
_SOFT = frozenset("=:/.@%+-#$!*~^\\_")
#: What spans of several tokens without an assignment look like: numbers, IBANs, addresses in another script.
_SEVERAL = re.compile(rf"[\d ()./+-]+|[A-Za-z]{{2}}\d{{2}}[A-Za-z0-9 ]+|[\w.+%-]*[^\W{_LATIN}][\w.+%-]*@?[\w.-]*|[\w.+%-]+@[\w.-]*[^\W{_LATIN}][\w.-]*")
_KEYWORD = re.compile(r"(?i)(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential)s?$")
_SECRET_PREFIX = re.compile(r"AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|AIza|eyJ")


def tokens_of_run(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]


def runs(text: str):
    """Yields (tokens as (start, end), word before) of the maximal runs of tokens that can be in entities."""
    spans: list[list[int]] = []
    at, n = 0, len(text)
    while True:
        m = _OPEN.search(text, at)
        if not m:
            break
        s = m.start()
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        e = m.end()
        while e < n and not text[e].isspace():
            e += 1
        at = e
        token = text[s:e]
        if token.startswith("=") or token.endswith("="):
            if token.startswith("="):
                k = s
                while k > 0 and text[k - 1].isspace():
                    k -= 1
                while k > 0 and not text[k - 1].isspace():
                    k -= 1
                s = k
        if token.endswith("=") or _KEYWORD.search(token.rstrip("\"'`:;,.)]>*")):
            behind = _BEHIND.match(text, e)
            e = behind.end() if behind else e
        while m := _GROUP.match(text, e):
            e = m.end()
            while e < n and not text[e].isspace():
                e += 1
        if spans and not text[spans[-1][1] : s].strip():
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
        at = max(at, spans[-1][1])
    for s, e in spans:
        k = s
        while k > 0 and text[k - 1].isspace():
            k -= 1
        b = k
        while b > 0 and k - b < 40 and not text[b - 1].isspace():
            b -= 1
        yield tokens_of_run(text, s, e), text[b:k].lower().strip(".,;:!?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def shape(s: str) -> str:
    """Digits as 9, letters as a, runs as one."""
    return re.sub(r"a+", "a", re.sub(r"9+", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", s))))[:24]


def trimmed(s: str) -> str:
    """Without the signs at its end; a quote stays where the span holds an assignment."""
    n = len(s)
    while n and not (s[n - 1].isalnum() or s[n - 1] in '_"'):  # a regular expression would try every sign within
        n -= 1
    s = s[:n]
    return s if "=" in s else s.rstrip('"')


def features(s: str, before: str, n_tokens: int) -> list[str]:
    """The features of a whole span (already trimmed)."""
    digits = re.sub(r"\D", "", s)
    s = s if s != s.upper() or _SECRET_PREFIX.match(s) else s.lower() if "@" in s or "=" in s else s
    f = ["bias", f"tokens={n_tokens}", f"shape={shape(s)}", f"digits={min(len(digits), 20)}", f"long={min(len(s) // 8, 6)}"]
    if "@" in s:
        f.append("at=" + str(bool(re.fullmatch(r"[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{2,}", s))))
    octets = s.split(".")
    if len(octets) == 4 and all(o.isdecimal() for o in octets):
        f.append("octets=" + str(all(len(o) < 4 and int(o) < 256 for o in octets)))
    if re.fullmatch(r"[\d -]+", s) and 13 <= len(digits) <= 19:
        f += [f"luhn={luhn(digits)}", f"issuer={digits[0]}"]
    if re.fullmatch(r"\+?[\d ().-]+", s):
        f += [f"dial={s[0] == '+'}", f"zero={s[0] == '0'}", f"dialled={7 <= len(digits) <= 15}", "groups=" + "-".join(map(str, map(len, re.findall(r"\d+", s)[:6])))]
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9 ]{10,38}", s):
        number = "".join(str(int(c, 36)) for c in (s[4:] + s[:4]).replace(" ", ""))
        f.append(f"mod97={int(number) % 97 == 1}")
    run = max(re.findall(r"[A-Za-z0-9_+/-]+", s), key=len, default="")
    if len(run) >= 12:
        f += [f"run={min(len(run) // 8, 5)}", f"hex={bool(re.fullmatch(r'[0-9a-fA-F]+', run))}", f"mixed={bool(re.search('[0-9]', run)) + bool(re.search('[a-z]', run)) + bool(re.search('[A-Z]', run))}"]
        share = [n / len(run) for n in Counter(run).values()]
        f.append(f"spread={min(int(-sum(p * math.log2(p) for p in share)), 5)}")
    if _SECRET_PREFIX.match(s):
        f.append("prefix")
    if s.isascii() and s.isalpha():
        f += [f"letters={min(len(s), 16)}", f"consonants={min(max(map(len, re.findall(r'[^aeiou]+', s.lower())), default=0), 5)}"]
    head, sign, rest = s.partition("=")
    if sign:
        f += [f"keyword={bool(_KEYWORD.search(head.strip()))}", f"value={min(len(rest.strip().strip(chr(34))) // 4, 6)}", f"spaced={head.endswith(' ')}"]
    if _KEYWORD.search(before):
        f.append("after keyword")
    return f


def _units(text: str, toks: list[tuple[int, int]]) -> dict[int, set[int]]:
    """{first token: tokens after the last} of spans whose inner signs don't matter: from a word's start to its end and, after a "=",
    to the ends of the next words; between two signs that end values, and after the first "=" or ":" in there; within quotes, with
    the name before. Starts and ends are few for each word, so all of them are linear in the text."""
    n, out = len(toks), {}
    sign = [text[s] if e - s == 1 and not (text[s].isalnum() or text[s] == "_") else "" for s, e in toks]
    gap = [k == 0 or toks[k][0] > toks[k - 1][1] for k in range(n)] + [True]
    word_end, unit_end, quote = [n] * (n + 1), [n] * (n + 1), {}
    for k in range(n - 1, -1, -1):
        word_end[k] = k + 1 if gap[k + 1] else word_end[k + 1]
        hard = sign[k] and sign[k] not in _SOFT
        unit_end[k] = k if hard else k + 1 if gap[k + 1] else unit_end[k + 1]
    later: dict[str, int] = {}
    for k in range(n - 1, -1, -1):
        if sign[k] in ('"', "'", "`"):
            quote[k] = later.get(sign[k])
            later[sign[k]] = k
    parted = False
    for k in range(n):
        fresh = gap[k] or bool(sign[k - 1] and sign[k - 1] not in _SOFT)
        after = not fresh and sign[k - 1] in ("=", ":") and not parted
        parted = parted and not fresh or after
        ends = out.setdefault(k, set())
        if gap[k]:
            ends.add(word_end[k])
            e = word_end[k]
            if e < n and ("=" in (sign[e - 1], sign[e])):  # name = value
                for _ in range(2):
                    e = word_end[e] if e < n else e
                    ends.add(e)
        if fresh or after:
            ends.add(unit_end[k])
        if k and sign[k - 1] and quote.get(k - 1):
            ends.add(quote[k - 1])
        if k + 2 < n and sign[k + 1] == "=" and quote.get(k + 2):
            ends.add(quote[k + 2] + 1)
        for e in list(ends):
            j = e
            while j > k + 1 and sign[j - 1] and sign[j - 1] != '"':
                j -= 1
            ends.discard(e)
            if j > k:
                ends.add(j)
    return out


def segments(text: str, toks: list[tuple[int, int]], before: str) -> list[tuple[int, int, int, list[str]]]:
    """(first token, token after the last, end of the trimmed text, features) of all candidate spans of a run."""
    out, units, word, between = [], _units(text, toks), before, ""
    for i, (at, first_end) in enumerate(toks):
        first = text[at:first_end]
        ends, key = set(units[i]), bool(_KEYWORD.search(word))
        if first[0].isalnum() or first[0] in "+(_":
            assigns = i + 1 < len(toks) and text[toks[i + 1][0]] == "="
            for j in range(i + 1, min(len(toks), i + MAX_TOKENS) + 1):
                if j > i + 1 and not assigns and (toks[j - 1][1] - at > LONGEST_CHARS or not _SEVERAL.fullmatch(trimmed(text[at : toks[j - 1][1]]))):
                    break  # only an assignment can be as long or hold other signs
                ends.add(j)
        for j in sorted(ends):
            s = trimmed(text[at : toks[j - 1][1]])
            if len(s) <= toks[j - 1][0] - at or not (key or _TRIGGER.search(s) or _SECRET_PREFIX.match(s)):
                continue
            left = text[at - 1] if at else " "
            left = "space" if left.isspace() else "letter" if left.isalnum() else left if left in "=:,;/(<" else "quote" if left in "\"'`" else "sign"
            out.append((i, j, at + len(s), [*features(s, word, j - i), f"left={left}", *([f"after keyword{between}"] if key else [])]))
        if first[0].isalnum() or first[0] in "+_":
            word, between = first.lower().strip(".,;:!?"), ""
        elif first in ":=":
            between = first
    return out


class Model:
    """Feature weights (features x kinds), transition weights (outside and kinds, in both)."""

    def __init__(self, names: dict[str, int], w: np.ndarray, a: np.ndarray):
        self.names, self.w, self.a = names, w, a

    def scores(self, segs) -> np.ndarray:
        return np.array([self.w[[self.names[f] for f in fs if f in self.names]].sum(0) for *_, fs in segs]).reshape(len(segs), self.w.shape[1])

    def decode(self, n: int, segs) -> list[tuple[int, int]]:
        """Best segmentation of a run of n tokens: [(segment, kind)]."""
        k = self.w.shape[1]
        s, by_end = self.scores(segs), [[] for _ in range(n + 1)]
        for x, (_, j, *_r) in enumerate(segs):
            by_end[j].append(x)
        best = np.full((n + 1, k + 1), -np.inf)
        best[0, 0] = 0
        back: list[list] = [[None] * (k + 1) for _ in range(n + 1)]
        for j in range(1, n + 1):
            p = int((best[j - 1] + self.a[:, 0]).argmax())
            best[j, 0], back[j][0] = best[j - 1, p] + self.a[p, 0], (j - 1, p, None)
            for x in by_end[j]:
                i = segs[x][0]
                come = best[i][:, None] + self.a[:, 1:]
                p = come.argmax(0)
                got = come[p, np.arange(k)] + s[x]
                for y in np.flatnonzero(got > best[j, 1:]):
                    best[j, y + 1], back[j][y + 1] = got[y], (i, int(p[y]), x)
        out, j, y = [], n, int(best[n].argmax())
        while j > 0:
            i, p, x = back[j][y]
            if x is not None:
                out.append((x, y - 1))
            j, y = i, p
        return out[::-1]


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def marginals(model: Model, n: int, segs) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of every segment with every kind, expected transitions, log of the sum over segmentations)."""
    k = model.w.shape[1]
    s = model.scores(segs)
    f = np.full((n + 1, k + 1), -np.inf)
    g = np.full((n + 1, k + 1), -np.inf)
    f[0, 0], g[n] = 0, 0
    by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for x, (i, j, *_r) in enumerate(segs):
        by_end[j].append(x)
        by_start[i].append(x)
    for j in range(1, n + 1):
        f[j, 0] = _lse(f[j - 1] + model.a[:, 0], 0)
        if by_end[j]:
            f[j, 1:] = _lse(np.stack([_lse(f[segs[x][0]][:, None] + model.a[:, 1:], 0) + s[x] for x in by_end[j]]), 0)
    for i in range(n - 1, -1, -1):
        ways = [model.a[:, 0] + g[i + 1, 0]]
        ways += [_lse(model.a[:, 1:] + s[x] + g[segs[x][1], 1:], 1) for x in by_start[i]]
        g[i] = _lse(np.stack(ways), 0)
    z = float(_lse(f[n], 0))
    prob, trans = np.zeros((len(segs), k)), np.zeros_like(model.a)
    for i in range(n):
        trans[:, 0] += np.exp(f[i] + model.a[:, 0] + g[i + 1, 0] - z)
    for x, (i, j, *_r) in enumerate(segs):
        t = np.exp(f[i][:, None] + model.a[:, 1:] + s[x] + g[j, 1:] - z)
        trans[:, 1:] += t
        prob[x] = t.sum(0)
    return prob, trans, z


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """An invented text with its entities."""
    word = lambda: "".join(rng.choice(["the", "er", "on", "an", "de", "la", "en", "ich", "que", "st", "ou"]) for _ in range(rng.randint(1, 3)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice(["4", "5", "37", "6011"]) + d(15)
        body = body[: rng.choice([15, 15, 15, 14])]
        return body + next(c for c in "0123456789" if luhn(body + c))

    def not_card() -> str:
        body = d(15)
        return body + rng.choice([c for c in "0123456789" if not luhn(body + c)])

    caps = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def iban() -> str:
        country, body = rng.choice(["DE", "FR", "ES", "GB"]), rng.choice([d(18), d(20), d(23), d(30), caps(4) + d(14), caps(4) + d(14), caps(4) + d(20) + caps(3), d(10) + caps(1) + d(10) + caps(2)])
        number = int("".join(str(int(c, 36)) for c in body + country + "00"))
        s = f"{country}{98 - number % 97:02d}{body}"
        return rng.choice([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])

    def split4(s: str) -> str:
        return rng.choice([s, s, s, " ".join(s[i : i + 4] for i in range(0, len(s), 4)), "-".join(s[i : i + 4] for i in range(0, len(s), 4))])

    def secret() -> str:
        hx, up = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
        make = lambda a, n: "".join(rng.choice(a) for _ in range(n))
        name = rng.choice(["token", "password", "secret", "api_key", "passwd", "pwd", "auth_token"])
        value = rng.choice([make(hx, rng.choice([16, 18, 32, 40, 64])), make(up + hx, rng.randint(10, 40)), make("abcdefghij", 6) + d(2), make(up + hx, rng.choice([120, 450, 1000]))])
        return rng.choice([lambda: "AKIA" + make(up, 16), lambda: "AKIA" + make(up, 16), lambda: "ghp_" + make(hx + "GHIJKLmnop", 36), lambda: f'{name} = "{value}"', lambda: f"{name} = {value}", lambda: f"{name}={value}", lambda: f"{name}={value}", lambda: f'{name}="{value}"', lambda: "eyJ" + ".".join(make(up + hx + "ghijk_-", rng.choice([20, 60, 300])) + make(up, 1) for _ in range(3))])()

    phone = lambda: rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{rng.choice(['44', '49', '33', '34'])} {d(3)} {d(7)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", "+" + " ".join(d(2) for _ in range(rng.choice([5, 6, 7]))), *national()])
    national = lambda: [f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(2)} {d(7)}", f"0{d(3)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)}-{d(7)}"]
    make = {
        "email": lambda: f"{word()}{rng.choice(['', '.', '_', '+'])}{rng.choice([word(), d(2), word() + '.' + d(2)])}@{rng.choice([word(), 'mail' + d(1)])}.{rng.choice(['com', 'org', 'example.com', 'de', 'co.uk', 'example.org'])}",
        "phone": phone, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": lambda: split4(card()), "iban": iban, "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}", "secret": secret,
    }
    other = [lambda: d(rng.randint(1, 9)), lambda: f"{rng.randint(1900, 2030)}", lambda: f"{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"${d(2)}.{d(2)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{rng.randint(1, 99)} {d(3)} {d(3)}", lambda: f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)}", lambda: f"0.{d(2)} 0.{d(2)}", lambda: f"0{d(1)} 0{d(1)} 0{d(1)}", lambda: f"x = {d(2)}", lambda: f"{word()}={word()}", lambda: f"{word()} = {word()}", lambda: f"@{word()}", lambda: f"{word()}{d(2)}", lambda: f"({d(1)})", lambda: f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(3)}", lambda: d(rng.choice([10, 11, 12, 17, 18, 20])), lambda: word() * rng.choice([40, 150]) + d(2), not_card, not_card, lambda: f"{d(2)}%", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{word()} @ {word()}", lambda: f"{word()}-{d(3)}-{d(2)}", lambda: f"/{word()}?page={d(1)}"]
    around = [("(", ")"), ("<", ">"), ("[", "]"), ('"', '"'), ("'", "'"), ("*", "*"), ("mailto:", ""), ("tel:", ""), ("http://", "/x"), ('{"' + word() + '":"', '"}'), (f'"{word()}":"', '",'), (word() + ",", "," + word()), (d(2) + ",", "," + d(3)), (word() + ";", ";"), (word() + "=", ""), ("?" + word() + "=", "&" + word() + "=" + d(1)), (word() + ":", ""), ("\u96fb\u8a71", "\u307e\u3067"), ("\u0442\u0435\u043b", ""), ("<b>", "</b>"), ("|", "|")]
    text, spans = word(), []
    for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
        text += " "
        if rng.random() < 0.6:
            kind = rng.choice(KINDS)
            s = make[kind]()
        else:
            kind, s = None, rng.choice(other)()
        head, tail = rng.choice(around) if rng.random() < 0.4 and "=" not in s else ("", "")
        text += head if not head.startswith("?") else "/" + word() + head
        if rng.random() < 0.15:  # behind a key word
            kind, head, tail = None, "", ""
            text += rng.choice(["password", "Password", "token", "secret", "api_key", "passwd", "auth_token"])
            letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz" + rng.choice(["", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])) for _ in range(rng.randint(14, 30)))
            text += (sign := rng.choice([": ", ":", ' : ', ': "', '":"', " "]))
            short = word() + rng.choice(["", word()]) + "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 5)))
            s = rng.choice([letters, short, (word() + word() + word() + word() + "thehorsebattery")[:28], "".join(rng.choice("abcdefgh") for _ in range(6)) + d(2), word(), word()] if sign != " " else [letters, word() * 2 + "correcthorse", word(), word(), word(), d(rng.randint(1, 5)), f"{word()} {word()}"])
            kind = "secret" if len(s) > 11 and " " not in s or sign != " " and (s[-1].isdigit() or s == short and len(s) > 7) else None
            tail = '"' if '"' in sign else ""
        if kind:
            spans.append((len(text), len(text) + len(s), kind))
        text += s + tail
        if kind in ("email", "phone", "ip", "card") and rng.random() < 0.1:  # two in a token
            text += rng.choice([",", ";", "|", '","', '":"'])
            more = make["email"]()
            spans.append((len(text), len(text) + len(more), "email"))
            text += more
        text += rng.choice(["", "", "", ".", ",", "!!", "%%%", "***", " " + word(), " " + word() + "."])
    return text + " " + word(), spans


def _instances(n: int, seed: int):
    rng = random.Random(seed)
    for _ in range(n):
        text, spans = example(rng)
        left = len(spans)
        for toks, before in runs(text):
            segs = segments(text, toks, before)
            gold = {(toks[i][0], end): x for x, (i, _, end, _) in enumerate(segs)}
            mine = [(s, e, k) for s, e, k in spans if toks[0][0] <= s < toks[-1][1]]
            left -= len(mine)
            yield len(toks), segs, [(gold[s, e], KINDS.index(k)) for s, e, k in mine]  # a span that is no candidate is an error
        if left:
            raise ValueError(f"entities outside all runs: {text!r}")


@lru_cache(maxsize=2)
def train(n_examples: int = 1500, epochs: int = 4, seed: int = 4) -> Model:
    """Weights by AdaGrad on the log-likelihood; the examples are invented, so no table is read."""
    data = list(_instances(n_examples, seed))
    seen = Counter(f for _, segs, _ in data for *_, fs in segs for f in fs)
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 2))}
    k = len(KINDS)
    model = Model(names, np.zeros((len(names), k)), np.zeros((k + 1, k + 1)))
    gw, ga = np.full_like(model.w, 1e-2), np.full_like(model.a, 1e-2)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for n, segs, gold in data:
            prob, trans, _ = marginals(model, n, segs)
            for x, y in gold:
                prob[x, y] -= 1
            at, prev = 0, 0
            for x, y in gold:
                i, j = segs[x][:2]
                for _t in range(at, i):
                    trans[prev, 0] -= 1
                    prev = 0
                trans[prev, y + 1] -= 1
                at, prev = j, y + 1
            for _t in range(at, n):
                trans[prev, 0] -= 1
                prev = 0
            rows = [np.array([names[f] for f in fs if f in names]) for *_, fs in segs]
            if rows:
                idx = np.concatenate(rows)
                g = np.repeat(prob, [len(r) for r in rows], 0)
                u, inv = np.unique(idx, return_inverse=True)
                grad = np.zeros((len(u), k))
                np.add.at(grad, inv, g)
                grad += 1e-4 * model.w[u]
                gw[u] += grad * grad
                model.w[u] -= 0.5 * grad / np.sqrt(gw[u])
            ga += trans * trans
            model.a -= 0.1 * trans / np.sqrt(ga)
    return model


def entities(text: str, model: Model) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's entities."""
    out = []
    for toks, before in runs(text):
        segs = segments(text, toks, before)
        if segs:
            out += [(KINDS[y], toks[segs[x][0]][0], segs[x][2]) for x, y in model.decode(len(toks), segs)]
    return out


def _find(model: Model):
    def find(batches):
        for b in batches:
            keep, kind, start, end = [], [], [], []
            for i, cell in enumerate(b.column(1)):
                text = cell.as_py()
                for k, s, e in entities(text, model) if text else ():
                    keep.append(i)
                    kind.append(k)
                    start.append(s)
                    end.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "kind", "start", "end"])

    return find


def find_pii(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end): a row for every entity of every text; narrow, no shuffle."""
    rows = docs.filter(F.col(text_col).rlike("[0-9@=]|(?i:pass|pwd|token|secret|key|auth|credential)|AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|AIza|eyJ")).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return rows.mapInArrow(_find(model or train()), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(common.table(spark, sf_dir, "documents"))
