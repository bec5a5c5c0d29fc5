"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to them.

The field scores whole candidate segments (their digits, check sums, punctuation, neighbours and the words before), and
dynamic programming over segments of bounded length picks boundaries and types together; a type is open to a segment only if its
form allows it. Its weights are fitted here, by likelihood, on a bounded sample of regions that the patterns and published forms
of keys, account and social security numbers label. What has such a form is reported whether the field finds it or not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import change_rows, only, small_batches, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
MOST_TOKENS = 16
Span = tuple[str, int, int]

_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The lookbehinds and possessive runs change no match; they keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Published forms of access keys and tokens.
_TOKENS = re.compile(
    r"\b(?:AKIA|ASIA|AGPA|AROA|AIDA)[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36,}|\bgithub_pat_[0-9A-Za-z_]{22,}|\bglpat-[0-9A-Za-z_-]{20,}|\bxox[abeoprs]-[0-9A-Za-z-]{10,}|\b[spr]k_(?:live|test)_[0-9A-Za-z]{16,}"
    r"|\bsk-[0-9A-Za-z_-]{20,}|\bAIza[0-9A-Za-z_-]{35}|\bya29\.[0-9A-Za-z_-]{20,}|\bnpm_[0-9A-Za-z]{36}|\bSG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}|\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}(?:\.[0-9A-Za-z_-]*)?")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----.*?-----END [A-Z ]{0,40}PRIVATE KEY-----", re.S)
_TOKEN_STARTS = ("AKIA", "ASIA", "AGPA", "AROA", "AIDA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "sk-", "AIza", "ya29.", "npm_", "SG.", "eyJ")
_QUOTED_HEX = re.compile(r"[\"']([0-9a-f]{24,})(?=[\"'])")
_NUMBERS = re.compile(r"[0-9][0-9 ().-]{8,}")
#: Words that announce a secret.
_KEYWORDS = r"passw(?:or)?d|passwort|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?"
_KEYWORD_STEMS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential")
_GIVEN = re.compile(rf"""(?i:{_KEYWORDS})["']?[ \t]*(?::=|=>|[=:])[ \t]*(?:"([^"\s]{{6,}})"|'([^'\s]{{6,}})'|([^\s"'<>,;()]{{8,}}))""")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_DATE = re.compile(r"(?:[0-9]{4}[-. ]?[0-9]{1,2}[-. ]?[0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ][0-9]{4})(?:[-. ]+[0-9]{1,6})*")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
# Runs that are candidates whole, whatever their token count: letters and digits, parts of addresses, numbers, quoted ones, words.
_RUNS = tuple(re.compile(x) for x in (r"[^\W_]+", r"[\w.%+@-]+", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", r"\+[0-9][ ().0-9-]+[0-9]", r"(?<=\")[^\s\"]+(?=\")|(?<=')[^\s']+(?=')", r"\S+"))
_ASKS = re.compile(rf"(?:{_KEYWORDS}|key|auth|bearer|basic)\W{{0,6}}$", re.I)
_ASSIGNED = re.compile(rf"(?:{_KEYWORDS}|key|auth)[\"']?[ \t]*(?::=|=>|[=:])[ \t]*[\"']?$", re.I)
_KEYWORD, _SIGN = re.compile(_KEYWORDS, re.I), re.compile(r"(?::=|=>|[=:])$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Grows from each @ instead of trying every start, which is the same and stays linear."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Fixed patterns, by kind as listed, then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _TRIGGER.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(only_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def iban(x: str) -> bool:
    plain = x.replace(" ", "")
    if not (15 <= len(plain) <= 34 and plain.isascii() and plain.isalnum() and plain[:2].isalpha() and plain[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in (plain[4:] + plain[:4]).upper())) % 97 == 1


def likely_secret(x: str, quoted: bool) -> bool:
    """Values that someone gives for a password or key, not words of prose: letters and digits, or quoted with a sign among them."""
    return (any(c.isdigit() for c in x) and any(c.isalpha() for c in x)) or (quoted and not x.isalnum() and x[0] not in "<{$%[")


def hints(text: str) -> tuple[bool, bool]:
    """Whether a text has a digit or an @, and a word that may announce a secret: most have neither."""
    low = text.lower()
    return _TRIGGER.search(text) is not None, any(x in low for x in _KEYWORD_STEMS)


def seeds(text: str) -> list[Span]:
    """What is known by its form: access keys, values given for passwords and keys, account and social security numbers with
    their checks, phone numbers without a country code. None lies within another."""
    digits, asked = hints(text)
    if not digits and not asked:
        return []
    found = [("secret", *m.span()) for m in _PEM.finditer(text)] if "-----BEGIN " in text else []
    if any(x in text for x in _TOKEN_STARTS):
        found += [("secret", *m.span()) for m in _TOKENS.finditer(text)]
    if digits:
        found += [("secret", *m.span(1)) for m in _QUOTED_HEX.finditer(text)]
    for m in _GIVEN.finditer(text) if asked else ():
        k = m.lastindex
        a, b = m.span(k)
        while k == 3 and b > a and not text[b - 1].isalnum():
            b -= 1
        if likely_secret(text[a:b], k < 3):
            found.append(("secret", a, b))
    if digits:
        for d in _DIGITS.finditer(text):
            m = _IBAN.match(text, d.start() - 2) if d.start() > 1 and text[d.start() - 1].isupper() else None
            if not m:
                continue
            a, b = m.span()
            while b > a and not iban(text[a:b]):  # a following word may stand close
                b = text.rfind(" ", a, b)
            if b > a:
                found.append(("iban", a, b))
        for n in _NUMBERS.finditer(text):
            near = (max(0, n.start() - 1), min(len(text), n.end() + 1))
            found += [(kind, *m.span()) for kind, form in (("ssn", _SSN), ("phone", _LOCAL_PHONE)) for m in form.finditer(text, *near)]
    out: list[Span] = []
    for kind, a, b in sorted(found, key=lambda f: (f[1], -f[2])):
        if not out or a >= out[-1][2]:
            out.append((kind, a, b))
    return out


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words on one line where entities can be: words with a digit or an @, words that announce a secret, and after these the
    sign and the value that it gives."""
    if not any(hints(text)):
        return
    start = end = -1
    given = False  # whether a value must follow
    for m in _WORD.finditer(text):
        word, joined = m[0], start >= 0 and "\n" not in text[end:m.start()]
        told = bool(_KEYWORD.search(word))
        if not (_TRIGGER.search(word) or told or (joined and (given or _SIGN.fullmatch(word)))):
            if start >= 0:
                yield start, end
            start, given = -1, False
            continue
        given = (told or joined) and bool(_SIGN.search(word))
        if not joined:
            if start >= 0:
                yield start, end
            start = m.start()
        end = m.end()
    if start >= 0:
        yield start, end


FEATURES = (
    "bias", "digits<8", "digits8-15", "digits16-19", "digits>19", "one_at", "dot_after_at", "local_and_domain", "four_parts", "parts_fit", "luhn16", "plus_first", "phone_marks",
    "card_marks", "only_digits", "hex", "letters_and_digits", "long24", "upper20", "asked_for", "quoted", "left_joined", "right_joined", "left_local", "right_more_digits",
    "several_words", "tokens>6", "odd_marks", "right_continues", "mixed_cases", "letters_and_digits8", "many_switches", "marked_prefix", "assigned", "whole", "fits_iban", "fits_ssn", "groups_of_three",
)


def own_features(x: str) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    """Features of a candidate by its own text, and which kinds its form allows."""
    return _short_features(x) if len(x) <= 160 else _features(x)


def _features(x: str) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    d = only_digits(x)
    out = [0, 1 if len(d) < 8 else 2 if len(d) < 16 else 3 if len(d) < 20 else 4]
    at = x.count("@")
    if at == 1:
        local, _, domain = x.partition("@")
        out.append(5)
        if "." in domain.strip("."):
            out.append(6)
        if local and all(c in _LOCAL for c in local) and _DOMAIN.fullmatch(domain):
            out.append(7)
    parts = x.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append(8)
        if all(int(p[:4]) <= 255 and len(p) <= 3 for p in parts):
            out.append(9)
    if 16 <= len(d) <= 19 and luhn(d):
        out.append(10)
    if x[0] == "+":
        out.append(11)
    if re.fullmatch(r"[+0-9][ ().0-9-]*", x) and re.search(r"[ ()-]", x):
        out.append(12)
    if re.fullmatch(r"[0-9](?:[ -]?[0-9])*", x):
        out.append(13)
    if len(d) == len(x):
        out.append(14)
    if re.fullmatch(r"[0-9a-f]+", x) and re.search("[a-f]", x):
        out.append(15)
    if x.isascii() and x.isalnum() and d and len(d) < len(x):
        out.append(16)
        if len(x) >= 24:
            out.append(17)
        if len(x) == 20 and x.isupper():
            out.append(18)
    if re.search(r"\s", x):
        out.append(25)
    if not re.fullmatch(r"[\w@.+() %-]+", x):
        out.append(27)
    if d and x.upper() != x and x.lower() != x:
        out.append(29)
    if d and len(x) >= 8 and re.fullmatch(r"[\w.+/=-]+", x) and len(d) < len(x):
        out.append(30)
    if len(re.findall(r"[^\W\d_](?=[0-9])|[0-9](?=[^\W\d_])", x)) >= 3:
        out.append(31)
    if re.match(r"[A-Za-z]{2,10}[_-][0-9A-Za-z_-]{12,}$", x):
        out.append(32)
    fits_iban, fits_ssn = "iban" in KINDS and iban(x), bool(_SSN.fullmatch(x))
    if fits_iban:
        out.append(35)
    if fits_ssn:
        out.append(36)
    if _LOCAL_PHONE.fullmatch(x):
        out.append(37)
    is_ip = len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-9:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts)
    allowed = {"email": 7 in out, "ip": is_ip, "card": 10 in out and 13 in out, "phone": 8 <= len(d) <= 15 and re.fullmatch(r"[+(0-9][ ().0-9-]*", x) is not None,
               "iban": fits_iban, "ssn": fits_ssn, "secret": len(x) >= 6 and not re.search(r"\s", x) and any(c.isalpha() for c in x) and (not x.isalpha() or 29 in out)}
    allowed["phone"] &= not _DATE.fullmatch(x)
    return tuple(out), tuple(allowed[k] for k in KINDS)


_short_features = lru_cache(maxsize=50_000)(_features)


Segment = tuple[int, int, tuple[int, ...], tuple[bool, ...]]


def tokens_of(text: str, start: int, end: int, cuts: set[int]) -> list[tuple[int, int]]:
    """Tokens of a region, split where a known span begins or ends, so that each of those can be a segment."""
    out = []
    for m in _TOKEN.finditer(text, start, end):
        a, b = m.span()
        for cut in sorted(c for c in cuts if a < c < b):
            out.append((a, cut))
            a = cut
        out.append((a, b))
    return out


def segments(text: str, start: int, end: int, spans: list[Span] | None = None) -> tuple[list[tuple[int, int]], list[Segment]]:
    """Tokens of a region and the candidate segments over them: (first, end token, features, kinds allowed). Candidates are all short
    runs of tokens, and the runs of ``_RUNS`` and what is known (``spans``) at any length."""
    spans = [*base_spans(text), *seeds(text)] if spans is None else spans
    inside = [(a, b) for _, a, b in spans if start <= a and b <= end]
    tokens = tokens_of(text, start, end, {x for span in inside for x in span})
    out = []
    first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: j for j, (_, b) in enumerate(tokens, 1)}
    long: dict[int, set[int]] = {}
    for a, b in inside:
        if a in first and b in last:
            long.setdefault(first[a], set()).add(last[b])
    for run in _RUNS:
        for m in run.finditer(text, start, end):
            a, b = m.span()
            while a < b and not (text[a].isalnum() or text[a] in "+(_%"):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if a < b and a in first and b in last and (last[b] - first[a] > MOST_TOKENS or b - a > 160):
                long.setdefault(first[a], set()).add(last[b])
    for i, (a, _) in enumerate(tokens):
        c, known = text[a], long.get(i, set())
        if not (c.isalnum() or c in "+(_%") and not known:
            continue
        left, before = text[a - 1] if a else " ", text[max(0, a - 32):a]
        asked, assigned = bool(_ASKS.search(before)), bool(_ASSIGNED.search(before))
        near = min(len(tokens), i + MOST_TOKENS)
        while near > i and tokens[near - 1][1] - a > 160:
            near -= 1
        for j in sorted({*range(i + 1, near + 1), *known}):
            b = tokens[j - 1][1]
            if not text[b - 1].isalnum() and j not in known:
                continue
            x = text[a:b]
            if not assigned and not _TRIGGER.search(x) and j not in known:
                continue
            found, allowed = own_features(x)
            if j in known and not any(allowed):
                allowed = (*allowed[:-1], True)
            if not any(allowed):
                continue
            found = list(found)
            right = text[b] if b < len(text) else " "
            if asked:
                found.append(19)
            if left in "\"'" and right in "\"'":
                found.append(20)
            if left.isalnum():
                found.append(21)
            if right.isalnum():
                found.append(22)
            if left in "._%+-@":
                found.append(23)
            if right in " .-" and b + 1 < len(text) and text[b + 1].isdigit():
                found.append(24)
            if j - i > 6:
                found.append(26)
            if right in ".@-_" and b + 1 < len(text) and text[b + 1].isalnum():
                found.append(28)
            if assigned:
                found.append(33)
            if left in " \t\n\"'([<=:,;" and (right in " \t\n\"')]>,;" or right in ".:!?" and (b + 1 == len(text) or text[b + 1].isspace())):
                found.append(34)
            out.append((i, j, tuple(found), allowed))
    return tokens, out


def as_arrays(found: list[Segment]) -> tuple[np.ndarray, np.ndarray]:
    """Features of segments, and 0 or minus infinity for each kind that the form allows or rules out."""
    x = np.zeros((len(found), len(FEATURES)))
    for k, (_, _, f, _) in enumerate(found):
        x[k, list(f)] = 1
    return x, np.where(np.array([allowed for *_, allowed in found], bool).reshape(len(found), len(KINDS)), 0.0, -np.inf)


def scores_of(found: list[Segment], weights: np.ndarray) -> np.ndarray:
    x, mask = as_arrays(found)
    return x @ weights + mask


def decode(text: str, weights: np.ndarray, spans: list[Span] | None = None) -> list[Span]:
    """Best segmentation of each region; tokens outside entities weigh nothing."""
    out: list[Span] = []
    for start, end in regions(text):
        tokens, found = segments(text, start, end, None if spans is None else [s for s in spans if start <= s[1] and s[2] <= end])
        if not found:
            continue
        score = scores_of(found, weights)
        kind, best = score.argmax(axis=1), score.max(axis=1)
        ends: dict[int, list[int]] = {}
        for k in np.flatnonzero(best > 0).tolist():
            ends.setdefault(found[k][1], []).append(k)
        total, back = [0.0] * (len(tokens) + 1), [-1] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            total[j] = total[j - 1]
            for k in ends.get(j, ()):
                if (value := total[found[k][0]] + best[k]) > total[j]:
                    total[j], back[j] = value, k
        j, spans = len(tokens), []
        while j:
            if back[j] < 0:
                j -= 1
            else:
                i = found[back[j]][0]
                spans.append((KINDS[kind[back[j]]], tokens[i][0], tokens[j - 1][1]))
                j = i
        out += spans[::-1]
    return out


def fit(examples: list[tuple[str, int, int]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights by likelihood over segmentations (forward-backward). ``examples``: text around a region and its bounds."""
    weights = np.zeros((len(FEATURES), len(KINDS)))
    ready = []
    for text, start, end in examples:
        known = [*base_spans(text), *seeds(text)]
        tokens, found = segments(text, start, end, known)
        gold = {(a, b): KINDS.index(k) for k, a, b in reversed(known) if start <= a and b <= end}
        truth = [(k, gold[tokens[i][0], tokens[j - 1][1]]) for k, (i, j, _, _) in enumerate(found) if (tokens[i][0], tokens[j - 1][1]) in gold]
        if found:
            x, mask = as_arrays(found)
            truth = [(k, kind) for k, kind in truth if mask[k, kind] == 0]
            ready.append((len(tokens), [(i, j) for i, j, _, _ in found], x, mask, truth))
    sums = np.full_like(weights, 1e-8)
    for _ in range(rounds):
        for size, places, x, mask, truth in ready:
            score = x @ weights + mask
            top = score.max(axis=1)
            whole = top + np.log(np.exp(score - top[:, None]).sum(axis=1))
            forward, backward = np.zeros(size + 1), np.zeros(size + 1)
            by_end: list[list[int]] = [[] for _ in range(size + 1)]
            by_start: list[list[int]] = [[] for _ in range(size + 1)]
            for k, (i, j) in enumerate(places):
                by_end[j].append(k)
                by_start[i].append(k)
            for j in range(1, size + 1):
                forward[j] = np.logaddexp.reduce([forward[j - 1], *[forward[places[k][0]] + whole[k] for k in by_end[j]]])
            for i in range(size - 1, -1, -1):
                backward[i] = np.logaddexp.reduce([backward[i + 1], *[backward[places[k][1]] + whole[k] for k in by_start[i]]])
            first, last = np.array([i for i, _ in places]), np.array([j for _, j in places])
            chance = np.exp(forward[first] + score.T + backward[last] - forward[size]).T
            for k, kind in truth:
                chance[k, kind] -= 1
            slope = x.T @ chance + decay * weights
            sums += slope**2
            weights -= rate * slope / np.sqrt(sums)
    return weights


#: Numbers and names that are no personal data, for training: dates, amounts, versions, measures, references.
NEGATIVES = (
    "on 2024-01-05 at 10:30:00 and 05.01.2024", "version 1.2.3 and v10.4.0-rc1 of 2023", "costs 1,234.50 or 99,95 in 1984", "pages 12-34, chapter 7.3.1", "ISBN 978-3-16-148410-0",
    "build 20240105T101500Z passed", "at 3.5x and 10^6 units, 42% of 1e9", "flight LH1234, room B12, route A7", "section 4.2.1.3 of RFC2616", "size 1920x1080 px, 64GB", "the key: required field",
    "password: required", "token count: 1234", "secret = none", "sha1 of 12 files", "utf-8 and iso-8859-1", "h2o, co2, mp3 and mp4 files", "covid-19 in q3 2020", "1st, 2nd and 3rd of 4th", "2001:0db8 net",
    "order 10023456 of lot 7781", "id 4711 row 00001234", "x86_64 and arm64-v8a", "log4j2 and python3.13", "figure 12b, table 3a, appendix c4", "tel 12 34 at 9am-5pm",
)


def train(docs: DataFrame, sample: int = 1500, seed: int = 3) -> np.ndarray:
    """Fits on the ``sample`` distinct regions of the corpus that come first in a seeded order; each is sent with up to 40 characters
    around it and regions of over 400 characters aren't examples."""

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, "text"):
                rows = [(t[max(0, a - 40):b + 40], a - max(0, a - 40), b - max(0, a - 40)) for t in texts(part.column("text")) for a, b in regions(t) if b - a <= 400]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))], ["x", "a", "b"])

    found = only(docs, text="string").filter(F.col("text").rlike(f"[0-9@]|(?i:{_KEYWORDS})")).mapInArrow(run, "x string, a int, b int")
    rows = found.distinct().orderBy(F.xxhash64(F.lit(seed), "x", "a"), "x", "a").limit(sample).collect()
    return fit([(r["x"], r["a"], r["b"]) for r in rows] + [(x, a, b) for x in NEGATIVES for a, b in regions(x)] * (len(rows) // 50)) if rows else fit([])


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and those added: what is known by its form, and what the field finds beside. Keys and account numbers are told whole
    even where a pattern found a part of them; no other added span overlaps one before."""
    base, known = base_spans(text), seeds(text)
    taken = sorted((a, b) for _, a, b in base)

    def free(a: int, b: int) -> bool:
        return not any(x < b and a < y for x, y in taken)

    added = [(kind, a, b) for kind, a, b in known if kind in ("secret", "iban") or free(a, b)]
    taken += [(a, b) for _, a, b in added]
    added += [(kind, a, b) for kind, a, b in decode(text, weights, base + known) if free(a, b)]
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])


def personal_data(docs: DataFrame, sample: int = 1500) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base patterns), base_sha256 (of the base
    spans as kind:start:end, comma-joined), spans (base and added ones, likewise; kinds as in ``KINDS``), n_added.

    Offsets are code points, ends exclusive. The field is fitted on at most ``sample`` regions of ``docs`` itself; where there are
    none it adds nothing. NULL text is empty. Repeated rows are judged alike, ids may be NULL, empty input gives no rows.
    """
    weights = train(docs, sample)

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, "text"):
                made = [all_spans(t, weights) for t in texts(part.column("text"))]
                columns = [pa.array([sum(s[0] == k for s in base) for base, _ in made], pa.int64()) for k in BASE_KINDS]
                columns += [pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in made]), pa.array([joined(base + added) for base, added in made]),
                            pa.array([len(added) for _, added in made], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *SCHEMA.names])

    return only(docs, doc_id="long", text="string").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), *SCHEMA.fields]))


def without_personal_data(docs: DataFrame, sample: int = 1500) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; a column n_chars (whole numbers) follows the new text. Rows without
    personal data stay as they are."""
    weights = train(docs, sample)

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [n.lower() for n in batch.schema.names]
        at, old = names.index("text"), batch.column("text").to_pylist()
        found = [all_spans(t or "", weights) for t in old]
        new = [t if t is None or not any(f) else redacted(t, sum(f, [])) for t, f in zip(old, found)]
        columns = list(batch.columns)
        columns[at] = pa.array(new, batch.schema.field(at).type)
        if "n_chars" in names and pa.types.is_integer(batch.schema.field(c := names.index("n_chars")).type):
            columns[c] = pa.array([x if a == b or x is None else len(b) for x, a, b in zip(columns[c].to_pylist(), old, new)], batch.schema.field(c).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return change_rows(docs, change)
