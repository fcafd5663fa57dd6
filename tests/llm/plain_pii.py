"""Pseudonyms in plain Python, text by text: what the DataFrame functions are held against."""

from __future__ import annotations

import datetime as dt
import hashlib

import regex

from tidemark.llm import pii

ANY = regex.compile(pii.ANY, regex.ASCII)
DAY0 = dt.date(1800, 1, 1)
FORMS = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y"}


def feistel(key, x, y, a, b, tweak):
    for r in range(pii.ROUNDS):
        prf = int(hashlib.sha256(f"{key}|{tweak}|{r}|{y if r % 2 == 0 else x}".encode()).hexdigest()[:15], 16)
        x, y = ((x + prf) % a, y) if r % 2 == 0 else (x, (y + prf) % b)
    return x, y


def zero(c):
    return 48 if c.isdigit() else 65 if c.isupper() else 97


def characters(s, key, tweak):
    out = ""
    for i in range(-(-len(s) // pii.PIECE)):
        piece = s[i * pii.PIECE : (i + 1) * pii.PIECE]
        free = [c for c in piece if c.isascii() and c.isalnum()]
        halves = free[: len(free) // 2], free[len(free) // 2 :]
        ranks, rooms = [], []
        for half in halves:
            rank, room = 0, 1
            for c in half:
                radix = 10 if c.isdigit() else 26
                rank, room = rank * radix + ord(c) - zero(c), room * radix
            ranks.append(rank)
            rooms.append(room)
        new = []
        for v, half in zip(feistel(key, *ranks, *rooms, f"{tweak}/{i}/" + ".".join(str(zero(c)) for c in free)), halves):
            own = []
            for c in reversed(half):
                v, d = divmod(v, 10 if c.isdigit() else 26)
                own.append(chr(zero(c) + d))
            new += reversed(own)
        it = iter(new)
        out += "".join(next(it) if c.isascii() and c.isalnum() else c for c in piece)
    return out


def poured(form, new):
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in form)


def luhn(digits, last_counts):
    return sum(d if (i + last_counts) % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def day(m):
    form = FORMS[next(c for c in m if not c.isdigit())]
    try:
        n = (dt.datetime.strptime(m, form).date() - DAY0).days
    except ValueError:
        return None
    return (n, form) if 0 <= n < 189 * 773 else None


def pseudonym(m, key):
    """(kind, pseudonym) of a match; None if it isn't valid."""
    if "@" in m:
        local, _, rest = m.partition("@")
        return "email", characters(local, key, "email") + "@" + rest
    digits = "".join(c for c in m if c.isdigit())
    if m[0].isupper():
        s = m.replace(" ", "")
        if mod97(s[4:] + s[:4]) != 1:
            return None
        own = characters(s[4:], key, "iban" + s[:2])
        return "iban", poured(m, s[:2] + f"{98 - mod97(own + s[:2] + '00'):02d}" + own)
    if m[0] == "+":
        return ("phone", poured(m, digits[:3] + characters(digits[3:], key, "phone" + digits[:3]))) if 7 <= len(digits) <= 15 else None
    if regex.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = list(map(int, m.split(".")))
        if max(o) > 255 or m != ".".join(map(str, o)):
            return None
        x, y = feistel(key, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return "ip", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if regex.fullmatch(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4}", m):
        if (found := day(m)) is None:
            return None
        x, y = feistel(key, found[0] // 773, found[0] % 773, 189, 773, "date")
        return "date", (DAY0 + dt.timedelta(days=x * 773 + y)).strftime(found[1])
    if regex.fullmatch(r"\d{3}([ -])\d\d\1\d{4}", m):
        area, group, serial = map(int, m.replace("-", " ").split())
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x, y = feistel(key, area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return "ssn", f"{x + (2 if x >= 665 else 1):03d}{m[3]}{y // 9999 + 1:02d}{m[3]}{y % 9999 + 1:04d}"
    if luhn(digits, 1) % 10:
        return None
    front = digits[0] + characters(digits[1:-1], key, "card")
    return "card", poured(m, front + str(-luhn(front, 0) % 10))


def pseudonymised(text, key):
    kinds = []

    def new(m):
        done = pseudonym(m[0], key)
        if done:
            kinds.append(done[0])
        return done[1] if done else m[0]

    return (None, []) if text is None else (ANY.sub(new, text), kinds)
