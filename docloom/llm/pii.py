"""PII pseudonyms by format-preserving keyed permutations.

Validated values are replaced by others of the same format: card numbers (Luhn), IBANs (mod 97),
IPv4 addresses, phone numbers, calendar dates and e-mail addresses. A balanced Feistel network over
the value's digits, keyed and told apart by kind and length, is a permutation of all values of that format; where some
digit strings are not valid (dates), the permutation is walked until it meets a valid one
again. The same value hence gets the same pseudonym in every document, two values never share
one, punctuation stays, check digits are made anew, and reveal() undoes it all with the key.

Values are equal when their digits are: "4417 7442 8035 1547" and "4417744280351547" are linked.

Rules: a card number has 13 to 19 digits, in one group or in groups joined by single spaces or hyphens, as cards
write them (CARD_GROUPS) or in any way where no other group stands in the row; an IBAN has its country's
length, in upper or lower case, with or without single spaces or hyphens; a phone number has a + and a country code of one to three digits, or a bracketed
area code, and 7 to 14 further digits; dates are year-month-day, or day and month in either order, and
years from 1900 to 2099. Where kinds overlap, the first listed wins, but a date beside a card number is a date. Values that fail
validation are left as they are. In a row of groups each is tried in turn as the start of a value, so that neighbours
neither hide nor change one. Where a pseudonym would make the groups before it the start of another value, its
permutation goes on until they don't: reveal() finds the same values, and only there does the neighbourhood decide on the pseudonym.

The key is the session's spark.docloom.pii.key or the environment's DOCLOOM_PII_KEY. Without either a session gets a random
one: its pseudonyms are linked in all that it writes, and nobody can undo them.

Defined results: a null text stays null and has no values; repeated rows are treated alike. All
other text stays. Each row of the input gives a row; other columns are ignored by op7.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from secrets import token_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import table

ROUNDS = 10
KINDS = ("email", "iban", "ip", "card", "date", "phone")
KEY_SETTING, KEY_VARIABLE = "spark.docloom.pii.key", "DOCLOOM_PII_KEY"

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?)@((?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![A-Za-z0-9])")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2})\d{2}(?=[ -]?[A-Za-z0-9])", re.ASCII)
# Characters of an IBAN by country.
IBAN_SIZES = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 "
    "PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
IBAN_BODY = {n: re.compile(rf"[A-Za-z0-9]{{4}}(?:[ -]?[A-Za-z0-9]){{{n - 4}}}(?![A-Za-z0-9])", re.ASCII) for n in {*IBAN_SIZES.values()}}
IBAN_OTHER = re.compile(r"[A-Za-z0-9]{15,34}(?![A-Za-z0-9])", re.ASCII)
# Digits in the groups that card numbers are written in; those of 16 digits before longer ones that begin alike.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (8, 8), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3))
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)", re.ASCII)
CARD_ROW = re.compile(r"(?<!\d)\d+(?:[ -]\d+)*", re.ASCII)
DATE = re.compile(r"(?<![\d./-])(?:((?:19|20)\d\d)([-/.])(\d\d?)\2(\d\d?)|(\d\d?)([-/.])(\d\d?)\6((?:19|20)\d\d))(?![\d/-]|\.\d)", re.ASCII)
PHONE = re.compile(r"(?<![\d+])(?:\+(\d{1,3})[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4})(?!\d)", re.ASCII)

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
FIRST, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() - datetime.date(1900, 1, 1).toordinal() + 1


def _round(key: bytes, tweak: str, i: int, half: int, size: int) -> int:
    h = hashlib.blake2b(f"{tweak}:{i}:{half}".encode(), key=key if len(key) <= 64 else hashlib.sha512(key).digest(), digest_size=32).digest()
    return int.from_bytes(h, "big") % size


def permute(value: int, left: int, right: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of the numbers below left * right: an alternating Feistel network on a pair."""
    a, b = divmod(value, right)
    for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2:
            b = (b + sign * _round(key, tweak, i, a, right)) % right
        else:
            a = (a + sign * _round(key, tweak, i, b, left)) % left
    return a * right + b


def walk(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The same for any size, by walking on until the value is below it again."""
    root = 1
    while root * root < size:
        root += 1
    while True:
        value = permute(value, root, root, key, tweak, back)
        if value < size:
            return value


def digits(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Digits to as many digits."""
    n = len(text)
    if n < 2:
        return str(walk(int(text), 10, key, f"{tweak}/1", back)) if n else ""
    return str(permute(int(text), 10 ** (n // 2), 10 ** (n - n // 2), key, f"{tweak}/{n}", back)).zfill(n)


def luhn_ok(text: str) -> bool:
    return luhn_digit(text[:-1]) == text[-1]


def luhn_digit(text: str) -> str:
    total = sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(text))))
    return str(-total % 10)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(pattern: str, new: str, of: Callable[[str], bool] = str.isdigit) -> str:
    """The pattern with its characters of a kind replaced in order."""
    it = iter(new)
    return "".join(next(it) if of(c) else c for c in pattern)


def _mixed(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters and digits, each as one number whose places have 26 or 10 values; case and other marks stay."""
    low = [c.lower() for c in text]
    places = [(DIGITS if c in DIGITS else LETTERS) for c in low if c in DIGITS or c in LETTERS]
    if not places:
        return text
    value, size = 0, 1
    for c, p in zip((c for c in low if c in DIGITS or c in LETTERS), places, strict=True):
        value, size = value * len(p) + p.index(c), size * len(p)
    cut = len(places) // 2
    right = 1
    for p in places[cut:]:
        right *= len(p)
    shape = "".join("d" if p is DIGITS else "l" for p in places)
    value = permute(value, size // right, right, key, f"{tweak}/{shape}", back) if cut else walk(value, size, key, f"{tweak}/{shape}", back)
    new = []
    for p in reversed(places):
        value, at = divmod(value, len(p))
        new.append(p[at])
    out = _refill("".join(low), "".join(reversed(new)), lambda c: c in DIGITS or c in LETTERS)
    return "".join(o.upper() if c.isupper() else o for c, o in zip(text, out, strict=True))


def email(m: re.Match, key: bytes, back: bool) -> str | None:
    """The local part changes, the domain stays."""
    return f"{_mixed(m[1], key, 'email', back)}@{m[2]}"


def _bare(text: str) -> str:
    return text.replace(" ", "").replace("-", "")


def is_iban(text: str) -> bool:
    plain = _bare(text)
    return 15 <= len(plain) <= 34 and _mod97(plain) == 1


def iban(text: str, key: bytes, back: bool) -> str:
    """The account part changes within its digits and letters; country and length stay, check digits are new."""
    plain = _bare(text)
    account = _mixed(plain[4:], key, f"iban{plain[:2].upper()}", back)
    check = 98 - _mod97(f"{plain[:2]}00{account}")
    return _refill(text, f"{plain[:2]}{check:02d}{account}", str.isalnum)


def _ibans(text: str, start: int = 0) -> Iterator[tuple[int, int]]:
    """Places of IBANs from a place on."""
    end = start
    for m in IBAN_START.finditer(text, start):
        if m.start() < end:
            continue
        size = IBAN_SIZES.get(m[1].upper())
        found = (IBAN_BODY[size] if size else IBAN_OTHER).match(text, m.start())
        if found and is_iban(found[0]):
            end = found.end()
            yield found.span()


def find_ibans(text: str, taken: Taken, key: bytes, back: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of each."""
    at = 0
    for a, b in _ibans(text):
        if taken.meet(a, b):
            continue
        new, near = text[a:b], text[max(at, a - 80) : a]
        while True:
            new = iban(new, key, back)
            if next(_ibans(near + new + text[b : b + 1])) == (len(near), len(near) + b - a):
                break
        yield a, b, new
        at = b


def ip(m: re.Match, key: bytes, back: bool) -> str | None:
    """All four bytes as one number."""
    parts = m[0].split(".")
    if any(len(p) > 1 and p[0] == "0" for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 65536, 65536, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def is_card(text: str) -> bool:
    plain = re.sub(r"[ -]", "", text)
    return 13 <= len(plain) <= 19 and luhn_ok(plain)


def card(text: str, key: bytes, back: bool) -> str:
    """All digits but the check digit."""
    new = digits(re.sub(r"[ -]", "", text)[:-1], key, "card", back)
    return _refill(text, new + luhn_digit(new))


def _cards(row: str, groups: list[tuple[int, int]], alone: bool = False) -> Iterator[tuple[int, int]]:
    """First and last group of the card numbers in a row of groups; alone: the groups are all of the row."""
    i, some = 0, False
    sizes = [b - a for a, b in groups]
    while i < len(groups):
        forms = [1] if 13 <= sizes[i] <= 19 else [len(f) for f in CARD_GROUPS if tuple(sizes[i : i + len(f)]) == f]
        for n in forms:
            if is_card(row[groups[i][0] : groups[i + n - 1][1]]):
                yield i, i + n - 1
                some, i = True, i + n - 1
                break
        i += 1
    if alone and not some and len(groups) > 1 and 13 <= sum(sizes) <= 19 and is_card(row[groups[0][0] : groups[-1][1]]):
        yield 0, len(groups) - 1


def find_cards(text: str, taken: Taken, key: bytes, back: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of each."""
    for m in CARD_ROW.finditer(text):
        if m.end() - m.start() < 13:
            continue
        rows: list[list[tuple[int, int]]] = [[]]
        whole = True
        for g in re.finditer(r"\d+", m[0]):
            a, b = g.start() + m.start(), g.end() + m.start()
            if taken.meet(a, b) or g.start() == 0 and text[max(a - 1, 0) : a] in ("+", "-"):
                rows.append([])
                whole = False
            else:
                rows[-1].append((a, b))
        for groups in rows:
            free = 0
            for i, k in _cards(text, groups, alone=whole):
                # A value that begins before this one has five groups at most.
                first = max(free, i - 4)
                a, b, from_ = groups[i][0], groups[k][1], groups[first][0]
                near = [(x - from_, y - from_) for x, y in groups[first : k + 1]]
                new = text[a:b]
                while True:
                    new = card(new, key, back)
                    if next(_cards(text[from_:a] + new, near, alone=whole and len(groups) == len(near)), None) == (i - first, k - first):
                        break
                yield a, b, new
                free = k + 1


def date(m: re.Match, key: bytes, back: bool) -> str | None:
    """The day, among all from 1900 to 2099. Day before month where both orders are dates."""
    year_first = m[1] is not None
    y, a, b, sep = (m[1], m[3], m[4], m[2]) if year_first else (m[8], m[5], m[7], m[6])
    month_first = year_first or (int(a) <= 12 < int(b))
    month, day = (a, b) if month_first else (b, a)
    try:
        value = datetime.date(int(y), int(month), int(day)).toordinal() - FIRST
    except ValueError:
        return None
    padded = (len(month), len(day))
    order = "ymd" if year_first else "mdy" if month_first else "dmy"

    def written(d: datetime.date) -> str | None:
        """None where the date would be read in another way or length than the one it stands for."""
        mm, dd = (str(d.month).zfill(2) if padded[0] == 2 else str(d.month)), (str(d.day).zfill(2) if padded[1] == 2 else str(d.day))
        if (len(mm), len(dd)) != padded or order == "mdy" and d.day <= 12:
            return None
        return sep.join({"ymd": (str(d.year), mm, dd), "mdy": (mm, dd, str(d.year)), "dmy": (dd, mm, str(d.year))}[order])

    full = order != "mdy" and padded == (2, 2)
    tweak = "date" if full else f"date/{order}/{padded}"
    while True:
        value = walk(value, DAYS, key, tweak, back)
        if (out := written(datetime.date.fromordinal(FIRST + value))) is not None:
            return out


def phone(m: re.Match, key: bytes, back: bool) -> str | None:
    """All digits after the country code."""
    code = m[1] or ""
    rest = m[0][1 + len(code) :] if code else m[0]
    plain = re.sub(r"\D", "", rest)
    if not 7 <= len(plain) <= 14:
        return None
    return ("+" + code if code else "") + _refill(rest, digits(plain, key, f"phone{code}", back))


class Taken:
    """Spans that don't overlap, in which places are looked up."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]

    def meet(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.spans[k][1] > a


def _each(pattern: re.Pattern, change: Callable[[re.Match, bytes, bool], str | None]) -> Callable:
    """Finds values that a pattern matches whole: (start, end, pseudonym) of each."""

    def find(text: str, taken: Taken, key: bytes, back: bool) -> Iterator[tuple[int, int, str]]:
        for m in pattern.finditer(text):
            if not taken.meet(*m.span()) and (new := change(m, key, back)) is not None:
                yield *m.span(), new

    return find


FINDERS = (_each(EMAIL, email), find_ibans, _each(IP, ip), find_cards, _each(DATE, date), _each(PHONE, phone))


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with pseudonyms, and (start, kind number, end) of the values in the text given, by start."""
    if not re.search(r"\d", text, re.ASCII) and "@" not in text:
        return text, []
    found: list[tuple[int, int, int, str]] = []
    for kind, find in enumerate(FINDERS):
        if kind == 0 and "@" not in text:
            continue
        spans = [(a, b) for a, _, b, _ in found]
        taken = Taken(spans)
        if find is find_cards:
            taken = Taken(spans + [(a, b) for a, b, _ in FINDERS[4](text, taken, key, back)])
        found += [(a, kind, b, new) for a, b, new in find(text, taken, key, back)]
    found.sort()
    out, at = [], 0
    for a, _, b, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [f[:3] for f in found]


def reveal(text: str, key: bytes) -> str:
    """The values again, from a text with pseudonyms."""
    return replace(text, key, back=True)[0]


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, a count for each kind, spans (kind:start:end in the text given) and text with pseudonyms, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                new, spans = (None, []) if text is None else replace(text, key)
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans), new))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(KINDS) + 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[: len(KINDS)]), *(pa.array(c, pa.string()) for c in columns[len(KINDS) :])],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "spans", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, spans string, text string")


_RANDOM_KEY = token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key that is configured, or this process's random one."""
    said = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    return said.encode() if said else _RANDOM_KEY


def op7_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents", "doc_id"), session_key(spark))


QUERIES = {"op7_feistel": op7_feistel}
