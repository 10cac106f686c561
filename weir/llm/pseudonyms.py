"""Operator 2, PII: format-preserving Feistel pseudonyms.

Personal values are found by pattern and validated (Luhn for cards, mod 97 for IBANs, ranges for addresses, the
calendar for dates); each valid one is replaced by a keyed permutation of the values of its own format, so equal
values get equal pseudonyms in every document, different values get different ones, and the pseudonym passes the
same validation. The permutation is a balanced Feistel network over the format's number of values, with cycle
walking; the key is a parameter. `pseudonymize` with back=True inverts it.

What counts: e-mail addresses (local part permuted, domain kept), payment cards (also where an expiry date or a
check value follows), IBANs (cut to their country's length), IPv4 addresses, phone numbers, US social security
numbers, dates, access-key ids, and values assigned to password, token, secret or key names: such a value goes on to
white space or to the quote that closes it, whatever its length. Values that fail validation stay.

There is no shuffle. Cases: null text stays null with 0 findings; an empty text stays empty; repeated rows give
equal rows; other columns are carried; an empty table gives an empty table; texts are read whole, in linear time.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_column

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Permutation:
    """Keyed permutations of 0..n-1, one for each kind of value and n."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, kind: str, n: int, i: int, half: int, bits: int) -> int:
        # a keyed hash gives up to 512 bits; halves of wider formats are drawn in blocks
        out, block = 0, 0
        base = f"{kind}|{n}|{i}|{half}|".encode()
        while bits > 512 * block:
            out = out << 512 | int.from_bytes(blake2b(base + str(block).encode(), key=self.key[:64]).digest(), "big")
            block += 1
        return out & ((1 << bits) - 1)

    def _walk(self, kind: str, n: int, x: int, rounds: list[int]) -> int:
        if n < 2:
            return x
        bits = max(1, (n - 1).bit_length() + 1 >> 1)
        mask = (1 << bits) - 1
        back = rounds[0] > rounds[-1]
        while True:
            left, right = x >> bits, x & mask
            for i in rounds:
                if back:
                    left, right = right ^ self._round(kind, n, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(kind, n, i, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def forward(self, kind: str, n: int, x: int) -> int:
        return self._walk(kind, n, x, list(range(ROUNDS)))

    def backward(self, kind: str, n: int, x: int) -> int:
        return self._walk(kind, n, x, list(range(ROUNDS))[::-1])


Turn = Callable[[str, int, int], int]  # forward or backward
Found = tuple[int, int, str]  # start, end, pseudonym


@cache
def _letters(block: int, category: str) -> str:
    return "".join(c for c in map(chr, range(block << 8, block + 1 << 8)) if unicodedata.category(c) == category and ord(c) > 127)


def other_letters(c: str) -> str:
    """The letters or digits beyond ASCII of c's category and block of 256 code points; nothing for other characters."""
    return _letters(ord(c) >> 8, unicodedata.category(c)) if c > "\x7f" and c.isalnum() else ""


def permute_chars(value: str, kind: str, turn: Turn, other: Callable[[str], str] = lambda c: "") -> str:
    """Permutes digits among digits, letters among letters of their case and others among what `other` has for them; the rest stays."""
    sets = [next((s for s in (DIGITS, LOWER, UPPER) if c in s), "") or other(c) for c in value]
    n, x = 1, 0
    for c, s in zip(value, sets, strict=True):
        if s:
            n, x = n * len(s), x * len(s) + s.index(c)
    x = turn(kind + "|" + "".join(str(len(s)) + "," for s in sets if s), n, x)
    out = list(value)
    for k in range(len(value) - 1, -1, -1):
        if sets[k]:
            x, r = divmod(x, len(sets[k]))
            out[k] = sets[k][r]
    return "".join(out)


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _spread(digits: str, like: str) -> str:
    """digits put where `like` has its digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


#: How the digits of a card are grouped where more digits (an expiry date, a check value) follow.
CARD_GROUPS = [(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))]


def _card_groups(sizes: list[int], digits: list[str], whole: bool) -> tuple[int, int] | None:
    """The groups i..j-1 of a run, or of what is left of it, that are a card: where several are, the first and shortest.

    A card may begin the run, or come after a group that is too short to be part of one; what a run has as a whole may
    be grouped in any way.
    """
    for i in range(len(sizes)):
        if i == 0 or sizes[i - 1] < 4:
            for layout in CARD_GROUPS:
                j = i + len(layout)
                if tuple(sizes[i:j]) == layout and _is_card("".join(digits[i:j])):
                    return i, j
    return (0, len(sizes)) if whole and len(sizes) <= 19 and _is_card("".join(digits)) else None


def cards(text: str, turn: Turn) -> Iterator[Found]:
    for run in CARD_RUN.finditer(text):
        spans = [g.span() for g in DIGIT_GROUP.finditer(text, *run.span())]
        digits, sizes, whole = [text[a:b] for a, b in spans], [b - a for a, b in spans], True
        while (at := _card_groups(sizes, digits, whole)) is not None:
            i, j = at
            new = "".join(digits[i:j])
            near = len(sizes) if whole and len(sizes) <= 19 else j + 5  # no card from a group before i ends beyond
            while True:  # walk on to a card that is found at the same place, so that it can be turned back
                body = new[0] + permute_chars(new[1:-1], "card", turn)
                new = body + luhn_digit(body)
                cut = iter(new)
                later = digits[:i] + ["".join(next(cut) for _ in g) for g in digits[i:j]] + digits[j:near]
                if _card_groups(sizes[:near], later, whole) == at:
                    break
            a, b = spans[i][0], spans[j - 1][1]
            yield a, b, _spread(new, text[a:b])
            spans, digits, sizes, whole = spans[j:], digits[j:], sizes[j:], False


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


#: The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def ibans(text: str, turn: Turn) -> Iterator[Found]:
    """Each is cut to the length of its country, so that words after it don't hide it; countries without one have no IBAN."""
    for m in IBAN_START.finditer(text):
        country, a = m[0], m.start()
        need = IBAN_LENGTHS.get(country, 0)
        b, held = a, []
        while b < len(text) and len(held) < need:
            c = text[b]
            if c in DIGITS or c in UPPER:
                held.append(c)
            elif c != " " or text[b - 1] == " ":
                break
            b += 1
        flat = "".join(held)
        if not need or len(flat) < need or b < len(text) and text[b].isalnum() and text[b].isascii() or _iban_check(country, flat[4:]) != flat[2:4]:
            continue
        body = permute_chars(flat[4:], "iban" + country, turn)
        it = iter(country + _iban_check(country, body) + body)
        yield a, b, "".join(c if c == " " else next(it) for c in text[a:b])


def ipv4(value: str, turn: Turn) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if any(p > 255 for p in parts):
        return None
    x = turn("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, x.to_bytes(4, "big")))


def _phone_class(number: str) -> tuple[bool, ...]:
    """What a number's pseudonym has to share with it. Of ten digits: whether area and exchange begin with 2 to 9, as they do
    in North American numbers, and aren't a service code like 911; else whether the number begins with 0."""
    if len(number) != 10:
        return (number[:1] == "0",)
    area, exchange = number[:3], number[3:6]
    return area[0] in "23456789", exchange[0] in "23456789", area[1:] == "11", exchange[1:] == "11"


def phone(value: str, turn: Turn) -> str | None:
    """The country code stays; the rest is permuted within the numbers that are as valid as it is."""
    if not 8 <= sum(c.isdigit() for c in value) <= 15:
        return None
    head = re.match(r"\+\d{1,3}(?=\D)|\+\d\d?", value)
    cut = head.end() if head else 0
    old = _phone_class(re.sub(r"\D", "", value[cut:]))
    new = value[cut:]
    while True:
        new = permute_chars(new, "phone", turn)
        if _phone_class(re.sub(r"\D", "", new)) == old:
            return value[:cut] + new


def ssn(value: str, turn: Turn) -> str | None:
    area, group, serial = value.split("-")
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return None
    areas = 898  # 001-899 without 666
    a = int(area) - 1 - (int(area) > 666)
    x = turn("ssn", areas * 99 * 9999, (a * 99 + int(group) - 1) * 9999 + int(serial) - 1)
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(value: str, turn: Turn) -> str | None:
    m = re.fullmatch(r"(\d{4})([-/.])(\d{2})\2(\d{2})", value)
    n = None if m else re.fullmatch(r"(\d{2})([-/.])(\d{2})\2(\d{4})", value)
    if not m and not n:
        return None
    y, mo, d, sep = (int(m[1]), int(m[3]), int(m[4]), m[2]) if m else (int(n[4]), int(n[3]), int(n[1]), n[2])
    swapped = False
    if n and mo > 12 >= d:  # month first
        mo, d, swapped = d, mo, True
    try:
        day = datetime.date(y, mo, d).toordinal()
    except ValueError:
        return None
    if not FIRST <= day <= LAST:
        return None
    kind = "date" + ("m" if swapped else "")
    # written month first is told by a day over 12: walk on to a day whose written form reads the same way
    x = day - FIRST
    while True:
        x = turn(kind, LAST - FIRST + 1, x)
        new = datetime.date.fromordinal(FIRST + x)
        if m or not swapped or new.day > 12:
            break
    if m:
        return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
    return f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year:04d}" if swapped else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"


#: Letters and digits of any script on both sides.
EMAIL = re.compile(r"(?<![\w.+-])[^\W_](?:[\w.+-]{0,62}[\w+-])?@(?:[^\W_](?:(?:[^\W_]|-){0,61}[^\W_])?\.)+[^\W\d_]{2,24}")
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
CLOSING = ".,;:!?)]}>\"'"  # marks that close a sentence or bracket after a value
BLOCK = 512  # longer secrets are permuted block by block, each with a permutation of its own: linear in their length


def email(value: str, turn: Turn) -> str | None:
    local, _, domain = value.rpartition("@")
    return f"{permute_chars(local, 'email@' + domain.lower(), turn, other_letters)}@{domain}"


def access_key(value: str, turn: Turn) -> str | None:
    body = value[4:]
    base = DIGITS + UPPER
    x = 0
    for c in body:
        x = x * 36 + base.index(c)
    x, out = turn("access-key", 36 ** len(body), x), []
    for _ in body:
        x, r = divmod(x, 36)
        out.append(base[r])
    return value[:4] + "".join(reversed(out))


def secret(value: str, turn: Turn) -> str | None:
    """None for what is an e-mail address or access-key id as a whole; marks after the value stay."""
    value, after = (v := value.rstrip(CLOSING)), value[len(v) :]
    if EMAIL.fullmatch(value) or ACCESS_KEY.fullmatch(value) or not any(map(str.isalnum, value)):
        return None
    hexes = "0123456789abcdef" if re.fullmatch(r"[0-9a-f]+", value) else "0123456789ABCDEF" if re.fullmatch(r"[0-9A-F]+", value) else ""
    out = []
    for at in range(0, len(value), BLOCK):
        part, kind = value[at : at + BLOCK], f"|{at}" if at else ""
        if not hexes or value.isdigit():
            out.append(permute_chars(part, "secret" + kind, turn, other_letters))
        else:
            out.append(f"{turn('hex' + hexes[-1] + kind, 16 ** len(part), int(part, 16)):0{len(part)}{'x' if hexes[-1] == 'f' else 'X'}}")
    return "".join([*out, after])


SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}(?:(?P<q>[\"'])|(?![\"']))(?P<v>(?:(?(q)(?!(?P=q)))\S){8,})")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}(?=\d{2})")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
CARD_RUN = re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,}(?![\w-])")
DIGIT_GROUP = re.compile("[0-9]+")
DATE = re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\w/-]|\.\d)")
IPV4 = re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w-])")


def each(pattern: re.Pattern, change: Callable[[str, Turn], str | None]) -> Callable[[str, Turn], Iterator[Found]]:
    """A finder of the pattern's matches (of its group v, where it has one) that `change` takes as valid."""
    group = "v" if "v" in pattern.groupindex else 0

    def find(text: str, turn: Turn) -> Iterator[Found]:
        for m in pattern.finditer(text):
            if (new := change(m[group], turn)) is not None:
                yield *m.span(group), new

    return find


#: kind, finder. Earlier kinds win where findings overlap.
KINDS: list[tuple[str, Callable[[str, Turn], Iterator[Found]]]] = [
    ("secret", each(SECRET, secret)),
    ("email", each(EMAIL, email)),
    ("access_key", each(ACCESS_KEY, access_key)),
    ("iban", ibans),
    ("ssn", each(SSN, ssn)),
    ("card", cards),
    ("date", each(DATE, date)),
    ("ipv4", each(IPV4, ipv4)),
    ("phone", each(PHONE, phone)),
]
#: A text with neither has nothing to find.
HINT = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)\s{0,3}[=:]")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.turns = Permutation(key)

    def apply(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
        """New text and findings (kind, start, end in the old text, pseudonym)."""
        if not HINT.search(text):
            return text, []
        turn = self.turns.backward if back else self.turns.forward
        taken: list[tuple[int, int, str, str]] = []
        busy = bytearray(len(text))  # what earlier kinds hold
        for kind, find in KINDS:
            for a, b, new in find(text, turn):
                if busy.find(1, a, b) < 0:
                    busy[a:b] = b"\1" * (b - a)
                    taken.append((a, b, kind, new))
        out, at = [], 0
        taken.sort()
        for a, b, _, new in taken:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), [(kind, a, b, new) for a, b, kind, new in taken]


FOUND = "array<struct<kind:string,start:int,end:int,pseudonym:string>>"


def pseudonymize(docs: DataFrame, key: str, text: str = "text", findings: str = "pii", back: bool = False) -> DataFrame:
    """docs with the text pseudonymised and a findings column (spans in code points of the old text). back inverts it."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def start():
        apply = Pseudonyms(key.encode()).apply

        def work(values: list) -> dict[str, pa.Array]:
            done = [(None, []) if t is None else apply(t, back) for t in values]
            return {text: pa.array([x for x, _ in done], pa.string()), findings: pa.array([[dict(zip(("kind", "start", "end", "pseudonym"), f, strict=True)) for f in found] for _, found in done], kind)}

        return work

    rows = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    return map_column(rows, text, start, f"`{text}` string, `{findings}` {FOUND}").select(*(f"`{c}`" for c in docs.columns if c != findings), f"`{findings}`")
