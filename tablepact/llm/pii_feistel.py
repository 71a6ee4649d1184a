"""PII pseudonyms that keep their format: keyed Feistel permutations of validated values.

Found and validated: e-mail addresses, telephone numbers, payment cards (Luhn), IBANs (mod 97),
IPv4 addresses, social security numbers, calendar dates, and quoted secrets after a name
such as ``token =``.  A value is read as a number in the set of all values of its format
(digits, letters of either case, days of 1900-2099, 32-bit addresses), permuted there by
a Feistel network keyed by the secret, the kind and the format, walked until it falls
into the set, and written back in the same layout; check digits are computed anew.  The map is
one-to-one, so equal values stay equal and different ones different in every document, and
``restore`` inverts it.

A map over the documents: no shuffle.  Defined cases: null text stays null, without
findings; a number that fails its check is left as it is; dates have one or two digits for day and
month, a year of four first or last, and are read day first if that gives a date, else month first; cards and IBANs are looked for at all
group edges of a longer stretch of digits or capitals (a valid one in a printed layout before
others), cards outside the other findings; overlapping findings are taken
from the left, by the order of ``KINDS`` where they start together; repeated rows
give equal rows; other columns are ignored.  A card or IBAN whose pseudonym would make a preferred place
of its stretch valid gets another one there, so that ``restore`` finds it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import in_worker

KEY = "tablepact-demo-key"
ROUNDS = 8


# --- permutation ------------------------------------------------------------------


class Permutation:
    """Keyed one-to-one map of 0 … size-1, by a balanced Feistel network with cycle walking."""

    def __init__(self, key: str, tweak: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.bytes = (self.half + 7) // 8
        self.keys = [blake2b(f"{tweak}|{size}|{r}".encode(), key=blake2b(key.encode(), digest_size=32).digest(), digest_size=16).digest()
                     for r in range(ROUNDS)]

    def mix(self, key: bytes, value: int) -> int:
        out, block = b"", 0
        while len(out) < self.bytes:
            out += blake2b(value.to_bytes(self.bytes, "big") + bytes([block]), key=key, digest_size=min(64, max(8, self.bytes))).digest()
            block += 1
        return int.from_bytes(out[: self.bytes], "big") & self.mask

    def turn(self, value: int, back: bool) -> int:
        left, right = value >> self.half, value & self.mask
        if back:
            for k in reversed(self.keys):
                left, right = right ^ self.mix(k, left), left
        else:
            for k in self.keys:
                left, right = right, left ^ self.mix(k, right)
        return left << self.half | right

    def __call__(self, value: int, back: bool = False) -> int:
        value = self.turn(value, back)
        while value >= self.size:
            value = self.turn(value, back)
        return value


def by_characters(text: str, key: str, tweak: str, back: bool, hexadecimal: bool = False) -> str:
    """Permute digits among digits and letters among letters of their case; the rest stays."""
    alphabets = ("0123456789abcdef", "0123456789ABCDEF") if hexadecimal else ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    own = [next((a for a in alphabets if c in a), "") for c in text]
    size, value = 1, 0
    for c, a in zip(text, own):
        if a:
            size, value = size * len(a), value * len(a) + a.index(c)
    if size < 2:
        return text
    layout = "".join({10: "9", 16: "h", 26: "a" if a[:1] == "a" else "A"}.get(len(a), c) for c, a in zip(text, own))
    value = Permutation(key, f"{tweak}|{layout}", size)(value, back)
    out = []
    for c, a in zip(reversed(text), reversed(own)):
        if a:
            value, digit = divmod(value, len(a))
            c = a[digit]
        out.append(c)
    return "".join(reversed(out))


# --- kinds of values --------------------------------------------------------------


def luhn(digits: str) -> int:
    """Check digit of a card number without its last digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def put_digits(layout: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def email(text: str, key: str, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    names, _, top = domain.rpartition(".")
    return f"{by_characters(local, key, 'local', back)}@{by_characters(names, key, 'domain', back)}.{top}"


def is_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1


def card(text: str, key: str, back: bool) -> str:
    body = by_characters(re.sub(r"\D", "", text)[:-1], key, "card", back)
    return put_digits(text, body + str(luhn(body)))


def is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]


def iban(text: str, key: str, back: bool) -> str:
    plain = text.replace(" ", "")
    country, account = plain[:2], by_characters(plain[4:], key, f"iban {plain[:2]}", back)
    it = iter(country + iban_check(country, account) + account)
    return "".join(c if c == " " else next(it) for c in text)


#: Group lengths in which cards are printed; unbroken numbers and these are preferred to others.
CARD_GROUPS = {(4, 4, 4, 4): 1, (4, 6, 5): 2, (4, 6, 4): 2, (4, 4, 5): 2, (4, 3, 3, 3): 2, (4, 4, 4, 4, 3): 3}


def sub_runs(text: str, group: str, least: int, most: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(start, end, group lengths) of the stretches of whole groups with ``least`` to ``most`` characters."""
    groups = [m.span() for m in re.finditer(group, text)]
    for i, (start, _) in enumerate(groups):
        lengths, total = [], 0
        for s, end in groups[i : i + most]:
            lengths.append(end - s)
            total += end - s
            if total > most:
                break
            if total >= least:
                yield start, end, tuple(lengths)


def card_places(text: str) -> list[tuple[int, int]]:
    """Where a card may lie in a stretch of digit groups, best layout first; the digits' values don't matter."""
    found = [((0 if len(lengths) == 1 else CARD_GROUPS.get(lengths, 4), len(set(re.findall(r"\D", text[start:end]))), start, -end), start, end)
             for start, end, lengths in sub_runs(text, r"\d+", 13, 19)]
    return [(start, end) for _, start, end in sorted(found)]


def iban_places(text: str) -> list[tuple[int, int]]:
    """Where an IBAN may lie in a stretch of groups of capitals and digits, groups of four first, long ones first."""
    found = [((any(n != 4 for n in lengths[:-1]) or lengths[-1] > 4 < sum(lengths[:-1]), start, -end), start, end)
             for start, end, lengths in sub_runs(text, r"[A-Z0-9]+", 15, 34) if re.match(r"[A-Z]{2}\d{2}", text[start:end])]
    return [(start, end) for _, start, end in sorted(found)]


def rewrite_places(text: str, places: list[tuple[int, int]], valid: Callable[[str], bool], turn: Callable[[str], str], back: bool) -> list[tuple[int, int, str]]:
    """(start, end, new value) of the values in a stretch: valid places, the best first, that overlap no better one.

    A new value is permuted on while it makes a better place valid, so the rewritten stretch has its
    values in the same places.  Each step is one-to-one on the values that keep the places with the
    rest of the stretch as it is; ``back`` takes the steps in reverse.
    """
    none = len(places)
    holder = [none] * len(text)  # rank of the chosen place at each character
    chosen = []
    for rank, (start, end) in enumerate(places):
        if min(holder[start:end]) == none and valid(text[start:end]):
            holder[start:end] = [rank] * (end - start)
            chosen.append(rank)
    by_start = sorted((start, end, rank) for rank, (start, end) in enumerate(places))
    widest = max((end - start for start, end in places), default=0)
    new = text
    for rank in reversed(chosen) if back else chosen:
        start, end = places[rank]
        near = by_start[bisect_left(by_start, (start - widest,)) : bisect_left(by_start, (end,))]
        better = [(s, e) for s, e, r in near if r < rank and e > start and min(holder[s:e]) > r]
        while True:
            new = new[:start] + turn(new[start:end]) + new[end:]
            if valid(new[start:end]) and not any(valid(new[s:e]) for s, e in better):
                break
    return [(*places[rank], new[slice(*places[rank])]) for rank in sorted(chosen)]


def cards(text: str, key: str, back: bool) -> list[tuple[int, int, str]]:
    return rewrite_places(text, card_places(text), is_card, lambda t: card(t, key, back), back)


def ibans(text: str, key: str, back: bool) -> list[tuple[int, int, str]]:
    return rewrite_places(text, iban_places(text), is_iban, lambda t: iban(t, key, back), back)


def address(text: str, key: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = Permutation(key, "ipv4", 1 << 32)(int.from_bytes(bytes(map(int, parts)), "big"), back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def social(text: str, key: str, back: bool) -> str | None:
    area, group, serial = (int(p) for p in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = 898  # 1 … 899 without 666
    place = area - 1 - (area > 666)
    value = Permutation(key, "ssn", areas * 99 * 9999)((place * 99 + group - 1) * 9999 + serial - 1, back)
    value, serial = divmod(value, 9999)
    place, group = divmod(value, 99)
    return f"{place + 1 + (place >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def day(text: str, key: str, back: bool) -> str | None:
    """Year first, day first, or month first where the day-first reading is no date.

    The new date is one that the layout can hold (a part of one digit is below 10) and that is read
    the same way: a month-first one has a day above 12.
    """
    texts = re.findall(r"\d+", text)
    year_first = len(texts[0]) == 4
    year, one, two = texts if year_first else (texts[2], *texts[:2])
    month_first = not year_first and int(two) > 12
    month, number = (one, two) if year_first or month_first else (two, one)
    try:
        found = date(int(year), int(month), int(number))
    except ValueError:
        return None
    if not FIRST_DAY <= found <= LAST_DAY:
        return None
    permuted = Permutation(key, "date month first" if month_first else "date", (LAST_DAY - FIRST_DAY).days + 1)
    moved = (found - FIRST_DAY).days
    while True:
        moved = permuted(moved, back)
        new = FIRST_DAY + timedelta(days=moved)
        if (len(month) == 2 or new.month < 10) and (len(number) == 2 or new.day < 10) and (not month_first or new.day > 12):
            break
    new_month, new_number = f"{new.month:0{len(month)}d}", f"{new.day:0{len(number)}d}"
    parts = f"{new.year:04d}{new_month}{new_number}" if year_first else f"{new_month}{new_number}{new.year:04d}" if month_first else f"{new_number}{new_month}{new.year:04d}"
    return put_digits(text, parts)


def phone(text: str, key: str, back: bool) -> str | None:
    prefix = re.match(r"\+\d{1,3}[ .-]?", text)
    at = prefix.end() if prefix else 0
    if not 7 <= sum(c.isdigit() for c in text[at:]) <= 12:
        return None
    return text[:at] + by_characters(text[at:], key, "phone", back)


def secret(text: str, key: str, back: bool) -> str | None:
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    return by_characters(text, key, "secret", back, hexadecimal)


#: (kind, pattern, rewriting); in this order where two start at one place.  Cards and IBANs: a stretch
#: of groups that may hold values, and the rewriting of all in it.
KINDS: tuple[tuple[str, str, Callable[[str, str, bool], str | list[tuple[int, int, str]] | None]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("secret", r"(?i:(?<=token = \")|(?<=token=\")|(?<=secret = \")|(?<=api_key = \")|(?<=password = \"))[A-Za-z0-9+/_-]{16,}(?=\")", secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,}", ibans),
    ("card", r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){12,}", cards),
    ("date", r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?:(?=[Tt]\d)|(?![\w/-]))", day),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", social),
    ("ipv4", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", address),
    ("phone", r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", phone),
)
NAMES = tuple(k[0] for k in KINDS)
#: For a kind found in stretches: a group, and what may not stand before the first and behind the last group.
STRETCHES = {"iban": (re.compile(r"[A-Z0-9]+"), re.compile(r"[A-Za-z0-9]"), re.compile(r"[A-Za-z0-9]")),
             "card": (re.compile(r"\d+"), re.compile(r"[\w.+-]"), re.compile(r"[\w-]"))}


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans joined, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            start, end = out[-1][0], max(end, out.pop()[1])
        out.append((start, end))
    return out


class Pseudonymiser:
    def __init__(self, key: str):
        self.key = key
        self.kinds = [(name, re.compile(pattern), rewrite) for name, pattern, rewrite in KINDS]
        self.number = re.compile(r"\d")
        self.known: dict[tuple[str, str, bool], str | list[tuple[int, int, str]] | None] = {}

    def rewrite(self, name: str, function, value: str, back: bool) -> str | list[tuple[int, int, str]] | None:
        key = (name, value, back)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = function(value, self.key, back)
        return self.known[key]

    def parts(self, name: str, text: str, stretch: re.Match, taken: list[tuple[int, int]]) -> Iterator[tuple[int, str]]:
        """(start, text) of the runs of a stretch's groups that stand free and outside ``taken``."""
        group, before, behind = STRETCHES[name]
        start = end = None
        for g in group.finditer(text, stretch.start(), stretch.end()):
            s, e = g.span()
            last = bisect_left(taken, (e,)) - 1  # the last that starts before the group's end
            free = not (s == stretch.start() and s and before.match(text, s - 1) or e == stretch.end() and behind.match(text, e)
                        or last >= 0 and taken[last][1] > s)
            if free:
                start, end = s if start is None else start, e
            elif start is not None:
                yield start, text[start:end]
                start = None
        if start is not None:
            yield start, text[start:end]

    def __call__(self, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(NAMES, 0)
        has_number = self.number.search(text) is not None
        if not has_number and "@" not in text and '"' not in text:
            return text, counts
        found = []
        # cards last: digits of other kinds' values belong to no card
        for rank, (name, pattern, function) in sorted(enumerate(self.kinds), key=lambda k: k[1][0] == "card"):
            if name == "email" and "@" not in text or name == "secret" and '"' not in text or name not in ("email", "secret") and not has_number:
                continue
            taken = merged((f[0], f[2]) for f in found) if name == "card" else []
            for m in pattern.finditer(text):
                if name in STRETCHES:
                    for at, part in self.parts(name, text, m, taken):
                        found += [(at + start, rank, at + end, name, new) for start, end, new in self.rewrite(name, function, part, back)]
                    continue
                new = self.rewrite(name, function, m.group(), back)
                if new is not None:
                    found.append((m.start(), rank, m.end(), name, new))
        out, at = [], 0
        for start, _, end, name, new in sorted(found):
            if start >= at:
                out += [text[at:start], new]
                at, counts[name] = end, counts[name] + 1
        return "".join([*out, text[at:]]), counts


def pseudonym_column(text: Column, key: str = KEY, back: bool = False) -> Column:
    """struct(text, n_<kind>…) for each text."""

    def rewrite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        change, none = Pseudonymiser(key), dict.fromkeys(NAMES, 0)
        for column in batches:
            new, counts = [], {n: [] for n in NAMES}
            for at in range(0, len(column), 512):
                in_worker()
                for t in column.slice(at, 512).to_pylist():
                    text, found = (None, none) if t is None else change(t, back)
                    new.append(text)
                    for n in NAMES:
                        counts[n].append(found[n])
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), *[pa.array(counts[n], pa.int32()) for n in NAMES]],
                                             ["text", *[f"n_{n}" for n in NAMES]])

    schema = "text string, " + ", ".join(f"n_{n} int" for n in NAMES)
    return F.arrow_udf(rewrite, schema)(text)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_<kind>…): every document with its personal values replaced."""
    return docs.select("doc_id", pseudonym_column(F.col("text"), key).alias("p")).select("doc_id", "p.*")


def restore(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The inverse of ``pseudonymise`` on the rewritten values."""
    return docs.select("doc_id", pseudonym_column(F.col("text"), key, back=True).alias("p")).select("doc_id", "p.text")
