"""Surrogates for personal data and secrets.

Detected entities get replacements that depend on a key and the entity alone, so
every mention in every document gets the same one (coreference). Numbers,
addresses and secrets go through a keyed permutation of all strings of their
format, a Feistel network with cycle walking, so two entities of one format
never meet; check digits, country codes, private address ranges and the places
of separators stay right for each mention. Names get a first name of the same
gender and script and a surname of the same script.

Where the entities are more than a quarter of all strings of their format, every
one keeps a permutation without fixed points of the whole format, and a
surrogate may be another entity. Names have no format to use up: each new draw is
longer.

What a permutation cannot exclude (two names with one surrogate, a surrogate
that is itself an entity of the corpus) is checked over the table of distinct
entities: all but one of each clashing set are drawn again with the next nonce
until no clash is left. Entities with a nonce above 0 go to the documents that
mention them by a join, which Spark turns into a broadcast only if that table
is small; all others are replaced where they are found, without a shuffle.

No entity is ever written in the clear: scratch tables hold it under a keyed
deterministic cipher, so equal entities still join, and all but the table of
redrawn surrogates are deleted before the result is returned.

Defined results: a secret without any letter or digit becomes letters of the
same length; a key block without any is no entity; a null text stays null with
no entities; texts without entities stay as they are; rows with equal or null
ids are handled each by itself; columns named n_entities and entity_kinds are
replaced, other columns pass unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

FIXED = "__pii_fixed"
#: The nonce of entities whose format is too full to draw again.
FULL, FULL_NONCE = "full", 1 << 30
#: Characters of a string that are permuted together; a longer one is a chain of such pieces.
PIECE = 128

# Given names by script and gender, surname beginnings and ends by script.
FIRST = {
    ("latin", "f"): "Anna Clara Diana Elena Flora Greta Helen Irene Julia Laura Marta Nora Olga Paula Rosa Sara Tina Vera Wilma Zoe".split(),
    ("latin", "n"): "Alex Andrea Charlie Dominique Jamie Jessie Kim Kris Morgan Nicola Robin Sam Sascha Toni".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul Robert Simon Tom Viktor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Зоя Ирина Мария Нина Ольга Юлия".split(),
    ("cyrillic", "n"): "Валя Женя Саша Слава Шура".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Максим Олег Павел Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ιρίνα Μαρία Νίκη Σοφία Χλόη".split(),
    ("greek", "n"): "Άλεξ Βάλια Χάρις".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δήμος Κώστας Νίκος Πέτρος Σπύρος Φίλιππος".split(),
}
SURNAME = {
    "latin": ("Ba Be Bo Da De Do Fa Fe Ga Ha He Ka Ko La Le Lo Ma Me Mo Na Ne Pa Pe Ra Ro Sa Se Ta Te Va".split(), "ber den der gan kel land lin man mer nau ner rik sen ser ström tin ton vall win zer".split()),
    "cyrillic": ("Ба Бе Ва Га Де За Ка Ле Ма Не Па Ра Са Та Фе".split(), "бин гов дин ков лев лин мов нин ров тин".split()),
    "greek": ("Βα Γα Δα Κα Λα Μα Νι Πα Σα Τα".split(), "δάκης κάς λίδης μάς νός πουλος ράς τζής".split()),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Señorita Г-жа Κυρία".split(),
    "m": "Mr Herr Monsieur Señor Sr Г-н Κύριος".split(),
    "n": "Dr Prof Mx Д-р Δρ".split(),
}
GENDER = {t.lower(): g for g, names in TITLES.items() for t in names}
#: A title without gender takes that of a given name that is known.
KNOWN = {name.lower(): g for (_, g), names in FIRST.items() for name in names}

#: Words after which two capitalised words are a name, those that need a colon, and what no name begins with.
CUES = "Contact Attn Dear Regards Sincerely Ansprechpartner Kontakt Contacto".split()
FIELDS = "From To Name Author Signed Nom Nombre".split()
NO_NAME = "All Customer Dept Information Me Our Sales Sir Support Team The Us Your".split()

_WORD = r"[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_PATTERNS = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----"),
    ("secret", r"(?i:\b(?:token|api[_-]?key|access[_-]?key|secret|password|passwd|pwd))\s*[=:]\s*[\"']?(?P<secret>[^\s\"']{8,})"),
    ("secret", r"\b(?P<secret2>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})\b"),
    ("email", r"(?P<email>[\w.%+-]+@(?:[\w-]+\.)+[^\W\d_]{2,})"),
    ("iban", r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"),
    ("ipv6", r"(?<![\w:.])(?P<ipv6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])"),
    ("ipv4", r"(?<![\w.])(?P<ipv4>(?:\d{1,3}\.){3}\d{1,3})(?!\w|\.\d)"),
    ("phone", r"(?<!\w)(?P<phone>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d(?:[ .-]\d{2}){4})(?!\w)"),
    ("ssn", r"(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"),
    ("card", r"(?<!\w)(?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"),
    ("name", rf"(?P<title>\b(?:{'|'.join(sorted((t for n in TITLES.values() for t in n), key=len, reverse=True))}))(?P<gap>\.? +)(?P<name>{_WORD}(?: {_WORD})?)"),
    ("name", rf"\b(?:(?:{'|'.join(CUES)})[:,]?|(?:{'|'.join(FIELDS)}):) +(?!(?:{'|'.join(NO_NAME)})\b)(?P<name2>{_WORD} {_WORD})"),
]
_ALL = re.compile("|".join(f"(?P<p{i}>{p})" for i, (_, p) in enumerate(_PATTERNS)))
_MAYBE = re.compile(r"[\d@]|[A-Fa-f]:[A-Fa-f]")
_TITLED = [t + s for n in TITLES.values() for t in n for s in (" ", ". ")] + [t + s for t in CUES for s in (" ", ": ", ", ")] + [t + ": " for t in FIELDS]
_KEYWORD = r"(?i:\b(?:token|api[_-]?key|access[_-]?key|secret|password|passwd|pwd))"
#: A secret whose word, sign and value stand on more than one line.
_ACROSS = re.compile(_KEYWORD + r"(?P<gap>\s*[=:]\s*)(?=[^\s])")
_KEY_BLOCK = re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)([\s\S]*?)(-----END [A-Z ]*PRIVATE KEY-----)")
_SECRET_WORDS = ("token", "key", "secret", "passw", "pwd", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "akia")


def _digits(s: str) -> str:
    """The decimals of any script, as ASCII digits."""
    return "".join(str(int(c)) for c in s if c.isdecimal())


def _ascii(s: str) -> str:
    return s if s.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in s)


def _in_script(digit: str, like: str) -> str:
    """The digit in the script of another."""
    return chr(ord(like) - int(like) + int(digit))


def _luhn(digits: str) -> int:
    """The check digit that would follow these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def detect(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of each mention; the entity is the same for all ways to write it.

    Every kind but key blocks lies within a line, or within the lines that a
    word for secrets and its value stand on, and has a digit of any script, an
    @, a colon between hexadecimal letters, a title or cue, or a word for
    secrets, so the patterns run on the lines that have one.
    """
    titles, low = [t for t in _TITLED if t in text], text.casefold()
    secrets = [w for w in _SECRET_WORDS if w in low]
    if "-----BEGIN" in text:
        yield from _mentions(text)
        return
    if not titles and not secrets and not _MAYBE.search(text):
        return
    at = 0
    for line in _lines(text, bool(secrets)):
        if _MAYBE.search(line) or any(t in line for t in titles) or (secrets and any(w in line.casefold() for w in secrets)):
            for a, b, kind, entity in _mentions(line):
                yield at + a, at + b, kind, entity
        at += len(line) + 1


def _lines(text: str, secrets: bool) -> list[str]:
    """The lines of a text; those that one secret stands on are one."""
    lines = text.split("\n")
    if not secrets or len(lines) == 1:
        return lines
    glued = [(m.start(), m.end()) for m in _ACROSS.finditer(text) if "\n" in m["gap"]]
    if not glued:
        return lines
    out, at, k = [], 0, 0
    for line in lines:
        while k < len(glued) and glued[k][1] < at:
            k += 1
        if out and k < len(glued) and glued[k][0] < at:
            out[-1] += "\n" + line
        else:
            out.append(line)
        at += len(line) + 1
    return out


def _mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _ALL.finditer(text):
        kind = next(k for i, (k, _) in enumerate(_PATTERNS) if m[f"p{i}"] is not None)
        if kind == "pem":
            if any(len(_alike(c)) > 1 for c in _KEY_BLOCK.fullmatch(m[0])[2]):
                yield m.start(), m.end(), kind, m[0]
            continue
        group = "secret2" if kind == "secret" and m["secret"] is None else "name2" if kind == "name" and m["name"] is None else kind
        a, b = m.span(group)
        raw = m[group]
        if kind == "email":
            yield a, b, kind, raw.lower()
        elif kind == "ipv4":
            parts = [int(x) for x in raw.split(".")]
            if max(parts) < 256:
                yield a, b, kind, ".".join(map(str, parts))
        elif kind == "ipv6":
            if "::" in raw:
                # Scope operators of programs look alike; an address has digits and three groups at least.
                if sum(bool(x) for x in raw.split(":")) < 3 or not any(c.isdecimal() for c in raw):
                    continue
                try:
                    raw = ipaddress.IPv6Address(raw).exploded
                except ValueError:
                    continue
            yield a, b, kind, ":".join(f"{int(x, 16):04x}" for x in raw.split(":"))
        elif kind == "iban":
            plain = _ascii(raw.replace(" ", ""))
            if 15 <= len(plain) <= 34 and _mod97(plain) == 1:
                yield a, b, kind, plain
        elif kind == "phone":
            code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", raw)
            yield a, b, kind, f"{_ascii(code[0]) if code else ''}|{_digits(raw[code.end() if code else 0 :])}"
        elif kind in ("card", "ssn"):
            digits = _digits(raw)
            # Thirteen digits from 14... to 19... without a check digit count milliseconds since 1970.
            if kind == "ssn" or len(digits) != 13 or not "14" <= digits[:2] <= "19" or _luhn(digits[:-1]) == int(digits[-1]):
                yield a, b, kind, digits
        elif group == "name2":
            name = " ".join(raw.split()).lower()
            yield a, b, kind, f"{KNOWN.get(name.split()[0], 'n')}|{name}"
        elif kind == "name":
            gender, name = GENDER[m["title"].lower()], " ".join(raw.split()).lower()
            yield a, b, kind, f"{KNOWN.get(name.split()[0], 'n') if gender == 'n' else gender}|{name}"
        else:
            yield a, b, kind, raw


def _radix(s: str) -> list[str]:
    """The characters that may stand at each place of a string of the same format."""
    if re.fullmatch(r"(?=.*\d)(?=.*[a-fA-F])(?:[0-9a-f]{16,}|[0-9A-F]{16,})", s):
        return ["0123456789abcdef" if s == s.lower() else "0123456789ABCDEF"] * len(s)
    return [_alike(c) for c in s]


@functools.lru_cache(maxsize=1 << 16)
def _alike(c: str) -> str:
    """The characters of one class with c: digits, letters of one case and, beyond ASCII, of one run of 32 code points."""
    if c.isascii() or not c.isalpha():
        return next((r for r in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in r), c)
    base = ord(c) & ~31
    return "".join(x for x in map(chr, range(base, base + 32)) if not x.isascii() and x.isalpha() and (x.islower(), x.lower() == x) == (c.islower(), c.lower() == c))


def _private(n: int) -> int:
    """Bits that vary in the private range of an IPv4 address; 32 outside of them."""
    return next((b for base, b in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24)) if n >> b == base >> b), 32)


def space(kind: str, entity: str) -> tuple[str, float]:
    """(format, number of its strings): a permutation leads from each format into one format."""
    if kind == "name":
        return "", math.inf
    if kind == "ipv4":
        n = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        return f"{n >> _private(n)}/{_private(n)}", 2.0 ** _private(n)
    if kind == "ipv6":
        return "", 2.0**128
    if kind in ("card", "ssn", "phone"):
        code, _, digits = entity.rpartition("|")
        off = (int(digits[-1]) - _luhn(digits[:-1])) % 10 if kind == "card" else ""
        return f"{code}|{len(digits)}|{off}", 10.0 ** (len(digits) - (kind == "card"))
    fixed, rest = "", entity
    if kind == "email":
        rest, _, fixed = entity.rpartition("@")
    elif kind == "iban":
        fixed, rest = entity[:2], entity[4:]
    elif kind == "secret" and not any(len(_alike(c)) > 1 for c in entity):
        return f"masked{len(entity)}", 26.0 ** min(64, len(entity))
    elif kind == "secret" and (prefix := re.match(r"AKIA|gh[pousr]_|sk-|", entity)[0]):
        fixed, rest = prefix, entity[len(prefix) :]
    elif kind == "pem":
        return str(len(entity)), math.inf
    radix = _radix(rest)
    shape = "".join(r[0] if len(r) > 1 else r for r in radix) + ("" if len(set(radix)) > 1 or not radix else str(len(radix[0])))
    return f"{shape}@{fixed}", float(min(10**300, math.prod(len(r) for r in radix)))


class Surrogates:
    """Keyed surrogates of entities; the nonce picks another one where two clash."""

    def __init__(self, key: bytes):
        self.key = key

    def _number(self, *parts, bits: int = 256) -> int:
        """A keyed number of at least so many pseudorandom bits."""
        raw = "\x1f".join(hex(x) if isinstance(x, int) else str(x) for x in parts).encode("utf-8", "surrogatepass")
        inner = hmac.new(self.key, raw, hashlib.sha256).digest()
        out = [inner]
        for i in range(1, -(-bits // 256)):
            out.append(hmac.new(self.key, inner + i.to_bytes(4, "big"), hashlib.sha256).digest())
        return int.from_bytes(b"".join(out), "big")

    def permuted(self, x: int, size: int, *tweak) -> int:
        """A keyed permutation of range(size)."""
        if size < 2:
            return x
        if FULL in tweak:
            return self._feistel((self._feistel(x, size, tweak, False) + 1) % size, size, tweak, True)
        return self._feistel(x, size, tweak, False)

    def _feistel(self, x: int, size: int, tweak: tuple, back: bool) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in range(6):
                if back:
                    a, b = b ^ (self._number(*tweak, size, 5 - r, a, bits=half) & mask), a
                else:
                    a, b = b, a ^ (self._number(*tweak, size, r, b, bits=half) & mask)
            x = a << half | b
            if x < size:
                return x

    def letters(self, s: str, *tweak) -> str:
        """The string with its letters and digits permuted, each staying of its class.

        A long string goes piece by piece, each under the surrogate pieces before
        it: still a permutation of all strings of its format, in linear time.
        """
        if len(s) > PIECE:
            out, chain = [], hashlib.sha256()
            for i in range(0, len(s), PIECE):
                out.append(self.letters(s[i : i + PIECE], *tweak, i, chain.hexdigest()))
                chain.update(out[-1].encode("utf-8", "surrogatepass"))
            return "".join(out)
        radix = _radix(s)
        x, size = 0, 1
        for c, r in zip(s, radix, strict=True):
            x, size = x * len(r) + r.index(c), size * len(r)
        shape = "".join(r[0] if len(r) > 1 else r for r in radix)
        x = self.permuted(x, size, *tweak, shape)
        out = []
        for r in reversed(radix):
            x, d = divmod(x, len(r))
            out.append(r[d])
        return "".join(reversed(out))

    def of(self, kind: str, entity: str, nonce: int = 0) -> str:
        """The surrogate of an entity, in the entity's canonical form."""
        t = (kind, FULL if nonce == FULL_NONCE else nonce)
        if kind == "email":
            local, _, domain = entity.rpartition("@")
            labels = domain.split(".")
            return f"{self.letters(local, *t)}@{'.'.join([*(self.letters(x, 'domain', i) for i, x in enumerate(labels[:-1])), labels[-1]])}"
        if kind == "ipv4":
            n = int.from_bytes(bytes(map(int, entity.split("."))), "big")
            bits = _private(n)
            while True:
                n = n >> bits << bits | self.permuted(n & ((1 << bits) - 1), 1 << bits, *t, bits)
                if bits < 32 or _private(n) == 32:
                    return ".".join(map(str, n.to_bytes(4, "big")))
        if kind == "ipv6":
            n = self.permuted(int(entity.replace(":", ""), 16) & ((1 << 64) - 1), 1 << 64, *t)
            n = f"{self.permuted(int(entity.replace(':', '')[:16], 16), 1 << 64, *t, 'net'):016x}{n:016x}"
            return ":".join(n[i : i + 4] for i in range(0, 32, 4))
        if kind == "card":
            body, off = entity[:-1], (int(entity[-1]) - _luhn(entity[:-1])) % 10
            body = str(self.permuted(int(body), 10 ** len(body), *t, len(body))).zfill(len(body))
            return body + str((_luhn(body) + off) % 10)
        if kind == "ssn":
            return str(self.permuted(int(entity), 10**9, *t)).zfill(9)
        if kind == "phone":
            code, digits = entity.split("|")
            return f"{code}|{str(self.permuted(int(digits), 10 ** len(digits), *t, code, len(digits))).zfill(len(digits))}"
        if kind == "iban":
            body = self.letters(entity[4:], *t, entity[:2])
            check = 98 - _mod97(entity[:2] + "00" + body)
            return f"{entity[:2]}{check:02d}{body}"
        if kind == "name":
            gender, name = entity.split("|", 1)
            script = "cyrillic" if re.search("[а-яё]", name) else "greek" if re.search("[α-ωά-ώ]", name) else "latin"
            x = self._number(*t, entity)
            heads, ends = SURNAME[script]
            x, a = divmod(x, len(heads))
            x, b = divmod(x, len(ends))
            x, c = divmod(x, len(heads))
            # Each draw adds a syllable, so there is no number of entities that uses the names up.
            more = "".join(heads[self._number(*t, entity, i) % len(heads)].lower() for i in range(nonce))
            last = heads[a] + (heads[c].lower() if x & 1 else "") + more + ends[b]
            last += "а" * (script == "cyrillic" and gender == "f")
            firsts = FIRST[script, gender]
            return f"{gender}|{firsts[(x >> 1) % len(firsts)]} {last}".lower() if " " in name else f"{gender}|{last}".lower()
        if kind == "pem":
            begin, body, end = _KEY_BLOCK.fullmatch(entity).groups()
            return begin + self.letters(body, *t) + end
        if kind == "secret" and not any(len(_alike(c)) > 1 for c in entity):
            x = self._number(*t, "masked", entity, bits=6 * len(entity) + 64)
            return "".join("abcdefghijklmnopqrstuvwxyz"[x // 26**i % 26] for i in range(min(64, len(entity)))) + "x" * (len(entity) - 64)
        prefix = re.match(r"AKIA|gh[pousr]_|sk-|", entity)[0]
        return prefix + self.letters(entity[len(prefix) :], *t)


def written(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate in the way the mention is written: separators, letter case, spaces."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(surrogate.split("|")[-1])
        code = len(surrogate.split("|")[0]) if kind == "phone" else 0
        return mention[:code] + "".join(_in_script(next(digits), c) if c.isdecimal() else c for c in mention[code:])
    if kind == "iban":
        letters = iter(surrogate)
        made = [(c, c if c == " " else next(letters)) for c in mention]
        return "".join(_in_script(x, c) if c.isdecimal() and x.isdecimal() else x for c, x in made)
    if kind == "ipv4" and not mention.isascii():
        like = next(c for c in mention if c.isdecimal() and not c.isascii())
        return "".join(_in_script(c, like) if c.isdecimal() else c for c in surrogate)
    if kind == "name":
        name = surrogate.split("|", 1)[1]
        return name.upper() if mention.isupper() else name.title()
    if kind == "ipv6" and "::" in mention:
        surrogate = ipaddress.IPv6Address(surrogate).compressed
    if kind in ("email", "ipv6"):
        if mention[0].isupper() and not mention.isupper():
            return surrogate[0].upper() + surrogate[1:]
        return surrogate.upper() if mention.isupper() else surrogate
    return surrogate


def replace(text: str, s: Surrogates, fixed: dict[tuple[str, str], str] | None = None) -> tuple[str, list[str]]:
    """(text with surrogates, kind of each mention)."""
    out, at, kinds = [], 0, []
    for a, b, kind, entity in detect(text):
        surrogate = (fixed or {}).get((kind, entity)) or s.of(kind, entity)
        out += [text[at:a], written(kind, text[a:b], surrogate)]
        at = b
        kinds.append(kind)
    return ("".join([*out, text[at:]]) if kinds else text), kinds


class Vault:
    """Entities as sealed bytes: deterministic under the key, so they can be joined and compared, and opened only with it."""

    def __init__(self, key: bytes):
        self.mac, self.stream = (hmac.new(key, x, hashlib.sha256).digest() for x in (b"vault mac", b"vault stream"))

    def _mask(self, head: bytes, n: int) -> int:
        return int.from_bytes(b"".join(hmac.new(self.stream, head + i.to_bytes(4, "big"), hashlib.sha256).digest() for i in range(-(-n // 32)))[:n], "big")

    def seal(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        head = hmac.new(self.mac, raw, hashlib.sha256).digest()[:16]
        return head + (int.from_bytes(raw, "big") ^ self._mask(head, len(raw))).to_bytes(len(raw), "big")

    def open(self, sealed: bytes) -> str:
        head, raw = sealed[:16], sealed[16:]
        return (int.from_bytes(raw, "big") ^ self._mask(head, len(raw))).to_bytes(len(raw), "big").decode("utf-8", "surrogatepass")


def _over(key: bytes, names: list[str], how: str):
    """Seals or opens the columns of the given names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vault = Vault(key)
        for b in batches:
            cols = [pa.array([getattr(vault, how)(x) for x in b.column(c).to_pylist()]) if c in names else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([c.cast(pa.binary() if how == "seal" else pa.string()) if n in names else c for c, n in zip(cols, b.schema.names, strict=True)], b.schema.names)

    return run


def _found(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vault = Vault(key)
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                if t:
                    rows += [(i, k, vault.seal(e)) for k, e in {(k, e) for _, _, k, e in detect(t)}]
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "kind", "entity"])

    return run


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, vault = Surrogates(key), Vault(key)
        for b in batches:
            out = [vault.seal(s.of(k, vault.open(e), n)) for k, e, n in zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "nonce")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "entity", "nonce")), pa.array(out, pa.binary())], ["kind", "entity", "nonce", "surrogate"])

    return run


def _spaces(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vault = Vault(key)
        for b in batches:
            made = [space(k, vault.open(e)) for k, e in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist(), strict=True)]
            formats = [hmac.new(key, f.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest() for f, _ in made]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), pa.array(formats, pa.string()), pa.array([n for _, n in made], pa.float64())], ["kind", "entity", "format", "size"])

    return run


TABLE = "kind string, entity binary, nonce int, surrogate binary"


def sealed_table(scratch: Scratch, entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, nonce, surrogate) of distinct sealed entities (kind, entity): no two alike, none an entity itself unless its format is over a quarter full."""
    formats = entities.select("kind", "entity").mapInArrow(_spaces(key), "kind string, entity binary, format string, size double")
    formats = scratch.save(formats.where(F.col("size") < F.lit(4.0) * entities.count()), "formats")
    full = formats.groupBy("kind", "format").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("4 * n > size").select("kind", "format")
    full = formats.join(full, ["kind", "format"], "left_semi").select("kind", "entity").withColumn("nonce", F.lit(FULL_NONCE))
    full = scratch.save(full.mapInArrow(_drawn(key), TABLE), "full")
    scratch.drop(formats)
    rest = entities.select("kind", "entity").join(full, ["kind", "entity"], "left_anti")
    table = scratch.save(rest.withColumn("nonce", F.lit(0)).mapInArrow(_drawn(key), TABLE), "surrogates")
    for _ in range(100):
        first = table.groupBy("kind", "surrogate").agg(F.min(F.struct("nonce", "entity")).alias("m"), F.count("*").alias("n"))
        double = first.where("n > 1").select("kind", "surrogate", F.col("m.nonce").alias("keep_nonce"), F.col("m.entity").alias("keep"))
        alike = table.join(double, ["kind", "surrogate"]).where("entity <> keep").select("kind", "entity", "nonce")
        real = table.join(entities.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi")
        again = scratch.save(alike.union(real.select("kind", "entity", "nonce")).distinct(), "clashes")
        if again.isEmpty():
            break
        new = again.withColumn("nonce", F.col("nonce") + 1).mapInArrow(_drawn(key), TABLE)
        rest = table.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti").select(*new.columns)
        nxt = scratch.save(rest.union(new), "surrogates")
        scratch.drop(table, again)
        table = nxt
    # What still clashes after so many draws has almost no strings of its format left: it keeps its last surrogate.
    return table.union(full)


def surrogate_table(scratch: Scratch, entities: DataFrame, key: bytes) -> DataFrame:
    """sealed_table() of distinct entities (kind, entity) in the clear, opened again; for callers that may write them."""
    sealed = scratch.save(entities.select("kind", "entity").mapInArrow(_over(key, ["entity"], "seal"), "kind string, entity binary"), "entities")
    return sealed_table(scratch, sealed, key).mapInArrow(_over(key, ["entity", "surrogate"], "open"), "kind string, entity string, nonce int, surrogate string")


def _replaced(key: bytes, schema: T.StructType):
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, vault = Surrogates(key), Vault(key)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                done = []
                for t, fixed in zip(b.column("text").to_pylist(), b.column(FIXED).to_pylist(), strict=True):
                    done.append((None, []) if t is None else replace(t, s, {(x["kind"], vault.open(x["entity"])): vault.open(x["surrogate"]) for x in fixed or ()}))
                cols = {c: b.column(c) for c in b.schema.names}
                cols |= {"text": pa.array([x for x, _ in done], b.schema.field("text").type), "n_entities": pa.array([len(k) for _, k in done], pa.int64())}
                cols["entity_kinds"] = pa.array([",".join(sorted(set(k))) for _, k in done], pa.string())
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return run


def replace_pii(spark: SparkSession, docs: DataFrame, key: bytes) -> DataFrame:
    """docs (doc_id, text, ...) with surrogates in text, n_entities and entity_kinds."""
    scratch = Scratch(spark, "pii")
    docs = docs.drop("n_entities", "entity_kinds", FIXED)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("kind", T.StringType()), T.StructField("entity", T.BinaryType())])
    found = scratch.save(docs.select("doc_id", "text").mapInArrow(_found(key), schema), "found")
    entities = scratch.save(found.select("kind", "entity").distinct(), "entities")
    table = sealed_table(scratch, entities, key)
    fixed = found.join(table.where("nonce > 0"), ["kind", "entity"])
    fixed = fixed.groupBy(F.col("doc_id").alias("__pii_id")).agg(F.collect_set(F.struct("kind", "entity", "surrogate")).alias(FIXED))
    fixed = scratch.save(fixed, "fixed")
    scratch.keep_only(fixed)
    rows = docs.join(fixed, F.col("doc_id").eqNullSafe(F.col("__pii_id")), "left").drop("__pii_id")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("entity_kinds", T.StringType())])
    return rows.mapInArrow(_replaced(key, schema), schema)
