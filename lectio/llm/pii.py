"""Personal data replaced by surrogates that are keyed, of the same type and format, and distinct where the originals are.

A surrogate is a cipher of the entity in normal form (country code and digits of a phone number, lower case of an address):
each character is turned within its own class (digits, vowels or consonants of a script and case, else the letters of its
script) by an amount that depends on the key and on the characters before it. Reading from the left this can be undone, so
two entities never share a surrogate, and the same entity has the same one in every document and spelling, without a table
that all tasks would have to share. Where only some values are valid (areas of social security numbers, private addresses)
the cipher is applied until the result is valid as the original was, which keeps it one to one; check digits are computed
anew. The form it was written in is then put back. What has no character that can turn becomes a masked token.

Given names are exchanged within their gender and script, each for the next in an order that the key decides; family names
are turned letter by letter, so a name stays one that can be read aloud in its script. Within a document a family name that
was found is replaced wherever it stands alone. Before anything is written, the originals of the whole corpus are grouped by
surrogate; should two share one, they get theirs from a further round of the key.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.blocks import arrow_map, flat, slices

KEY = b"surrogates-1"

GIVEN = {
    ("f", "latin"): (
        "Alice Amelie Ana Andrea Anna Barbara Camille Carla Carmen Charlotte Chloe Claire Clara Elena Elisabeth Emily Emma Eva Greta Hannah Helena Ines Isabel Jane Jessica Julia Karen Katharina Laura Lena Linda Lisa Lucia Luisa Margaret Maria Marie Martha Mary Monika Nicole Olivia Patricia Paula Petra Rosa Sabine Sandra Sara Sarah Silvia Sofia Sophie Susan Ursula "
        "Agnieszka Aisha Ananya Anjali Astrid Ayşe Beatriz Brigitte Catarina Chiara Deepika Dorota Elif Fatima Federica Fernanda Francesca Freya Gabriela Giulia Gudrun Ingrid Joana Kavita Khadija Lakshmi Leila Małgorzata Mariana Meera Mehwish Mei Nadia Naomi Nasrin Neha Noor Padma Pooja Priya Sakura Sanaa Shreya Sunita Svetlana Valentina Yasmin Yuki Zeynep Zofia"
    ).split(),
    ("m", "latin"): (
        "Adam Albert Alexander Andreas Antonio Arthur Bernd Bruno Carl Carlos Charles Christian Daniel David Diego Edward Felix Fernando Francis Frank Fritz George Hans Henri Henry Hugo Jack Jacques James Javier Jean John Jorge Jose Juan Karl Klaus Louis Lucas Luis Manuel Marcel Markus Martin Matthew Max Michael Miguel Oliver Oscar Otto Pablo Paul Pedro Peter Philip Pierre Richard Robert Stefan Thomas Victor Walter William Wolfgang "
        "Abdullah Ahmed Ahmet Amit Anders Andrzej Arjun Bartosz Benedikt Björn Dariusz Emre Enzo Giovanni Giuseppe Gonçalo Grzegorz Gustavo Hamza Hassan Haruto Hiroshi Ibrahim Jürgen Kenji Khalid Krzysztof Lars Lorenzo Łukasz Marco Mateusz Mehmet Mohammed Mustafa Nikhil Omar Paolo Piotr Rafael Rahul Rajesh Rohan Sanjay Sven Takashi Tomasz Vikram Vinícius Wei Wojciech Xavier Youssef Zhang"
    ).split(),
    ("f", "cyrillic"): "Анна Вера Дарья Екатерина Елена Ирина Ксения Людмила Мария Наталья Нина Ольга Полина Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Григорий Дмитрий Иван Максим Михаил Николай Олег Павел Пётр Сергей".split(),
    ("f", "greek"): "Αγγελική Αικατερίνη Βασιλική Ειρήνη Ελένη Μαρία Σοφία".split(),
    ("m", "greek"): "Γεώργιος Γιάννης Δημήτρης Κωνσταντίνος Νίκος Παναγιώτης Χρήστος".split(),
}
TITLES = {"f": "Mrs Ms Miss Madam Lady Frau Madame Mme Mlle Señora Sra Srta Pani Госпожа Κυρία".split(), "m": "Mr Sir Lord Herr Monsieur Señor Sr Pan Господин Κύριος".split(), "": "Dr Prof Doctor Professor Docteur".split()}
#: Country codes of one and of two digits; all others have three.
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

_CLASSES = ["0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñß", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝŸŒ", "ÇÑ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "ąęó", "ĄĘÓ", "ćłńśźż", "ĆŁŃŚŹŻ"]
_CLASS = {c: (alphabet, i) for alphabet in reversed(_CLASSES) for i, c in enumerate(alphabet)}
_UPPER = "A-Z" + "".join(chr(c) for c in range(0xC0, 0x530) if unicodedata.category(chr(c)) == "Lu")
_NAME = rf"[{_UPPER}][^\W\d_]*(?:['’-][{_UPPER}][^\W\d_]*)?"
_FIRST = "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True))
_TITLE = "|".join(sorted((t for titles in TITLES.values() for t in titles), key=len, reverse=True))
_KINDS = {
    "email": r"(?<![\w%+-])\w[\w.%+-]{0,254}@(?:[^\W_][\w-]{0,62}\.){1,8}[^\W\d_]{2,24}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\d.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\d)",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,5}\)|[ .-]\d{1,5}|\d{2,5})(?:[ .-]?\d{2,5}){1,4}(?![\w-])|(?<![\w(+-])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"(?<!\w)(?:(?:{_TITLE})\.? +{_NAME}(?: {_NAME})?|(?:{_FIRST}) {_NAME})",
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()))
#: What a text has at least that the pattern matches, kind by kind, for a quick look at a whole column; digits are those of any script, as in the pattern.
_LOOK = {
    "email": "@",
    "iban": "[A-Z]{2}\\p{Nd}{2} ?[A-Z0-9]{4}",
    "ip": "[0-9]\\.[0-9]{1,3}\\.[0-9]",
    "phone": "\\+\\p{Nd}|\\p{Nd}{3}(?:\\) ?|[-. ])\\p{Nd}{3}[-. ]\\p{Nd}{4}",
    "ssn": "\\p{Nd}{3}-\\p{Nd}{2}-\\p{Nd}{4}",
    "card": "\\p{Nd}(?:[ -]?\\p{Nd}){12}",
    "name": f"(?:{_TITLE})\\.? +[{_UPPER}]|(?:{_FIRST}) [{_UPPER}]",
}
_MAYBE = "|".join(_LOOK.values())
_PARTS = re.compile(rf"^(?:(?P<title>{_TITLE})(?P<dot>\.? +))?(?P<rest>.*)$", re.S)
#: Entities that a task remembers, for speed alone.
MEMORY = 200_000


@functools.cache
def _alphabet(low: int, high: int, kind: str) -> dict[str, int]:
    own = (x for x in map(chr, range(low, high)) if unicodedata.category(x) == kind and x not in _CLASS and len(x.lower()) == len(x.upper()) == 1)
    return {c: i for i, c in enumerate(own)}


@functools.lru_cache(1 << 16)
def _class(c: str) -> tuple[str, int] | None:
    """The characters that c can become, and its place among them: those of its class, else those of its kind in its block of 128 code points (of all ideographs, for one); None where there are no others."""
    if c in _CLASS:
        return _CLASS[c]
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return None
    low, high = (0x4E00, 0x9FA6) if 0x4E00 <= ord(c) < 0x9FA6 else (ord(c) & ~127, (ord(c) | 127) + 1)
    if kind == "Nd":
        low = ord(c) - unicodedata.decimal(c)
        high = low + 10
    own = _alphabet(low, high, kind)
    return ("".join(own), own[c]) if c in own and len(own) > 1 else None


def _range(octets: tuple[int, ...]) -> int:
    """How many octets tell the kind of an address: 0 for a public one."""
    a, b = octets[:2]
    if a in (0, 10, 127) or a >= 224:
        return 1
    return 2 if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32 or a == 100 and 64 <= b < 128 else 0


class Surrogates:
    """Surrogates under a key; those of `again`, (kind, normal form), are made by a further round of it."""

    def __init__(self, key: bytes = KEY, again: frozenset[tuple[str, str]] = frozenset()) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.again = again
        self.made: dict[tuple[str, str], str] = {}
        self.given = {}
        for (gender, script), names in GIVEN.items():
            order = sorted(names, key=lambda n: self._hash("given", gender, n))
            self.given |= {n: (order[(i + 1) % len(order)], gender, script) for i, n in enumerate(order)}

    def _hash(self, *parts: str) -> int:
        return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), key=self.key, digest_size=8).digest(), "big")

    def turn(self, kind: str, text: str, fixed: int = 0, classes: dict[int, tuple[str, ...]] | None = None) -> str:
        """text with each character turned within its class but for the last `fixed` ones; the first that can turn always does. classes: by place, alphabets of which the character keeps its own."""
        end = len(text) - fixed
        found = [None if i >= end else next(((a, a.index(c)) for a in (classes or {}).get(i, ()) if c in a), None) or _class(c) for i, c in enumerate(text)]
        shape = "".join(f[0][0] if f else c for f, c in zip(found, text))
        out, moved = [], False
        for i, (c, f) in enumerate(zip(text, found)):
            if not f or len(f[0]) < 2:
                out.append(c)
                continue
            alphabet, at = f
            draw = self._hash(kind, shape, text[:i])
            by = draw % len(alphabet) if moved else 1 + draw % (len(alphabet) - 1)
            out.append(alphabet[(at + by) % len(alphabet)])
            moved = True
        return "".join(out)

    def _phone(self, kind: str, text: str) -> str:
        """The country code stays, and so does a 0 in brackets after it; a number without a code is a North American one."""
        plain = re.sub(r"\(0\)", "", text, count=1) if text[0] == "+" else text
        digits = re.sub(r"\D", "", plain)
        ascii_ = "".join(str(unicodedata.decimal(c)) for c in digits)
        code = next((n for n in (1, 2) if ascii_[:n] in CODES), 3) if text[0] == "+" else 0
        prefix, own = (ascii_[:code] if code else "1"), ascii_[code:]
        first = ("0", "1", "23456789")
        places = {0: first, 3: first} if prefix == "1" and len(own) == 10 else {0: ("0", "123456789")}
        new = self.turn(kind, own, classes=places)
        zero = {c: chr(ord(c) - unicodedata.decimal(c)) for c in set(digits)}
        signs = iter(digits[:code] + "".join(chr(ord(zero[c]) + int(n)) for c, n in zip(digits[code:], new)))
        skip = re.search(r"\(0\)", text) if text[0] == "+" else None
        return "".join(c if skip and skip.start() <= i < skip.end() or unicodedata.category(c) != "Nd" else next(signs) for i, c in enumerate(text))

    def _walk(self, kind: str, text: str, valid) -> str:
        """The cipher of digits applied until the result is valid as the original is."""
        like, new = valid(text), self.turn(kind, text)
        while valid(new) != like:
            new = self.turn(kind, new)
        return new

    def make(self, kind: str, text: str) -> tuple[str, str]:
        """(normal form, surrogate in the form of text) of an entity; never the text itself."""
        normal = self.normal(kind, text)
        new = self._make(kind + "+" if (kind, normal) in self.again else kind, text)
        if new == text:
            new = f"[{kind.upper()}-{self._hash(kind, normal):016x}]"
        return normal, new

    def _make(self, kind: str, text: str) -> str:
        base = kind.rstrip("+")
        if base == "email":
            normal = text.lower() if len(text.lower()) == len(text) else text
            new = self.turn(kind, normal, len(text) - text.rindex("."))
            return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(text, new))
        if base == "ip":
            return ".".join(map(str, self._address(kind, tuple(map(int, text.split("."))))))
        if base == "phone":
            return self._phone(kind, text)
        digits = re.sub(r"\D", "", text)
        if base == "card":
            plain = "".join(str(unicodedata.decimal(c)) for c in digits)
            body = plain[0] + self.turn(kind, plain[1:-1])  # the first digit tells the kind of card
            last = (_luhn(body) + int(plain[-1]) - _luhn(plain[:-1])) % 10
            return _written(text, body + str(last))
        if base == "iban":
            normal = "".join(str(unicodedata.decimal(c)) if unicodedata.category(c) == "Nd" else c for c in text.replace(" ", ""))
            body = self.turn(kind, normal[4:])
            was, check = int(normal[2:4]), _check(normal[:2], normal[4:])
            now = 2 + (_check(normal[:2], body) - 2 + was - check) % 97 if 2 <= was <= 98 else was
            new = iter(f"{normal[:2]}{now:02d}{body}")
            return re.sub(r"\S", lambda _: next(new), text)
        if base == "ssn":
            plain = "".join(str(unicodedata.decimal(c)) for c in digits)
            return _written(text, self._walk(kind, plain, lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"))
        parts = _PARTS.match(text)
        first, _, family = parts["rest"].partition(" ")
        known = self.given.get(first)
        new = known[0] if known else self._first(kind, first)
        lead = (parts["title"] + parts["dot"]) if parts["title"] else ""
        return lead + new + (f" {self._family(kind, family)}" if family else "")

    def _address(self, kind: str, octets: tuple[int, ...]) -> tuple[int, ...]:
        """A private, local or other special address stays in its range, a public one public."""
        keep = _range(octets)
        a, b = octets[:2]
        low, span = (16, 16) if a == 172 else (64, 64)
        while True:
            new = list(octets[:keep])
            if keep == 2 and a in (172, 100):
                new[1] = low + (b - low + self._hash(kind, str(a)) % span) % span
            for i in range(keep, 4):
                draw = self._hash(kind, ".".join(map(str, octets[:i])), str(keep))
                new.append((octets[i] + (draw % 256 if i > keep else 1 + draw % 255)) % 256)
            octets = tuple(new)
            if _range(octets) == keep:
                return octets

    def _family(self, kind: str, name: str) -> str:
        """A family name turned letter by letter but for its last letter, which may tell a gender."""
        return self.turn(kind, name, 1 if len(name) > 3 else 0)

    def _first(self, kind: str, name: str) -> str:
        """The same for a name that isn't in the lists, nor becomes one that is."""
        new = self._family(kind, name)
        while new in self.given:
            new = self._family(kind, new)
        return new

    def written(self, kind: str, text: str) -> str:
        got = self.made.get((kind, text))
        if got is None:
            if len(self.made) > MEMORY:
                self.made.clear()
            got = self.made[kind, text] = self.make(kind, text)[1]
        return got

    def found(self, text: str) -> list[tuple[int, int, str, str]]:
        """(begin, end, kind, entity) of all entities of a text in order: those of the pattern, and between them family names that were found with a title or a given name, where they stand alone."""
        out = [(m.start(), m.end(), m.lastgroup, m.group()) for m in _PATTERN.finditer(text) if m.lastgroup != "ip" or max(map(int, m.group().split("."))) < 256]
        families = {_PARTS.match(e)["rest"].rpartition(" ")[2] for _, _, kind, e in out if kind == "name"} - self.given.keys()
        if families:
            alone = re.compile(rf"(?<![\w'’-])(?:{'|'.join(map(re.escape, sorted(families, key=len, reverse=True)))})(?![\w-])")
            edges = [0, *(x for b, e, _, _ in out for x in (b, e)), len(text)]
            more = [(m.start(), m.end(), "family", m.group()) for low, high in zip(edges[::2], edges[1::2]) for m in alone.finditer(text, low, high)]
            out = sorted(out + more)
        return out

    def replace(self, text: str) -> tuple[str, int]:
        """text with surrogates, and how many entities it had."""
        found, out, last = self.found(text), [], 0
        for begin, end, kind, entity in found:
            out += [text[last:begin], self._family("name", entity) if kind == "family" else self.written(kind, entity)]
            last = end
        return "".join([*out, text[last:]]), len(found)

    @staticmethod
    def normal(kind: str, text: str) -> str:
        """The normal form, in which entities are compared; a masked token is one already."""
        if text[0] == "[":
            return text
        if kind == "email":
            return text.lower() if len(text.lower()) == len(text) else text
        if kind == "ip":
            return ".".join(str(int(o)) for o in text.split("."))
        if kind == "name":
            return _PARTS.match(text)["rest"]
        if kind == "phone" and text[0] == "+":
            text = re.sub(r"\(0\)", "", text, count=1)
        plain = "".join(str(unicodedata.decimal(c)) if unicodedata.category(c) == "Nd" else c for c in text)
        if kind == "iban":
            return plain.replace(" ", "")
        digits = re.sub(r"[^0-9]", "", plain)
        return digits if kind != "phone" or text[0] == "+" else f"1{digits}"


def _written(text: str, digits: str) -> str:
    """text with its digits replaced, each in its own script."""
    new = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(new))) if unicodedata.category(c) == "Nd" else c for c in text)


def _check(country: str, body: str) -> int:
    """The check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _luhn(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def replace(docs: DataFrame, key: bytes = KEY, count: str | None = "n_entities", check: bool = True) -> DataFrame:
    """docs with surrogates in text, n_chars set anew in the rows that had an entity, and the number of entities in a further column `count` (None: without).

    Kinds: email, iban, ip, phone, ssn, card (13 to 19 digits) and name (after a title, or a known given name before another
    name; in the same text also its family name alone). With check, the entities of all docs are first grouped by surrogate,
    and any that would share one are made by a further round. Null texts stay null with a count of 0; empty texts, null ids and rows that repeat are treated like any other, and
    further columns stay as they are. A column that is called like `count` is replaced. An empty table gives no rows.
    """
    work = docs.select(*(c for c in docs.columns if not count or c.lower() != count.lower()))
    place = next(i for i, c in enumerate(work.columns) if c.lower() == "text")
    length = next((i for i, c in enumerate(work.columns) if c.lower() == "n_chars"), None)
    schema = type(work.schema)(list(work.schema.fields))
    if count:
        schema = schema.add(count, "long")
    again: frozenset[tuple[str, str]] = frozenset()
    while check:
        # No two entities of a kind share a surrogate by construction, masked tokens aside (64 bits), so this is nothing or next to it.
        more = frozenset((r.kind, r.original) for r in shared(docs, key, again).limit(1 << 16).collect())
        if more <= again:
            break
        again |= more

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Surrogates(key, again)
        for batch in batches:
            for part in slices(batch, batch.schema.names[place]):
                column = flat(part.column(place))
                maybe = pc.fill_null(pc.match_substring_regex(column, _MAYBE), False)
                counts = [0] * len(column)
                hit, texts = [False] * len(column), []
                for i in pc.indices_nonzero(maybe).to_pylist():
                    text, counts[i] = writer.replace(column[i].as_py())
                    if counts[i]:
                        hit[i] = True
                        texts.append(text)
                if texts:
                    new = pa.array(texts, column.type)
                    mask = pa.array(hit)
                    part = part.set_column(place, part.schema.field(place), pc.replace_with_mask(column, mask, new))
                    if length is not None:
                        old = flat(part.column(length))
                        part = part.set_column(length, part.schema.field(length), pc.replace_with_mask(old, mask, pc.utf8_length(new).cast(old.type)))
                yield pa.RecordBatch.from_arrays([*part.columns, *([pa.array(counts, pa.int64())] if count else [])], [*part.schema.names, *([count] if count else [])])

    return arrow_map(work, change, schema)


def entities(docs: DataFrame, key: bytes = KEY, again: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """(kind, original, surrogate), both in normal form: each entity at least once. Null texts have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Surrogates(key, again)
        for batch in batches:
            for part in slices(batch):
                column = flat(part.column("text"))
                rows = set()
                for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, _MAYBE), False)).to_pylist():
                    for _, _, kind, entity in writer.found(column[i].as_py()):
                        if kind != "family":
                            rows.add((kind, writer.normal(kind, entity), writer.normal(kind, writer.written(kind, entity))))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows)) or [[]] * 3], ["kind", "original", "surrogate"])

    return arrow_map(docs.select(F.col("text").cast("string").alias("text")), find, "kind string, original string, surrogate string")


def shared(docs: DataFrame, key: bytes = KEY, again: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """(kind, original): of each surrogate that several entities have, the last of them in order; once it has another, the next is found."""
    ends = entities(docs, key, again).groupBy("kind", "surrogate").agg(F.min("original").alias("first"), F.max("original").alias("original"))
    return ends.where("original <> first").select("kind", "original")
