"""PII surrogates: keyed, type-consistent replacements of detected entities.

An entity's canonical form (lower-case e-mail address, country code and digits of a phone number ...) and a
key give its surrogate, so an entity has the same surrogate wherever it stands and however it is written.
The surrogate keeps the entity's format: letters stay letters of their script and case, digits digits,
separators stand; so do top-level domains, country codes, the first two digits of cards and the prefixes that
tell a token's issuer.  Card numbers keep a valid check digit if they had one, IBANs get theirs.  A person is
a given name with a surname: the surname has one surrogate, the given name one for each person, from the
pool of the person's gender and script; the gender is what most of the person's titles say, anywhere in the
table.  A text's later mentions of its persons are found without a title.  Surrogates of all distinct
entities are checked for collisions, with each other and with real entities; who loses draws again,
and after PATIENCE draws each four further ones add a character, so that an assignment always exists.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import os
import re
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.runtime import written

KEY_CONF, KEY_VARIABLE = "spark.quarrylight.surrogate.key", "QUARRYLIGHT_SURROGATE_KEY"
PLAIN_POOL = 6  # attempts that take a name from the pools; later ones coin one
PATIENCE = 8  # attempts in an entity's own format; later ones are longer

# Titles with the gender they tell, and names to choose from.
TITLES = {
    "mr": "m", "mister": "m", "herr": "m", "señor": "m", "monsieur": "m", "господин": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "señorita": "f", "madame": "f", "mademoiselle": "f", "госпожа": "f",
    "dr": "n", "prof": "n", "professor": "n",
}
POOLS = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "Denis", "Emil", "Felix", "Georg", "Hugo", "Ivo", "Jonas", "Karl", "Leon", "Marco", "Niels", "Oscar", "Paul", "Rafael", "Simon", "Tobias", "Victor"),
    ("f", "latin"): ("Alice", "Berta", "Clara", "Dora", "Elena", "Frida", "Greta", "Helena", "Irene", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
    ("n", "latin"): ("Alex", "Andrea", "Chris", "Dominique", "Eden", "Jules", "Kim", "Lou", "Marian", "Robin", "Sasha", "Toni"),
    ("m", "cyrillic"): ("Андрей", "Борис", "Виктор", "Иван", "Максим", "Николай", "Олег", "Павел", "Роман", "Сергей"),
    ("f", "cyrillic"): ("Алина", "Вера", "Галина", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Светлана", "Татьяна"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Шура"),
    ("s", "latin"): ("Albrecht", "Barnes", "Costa", "Duval", "Engel", "Fischer", "Garcia", "Holm", "Ibsen", "Jansen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Perez", "Quint", "Richter", "Santos", "Torres", "Urban", "Vidal", "Weber", "Young", "Ziegler"),
    ("s", "cyrillic"): ("Белов", "Волков", "Громов", "Зимин", "Козлов", "Лебедев", "Морозов", "Орлов", "Павлов", "Соколов"),
}

# Words before a person's name, of which one must have a given name and a surname.
CUES = ("name", "full name", "contact", "author", "signed", "sincerely", "regards", "my name is", "ich heiße", "mein name ist", "je m'appelle", "me llamo", "mi nombre es", "меня зовут")
# What names a secret, and what issued tokens begin with.
KEYWORDS = ("api key", "access key", "private key", "secret key", "auth key", "token", "secret", "password", "passwd", "pwd")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "AIza", "glpat-", "eyJ")

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_CAP = r"(?-i:[^\W\d_a-zß-öø-ÿа-я])[^\W\d_]+"
_KEYWORD = "|".join(k.replace(" ", "[_ -]?") for k in KEYWORDS)
_HUMP = "|".join("".join(x.title() for x in k.split()) for k in KEYWORDS)
_HEX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")),
    ("iban", re.compile(r"(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){3,7}(?: ?[A-Za-z0-9]{1,3})?(?!\w)")),
    ("secret", re.compile(rf"(?:(?<![^\W\d_])(?i:{_KEYWORD})|(?<=[a-z])(?:{_HUMP}))(?:s|[_-][\w-]*|(?<=[a-z])(?=[A-Z])\w*)?[\"']?\s*[:=]>?\s*[\"']?([\w+/.~!@#$%^&*-]{{8,}}=*)")),
    ("secret", re.compile(r"(?<!\w)(A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|glpat-[\w-]{20,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?!\w)")),
    ("secret", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]{32,}?)\s*-----END ")),
    ("ipv6", re.compile(rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:])")),
    ("mac", re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![\w:-])")),
    ("ipv4", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)")),
    ("phone", re.compile(
        r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w|[.-]\d)"  # with an area code in brackets
        r"|(?<![\w.+-])\+\d{1,3}[ .-]\d{1,4}(?:[ .-]\d{2,4}){1,4}(?!\w|[.-]\d)"  # with a country code
        r"|(?<![\w.+-])0\d{1,4}(?:[ .-]\d{2,4}){2,4}(?!\w|[.-]\d)"  # with a leading 0
        r"|(?<![\w.+-])\d{3}([ .-])\d{3}\1\d{4}(?!\w|[.-]\d)|(?<![\w.+-])\+\d{8,15}(?!\w)"
    )),
    ("name", re.compile(rf"(?i:(?<!\w)(?:{_TITLE})\.?) +((?:{_CAP}[ ]){{0,1}}{_CAP})")),
    ("name", re.compile(rf"(?i:(?<!\w)(?:{'|'.join(CUES)}) ?[:,]?)[ \n]+({_CAP} {_CAP})")),
)
_NEEDS_DIGIT = {"iban", "ipv6", "mac", "ipv4", "ssn", "card", "phone"}
# parts of folded texts without which no secret, and no name, can be found
_SECRET_MARKS = tuple({k.split(" ")[-1] for k in KEYWORDS} | {p.casefold() for p in PREFIXES})
_NAME_MARKS = tuple({t.casefold() + end for t in TITLES for end in (" ", ". ")} | {c.casefold() for c in CUES})
_GROUP = {"secret": 1, "name": 1}


def configured_key(spark: SparkSession, _own: dict[str, str] = {}) -> str:  # noqa: B006
    """The key of KEY_CONF or KEY_VARIABLE.  Where neither is set, one drawn for this application: nobody can
    rebuild its surrogates, and another application's differ."""
    key = spark.conf.get(KEY_CONF, None) or os.environ.get(KEY_VARIABLE)
    return key or _own.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _digits(s: str) -> str:
    """The digits of a string, those of other scripts as ASCII ones."""
    return "".join(str(int(c)) for c in s if c.isdecimal())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_remainder(iban: str) -> int:
    """1 for a valid number, without blanks."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, raw: str) -> str:
    """What all ways to write an entity have in common."""
    if kind == "phone":  # country code, with or without 1 being the same, and the other digits
        digits = _digits(raw)
        m = re.match(r"\+(\d{1,3})[ .(-]", raw)
        code = _digits(m[1]) if m else digits[: 1 if digits[:1] in "17" else 2] if raw[0] == "+" else ""
        rest = digits[len(code) :]
        if not code and len(rest) == 11 and rest[0] == "1":
            rest = rest[1:]
        return f"{'' if code == '1' else code}|{rest}"
    if kind in ("card", "ssn"):
        return _digits(raw)
    if kind == "iban":
        return raw.replace(" ", "").upper()
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(raw))
    if kind == "mac":
        return re.sub(r"[:-]", "", raw).lower()
    return raw if kind == "secret" else raw.lower()


def _accepted(kind: str, raw: str) -> bool:
    if kind == "iban":
        return iban_remainder(raw.replace(" ", "").upper()) == 1
    if kind == "phone":
        return 7 <= len(_digits(raw)) <= 15
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(raw)
        except ValueError:
            return False
        return sum(c.isalnum() for c in raw) >= 5 and re.search(r"\d", raw) is not None
    return True


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, left to right without overlap; earlier kinds win."""
    return [x[:4] for x in find(text)]


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """As ``detect``, with the gender that a title told of a given name's person: m, f or n.

    A given name's form holds its person's surname.
    """
    folded = text.casefold()
    digit = re.search(r"\d", text) is not None
    checks = {"email": "@" in text, "secret": any(m in folded for m in _SECRET_MARKS), "name": any(m in folded for m in _NAME_MARKS)}
    found: list[tuple[int, int, str, str, str]] = []
    persons: dict[tuple[str, str], None] = {}

    def add(a: int, b: int, kind: str, form: str, gender: str = "n") -> None:
        if a < b and not any(a < x[1] and x[0] < b for x in found):
            found.append((a, b, kind, form, gender))

    def add_name(a: int, b: int, gender: str) -> None:
        given, _, surname = text[a:b].rpartition(" ")
        if any(a < x[1] and x[0] < b for x in found):
            return
        if given:
            add(a, a + len(given), "given", f"{given.lower()}|{surname.lower()}", gender)
        add(b - len(surname), b, "surname", surname.lower())
        persons[given, surname] = None

    for kind, pattern in PATTERNS:
        if not (digit if kind in _NEEDS_DIGIT else checks[kind]):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(_GROUP.get(kind, 0))
            if kind == "name":
                add_name(a, b, TITLES.get(re.match(r"\w+", m[0])[0].lower(), "n"))
            elif kind == "secret" and text[a:b].islower() and text[a:b].rstrip(".!").isalpha() and text[m.start() : a].rstrip()[-1:] == ":":
                continue  # a word after a colon, as in prose
            elif _accepted(kind, text[a:b]):
                add(a, b, kind, canonical(kind, text[a:b]))
    for given, surname in list(persons):  # whole names first: a given name alone may be a word
        if given:
            for m in re.finditer(rf"(?<!\w){re.escape(given)} {re.escape(surname)}(?!\w)", text):
                add_name(*m.span(), "n")
    for surname in {x for _, x in persons}:
        for m in re.finditer(rf"(?<!\w){re.escape(surname)}(?!\w)", text):
            add(*m.span(), "surname", surname.lower())
    return sorted(found)


class _Stream:
    """Keyed numbers for an entity and attempt."""

    def __init__(self, key: str, kind: str, form: str, attempt: int):
        self.key, self.seed, self.block, self.buffer = key.encode(), f"{kind}\0{form}\0{attempt}", 0, b""

    def below(self, n: int) -> int:
        if len(self.buffer) < 4:
            self.buffer += hmac.new(self.key, f"{self.seed}\0{self.block}".encode(), hashlib.sha256).digest()
            self.block += 1
        value, self.buffer = int.from_bytes(self.buffer[:4], "big"), self.buffer[4:]
        return value * n >> 32


def _script(s: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in s) else "latin"


def _same_shape(s: str, stream: _Stream, hexadecimal: bool = True) -> str:
    hexadecimal = hexadecimal and re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", s) is not None
    out = []
    for c in s:
        if hexadecimal:
            out.append("0123456789abcdef"[stream.below(16)])
        elif c.isdigit():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            out.append(chr(0x430 + stream.below(32)) if _script(c) == "cyrillic" else chr(97 + stream.below(26)))
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: str, kind: str, form: str, attempt: int = 0, gender: str = "n") -> str:
    """The canonical form that stands for another one; ``gender`` is that of a given name's person."""
    stream = _Stream(key, kind, form, attempt)
    more = max(0, -(-(attempt - PATIENCE + 1) // 4))
    digits = lambda n: "".join(str(stream.below(10)) for _ in range(n))
    letters = lambda n: "".join(chr(97 + stream.below(26)) for _ in range(n))
    hexes = lambda n: "".join("0123456789abcdef"[stream.below(16)] for _ in range(n))
    if kind == "email":
        local, _, domain = form.partition("@")
        labels = domain.split(".")
        return _same_shape(local, stream) + letters(more) + "@" + ".".join([*(_same_shape(x, stream) for x in labels[:-1]), labels[-1]])
    if kind == "ipv4":  # there is no longer one: a host name of the address then
        return ".".join([*([f"h{digits(more)}"] if more else []), *(str(1 + stream.below(254)) for _ in range(4))])
    if kind == "ipv6":
        # no leading zeros, and no group of zeros, so that the form stays the canonical one
        groups = ["123456789abcdef"[stream.below(15)] + hexes(len(x) - 1) if x else "" for x in form.split(":")]
        return ":".join(groups) + ("%" + digits(more) if more else "")  # a zone
    if kind == "mac":
        return hexes(12 + 2 * more)  # the longer form of such identifiers
    if kind == "card":
        body = form[:2] + digits(len(form) - 3 + more)
        if not luhn(form):
            return body + digits(1)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "phone":
        code, _, rest = form.partition("|")
        return f"{code}|{'0' if rest[0] == '0' else 1 + stream.below(9)}{digits(len(rest) - 1 + more)}"
    if kind == "ssn":
        return digits(len(form) + more)
    if kind == "iban":
        rest = _same_shape(form[4:].lower(), stream, False).upper() + digits(more)
        return f"{form[:2]}{98 - iban_remainder(form[:2] + '00' + rest):02d}{rest}"
    if kind in ("given", "surname"):
        name, _, person = form.partition("|")
        pool = POOLS[gender if kind == "given" else "s", _script(name)]
        new = pool[stream.below(len(pool))]
        if attempt >= PLAIN_POOL:
            new = _same_shape(new + "a" * (attempt - PLAIN_POOL), stream, False)
        return new.lower() + (f"|{person}" if kind == "given" else "")
    known = next((p for p in PREFIXES if form.startswith(p)), "")
    return known + _same_shape(form[len(known) :], stream) + letters(more)


def render(raw: str, kind: str, form: str) -> str:
    """A canonical surrogate in the format of the text it replaces."""
    if kind in ("phone", "card", "ssn", "iban", "mac"):
        form = form.partition("|")[2] if kind == "phone" else form
        marks = [k for k, c in enumerate(raw) if c.isalnum()][-len(form) :]
        out = list(raw)
        for k, x in zip(marks, form):
            if raw[k].isdecimal() and x.isdecimal():
                x = chr(ord(raw[k]) - int(raw[k]) + int(x))
            out[k] = x.lower() if raw[k].islower() else x.upper() if raw[k].isupper() else x
        if kind == "mac" and raw.isupper():
            out = [x.upper() for x in out]
        return "".join(out[: marks[-1] + 1]) + form[len(marks) :] + "".join(out[marks[-1] + 1 :])
    if kind == "ipv6":
        if "%" not in form and len(raw) == 39:
            form = ipaddress.IPv6Address(form).exploded
        return form.upper() if any(c.isupper() for c in raw) else form
    if kind in ("given", "surname"):
        out = form.partition("|")[0].title()
        return out.upper() if raw.isupper() else out
    if kind == "secret":
        return "".join(x.upper() if c.isupper() else x for c, x in zip(raw, form)) + form[len(raw) :]
    letters = [c for c in raw if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return form.upper()
    if len(form) == len(raw):
        return "".join(x.upper() if c.isupper() else x for c, x in zip(raw, form))
    return form


def find_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, kind, form, m, f) for each document and distinct entity; m and f say that a title told that gender."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, raw in zip(batch.column(0), batch.column(1)):
                seen: dict[tuple[str, str], set[str]] = {}
                for _, _, kind, form, gender in find(raw.as_py() or ""):
                    seen.setdefault((kind, form), set()).add(gender)
                out += [(row.as_py(), kind, form, "m" in g, "f" in g) for (kind, form), g in seen.items()]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "kind", "form", "m", "f"])

    return rows.mapInArrow(search, "row long, kind string, form string, m boolean, f boolean")


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, gender, attempt, new) of distinct (kind, form): no two alike, none a real entity's form.

    Of entities that draw the same form the least keeps it; the others, and those that draw a real form, draw
    again.  Only those are carried to the next round.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(key, a.as_py(), b.as_py(), n.as_py(), g.as_py()) for a, b, g, n in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "form", "gender", "attempt", "new"])

    votes = F.sum(F.col("m").cast("int") - F.col("f").cast("int"))
    open_ = entities.groupBy("kind", "form").agg(F.when(votes > 0, "m").when(votes < 0, "f").otherwise("n").alias("gender"))
    open_ = written(open_.withColumn("attempt", F.lit(0)), "distinct")
    # what no surrogate may be, whatever its case
    real = open_.select("kind", F.lower("form").alias("as_real")).distinct()
    settled: DataFrame | None = None
    while settled is None or not open_.isEmpty():
        drawn = written(open_.mapInArrow(draw, "kind string, form string, gender string, attempt int, new string"), "drawn")
        least = drawn.groupBy(F.col("kind").alias("k"), F.lower("new").alias("taken")).agg(F.min("form").alias("least"))
        alone = drawn.join(least, (F.col("kind") == F.col("k")) & (F.lower("new") == F.col("taken")) & (F.col("form") == F.col("least")), "left_semi")
        for others in [real] if settled is None else [real, settled.select("kind", F.lower("new").alias("as_real"))]:
            others = others.withColumnRenamed("kind", "k")
            alone = alone.join(others, (F.col("kind") == F.col("k")) & (F.lower("new") == F.col("as_real")), "left_anti")
        alone = written(alone, "settled")
        open_ = written(drawn.join(alone.select("kind", "form"), ["kind", "form"], "left_anti").select("kind", "form", "gender", (F.col("attempt") + 1).alias("attempt")), "again")
        settled = alone if settled is None else settled.unionByName(alone)
    return settled


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the kinds of entities replaced, one for each place.

    Rows are replaced one by one: repeated rows and ids get equal texts, an empty table gives none, other
    columns may bear any names but must not be called ``entities``.  Texts without entities, null and empty
    ones stay as they are.  ``docs``' plan must read the same rows in the same partitions each time, as a
    table scan does.
    """
    found = written(find_entities(docs, text), "entities")
    # what a document's own text and the key don't tell
    told = written(assign_surrogates(found, key).where("attempt > 0 OR gender <> 'n'").drop("new"), "told")
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*columns, F.monotonically_increasing_id().alias("the_row"))
    if told.isEmpty():
        rows = rows.drop("the_row").withColumn("the_told", F.lit(None).cast("array<struct<kind:string,form:string,gender:string,attempt:int>>"))
    else:
        own = found.join(told, ["kind", "form"]).groupBy(F.col("row").alias("the_row")).agg(F.collect_list(F.struct("kind", "form", "gender", "attempt")).alias("the_told"))
        rows = rows.join(own, "the_row", "left").drop("the_row")
    at = docs.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            kinds: list[list[str]] = [[] for _ in range(len(texts))]
            values, mask = [], np.zeros(len(texts), bool)
            for k, raw in enumerate(texts):
                raw = raw.as_py() or ""
                parts, last = [], 0
                entities = detect(raw)
                own = {(x["kind"], x["form"]): x for x in (batch.column(batch.num_columns - 1)[k].as_py() or () if entities else ())}
                for a, b, kind, form in entities:
                    x = own.get((kind, form), {"attempt": 0, "gender": "n"})
                    parts += [raw[last:a], render(raw[a:b], kind, surrogate(key, kind, form, x["attempt"], x["gender"]))]
                    kinds[k].append(kind)
                    last = b
                if parts:
                    values.append("".join([*parts, raw[last:]]))
                    mask[k] = True
            new = texts if not values else pc.replace_with_mask(texts, pa.array(mask), pa.array(values, texts.type))
            arrays = [new if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kinds, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "the_kinds"])

    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), "the_kinds array<string>"])
    out = rows.mapInArrow(replace, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("the_kinds").alias("entities"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = replace_entities(docs, configured_key(spark))
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities")), ",").alias("kinds"))
