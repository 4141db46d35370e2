"""Surrogates for personal data: keyed, type-consistent replacements over a whole corpus.

Detected entities are normalised (case and separators aside) and get a surrogate that a key, the type and
the normalised form decide, so every mention of an entity has the same one (coreference), written in the
mention's own format. Surrogates keep what the type asks for: a card's brand digit and checksum, a
phone's country code, an account's country and checksum, the shape of an address, gender, script and
hyphens of a name, upper and lower case.

A name follows a title, and is capitalised or of a script without case; particles (`von`, `de la`) may
stand between and stay. Names of scripts without lists are drawn from letters of their script.

Distinct entities must stay distinct, and no surrogate may be an entity that really occurs. Both are
checked over the distinct entities of all texts: names are drawn from a space some fifty times as large
as their number (lists, then lists with syllables before), of those that collide one keeps its
surrogate, and only the others draw again, until nothing collides. Entities that drew again travel
back to their texts; all others are computed where they are found. Distinct entities are pre-aggregated
in tasks.

Defined results: null text stays null, text without entities stays as it is, byte for byte; overlapping
finds go to the one that starts first, then the longest; repeated rows are rewritten alike; other
columns pass through. `entities` is replaced where the input has it.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm.storage import free_name, stored
from shelfscope.llm.text import batches_of

BROADCAST_ROWS = 200_000
#: Bytes of text that a task works on at a time.
AT_ONCE = 1 << 20

#: Titles by gender, and names for surrogates by script and gender.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "госпожа", "г-жа", "κυρία", "Κυρία"],
    "n": ["Dr", "Prof", "Professor"],
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    ("latin", "f"): ["Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ines", "Julia", "Karin", "Laura", "Marta", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera"],
    ("latin", "n"): ["Alex", "Andrea", "Chris", "Dominique", "Kim", "Lou", "Noa", "Robin", "Sam", "Toni"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Дмитрий", "Егор", "Иван", "Максим", "Олег", "Павел", "Сергей"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья", "Юлия"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Шура", "Слава"],
    ("greek", "m"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Μαρία", "Σοφία"],
    ("greek", "n"): ["Αλέξης", "Νικόλ", "Φώτης"],
}
FAMILY = {
    "latin": ["Albert", "Becker", "Costa", "Dupont", "Evans", "Fischer", "Garcia", "Hansen", "Iglesias", "Jansen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Petit", "Quinn", "Romero", "Schmidt", "Turner", "Vidal", "Weber"],
    "cyrillic": ["Белов", "Волков", "Громов", "Зайцев", "Козлов", "Лебедев", "Морозов", "Орлов", "Павлов", "Соколов"],
    "greek": ["Γεωργίου", "Δημητρίου", "Νικολάου", "Παππάς", "Πέτρου"],
}
SYLLABLES = {
    "latin": ["an", "bel", "cor", "den", "er", "fin", "gar", "hal", "is", "lor", "mar", "nel", "or", "ros", "sen", "tin"],
    "cyrillic": ["ан", "бел", "вин", "гор", "дан", "ер", "кин", "лев", "мар", "нов"],
    "greek": ["αν", "δελ", "κορ", "λιν", "μαρ", "νικ", "παν", "ρος"],
}

#: Letters for names of scripts without case, by the first word of a letter's Unicode name.
LETTERS = {
    "cjk": "山川田中村木林森石松原野本高橋", "hiragana": "あいうえおかきくけこさしすせそ", "katakana": "アイウエオカキクケコサシスセソ",
    "hangul": "김이박최정강조윤장임한오서신권", "arabic": "ابتجدرسعلمنهويك", "hebrew": "אבגדהלמנרשתק", "devanagari": "कखगजतदनपमरलवसह", "thai": "กขคงจชดตนปพมรลวสห",
}
#: Particles of family names, and lengths of country calling codes (all others have three digits).
PARTICLES = {"von", "van", "de", "da", "di", "del", "della", "du", "dos", "la", "le", "el", "al", "bin", "ben", "ter", "ten", "zu", "y"}
INNER_PARTICLES = PARTICLES | {"der", "den", "dem", "las", "los", "und"}
ONE_DIGIT = {"1", "7"}
TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

WORD = r"[^\W\d_][^\W\d_'’-]*(?:[-'’][^\W\d_]+)?"
TITLE = re.compile(
    r"(?<!\w)(?:" + "|".join(sorted({re.escape(x) for g in "mfn" for t in TITLES[g] for x in (t, t.upper())}, key=len, reverse=True))
    + r")(?=\.?[ \t])"
)
INITIALS = re.compile(r"\.?(?:[ \t][^\W\d_a-zа-яα-ω]\.)*")
NEXT_WORD = re.compile(rf"[ \t]({WORD})")
TITLE_GENDER = {x: g for g, titles in TITLES.items() for t in titles for x in (t, t.upper())}
GIVEN_GENDER = {n.casefold(): g for (_, g), names in GIVEN.items() if g != "n" for n in names}
EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-])")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
CARD = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SECRET = re.compile(r"(?i:(?<!\w)(?:token|password|passwd|secret|api[_-]?key)[ \t]*[=:][ \t]*[\"']?)([A-Za-z0-9+/_-]{12,}={0,2})")
DIGIT = re.compile(r"\d")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str
    norm: str
    gender: str = "n"


def luhn(digits: str) -> int:
    """The checksum over all digits, modulo 10; 0 for a valid number."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def script_of(word: str) -> str:
    for char in word:
        script = re.split("[ -]", unicodedata.name(char, "").lower())[0]
        if script in ("cyrillic", "greek") or script in LETTERS:
            return script
    return "latin"


def like_a_name(word: str) -> bool:
    """At least two letters, the first one a capital or of a script without case; a single one of such a script."""
    caseless = word[0].lower() == word[0].upper()
    return caseless or word[0].isupper() and len(word) > 1


def names_in(text: str) -> Iterator[Found]:
    """Words of names after a title: given names, and the last one as family name.

    A given name has the gender of the lists, else of its title. A family name is one entity for all its
    bearers; its Cyrillic feminine form counts as the masculine one and is written back as feminine.
    """
    for match in TITLE.finditer(text):
        gender = TITLE_GENDER[match.group(0)]
        begin = at = INITIALS.match(text, match.end()).end()
        taken: list[tuple[int, str]] = []
        while len(taken) < 3 and (found := NEXT_WORD.match(text, at)):
            word = found.group(1)
            if like_a_name(word) and word not in TITLE_GENDER:
                taken.append((found.start(1), word))
            elif word not in (PARTICLES if at == begin else INNER_PARTICLES):
                break
            at = found.end()
        for k, (start, word) in enumerate(taken):
            script, norm, own = script_of(word), word.casefold(), gender
            if k == len(taken) - 1:
                kind = f"family:{script}:n"
                if script == "cyrillic" and norm.endswith(("ова", "ева", "ина", "ына")):
                    norm, own = norm[:-1], "f"
            else:
                kind = f"given:{script}:{GIVEN_GENDER.get(norm, gender)}"
            yield Found(start, start + len(word), kind, norm, own)


def entities_in(text: str) -> list[Found]:
    """What is personal in a text, in order, without overlaps."""
    found: list[Found] = []
    add = lambda kind, m, norm, g=0: found.append(Found(m.start(g), m.end(g), kind, norm))
    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", m, m.group(0).lower())
    if DIGIT.search(text):
        for m in IBAN.finditer(text):
            norm = m.group(0).replace(" ", "")
            if 15 <= len(norm) <= 34 and mod97(norm) == 1:
                add("iban", m, norm)
        for m in CARD.finditer(text):
            digits = re.sub(r"\D", "", m.group(0))
            if luhn(digits) == 0 and len(set(digits)) > 1:
                add("card", m, digits)
        for m in IP.finditer(text):
            add("ip", m, m.group(0))
        for m in SSN.finditer(text):
            add("ssn", m, m.group(0).replace("-", ""))
        for m in PHONE.finditer(text):
            digits = re.sub(r"\D", "", m.group(0))
            if 8 <= len(digits) <= 15:
                add("phone", m, ("+" if m.group(0)[0] == "+" else "") + digits)
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            if DIGIT.search(m.group(1)):
                add("secret", m, m.group(1), 1)
    found.extend(names_in(text))
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Found] = []
    for f in found:
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


# Surrogates


class Stream:
    """Numbers that the key and a message decide."""

    def __init__(self, key: bytes, *message: object) -> None:
        self.key, self.message, self.count, self.bytes = key, "\0".join(map(str, message)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 8:
            self.bytes += hmac.new(self.key, self.message + b"\0" + str(self.count).encode(), hashlib.sha256).digest()
            self.count += 1
        value, self.bytes = int.from_bytes(self.bytes[:8], "big"), self.bytes[8:]
        return value % n

    def pick(self, options):
        return options[self.below(len(options))]

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def shaped(text: str, stream: Stream) -> str:
    """Letters for letters, digits for digits, all else as it is; text of hexadecimal digits stays such."""
    hexadecimal = re.fullmatch(r"[0-9a-f]+", text) is not None
    out = []
    for c in text:
        if hexadecimal:
            out.append(stream.pick("0123456789abcdef"))
        elif c.isdigit():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            small = stream.pick({"cyrillic": "абвгдеклмнопрст", "greek": "αβγδεκλμνοπρστ"}.get(script_of(c), "abcdefghijklmnopqrstuvwxyz"))
            out.append(small.upper() if c.isupper() else small)
        else:
            out.append(c)
    return "".join(out)


def email_for(norm: str, stream: Stream, key: bytes) -> str:
    """The local part by shape; a domain of the reserved ones, the same for every address of a domain."""
    local, _, domain = norm.partition("@")
    top = domain.rpartition(".")[2]
    own = Stream(key, "domain", domain)
    label = "".join(own.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    return f"{shaped(local, stream)}@{label}.example{'.' + top if top in ('com', 'net', 'org') else ''}"


def phone_for(norm: str, stream: Stream, key: bytes) -> str:
    digits = norm.lstrip("+")
    kept = 0 if norm[0] != "+" else 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3
    return norm[: len(norm) - len(digits)] + digits[:kept] + str(2 + stream.below(8)) + stream.digits(len(digits) - kept - 1)


def card_for(norm: str, stream: Stream, key: bytes) -> str:
    body = norm[0] + stream.digits(len(norm) - 2)
    return body + str((10 - luhn(body + "0")) % 10)


def iban_for(norm: str, stream: Stream, key: bytes) -> str:
    body = "".join(stream.pick("0123456789") if c.isdigit() else stream.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in norm[4:])
    return f"{norm[:2]}{98 - mod97(norm[:2] + '00' + body):02d}{body}"


def ip_for(norm: str, stream: Stream, key: bytes) -> str:
    return ".".join(str(1 + stream.below(254)) for _ in range(4))


def names_of(role: str, script: str, gender: str) -> list[str] | str:
    return LETTERS[script] if script in LETTERS else GIVEN[script, gender] if role == "given" else FAMILY[script]


def name_for(kind: str, norm: str, stream: Stream, syllables: int) -> str:
    """From the lists by script and gender with `syllables` put before; each part of a double name apart.
    Names of other scripts have the letters of the norm and one more per syllable, all of that script."""
    role, script, gender = kind.split(":")
    options = names_of(role, script, gender)
    if script in LETTERS:
        return "".join(stream.pick(options) for _ in range(len(norm) + syllables))
    parts = []
    for _ in norm.split("-"):
        name = stream.pick(options)
        start = "".join(stream.pick(SYLLABLES[script]) for _ in range(syllables))
        parts.append(start.capitalize() + name.lower() if start else name)
    return "-".join(parts)


def syllables_for(kind: str, entities: int) -> int:
    """How many syllables make the names of a space fifty times as many as its entities."""
    role, script, _ = f"{kind}:n".split(":")[:3]
    if script in LETTERS:
        size, each = len(LETTERS[script]), len(LETTERS[script])
    else:
        size, each = min(len(names_of(role, script, g)) for g in "mfn"), len(SYLLABLES[script])
    syllables = 0
    while size < 50 * entities and entities > size // 4:
        size, syllables = size * each, syllables + 1
    return syllables


FORMS: dict[str, Callable[[str, Stream, bytes], str]] = {
    "phone": phone_for, "card": card_for, "iban": iban_for, "ip": ip_for, "email": email_for,
    "ssn": lambda norm, stream, key: f"{1 + stream.below(899):03d}{1 + stream.below(99):02d}{1 + stream.below(9999):04d}",
    "secret": lambda norm, stream, key: shaped(norm, stream),
}


def surrogate(kind: str, norm: str, attempt: int, key: bytes, syllables: dict[str, int]) -> str:
    """The normalised surrogate of an entity; `syllables` by space of names."""
    stream = Stream(key, kind, norm, attempt)
    if ":" in kind:
        more = syllables.get(space(kind), 0) + (attempt + 2) // 3
        return name_for(kind, norm, stream, more).casefold()
    return FORMS[kind](norm, stream, key)


def address_like(value: str, mention: str) -> str:
    """An address with the capitals of the mention: of the local part by place, of the domain by its ends."""
    local, _, domain = value.partition("@")
    own, _, own_domain = mention.partition("@")
    local = "".join(c.upper() if m.isupper() else c for c, m in zip(local, own, strict=True))
    if own_domain.isupper():
        return f"{local}@{domain.upper()}"
    labels, own_labels = domain.split("."), own_domain.split(".")
    if own_labels[0][:1].isupper():
        labels[0] = labels[0].capitalize()
    if own_labels[-1].isupper():
        labels[-1] = labels[-1].upper()
    return f"{local}@{'.'.join(labels)}"


def written(found: Found, mention: str, value: str) -> str:
    """A normalised surrogate in the format of the mention."""
    if ":" in found.kind:
        if found.kind.startswith("family:cyrillic") and found.gender == "f" and value[-1] in "вн":
            value += "а"
        return value.upper() if mention.isupper() and len(mention) > 1 else "-".join(x[:1].upper() + x[1:] for x in value.split("-"))
    if found.kind in ("phone", "card", "ssn", "iban"):
        rest = iter(value.lstrip("+"))
        return "".join(next(rest) if c.isalnum() else c for c in mention)
    if found.kind == "email":
        return address_like(value, mention)
    return value


def rewritten(text: str, key: bytes, attempts: dict[str, int], syllables: dict[str, int] | None = None) -> tuple[str, list[dict]]:
    """The text with surrogates, and where they stand in it."""
    out, spans, at, length = [], [], 0, 0
    for f in entities_in(text):
        mention = text[f.start : f.end]
        new = written(f, mention, surrogate(f.kind, f.norm, attempts.get(f"{f.kind}\0{f.norm}", 0), key, syllables or {}))
        out += [text[at : f.start], new]
        length += f.start - at
        spans.append({"kind": f.kind.partition(":")[0], "start": length, "end": length + len(new)})
        length += len(new)
        at = f.end
    return "".join([*out, text[at:]]), spans


# Over the corpus


def mentions(docs: DataFrame) -> DataFrame:
    """(text_key, kind, norm): the distinct entities of each text."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", AT_ONCE):
                rows = {
                    (key, f.kind, f.norm)
                    for key, text in zip(part.column("text_key").to_pylist(), part.column("text").to_pylist(), strict=True) if text
                    for f in entities_in(text)
                }
                keys, kinds, norms = ([r[k] for r in rows] for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(norms, pa.string())], names=["text_key", "kind", "norm"])

    return docs.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(look, "text_key long, kind string, norm string")


def space(kind: str) -> str:
    """Kinds whose surrogates must differ from each other: names of one script share one space."""
    return ":".join(kind.split(":")[:2])


def drawn(entities: DataFrame, key: bytes, syllables: dict[str, int]) -> DataFrame:
    """`entities` (kind, norm, attempt) with their space and surrogate."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array([space(r["kind"]) for r in rows], pa.string()),
                    pa.array([surrogate(r["kind"], r["norm"], r["attempt"], key, syllables) for r in rows], pa.string()),
                ],
                names=[*batch.schema.names, "space", "value"],
            )

    return entities.select("kind", "norm", "attempt").mapInArrow(draw, "kind string, norm string, attempt int, space string, value string")


SPACE = r"^([^:]*(?::[^:]*)?).*$"


def assigned(found: DataFrame, key: bytes, rounds: int = 64) -> tuple[DataFrame, dict[str, int]]:
    """(kind, norm, attempt) of the entities that drew again, such that the surrogates of all are distinct
    in their space and none is an entity that occurs; and the syllables of each space of names.

    In each round, entities that drew a value of an earlier round or a real one, and all but one of those that
    drew the same, go on to the next; equal values are aggregated. A value's entities are few, as each space is
    far larger than their number.
    """
    entities = stored(found.select("kind", "norm").distinct().withColumn("space", F.regexp_replace("kind", SPACE, "$1")), "entities")
    # A row per kind of entity and script.
    counts = entities.groupBy("space").agg(F.count("*").alias("n")).collect()
    syllables = {r["space"]: syllables_for(r["space"], r["n"]) for r in counts if ":" in r["space"]}
    used = [stored(entities.select("space", F.col("norm").alias("value")).distinct(), "real-entities")]
    pending, again = entities.select("kind", "norm", F.lit(0).alias("attempt")), []
    for _ in range(rounds):
        values = stored(drawn(pending, key, syllables), "drawn")
        free = values
        for one in used:
            free = free.join(one, ["space", "value"], "left_anti")
        keeper = F.min(F.struct(F.xxhash64("kind", "norm").alias("h"), "kind", "norm", "attempt")).alias("keeper")
        kept = stored(free.groupBy("space", "value").agg(keeper).select("space", "value", "keeper.kind", "keeper.norm", "keeper.attempt"), "kept")
        used.append(kept.select("space", "value"))
        again.append(kept.filter("attempt > 0").select("kind", "norm", "attempt"))
        pending = stored(values.join(kept, ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "draws-again")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, again), syllables
    raise ValueError(f"surrogates still collide after {rounds} rounds")


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """`docs` with surrogates in `text`, and `entities`: array of (kind, start, end) in the new text."""
    docs = docs.drop("entities")
    found = stored(mentions(docs.filter("text IS NOT NULL")), "mentions")
    again, syllables = assigned(found, key)
    override = F.struct(F.concat("kind", F.lit("\0"), "norm").alias("key"), F.col("attempt").alias("value"))
    by_text = stored(
        found.join(again, ["kind", "norm"]).groupBy("text_key").agg(F.collect_set(override).alias("overrides")), "overrides"
    )
    small = F.broadcast(by_text) if by_text.count() <= BROADCAST_ROWS else by_text
    text_key, overrides = free_name(docs, "text_key"), free_name(docs, "overrides")
    small = small.select(F.col("text_key").alias(text_key), F.map_from_entries("overrides").alias(overrides))
    spans = T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>")
    schema = T.StructType([*docs.schema.fields, T.StructField("entities", spans)])

    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in batches_of(batch, "text", AT_ONCE):
                texts = part.column("text").to_pylist()
                own = part.column(overrides).to_pylist()
                done = [(t, []) if not t else rewritten(t, key, dict(o or ()), syllables) for t, o in zip(texts, own, strict=True)]
                columns = {name: part.column(name) for name in names}
                columns["text"] = pa.array([d[0] for d in done], pa.string())
                columns["entities"] = pa.array([d[1] for d in done], kind)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    keyed = docs.withColumn(text_key, F.xxhash64("text")).join(small, text_key, "left").drop(text_key)
    return keyed.mapInArrow(rewrite, schema)
