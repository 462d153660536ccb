"""Personal data replaced by surrogates.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card numbers, IBANs, US social security
numbers, and names.  A name is a row of capitalised words after a title, after words that introduce or sign
a person, in a greeting, before "wrote", right before an address or number, or a known given name before
a capitalised word; the words so found count wherever they stand alone in the same text, in capitals too.
Scripts without capital letters have no names here.  Every entity gets a surrogate drawn from a keyed hash
of its kind and canonical value: the same entity has the same surrogate everywhere, in the case and
punctuation of each mention.  Numbers keep their length, check digits and calling code, addresses their
private range, domains their last label; every other letter and digit is drawn anew, however long the value.

A word of a name is one entity, whatever its title and whether it is a given name or a surname: its gender is that of the known
given names, else of the most titles before it in the whole corpus.  Its surrogate has that gender and
the word's script, so a surname alone still agrees with the full name.

The different entities of all rows are a table; in rounds, a drawn surrogate is refused if it is an
entity of the corpus or if another entity of its space (all names are one) has it, and drawn anew with the
next attempt.  So different entities have different surrogates; if a space is used up after ``ROUNDS``
rounds, an error says so.  The table is joined to the mentions and goes back to the rows that have them;
rows without mentions are never shuffled.  Matching on a hash of the row is harmless: a collision gives a
row surrogates that it doesn't look up.

Null texts stay null; empty and repeated rows stay; texts are read whole; equal draws go to the entity of the
smallest value; a mention in many rows is a skewed join key without an aggregation above it, which Spark
splits; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import pieces, plain
from .shared import written

#: Rounds of draws after which a space of surrogates counts as used up.
ROUNDS = 64

# Given names by gender, surnames, by script.
NAMES = {
    ("f", "latin"): "Mary Anna Emma Olivia Sophia Julia Laura Sarah Maria Elena Clara Alice Nina Lucia Marta Ingrid Helga Claire Camille Carmen Isabel Jennifer Linda Patricia Susan Karen Nancy Lisa Margaret Emily".split(),
    ("m", "latin"): "James John Robert Michael William David Thomas Daniel Paul Peter Martin Stefan Hans Klaus Pierre Jean Louis Antoine Carlos Diego Javier Miguel Richard Joseph Charles Steven Andrew Kevin Brian George".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Κατερίνα Σοφία".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Πέτρος".split(),
    ("s", "greek"): "Παπαδόπουλος Γεωργίου Ιωάννου Νικολάου Δημητρίου".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина".split(),
    ("m", "cyrillic"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел".split(),
    ("s", "latin"): "Smith Johnson Brown Miller Davis Wilson Anderson Taylor Moore Martin Schmidt Schneider Fischer Weber Meyer Wagner Becker Dubois Laurent Moreau Lefebvre Garcia Fernandez Gonzalez Rodriguez Lopez Sanchez Novak Rossi Jansen".split(),
    ("s", "cyrillic"): "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Петров".split(),
}
# Syllables of made-up names.
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "greek": "βα δε κο λα με νο ρα σε το φα".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
}
# Endings of made-up given names.
ENDINGS = {"f": {"latin": "a", "greek": "α", "cyrillic": "а"}, "m": {"latin": "n", "greek": "ς", "cyrillic": "н"}}
# Calling codes of two digits; 1 and 7 have one digit, all others three.
CALLING = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Titles and their gender, words that introduce or sign a person, greetings, and what they also greet.
FEMALE_TITLES = frozenset("mrs ms miss madame mme frau señora sra lady".split())
MALE_TITLES = frozenset("mr herr monsieur señor sir".split())
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Madame|Mme|Monsieur|Señora|Señor|Sra|Lady|Sir)"
INTRO = (
    r"(?:[Nn]ame(?:\x20is|\x20ist|:)|[Nn]om(?:\x20est|:)|[Nn]ombre(?:\x20es|:)|m['’]appelle|[Mm]e\x20llamo|[Ii]ch\x20heiße|[Cc]ontact(?:\x20person)?:|[Aa]nsprechpartner(?:in)?:|[Aa]uthor:|[Ss]igned(?:\x20by|:|,)"
    r"|[Rr]egards,?|[Ss]incerely,?|[Gg]rüßen?,?|[Cc]ordialement,?|[Aa]tentamente,?|[Мм]еня\x20зовут|[Сс]\x20уважением,?)"
)
GREETING = r"(?:Dear|Hello|Hi|Lieber?|Chère|Cher|Estimad[oa]|Querid[oa]|Уважаем(?:ый|ая))"
NOT_NAMES = frozenset("sir madam all customer team colleague colleagues world friend friends everyone reader readers the a an this that these those our my your his her their we you they and or but is mr mrs ms miss dr prof".split())
WROTE = r"(?:wrote|writes|schrieb|schreibt|escribió|escribe|écrivit|écrit|написала?)"

GIVEN = {name.casefold(): key[0] for key, names in NAMES.items() if key[0] != "s" for name in names}
WORD = r"(?:\p{Lu}\p{Ll}+(?:['’-]\p{Lu}\p{Ll}+)?|\p{Lu}['’]\p{Lu}\p{Ll}+)"
CAPITALS = r"(?:\p{Lu}{2,}(?:-\p{Lu}{2,})?|\p{Lu}['’]\p{Lu}{2,})"
PARTICLES = r"(?:(?:van|von|der|den|de|del|della|di|da|la|le|bin|al)\x20){0,3}"
SEVERAL = rf"{WORD}(?:\x20{PARTICLES}{WORD}){{1,2}}"
SOME = rf"{WORD}(?:\x20{PARTICLES}{WORD}){{0,2}}"
FIRST = "|".join(sorted({name for key, names in NAMES.items() if key[0] != "s" for name in names}))
FIRST_CAPITALS = FIRST.upper()
ADDRESS = r",?\x20?[(<\[]?(?:[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9]|\+\d)"

HEX = "[0-9A-Fa-f]{1,4}"

PATTERNS = (
    ("email", regex.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")),
    ("iban", regex.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", regex.ASCII)),
    ("ip6", regex.compile(rf"(?<![\w:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}(?::{HEX}){{0,5}})?::(?:{HEX}(?::{HEX}){{0,5}})?)(?![\w:])", regex.ASCII)),
    ("ip", regex.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)", regex.ASCII)),
    ("card", regex.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}[\x20-]\d{4}[\x20-]\d{4}[\x20-]\d{1,7}|\d{4}[\x20-]\d{6}[\x20-]\d{5})(?![\w-])", regex.ASCII)),
    ("ssn", regex.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", regex.ASCII)),
    ("phone", regex.compile(r"(?<![\w.+-])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d(?:[\x20.-]?\d){5,12}|\(\d{2,4}\)[\x20.-]?\d{3,4}[\x20.-]\d{3,4}|\d{3}[\x20.-]\d{3}[\x20.-]\d{4})(?![\w-])", regex.ASCII)),
)
#: Each match's group "name" is the words of a name, and "title" what stood before them.
NAME_PATTERNS = tuple(
    regex.compile(rf"(?<!\w){p}(?!\w)")
    for p in (
        rf"(?P<title>{TITLE})\.?\x20+(?P<name>(?:{WORD}|{CAPITALS})(?:\x20{PARTICLES}(?:{WORD}|{CAPITALS})){{0,2}})",
        rf"(?P<name>(?:{FIRST})\x20{PARTICLES}(?:{WORD}|{CAPITALS}))",
        rf"(?P<name>(?:{FIRST_CAPITALS})\x20{CAPITALS})",
        rf"{INTRO}\s{{1,3}}(?P<name>{SOME})",
        rf"{GREETING}\x20(?P<name>{SOME})(?=[,!:])",
        rf"(?P<name>{SEVERAL})(?=\x20{WROTE})",
        rf"(?P<name>{SEVERAL})(?={ADDRESS})",
    )
)
#: Texts without a match of this have no mention.
MAYBE = (
    rf"@[A-Za-z0-9]|:[0-9A-Fa-f]{{0,4}}:|\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d|\d{{13}}|\d{{3,4}}[ -]\d{{2,6}}[ -]\d|\+\d|\(\d{{2,4}}\)|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}|[A-Z]{{2}}\d\d[ A-Z0-9]"
    rf"|{TITLE}\.? |(?:{FIRST}|{FIRST_CAPITALS}) |{INTRO}\s|{GREETING} \p{{Lu}}|\p{{Ll}} {WROTE}"
)


WORDS = regex.compile(r"\w+")


class Mention(NamedTuple):
    """``role``: f, m or u (not known) of a given name, s of a surname, empty for other kinds and for names found again."""

    start: int
    end: int
    kind: str
    value: str
    role: str = ""


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def script_of(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def canonical(kind: str, value: str) -> str | None:
    """The value without case and punctuation; None if it isn't one of its kind."""
    if kind in ("phone", "card", "ssn"):
        digits = ("+" if value[0] == "+" else "") + "".join(c for c in value if c.isdigit())
        return digits if kind != "card" or 13 <= len(digits) <= 19 else None
    if kind == "iban":
        value = value.replace(" ", "")
        return value if 15 <= len(value) <= 34 and iban_holds(value) else None
    if kind == "ip6":
        return ip6(value)
    return value.lower() if kind == "email" else value


def ip6(value: str) -> str | None:
    """The short form of an IPv6 address; None for what is none, or has too few digits to be told from other text with colons."""
    if sum(c != ":" for c in value) < 5 or not any(c.isdigit() for c in value):
        return None
    try:
        return ipaddress.IPv6Address(value).compressed
    except ValueError:
        return None


def mentions(text: str) -> list[Mention]:
    """The mentions in a text, in order and apart from each other."""
    found: list[Mention] = []
    taken = bytearray(len(text))

    def take(own: list[Mention], a: int, b: int) -> None:
        taken[a:b] = b"\x01" * (b - a)
        found.extend(own)

    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span()
            if taken.find(1, a, b) < 0 and (value := canonical(kind, m[0])) is not None:
                take([Mention(a, b, kind, value)], a, b)
    names: dict[str, str] = {}
    for pattern in NAME_PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span("name")
            parts = name_parts(m["name"], a, m.groupdict().get("title") or "")
            if parts and taken.find(1, a, b) < 0:
                take(parts, a, b)
                names.update((x.value, x.kind) for x in parts)
    if names:  # the same names again, alone
        for a, b in words_at(text):
            value = names.get(folded := text[a:b].casefold()) and folded
            if value and taken.find(1, a, b) < 0 and text[a:b] in (value.title(), value.upper()):
                take([Mention(a, b, names[value], value)], a, b)
    return sorted(found)


def words_at(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every two words that a hyphen or an apostrophe joins, and of every word, the longer first."""
    before = None
    for m in WORDS.finditer(text):
        a, b = m.span()
        if before and a == before[1] + 1 and text[before[1]] in "'’-":
            yield before[0], b
        if before:
            yield before
        before = a, b
    if before:
        yield before


def name_parts(name: str, at: int, title: str) -> list[Mention]:
    """The capitalised words of a name that starts at ``at``, up to one that can't be in a name."""
    words = [m for m in regex.finditer(r"\S+", name) if m[0][0].isupper()]
    words = words[: next((i for i, m in enumerate(words) if m[0].casefold() in NOT_NAMES), len(words))]
    gender = "f" if title.casefold() in FEMALE_TITLES else "m" if title.casefold() in MALE_TITLES else "u"
    out = []
    for i, m in enumerate(words):
        given = i < len(words) - 1 or not title and len(words) == 1
        out.append(Mention(at + m.start(), at + m.end(), f"name-{script_of(m[0])}", m[0].casefold(), gender if given else "s"))
    return out


def iban_number(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4]))


def iban_holds(value: str) -> bool:
    return iban_number(value) % 97 == 1


class Draw:
    """Numbers from a keyed hash, as many as are asked for."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what = key, "\x1f".join(map(str, what)).encode()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if not self.left:
            self.left = hmac.new(self.key, self.block.to_bytes(8, "big") + self.what, hashlib.sha512).digest()
            self.block += 1
        out, self.left = int.from_bytes(self.left[:8], "big") % n, self.left[8:]
        return out

    def like(self, text: str) -> str:
        """Letters for letters and digits for digits; a leading zero stays, other leading digits stay nonzero."""
        out = []
        for i, c in enumerate(text):
            if c.isdigit():
                out.append(str(self.below(10)) if i else "0" if c == "0" and len(text) > 1 else str(1 + self.below(9)))
            elif c.isalpha():
                out.append(chr((97 if c.islower() else 65) + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def calling_code(number: str) -> str:
    """The calling code of an international number, with its plus."""
    return number[: 2 if number[1] in "17" else 3 if number[1:3] in CALLING else 4]


def surrogate(kind: str, value: str, role: str, attempt: int, key: bytes) -> str:
    """Canonical value of a surrogate; another one for each attempt.  Where a form has few values, late attempts are longer."""
    draw = Draw(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        near = Draw(key, "domain", domain)  # the same for all addresses of a domain
        longer = "".join(chr(97 + draw.below(26)) for _ in range(attempt // 4))
        return ".".join([draw.like(local) + longer + "@" + near.like(labels[0]), *map(near.like, labels[1:-1]), labels[-1]])
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        keep = 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] or octets[0] == 172 and 16 <= octets[1] < 32 else 0
        if keep and attempt < 8:
            return ".".join(map(str, octets[:keep] + [1 + draw.below(254) for _ in range(4 - keep)]))
        return ".".join(map(str, [11 + draw.below(90), *(1 + draw.below(254) for _ in range(3))]))
    if kind == "ip6":
        digit = lambda c, first: c if c == ":" else f"{1 + draw.below(15):x}" if first else f"{draw.below(16):x}"
        return "".join(digit(c, not i or value[i - 1] == ":") for i, c in enumerate(value)) + (f":{1 + draw.below(65535):x}" if attempt > 7 and value.endswith("::") else "")
    if kind == "card":
        body = value[0] + draw.like("1" + value[1:])[1:]
        if not luhn(value):
            return body
        return next(s for s in (body[:-1] + str(d) for d in range(10)) if luhn(s))
    if kind == "iban":
        body = draw.like(value[4:])
        return f"{value[:2]}{98 - iban_number(value[:2] + '00' + body) % 97:02d}{body}"
    if kind in ("phone", "ssn"):
        code = calling_code(value) if value[0] == "+" else ""
        return code + draw.like(value[len(code) :])
    script = kind.partition("-")[2]
    if attempt < 4:
        pool = NAMES[role if role in "fms" else "fm"[draw.below(2)], script]
        return pool[draw.below(len(pool))].casefold()
    made = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(3 + attempt // 8))
    return made + ENDINGS.get(role, {}).get(script, "")


def dressed(mention: str, value: str, kind: str) -> str:
    """The surrogate ``value`` in the punctuation and case of ``mention``."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(value.replace("+", ""))
        return "".join(next(rest, "") if c.isalnum() else c for c in mention)
    if kind == "ip":
        return value
    if kind == "ip6":
        return value.upper() if mention.isupper() else value
    if kind == "email":
        if mention.isupper():
            return value.upper()
        return "".join(v.upper() if i < len(mention) and mention[i].isupper() else v for i, v in enumerate(value))
    return value.upper() if mention.isupper() and len(mention) > 1 else value.title()


def hits(texts: pa.StringArray) -> pa.BooleanArray:
    return pc.match_substring_regex(texts, MAYBE)


ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("role", pa.string())]))


def found_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with mentions: doc_id, key, text and their entities."""
    for batch in batches:
        for part in pieces(batch, "text"):
            some = part.filter(hits(plain(part.column("text"))))
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if own := {m[2:] for m in mentions(text)}:
                    rows.append((doc_id, key, text, [{"kind": k, "value": v, "role": r} for k, v, r in sorted(own)]))
            kinds = (some.schema.field("doc_id").type, pa.int64(), pa.string(), ENTITIES)
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "key", "text", "entities"])


def roles(each: DataFrame) -> DataFrame:
    """(kind, value, role) of the different entities of (kind, value, role) mentions: f, m or u of given names, s of surnames."""
    votes = {r: F.sum((F.col("role") == r).cast("int")).alias(r) for r in "fmus"}
    counted = each.groupBy("kind", "value").agg(*votes.values())
    role = F.when(~F.col("kind").startswith("name"), "").when(F.col("s") > F.col("f") + F.col("m") + F.col("u"), "s").when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("u")
    known = [F.when(F.col("value").isin(*[n for n, g in GIVEN.items() if g == r]) & (F.col("s") <= F.col("f") + F.col("m") + F.col("u")), r) for r in "fm"]
    return counted.select("kind", "value", F.coalesce(*known, role).alias("role"))


def drawn(entities: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, surrogate) for (kind, value, role), all surrogates of a space different and none of them an entity."""

    def tries(attempt: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [surrogate(k, v, r, attempt, key) for k, v, r in zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "role")), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.string())], names=["kind", "value", "role", "surrogate"])

        return rows

    def space(df: DataFrame) -> DataFrame:
        return df.withColumn("space", F.substring_index("kind", "-", 1))

    real = space(entities).select("space", F.col("value").alias("surrogate")).distinct()
    done, left = None, entities
    for attempt in range(rounds):
        tried = written(space(left.mapInArrow(tries(attempt), "kind string, value string, role string, surrogate string")), "drawn")
        first = F.row_number().over(Window.partitionBy("space", "surrogate").orderBy("value", "kind"))
        fresh = tried.withColumn("turn", first).where("turn = 1").drop("turn").join(real.hint("merge"), ["space", "surrogate"], "left_anti")
        if done is not None:
            fresh = fresh.join(space(done).select("space", "surrogate").hint("merge"), ["space", "surrogate"], "left_anti")
        fresh = written(fresh.select("kind", "value", "surrogate"), "fresh")
        done = fresh if done is None else done.unionByName(fresh)
        left = written(tried.join(fresh.select("kind", "value").hint("merge"), ["kind", "value"], "left_anti").select("kind", "value", "role"), "left")
        if left.isEmpty():
            return done
    raise ValueError(f"no surrogates left after {rounds} rounds for {left.count()} entities, such as of kind {left.first()['kind']}")


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions) and kinds of every row."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(rows.mapInArrow(found_rows, f"doc_id {kind}, key long, text string, entities array<struct<kind:string,value:string,role:string>>"), "found")
    each = found.select("key", F.explode("entities").alias("e")).select("key", "e.kind", "e.value").distinct()
    entities = written(roles(found.select(F.explode("entities").alias("e")).select("e.*")), "entities")
    known = drawn(entities, key)
    maps = each.join(known.hint("merge"), ["kind", "value"]).groupBy("key").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("own"))
    schema = f"doc_id {kind}, text string, n_entities int, kinds string"

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers, names = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
                by = {(x["kind"], x["value"]): x["surrogate"] for x in own}
                out, at, all_found = [], 0, mentions(text)
                for a, b, what, value, _ in all_found:
                    out += [text[at:a], dressed(text[a:b], by[what, value], what)]
                    at = b
                texts.append("".join([*out, text[at:]]))
                numbers.append(len(all_found))
                names.append(",".join(sorted({m.kind.partition("-")[0] for m in all_found})))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string()), pa.array(numbers, type=pa.int32()), pa.array(names, type=pa.string())], names=["doc_id", "text", "n_entities", "kinds"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = plain(part.column("text"))
                keep = [not (maybe and mentions(t.as_py())) for maybe, t in zip(hits(texts).to_pylist(), texts, strict=True)]
                some = part.filter(pa.array(keep, type=pa.bool_()))
                n = some.num_rows
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), pa.array([0] * n, type=pa.int32()), pa.array([""] * n, type=pa.string())], names=["doc_id", "text", "n_entities", "kinds"])

    changed = found.select("doc_id", "key", "text").join(maps.hint("merge"), "key").select("doc_id", "text", "own").mapInArrow(replaced, schema)
    return changed.unionByName(rows.select("doc_id", "text").mapInArrow(untouched, schema))
