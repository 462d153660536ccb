"""Secret scan: three exact patterns, and guess costs of all values that stand where a credential stands.

The patterns give the base spans.  Every value after a credential word (in four languages) and a separator, quoted ones
with their blanks, in the password place of a URL, or assigned in a base span, is cut by dynamic programming into the
cheapest row of words, dates, repeats, keyboard walks, sequences and brute-force spans.  A value that needs 10^``GUESSES``
guesses or more (exactly as many: a secret) is a span of kind "guess", unless one base span holds it whole; the
cost of every value, base ones too, is in ``costs``.  Spans are code points, end exclusive, from the start of the match
(assign, access, hex) or of the value (guess).

Words are a short list of frequent passwords and then all words of the scanned corpus, counted over all of its texts but for the
values themselves, so that a secret is no word because its text was copied.  A word's rank is the number of words on higher
levels of frequency, ``LEVELS`` to a doubling.  The ranks are looked up by joining the pieces of the different values to the
counted words: no dictionary is sent anywhere and none is cut off, and a value is costed once however often it is there.

Null texts are empty texts and have no secret; repeated rows are scanned as rows of their own; an empty
table gives an empty result; only the key columns asked for and the text are read.  Values are costed
whole, in time linear in their length; values under ``SHORTEST`` characters are never costed, as none of them can take as many guesses.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import pieces, plain
from .shared import written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CREDENTIAL = (
    r"(?:pass(?:word|wd|phrase|code|key|wort)?|pwd|pin|secret|token|credentials?|creds?|bearer|auth(?:orization)?|login"
    r"|(?:api|access|private|secret|signing|encryption|account|client|master)[_\-\x20]?(?:key|secret|token|password)"
    r"|kennwort|losung|geheim(?:nis|wort|code)|schl[\u00fc\u00dc]ssel|zugangs(?:code|daten)"
    r"|contrase[\u00f1\u00d1]a|clave|secreto|mot\x20de\x20passe|mdp|jeton|cl[\u00e9\u00c9](?:\x20secr[\u00e8\u00c8]te)?)"
)
SEPARATOR = r"""["']?(?:\x20*(?::=|=>|->|[:=])\x20*|\x20+(?:is|was|ist|war|lautet|es|era|est|[\u00e9\u00c9]tait)\x20+)"""
CONTEXT = re.compile(rf"""(?<![A-Za-z]){CREDENTIAL}{SEPARATOR}(?:bearer\x20+|basic\x20+)?["'`]?([^\s"'`<>,;]+)""", re.IGNORECASE | re.ASCII)
#: A quoted value with blanks in it.
QUOTED = re.compile(rf"""(?<![A-Za-z]){CREDENTIAL}{SEPARATOR}(["'`])([^"'`\n]*\x20[^"'`\n]*)\1""", re.IGNORECASE | re.ASCII)
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]+:([^\s:/@]+)@")
#: Texts without a match of this, which never misses one of the above, are not looked at again.
MAYBE = (
    r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|://[^\s:/@]+:[^\s:/@]+@"
    r"|(?i:pass|pwd|pin|cred|bearer|auth|login|key|wort|losung|geheim|ssel|zugangs|contrase|clave|secreto|mdp|jeton|cl[\x{e9}\x{c9}])[\p{L}\x20]*[\"']?"
    r"(?:\x20*(?::=|=>|->|[:=])|\x20+(?i:is|was|ist|war|lautet|es|era|est|[\x{e9}\x{c9}]tait)\x20)"
)

#: A value is a secret from this many decimal digits of guesses on.
GUESSES = 10.0
#: Lengths of the words of the corpus, and levels of frequency to a doubling.
LENGTHS, LEVELS = (4, 16), 16
#: Least length of a value: one character less takes fewer guesses than a secret, even by brute force alone.
SHORTEST = 6
#: Digits of guesses for one more segment.
SEGMENT = 0.3

# Frequent passwords and words in them, the most frequent first.
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login abc iloveyou sunshine princess football baseball "
    "shadow superman michael jordan hunter trustno ashley bailey passw0rd charlie donald freedom whatever starwars hello secret "
    "summer winter spring autumn flower test guest root user default changeme example sample demo temp system server database "
    "mysql oracle postgres backup access token key pass word pin code private public account client service none null true false "
    "the and for you are not with this that from have love baby angel happy lucky money magic power black white green blue red "
    "orange silver golden purple yellow january february march april june july august september october november december monday "
    "tuesday wednesday thursday friday saturday sunday apple google computer internet windows linux company office home family"
).split()
# Rows of the keyboard and running orders.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop")
# Characters that stand for letters.
LEET = str.maketrans("@4831!0$57", "aaebiiosst")

RANK = {word: i + 1 for i, word in enumerate(WORDS)}
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
NEXT |= {(b, a) for a, b in NEXT}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?[01]?\d[-/._]?[0-3]?\d|[0-3]?\d[-/._][01]?\d[-/._](?:19|20)?\d\d|(?:19|20)\d\d", re.ASCII)
UNITS = 6
WORD = re.compile("[a-z]+")


def guess_digits(value: str, ranks: dict[str, int] = RANK) -> float:
    """Decimal digits of the guesses that the cheapest segmentation of ``value`` takes; ``ranks`` of words of at most 16 letters."""
    n = len(value)
    lower = value.lower()
    if len(lower) != n:
        lower = value
    leet = lower.translate(LEET)
    ways: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for size in range(3, min(LENGTHS[1], n - i) + 1):
            for folded, extra in ((lower, 0.0), (leet, 0.6)):
                if rank := ranks.get(folded[i : i + size]):
                    raised = 0.0 if value[i : i + size] == lower[i : i + size] else 0.3 if value[i].isupper() else 1.0
                    ways[i].append((i + size, math.log10(rank + 1) + extra + raised))
                    break
        if value[i].isdigit() and (m := DATE.match(value, i)):
            ways[i].append((m.end(), 2.1 if m.end() - i == 4 else 4.6))
    walk = run = 0
    for i in range(1, n):  # walks and running orders, from their last character back to their first
        walk = walk + 1 if (lower[i - 1], lower[i]) in NEXT else 0
        if walk >= 2 and (i + 1 == n or (lower[i], lower[i + 1]) not in NEXT):
            ways[i - walk].append((i + 1, math.log10(47 * (walk + 1))))
    for unit in range(1, min(UNITS, n // 2) + 1):
        run = 0
        for i in range(n - unit - 1, -1, -1):
            run = run + 1 if value[i] == value[i + unit] else 0
            times = run // unit + 1
            if times >= 3 or times == 2 and unit >= 3:
                ways[i].append((i + times * unit, unit + math.log10(times)))
    best = [0.0] + [math.inf] * n  # cheapest of the first i characters
    brute = math.inf  # the same, if the last segment is brute force
    for i in range(n):
        brute = min(brute, best[i] + SEGMENT) + 1
        best[i + 1] = min(best[i + 1], brute)
        for end, cost in ways[i]:
            best[end] = min(best[end], best[i] + cost + SEGMENT)
    return best[n]


class Span(NamedTuple):
    start: int
    order: int
    end: int
    value_start: int
    value_end: int

    @property
    def kind(self) -> str:
        return KINDS[self.order]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    found = [Span(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for order, pattern in ((1, ACCESS), (2, HEX)):
        found += [Span(m.start(), order, m.end(), m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def values_of(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """(start, end) of all values that stand where a credential stands, in order."""
    found = {(s.value_start, s.value_end) for s in base if s.order == 0}
    for pattern, group in ((CONTEXT, 1), (URL, 1), (QUOTED, 2)):
        for m in pattern.finditer(text):
            a, b = m.span(group)
            while b > a and text[b - 1] in ".!?)]}|":
                b -= 1
            if b - a >= SHORTEST:
                found.add((a, b))
    return sorted(found)


def held(base: list[Span]) -> Callable[[int, int], bool]:
    """Whether one span holds a stretch whole."""
    starts = [s.start for s in base]
    reach = [s.end for s in base]  # the furthest end of this span and those before
    for i in range(1, len(reach)):
        reach[i] = max(reach[i], reach[i - 1])
    return lambda a, b: (i := bisect_right(starts, a)) > 0 and reach[i - 1] >= b


def find_spans(text: str, digits: float = GUESSES, ranks: dict[str, int] = RANK) -> list[Span]:
    """All spans of one text, in order, with the words of ``ranks``."""
    base = base_spans(text)
    inside = held(base)
    guessed = [Span(a, 3, b, a, b) for a, b in values_of(text, base) if not inside(a, b) and guess_digits(text[a:b], ranks) >= digits]
    return sorted(base + guessed)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with the secret values (of assignments, what is assigned) replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted((s.value_start, s.value_end) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


# Costs of all values of a table


def hits(texts: pa.StringArray) -> Iterator[tuple[int, str]]:
    found = pc.indices_nonzero(pc.match_substring_regex(texts, MAYBE))
    yield from zip(found.to_pylist(), texts.take(found).to_pylist(), strict=True)


def words_in(text: str, values: list[tuple[int, int]]) -> Iterator[str]:
    """The words that lie in ``values``, each place of the text counted once."""
    at = 0
    for a, b in values:
        yield from WORD.findall(text[max(a, at) : b].lower())
        at = max(at, b)


def value_pieces(value: str) -> Iterator[str]:
    """All stretches of a value that may be words of the corpus."""
    lower = value.lower()
    if len(lower) != len(value):
        lower = value
    for folded in dict.fromkeys((lower, lower.translate(LEET))):
        for m in WORD.finditer(folded):
            for i in range(m.start(), m.end() - LENGTHS[0] + 1):
                for end in range(i + LENGTHS[0], min(i + LENGTHS[1], m.end()) + 1):
                    yield folded[i:end]


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, word) for every stretch of every value."""

    def batch_of(values: list[str], words: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, type=pa.string()), pa.array(words, type=pa.string())], names=["value", "word"])

    values: list[str] = []
    words: list[str] = []
    for batch in batches:
        for value in batch.column("value").to_pylist():
            for word in value_pieces(value):
                values.append(value)
                words.append(word)
                if len(words) >= 1 << 14:
                    yield batch_of(values, words)
                    values, words = [], []
    if words:
        yield batch_of(values, words)


def cost_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digits = []
        for value, known in zip(batch.column("value").to_pylist(), batch.column("known").to_pylist(), strict=True):
            ranks = {k["word"]: k["rank"] for k in known or ()}
            digits.append(guess_digits(value, ranks | RANK))
        yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(digits, type=pa.float64())], names=["value", "digits"])


def word_ranks(texts: DataFrame, value_words: DataFrame) -> DataFrame:
    """(word, rank) of all words of the corpus; ``value_words`` (word, n) are those that lie in values, which don't count."""
    some = F.length("word").between(*LENGTHS)
    own = texts.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word")).where(some).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = own.unionByName(value_words.where(some).select("word", (-F.col("n")).alias("n"))).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    counted = written(counted.select("word", F.floor(F.log2("n") * LEVELS).cast("int").alias("level")), "words")
    levels = counted.groupBy("level").count().collect()  # at most LEVELS a doubling
    above, ranks = len(RANK), []
    for r in sorted(levels, key=lambda r: -r["level"]):
        ranks.append((r["level"], above + 1))
        above += r["count"]
    level_ranks = texts.sparkSession.createDataFrame(ranks, "level int, rank long")
    return counted.join(F.broadcast(level_ranks), "level").select("word", "rank")  # a row a level


def value_costs(texts: DataFrame, values: DataFrame, value_words: DataFrame) -> DataFrame:
    """(value, digits) of every different value."""
    different = written(values.select("value").distinct(), "values")
    pieces_of = different.mapInArrow(piece_rows, "value string, word string").distinct()
    known = pieces_of.join(word_ranks(texts, value_words), "word").groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("known"))
    return written(different.join(known, "value", "left").select("value", "known").mapInArrow(cost_rows, "value string, digits double"), "costs")


FOUND = "array<struct<start:int,end:int,value:string,held:boolean>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("held", pa.bool_())]))
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("order", pa.int32()), ("end", pa.int32())]))
_WORDS = pa.list_(pa.string())


def found_in(text: str) -> tuple[list[Span], list[dict], list[str]]:
    """Base spans, values and the words in them of one text."""
    base = base_spans(text)
    values = values_of(text, base)
    inside = held(base)
    return base, [{"start": a, "end": b, "value": text[a:b], "held": inside(a, b)} for a, b in values], list(words_in(text, values))


def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for part in pieces(batch, "text"):
            column = plain(part.column("text"))
            n = len(column)
            counts = [[0] * n for _ in range(3)]
            sums, spans, values, words = [nothing] * n, [[]] * n, [[]] * n, [[]] * n
            for i, text in hits(column):
                base, values[i], words[i] = found_in(text)
                for s in base:
                    counts[s.order][i] += 1
                sums[i] = hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
                spans[i] = [{"start": s.start, "order": s.order, "end": s.end} for s in base]
            numbers = [pa.array(x, type=pa.int64()) for x in counts]
            columns = [part.column("doc_id"), *numbers, pa.array(sums, type=pa.string()), pa.array(spans, type=_BASE), pa.array(values, type=_FOUND), pa.array(words, type=_WORDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "values", "words"])


def counted_words(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def scan(docs: DataFrame, digits: float = GUESSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess and costs (start:end:digits of each value) of every row."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,order:int,end:int>>, values {FOUND}, words array<string>"
    scanned = written(texts.mapInArrow(scan_rows, schema).withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = scanned.select("row", F.explode("values").alias("v")).select("row", "v.*")
    met = each.join(value_costs(texts, each, counted_words(scanned)), "value")
    cost = F.struct("start", "end", "digits", "held")
    costs = met.groupBy("row").agg(F.array_sort(F.collect_list(cost)).alias("costs"))
    got = scanned.join(costs, "row", "left").withColumn("costs", F.coalesce("costs", F.array().cast("array<struct<start:int,end:int,digits:double,held:boolean>>")))
    guess = F.transform(F.filter("costs", lambda c: (c["digits"] >= digits) & ~c["held"]), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("order"), c["end"].alias("end")))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat("base", guess)), lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string")))
    told = F.transform("costs", lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"), F.format_string("%.2f", c["digits"])))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"), F.size(guess).cast("long").alias("n_guess"), F.array_join(told, ",").alias("costs"))


def suspect_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, value, held) of the values, and (key, word) of the words in them, of the rows that have any."""
    for batch in batches:
        for part in pieces(batch, "text"):
            column, keys = plain(part.column("text")), part.column("key")
            rows = []
            for i, text in hits(column):
                _, values, words = found_in(text)
                if values:
                    rows.append((keys[i].as_py(), sorted({v["value"] for v in values if not v["held"]}), [v["value"] for v in values], words))
            if rows:
                key, free, values, words = zip(*rows, strict=True)
                columns = [pa.array(key, type=pa.int64()), *(pa.array(x, type=_WORDS) for x in (free, values, words))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "free", "values", "words"])


def redacted(docs: DataFrame, digits: float = GUESSES) -> DataFrame:
    """``docs`` with the secrets in its column text replaced; all rows and columns stay.

    Which values are secret is found first, by rows of equal text; the table of them is joined to the rows, broadcast only if Spark
    finds it small enough.
    """
    text = F.col("text").cast("string")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    texts = docs.select(key.alias("key"), text.alias("text"))
    suspects = written(texts.mapInArrow(suspect_rows, "key long, free array<string>, values array<string>, words array<string>"), "suspects")
    costs = value_costs(texts, suspects.select(F.explode("values").alias("value")), counted_words(suspects))
    free = suspects.select("key", F.explode("free").alias("value")).distinct()
    # A value's cost is its own, so texts that share a key by chance still have the right values replaced.
    secret = written(free.join(costs.where(F.col("digits") >= digits), "value").groupBy("key").agg(F.collect_list("value").alias("__secrets")), "secret")
    columns = docs.columns
    met = docs.withColumn("__key", key).join(secret.withColumnRenamed("key", "__key"), "__key", "left").select(*columns, "__secrets")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in pieces(batch, "text"):
                out, secrets = part.column(at).to_pylist(), part.column(len(columns))
                for i, whole in hits(plain(part.column(at))):
                    base = base_spans(whole)
                    known = set(secrets[i].as_py() or ())
                    inside = held(base)
                    guessed = [Span(a, 3, b, a, b) for a, b in values_of(whole, base) if whole[a:b] in known and not inside(a, b)] if known else []
                    out[i] = redact(whole, sorted(base + guessed))
                yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string()) if k == at else c for k, c in enumerate(part.columns[:-1])], names=columns)

    return met.mapInArrow(rows, docs.schema)
