"""Keyed surrogates for personal data, consistent in type and distinct over a corpus.

Mentions are found in every whole text: e-mail addresses, telephone numbers, IPv4 and
IPv6 addresses, payment cards (Luhn), IBANs (mod 97), social security numbers, secrets
given to a name such as token or password, and persons (a title, a greeting or farewell, a
phrase such as "my name is", or a known given name before capitalised words).  A name found so is
looked for again in the same text, so that later mentions by surname alone are replaced as
well.  Names that nothing introduces are not found.

A mention stands for one or two entities, each a kind and a normalised value: digits
without separators, lower-cased addresses, domain and whole address of an e-mail,
each name by itself with its script.  An entity's surrogate comes from a keyed hash
of kind, value and the number of the attempt.  It keeps length, character classes,
separators and upper case of the mention, the country of telephone numbers and IBANs,
the first digit of cards, check digits, top-level domains, and the script of names.
A name is a male or female given name or a family name for the whole corpus, as most of its mentions are used (ties: family, then
female), and its surrogate is of that kind.  The same entity thus has the same surrogate
wherever it occurs, in every format and setting.

Collision checks work on the table of distinct entities: of entities of a kind with
the same surrogate, as it is written, the one with the fewest attempts, then the smallest value, keeps
it, and one whose surrogate occurs in the corpus as an original never does; the
others go on to their next attempt, until none is left.  From attempt ``WIDEN`` on a
surrogate gets longer, so a format with few values cannot run out.  Scans of texts
then only need the entities beyond their first attempt, and names used otherwise than they look by themselves.  These are sent to the tasks
if there are ``most_sent`` at most, else they are joined to the texts that hold them.

Defined results: null stays null and empty stays empty, without entities; texts of any
length are read whole; repeated rows each give a row with the same surrogates; rows
without an id are rows like others; an empty table gives none.  Overlapping mentions:
the one that starts first counts, then the longer one, then the earlier kind of KINDS.
Other columns never matter.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "secret", "iban", "ip", "ip6", "phone", "card", "ssn", "person")
WIDEN = 16
SALTS = 16
ENTITY = "kind string, value string, use string"

# --- mentions ------------------------------------------------------------------------------------------------

LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:[a-z0-9]{1,20}[_-])?(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.=-]{8,200}|(?=[A-Za-z]*[0-9])[A-Za-z0-9]{6,7})(?![A-Za-z0-9+/_=-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IP = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])")
FULL_IP6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
HEX_OR_COLON = set("0123456789abcdefABCDEF:")
# Country calling codes of one and two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "17", set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
PHONE = re.compile(r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
                   r"|(?<![\w(+])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])|(?<![0-9.+-])[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}(?![0-9-])")
NATIONAL = re.compile(r"0[1-9][0-9]{1,4}[ /-][0-9]{5,9}")
CARD = re.compile(r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
WORD = re.compile(r"[^\W\d_]+")

# Titles by gender, and common given names: fixed values.
TITLES = {
    "m": "mr mister sir herr herrn monsieur señor sr don signor господин κύριος κύριο",
    "f": "mrs ms miss madam lady frau madame mademoiselle mme señora señorita sra srta doña signora госпожа κυρία",
    "x": "dr prof professor",
}
GIVEN = {
    "m": "james john robert michael william david richard thomas charles peter paul george hans jürgen klaus wolfgang stefan jean pierre michel "
         "philippe louis josé juan carlos miguel antonio иван сергей дмитрий алексей николай γιώργος γιάννης νίκος",
    "f": "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna emma julia ursula monika sabine petra marie isabelle nathalie "
         "sophie maría carmen ana laura елена ольга наталья анна мария μαρία ελένη κατερίνα",
}
LOWER_TITLES = set("monsieur madame mademoiselle señor señora señorita don doña господин госпожа κύριος κύριο κυρία".split())  # written without a capital too
# Words after which a capitalised run is a person: greetings, farewells and introductions, fixed values.
CUES = ("dear;hi;hello;regards;sincerely;cheers;my name is;i am called;liebe;lieber;grüße;ich heiße;mein name ist;cher;chère;cordialement;je m'appelle;"
        "querido;querida;estimado;estimada;saludos;me llamo;mi nombre es").split(";")
# Written small or with a capital; without a look behind, so that a search skips to their first letters.
CUE = re.compile("(?:" + "|".join(sorted({re.escape(w) for c in CUES for w in (c, c[0].upper() + c[1:])}, reverse=True)) + r")[ ,\n]{1,3}(?=([^\W\d_]))")
TITLE_OF = {w: g for g, words in TITLES.items() for w in words.split()}
GIVEN_OF = {w: g for g, words in GIVEN.items() for w in words.split()}


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_rest(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def ip_address_6(text: str) -> str:
    """All eight groups of an address, four digits each; empty if it is none."""
    try:
        return IPv6Address(text).exploded.lower()
    except ValueError:
        return ""


def script_of(word: str) -> str:
    return unicodedata.name(word[0], "OTHER").split()[0].lower()


def capitalised(word: str) -> bool:
    return word[0].isupper() and (len(word) == 1 or word[1:].islower() or word.isupper())


def _emails(text: str) -> Iterator[tuple[int, int, str, str]]:
    at = text.find("@")
    while at >= 0:
        local, domain = LOCAL.search(text[max(0, at - 64) : at]), DOMAIN.match(text, at + 1)
        if local and domain:
            yield at - len(local.group()), domain.end(), "email", text[at - len(local.group()) : domain.end()].lower()
        at = text.find("@", at + 1)


def beside(text: str, start: int, end: int, more: str) -> bool:
    """Whether a letter, a digit or one of some characters stands right before or behind a stretch."""
    around = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    return around[0].isalnum() or around[1].isalnum() or around[0] in more or around[1] in more.replace(".", "")


def _addresses_6(text: str) -> Iterator[tuple[int, int, str, str]]:
    if text.count(":") < 2:
        return
    spots = {m.start() for m in FULL_IP6.finditer(text)} if text.count(":") >= 7 else set()
    at = text.find("::")
    while at >= 0:
        spots.add(at)
        at = text.find("::", at + 2)
    done = 0
    for at in sorted(spots):
        start = end = at
        while start > done and text[start - 1] in HEX_OR_COLON and at - start < 40:
            start -= 1
        while end < len(text) and text[end] in HEX_OR_COLON and end - at < 40:
            end += 1
        found = text[start:end]
        if sum(map(bool, found.split(":"))) >= 3 and any(c.isdigit() for c in found) and not beside(text, start, end, ":"):
            value = ip_address_6(found)
            if value:
                yield start, end, "ip6", value
        done = max(done, end)


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in IP.finditer(text):
        if all(int(o) < 256 for o in m.group().split(".")):
            yield *m.span(), "ip", ".".join(str(int(o)) for o in m.group().split("."))
    yield from _addresses_6(text)
    for m in NATIONAL.finditer(text):
        if not beside(text, *m.span(), "_.+/-") and 8 <= len(digits := re.sub("[^0-9]", "", m.group())) <= 15:
            yield *m.span(), "phone", f"0|{digits}"
    for m in PHONE.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 8 <= len(digits) <= 15:
            code = 0 if m.group()[0] != "+" else 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3
            yield *m.span(), "phone", f"{digits[:code] or '1'}|{digits[code:]}"
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if luhn_digit(digits[:-1]) == digits[-1] and digits[0] != "0":
            yield *m.span(), "card", digits
    for m in SSN.finditer(text):
        if m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00":
            yield *m.span(), "ssn", re.sub("[^0-9]", "", m.group())
    for m in IBAN.finditer(text):
        value = m.group().replace(" ", "")
        if 15 <= len(value) <= 34 and iban_rest(value[:2], value[2:4], value[4:]) == 1:
            yield *m.span(), "iban", value


def usual(name: str) -> str:
    """What a name looks like by itself: m or f for a known given name, else family."""
    return GIVEN_OF.get(name, "family")


def cues_in(text: str) -> set[int]:
    """Where a capitalised word follows a greeting, a farewell or an introduction."""
    return {m.end() for m in CUE.finditer(text) if m.group(1).isupper() and not (m.start() and text[m.start() - 1].isalpha())}


def _persons(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """One mention for each name: value is "<script>:<name>", with how it is used there (m, f or family)."""
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    cued = cues_in(text)
    known: dict[str, str] = {}

    def gap(i: int) -> str:
        return text[words[i][1] : words[i + 1][0]]

    i = 0
    while i < len(words):
        low = words[i][2].lower()
        title = TITLE_OF.get(low) if words[i][2][0].isupper() or low in LOWER_TITLES else None
        given = GIVEN_OF.get(low) if capitalised(words[i][2]) else None
        cue = words[i][0] in cued and not title
        first = i + 1 if title else i
        if title and i + 1 < len(words) and gap(i) not in (" ", ". ") or not (title or given or cue):
            i += 1
            continue
        last = first
        while last < len(words) and last - first < 4 and capitalised(words[last][2]) and len(words[last][2]) > 1 and (last == first or gap(last - 1) in (" ", "-")):
            last += 1
        names = [words[k][2] for k in range(first, last)]
        if names and (title or cue or len(names) > 1):
            for k, name in enumerate(names):
                low = name.lower()
                before_family = k < len(names) - 1 and gap(first + k) == " "
                gender = GIVEN_OF.get(low) or (title if title not in (None, "x") and before_family else None)
                known.setdefault(low, gender if gender and (before_family or low in GIVEN_OF) else "family")
        i = max(last, i + 1)
    if known:
        for start, end, word in words:
            if capitalised(word) and (use := known.get(word.lower())):
                yield start, end, "person", f"{script_of(word.lower())}:{word.lower()}", use


def used_mentions(text: str | None) -> list[tuple]:
    """(start, end, kind, value) of all mentions, in order, without overlaps; behind a name stands how it is used."""
    if not text:
        return []
    found: list[tuple] = []
    if "@" in text:
        found += _emails(text)
    if any(d in text for d in "0123456789"):
        found += _numbers(text)
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret", m.group(1)) for m in SECRET.finditer(text)]
    if PERSON_HINT.search(text) or cues_in(text):
        found += _persons(text)
    if len(found) < 2:
        return found
    out: list[tuple] = []
    for m in sorted(found, key=lambda m: (m[0], -m[1], KINDS.index(m[2]))):
        if not out or m[0] >= out[-1][1]:
            out.append(m)
    return out


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    return [m[:4] for m in used_mentions(text)]


PERSON_HINT = re.compile("(?<![^\\W\\d_])(?:" + "|".join(sorted({form for w in (*TITLE_OF, *GIVEN_OF) for form in (w.capitalize(), w.upper(), *({w} & LOWER_TITLES))})) + ")(?![^\\W\\d_])")


def entities_of(kind: str, value: str) -> list[tuple[str, str]]:
    """The entities that a mention needs surrogates for."""
    return [("email", value), ("domain", value.split("@")[1])] if kind == "email" else [(kind, value)]


# --- surrogates ----------------------------------------------------------------------------------------------


class Stream:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, *what: object):
        self.seed, self.key, self.block, self.left = "\0".join(map(str, what)).encode(), key, 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = blake2b(self.seed + self.block.to_bytes(4, "big"), key=self.key[:64]).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x * n >> 32

    def of(self, choices: str) -> str:
        return choices[self.below(len(choices))]


DIGITS, LOWER, UPPER_CASE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Sounds of made-up names by script: consonants, vowels, female endings, male endings.
SOUNDS = {
    "latin": ("bdfgklmnprstv", "aeiou", "a", "dklnrst"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "внрсйт"),
    "greek": ("βγδζκλμνπρστφ", "αειου", "α", "ςν"),
}


def like(s: Stream, text: str, by_place: bool = False) -> str:
    """Letters and digits replaced by others of their class; hexadecimal digits of both classes by any, unless ``by_place``."""
    hexadecimal = not by_place and len(text) >= 16 and re.fullmatch("(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)", text)
    if hexadecimal:
        return "".join(s.of("0123456789abcdef") for _ in text) if text == text.lower() else "".join(s.of("0123456789ABCDEF") for _ in text)
    return "".join(s.of(DIGITS) if c in DIGITS else s.of(LOWER) if c in LOWER else s.of(UPPER_CASE) if c in UPPER_CASE else c for c in text)


def made_name(s: Stream, script: str, name: str, use: str, more: int) -> str:
    sounds = SOUNDS.get(script)
    if sounds is None:  # letters of the same class from the same stretch of the character table
        near = lambda c: [x for x in map(chr, range(ord(c) & ~31, (ord(c) | 31) + 1)) if unicodedata.category(x) == unicodedata.category(c)]
        return "".join(s.of("".join(near(c))) for c in name + name[-1] * more)
    consonants, vowels, female, male = sounds
    syllables = "".join(s.of(consonants) + s.of(vowels) for _ in range(2 + s.below(2) + more))
    if use != "family":
        return syllables[:-1] + s.of(female) if use == "f" else syllables + s.of(male)
    if script == "cyrillic":
        return syllables[:-1] + ("ова" if name.endswith(("ова", "ева", "ина", "ая")) else "ов")
    return syllables + s.of(male)


@lru_cache(maxsize=50_000)
def surrogate(key: bytes, kind: str, value: str, attempt: int, use: str | None = None) -> str:
    """The surrogate, as a normalised value, that an attempt gives an entity; ``use`` of a name: m, f or family."""
    s = Stream(key, kind, value, attempt)
    more = max(0, attempt - WIDEN + 1)
    tail = lambda chars: "".join(s.of(chars) for _ in range(more))
    if kind == "email":
        local, domain = value.split("@")
        return like(s, local) + tail(LOWER) + "@" + domain
    if kind == "domain":
        labels, top = value.rsplit(".", 1)
        return like(s, labels) + tail(LOWER) + "." + top
    if kind == "secret":
        return like(s, value) + tail(LOWER)
    if kind == "ip":
        least, most = {1: 1, 2: 10, 3: 100}, {1: 9, 2: 99, 3: 255}
        octets = [s.below(256) if more else least[len(o)] + s.below(most[len(o)] - least[len(o)] + 1) for o in value.split(".")]
        return ".".join(map(str, octets + [attempt] * (more > WIDEN)))
    if kind == "ip6":
        return ":".join(f"{(0 if int(g, 16) == 0 and not more else s.below(65536)):04x}" for g in value.split(":"))
    if kind == "phone":
        code, rest = value.split("|")
        return code + "|" + ("0" if rest[:1] == "0" else "") + s.of("23456789") + "".join(s.of(DIGITS) for _ in rest[2 if rest[:1] == "0" else 1:]) + tail(DIGITS)
    if kind == "card":
        body = value[0] + "".join(s.of(DIGITS) for _ in value[1:-1]) + tail(DIGITS)
        return body + luhn_digit(body)
    if kind == "ssn":
        area = 1 + s.below(898)
        return f"{area + (area >= 666):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}" + tail(DIGITS)
    if kind == "iban":
        body = like(s, value[4:], True) + tail(DIGITS)
        return value[:2] + f"{98 - iban_rest(value[:2], '00', body):02d}" + body
    script, name = value.split(":", 1)
    return script + ":" + made_name(s, script, name, use or usual(name), more)


def cased(made: str, mention: str) -> str:
    if len(made) == len(mention):
        return "".join(m.upper() if o.isupper() else m for m, o in zip(made, mention))
    if mention.isupper() and len(mention) > 1:
        return made.upper()
    return made[:1].upper() + made[1:] if mention[:1].isupper() else made


def in_format(digits: str, mention: str) -> str:
    """``digits`` between the separators of ``mention``; what is left over follows."""
    left = iter(digits)
    return "".join(next(left, "") if c.isalnum() else c for c in mention) + "".join(left)


def replaced(kind: str, value: str, mention: str, key: bytes, attempts: dict[tuple[str, str], tuple[int, str | None]]) -> str:
    """What takes the place of a mention."""
    get = lambda k, v: surrogate(key, k, v, *attempts.get((k, v), (0, None)))
    if kind == "email":
        local, domain = value.split("@")
        at = mention.index("@")
        return cased(get("email", value).split("@")[0], mention[:at]) + "@" + cased(get("domain", domain), mention[at + 1 :])
    new = get(kind, value)
    if kind == "phone":
        return in_format((new.split("|")[0] if mention[0] == "+" else "") + new.split("|")[1], mention)
    if kind in ("card", "ssn", "iban"):
        return in_format(new, mention)
    if kind == "ip6":
        return as_written(new, mention)
    return cased(new.split(":", 1)[1], mention) if kind == "person" else new


def as_written(address: str, mention: str) -> str:
    """An address in full, or short as the mention is, in its case."""
    out = IPv6Address(address).compressed if "::" in mention or len(mention) < 39 else address
    return out.upper() if mention.isupper() else out


def rewritten(text: str, key: bytes, attempts: dict[tuple[str, str], tuple[int, str | None]]) -> tuple[str, list[dict]]:
    """The text with surrogates, and its mentions (kind, first place and length in the text given)."""
    out, done, found = [], 0, []
    for start, end, kind, value in mentions(text):
        out += [text[done:start], replaced(kind, value, text[start:end], key, attempts)]
        found.append({"kind": kind, "start": start, "length": end - start})
        done = end
    return "".join([*out, text[done:]]) if found else text, found


# --- over a corpus -------------------------------------------------------------------------------------------


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row columns, kind, value, use) of the distinct entities of every text, the last column; use only for names."""
    for batch in batches:
        at, rows = [], []
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            mine = sorted({(*e, m[4] if m[2] == "person" else "") for m in used_mentions(text) for e in entities_of(m[2], m[3])})
            at += [i] * len(mine)
            rows += mine
        kept = batch.select(range(batch.num_columns - 1)).take(pa.array(at, pa.int32())).columns if batch.num_columns > 1 else []
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], names=[*batch.schema.names[:-1], "kind", "value", "use"])


def one_use(found: DataFrame) -> DataFrame:
    """Distinct entities (kind, value, use) with the use that most texts make of a name (ties: family, then f); none for other kinds."""
    counts = found.groupBy("kind", "value", "use").agg(F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("use") == "family", 2).when(F.col("use") == "f", 1).otherwise(0)
    return counts.groupBy("kind", "value").agg(F.max_by("use", F.struct("n", order)).alias("use")).select("kind", "value", F.nullif("use", F.lit("")).alias("use"))


def with_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``entities`` (kind, value, use, attempt) with the surrogate of the attempt."""
    names = ("kind", "value", "attempt", "use")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, *row) for row in zip(*(batch.column(c).to_pylist() for c in names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.string())], names=[*names, "made"])

    return entities.select(*names).mapInArrow(run, "kind string, value string, attempt int, use string, made string")


def settled(entities: DataFrame, key: bytes) -> DataFrame:
    """Rows (kind, value, attempt, use, made) for distinct entities (kind, value, use): surrogates are distinct and no originals."""
    state = written(with_surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        originals = state.select(F.col("kind").alias("k"), F.col("value").alias("m"))
        first = state.groupBy(F.col("kind").alias("k"), F.col("made").alias("m")).agg(F.min(F.struct("attempt", "value")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        own = state.withColumn("me", F.struct("attempt", "value"))
        same = (own.kind == first.k) & (own.made == first.m)
        clash = own.join(first, same).where("me <> first").select("kind", "value")
        taken = state.join(originals, (F.col("kind") == F.col("k")) & (F.col("made") == F.col("m")), "left_semi").select("kind", "value")
        losers = written(clash.unionByName(taken).distinct(), "collisions")
        if losers.isEmpty():
            return state
        again = state.join(losers, ["kind", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        state = written(state.join(losers, ["kind", "value"], "left_anti").unionByName(with_surrogates(again, key)), "surrogates")


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most_sent: int = 100_000) -> DataFrame:
    """``keep`` columns with surrogate_text and the mentions replaced (kind, start, length)."""
    spark = docs.sparkSession
    n = len(keep)
    names = [f"_{i}" for i in range(n)]
    rows = docs.select(*(docs[c].alias(a) for c, a in zip(keep, names)), docs[text].alias("_text"))
    found = one_use(rows.select("_text").mapInArrow(_entities, ENTITY))
    looks = F.pandas_udf(lambda v: v.map(lambda x: usual(x.split(":", 1)[-1])), "string")
    later = settled(found, key).where((F.col("attempt") > 0) | (F.col("use").isNotNull() & (F.col("use") != looks("value")))).select("kind", "value", "attempt", "use")
    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    schema = (kept_schema + ", " if names else "") + "surrogate_text string, mentions array<struct<kind:string,start:int,length:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def answer(batch: pa.RecordBatch, texts: list, attempts: Iterator[dict]) -> pa.RecordBatch:
        done = [(None, []) if t is None else rewritten(t, key, a) for t, a in zip(texts, attempts)]
        return pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([t for t, _ in done], pa.string()), pa.array([m for _, m in done], kind)], names=[*names, "surrogate_text", "mentions"])

    if later.count() <= most_sent:
        sent = spark.sparkContext.broadcast({(r.kind, r.value): (r.attempt, r.use) for r in later.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            attempts = sent.value
            for batch in batches:
                texts = batch.column(n).to_pylist()
                yield answer(batch, texts, [attempts] * len(texts))

        return rows.mapInArrow(run, schema).toDF(*keep, "surrogate_text", "mentions")

    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")
    held = numbered.select("_row", "_text").mapInArrow(_entities, "_row long, " + ENTITY).drop("use").withColumn("salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
    salted = later.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    of_row = held.join(salted, ["kind", "value", "salt"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "value", "attempt", "use")).alias("_later"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later_of = batch.column(n + 1).to_pylist()
            yield answer(batch, batch.column(n).to_pylist(), ({(e["kind"], e["value"]): (e["attempt"], e["use"]) for e in x or ()} for x in later_of))

    both = numbered.join(of_row, "_row", "left").select(*names, "_text", "_later")
    return both.mapInArrow(joined, schema).toDF(*keep, "surrogate_text", "mentions")


def op8_surrogates(spark: SparkSession, sf_dir: str, key: bytes = b"corpus surrogates") -> DataFrame:
    done = pseudonymised(table(spark, sf_dir, "documents"), key)
    return done.select("doc_id", F.size("mentions").cast("long").alias("n_entities"), F.array_sort(F.array_distinct(F.col("mentions.kind"))).alias("kinds"),
                       F.sha2(F.col("surrogate_text").cast("binary"), 256).alias("text_sha256"), F.col("surrogate_text").alias("text"))
