"""Text functions: tokens, similarity, scrubbing, dates, stems.

Everything but the stemmer, Unicode normalisation and the chunker is a plain
column expression.  Those three are Python functions, which the operators apply
to distinct vocabulary terms or in Arrow batches.
"""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function words that never act as query terms.
STOP_WORDS = (
    "about above after again against ain all am an and any are aren as at be because been before being "
    "below between both but by can couldn did didn do does doesn doing don down during each few for from "
    "further had hadn has hasn have haven having he her here hers herself him himself his how if in into "
    "is isn it its itself just ll ma me mightn more most mustn my myself needn no nor not now of off "
    "on once only or other our ours ourselves out over own re same shan she should shouldn so some such "
    "than that the their theirs them themselves then there these they this those through to too under until up "
    "ve very was wasn we were weren what when where which while who whom why will with won wouldn you "
    "your yours yourself yourselves"
).split()

# Words that count as each other in a search, one group a line.
SYNONYM_GROUPS = [line.split() for line in """
auth authentication authn authenticating
authz authorization authorizing
db database datastore
perf performance latency throughput slow bottleneck
optim optimization optimizing optimise query-optimization
k8s kubernetes kube
config configuration configuring setup
deps dependencies dependency
env environment
fn function
impl implementation implementing
msg message messaging
repo repository
req request
res response
ts typescript
js javascript
pg postgres postgresql
err error errors
api endpoint endpoints
ci continuous-integration
cd continuous-deployment
test testing tests
doc documentation docs
infra infrastructure
deploy deployment deploying
cache caching cached
log logging logs
monitor monitoring
observe observability
sec security secure
validate validation validating
migrate migration migrations
debug debugging
container containerization docker
crash crashloop crashloopbackoff
webhook webhooks callback
middleware mw
paginate pagination
serialize serialization
encrypt encryption
hash hashing
""".strip().splitlines()]

# Credentials, in the order in which they are replaced (Java regular expressions).
SECRET_PATTERNS = [
    r"""(?i)(?:api[_-]?key|secret|token|password|credential|auth)\s*[=:]\s*["']?[A-Za-z0-9_\-/.+]{20,}["']?""",
    r"""(?i)(?:api[_-]?key|secret|password|passwd|pwd)\s*[=:]\s*["']?[^\s"']+["']?""",
    r"(?i)Bearer\s+[A-Za-z0-9._\-+/=]{20,}",
    r"(?<![A-Za-z0-9])sk-proj-[A-Za-z0-9\-_]{20,}",
    r"(?<![A-Za-z0-9])(?:sk|pk|rk|ak)-[A-Za-z0-9][A-Za-z0-9\-_]{19,}",
    r"(?<![A-Za-z0-9])sk-ant-[A-Za-z0-9\-_]{20,}",
    r"gh[pus]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"xoxb-[A-Za-z0-9\-]+",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[A-Za-z0-9\-_]{35}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"npm_[A-Za-z0-9]{36}",
    r"glpat-[A-Za-z0-9\-_]{20,}",
    r"dop_v1_[A-Za-z0-9]{64}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
]
# Text that a match of the pattern in the same place must hold; looked for first, as most texts hold none.
SECRET_HINTS = [("=", ":"), ("=", ":"), ("bearer",), ("sk-proj-",), ("sk-", "pk-", "rk-", "ak-"), ("sk-ant-",), ("ghp_", "ghu_", "ghs_"), ("github_pat_",), ("xoxb-",), ("AKIA",), ("AIza",), ("eyJ",),
                ("npm_",), ("glpat-",), ("dop_v1_",), ("-----BEGIN ",)]
PRIVATE_BLOCK = r"(?is)<private>.*?</private>"
URL_CREDENTIAL = r"(?i)((?<![a-z0-9+.-])[a-z][a-z0-9+.-]*://[^\s:@/]+:)[^\s@/]+(@)"

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
NOT_TOKEN = r"[^\p{L}\p{N}/.\\\]^_]+"


def tokens(text: Column) -> Column:
    """Lower-case search tokens of two characters or more; hyphens split, ``/ . \\ ] ^ _`` stay. Null: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_TOKEN), lambda t: F.char_length(t) >= 2)


def cjk_tokens(text: Column) -> Column:
    """As ``tokens``, but each run of Han, Kana or Hangul gives its overlapping pairs of characters (a run of one: itself)."""
    runs = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_TOKEN, " "),
                                F.lit(f"[{CJK}]+|[^{CJK} ]+"), F.lit(0))

    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{CJK}]"), pairs).otherwise(F.filter(F.array(run), lambda t: F.char_length(t) >= 2))

    return F.flatten(F.transform(runs, pieces))


def without_stop_words(terms: Column) -> Column:
    """Query side only: a term goes if it is a stop word once the punctuation at its edges is off."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(terms, lambda t: ~F.array_contains(stop, F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))


def word_set(text: Column, longer_than: int = 2) -> Column:
    """Distinct lower-case words, cut at white space, longer than ``longer_than``."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f\x0B]+"), lambda t: F.char_length(t) > longer_than))


def distinctive_terms(text: Column) -> Column:
    """Distinct runs of three letters or digits and more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def jaccard(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """Shared share of two token sets; where one is empty, 1 if the texts agree up to white space, else 0."""
    squeezed = lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    same = F.when(squeezed(text_a) == squeezed(text_b), 1.0).otherwise(0.0)
    some = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), same).otherwise(some)


def scrub(text: Column) -> Column:
    """Private blocks, credentials and passwords in URLs replaced by a mark."""
    lower = F.lower(text)

    def guarded(out: Column, hints: tuple[str, ...], pattern: str, mark: str) -> Column:
        hit = F.lit(False)
        for h in hints:
            hit = hit | F.contains(lower if h in ("bearer", "<private>") else text, F.lit(h))
        # A lambda's variable stands for the text so far, which would otherwise be written out twice at every step.
        return F.transform(F.array(out), lambda x: F.when(hit, F.regexp_replace(x, pattern, mark)).otherwise(x))[0]

    out = guarded(text, ("<private>",), PRIVATE_BLOCK, "[REDACTED]")
    for hints, pattern in zip(SECRET_HINTS, SECRET_PATTERNS, strict=True):
        out = guarded(out, hints, pattern, "[REDACTED_SECRET]")
    return guarded(out, ("://",), URL_CREDENTIAL, "$1[REDACTED_SECRET]$2")


def date_terms(ts: Column) -> Column:
    """Terms for a record's day, month and day of the month in UTC; a null date gives none."""
    made = F.array(F.date_format(ts, "'@'yyyy-MM-dd"), F.date_format(ts, "'@'yyyy-MM"), F.date_format(ts, "'@'MM-dd"))
    return F.when(ts.isNull() | (F.year(ts) < 1000) | (F.year(ts) > 9999), F.array().cast("array<string>")).otherwise(made)


def iso_dates(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)))


def different_dates(a: Column, b: Column) -> Column:
    """Both texts name dates and share none."""
    x, y = iso_dates(a), iso_dates(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 3).cast("long")


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the trimmed, lower-cased text."""
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 16)


def middle_out(text: Column, limit: int = 2000, mark: str = "\n...\n") -> Column:
    half = (limit - len(mark)) // 2
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half))))


# ---------------------------------------------------------------- stems

# Suffix and replacement; the first that matches ends its step.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("iser", "ise"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("isation", "ise"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("alise", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
# Endings that go after a long enough stem.
STEP_4 = "ement ment tion sion ance ence able ible ism ate iti ous ive ize ise ant ent al er ic ou".split()


def _measure(part: str) -> int:
    return len(re.findall("[aeiouy]+[^aeiouy]+", part))


def _doubled(word: str) -> bool:
    return re.search(r"([^aeiou])\1$", word) is not None


def _short_syllable(word: str) -> bool:
    return re.search(r"[^aeiou][aeiou][^aeiouwxy]$", word) is not None


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if re.search("[^s]s$", word) else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    cut = re.fullmatch(r"(.*[aeiou].*)(ed|ing)", word, re.S)
    if not cut:
        return word
    rest = cut[1]
    if _doubled(rest) and rest[-1] not in "lsz":
        return rest[:-1]
    silent = rest.endswith(("at", "bl", "iz")) or _measure(rest) == 1 and _short_syllable(rest)
    return rest + "e" if silent else rest


def _mapped(word: str, table: list[tuple[str, str]]) -> str:
    for suffix, to in table:
        if word.endswith(suffix):
            base = word[:-len(suffix)]
            return base + to if _measure(base) else word
    return word


def stem(word: str) -> str:
    """A reduced Porter stem."""
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and re.search("[aeiou]", word[:-1]):
        word = word[:-1] + "i"
    word = _mapped(_mapped(word, STEP_2), STEP_3)
    # the leftmost match is the longest ending
    ending = re.search(f"({'|'.join(STEP_4)})$", word)
    if ending and _measure(word[:ending.start()]) > 1:
        word = word[:ending.start()]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_syllable(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def synonym_pairs() -> list[tuple[str, str]]:
    """(stem, stem of another word of its group); as many as the groups above give, whatever the corpus."""
    out = set()
    for group in SYNONYM_GROUPS:
        stems = [stem(w) for w in group]
        out |= {(a, b) for a in stems for b in stems if a != b}
    return sorted(out)


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


# ---------------------------------------------------------------- chunks


def chunks(text: str | None, most: int = 1200, overlap: int = 150) -> list[str]:
    """Blocks between blank lines gathered up to ``most`` characters; a heading in capitals starts a chunk.

    A block that is too long breaks behind a line, a sentence or a word in its
    second half.  A chunk of a broken block repeats up to ``overlap`` characters
    of the one before, from the start of a word.  Null or blank text: none.
    """
    out: list[str] = []
    held = ""
    for block in re.split(r"\n\s*\n", text or ""):
        block = block.strip()
        if not block:
            continue
        heading = block.split("\n", 1)[0]
        starts = heading.isupper() and len(heading) < 80
        if held and (starts or len(held) + len(block) + 2 > most):
            out.append(held)
            held = ""
        held = f"{held}\n\n{block}" if held else block
        while len(held) > most:
            cut = max(next((at for at in (held.rfind(mark, most // 2, most) for mark in ("\n", ". ", " ")) if at > 0), most - 1) + 1, overlap + 1)
            out.append(held[:cut].rstrip())
            back = held.find(" ", cut - overlap, cut) + 1
            held = held[back if 0 < back < cut else cut:].lstrip()
    return [*out, held] if held else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_column(texts: pd.Series) -> pd.Series:
    return texts.map(chunks)


# ---------------------------------------------------------------- pieces of records


def one_line(value: Column) -> Column:
    """Line breaks, with the white space around them, become single spaces; the ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(value, r"\s*\n+\s*", " "), r"^\s+|\s+$", "")


def collapsed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def shortened(value: Column, limit: int, mark: str = "...") -> Column:
    """The head of a text, with a mark if something was cut."""
    return F.when(F.char_length(value) <= limit, value).otherwise(F.concat(F.left(value, F.lit(limit)), F.lit(mark)))


def xml_escaped(value: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def tag_neutralised(value: Column, tag: str) -> Column:
    """Closing tags of an element can't end it any more."""
    return F.regexp_replace(value, rf"(?i)</(\s*{tag})", "&lt;/$1")


def xml_values(value: Column, tag: str) -> Column:
    """The contents of all elements of a name that hold no other of it."""
    return F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(rf"<{tag}(?:\s[^>]*)?>([\s\S]*?)</{tag}>"), F.lit(1)), lambda x: F.trim(x))


def has_leaked_arguments(value: Column) -> Column:
    """Text that swallowed the arguments of a tool call after it: more than one piece of its markup, or the next key of a JSON list."""
    kinds = "pattern|preference|architecture|bug|workflow|fact"
    quote, open_quote = '["”]', '["“]'
    json_leak = rf"{quote}\s*,\s*{open_quote}(?:concepts{quote}\s*:|type{quote}\s*:\s*{open_quote}(?:{kinds}){quote})"
    markers = [r"(?i)</(?:[a-z]+:)?(?:parameter|invoke|function_calls)>", r"(?i)<parameter\s+name=", r"(?i)</content>"]
    n = sum((F.regexp_count(value, F.lit(m)) for m in markers), F.lit(0))
    return value.rlike(json_leak) | (n > 1)


def lesson_sentences(value: Column, most: int = 20) -> Column:
    """Distinct sentences of 20 to 220 characters that open with advice, in order; the first spelling of each stays."""
    start = r"(?i)^(always|never|don['’]?t|do not|make sure|remember to|prefer|avoid|note:|caveat:|warning:)\s"
    parts = F.split(F.coalesce(value, F.lit("")), r"\n+|(?<=[.!?])\s+")
    clean = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"^(?:[-*+>]|\d+[.)])\s+", ""), r"\s+", " "))
    count = lambda s, token: F.regexp_count(s, F.lit(token))
    good = lambda s: (F.char_length(s).between(20, 220) & s.rlike(start) & (count(s, r"\*\*") % 2 == 0) & (count(s, "`") % 2 == 0)
                      & (count(s, r"\[\[") == count(s, r"\]\]")))
    kept = F.filter(clean, good)
    lower = F.transform(kept, F.lower)
    first = F.filter(kept, lambda s, i: F.array_position(lower, F.lower(s)) == i + 1)
    return F.slice(first, 1, most)


# Capitalised words that name no entity of a question: fixed values.
ENTITY_STOP = ("The This That What When Where How Why Who Which Did Does Do Is Are Was Were Has Have Had Can Could Would Should Will May Might "
               "If And But Or Not For From With About After Before Between").split()


def query_entities(query: Column) -> Column:
    """Distinct phrases in double quotes and words with a capital of a query, without question words; null: none."""
    asked = F.coalesce(query, F.lit(""))
    quoted = F.regexp_extract_all(asked, F.lit('"([^"]+)"'), F.lit(1))
    words = F.regexp_extract_all(asked, F.lit(r"\b[A-Z][a-zA-Z0-9_.-]+\b"), F.lit(0))
    return F.array_distinct(F.concat(quoted, F.array_except(words, F.array(*[F.lit(w) for w in ENTITY_STOP]))))


def query_date_terms(query: Column, most: int = 5) -> Column:
    """Terms ``@yyyy-mm-dd``, ``@mm-dd`` and ``@yyyy-mm`` for the dates that a query names, as ``date_terms`` has them for records.

    ISO dates, "Month D[, Y]", "D Month [Y]" and "Month Y"; a month's name that is also a word (march, may)
    counts only with an ordinal, a year or after "on".
    """
    names = "january february march april may june july august september october november december".split()
    month = "(?:" + "|".join(rf"{n}|{n[:3]}" for n in names) + ")"
    low = F.lower(F.coalesce(query, F.lit("")))
    iso = F.transform(F.regexp_extract_all(low, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)), lambda d: F.concat(F.lit("@"), d))
    found = F.regexp_extract_all(low, F.lit(rf"(?:\bon )?\b{month} \d{{1,2}}(?:st|nd|rd|th)?(?!\d)(?:,? \d{{4}}\b)?|(?:\bon )?\b\d{{1,2}}(?:st|nd|rd|th)? {month}\b(?:,? \d{{4}}\b)?|\b{month} \d{{4}}\b"), F.lit(0))

    def term(s: Column) -> Column:
        name = F.regexp_extract(s, month, 0)
        mm = F.lit(None).cast("string")
        for i, n in enumerate(names):
            mm = F.when(F.startswith(name, F.lit(n[:3])), f"{i + 1:02d}").otherwise(mm)
        year = F.regexp_extract(s, r"\b(\d{4})\b", 1)
        day = F.regexp_extract(s, r"\b(\d{1,2})(?:st|nd|rd|th)?\b", 1)
        sure = ~name.isin("march", "may", "mar") | s.rlike(r"^on |\d(?:st|nd|rd|th)|\b\d{4}\b")
        full = F.when((day != "") & (year != ""), F.concat(F.lit("@"), year, F.lit("-"), mm, F.lit("-"), F.lpad(day, 2, "0")))
        made = F.coalesce(full, F.when(day != "", F.concat(F.lit("@"), mm, F.lit("-"), F.lpad(day, 2, "0"))), F.concat(F.lit("@"), year, F.lit("-"), mm))
        return F.when(sure & (F.coalesce(F.nullif(day, F.lit("")).cast("int"), F.lit(1)).between(1, 31)), made)

    return F.slice(F.array_distinct(F.array_compact(F.concat(iso, F.transform(found, term)))), 1, most)
