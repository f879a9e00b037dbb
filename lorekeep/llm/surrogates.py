"""Personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, phone numbers, payment card numbers, IPv4 addresses, social security numbers, quoted secrets
(token = "...", and key, secret, password), issued keys and long hexadecimal ones, bank account numbers (IBAN), and names
after a title. Every later or earlier mention of a detected entity in the same text goes with it: the whole name, each of its
words where it stands alone, and any other entity wherever its characters stand again. A word of a name that is an ordinary
word too (it is in ORDINARY, or stands in lower case in the text) is left alone at the start of a sentence, and elsewhere goes
only as the surname.

A surrogate keeps what the format shows: separators, letter case, script, digit or letter at each place, a card's first digit
and whether its check digit holds, an IBAN's country and whether its check digits hold, a phone's country code, a mail
address's top-level domain. A name word that is in one of the lists of given names (by gender) and surnames becomes another
of the same list; any other keeps its pattern of vowels and consonants, its script and its last letter, which often shows
gender. Punctuation around an entity is not part of it.

One entity has one surrogate however it is written: a mail address in any case, a phone number or an IBAN with any
separators, an IP address with leading zeros, a name word in any context. A surrogate is the image of the entity's canonical
form under a keyed permutation of all forms of its shape that is one single cycle (a Feistel network, walked until inside the
range, around an addition of one). So equal entities get equal surrogates in all documents, different ones different
surrogates, and none its own value, without a table of entities. `collisions` checks this over a table of all distinct
entities: a surrogate that two originals share, or an original that stayed.

The key belongs to the caller; who has it can undo the permutation. The query takes it from spark.lorekeep.surrogate.secret (a name
that Spark's own redaction hides) and, where that is unset, draws one for the application that is kept in the driver's memory alone.

Defined results: null and empty texts have no entities and become empty texts. A masked value (one symbol or x repeated) is no
entity and stays. Each row is treated alone, so repeated rows get equal results; null ids and further columns stay as they
are. Bytes that are not UTF-8 count as U+FFFD. Very long texts are read whole. An empty table gives an empty table. The same key gives
the same surrogates in every run.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, text_of

KEY_SETTING = "spark.lorekeep.surrogate.secret"
_drawn: dict[str, str] = {}

# Titles before names, the letters that pattern a surrogate name, names by kind, country codes of phones.
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
ALPHABETS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "accented": ("áéíóúàèìòùâêîôûäëïöü", "çñšžčřłśźż"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
    "cyrillic": ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"),
}
NAMES = {
    "female": "alice amelia amy angela anna barbara beatrice carla caroline catherine charlotte clara claudia diana elena elizabeth emily emma eva helen ines irene isabel jane jennifer jessica julia karen laura linda lisa lucy maria marie martha mary nancy nina olivia patricia rachel rebecca rosa ruth sandra sarah sofia sophie susan teresa vera victoria",
    "male": "adam albert andrew anthony arthur benjamin bruno carlos charles christopher daniel david edward eric felix francis frank george hans henry hugo isaac jack jacob james jan john jorge joseph juan karl kevin lewis louis luis mark martin matthew michael nicolas oliver oscar pablo patrick paul pedro peter philip richard robert samuel simon stefan steven thomas victor walter william",
    "surname": "adams allen anderson bailey baker bauer becker bell bennett bernard brooks brown campbell carter clark cohen collins cooper costa cox cruz davies davis diaz dubois edwards evans ferrari fischer flores foster garcia gomez gonzalez gray green hall harris hernandez hill hoffmann howard hughes jackson johnson jones keller kelly khan king klein lambert lee lewandowski lopez martinez meyer miller moore moreau morgan morris murphy nelson novak parker patel perez phillips ramirez reed reyes rivera roberts robinson rossi russell sanchez schmidt schneider schulz scott silva simmons smith stewart sullivan taylor thompson torres turner wagner walker ward watson weber white wilson wood wright young",
}
ORDINARY = frozenset("august april bill black brown carter cook dean drew faith frank gene grace grant gray green hall hill hope in jack joy june king long mark may miller old on page pat prince reed rich rose sue taylor turner victor walker ward white will wood young".split())
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"

_CLASS = {c: a for pair in ALPHABETS.values() for a in pair for c in a}
_LIST = {w: names for names in (tuple(x.split()) for x in NAMES.values()) for w in names}
_CODES_2 = frozenset(CODES_2.split())
_PUNCTUATION = "!#$%&()*+,-./:;<=>?@[]^_{|}~"


def _marks() -> str:
    """All combining marks of the first plane, as ranges of a character class: they are parts of a word too."""
    at = [k for k in range(0x300, 0x10000) if unicodedata.category(chr(k))[0] == "M"]
    runs = [[x for _, x in g] for _, g in groupby(enumerate(at), lambda p: p[1] - p[0])]
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


_LETTER = rf"(?:[^\W\d_]|[{_marks()}])"
_NAME = rf"[^\W\d_]{_LETTER}+(?:['’-]{_LETTER}+)*"
PATTERNS: list[tuple[str, str]] = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    ("secret", r"(?i:(?<=token)|(?<=key)|(?<=secret)|(?<=password)|(?<=passwd))\s*[=:]\s*[\"'](?P<value>[^\"'\s]{6,})[\"']"),
    ("key", r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![\w-])"),
    ("hex", r"(?<!\w)(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,64}(?!\w)"),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?!\w)"),
    ("ssn", r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("card", r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])(?!\.[0-9])"),
    ("phone", r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)(?!\.[0-9])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w])(?!\.[0-9])"),
    ("name", rf"(?:(?<=^)|(?<=\W))(?:{'|'.join(map(re.escape, TITLES))}) (?P<name>{_NAME}(?: {_NAME}){{0,2}})"),
]
_ANY = re.compile("|".join(f"(?P<{n}>{p})" if n != "name" else f"(?P<titled>{p})" for n, p in PATTERNS))
_BARE = re.compile("|".join(f"(?P<{n}>{p})" for n, p in PATTERNS if n in ("key", "hex")))
#: What stands between two sentences, or before the first.
_ENDS = re.compile(r"(?:^|[.!?:;…。\n])[\s\"'“”„«»()\[\]*_>-]*$")
#: A text without a title and without any of these has no entity: each pattern asks for one of them.
_HINT = re.compile(r"[0-9@=:]|AKIA|gh[pousr]_|sk-|eyJ")


def _feistel(x: int, bits: int, key: bytes, back: bool) -> int:
    half = bits // 2
    low = (1 << half) - 1
    left, right = x >> half, x & low
    for r in reversed(range(8)) if back else range(8):
        turn = lambda v: int.from_bytes(hashlib.blake2b(v.to_bytes(32 + half // 8, "big") + bytes([r]), key=key, digest_size=min(64, half // 8 + 9)).digest(), "big") & low  # noqa: B023, E731
        if back:
            left, right = right ^ turn(left), left
        else:
            left, right = right, left ^ turn(right)
    return left << half | right


def permuted(x: int, size: int, key: bytes) -> int:
    """A keyed permutation of range(size) that is one cycle: nothing stays where it is if size > 1."""
    if size < 2:
        return x
    bits = max(2, (size - 1).bit_length())
    bits += bits % 2

    def walk(v: int, back: bool) -> int:
        while True:
            v = _feistel(v, bits, key, back)
            if v < size:
                return v

    return walk((walk(x, True) + 1) % size, False)


@lru_cache(maxsize=4096)
def _alike(c: str) -> str:
    """The characters of c's category and script in its stretch of 128 code points, but for those of ALPHABETS."""
    sort = lambda x: (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0])
    start = ord(c) & ~127
    return "".join(x for x in map(chr, range(start, start + 128)) if sort(x) == sort(c) and x.lower() not in _CLASS)


def _is_hex(text: str) -> bool:
    """Lower or upper hexadecimal, with digits and letters both."""
    return re.fullmatch(r"(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)", text, re.ASCII) is not None


def _wordlike(text: str) -> bool:
    return any(c.isalnum() for c in text)


def _places(text: str, kind: str) -> list[str]:
    """For each character that may change, the characters it may become; others are single."""
    out = []
    hexadecimal = kind in ("secret", "hex") and _is_hex(text)
    symbols = kind == "secret" and not _wordlike(text)
    for k, c in enumerate(text):
        low = c.lower()
        if hexadecimal:
            out.append("0123456789abcdef" if text == text.lower() else "0123456789ABCDEF")
        elif c.isdecimal() and not "0" <= c <= "9":
            zero = ord(c) - unicodedata.decimal(c)
            out.append("".join(chr(zero + k) for k in range(10)))
        elif "0" <= c <= "9":
            # The first digits of some groups keep to 2-9 or to 0-1: area codes and the like.
            first = kind == "ssn" and (k == 0 or not text[k - 1].isdigit()) or kind == "phone" and (k == 0 or k == 3 and len(text) == 10)
            out.append("23456789" if first and c >= "2" else "01" if first else "0123456789")
        elif low in _CLASS and len(low) == 1:
            own = _CLASS[low]
            out.append(own if c == low else own.upper() if len(own.upper()) == len(own) else c)
        elif symbols and c in _PUNCTUATION:
            out.append(_PUNCTUATION)
        elif c.isalpha() or symbols:
            out.append(_alike(c))
        else:
            out.append(c)
    return out


def _moved(text: str, kind: str, key: bytes, keep: Callable[[str], bool] | None = None) -> str:
    """Text with every changeable place moved by one permutation of all their values, on to the next of those that `keep` admits."""
    places = _places(text, kind)
    shape = "".join(p if len(p) == 1 else p[0] for p in places)
    x, size = 0, 1
    for c, p in zip(text, places, strict=True):
        x, size = x * len(p) + p.index(c), size * len(p)
    own = hashlib.blake2b(f"{kind}|{shape}|{size}".encode(), key=key, digest_size=32).digest()
    while True:
        x = y = permuted(x, size, own)
        out = []
        for p in reversed(places):
            y, r = divmod(y, len(p))
            out.append(p[r])
        new = "".join(reversed(out))
        if size < 2 or keep is None or keep(new):
            return new


def luhn(digits: str) -> int:
    """The check digit that completes the digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(country: str, check: str, account: str) -> int:
    """The remainder of an IBAN that its check digits set to 1."""
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def _valid_iban(plain: str) -> bool:
    return _mod97(plain[:2], plain[2:4], plain[4:]) == 1 and plain[2:4] not in ("00", "01", "99")


def _country_code(digits: str) -> int:
    """Length of the country code that an international number starts with."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _CODES_2 else 3


def _phone_parts(text: str) -> tuple[str, str]:
    """(country code, national digits); ten digits without a code are of country 1."""
    digits = re.sub(r"\D", "", text)
    if text.startswith("+"):
        n = min(_country_code(digits), len(digits) - 1)
        return digits[:n], digits[n:]
    return "1", digits


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity."""
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "phone":
        return "+" + " ".join(_phone_parts(text))
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "card":
        return re.sub(r"\D", "", text)
    return text


def _refilled(text: str, new: str, goes: Callable[[str], bool]) -> str:
    """The text with its characters of a sort replaced one after the other."""
    it = iter(new)
    return "".join(next(it) if goes(c) else c for c in text)


def name_word(word: str, key: bytes) -> str:
    """The surrogate of one word of a name, whatever stands around it."""
    cased = str.upper if word.isupper() else str.capitalize if word == word.capitalize() else None
    listed = _LIST.get(word.lower()) if cased else None
    if listed:
        own = hashlib.blake2b(f"list|{listed[0]}".encode(), key=key, digest_size=32).digest()
        return cased(listed[permuted(listed.index(word.lower()), len(listed), own)])
    free = lambda w: not (w.lower() in _LIST and w in (w.upper(), w.capitalize()))
    if sum(len(p) > 1 for p in _places(word[:-1], "name")):
        return _moved(word[:-1], f"name-{word[-1]}", key, lambda w: free(w + word[-1])) + word[-1]
    return _moved(word, "name", key, free)


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of one entity, in the format of this mention."""
    if kind == "email":
        local, _, domain = text.lower().partition("@")
        name, _, top = domain.rpartition(".")
        return f"{_moved(local, kind, key)}@{_moved(name, 'host', key)}.{top}"
    if kind == "card":
        digits = canonical(kind, text)
        middle = _moved(digits[1:-1], kind, key)
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10
        return _refilled(text, digits[0] + middle + str((luhn(digits[0] + middle) + off) % 10), str.isdigit)
    if kind == "key":
        n = 3 if text.startswith(("sk-", "eyJ")) else 4  # what names the issuer stays
        return text[:n] + _moved(text[n:], kind, key)
    if kind == "iban":
        plain = canonical(kind, text)
        if not _valid_iban(plain):  # account numbers whose check digits do not hold go to others of that sort
            return _refilled(text, plain[:2] + _moved(plain[2:], "account", key, lambda x: not _valid_iban(plain[:2] + x)), lambda c: c != " ")
        account = _moved(plain[4:], kind, key)
        return _refilled(text, f"{plain[:2]}{98 - _mod97(plain[:2], '00', account):02d}{account}", lambda c: c != " ")
    if kind == "phone":
        code, national = _phone_parts(text)
        new = _moved(national, kind, hashlib.blake2b(code.encode(), key=key, digest_size=32).digest())
        return _refilled(text, code + new if text.startswith("+") else new, str.isdigit)
    if kind == "ip":
        parts = [int(x) for x in text.split(".")]
        first = range(1, 224) if 1 <= parts[0] < 224 else [0, *range(224, 256)]
        x, size = list(first).index(parts[0]), len(first)
        for p in parts[1:]:
            x, size = x * 256 + p, size * 256
        y = permuted(x, size, hashlib.blake2b(f"ip|{size}".encode(), key=key, digest_size=32).digest())
        tail = []
        for _ in range(3):
            y, r = divmod(y, 256)
            tail.append(r)
        return ".".join(map(str, [list(first)[y], *reversed(tail)]))
    if kind == "name":
        return " ".join(name_word(w, key) for w in text.split(" "))
    return _moved(text, kind, key, _is_hex if _is_hex(text) else lambda x: not _is_hex(x))


def _changeable(kind: str, text: str) -> bool:
    return any(len(p) > 1 for p in _places(text, kind))


def _masked(value: str) -> bool:
    """A value that shows nothing: one character repeated, no letter or digit but x."""
    return len(set(value)) == 1 and (value[0] in "xX" or not value[0].isalnum())


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, from, to) of every entity that its own form or surroundings show, left to right, without overlaps."""
    if not _HINT.search(text) and not any(t in text for t in TITLES):
        return []
    out = []
    for m in _ANY.finditer(text):
        kind = m.lastgroup
        if m["value"] is not None:
            if not _masked(m["value"]) and _changeable("secret", m["value"]):
                # A key that is known by its own form is the same entity with and without a word before it.
                bare = _BARE.fullmatch(m["value"])
                out.append((bare.lastgroup if bare else "secret", *m.span("value")))
        elif m["name"] is not None:
            # A name's words are capitalised where the script has capitals.
            words = []
            for w in m["name"].split(" "):
                if w[0].islower() or not _changeable("name", w):
                    break
                words.append(w)
            if words:
                out.append(("name", m.start("name"), m.start("name") + len(" ".join(words))))
        elif kind == "ip" and m[0] in ("127.0.0.1", "0.0.0.0", "255.255.255.255"):
            continue  # addresses of no one
        else:
            out.append((kind, *m.span()))
    return out


def mentions(text: str) -> list[tuple[str, int, int]]:
    """detect(), and between these every further mention of the entities found."""
    found = detect(text)
    if not found:
        return found
    again: dict[str, str] = {}
    lone: dict[str, bool] = {}  # words of names that are not all of one, and whether they may be a surname
    for kind, a, z in found:
        if kind == "name":
            words = text[a:z].split(" ")
            for k, w in enumerate(words):
                again |= dict.fromkeys((w, w.upper()), "name")
                for x in (w, w.upper()):
                    lone[x] = lone.get(x, False) or (k == len(words) - 1 and x == w)
        again[text[a:z]] = kind
    ordinary = {w for w in lone if w.lower() != w and (w.lower() in ORDINARY or re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", text))}

    def goes(m: re.Match) -> bool:
        return m[0] not in ordinary or (lone[m[0]] and not _ENDS.search(text, max(0, m.start() - 40), m.start()))

    # A script that writes no spaces shows no ends of words.
    alone = lambda w: ("" if unicodedata.category(w[0]) == "Lo" else r"(?<!\w)") + re.escape(w) + ("" if unicodedata.category(w[-1]) == "Lo" else rf"(?!{_LETTER}|\w)")
    search = re.compile("|".join(map(alone, sorted(again, key=len, reverse=True)))).finditer
    out, at = [], 0
    for kind, a, z in [*found, ("", len(text), len(text))]:
        out += [(again[m[0]], *m.span()) for m in search(text, at, a) if goes(m)]
        if kind:
            out.append((kind, a, z))
        at = z
    return out


def replaced(text: str, key: bytes, known: dict | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, original, surrogate) of each mention, in canonical forms."""
    found, out, at = [], [], 0
    known = {} if known is None else known
    for kind, a, z in mentions(text):
        original = text[a:z]
        new = known.get((kind, original))
        if new is None:
            if len(known) > 100_000:
                known.clear()
            new = known[kind, original] = surrogate(kind, original, key)
        out += [text[at:a], new]
        at = z
        found.append((kind, canonical(kind, original), canonical(kind, new)))
    return "".join(out) + text[at:] if found else text, found


def _rows(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for b in batches:
        done = [replaced(t, key, known) for t in b.column(1).to_pylist()]
        kinds = [", ".join(sorted({f"{k}:{sum(x[0] == k for x in f)}" for k, _, _ in f})) for _, f in done]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "text", "n_entities", "kinds"]
        )


def _entities(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for b in batches:
        found = {e for t in b.column(0).to_pylist() for e in replaced(t, key, known)[1]}
        kind, original, new = zip(*sorted(found), strict=True) if found else ((),) * 3
        digest = [hashlib.blake2b(o.encode(), key=key, digest_size=16).hexdigest() for o in original]
        same = [o == s for o, s in zip(original, new, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((kind, pa.string()), (digest, pa.string()), (new, pa.string()), (same, pa.bool_()))], names=["kind", "original", "surrogate", "unchanged"])


def _in_place(batches: Iterator[pa.RecordBatch], key: bytes, column: int) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for b in batches:
        texts = [None if t is None else replaced(t, key, known)[0] for t in b.column(column).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(k).type) if k == column else c for k, c in enumerate(b.columns)], names=b.schema.names)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))


def surrogated(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities, kinds): every text with its entities replaced."""
    return map_batches(_texts(docs), partial(_rows, key=key), "doc_id long, text string, n_entities long, kinds string")


def replaced_texts(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The table with its texts replaced, all other columns as they were."""
    valid = docs.withColumn(text, F.make_valid_utf8(docs[text].cast("string")))
    return map_batches(valid, partial(_in_place, key=key, column=docs.columns.index(text)), valid.schema)


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate, n_originals): surrogates that two entities share, or that equal their entity; none is expected."""
    ledger = map_batches(_texts(docs).select("text"), partial(_entities, key=key), "kind string, original string, surrogate string, unchanged boolean").distinct()
    by = ledger.groupBy("kind", "surrogate").agg(F.count("*").alias("n_originals"), F.max("unchanged").alias("unchanged"))
    return by.filter("n_originals > 1 or unchanged").select("kind", "surrogate", "n_originals")


def session_key(spark: SparkSession) -> bytes:
    """The key set in KEY_SETTING (any text), else one drawn for this session."""
    named = spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return hashlib.blake2b(named.encode(), digest_size=32).digest()


def checked(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents, once no two of their entities share a surrogate and none keeps its own value."""
    shared = collisions(docs, key).count()
    if shared:
        raise ValueError(f"{shared} surrogates are shared by different entities or equal their own")
    return docs


def op8_surrogates(spark, sf_dir: str) -> DataFrame:
    key = session_key(spark)
    return surrogated(checked(spark.read.parquet(f"{sf_dir}/documents.parquet"), key), key)
