"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent over the whole corpus.

Emails, telephone numbers, IPv4 and IPv6 addresses, card numbers, IBANs, US social security numbers, access keys, quoted
tokens, passwords and names are detected. All but names are replaced by a keyed permutation of the strings of their own
format: each letter stays a letter of its script and case, each digit a digit, punctuation stays; card numbers and IBANs
keep the state of their check digits, an address stays in its network of NETWORKS or public, a telephone number keeps
its country and is one number however it is spaced; the American form without a country is of country 1. A permutation
maps different entities to different surrogates and one entity always to the same, without any table. Emails count as
equal whatever their case, which the surrogate takes from each mention.

Names are found behind a title of TITLES, in Latin, Cyrillic or Greek script, PARTICLES between their tokens staying, and
then wherever their tokens stand with a capital in the same text. A token that is an ordinary word too (one of ORDINARY,
or in lower case somewhere in the text) is replaced without a title only beside another token of the names or before a
word of SPEECH or a possessive. Each token (double-barrelled names have two) gets a keyed name of its gender, of its
script, in the case of the mention, with an accent where it had one, so that a surname alone still meets its full form.
The gender is the one that a title tells in the text; where none does, the one that titles of the whole corpus agree on
for this token, so that Dr John meets Mr John; where they do not agree or are silent, none. A corpus-wide check groups all surrogates and all names found, whatever their gender and script, and moves
on all but one of those that coincide; each move adds a syllable, so the stock never runs out.

The key is the caller's. With it the permutations can be inverted, so it must not be published with the result.

Defined cases: null text stays null with 0 entities; a surrogate never equals its original; overlapping detections go
to the leftmost, then the longest; neighbouring name tokens count as one entity; repeated rows give repeated results; rows
without doc_id are treated as all others; other columns, whatever their names, are kept by pseudonymise but for
n_entities, which gives way; an empty table gives no rows.
"""

from __future__ import annotations

import ipaddress
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineproof.llm.shared import batch, marked, sliced, stored

KEY_SETTING = "spark.lineproof.pii.key"
ROUNDS = 8
DETECT = re.compile(
    r"(?P<email>(?<![\w.+-])\w[\w.+%-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?P<secret>(?i:\b(?:token|secret|api[_-]?key|password|passwd|pwd)\b)\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_-]{8,}))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w+.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-]))"
)
#: Titles by the gender they tell; "" where they tell none. Lower case counts where the language writes titles so.
TITLES = {
    "Mr": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f",
    "Doña": "f", "Г-н": "m", "Господин": "m", "Г-жа": "f", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "", "Prof": "", "Др": "",
    "monsieur": "m", "señor": "m", "madame": "f", "señora": "f", "г-н": "m", "господин": "m", "г-жа": "f", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
UNTOLD = "?"
GENDER_CODES = {1: "m", 2: "f"}
#: Words between the tokens of a name; they stay.
PARTICLES = "af al bin da das de del della der den di do dos du el ibn la las le los ten ter van von vom zu zum zur".split()
#: English and German words that are names too.
ORDINARY = set(
    """art banks baker bell best bill bishop black booth bright brook brown bush butler carpenter chance chase clay cook cross day dean dawn drew english faith field fisher ford forest fox frank french
    gold good grace grant gray green hall hand hill holly hope house hunter ivy jack jean joy judge july june king knight lake lane law little long love major march mark marsh may miller mills moore
    north page park parks penny pope price rich rivers rob rose sharp short singer smart snow south spring star stone strong summer taylor trade turner wall ward waters weaver welsh west white will wise
    wolf wood woods words young groß jung klein koch kurz lang richter schwarz sommer stark stein vogt weber weiß winter wolf""".split()
)
#: Words of speech behind a mention.
SPEECH = re.compile(r"['’]s\b|,? (?:said|says|asked|asks|told|called|calls|wrote|writes|replied|added|answered|sagte|sagt|fragte|schrieb|rief)\b")
#: Networks of addresses that are not public, by their first address and the bits within; an address stays in its own.
NETWORKS = [("0.0.0.0", 24), ("10.0.0.0", 24), ("127.0.0.0", 24), ("169.254.0.0", 16), ("172.16.0.0", 20), ("192.168.0.0", 16), ("224.0.0.0", 28), ("240.0.0.0", 28)]
NETWORKS = [(int(ipaddress.IPv4Address(first)), 1 << bits) for first, bits in NETWORKS]
#: Country codes of one and of two digits; all others have three.
COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
TRUNK = re.compile(r"\(0\)")
UPPER_LETTER = "A-ZÀ-ÖØ-ÞĀ-ſΆ-ΫЀ-Я"
LETTER = r"[^\W\d_]"
TOKEN = rf"[{UPPER_LETTER}]{LETTER}*(?:['’-]{LETTER}{{2,}})*"
SMALL = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
NAME = re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})(\.? )({SMALL}{TOKEN}(?: (?:[{UPPER_LETTER}]\. )?{SMALL}{TOKEN}){{0,2}})")
#: What stands between tokens of one name.
GAP = re.compile(rf"[ -](?:[{UPPER_LETTER}]\. )?{SMALL}")
#: Parts of a name token that are names of their own; a possessive ending and single letters are none.
PART = re.compile(rf"{LETTER}{{2,}}")
POSSESSIVE = re.compile(r"['’][sS]$")
#: Syllables and gendered endings of surrogate names, by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ha he ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo wa we".split(),
    "cyrillic": "ба бе би бо ва ве ви во га го да де ди до жа за зо ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се си со та те ти то фа фе хо ча ша".split(),
    "greek": "βα βε βι βο γα γε γι γο δα δε δι δο ζα ζε ζω θα θε θο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φε".split(),
}
ENDINGS = {
    "latin": {"m": ["n", "r", "s", "k", "rt", "ld", "l", "m"], "f": ["na", "ra", "la", "sa", "ne", "lie", "ria", "tta"], "": ["n", "ne", "r", "l", "s", "le", "th", "x"]},
    "cyrillic": {"m": ["н", "р", "с", "к", "л", "м", "т", "й"], "f": ["на", "ра", "ла", "са", "ня", "лия", "рия", "та"], "": ["н", "р", "ль", "к", "с", "нко", "х", "т"]},
    "greek": {"m": ["ος", "ης", "ας", "ων", "ις", "ευς", "νος", "ρος"], "f": ["η", "α", "ια", "ις", "νη", "ρα", "λη", "τα"], "": ["ου", "η", "ας", "ης", "ίδη", "άκη", "ος", "ις"]},
}
PLAIN_VOWELS, ACCENTED = "aeiou", "áéíóú"


def key_of(spark: SparkSession) -> bytes:
    """The surrogate key that the session names in KEY_SETTING; without one a new random key, so that no two calls agree."""
    told = spark.conf.get(KEY_SETTING, None)
    return told.encode()[:64] if told else os.urandom(32)


def digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest(), "big")


def permuted(key: bytes, label: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size) or its inverse: a Feistel network on an even number of bits, walked into the range."""
    half = max(1, (size.bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ (digest(key, label, r, left) & mask), left
            else:
                left, right = right, left ^ (digest(key, label, r, right) & mask)
        value = left << half | right
        if value < size:
            return value


def moved_on(key: bytes, label: str, value: int, size: int) -> int:
    """The successor of value on one keyed cycle through all of range(size): a permutation without fixed points."""
    return permuted(key, label, (permuted(key, label, value, size) + 1) % size, size, back=True)


def span(first: str, last: str, without: str = "") -> str:
    return "".join(c for c in map(chr, range(ord(first), ord(last) + 1)) if c not in without)


RADIX = [("abcdefghijklmnopqrstuvwxyz", "a"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("0123456789", "0"), (span("à", "þ", "÷"), "à"), (span("À", "Þ", "×"), "À"), (span("а", "я"), "а"), (span("А", "Я"), "А"), (span("α", "ω", "ς"), "α"), (span("Α", "Ω", "\u03a2"), "Α")]
CLASS = {c: alphabet for alphabet, _ in RADIX for c in alphabet}
SHAPE = {c: mark for alphabet, mark in RADIX for c in alphabet}


def same_shape(key: bytes, label: str, text: str, alphabets: list[str] | None = None) -> str:
    """Permute a string among the strings of its shape; characters outside the alphabets stay."""
    alphabets = alphabets or [CLASS.get(c, "") for c in text]
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    shape = "".join(SHAPE.get(c, c) if a else c for c, a in zip(text, alphabets, strict=True))
    new = moved_on(key, f"{label}\x1f{shape}", value, size) if size > 1 else value
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            new, at = divmod(new, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Sum of a number with its check digit, modulo 10; 0 is valid."""
    return sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if d > "4" else int(d) * 2) for i, d in enumerate(reversed(digits))) % 10


def refill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def walk(key: bytes, label: str, text: str, fine) -> str:
    """Permute within the strings of the same shape that are as fine as the original."""
    want, out = fine(text), same_shape(key, label, text)
    while fine(out) != want:
        out = same_shape(key, label, out)
    return out


def cased(new: str, old: str) -> str:
    """new with the case of old, character by character."""
    return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, old, strict=True))


def iban_check(text: str) -> int:
    """The remainder that is 1 for a valid IBAN."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of one entity; injective within a kind."""
    if kind == "email":
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        local, _, domain = low.rpartition("@")
        labels = domain.split(".")
        return cased(same_shape(key, "local", local) + "@" + ".".join([same_shape(key, "label", x) for x in labels[:-1]] + labels[-1:]), text)
    if kind == "iban":
        solid = text.replace(" ", "")
        body = same_shape(key, "iban" + solid[:2], solid[4:])
        check = f"{98 - iban_check(solid[:2] + '00' + body):02d}"
        it = iter(solid[:2] + check + body)
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "ipv6":
        number = int(ipaddress.IPv6Address(text))
        new = ipaddress.IPv6Address(number >> 112 << 112 | moved_on(key, f"ipv6 {number >> 112}", number & (1 << 112) - 1, 1 << 112))
        out = str(new) if "::" in text else new.exploded if any(len(p) == 4 and p[0] == "0" for p in text.split(":")) else ":".join(f"{int(p, 16):x}" for p in new.exploded.split(":"))
        return out.upper() if text.upper() == text else out
    digits = "".join(c for c in text if c.isdigit())
    if kind == "card":
        state = luhn(digits)
        body = walk(key, "card", digits[:-1], lambda d: d[0])
        last = next(d for d in "0123456789" if luhn(body + d) == state)
        return refill(text, body + last)
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        number = int.from_bytes(bytes(octets), "big")
        network = lambda n: next(((first, size) for first, size in NETWORKS if first <= n < first + size), None)
        if home := network(number):
            new = home[0] + moved_on(key, f"ip {home[0]}", number - home[0], home[1])
        else:
            new = moved_on(key, "ip", number, 1 << 32)
            while network(new):
                new = moved_on(key, "ip", new, 1 << 32)
        return ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "phone":
        country = COUNTRY.match(text)[0] if text.startswith("+") else ""
        # A trunk zero in brackets is no part of the number.
        parts = TRUNK.split(text[len(country) :])
        national = "".join(c for part in parts for c in part if c.isdigit())
        new = walk(key, f"phone{country or '+1'}", national, lambda d: d[:1] > "1")
        out = []
        for part in parts:
            n = sum(c.isdigit() for c in part)
            out.append(refill(part, new[:n]))
            new = new[n:]
        return country + "(0)".join(out)
    if kind == "ssn":
        return refill(text, walk(key, "ssn", digits, lambda d: d[:3] not in ("000", "666") and d[0] != "9"))
    if kind == "key":
        return text[:4] + same_shape(key, "key", text[4:])
    if re.fullmatch("[0-9a-f]+", text):
        return same_shape(key, "hex", text, ["0123456789abcdef"] * len(text))
    return same_shape(key, "secret", text)


def script(token: str) -> str:
    c = token[0]
    return "cyrillic" if "\u0400" <= c <= "\u04ff" else "greek" if "\u0370" <= c <= "\u03ff" else "latin"


def name_surrogate(token: str, gender: str, attempt: int, key: bytes) -> str:
    """The lower-case surrogate of a lower-case token; each attempt has a syllable more, up to eight."""
    kind = script(token)
    n = digest(key, "name", gender, token, attempt)
    out, syllables = "", SYLLABLES[kind]
    for _ in range(min(3 + attempt, 8)):
        n, at = divmod(n, len(syllables))
        out += syllables[at]
    ends = ENDINGS[kind][gender]
    out += ends[n % len(ends)]
    if kind == "latin" and not token.isascii():
        at = next(i for i, c in enumerate(out) if c in PLAIN_VOWELS)
        out = out[:at] + ACCENTED[PLAIN_VOWELS.index(out[at])] + out[at + 1 :]
    return out if out != token else name_surrogate(token, gender, attempt + 1, key)


def name_tokens(text: str) -> dict[str, str]:
    """Lower-case parts of the titled names with their gender, UNTOLD where no title of the text tells it; surnames have none."""
    out: dict[str, str] = {}
    for m in NAME.finditer(text):
        tokens = [t for t in m[3].split(" ") if t not in PARTICLES]
        for i, token in enumerate(tokens):
            gender = (TITLES[m[1]] or UNTOLD) if i < len(tokens) - 1 else ""
            for part in PART.findall(POSSESSIVE.sub("", token)):
                # A token that is a surname somewhere in the text is one everywhere in it; a told gender goes before an untold one.
                if not gender or out.get(part.lower(), UNTOLD) == UNTOLD:
                    out[part.lower()] = gender
    return out


def gendered(names: dict[str, str], moved: dict[str, int]) -> dict[str, str]:
    """Names with what the corpus tells of untold genders."""
    return {t: GENDER_CODES.get(moved.get(f"{UNTOLD}:{t}"), "") if g == UNTOLD else g for t, g in names.items()}


def name_spans(text: str, names: dict[str, str], moved: dict[str, int], key: bytes) -> list[tuple[int, int, str, bool]]:
    """(start, end, new, True) of the mentions of the names' tokens that start with a capital; ordinary words need a title or a cue."""
    if not names:
        return []
    names = gendered(names, moved)
    mention = re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, sorted(names, key=lambda x: (-len(x), x))))})(?![^\W_])", re.IGNORECASE)
    every = [(m.start(), m.end(), m[0]) for m in mention.finditer(text) if m[0].lower() in names]
    plain = ORDINARY | {old for *_, old in every if old[0].islower()}
    every = [x for x in every if x[2][0].isupper()]
    titled = [(m.start(3), m.end(3)) for m in NAME.finditer(text)]
    starts = [s for s, _ in titled]
    beside = [bool(GAP.fullmatch(text, a[1], b[0])) for a, b in zip(every, every[1:], strict=False)]
    found = []
    for i, (start, end, old) in enumerate(every):
        token = old.lower()
        at = bisect_right(starts, start) - 1
        behind_title = at >= 0 and start < titled[at][1]
        cue = (i > 0 and beside[i - 1]) or (i < len(beside) and beside[i]) or SPEECH.match(text, end)
        if token in plain and not behind_title and not cue:
            continue
        new = name_surrogate(token, names[token], moved.get(f"{names[token]}:{token}", 0), key)
        found.append((start, end, new.upper() if old.isupper() else new.capitalize(), True))
    return found


def told_entity(m: re.Match, key: bytes) -> tuple[int, int, str, bool] | None:
    """(start, end, new, False) of a match of DETECT; null where its check tells that it is none."""
    kind = "secret" if m["secret"] else m.lastgroup
    start, end, text = (m.start("value"), m.end("value"), m["value"]) if kind == "secret" else (m.start(), m.end(), m[0])
    if kind == "card" and luhn("".join(c for c in text if c.isdigit())) and not 15 <= sum(c.isdigit() for c in text) <= 16:
        return None
    if kind == "iban" and iban_check(text.replace(" ", "")) != 1:
        return None
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        # Short forms without a digit are more often code than addresses.
        if int(ipaddress.IPv6Address(text)) < 1 << 32 or not SOME_DIGIT.search(text):
            return None
    return start, end, surrogate(kind, text, key), False


def replaced(text: str, moved: dict[str, int] | None, key: bytes) -> tuple[str, int]:
    """The text with surrogates and the number of entities replaced."""
    spans = []
    if "@" in text or SOME_DIGIT.search(text) or SECRET_WORD.search(text) or "::" in text:
        spans = [x for m in DETECT.finditer(text) if (x := told_entity(m, key))]
    if TITLE.search(text):
        spans = sorted(spans + name_spans(text, name_tokens(text), moved or {}, key), key=lambda x: (x[0], -x[1]))
    out, n, at, name_end = [], 0, 0, -1
    for start, end, new, is_name in spans:
        if start < at:
            continue
        # Tokens side by side are one name.
        n += not (is_name and name_end >= 0 and GAP.fullmatch(text, name_end, start))
        name_end = end if is_name else -1
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), n


SOME_DIGIT = re.compile("[0-9]")
SECRET_WORD = re.compile("(?i)token|secret|api.?key|passw|pwd")
TITLE = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? {SMALL}[{UPPER_LETTER}]")
TITLE_SQL = r"(?U)\b(" + "|".join(TITLES) + r")\.? " + SMALL + r"\p{Lu}"
NAMES = pa.schema([("id", pa.string()), ("token", pa.string()), ("gender", pa.string())])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = sorted({(i, *x) for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True) for x in name_tokens(t or "").items()})
        yield batch(NAMES, **{c: [x[k] for x in found] for k, c in enumerate(NAMES.names)})


def _told(key: bytes):
    schema = pa.schema([("token", pa.string()), ("gender", pa.string()), ("attempt", pa.int32()), ("s", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b[c].to_pylist() for c in ("token", "gender", "attempt")), strict=True))
            yield batch(schema, token=b["token"], gender=b["gender"], attempt=b["attempt"], s=[name_surrogate(t, g, a, key) for t, g, a in rows])

    return run


def collisions(names: DataFrame, key: bytes) -> DataFrame:
    """(token, gender, attempt) of the names that must move on: another name has their surrogate, or is it.

    Each round gives the moved names new surrogates and checks all names again, until no two share one.
    """
    state = stored(names.select("token", "gender").distinct().withColumn("attempt", F.lit(0)), "pii-names")
    real = state.select(F.col("token").alias("s"), F.lit(1).alias("real")).distinct()
    while True:
        told = stored(state.mapInArrow(_told(key), "token string, gender string, attempt int, s string"), "pii-names")
        least = told.groupBy("s").agg(F.min(F.struct("attempt", "token", "gender")).alias("m"), F.count(F.lit(1)).alias("n"))
        bad = least.join(real, "s", "left").filter("n > 1 or real = 1")
        if bad.isEmpty():
            return told.filter("attempt > 0").select("token", "gender", "attempt")
        both = told.join(bad, "s", "left")
        stays = F.col("n").isNull() | (F.col("real").isNull() & (F.col("m.token") == F.col("token")) & (F.col("m.gender") == F.col("gender")))
        state = both.select("token", "gender", (F.col("attempt") + F.when(stays, 0).otherwise(1)).cast("int").alias("attempt"))


def _replace(key: bytes):
    schema = pa.schema([("new", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            moved = [dict(m) if m else {} for m in b["moved"].to_pylist()]
            out = [(None, 0) if t is None else replaced(t, m, key) for t, m in zip(b["text"].to_pylist(), moved, strict=True)]
            told = batch(schema, new=[t for t, _ in out], n=[n for _, n in out])
            yield pa.RecordBatch.from_arrays([b["row"], *told.columns], ["row", "new", "n"])

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text replaced and n_entities beside its own columns. key: the caller's, up to 64 bytes."""
    row = F.struct(F.lit(0).alias("lineproof"), *[F.col(c) for c in docs.columns if c not in ("text", "n_entities")])
    rows = docs.select(F.col("text").cast("string").alias("text"), row.alias("row"))
    titled = rows.filter(F.col("text").rlike(TITLE_SQL)).select(F.md5("text").alias("id"), "text")
    names = stored(titled.mapInArrow(_names, "id string, token string, gender string"), "pii-mentions")
    # One row a token: the gender that the titles of the corpus agree on.
    told_of = names.filter(F.col("gender").isin("m", "f")).groupBy("token").agg(F.min("gender").alias("least"), F.max("gender").alias("most")).filter("least = most").select("token", F.col("least").alias("agreed"))
    asked_of = names.filter(F.col("gender") == UNTOLD).select("token").distinct()
    agreed = stored(asked_of.join(told_of, "token", "left").select("token", F.lit(UNTOLD).alias("gender"), F.coalesce("agreed", F.lit("")).alias("agreed")), "pii-genders")
    known = names.filter(F.col("gender") != UNTOLD).select("token", "gender").distinct().unionByName(agreed.select("token", F.col("agreed").alias("gender")))
    moved = stored(collisions(known, key), "pii-moved")
    # What a text must know of a token: its gender, and the number of moves of the name that it then is.
    as_given = moved.withColumn("gender_then", F.col("gender"))
    if_untold = agreed.join(moved.withColumnRenamed("gender", "agreed"), ["token", "agreed"], "left").select("token", "gender", "attempt", F.col("agreed").alias("gender_then"))
    code = F.lit(None).cast("int")
    for number, gender in GENDER_CODES.items():
        code = F.when((F.col("gender") == UNTOLD) & (F.col("gender_then") == gender), number).otherwise(code)
    needed = stored(as_given.unionByName(if_untold).withColumn("code", code).filter("attempt is not null or code is not null"), "pii-needed")
    empty = F.lit(None).cast("map<string,int>")
    if needed.isEmpty():
        told = rows.withColumn("moved", empty)
    else:
        # Texts that hold such a name meet it by their digest; all others stay where they are.
        entry = F.array(F.struct(F.concat_ws(":", "gender_then", "token").alias("k"), F.col("attempt").alias("v")), F.struct(F.concat_ws(":", F.lit(UNTOLD), "token").alias("k"), F.col("code").alias("v")))
        entries = names.distinct().join(needed, ["token", "gender"]).select("id", F.explode(entry).alias("e")).filter("e.v is not null")
        maps = entries.groupBy("id").agg(F.map_from_entries(F.collect_set("e")).alias("moved"))
        maps = stored(maps, "pii-maps")
        asked = marked(rows.withColumn("short", F.xxhash64(F.md5("text"))), "short", maps.select(F.xxhash64("id").alias("short")).distinct(), "asked")
        met = asked.filter("asked").withColumn("id", F.md5("text")).join(maps, "id", "left").select("text", "row", "moved")
        told = met.unionByName(asked.filter("not asked").select("text", "row").withColumn("moved", empty))
    schema = T.StructType([rows.schema["row"], T.StructField("new", T.StringType()), T.StructField("n", T.LongType())])
    out = told.mapInArrow(_replace(key), schema)
    return out.select(*[F.col("new").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "n_entities"], F.col("n").alias("n_entities"))

