"""PII surrogates: detected entities get keyed, type-consistent replacements.

Kinds: email, ip, card, phone, name. Names are found by a given name of the list before a surname, by a title or a
label ("contact:") in front, and as lists of three and more different pairs of capitalised words; each word of a name
is then found in the whole text, so that a surname alone, before or after the full name, is replaced alike. Names in
scripts without capitals, and names with nothing of all that about them, aren't found.

A surrogate depends on the key, the kind and the entity alone, so an entity has the same surrogate wherever it occurs
(coreference), and a name's words have theirs alone. It is made by a keyed permutation of all entities of the same
format (letter case, script, digits, punctuation, length; country code; private or public network; check digit; gender
and script of a given name), so two entities never share a surrogate and none is its own. The permutation is one cycle
through the format's entities: a Feistel network f over mixed-radix digits, and f(f^-1(x) + 1) as surrogate (a single
character or a listed name goes by the order of keyed hashes); steps on until the class (such as "public network", or
"not a listed name") is kept. So no two entities can share a surrogate; that is checked all the same. An entity that is the only one of its format becomes a keyed tag
such as ``name-1f0c...``.

Defined cases: a null text stays null, an empty one empty; a very long text is read whole, in one task; repeated rows
and rows of one id get a result each; a row with a null id takes part; other columns are kept by `replaced`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.llm.common import free_name, map_arrow, stored, table

KEY = b"noticeboard surrogate key"
KINDS = ("email", "ip", "card", "phone", "name")
#: fixed values: given names by gender and script
NAMES = {
    ("f", "latin"): "Aisha Alice Amelia Amina Ananya Anna Carmen Charlotte Clara Elena Emily Emma Fatima Hannah Ingrid Isabel Julia Lakshmi Laura Leila Lucia Maria Marie Martha Mei Ngozi Noor Nora Olivia Paula Priya Sakura Sarah Sofia Susan Yuki Zainab".split(),
    ("m", "latin"): "Ahmed Albert Ali Arjun Carlos Chidi Daniel David Diego Edward Felix George Hans Hassan Henry Hiroshi James Jean John Jonas Karl Kenji Kwame Luis Martin Michael Mohammed Omar Oscar Paul Pedro Peter Rahul Raj Robert Thomas Wei".split(),
    ("f", "cyrillic"): "Анна Вера Галина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
#: fixed values: titles that announce a name, labels that do with a colon, and what stands between the names of a list
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Sir Dame Herr Frau Monsieur Madame Mme Mlle Señor Señora Don Doña Господин Госпожа".split()
LABELS = "name contact author patient customer client employee attn signed kontakt autor kunde auteur nom nombre cliente имя контакт автор".split()
JOINTS = (", and ", ", ", "; ", " and ", " & ", " und ", " et ", " y ", " и ")
_EMAIL = re.compile(r"[^\W_](?:[\w.+-]*[^\W_])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")
_CARD = re.compile(r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?![\w]|[.-]\d)|(?<![\w.+-])\+\d{8,15}(?!\d)")
_W = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)*"
_GIVEN = {n: (group, i) for group, names in NAMES.items() for i, n in enumerate(names)}
_NAME = regex.compile(rf"\b(?:{'|'.join(_GIVEN)})(?:-(?:{'|'.join(_GIVEN)}))? {_W}\b")
_TITLED = regex.compile(rf"\b(?:{'|'.join(TITLES)})\.? {_W}(?: {_W})?\b")
_LABELLED = regex.compile(rf"\b(?i:{'|'.join(LABELS)})\s*:\s*({_W}(?: {_W}){{1,2}})\b")
_LISTED = regex.compile(rf"\b{_W} {_W}(?:(?:{'|'.join(map(re.escape, JOINTS))}){_W} {_W}){{2,}}\b")
_PAIR = regex.compile(rf"({_W}) ({_W})")
_CHEAP = frozenset(_GIVEN) | frozenset(TITLES)  # each of them is a whole \w+ where _NAME or _TITLED matches
_TOKEN = re.compile(r"\w+")
_LETTERS_OF_NAME = re.compile(r"[^\W\d_]+")
#: fixed values: letters that change among themselves, so that made-up words keep script, case and vowels. Other letters change within their category and their 128 code points.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "äöü", "àèìòù", "âêîôû", "абвгдежзиклмнопрстуфхцчшщ", "аеиоуыэюя", "αβγδεζηθικλμνξοπρστυφχψω")


def _classes() -> dict[str, str]:
    out: dict[str, str] = {}
    for letters in LETTERS:
        own = "".join(c for c in letters if c not in out)  # a letter of two rows belongs to the first
        out |= dict.fromkeys(own, own) | dict.fromkeys(own.upper(), own.upper())
    return out


_CLASSES = _classes()
_FIXED = frozenset(_CLASSES)
_RESERVED = re.compile(r"(?:^|\.)example\.(?:com|org|net)$", re.I)


@lru_cache(maxsize=65536)
def _round(key: bytes, tweak: str, n: int, x: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|{x}".encode("utf-8", "surrogatepass"), key=key[:64], digest_size=16).digest(), "big")


def _feistel(x: int, a: int, b: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(a * b), by adding into either part what the other gives."""
    u, v = divmod(x, b)
    for n in range(9, -1, -1) if back else range(10):
        sign = -1 if back else 1
        if n % 2:
            v = (v + sign * _round(key, tweak, n, u)) % b
        else:
            u = (u + sign * _round(key, tweak, n, v)) % a
    return u * b + v


@lru_cache(maxsize=4096)
def _order(n: int, key: bytes, tweak: str) -> tuple[list[int], list[int]]:
    """range(n) in the order of keyed hashes, and where each number is."""
    order = sorted(range(n), key=lambda x: (_round(key, tweak, 10, x), x))
    place = [0] * n
    for i, x in enumerate(order):
        place[x] = i
    return order, place


def cycle(x: int, radices: list[int], key: bytes, tweak: str) -> int:
    """The element after x in a keyed cycle through all numbers under the product of the radices."""
    if len(radices) == 1:  # too few for a network, whose parts would be one: shuffled by keyed hashes instead
        order, place = _order(radices[0], key, tweak)
        return order[(place[x] + 1) % radices[0]]
    total = 1
    for r in radices:
        total *= r
    a = 1
    for r in radices[: (len(radices) + 1) // 2]:
        a *= r
    return _feistel((_feistel(x, a, total // a, key, tweak, back=True) + 1) % total, a, total // a, key, tweak)


def _alphabet(c: str) -> str:
    """The characters that c changes among; itself alone if it is neither a letter nor a decimal digit."""
    if c not in _CLASSES:
        kind = unicodedata.category(c)
        if kind == "Nd":
            zero = ord(c) - unicodedata.decimal(c)
            _CLASSES[c] = "".join(map(chr, range(zero, zero + 10)))
        elif kind in ("Lu", "Ll", "Lt", "Lm", "Lo"):
            first = ord(c) & ~127
            _CLASSES[c] = "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind and x not in _FIXED)
        else:
            return c
    return _CLASSES[c]


def reformed(text: str, key: bytes, tweak: str) -> str:
    """The next text of the same format: letters for letters of their kind and case, digits for digits, the rest as is."""
    alphabets = [_alphabet(c) for c in text]
    at = [i for i, a in enumerate(alphabets) if len(a) > 1]
    if not at:
        return text
    radices = [len(alphabets[i]) for i in at]
    x = 0
    for i, r in zip(at, radices, strict=True):
        x = x * r + alphabets[i].index(text[i])
    form = "".join(a if len(a) == 1 else a[0] for a in alphabets)
    x = cycle(x, radices, key, f"{tweak}|{form}")
    out = list(text)
    for i, r in zip(reversed(at), reversed(radices), strict=True):
        x, d = divmod(x, r)
        out[i] = alphabets[i][d]
    return "".join(out)


def _email(s: str, key: bytes, tweak: str) -> str:
    local, _, domain = s.partition("@")
    kept = _RESERVED.search(domain)
    cut = kept.start() if kept else domain.rindex(".")
    new = reformed(domain[:cut], key, f"{tweak}|domain|{domain[cut:]}") + domain[cut:]
    return f"{reformed(local, key, f'{tweak}|local')}@{new}"


def _network(o: list[int]) -> str:
    return "a" if o[0] == 10 else "b" if o[0] == 172 and 16 <= o[1] < 32 else "c" if o[:2] == [192, 168] else "odd" if o[0] in (0, 127) or o[0] >= 224 else "public"


def _ip(s: str, key: bytes, tweak: str) -> str:
    octets = [int(x) for x in s.split(".")]
    kind = _network(octets)
    fixed = {"a": 1, "c": 2}.get(kind, 0)
    while True:
        x = 0
        for o in octets[fixed:]:
            x = x * 256 + o
        x = cycle(x, [256] * (4 - fixed), key, f"{tweak}|{kind}")
        octets[fixed:] = list(x.to_bytes(4 - fixed, "big"))
        if _network(octets) == kind:
            return ".".join(map(str, octets))


def check_digit(digits: str) -> int:
    """The Luhn digit that belongs after digits."""
    return -sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits))) % 10


def _card(s: str, key: bytes, tweak: str) -> str:
    digits = re.sub(r"\D", "", s)
    off = (int(digits[-1]) - check_digit(digits[:-1])) % 10  # 0 in a valid one; it stays as far off
    new = reformed(digits[:-1], key, f"{tweak}|{off}")
    new += _alphabet(digits[-1])[(check_digit(new) + off) % 10]
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in s)


def _phone(s: str, key: bytes, tweak: str) -> str:
    m = re.match(r"\+\d{1,3}(?=[ .-])", s)
    head = m[0] if m else s[:2] if s.startswith("+") else ""
    return head + reformed(s[len(head) :], key, f"{tweak}|{head}")


def _word(s: str, key: bytes, tweak: str) -> str:
    """A word of a name; a name of the list turns into another one of its group, any other word into one that isn't listed."""
    if s in TITLES:
        return s
    if s not in _GIVEN:
        new = reformed(s, key, f"{tweak}|word")
        while new in _CHEAP:  # on past listed names and titles, so that no other word lands on a surrogate of theirs
            new = reformed(new, key, f"{tweak}|word")
        return new
    group, i = _GIVEN[s]
    return NAMES[group][cycle(i, [len(NAMES[group])], key, f"{tweak}|{group}")]


def _name(s: str, key: bytes, tweak: str) -> str:
    return _LETTERS_OF_NAME.sub(lambda m: _word(m[0], key, tweak), s)


_MAKERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "name": _name}


def surrogate(kind: str, entity: str, key: bytes = KEY, tweak: int = 0) -> str:
    """The replacement of an entity of a kind."""
    new = _MAKERS[kind](entity, key, f"{kind}|{tweak}")
    return new if new != entity else f"{kind}-{hashlib.blake2b(f'{tweak}|{entity}'.encode('utf-8', 'surrogatepass'), key=key[:64], digest_size=8).hexdigest()}"


class _Spans(list):
    """Spans in order, without overlap: of overlapping ones the first to come stays."""

    def put(self, start: int, end: int, kind: str) -> None:
        i = bisect_left(self, (start, end, kind))
        if (not i or self[i - 1][1] <= start) and (i == len(self) or end <= self[i][0]):
            insort(self, (start, end, kind))


def _add_names(text: str, found: _Spans) -> None:
    before = len(found)
    if not _CHEAP.isdisjoint(_TOKEN.findall(text)):
        for pattern in (_TITLED, _NAME):
            for m in pattern.finditer(text):
                found.put(*m.span(), "name")
    if ":" in text:
        for m in _LABELLED.finditer(text):
            found.put(*m.span(1), "name")
    for m in _LISTED.finditer(text):
        pairs = [p for p in _PAIR.finditer(text, *m.span()) if p[1] != p[2]]
        if len({p[0] for p in pairs}) >= 3:
            for p in pairs:
                found.put(*p.span(), "name")
    if len(found) > before:
        words = {w for a, b, kind in found if kind == "name" for w in _LETTERS_OF_NAME.findall(text[a:b]) if len(w) > 2} - set(TITLES)
        for m in _TOKEN.finditer(text):
            if m[0] in words:
                found.put(*m.span(), "name")


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of entities, in order, without overlap; of overlapping ones the kind listed first counts."""
    found = _Spans()
    if not text:
        return found
    if "@" in text:
        for m in _EMAIL.finditer(text):
            found.put(*m.span(), "email")
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(str(int(x)) == x and int(x) < 256 for x in m[0].split(".")):
                found.put(*m.span(), "ip")
        for m in _CARD.finditer(text):
            found.put(*m.span(), "card")
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 7 <= n <= 15 and ("+" in m[0] or "(" in m[0] or n >= 9):
                found.put(*m.span(), "phone")
    _add_names(text, found)
    return found


_DIGITS = re.compile(r"\d[\d ().-]{5}")


def entities(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """kind, entity: the distinct ones of all texts. Counted by task first, so a frequent entity is no hot key."""

    def run(b: pa.RecordBatch) -> list:
        seen = dict.fromkeys((k, t[x:y]) for t in b.column(0).to_pylist() for x, y, k in find(t))
        return [[k for k, _ in seen], [e for _, e in seen]]

    return map_arrow(docs.select(text_col), run, "kind string, entity string").distinct()


def collisions(found: DataFrame, key: bytes = KEY, tweak: int = 0) -> DataFrame:
    """Surrogates that two entities of a kind share, or that equal their entity."""
    made = map_arrow(found, lambda b: [b.column(0), b.column(1), [surrogate(k, e, key, tweak) for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]], "kind string, entity string, surrogate string")
    return made.groupBy("surrogate").agg(F.min("kind").alias("kind"), F.min("entity").alias("one"), F.max("entity").alias("other")).filter("one != other or one = surrogate")


def confirm(docs: DataFrame, *, text_col: str = "text", key: bytes) -> None:
    """Check that no two entities of the texts share a surrogate. By the way these are made none can; only keyed tags could, by a collision of 64-bit hashes."""
    found = stored(entities(docs, text_col=text_col), "entities")
    if not collisions(found, key).isEmpty():
        raise RuntimeError("two entities share a surrogate")


def rewrite(text: str | None, key: bytes = KEY, tweak: int = 0) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities' spans in the old one."""
    spans = find(text)
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], surrogate(kind, text[a:b], key, tweak)]
        at = b
    return (text if not spans else "".join(out) + text[at:]), spans


KIND = "struct<text:string,spans:array<struct<kind:string,start:int,end:int>>>"


def replaced(docs: DataFrame, *, key: bytes, text_col: str = "text", name: str = "pii") -> DataFrame:
    """docs with a column of the text with surrogates and the entities' spans. No shuffle but of distinct entities."""
    name = free_name(docs, name)
    confirm(docs, text_col=text_col, key=key)

    def run(b: pa.RecordBatch) -> list:
        out = []
        for t in b.column(b.schema.get_field_index(text_col)).to_pylist():
            new, spans = rewrite(t, key)
            out.append({"text": new, "spans": [{"kind": k, "start": a, "end": e} for a, e, k in spans]})
        return [out]

    return map_arrow(docs, run, f"`{name}` {KIND}", keep=True)


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, counts by kind, spans (kind:start:end of the old text)."""
    p = replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), key=KEY)
    s = F.col("pii.spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    listed = F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return p.select("doc_id", F.col("pii.text").alias("text"), *counts, listed.alias("spans"))
