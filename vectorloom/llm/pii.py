"""Personal data with offset-preserving deobfuscation.

Identifiers are first found as they stand. Then, where a text has disguises, a transducer rewrites it: homoglyphs
and full-width forms become ASCII, invisible characters vanish, runs of spelled digits become digits (short ones beside a digit or a dot; dots between groups of three or fewer stay), and
``[at]``/``(dot)``/`` at `` ... `` dot `` become ``@`` and ``.``. It carries for every character it
writes the range of source characters it stands for. The same detectors run over the rewritten text, and what they find with
the help of at least one rewritten or left out character is mapped back to source characters and added; spans found directly stay.

Every pattern runs in time linear in the text: no pattern restarts inside a run that it has already seen.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Look-alikes of ASCII letters (Cyrillic, Greek) and signs, by what they stand for.
LOOKALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еε", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ", "n": "ո", "o": "оο", "p": "рρ", "s": "ѕ", "t": "τ", "u": "υ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥУ", "Z": "Ζ",
    "@": "＠﹫", ".": "．․。｡", "-": "‐‑‒–—−－", "+": "＋﹢", " ": "\u00a0\u2007\u2009\u202f\u3000",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits in English, German, French and Spanish, and the words for the signs of an address.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS = ("at", "ät", "arobase", "arroba"), ("dot", "punkt", "point", "punto")
#: As many spelled digits at least are read as a number anywhere; fewer beside a digit, a dot or a spelled dot.
SPELLED_RUN = 4

_TO_ASCII = {ch: a for a, many in LOOKALIKES.items() for ch in many}
_TO_ASCII |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict.fromkeys(INVISIBLE, "")
_TO_ASCII |= {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_OPEN, _CLOSE = r"\s{0,2}[\[({<]\s{0,2}", r"\s{0,2}[\])}>]\s{0,2}"
_CHAR = f"[{re.escape(''.join(_TO_ASCII))}]"
_RULES = re.compile(
    "|".join((
        rf"(?P<number>(?<![^\W\d_])(?:plus[\x20-]{{1,3}})?(?:{_WORDS})(?:[\x20,.-]{{1,3}}(?:{_WORDS})){{{SPELLED_RUN - 1},}}(?![^\W\d_]))",
        rf"(?P<short>(?<![^\W\d_])(?:plus[\x20-]{{1,3}})?(?:{_WORDS})(?:[\x20,-]{{1,3}}(?:{_WORDS})){{0,{SPELLED_RUN - 2}}}(?![^\W\d_]))",
        rf"(?P<at>{_OPEN}(?:{_AT}|@){_CLOSE}|(?<=[A-Za-z0-9])\s{{1,3}}(?:{_AT})\s{{1,3}}(?=[A-Za-z0-9-]{{1,63}}\s{{1,3}}(?:{_DOT})\s))",
        rf"(?P<dot>{_OPEN}(?:{_DOT}|\.){_CLOSE}|(?<=[A-Za-z0-9])\s{{1,3}}(?:{_DOT})\s{{1,3}}(?=[A-Za-z0-9]))",
        rf"(?P<char>{_CHAR})",
    )),
    re.IGNORECASE,
)
#: What makes a short run a number: before it and after it.
_BEFORE = re.compile(rf"(?:[0-9][\x20,.()-]{{0,3}}|\.|(?<![A-Za-z])(?:{_DOT})\s{{1,3}}|{_OPEN}(?:{_DOT}|\.){_CLOSE})\Z", re.IGNORECASE)
_AFTER = re.compile(rf"[\x20,.()-]{{0,3}}[0-9]|\.|\s{{1,3}}(?:{_DOT})\s|{_OPEN}(?:{_DOT}|\.)\s{{0,2}}[\])}}>]", re.IGNORECASE)
_DIGIT_WORD = re.compile(_WORDS, re.IGNORECASE)
#: Cheap and necessary for any rule to apply.
_A_CHAR = re.compile(_CHAR)
_BRACKETED = re.compile(rf"[\[({{<]\s{{0,2}}(?:{_AT}|@|{_DOT}|\.)\s{{0,2}}[\])}}>]", re.IGNORECASE)
_SPELLED = re.compile(rf"(?<![^\W\d_])(?:{_WORDS})(?:[\x20,.-]{{1,3}}(?:(?:{_WORDS})[\x20,.-]|[0-9])|\.[0-9A-Za-z]|\s{{0,2}}[\[({{<])|(?:[0-9][\x20,.()-]{{0,3}}|\.)(?:{_WORDS})(?![^\W\d_])", re.IGNORECASE)
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_DIGIT_BYTES, _DOT_BYTES = frozenset(w.encode() for w in DIGIT_WORDS) | {"FÜNF".encode().lower(), "ZÉRO".encode().lower()}, frozenset(w.encode() for w in DOT_WORDS)


def hinted(text: str) -> bool:
    """Whether any rule may apply. Capitals beyond ASCII are not folded but for those of the digits' names."""
    raw = text.encode("utf-8", "replace")
    if not raw.isascii() and _A_CHAR.search(text) or _BRACKETED.search(text):
        return True
    words = raw.translate(_LETTERS).split()
    return not _DOT_BYTES.isdisjoint(words) or not _DIGIT_BYTES.isdisjoint(words) and _SPELLED.search(text) is not None


Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Identifiers as they stand: start, end, kind; leftmost and non-overlapping within each kind."""
    out = [(s, e, "email") for s, e in _emails(text)]
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def transduce(text: str) -> tuple[str, list[int], list[int], list[bool], list[int]]:
    """The text without disguises; for each of its characters the source range and whether it was rewritten; and the places
    in it where invisible characters stood."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    changed: list[bool] = []
    seams: list[int] = []

    def put(s: str, a: int, b: int) -> None:
        for c in s:
            out.append(c)
            starts.append(a)
            ends.append(b)
            changed.append(True)
        if not s:
            seams.append(len(starts))

    def copy(a: int, b: int) -> None:
        out.append(text[a:b])
        starts.extend(range(a, b))
        ends.extend(range(a + 1, b + 1))
        changed.extend([False] * (b - a))

    done = 0
    for m in _RULES.finditer(text):
        copy(done, m.start())
        done = m.end()
        if m.lastgroup == "short" and not (_AFTER.match(text, m.end()) or _BEFORE.search(text, max(0, m.start() - 16), m.start())):
            copy(m.start(), m.end())
        elif m.lastgroup in ("number", "short"):
            if m[0][:4].lower() == "plus":
                put("+", m.start(), m.start() + 4)
            words = list(_DIGIT_WORD.finditer(m[0]))
            dots = [m[0].find(".", w.end(), v.start()) for w, v in zip(words, words[1:])] + [-1]
            groups = "".join("01"[d >= 0] for d in dots[:-1]).split("1")
            octets = 1 < len(groups) <= 4 and all(len(g) < 3 for g in groups)  # of three digits at most
            for w, d in zip(words, dots, strict=True):
                put(DIGIT_WORDS[w[0].lower()], m.start() + w.start(), m.start() + w.end())
                if octets and d >= 0:
                    put(".", m.start() + d, m.start() + d + 1)
        elif m.lastgroup == "char":
            put(_TO_ASCII.get(m[0], m[0]), m.start(), m.end())
        else:
            put("@" if m.lastgroup == "at" else ".", m.start(), m.end())
    copy(done, len(text))
    return "".join(out), starts, ends, changed, seams


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Further spans that the rewritten text shows with the help of at least one rewritten or left out character. One that overlaps
    base spans of its kind is added only if it goes beyond them and holds them whole."""
    if not hinted(text):
        return []
    plain, starts, ends, changed, seams = transduce(text)
    taken: dict[str, list[Span]] = {k: [b for b in base if b[2] == k] for k in KINDS}
    out = []
    for s, e, kind in detect(plain):
        if any(changed[s:e]) or bisect_left(seams, e) > bisect_right(seams, s):
            a, b = starts[s], ends[e - 1]
            met = [(x, y) for x, y, _ in taken[kind] if x < b and a < y]
            if (a, b) not in met and all(a <= x and y <= b for x, y in met):
                out.append((a, b, kind))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _score(texts: list[bytes]) -> dict[str, list]:
    out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_added": [], "added": []}
    for raw in texts:
        text = raw.decode("utf-8", "replace")
        base = detect(text)
        more = disguised(text, base)
        for k in KINDS:
            out[f"n_{k}"].append(sum(b[2] == k for b in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(base + more))
        out["n_added"].append(len(more))
        out["added"].append([{"kind": k, "start": s, "end": e, "text": text[s:e]} for s, e, k in more])
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, added for every row of ``docs``.

    ``added``: kind, start, end, text of what was disguised. Null text: empty, no spans. Repeated rows are rows of the result;
    empty table: empty result;
    extra columns are not read. Offsets are code points, end exclusive."""
    longs = [(f"n_{k}", pa.int64()) for k in KINDS]
    added = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
    arrow = pa.schema([*longs, ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("added", added)])
    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, added array<struct<kind:string,start:long,end:long,text:string>>"
    return per_text(docs, id_col, text_col, _score, schema, arrow)
