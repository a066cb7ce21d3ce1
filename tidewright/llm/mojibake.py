"""Problem 9: text garbled by decoding bytes with the wrong character encoding.

Characters are mapped back to the bytes of a legacy code page; a byte-structure automaton
finds the maximal well-formed UTF-8 spans among them; only those spans are decoded. Pairs of
single-byte code pages, which have no byte structure, are told by letters that cannot stand
where they do.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import table

#: Code pages that UTF-8 bytes are commonly mistaken for.
LEGACY = ("cp1252", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "cp866", "koi8_r")
#: Letters of the larger European alphabets, their punctuation and signs: a span of two bytes that
#: decodes to one of them is believed on little other evidence, anything else must read oddly as it stands.
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
LATIN_MORE = "ąćęłńśźżčřŕěšžůďťňőœĺľ"
SIGNS = "‘’‚“”„–—…•†‡‰‹›€™№"
FAMILIAR = frozenset(RUSSIAN + RUSSIAN.upper() + LATIN_MORE + LATIN_MORE.upper() + "Ÿƒˆ˜" + SIGNS + "".join(map(chr, range(0xA0, 0x100))) + "".join(map(chr, range(0x80, 0xA0))) + "\u0300\u0301\u0302\u0303\u0307\u0308\u030a\u030c\u0327\u0328")
#: Signs that may rightly follow a letter, so that they prove nothing alone.
AFTER_LETTER = frozenset("‘’‚“”„–—…«»\u00a0")
AFTER_CYRILLIC = AFTER_LETTER | frozenset("ёЁ№§©™®іІїЇєЄґҐўЎ")
#: What may rightly follow a root or another sign in a formula.
OPERANDS = frozenset("π∂∑∏∫Ω∆")
VERBATIM = re.compile(r"\\verb\|[^|\n]*\|")
FOREIGN = re.compile(r"[^\x00-\x7f]+")
FOREIGN_ONE = re.compile(r"[^\x00-\x7f]")
FOREIGN_MORE = re.compile(r"[^\x00-\x7f]{2,}")
C1 = re.compile(r"[\x80-\x9f]")


def _page(name: str) -> dict[str, int]:
    """Character to byte for the upper half of a code page; bytes it leaves undefined stand for themselves."""
    page = {}
    for b in range(0x80, 0x100):
        try:
            page[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            page[chr(b)] = b
    for b in range(0x80, 0xA0):
        page.setdefault(chr(b), b)
    return page


PAGES = {name: _page(name) for name in LEGACY}
#: Lead characters with which a page is believed on little other evidence, where others are ordinary letters or frames.
LEADS = {
    "cp850": frozenset("┬├─┼Ô"),
    "cp866": frozenset("┬├─┼╨╤"),
}


def _need(b: int) -> int:
    """Continuation bytes a lead byte asks for; 0 for bytes that lead nothing."""
    return 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0


@lru_cache(maxsize=None)
def _kind(c: str) -> str:
    """One letter for what a character is as it stands: u and l letters, p signs that may touch
    letters, b frames and blocks, s other signs, x what no right text holds."""
    if c in AFTER_LETTER:
        return "p"
    if "\u2500" <= c <= "\u25ff":
        return "b"
    group = unicodedata.category(c)
    if group in ("Lu", "Ll", "Lo") and c not in "ªº":
        return "u" if group == "Lu" else "l"
    return "x" if group[0] == "C" or c == "\ufffd" else "s"


#: Readings that occur in right texts: a word in ordinary capitals between punctuation, frames, signs.
ORDINARY = re.compile(r"p*(?:u+l*|l+)p*|[bp]+|[sp]+")


def _odd(s: str) -> bool:
    """Whether a span cannot be right as it stands. Three signs that begin with a low quotation
    mark before a capital and another letter are odd too, as no word begins so."""
    kinds = "".join(map(_kind, s))
    return ORDINARY.fullmatch(kinds) is None or s[0] == "\u201a" and len(s) > 2


def _assigned(c: str) -> bool:
    return unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc")


def _sequences(run: str, name: str) -> list[tuple[int, int, str]]:
    """Well-formed multibyte sequences ``(start, end, decoded)`` of a run of non-ASCII characters
    under one code page, whatever assigned character they decode to. A sequence whose last bytes
    were lost to U+FFFD decodes to U+FFFD."""
    page, out, i = PAGES[name], [], 0
    while i < len(run):
        b = page.get(run[i], 0)
        n = _need(b)
        if n:
            tail = [page.get(c, 0) for c in run[i + 1 : i + 1 + n]]
            good = 0
            while good < len(tail) and 0x80 <= tail[good] <= 0xBF:
                good += 1
            if good == n:
                try:
                    ch = bytes([b, *tail]).decode("utf-8")
                except UnicodeDecodeError:
                    ch = ""
                if ch and (ch in FAMILIAR or _assigned(ch)):
                    out.append((i, i + n + 1, ch))
                    i += n + 1
                    continue
            elif good + 1 + i < len(run) and run[i + 1 + good] == "\ufffd" and (good or n == 1) and _led(run[i], name):
                out.append((i, i + good + 2, "\ufffd"))
                i += good + 2
                continue
        i += 1
    return out


def _led(lead: str, name: str) -> bool:
    return name not in LEADS or lead in LEADS[name]


def _strong(run: str, seq: tuple[int, int, str], name: str, before: str, after: str) -> bool:
    """Whether a sequence with a familiar meaning is evidence by itself, given the ASCII characters around the run."""
    i, j, ch = seq
    if j - i > 2 or ch == "\ufffd":
        return True
    lead, tail = run[i], run[j - 1]
    prev = run[i - 1] if i else before
    nxt = run[j] if j < len(run) else after
    if name == "mac_roman" and lead in "–—":
        return False
    if name == "mac_roman" and tail in OPERANDS and _kind(lead) == "s":
        return ch.isalpha() and (prev + nxt).isascii() and (prev.isalpha() or nxt.isalpha())
    if _kind(lead) == _kind(tail) == "b":  # part of a frame
        return not (_kind(prev) == "b" or _kind(nxt) == "b" or prev.isspace() and nxt.isspace())
    if name == "koi8_r":
        return not ("\u0400" <= tail <= "\u04ff") and "\u2500" <= tail <= "\u25ff"
    if name == "cp1251":
        return tail not in AFTER_CYRILLIC or any(x.isascii() and x.isalpha() for x in (prev, nxt))
    if tail in AFTER_LETTER:
        return ch.isalpha() and (not prev.isalpha() or nxt.isalpha())
    return True


@lru_cache(maxsize=None)
def _script(c: str) -> str:
    """The script of a letter; empty for other characters."""
    return unicodedata.name(c, "?").split()[0] if c.isalpha() else ""


#: Pages of which only the letters with accents matter to words in ASCII letters.
WESTERN = ("cp1252", "cp1250", "mac_roman")


def _believed(run: str, chain: list[tuple[int, int, str]], name: str, before: str, after: str, proven: str) -> bool:
    """Whether a maximal chain of touching sequences came from the wrong page."""
    if name == proven and any(s[2] in FAMILIAR or s[1] - s[0] > 2 for s in chain):
        return True
    known = [s for s in chain if (s[2] in FAMILIAR or s[2] == "\ufffd") and _led(run[s[0]], name)]
    if any(_strong(run, s, name, before, after) for s in known):
        return True
    i, j = chain[0][0], chain[-1][1]
    if len(known) == len(chain):
        return len(chain) >= (3 if name == "koi8_r" or name == "cp1251" and all(run[s[1] - 1] in AFTER_CYRILLIC for s in chain) else 2)
    prev, nxt = run[i - 1] if i else before, run[j] if j < len(run) else after
    inside = [x if x.isascii() and x.isalpha() and name in WESTERN else "" for x in (prev, nxt)]
    if not _odd(inside[0] + run[i:j] + inside[1]):
        return False
    scripts = {_script(s[2]) for s in chain} - {""}
    if len(scripts) > 1 and len(chain) < 4:
        return False
    if len(chain) == 1 and j - i == 2:  # a Latin letter within a word, or a Greek one alone
        return scripts == {"LATIN"} and (prev + nxt).isascii() and (prev.isalpha() or nxt.isalpha()) or scripts == {"GREEK"} and not prev.isalpha() and not nxt.isalpha()
    return len(chain) > 2 or name not in ("cp850", "cp866", "cp1251", "koi8_r") or all("\u2010" <= s[2] <= "\u22ff" for s in chain)


_seen: dict[tuple[str, str, str, str], tuple[str, list[tuple[int, int, str]]]] = {}


def utf8_spans(run: str, before: str, after: str, proven: str = "") -> tuple[str, list[tuple[int, int, str]]]:
    """``(code page, sequences)`` of a run, by the page that explains most of it; no sequences
    where none is proof. A span is judged whole: by strong sequences in it, by its length, by how
    odd it reads as it stands, and by a page that the text has ``proven``."""
    key = (run, before, after, proven)
    if key in _seen:
        return _seen[key]
    best: tuple[str, list[tuple[int, int, str]]] = ("", [])
    covered = 0
    if len(run) > 1:
        for name in LEGACY:
            found = _sequences(run, name)
            kept: list[tuple[int, int, str]] = []
            k = 0
            while k < len(found):  # chains of touching sequences
                e = k + 1
                while e < len(found) and found[e][0] == found[e - 1][1]:
                    e += 1
                if _believed(run, found[k:e], name, before, after, proven):
                    kept += found[k:e]
                k = e
            size = sum(j - i for i, j, _ in kept)
            if size > covered:
                best, covered = (name, kept), size
    if len(_seen) >= 200_000:
        _seen.clear()
    _seen[key] = best
    return best


_to_1252 = {c: bytes([b]).decode("cp1252", "replace") for c, b in PAGES["mac_roman"].items()}
_to_mac = {c: bytes([b]).decode("mac_roman") for c, b in PAGES["cp1252"].items()}
_cyr_1252 = {c: bytes([b]).decode("cp1252", "replace") for c, b in PAGES["cp1251"].items()}
_mac_odd = "".join(c for c, x in _to_1252.items() if x.isalpha() and x.islower() and not c.islower() and c not in "·’‘–—…“”")
#: Latin letters around a sign that cannot stand inside a word. Initials: no word of English, German, French,
#: Portuguese, Spanish or Polish begins with Õ or ÿ, none is abbreviated in lower case before a name, and a
#: Cyrillic initial does not stand before a name in Latin letters.
BEFORE, AFTER = "A-Za-zß-öø-ž", "a-z" + "".join(c for c in map(chr, range(0xDF, 0x17F)) if c.islower())
MAC_INNER = re.compile(rf"[{BEFORE}][{re.escape(_mac_odd)}ﬂ](?=[{AFTER}])|[A-Za-km-z]·(?=[{AFTER}])|(?<=[ {{~])[÷¡‹›≈ÿÕ]\. (?=[A-Z])")
MAC_QUOTED = re.compile(r"(?<!\w)ì(?=[A-Za-z])[^ìî\n]*[A-Za-z]î(?!\w)")
WIN_INNER = re.compile(r"[a-z][ŽŠŒŸ•§](?=[a-z])|[a-z]Õ(?=[a-z])|(?<!\w)Ò(?=[A-Za-z])[^ÒÓ\n]*[A-Za-z]Ó(?!\w)|\d ?¡C|(?<=[ {~])[êç†ƒ¯]\. (?=[A-Z])")
RIGHT_INNER = re.compile(r"[a-z][à-öø-ÿ][a-z]|[a-z]’[a-z]|“[A-Za-z]|[a-z]”|\d ?°C|\d–\d| — |\d €")
MAC_ALONE = re.compile(r"\d ?∞C|(?<=[\w.,)] )ñ(?= \w)|\d Ä(?!\w)|(?<!\w)ë(?=[A-Za-z])[^ëí\n]*[A-Za-z]í(?!\w)")
CYR_INNER = re.compile(rf"[{BEFORE}][\u0400-\u04ff]{{1,2}}[{AFTER}]|(?<!\w)[A-Za-z]+[a-z][\u0400-\u04ff]{{1,2}}(?!\w)|(?<=[ {{~])[\u0400-\u04ff]\. (?=[A-Z])")
LATIN_RUN = re.compile(r"(?<![A-Za-z])[À-ÿ]{4,}(?![A-Za-z])")
KOI_WORD = re.compile(r"(?<![А-Яа-яЁё])[а-яё][А-ЯЁ]{2,}(?![А-Яа-яЁё])")
CYR_UPPER = re.compile(r"[А-ЯЁ]{2,}")
FREQUENT = frozenset("оеаинтсрвл")


def _koi(s: str) -> str:
    """The better reading of case-inverted Cyrillic: KOI8-R bytes read as cp1251, or the reverse."""
    best = s
    for a, b in (("cp1251", "koi8_r"), ("koi8_r", "cp1251")):
        try:
            x = s.encode(a).decode(b)
        except UnicodeError:
            continue
        if sum(c in FREQUENT for c in x) > sum(c in FREQUENT for c in best):
            best = x
    return best


def _each(pattern: str, page: Callable[[str], str]) -> Callable[[str], tuple[str, int]]:
    found = re.compile(pattern)
    return lambda x: found.subn(lambda m: page(m.group()), x)


_cyr = {c: bytes([b]).decode("cp1251", "replace") for c, b in PAGES["cp1252"].items() if b >= 0xA0 or b in (0x84, 0x93, 0x94, 0x85, 0x96, 0x97)}
#: How a line in one of the single-byte pages is set right.
MENDS = {
    "cp1251>cp1252": _each("[À-ÿ¨¸¹]+", lambda x: "".join(_cyr.get(c, c) for c in x)),
    "koi8_r<>cp1251": _each("[А-Яа-яЁёЈ]+", _koi),
    "cp1252>cp1251": _each("[\u0400-\u04ff]", lambda c: _cyr_1252.get(c, c)),
    "mac_roman>cp1252": _each(r"[^\x00-\x7f]", lambda c: _to_mac.get(c, c)),
    "cp1252>mac_roman": _each(r"[^\x00-\x7f]", lambda c: _to_1252.get(c, c)),
}
#: The page in which such a line was read.
READ_AS = {"cp1251>cp1252": "cp1252", "koi8_r<>cp1251": "cp1251", "cp1252>cp1251": "cp1251", "mac_roman>cp1252": "cp1252", "cp1252>mac_roman": "mac_roman"}
#: Characters without which no pattern of a kind can match.
WIN_SIGNS, MAC_SIGNS = frozenset("ŽŠŒŸ•§ÕÒ¡êç†ƒ¯"), frozenset(_mac_odd + "ﬂ·÷¡‹›≈ÿÕì∞ñÄë")


def _pages_of(line: str) -> Iterator[str]:
    """The mistakes that a line without quoted spans gives proof of, the likeliest first."""
    signs = "".join(FOREIGN.findall(line))
    seen = frozenset(signs)
    if not seen:
        return
    if any("À" <= c <= "ÿ" for c in seen):
        hits = LATIN_RUN.findall(line)
        if hits:
            back = "".join(hits).encode("cp1252", "ignore").decode("cp1251")
            if sum(c.lower() in RUSSIAN for c in back) >= 0.95 * len(back):
                yield "cp1251>cp1252"
    if any("\u0400" <= c <= "\u04ff" for c in seen):
        if KOI_WORD.search(line):
            yield "koi8_r<>cp1251"
        upper = "".join(CYR_UPPER.findall(line))
        if len(upper) >= 12:
            back = _koi(upper)
            if back != upper and sum(c in FREQUENT for c in back) - sum(c.lower() in FREQUENT for c in upper) > 0.25 * len(upper):
                yield "koi8_r<>cp1251"
        if CYR_INNER.search(line):
            yield "cp1252>cp1251"
    if seen & WIN_SIGNS and WIN_INNER.search(line):
        yield "mac_roman>cp1252"
    if seen & MAC_SIGNS and (MAC_INNER.search(line) or MAC_QUOTED.search(line) or MAC_ALONE.search(line)):
        yield "cp1252>mac_roman"


def _outside(line: str, mend: Callable[[str], tuple[str, int]]) -> tuple[str, int]:
    """``mend`` applied to all of a line but its quoted spans."""
    out, at, n = [], 0, 0
    for m in VERBATIM.finditer(line):
        part, k = mend(line[at : m.start()])
        out += [part, m.group()]
        at, n = m.end(), n + k
    part, k = mend(line[at:])
    return "".join([*out, part]), n + k


def _single_byte(line: str) -> tuple[str, int, str]:
    """Repair of one line read in the wrong single-byte code page: ``(line, spans, pages)``. A line
    with a letter of another script, which the wrong page does not have, was not read in it and stays."""
    plain = VERBATIM.sub(" ", line) if "\\verb|" in line else line
    for kind in _pages_of(plain):
        if all(c in PAGES[READ_AS[kind]] or _script(c) in ("", "LATIN", "CYRILLIC") for c in frozenset("".join(FOREIGN.findall(plain)))):
            return *_outside(line, MENDS[kind]), kind
    return line, 0, ""


#: Sequences of one code page that prove it for the rest of a text.
PROOF = 4


def _utf8_pass(text: str, quoted: list[tuple[int, int]], proven: str = "") -> tuple[str, int, set[str]]:
    out, at, n, pages = [], 0, 0, set()
    q, by_page = 0, {}
    for m in FOREIGN_MORE.finditer(text):
        s, e = m.span()
        while q < len(quoted) and quoted[q][1] <= s:
            q += 1
        if q < len(quoted) and quoted[q][0] <= s:
            continue
        run = m.group()
        name, found = utf8_spans(run, text[s - 1] if s else " ", text[e] if e < len(text) else " ", proven)
        by_page[name] = by_page.get(name, 0) + len(found)
        for i, j, ch in found:
            out += [text[at : s + i], ch]
            at = s + j
            n += 1
            pages.add(f"utf_8>{name}")
    if not n:
        return text, 0, pages
    top = max(by_page, key=by_page.get)
    if not proven and by_page[top] >= PROOF:
        return _utf8_pass(text, quoted, top)
    return "".join(out) + text[at:], n, pages


def restore(text: str | None) -> tuple[str | None, int, str]:
    """``(restored text, spans decoded, pages)``; spans is 0 where nothing was garbled.

    Null gives null; empty and ASCII texts come back as they are. Text inside ``\\verb|...|`` is
    left alone. Rounds go on until nothing decodes, so repeated mistakes are undone. Characters that were lost stay U+FFFD;
    stray C1 controls that no span explains count as garbled and stay.
    """
    if not text or text.isascii():
        return text, 0, ""
    total, pages = 0, set()
    while FOREIGN_MORE.search(text):
        text, n, used = _utf8_pass(text, [m.span() for m in VERBATIM.finditer(text)])
        total += n
        pages |= used
        if not n:
            break
    lines, marked = text.split("\n"), {}
    for k, line in enumerate(lines):
        if line.isascii():
            continue
        fixed, n, used = _single_byte(line)
        if n:
            lines[k], total = fixed, total + n
            pages.add(used)
            marked[k] = used
    for used in ("cp1252>mac_roman", "mac_roman>cp1252"):
        # a whole text in the wrong page: the lines without proof too
        if list(marked.values()).count(used) < 2 or any(RIGHT_INNER.search(VERBATIM.sub(" ", x)) for k, x in enumerate(lines) if k not in marked):
            continue
        for k, line in enumerate(lines):
            if k not in marked and not line.isascii():
                lines[k] = _outside(line, MENDS[used])[0]
    text = "\n".join(lines)
    stray = len(C1.findall(VERBATIM.sub("", text)))
    return text, total + stray, ",".join(sorted(pages))


def repaired(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans, pages, restored)`` of the documents with garbled sequences, others left out.

    One pass without a shuffle; whole texts, Arrow batch by batch. Null texts are never garbled,
    repeated rows are judged each for itself, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, spans, pages, texts = [], [], [], []
            for i, t in zip(b.column(0), b.column(1), strict=True):
                fixed, n, used = restore(t.as_py())
                if n:
                    ids.append(i.as_py())
                    spans.append(n)
                    pages.append(used)
                    texts.append(fixed)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(spans, pa.int32()), pa.array(pages, pa.string()), pa.array(texts, pa.string())], ["doc_id", "spans", "pages", "restored"])

    kind = dict(documents.dtypes)[id_col]
    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, spans int, pages string, restored string")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark, sf_dir: str) -> DataFrame:
    """The affected documents with the restored text."""
    return repaired(table(spark, sf_dir, "documents"))
