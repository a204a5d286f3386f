"""Text decoded with the wrong character encoding: found, and restored where the bytes survive.

UTF-8 read as a single-byte encoding X gives every character a sequence of two to four characters; these sequences, also of
text misread twice, are computed beforehand for all X and a repertoire derived from the encodings themselves
and from whole alphabets. An Aho-Corasick automaton over all of them finds the longest leftmost
matches, and only the matched spans are replaced; correct text around them, markup and entities stay untouched.

Sequences that can be legal text (a letter of a native alphabet before another sign, box drawing, ideographs) need evidence
beside them: a Latin letter or digit in the same word, a chain of such spans, or several in a text without letters
of that alphabet. One single-byte encoding read as another gives single characters; there a word must be
impossible as it stands (alphabets mixed, a capital inside, no plain letter at all), and one pair of
encodings must make every such word of the text possible, at least two words or four characters.
A cheap expression in the JVM keeps texts without any suspicious pair of characters out of Python.

Defined results: null and empty text is never affected; U+FFFD (and its own garbled forms) and control characters left
after the restoration mark lost characters: affected, not restorable, left as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings in which bytes get misread. Bytes without a character stay as control characters.
READ_AS = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "iso8859-15", "cp866", "koi8-r", "iso8859-2", "iso8859-5", "cp1253", "cp1257", "cp852", "mac_cyrillic")
LOST = "�"
_span = lambda a, b: "".join(map(chr, range(a, b + 1)))
#: Alphabets beside what the encodings hold: Greek, Cyrillic, Vietnamese, general punctuation.
ALPHABETS = _span(0x386, 0x3CE) + _span(0x401, 0x45F) + _span(0x1EA0, 0x1EF9) + _span(0x2010, 0x2027) + _span(0x2030, 0x203F) + "€−"
#: Scripts of many signs: kana with its punctuation, ideographs.
SIGNS = _span(0x3001, 0x30FF) + _span(0x4E00, 0x9FFF) + _span(0xFF01, 0xFF5E)
_NATIVE = re.compile(r"[Ͱ-ӿ]")
_BOX = re.compile(r"[─-▟]")
_LATIN = re.compile(r"[A-Za-z0-9À-ɏ]")


@lru_cache(maxsize=64)
def _table(encoding: str) -> tuple[str, ...]:
    """The character of each byte."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


def misread(text: str, encoding: str, true: str = "utf-8") -> str | None:
    """The text's bytes in ``true`` as characters of ``encoding``; bytes undefined there become control characters."""
    table = _table(encoding)
    raw = text.encode(true)
    if any(ord(table[b]) == b and b >= 0xA0 and encoding != "latin-1" and _undefined(encoding, b) for b in raw):
        return None
    return "".join(table[b] for b in raw)


@lru_cache(maxsize=8192)
def _undefined(encoding: str, b: int) -> bool:
    try:
        bytes([b]).decode(encoding)
        return False
    except UnicodeDecodeError:
        return True


@lru_cache(maxsize=4)
def repertoire(encodings: tuple[str, ...] = READ_AS) -> str:
    """Letters and signs of all the encodings, and of the alphabets."""
    own = {c for e in encodings for c in _table(e)[0x80:] if ord(c) >= 0xA0 and not _BOX.match(c)}
    return "".join(sorted(own | set(ALPHABETS)))


@lru_cache(maxsize=4)
def sequences(encodings: tuple[str, ...] = READ_AS, signs: str = SIGNS) -> dict[str, tuple[str, str]]:
    """Garbled sequence -> (original character, reading), for one and two misreadings; lost characters map to themselves."""
    table: dict[str, tuple[str, str]] = {}
    once: dict[str, dict[str, str]] = {e: {} for e in encodings}
    for e in encodings:
        for ch in repertoire(encodings) + LOST:
            g = misread(ch, e)
            if g and g != ch:
                once[e][ch] = g
    for e in reversed(encodings):  # signs first, letters over them, so that the commoner reading wins where both give one sequence
        for ch in signs:
            g = misread(ch, e)
            if g:
                table[g] = (ch, e)
    for e in reversed(encodings):  # twice, then once
        for e2 in ("latin-1", "cp1252") if e in ("latin-1", "cp1252") else (e,):
            for ch, g in once[e].items():
                g2 = misread(g, e2)
                if g2:
                    table[g2] = (ch, e)
    for e in reversed(encodings):
        for ch, g in once[e].items():
            table[g] = (ch, e)
    table = {k: v for k, v in table.items() if len(k) > 1}
    table[LOST] = (LOST, "")
    return table


def _needs_evidence(g: str, ch: str, reading: str) -> int:
    """0 for a certain sequence; 1 for one that can be legal beside other letters; 2 for one that can stand among them."""
    if ch in SIGNS:
        return 2
    if len(g) > 2 or ch == LOST:
        return 0
    if reading in ("cp437", "cp850", "cp852", "mac_roman") and g.isalpha() and all(_LATIN.match(c) for c in g):
        return 2
    return int(_NATIVE.match(g[0]) is not None or _BOX.match(g[0]) is not None)


@lru_cache(maxsize=4)
def automaton(encodings: tuple[str, ...] = READ_AS):
    import ahocorasick

    a = ahocorasick.Automaton()
    for g, (ch, e) in sequences(encodings).items():
        a.add_word(g, (len(g), ch, e, _needs_evidence(g, ch, e)))
    a.make_automaton()
    return a


def _believed(text: str, spans: list[tuple[int, int, str, str, int]]) -> list[tuple[int, int, str, str, int]]:
    """The spans that are certain or have evidence."""
    if not any(weak for *_, weak in spans):
        return spans
    # chains of adjacent spans stand or fall together
    chains: list[list[tuple[int, int, str, str, int]]] = []
    outside, by_reading, at = [], {}, 0
    for s in spans:
        if chains and chains[-1][-1][1] == s[0]:
            chains[-1].append(s)
        else:
            chains.append([s])
            by_reading[s[3]] = by_reading.get(s[3], 0) + 1
        outside.append(text[at : s[0]])
        at = s[1]
    outside = " ".join([*outside, text[at:]])
    native = _NATIVE.search(outside) is not None or _BOX.search(outside) is not None
    keep = []
    for c in chains:
        if all(weak for *_, weak in c):
            first, last = c[0][0], c[-1][1]
            signs = all(ch in SIGNS for _, _, ch, _, _ in c)
            beside = (first > 0 and _LATIN.match(text[first - 1])) or (last < len(text) and _LATIN.match(text[last]))
            several = by_reading[c[0][3]] > 1 and not native
            among = any(weak == 2 for *_, weak in c)
            if not (len(c) >= (2 if signs else 3) or (not among and (beside or several))):
                continue
        keep += c
    return keep


# --- one single-byte encoding read as another ---

#: Signs that never stand within a word (apostrophes, hyphens, dashes and quotes do).
_ODD = "─-◿∀-⋿¢-¦§¨©¬®-¶¸¹¼-¿×÷ˆ-˝™†‡•‰⁄\x80-\x9f‚„"
_WORDS = re.compile(rf"[^\W\d_]+(?:[{_ODD}]+[^\W\d_]+)*")
_ALONE = re.compile(r"(?<![^\s(«\"])[^\x00-\x7f](?![^\s,.;:)»\"])")
#: The letters most used beside the plain ones, by alphabet; what a right reading mostly yields.
COMMON = frozenset("éèàçêâîôûëïœüöäßáíóúñãõåøæčšžřěýůłąężśćńőűșțăğışΑαειοντσςρκπλμάέήίόύώоеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ")
_SCRIPTS = ((0x41, 0x24F), (0x370, 0x3FF), (0x400, 0x4FF))


def _script(c: str) -> int:
    return next((i for i, (a, b) in enumerate(_SCRIPTS) if a <= ord(c) <= b), -1)


def _possible(word: str) -> bool:
    """Letters of one alphabet, no capital after a small letter that is no plain one, and plain letters among Latin ones."""
    if not word.isalpha() or len({_script(c) for c in word}) > 1:
        return False
    if any(a.islower() and b.isupper() and not b.isascii() for a, b in zip(word, word[1:])):
        return False
    return _script(word[0]) != 0 or len(word) < 4 or any(c.isascii() for c in word)


@lru_cache(maxsize=512)
def _translation(read_as: str, true: str) -> dict[int, str | None]:
    """Character read -> character meant, None where the byte has none."""
    return {ord(r): (None if _undefined(true, b) else t) for b, (r, t) in enumerate(zip(_table(read_as), _table(true))) if b >= 0x80}


def restore_single_byte(text: str, encodings: tuple[str, ...] = READ_AS) -> tuple[str, int]:
    """Text with impossible words read anew by the one pair of encodings that makes all of them possible, and their number."""
    words = [m for m in _WORDS.finditer(text) if not m.group().isascii() and not _possible(m.group())]
    odd = sum(not c.isascii() for m in words for c in m.group())
    if len(words) < 2 and odd < 4:
        return text, 0
    distinct = {m.group() for m in words}
    best = None
    for x in encodings:
        for t in encodings:
            if x == t:
                continue
            table = _translation(x, t)
            new = {}
            for w in distinct:
                if any(ord(c) >= 0x80 and table.get(ord(c)) is None for c in w):
                    break
                n = w.translate(table)
                if n == w or not _possible(n):
                    break
                new[w] = n
            else:
                letters = [c.lower() for n in new.values() for c in n if not c.isascii()]
                # of several pairs the one whose letters are the most common ones, written small inside words
                score = sum((c in COMMON) for c in letters) + 0.1 * sum(c.islower() for n in new.values() for c in n[1:])
                if sum(c in COMMON for c in letters) * 2 > len(letters) and (best is None or score > best[0]):
                    best = (score, new, table)
    if best is None:
        return text, 0
    # words that are possible as they stand belong to the same reading if all of them make sense in it
    table, fixed = best[2], best[1]
    others = {m.group() for m in _WORDS.finditer(text) if not m.group().isascii()} - distinct
    if all(table.get(ord(c)) for w in others for c in w if ord(c) >= 0x80):
        anew = {w: w.translate(table) for w in others}
        letters = [c.lower() for n in anew.values() for c in n if not c.isascii()]
        if all(map(_possible, anew.values())) and sum(c in COMMON for c in letters) * 2 > len(letters):
            words, fixed = [m for m in _WORDS.finditer(text) if not m.group().isascii()], fixed | anew
    out, at = [], 0
    for m in words:
        out += (text[at : m.start()], fixed[m.group()])
        at = m.end()
    # single letters that stand alone belong to the same reading
    alone = lambda m: n if (n := best[2].get(ord(m.group()))) and n.lower() in COMMON else m.group()
    return _ALONE.sub(alone, "".join([*out, text[at:]])), len(words)


def restore(text: str | None, encodings: tuple[str, ...] = READ_AS) -> tuple[str | None, int, int]:
    """Restored text, number of garbled spans, number of characters that are lost."""
    if not text:
        return text, 0, 0
    spans = [(end - n + 1, end + 1, ch, e, weak) for end, (n, ch, e, weak) in automaton(encodings).iter_long(text)]
    spans = _believed(text, spans)
    if not spans:
        done, n = restore_single_byte(text, encodings)
        left = _control(done)
        return done, n + left, left
    out, at, lost = [], 0, 0
    for a, b, ch, _, _ in spans:
        out += (text[at:a], ch)
        at = b
        lost += ch == LOST
    out.append(text[at:])
    done = "".join(out)
    return done, len(spans), lost + _control(done)


def _control(text: str) -> int:
    """Control characters no text holds (the one that ends a line excepted): bytes no reading explains."""
    return sum(0x80 <= ord(c) < 0xA0 and c != "\x85" for c in text)


def suspicious(c: Column, encodings: tuple[str, ...] = READ_AS) -> Column:
    """True where a text may be affected: how sequences begin, or signs of a word that can't be."""

    def escape(chars):
        return "".join(f"\\u{ord(x):04x}" for x in sorted(chars))

    seqs = {s: ch for s, (ch, _) in sequences(encodings).items() if s != LOST}
    letters = {s[0] for s, ch in seqs.items() if ch not in SIGNS}
    signs = {s[0] for s, ch in seqs.items() if ch in SIGNS} - letters
    # every alternative begins with a character beyond ASCII, which most places of a text don't hold
    garbled = c.rlike(f"[^\\x00-\\x7f](?:(?<=[{escape(letters)}])[^\\x00-\\x7f]|(?<=[{escape(signs)}])[^\\x00-\\x7f]{{2}})")
    odd = r"[^\x00-\x7f](?:(?<=[a-z][Ͱ-ӿ─-▟])|(?<=[Ͱ-ӿ─-▟])[a-z]|(?<=\p{Ll}\p{Lu})|(?<=[À-ÿ])[À-ÿ]{3}|(?<=\p{L}[∀-⋿ˆ-˝¢-¦§¨©¬®-¶¸¹¼-¿×÷™†‡•‰⁄‚„])\p{L}|(?<=[\x80-\x84\x86-\x9f�]))"
    return F.coalesce(c.rlike(odd) | garbled, F.lit(False))


def garbled_fields(rows: DataFrame, key: str, fields: list[str], encodings: tuple[str, ...] = READ_AS) -> DataFrame:
    """One row per affected (key, field): restored text, garbled spans, lost characters. Repeated rows stay repeated."""
    maybe = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.when(suspicious(F.col(f), encodings), F.col(f)).alias("text")) for f in fields]), lambda x: x["text"].isNotNull())
    long = rows.select(F.col(key).alias("key"), F.inline(maybe))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [restore(t, encodings) for t in pdf.text]
            out = pd.DataFrame({"key": pdf.key, "field": pdf.field, "restored": [x[0] for x in done], "n_spans": [x[1] for x in done], "n_lost": [x[2] for x in done]})
            yield out[out.n_spans > 0]

    kind = rows.schema[key].dataType.simpleString()
    return long.mapInPandas(fix, f"key {kind}, field string, restored string, n_spans long, n_lost long")
