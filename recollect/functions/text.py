"""Text functions: Column builders on the JVM, Arrow UDFs only where Unicode tables or line folds need them."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values (word lists and patterns that decide results) ---
IMPERATIVE = [
    "ignore previous instructions", "ignore all previous instructions", "ignore prior instructions", "disregard previous instructions", "disregard all prior",
    "ignore the above", "forget your instructions", "forget all previous", "you must now", "from now on you", "new instructions:", "system prompt:",
    "your new system prompt", "do not tell the user", "don't tell the user", "without telling the user", "reply only with", "respond only with", "when you read this, ",
]
TOOL_CALL = ["<tool_call>", "</tool_call>", "<function_call>", '"function_call"', '"tool_calls"', "<|im_start|>", "<|endoftext|>", "[system](#", "<system>"]
EXFIL = ["send this to http", "send the above to", "post this to http", "forward this conversation to", "curl -x post http", "curl http", "wget http", "exfiltrate"]
MARKERS = {"imperative-instruction": IMPERATIVE, "tool-call-syntax": TOOL_CALL, "exfil-marker": EXFIL}
ENCODED_RUN = "[A-Za-z0-9+/=]{120,}"
ENTITY_STOPWORDS = set(
    "the this that these those a an i we you he she it they my our your their if when then and or but so monday tuesday wednesday thursday friday saturday sunday "
    "january february march april may june july august september october november december today tomorrow yesterday ok yes no hi hello".split()
)
CODE_EXTENSIONS = (
    "asm bash bat c cc cfg clj conf cpp cs css csv cxx dart diff dockerfile ex exs f90 fish go gradle graphql groovy h hpp hs html ini java jl js json jsonl jsx kt kts lisp lock lua m make mk ml "
    "nim nix patch php pl properties proto ps1 psm1 py pyi r rb rs sbt scala scm sh sql svg swift tf tfvars toml ts tsv tsx vb vim xml yaml yml zig zsh"
).split()
CODE_FILENAMES = "dockerfile makefile rakefile gemfile justfile procfile cmakelists.txt .gitignore .dockerignore .editorconfig .env".split()
TAG_RULES = [
    ("question", ["what ", "how ", "why ", "when ", "where ", "who "]),
    ("preference", ["i love", "i like", "i prefer", "i hate", "my favorite", "i enjoy"]),
    ("decision", ["decided", "we will", "i will", "going to", "plan to", "let's"]),
    ("procedure", ["first,", "then ", "step ", "afterwards", "finally"]),
    ("event", ["yesterday", "today", "last week", "went to", "happened", "attended"]),
]
#: Letters that no decomposition reaches, keyed by their lower-case form.
LETTERS = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ſ": "s", "ĳ": "ij", "ŉ": "n", "ẚ": "a", "ß": "ss", "æ": "ae", "ø": "o", "đ": "d", "ŀ": "l", "ł": "l",
    "œ": "oe", "ŧ": "t", "ƒ": "f", "ǆ": "dz", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz", "ȷ": "j", "ı": "i", "ς": "σ", "ϲ": "σ", "ϐ": "β", "µ": "μ", "ё": "е",
    "آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ٲ": "ا", "ٳ": "ا", "ٵ": "ا", "ى": "ي", "ی": "ي", "ة": "ه", "ۃ": "ه", "ۀ": "ه", "ہ": "ه", "ۂ": "ه", "ک": "ك",
}
#: Ranges of scripts that don't delimit words: name, first, last.
ATTACHING = [
    ("han", 0x3005, 0x3005), ("han", 0x303B, 0x303B), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x2A6DF), ("han", 0x2A700, 0x2EBEF), ("han", 0x2F800, 0x2FA1F),
    ("hiragana", 0x3040, 0x309F), ("katakana", 0x30A0, 0x30FF), ("katakana", 0x31F0, 0x31FF), ("katakana", 0xFF66, 0xFF9F), ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xA960, 0xA97F),
    ("hangul", 0xAC00, 0xD7A3), ("hangul", 0xD7B0, 0xD7FF), ("bopomofo", 0x3105, 0x312F), ("bopomofo", 0x31A0, 0x31BF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x08A0, 0x08FF),
    ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("hebrew", 0x0590, 0x05FF), ("hebrew", 0xFB1D, 0xFB4F), ("khmer", 0x1780, 0x17FF), ("khmer", 0x19E0, 0x19FF), ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF), ("myanmar", 0x1000, 0x109F), ("myanmar", 0xA9E0, 0xA9FF), ("myanmar", 0xAA60, 0xAA7F),
]
#: Letter scripts for telling whether two texts can share a word: bit and character class.
LETTER_SCRIPTS = [
    (0, "A-Za-zÀ-ɏḀ-ỿ"), (1, "Ͱ-Ͽἀ-῿"), (2, "Ѐ-ԯ"), (3, "԰-֏"), (4, "֐-׿"), (5, "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"),
    (6, "ऀ-ॿ"), (7, "ঀ-৿"), (8, "਀-੿"), (9, "઀-૿"), (10, "଀-୿"), (11, "஀-௿"), (12, "ఀ-౿"), (13, "ಀ-೿"), (14, "ഀ-ൿ"),
    (15, "඀-෿"), (16, "฀-๿"), (17, "຀-໿"), (18, "ༀ-࿿"), (19, "က-႟"), (20, "Ⴀ-ჿᲐ-Ჿ"), (21, "ሀ-፿"), (22, "ក-៿"),
    (23, "぀-ゟ"), (24, "゠-ヿ"), (25, "㄀-ㄯ"), (26, "㐀-䶿一-鿿豈-﫿"), (27, "ᄀ-ᇿ㄰-㆏가-힯"),
]
# --- End of fixed values ---


def make_safe(text: Column) -> Column:
    """Line ends as LF, control characters but tab and LF dropped."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\u009F]", "")


def _fold_lines(text: str) -> str:
    """Right-trims lines and keeps two blank lines of a run, outside fenced blocks."""
    out: list[str] = []
    fenced, blank = False, 0
    for line in text.split("\n"):
        mark = line.lstrip()[:3] in ("```", "~~~")
        if fenced or mark:
            fenced, blank = fenced ^ mark, 0
            out.append(line)
            continue
        line = line.rstrip()
        blank = 0 if line else blank + 1
        if blank <= 2:
            out.append(line)
    return "\n".join(out).strip("\n")


CODE_EDGES = re.compile(r"\A\n+|\n+\Z")


def tidied(text: str) -> str:
    """A safe text as prose: line by line, or right-trimmed where it is one line."""
    return _fold_lines(text) if "\n" in text else text.rstrip(" \t\n\x0b\f\r")


@F.pandas_udf(T.StringType())
def _prose(text: pd.Series) -> pd.Series:
    return text.map(_fold_lines, na_action="ignore")


def normalize_content(text: Column, mode: Column | None = None) -> Column:
    """Prose is tidied line by line; code keeps all but its outer blank lines. Plain prose without line ends stays on the JVM."""
    safe = make_safe(text)
    prose = F.when(F.contains(safe, F.lit("\n")), _prose(safe)).otherwise(F.regexp_replace(safe, r"\s+$", ""))
    return prose if mode is None else F.when(mode == "code", F.regexp_replace(safe, r"^\n+|\n+$", "")).otherwise(prose)


def mode_for_path(path: Column) -> Column:
    """code or prose, from the file name alone."""
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    ext = F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)
    return F.when(name.isin(CODE_FILENAMES) | ext.isin(CODE_EXTENSIONS), "code").otherwise("prose")


def normalize_wing(name: Column) -> Column:
    """Lower case, blanks as hyphens, only letters, digits, hyphens and underscores, no outer hyphens."""
    kept = F.regexp_replace(F.translate(F.lower(F.trim(name)), " ", "-"), r"[^\p{L}\p{N}_-]", "")
    return F.regexp_replace(kept, "^-+|-+$", "")


def valid_name(name: Column) -> Column:
    """1 to 128 bytes after trimming, no control characters, no slashes."""
    size = F.octet_length(F.trim(name))
    return (size >= 1) & (size <= 128) & ~F.rlike(name, F.lit(r"[\x00-\x1F\x7F/\\]"))


def valid_content(text: Column) -> Column:
    """At most 100,000 bytes."""
    return F.octet_length(text) <= 100_000


def _is_mark(c: str) -> bool:
    return "̀" <= c <= "ͯ"


def _family(c: str) -> str:
    name = unicodedata.name(c, "")
    return next((s for s in ("LATIN", "GREEK", "CYRILLIC") if name.startswith(s)), "")


#: Characters whose form depends on their neighbours: combining marks, letters that lower-case by context, compatibility forms.
_NEIGHBOURLY = re.compile("[\u0300-\u036fΣİﭐ-﷿ﹰ-\ufeff！-ￜ]")
_DIGITS = {**{chr(0x660 + d): str(d) for d in range(10)}, **{chr(0x6F0 + d): str(d) for d in range(10)}}


def _fold(text: str) -> str:
    """fold_key of any text in its composed form, character by character."""
    wide = []
    for c in text:
        form = unicodedata.normalize("NFKC", c) if "ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "﻿" or "！" <= c <= "ￜ" else c
        wide.append(form if len(form) <= 4 and form.isalnum() and c.isalnum() else c)
    low, out = unicodedata.normalize("NFC", "".join(wide)).lower(), []
    for c in low:
        if _is_mark(c) and out and (_family(out[-1]) in ("LATIN", "GREEK") or _family(out[-1]) == "CYRILLIC" and c in "̀́"):
            continue
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isalpha() and _family(base[0]) in ("LATIN", "GREEK"):
            out.extend(x for x in base if not _is_mark(x))
        else:
            out.append(c)
    return "".join(LETTERS.get(c) or _DIGITS.get(c) or c for c in out)


class _Folded(dict):
    """The folded form of each character, made when it is first asked for."""

    def __missing__(self, code: int) -> str:
        self[code] = _fold(chr(code))
        return self[code]


_FOLDED = _Folded()


def fold_key(text: str) -> str:
    """The search form of a text: compatibility letters expanded, lower case, Latin and Greek without diacritics, letter variants joined."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return _fold(text) if _NEIGHBOURLY.search(text) else text.translate(_FOLDED)


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(fold_key, na_action="ignore")


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def search_key(text: Column) -> Column:
    """fold_key; ASCII texts never leave the JVM."""
    return F.when(_ascii(text), F.lower(text)).otherwise(_folded(F.when(~_ascii(text), text)))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def match_key(text: Column) -> Column:
    """NFC; ASCII texts never leave the JVM."""
    return F.when(_ascii(text), text).otherwise(_nfc(F.when(~_ascii(text), text)))


def _script(c: str) -> str:
    code = ord(c)
    return "other" if code < 0x590 else next((s for s, a, b in ATTACHING if a <= code <= b), "other")


_ASCII_WORDS = re.compile("[A-Za-z0-9]+")
_WORDS = re.compile(r"[^\W_]+")
#: Characters of scripts whose words attach to one another, and marks that join a word.
_ATTACHED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for _, a, b in ATTACHING) + "".join(chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c)) in (7, 9)) + "]")


def segment_text(text: str) -> tuple[list[str], list[bool], int]:
    """Tokens, whether each is a fragment of a longer word, and the length in content units."""
    if text.isascii():
        words = _ASCII_WORDS.findall(text)
        return words, [False] * len(words), len(words)
    if not _ATTACHED.search(text):
        words = _WORDS.findall(text)
        return words, [False] * len(words), len(words)
    tokens: list[str] = []
    fragment: list[bool] = []
    length, run = 0, ""

    def emit(part: str, script: str) -> None:
        nonlocal length
        if script == "other":
            tokens.append(part)
            fragment.append(False)
            length += 1
            return
        length += len(part)
        if script == "han" or len(part) == 1:
            tokens.extend(part)
            fragment.extend([False] * len(part))
        if len(part) > 1:
            pairs = [part[i : i + 2] for i in range(len(part) - 1)]
            tokens.extend(pairs)
            fragment.extend([script != "han" and len(part) > 2] * len(pairs))
        if len(part) > 2:
            tokens.append(part)
            fragment.append(False)

    def close() -> None:
        nonlocal run
        at = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or _script(run[i]) != _script(run[at]):
                emit(run[at:i], _script(run[at]))
                at = i
        run = ""

    for c in text:
        joins = unicodedata.combining(c) in (7, 9) and run and _script(run[-1]) == "other"
        if c.isalnum() or joins:
            run += c
        elif run:
            close()
    if run:
        close()
    return tokens, fragment, length


SEGMENTED = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("ngram", T.ArrayType(T.BooleanType())), T.StructField("len", T.LongType())])
_SEGMENTED = pa.struct([("tokens", pa.list_(pa.string())), ("ngram", pa.list_(pa.bool_())), ("len", pa.int64())])


@F.arrow_udf(SEGMENTED)
def segment(text: pa.Array) -> pa.Array:
    """segment_text of each value; null gives empty lists. Tokens are packed 256 texts at a time."""
    parts = []
    for at in range(0, len(text), 256):
        own = [segment_text(t) if t is not None else ([], [], 0) for t in text[at : at + 256].to_pylist()]
        parts.append(pa.StructArray.from_arrays([pa.array([s[k] for s in own], f.type) for k, f in enumerate(_SEGMENTED)], fields=list(_SEGMENTED)))
    return pa.concat_arrays(parts) if parts else pa.array([], _SEGMENTED)


def words(text: Column) -> Column:
    """Letter and digit runs of delimiting scripts, in order, from a search key."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)


#: Characters up to the end of Latin extended B but the three letters there that no listed script holds.
_COMMON = "[\\x00-\\u00A9\\u00AB-\\u00B4\\u00B6-\\u00B9\\u00BB-\\u024F]+"


def script_mask(text: Column) -> Column:
    """A bit for each letter script that occurs; 63 for letters of any other. What lies beyond Latin is cut out first, and
    once, so that the other scripts are looked for in little text."""
    listed = "".join(chars for _, chars in LETTER_SCRIPTS)

    def bits(x: Column) -> Column:
        rest = x["rest"]
        out = F.when(F.rlike(rest, F.lit(f"(?![{listed}])\\p{{L}}")), F.lit(-(1 << 63))).otherwise(F.lit(0)).cast("long")
        for bit, chars in LETTER_SCRIPTS:
            out = out.bitwiseOR(F.when(F.rlike(x["text"] if bit == 0 else rest, F.lit(f"(?=\\p{{L}})[{chars}]")), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
        return out

    both = F.struct(text.alias("text"), F.regexp_replace(text, _COMMON, "").alias("rest"))
    return F.when(_ascii(text), F.rlike(text, F.lit("[A-Za-z]")).cast("long")).otherwise(_once(both, bits))


def scripts_disjoint(a: Column, b: Column) -> Column:
    """Both have letters and no script in common."""
    return (a != 0) & (b != 0) & (a.bitwiseAND(b) == 0)


def split_chunks(text: str, size: int = 800, overlap: int = 100, least: int = 50) -> list[str]:
    """Paragraphs packed up to size bytes; longer ones cut into overlapping windows; a short tail joins its predecessor."""
    text = text.strip()
    if len(text.encode()) <= size:
        return [text] if text else []
    out: list[str] = []
    packed = b""
    for para in (p.strip().encode() for p in text.split("\n\n")):
        if not para:
            continue
        if len(packed) + len(para) + 2 <= size:
            packed = packed + b"\n\n" + para if packed else para
            continue
        if packed:
            out.append(packed.decode())
        packed = para if len(para) <= size else b""
        start = 0 if len(para) > size else len(para)
        while start < len(para):
            end = min(start + size, len(para))
            while end < len(para) and para[end] & 0xC0 == 0x80:
                end += 1
            while para[start] & 0xC0 == 0x80:
                start += 1
            out.append(para[start:end].decode())
            if end == len(para):
                break
            start = end - overlap if end - overlap > start else end
    if packed:
        out.append(packed.decode())
    if len(out) > 1 and len(out[-1].encode()) < least:
        out[-2:] = [out[-2] + "\n\n" + out[-1]]
    return [c for c in out if c.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks(text: pd.Series) -> pd.Series:
    """split_chunks of each value."""
    return text.map(lambda t: split_chunks(t) if isinstance(t, str) else [])


_WORD_CHARS = re.compile(r"[^\w'-]|_", re.U)


def find_entities(text: str) -> list[str]:
    """Capitalised runs of two words and more, and single capitalised words that don't begin a sentence; lower case, sorted."""
    found = set()
    for sentence in re.split(r"[.!?\n]", text):
        run: list[str] = []
        begun = 0
        for i, raw in enumerate([*sentence.split(), ""]):
            word = "" if raw.islower() else _WORD_CHARS.sub("", raw)
            if word[:1].isupper() and any(c.islower() for c in word[1:]) and word.lower() not in ENTITY_STOPWORDS:
                begun = i if not run else begun
                run.append(word)
                continue
            if len(run) > 1 or run and begun:
                found.add(" ".join(run).lower())
            run = []
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def entities(text: pd.Series) -> pd.Series:
    """find_entities of each value."""
    return text.map(lambda t: find_entities(t) if isinstance(t, str) else [])


def _byte_offset(text: Column, position: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), position - 1)).cast("long")


def _once(value: Column, made) -> Column:
    """``made`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), made)[0]


def _offset(text: Column, position: Column) -> Column:
    """Byte offset of a position that is computed once; null for 0 or null."""
    return _once(F.struct(text.alias("t"), position.alias("i")), lambda x: F.when(x["i"] > 0, _byte_offset(x["t"], x["i"])))


def first_marker(lowered: Column, markers: list[str]) -> Column:
    """Byte offset of the first of the markers in lower-cased text, looked for in one pass where there is any; null without one."""
    pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", m) for m in markers)
    held = lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in markers))
    return _once(lowered, lambda low: _offset(low, F.when(held(low), F.regexp_instr(low, F.lit(pattern)))))


def encoded_run(text: Column) -> Column:
    """Byte offset of the first long run of the base64 alphabet; null without one."""
    return _offset(text, F.regexp_instr(text, F.lit(ENCODED_RUN)))


def screen(text: Column, similar: Column | None = None) -> Column:
    """Signals (code, offset) in class order; ``similar`` is the offset of a window like a known attack, if computed."""
    signal = lambda code: lambda at: F.when(at.isNotNull(), F.struct(F.lit(code).alias("code"), at.alias("offset")))
    found = [(code, first_marker(F.lower(text), list_)) for code, list_ in MARKERS.items()] + [("encoded-blob", encoded_run(text))]
    signals = [_once(at, signal(code)) for code, at in found]
    return F.array_compact(F.array(*signals, *([] if similar is None else [signal("fixture-similarity")(similar.cast("long"))])))


def rule_tag(text: Column) -> Column:
    """The first rule that fits: question, preference, decision, procedure, event, else statement."""
    trimmed = F.trim(text)
    low, out = F.lower(trimmed), F.lit("statement")
    for tag, phrases in reversed(TAG_RULES):
        fits = F.contains(low, F.lit(phrases[0]))
        for phrase in phrases[1:]:
            fits = fits | F.contains(low, F.lit(phrase))
        out = F.when((F.endswith(trimmed, F.lit("?")) | fits) if tag == "question" else fits, tag).otherwise(out)
    return out


def speaker_label(speaker: Column, role: Column) -> Column:
    """The named speaker, else the role with its first letter capitalised, else Unknown."""
    capital = F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 1_000_000))
    return F.coalesce(F.when(F.trim(speaker) != "", speaker), F.when(role != "", capital), F.lit("Unknown"))


def snippet(text: Column, query: str, size: int = 100) -> Column:
    """One line of at most ``size`` characters that opens a little before the first query word."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    terms = [t for t in re.split(r"\W+", query.lower()) if len(t) > 1]
    hits = [F.nullif(F.instr(F.lower(flat), F.lit(t)), F.lit(0)) for t in terms] or [F.lit(None).cast("int")]
    at = F.coalesce(F.least(*hits) if len(hits) > 1 else hits[0], F.lit(1))
    from_ = F.greatest(at - size // 3, F.lit(1))
    space = F.instr(F.substring(flat, from_, at - from_), F.lit(" "))
    start = F.when(at == 1, F.lit(1)).when(space > 0, from_ + space).otherwise(from_)
    tail = F.substring(flat, start, F.lit(size))
    more = F.char_length(flat) - start + 1 > size
    return F.concat(F.when(start > 1, "…").otherwise(""), F.when(start > 1, F.rtrim(tail)).otherwise(tail), F.when(more, "…").otherwise(""))


def evidence(exact: Column, morph: Column, semantic: Column) -> Column:
    """The channels of a hit, in words."""
    return F.format_string("exact %.3f · morph %.3f · semantic %.3f", exact, morph, semantic)


def within_one_edit(a: Column, b: Column) -> Column:
    """Equal, or one edit apart where both have five characters and more."""
    near = (F.char_length(a) >= 5) & (F.char_length(b) >= 5) & (F.levenshtein(a, b, 1) >= 0)
    return (a == b) | near


#: Inflections taken off the ends of words, by language; our own short lists.
SUFFIXES = {
    "en": "ings ing edly ed ies es s ly", "de": "ungen ung heiten heit keiten keit lichen liche lich en er es em e n s", "nl": "ingen ing heden heid en er s e", "it": "zioni zione mente are ere ire i e a o",
    "es": "ciones ción mente ados adas ado ada os as es ar er ir o a s", "fr": "tions tion ments ment ements eaux aux es er ez é és ée ées s e", "pt": "ções ção mente ados adas ado ada os as es ar er ir o a s",
    "tr": "ların lerin lar ler ın in un ün da de dan den ı i u ü", "ru": "ами ями ого его ому ему ых их ой ей ам ям ах ях ы и а я у ю е о", "el": "ους ων ες ος ας ης α η ο", "hi": "ों ें ीं ो े ी ा", "ka": "ების ები ის ს ი", "ko": "에서 으로 에게 은 는 이 가 을 를 의",
}


def stem(token: Column, language: str) -> Column:
    """A token without its first listed suffix that leaves three characters."""
    listed = "|".join(sorted(SUFFIXES[language].split(), key=lambda s: (-len(s), s)))
    return F.regexp_replace(token, f"^(.{{3,}}?)(?:{listed})$", "$1")


def inflected(word: str, language: str) -> list[str]:
    """Every token that has the word's stem: the stem alone or with one of the listed suffixes, where taking suffixes
    off leads back to it."""
    listed = "|".join(sorted(SUFFIXES[language].split(), key=lambda s: (-len(s), s)))
    base = lambda t: re.sub(f"^(.{{3,}}?)(?:{listed})$", r"\1", t)
    own = base(word)
    return [t for t in (own, *(own + s for s in SUFFIXES[language].split())) if base(t) == own]


def edit_keys(token: Column) -> Column:
    """Hashes of a token and of what it is without each one of its letters; two tokens one edit apart have one in common."""
    cut = lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.lit(1 << 30)))
    shorter = F.transform(F.sequence(F.lit(1), F.char_length(token)), cut)
    return F.when(F.char_length(token) > 0, F.array_distinct(F.transform(F.concat(F.array(token), shorter), lambda k: F.xxhash64(k)))).otherwise(F.array().cast("array<bigint>"))


def locate(claim: Column, text: Column) -> Column:
    """Byte span (offset, len) of a claim in a text; null where it isn't there."""
    at = F.instr(text, claim)
    return F.when((at > 0) & (claim != ""), F.struct(_byte_offset(text, at).alias("offset"), F.octet_length(claim).cast("long").alias("len")))


def f1_tokens(text: Column) -> Column:
    """Lower-case letter and digit runs; every CJK character by itself."""
    cjk = "一-鿿㐀-䶿぀-ヿ가-힯"
    return F.transform(F.regexp_extract_all(text, F.lit(f"([{cjk}]|[\\p{{L}}\\p{{N}}&&[^{cjk}]]+)"), 1), lambda t: F.lower(t))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets; 0 where either is empty."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def _salvage(text: str) -> list[dict]:
    """Complete objects of a JSON array that may be fenced, surrounded by prose or cut off."""
    decoder, out, at = json.JSONDecoder(strict=False), [], text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                out.append(value)
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    return out


def _in_slices(values: pa.Array, one, made: pa.DataType) -> pa.Array:
    """``one`` of each value, packed 256 values at a time."""
    parts = [pa.array([one(t) for t in values[at : at + 256].to_pylist()], made) for at in range(0, len(values), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], made)


def _compact_objects(text: str | None) -> list[str]:
    return [json.dumps(o, separators=(",", ":"), ensure_ascii=False) for o in _salvage(text)] if text is not None else []


@F.arrow_udf(T.ArrayType(T.StringType()))
def _lenient(text: pa.Array) -> pa.Array:
    return _in_slices(text, _compact_objects, pa.list_(pa.string()))


#: Declared nondeterministic so that Spark runs it once a row: a filter on what it gives would run it again below, with
#: Python workers of its own.
_lenient_once = _lenient.asNondeterministic()


def lenient_objects(text: Column) -> Column:
    """The objects found in model output, each as compact JSON; null gives none."""
    return _lenient_once(text)


def _render(block: object) -> str:
    if isinstance(block, str):
        return block
    if block is None:
        return ""
    if isinstance(block, list):
        return "\n".join(r for r in map(_block, block) if r.strip())
    return json.dumps(block, separators=(",", ":"), ensure_ascii=False)


def _block(block: object) -> str:
    if not isinstance(block, dict):
        return _render(block)
    kind = block.get("type") or ""
    if kind == "text":
        return block.get("text") or ""
    if kind in ("thinking", "reasoning", "redacted_thinking"):
        said = block.get("thinking") or block.get("text") or ""
        return f"[thinking]\n{said}" if said else ""
    if kind in ("tool_use", "tool_call"):
        return f"[tool_use: {block.get('name') or 'tool'}]\n{_render(block.get('input', block.get('arguments')))}".rstrip()
    if kind == "tool_result":
        return f"[tool_result]\n{_render(block.get('content', block.get('output')))}".rstrip()
    if kind == "image":
        source = block.get("source") or {}
        where = source.get("url") or source.get("media_type") or ""
        return f"[image: {where}]" if where else "[image]"
    return f"[{kind}]\n{_render(block)}".rstrip() if kind else _render(block)


def _rendered(content: str | None) -> str:
    if content is None:
        return ""
    try:
        return _render(json.loads(content))
    except ValueError:
        return content


@F.arrow_udf(T.StringType())
def _render_all(content: pa.Array) -> pa.Array:
    return _in_slices(content, _rendered, pa.string())


#: Nondeterministic for the same reason as ``_lenient_once``.
_render_once = _render_all.asNondeterministic()


def render_content(content: Column) -> Column:
    """Message content (JSON text) as written: strings plain, blocks under a mark of their kind; null gives an empty text."""
    return _render_once(content)
