"""Problem 8: sentence boundaries across languages and scripts.

The boundary rules are compiled into a finite transducer. A regular expression finds the places where anything can
happen (line ends, stops, quotation marks, blanks between Thai letters). Each is read as classes of what stands around it
in a bounded stretch of text, and tables compiled from the rules over these classes (:data:`DOT`, :data:`STOP`,
:data:`CLOSE`) give its letter of a small alphabet; :data:`NEXT` / :data:`EMIT` say what a letter does in each of the
transducer's states. Reading a run of letters is thus a function from states to states. The functions of all events
of a batch are composed by a parallel prefix scan, where the letter that starts a document is a constant function.
Documents over :data:`CHUNK` code points are cut into chunks that different tasks read: each yields its function (one
state for each state), the functions of a document are composed in order, and a second pass over the chunks emits the
sentence ends from the state that each chunk is entered in.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 17
CONTEXT = 400
#: Chunks whose functions are composed at one node of the tree.
FAN = 128

# --- fixed values: abbreviations, by what may follow them ------------------------------------------------------------
#: Never at a sentence's end.
NEVER = frozenset(
    "p pp ch vol mr mrs ms dr prof fig figs sec vs approx mod cf ver resp acc e.g i.e viz st gen col rev hon "
    "abb kap nr bzw z.b d.h ca vgl bspw evtl ggf inkl s.o "
    "sr sra dr dra pág págs p.ej núm art mme mlle mm p.ex chap "
    "рис гл г см т.е стр ул им π.χ κ κα βλ डॉ श्री د أ".split()
)
#: At a sentence's end if what follows looks like the start of one.
SOMETIMES = frozenset(
    "etc a.m p.m p.a inc ltd co corp jr sr. usw u.a т.д т.п др κ.λπ κ.ά δευτ u.s "
    "mon tue tues wed thu thurs fri sat sun jan feb mar apr jun jul aug sept sep oct nov dec".split()
)
#: Abbreviations of two parts written with a space, likewise.
NEVER_PAIR = frozenset("z. b|d. h|p. ej|p. ex|т. е|i. e|e. g|u. a|s. o|π. χ".split("|"))
SOMETIMES_PAIR = frozenset("т. д|т. п|u. s|a. m|p. m|p. a|ee. tt|ee. uu|κ. ά".split("|"))
#: Before a number only.
BEFORE_NUMBER = frozenset("no nos nº".split())
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jänner "
    "januari leden siječnja jan feb mär apr jun jul aug sep okt nov dez".split()
)
#: Words that open an English sentence but no surname.
STARTERS = frozenset(
    "a an the this that these those it its he she they we you i his her their our your there here if when while once since after "
    "before until because although though as at by for from in into of on onto over to under with without within about between "
    "during despite neither either both each every any all some no not none nobody nothing one two three only and but or so yet still "
    "then thus hence however therefore moreover also what why who whom whose which where how was were is are am do does did has have had "
    "can could will would shall should may might must let please set see don't never always lazy given assume suppose state rank "
    "npm in-depth well cost approx acc cf mod ver fig sec no inc dr mr mrs ms prof version".split()
)
CJK = "⺀-⿿　-ヿㇰ-ㇿ㐀-鿿豈-﫿＀-￯"
STOPS = ".!?…。！？｡।॥؟۔;;"

# --- the alphabet and the states --------------------------------------------------------------------------------------
S, S2, TXT, QD, QS, QT, FD, FS, FT, ITEM, HEAD, FENCE, SHUT = range(13)
N = 13
BASE = [
    "doc", "doc_item", "doc_head", "doc_fence",  # a document starts
    "nl", "nl_item", "nl_strong", "nl_head", "nl_fence",  # a single line break, by what the next line is
    "bl", "bl_item", "bl_head", "bl_fence",  # a blank line
    "stop", "thai", "end",
    "d_open", "d_new", "d_say", "d_go", "d_open_new", "d_open_say", "d_open_go",  # straight double mark: may open; as a closing one, what follows
    "t_open", "t_new", "t_say", "t_go", "t_open_new", "t_open_say", "t_open_go",  # typographic marks
    "s_open", "s_new", "s_go",  # apostrophes
]
CLASS = {c: i for i, c in enumerate(BASE)}
NO, BEFORE, AFTER = 0, 1, 2


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables over (letter, with or without text before it) and state."""
    nxt, out = np.zeros((2 * len(BASE), N), np.uint8), np.zeros((2 * len(BASE), N), np.uint8)
    kinds = {"item": ITEM, "strong": ITEM, "head": HEAD, "fence": FENCE}
    opened = {"d": (QD, FD), "t": (QT, FT), "s": (QS, FS)}
    for ci, c in enumerate(BASE):
        for text in (0, 1):
            for s0 in range(N):
                s = TXT if text and s0 in (S, S2) else s0
                n, o = s, NO
                head, _, tail = c.partition("_")
                if head == "doc":
                    n = kinds.get(tail, S)
                elif c == "end":
                    n, o = S, BEFORE
                elif s == FENCE:
                    n = SHUT if c in ("nl_fence", "bl_fence") else FENCE
                elif head in ("nl", "bl") and s == SHUT:
                    n, o = kinds.get(tail, S), BEFORE
                elif s == SHUT:
                    n = SHUT
                elif head == "bl":
                    n, o = kinds.get(tail, S), BEFORE
                elif head == "nl":
                    if s in (ITEM, HEAD):
                        n, o = kinds.get(tail, S), BEFORE
                    elif tail in ("head", "fence", "strong") or tail == "item" and s == S:
                        n, o = kinds[tail], BEFORE
                elif s in (ITEM, HEAD):
                    pass
                elif c in ("stop", "thai"):
                    if s in (S, S2, TXT):
                        n, o = S2, AFTER if c == "stop" else BEFORE
                else:  # quotation marks
                    introduced, first = opened[head]
                    how = tail.rpartition("_")[2]
                    if s in (introduced, first):
                        n = TXT
                        if how == "new" or how == "say" and s == introduced:
                            n, o = S2, AFTER
                    elif s in (S, S2, TXT) and tail.startswith("open"):
                        n = introduced if s == TXT else first
                nxt[2 * ci + text, s0], out[2 * ci + text, s0] = n, o
    return nxt, out


NEXT, EMIT = _compile()

# --- from text to letters ---------------------------------------------------------------------------------------------
_BREAK = r"(?:\r\n|\n|\r)"
_PREFIX = r"[ \t]*(?:(?:[>|]+|//)(?=[ \t\r\n]|$))?[ \t]*"
EVENT = re.compile(
    rf"(?P<nl>[ \t ]*{_BREAK}(?:{_PREFIX}{_BREAK})*[ \t]*)"
    rf"|(?P<stop>[{STOPS}]+[)\]）】]*)"
    r"|(?P<q>[\"„“”«»「」『』])|(?P<s>')"
    r"|(?P<thai>(?<=[฀-๿])[  ​]+(?=[^\s0-9A-Za-z.,;:!?)]))"
)
_COUNT = re.compile(_BREAK)
_LINE = re.compile(r"(?P<fence>```|~~~)|(?P<item>(?:(?P<bullet>[-*+•‣])|\d{1,3}[.)]|[a-z]\))[ \t]+\S)|(?P<head>#{1,6}[ \t]+\S)")
_GAP = re.compile(rf"(?:[ \t ​]+|{_BREAK}{_PREFIX})*")
_LEFT = re.compile(r"[^\s\"„“”«»「」『』(\[{<>¿¡—–/`]*$")
_PAIR = re.compile(rf"(?<![^\W_])([^\W\d_]{{1,2}})\.(?:[ \t ]|{_BREAK}{_PREFIX})+$")
_INITIALS = re.compile(rf"(?:(?<![^\s(\"„“«])[^\W\d_]\.(?:[ \t ]|{_BREAK}{_PREFIX})+)+$")
_ELIDED = re.compile(r"^(?:[cdjlmnst]|qu)['’](?=\w)")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_CAMEL = re.compile(r"[A-Z]?[a-z0-9]*[A-Z][a-z0-9]+[A-Z]|[a-z]+[A-Z]")
_CALL = re.compile(r"\w+\(")
_STOPS_SET = frozenset(STOPS)
_CLOSERS = ")]）】"
_BLANK_AHEAD = re.compile(rf"{_BREAK}{_PREFIX}{_BREAK}")
_SAY = re.compile(r"[^。！？“”「」『』\r\n]{0,16}?(?:问道|说道|答道|喊道|写道|问|说|答|道)[。，：！？]")
_GO = re.compile(r"と|って|との|という|然后|并|就|便|随后|接着|而|，|、|,")
_CJK = re.compile(f"[{CJK}]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_ENDS = {'"': '"', "„": "“”", "“": "”", "«": "»", "「": "」", "『": "』"}
_PARTNERS = "".join(sorted({e for x in _ENDS.values() for e in x})) + "'"
_APOSTROPHE = re.compile(r"(?<=\S)'(?!\w)")


def _starts(text: str, i: int) -> bool:
    """Whether what stands at ``i`` looks like the start of a sentence, judged by its first word."""
    c = text[i : i + 1]
    if not c:
        return True
    if c.islower():
        w = _WORD.match(text, i)
        w = w.group() if w else ""
        return w.partition("-")[0] == "npm" or bool(_CAMEL.match(w))
    if c in "(（[":
        return _starts(text, i + 1) and text[i + 1 : i + 2] not in ("",)
    return c.isalnum() or c in "\"„“«「『'`¿¡*_‘-#@<"


# --- the rules about stops and closing marks ---------------------------------------------------------------------------
# A stop is read as a tuple of classes of what stands around it, each seen in a bounded stretch of text, and the rules
# are functions of these classes alone. They are compiled into tables over all tuples when the module is loaded, so that
# the transducer's letter for a stop is one look-up: first DOT (does a single full stop end a sentence, by the token before
# it and the word behind it), whose answer is one of the classes of STOP; likewise CLOSE for closing marks.

#: The token before a full stop; of a single letter its case, and whether an odd number of initials stands before it.
LEFT = ("none", "never", "sometimes", "before_number", "short_number", "number", "letter_upper", "letter_upper_odd", "letter_lower", "letter_lower_odd", "letter_other", "letter_other_odd", "two_upper", "word")
_L = {c: i for i, c in enumerate(LEFT)}
#: What stands behind it, as bits.
R_END, R_STARTS, R_LOWER, R_UPPER, R_DIGIT, R_MONTH, R_INITIAL, R_STARTER, R_NO_WORD, R_TWO_UPPER = (1 << i for i in range(10))


def _dot_rule(left: str, r: int) -> bool:
    """Whether a single full stop ends a sentence."""
    starts = bool(r & R_STARTS)
    if left in ("none", "sometimes"):
        return starts
    if left == "never":
        return False
    if left == "before_number":
        return not r & R_DIGIT
    if left == "short_number":  # a day before its month
        return not (r & R_UPPER and r & R_MONTH)
    if left == "two_upper":
        return not r & R_TWO_UPPER
    if left in ("number", "word"):
        return True
    upper, lower, odd = "upper" in left, "lower" in left, left.endswith("odd")
    if r & R_END:
        return True
    if r & R_INITIAL:
        return odd and upper  # names have two initials at most
    if r & R_LOWER:
        return starts and upper
    if r & R_DIGIT:
        return lower
    if r & R_NO_WORD:
        return starts
    return lower and bool(r & R_UPPER) or bool(r & R_STARTER)


DOT = [[_dot_rule(c, r) for r in range(1 << 10)] for c in LEFT]
#: What a row of DOT says whatever stands behind, else None.
ALWAYS = [row[0] if len(set(row)) == 1 else None for row in DOT]

#: Kinds of stops, and of the character right behind one.
RUN = ("semicolon", "wide", "dot", "dots", "mark")
AFTER_STOP = ("end", "comma", "sticky", "apostrophe", "quote", "digit", "numeric", "bracket", "backtick", "lower", "upper_word", "upper_more", "letter", "other")
_A = {c: i for i, c in enumerate(AFTER_STOP)}
#: More about a stop, as bits: a closing bracket belongs to it; no space follows; what it follows is a letter, digit or closing
#: mark, white space, a letter, Greek; what follows is a call or member; looks like a start; is a digit; the full stop ends a sentence.
T_CLOSED, T_JOINED, T_FIRM, T_SPACE, T_ALPHA, T_GREEK, T_MEMBER, T_STARTS, T_DIGIT, T_DOT = (1 << i for i in range(10))


def _stop_rule(run: str, after: str, t: int) -> bool:
    """Whether a stop can end a sentence."""
    if run == "semicolon":
        return bool(t & T_GREEK) and after not in ("digit", "numeric", "lower", "upper_word", "upper_more", "letter")
    if run == "wide":
        return after != "comma"
    if after in ("comma", "sticky"):
        return False
    closed = bool(t & T_CLOSED)
    if t & T_JOINED:
        if after in ("apostrophe", "quote"):
            return after == "quote" and not closed  # a mark that closes is no end by itself: its state decides
        if after in ("digit", "bracket"):
            return False
        if after == "backtick":
            return bool(t & T_ALPHA)
        if after in ("lower", "upper_more") or after == "upper_word" and run == "dot" and not closed and t & T_MEMBER:
            return False
        if after in ("upper_word", "letter") and not t & T_FIRM:
            return False
    if closed or run == "dots":
        return bool(t & T_STARTS)
    if run == "dot":
        return bool(t & T_DOT) and not (t & T_SPACE and t & T_DIGIT and t & T_JOINED)
    return True  # ? and !


STOP = [[[_stop_rule(r, c, t) for t in range(1 << 10)] for c in AFTER_STOP] for r in RUN]

#: The same for what is joined to a stop: where it never ends a sentence, whatever else holds.
NEVER_JOINED = [[not any(cell[t | T_JOINED] for t in range(1 << 10)) for cell in row] for row in STOP]

#: About a closing mark, as bits: a stop stands before it; the text ends; the sentence goes on; ideographs follow, with a verb of
#: saying; the same mark opens again; what follows looks like a start.
C_STOP, C_END, C_GO, C_WIDE, C_SAY, C_AGAIN, C_STARTS = (1 << i for i in range(7))


def _close_rule(c: int) -> str:
    """What follows a closing mark: a new sentence, words that say who spoke, or the same sentence going on."""
    if not c & C_STOP or c & (C_END | C_GO):
        return "go"
    if c & C_WIDE:
        return "say" if c & C_SAY else "new"
    return "new" if c & C_STARTS and not c & C_AGAIN else "go"


CLOSE = [_close_rule(c) for c in range(1 << 7)]

_WIDE_STOPS = "。！？｡।॥۔؟\u037e"
_STICKY = frozenset(";:-/\\=&%@_*~|+>،؛")
_QUOTES = frozenset("\"„“”«»「」『』")
_TWO_UPPER = re.compile(r"[A-Z]{2}\.")


def _after(text: str, i: int) -> str:
    """The class of the character at ``i``."""
    c = text[i : i + 1]
    if not c:
        return "end"
    if c in ",，、":
        return "comma"
    if c in _STICKY:
        return "sticky"
    if c in "'’":
        return "apostrophe"
    if c in _QUOTES:
        return "quote"
    if c.isdigit():
        return "digit"
    if c in ")]}）】":
        return "bracket"
    if c == "`":
        return "backtick"
    if c.isalpha():
        if c.islower():
            return "lower"
        if not c.isupper():
            return "letter"
        two = text[i + 1 : i + 2]
        return "upper_word" if not two or two.islower() or two.isspace() or two in "'’" else "upper_more"
    return "numeric" if c.isalnum() else "other"


@functools.lru_cache(maxsize=1 << 16)
def _token(left: str) -> tuple[int, str]:
    """The class of a token by itself, and the token in lower case without what clings to it."""
    tok = _ELIDED.sub("", left.lower().lstrip("'*_#"))
    for words, name in ((("",), "none"), (BEFORE_NUMBER, "before_number"), (NEVER, "never"), (SOMETIMES, "sometimes")):
        if tok in words:
            return _L[name], tok
    if tok.isdigit():
        return _L["short_number" if len(tok) <= 2 else "number"], tok
    if len(tok) == 1 and tok.isalpha() and not _CJK.match(tok):
        return _L["letter_upper" if left.isupper() else "letter_lower" if left.islower() else "letter_other"], tok
    return _L["two_upper" if len(tok) == 2 and left.isupper() else "word"], tok


def _left(text: str, start: int) -> tuple[int, str]:
    """The class of the token before the full stop at ``start``, and the token."""
    left = _LEFT.search(text, max(0, start - 40), start).group()
    cls, tok = _token(left)
    if not tok or len(tok) > 2:
        return cls, left
    pair = _PAIR.search(text, max(0, start - len(left) - 8), start - len(left))
    if pair:
        both = f"{pair.group(1)}. {tok}".lower()
        if both in NEVER_PAIR or both in SOMETIMES_PAIR:
            return _L["never" if both in NEVER_PAIR else "sometimes"], left
    if LEFT[cls].startswith("letter"):
        chain = _INITIALS.search(text, max(0, start - len(left) - 24), start - len(left))
        if chain and chain.group().count(".") % 2 == 1:
            return cls + 1, left
    return cls, left


def _right(text: str, nxt: int) -> int:
    """The bits of what stands at ``nxt``."""
    c = text[nxt : nxt + 1]
    if not c:
        return R_END | R_STARTS | R_NO_WORD
    w = _WORD.match(text, nxt)
    word = w.group() if w else ""
    low = word.lower()
    r = R_STARTS if _starts(text, nxt) else 0
    r |= (R_LOWER if c.islower() else 0) | (R_UPPER if c.isupper() else 0) | (R_DIGIT if c.isdigit() else 0) | (0 if word else R_NO_WORD)
    r |= (R_MONTH if low in MONTHS else 0) | (R_INITIAL if len(word) == 1 and text[nxt + 1 : nxt + 2] == "." else 0)
    r |= (R_STARTER if low in STARTERS or _CAMEL.match(word) else 0) | (R_TWO_UPPER if _TWO_UPPER.match(text, nxt, nxt + 3) else 0)
    return r


def _stop(text: str, m: re.Match) -> bool:
    """Whether the stop ``m`` can end a sentence: its classes, looked up; those that its rule doesn't ask for aren't seen."""
    start, end = m.span()
    run = m.group()
    prev = text[start - 1 : start]
    after = _after(text, end)
    t = 0
    if run == ".":
        row = 2
    else:
        bare = run.rstrip(_CLOSERS)
        t = T_CLOSED if len(bare) < len(run) else 0
        row = 0 if set(bare) == {";"} else 1 if bare[0] in _WIDE_STOPS or "…" in bare or bare[-1] in _WIDE_STOPS else 2 if bare == "." else 3 if set(bare) == {"."} else 4
    if row < 2:
        return STOP[row][_A[after]][T_GREEK if row == 0 and _GREEK.match(prev) else 0]
    if after in ("comma", "sticky"):
        return False
    nxt = _GAP.match(text, end).end()
    if nxt == end and after != "end":
        if NEVER_JOINED[row][_A[after]]:
            return False
        t |= T_JOINED | (T_FIRM if prev.isalnum() or prev in _CLOSERS + "\"”»`'% \u00a0" else 0) | (T_ALPHA if prev.isalpha() else 0)
    if row == 2 and not t & T_CLOSED:
        cls, left = _left(text, start)
        dot = ALWAYS[cls]
        if dot is None:
            dot = DOT[cls][_right(text, nxt)]
        if after == "upper_word" and t & T_JOINED and (_CALL.match(text, end) or left[:1].isupper() and len(left) > 1 and left[1:2].islower() and not prev.isdigit() and _CAMEL.match(_WORD.match(text, end).group())):
            t |= T_MEMBER
        t |= (T_DOT if dot else 0) | (T_SPACE if prev.isspace() else 0) | (T_DIGIT if text[nxt : nxt + 1].isdigit() else 0)
    elif t & T_CLOSED or row == 3:
        t |= T_STARTS if _starts(text, nxt) else 0
    return STOP[row][_A[after]][t]


def _closing(text: str, start: int, end: int) -> str:
    """What follows the mark at ``start``, if it closes."""
    i = start - 1
    while i >= 0 and (text[i].isspace() or text[i] in _CLOSERS):
        i -= 1
    if i < 0 or text[i] not in _STOPS_SET:
        return CLOSE[0]
    nxt = _GAP.match(text, end).end()
    c = text[nxt : nxt + 1]
    bits = C_STOP | (0 if c else C_END) | (C_GO if _GO.match(text, nxt) else 0)
    if c and _CJK.match(c):
        bits |= C_WIDE | (C_SAY if _SAY.match(text, nxt) else 0)
    elif c:
        bits |= (C_AGAIN if c in "\"„“«「『" and nxt == end and text[end - 1] == c else 0) | (C_STARTS if _starts(text, nxt) else 0)
    return CLOSE[bits]


def letters(text: str, lo: int, hi: int, begins: bool, ends: bool, beyond: str = "") -> tuple[list[int], list[int], list[int]]:
    """Letters of ``text[lo:hi]`` with the places a sentence would end at if it did before or after the event."""
    cls, before, after = [], [], []
    last = lo

    def add(name: str, start: int, end: int) -> None:
        nonlocal last
        between = text[last:start]
        cls.append(2 * CLASS[name] + (1 if between and not between.isspace() else 0))
        before.append(start)
        after.append(end)
        last = end

    def line(at: int, kind: str, start: int) -> str:
        k = _LINE.match(text, at)
        if not k:
            return kind
        if k["fence"]:
            return kind + "_fence"
        if k["head"]:
            return kind + "_head"
        if kind == "nl" and k["bullet"] and text[start - 1 : start] in (":", ".", "!", "?"):
            return "nl_strong"
        return kind + "_item"

    ahead = Ahead(text)

    def partner(mark: str, at: int) -> bool:
        """Whether ``mark`` closes before the next blank line."""
        blank = ahead.blank(at)
        return ahead.closes(mark, at) < blank or blank == len(text) and mark in beyond

    if begins:
        at = lo + (len(text) - lo - len(text[lo:].lstrip(" \t\r\n​﻿")))
        add(line(at, "doc", at), lo, lo)
    for m in EVENT.finditer(text, lo):
        start, end = m.span()
        if start >= hi:
            break
        kind = m.lastgroup
        if kind == "nl":
            add(line(end, "bl" if len(_COUNT.findall(m.group())) > 1 else "nl", start), start, end)
        elif kind == "stop":
            if _stop(text, m):
                add("stop", start, end)
        elif kind == "thai":
            add("thai", start, end)
        elif kind == "q":
            c = m.group()
            how = _closing(text, start, end)
            opens = False
            if c in _ENDS:
                if end < len(text) and (not text[end].isspace() or text[end] == " " or c == "«"):
                    opens = any(partner(e, end) for e in _ENDS[c])
            head = "d" if c == '"' else "t"
            add(f"{head}_open_{how}" if opens else f"{head}_{how}", start, end)
        else:
            prev, follow = text[start - 1 : start], text[end : end + 1]
            if (not prev or prev.isspace() or prev in "([") and follow.isalnum():
                if partner("'", end):
                    add("s_open", start, end)
            elif prev and not prev.isspace() and not follow.isalnum():
                how = _closing(text, start, end)
                add("s_new" if how == "new" else "s_go", start, end)
    if ends:
        add("end", hi, hi)
    return cls, before, after


def scan(cls: np.ndarray) -> np.ndarray:
    """Prefix compositions of the letters' functions: row i maps the state before the first letter to that after letter i."""
    f = NEXT[cls].copy()
    step = 1
    while step < len(f):
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), axis=1)
        step *= 2
    return f


def _emit(text: str, cls: np.ndarray, entered: np.ndarray, before: list[int], after: list[int]) -> list[int]:
    """Sentence ends (offsets into ``text``) given the state before each letter."""
    ends: list[int] = []
    last = -1
    how = EMIT[cls, entered]
    for k in np.flatnonzero(how):
        e = after[k] if how[k] == AFTER else before[k]
        e = len(text[max(last, 0) : e].rstrip(" \t\r\n 　  \x0b\x0c​")) + max(last, 0) if how[k] == BEFORE else e
        if e > last and (last >= 0 or text[:e].strip()) and text[max(last, 0) : e].strip():
            ends.append(e)
            last = e
    return ends


def batch_ends(texts: list[str]) -> list[list[int]]:
    """Sentence ends of whole texts, by one scan over all of them."""
    parts = [letters(t, 0, len(t), True, True) for t in texts]
    if not parts:
        return []
    cls = np.array([c for p in parts for c in p[0]], np.intp)
    state = scan(cls)[:, S]
    entered = np.concatenate([[S], state[:-1]])
    ends, at = [], 0
    for t, (c, b, a) in zip(texts, parts, strict=True):
        k = at + len(c)
        ends.append(_emit(t, cls[at:k], entered[at:k], b, a))
        at = k
    return ends


class Ahead:
    """The next blank line and the next closing marks of a text, for places that only go forward."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, {}

    def _next(self, what: str, at: int, find) -> int:
        if self.at.get(what, -1) < at:
            self.at[what] = find()
        return self.at[what]

    def blank(self, at: int) -> int:
        """Where the next blank line begins, else the end of the text."""
        return self._next("blank", at, lambda: m.start() if (m := _BLANK_AHEAD.search(self.text, at)) else len(self.text))

    def closes(self, mark: str, at: int) -> int:
        """Where ``mark`` closes a quotation next, else the end of the text."""
        if mark == "'":
            return self._next(mark, at + 1, lambda: m.start() if (m := _APOSTROPHE.search(self.text, at + 1)) else len(self.text))
        return self._next(mark, at, lambda: p if (p := self.text.find(mark, at)) >= 0 else len(self.text))


def chunks(text: str, size: int = CHUNK) -> list[tuple[int, int]]:
    """Where a long text is cut: after the last line break, else the last blank, in each ``size`` code points."""
    cuts, lo = [], 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        if hi < len(text):
            cut = max(text.rfind("\n", lo + 1, hi) + 1, 0)
            if cut <= lo:
                cut = text.rfind(" ", lo + 1, hi) + 1
            hi = cut if cut > lo else hi
        cuts.append((lo, hi))
        lo = hi
    return cuts


def _chunk_letters(pdf: pd.DataFrame) -> Iterator[tuple]:
    for row in pdf.to_dict("records"):
        yield row, letters(row["_text"], row["_lo"], row["_hi"], row["_begins"], row["_ends"], row["_beyond"])


def entries(functions: DataFrame) -> DataFrame:
    """``(_id, _no, _enter)``: the state before each chunk, from the chunks' functions ``(_id, _no, _f)``.

    A prefix scan in a tree: the functions of :data:`FAN` neighbouring chunks are composed into one, those of a document's
    blocks give the state before each block, and within the blocks the states are followed chunk by chunk. A string
    holds 2 GB at most, so a document has some 16,000 chunks and 128 blocks at most, and no row holds more than 128
    functions of 13 numbers.
    """

    def follow(fs: str, f: str, start) -> Column:
        return F.aggregate(fs, F.array(start), lambda acc, x: F.concat(acc, F.array(x[f][F.element_at(acc, -1)])))

    blocks = functions.withColumn("_b", F.floor(F.col("_no") / FAN).cast("int")).groupBy("_id", "_b").agg(F.array_sort(F.collect_set(F.struct("_no", "_f"))).alias("_fs"))
    composed = F.aggregate("_fs", F.sequence(F.lit(0), F.lit(N - 1)), lambda acc, x: F.transform(acc, lambda s: x["_f"][s]))
    tops = blocks.select("_id", "_b", composed.alias("_g")).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_b", "_g"))).alias("_gs"))
    starts = tops.select("_id", F.posexplode(follow("_gs", "_g", F.lit(S))).alias("_b", "_start"))
    inner = blocks.join(starts, ["_id", "_b"]).select("_id", "_b", F.posexplode(follow("_fs", "_f", F.col("_start"))).alias("_k", "_enter"), F.size("_fs").alias("_size"))
    return inner.where("_k < _size").select("_id", (F.col("_b") * FAN + F.col("_k")).cast("int").alias("_no"), "_enter")


def sentence_ends(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per sentence: ``(id, end_char)``, the number of code points up to and including its last character.

    Null, empty and blank texts have no sentence. Repeated rows give the rows of one of them. Other columns are ignored.
    The text is read whole whatever its length; nothing but the text decides (a language column isn't looked at).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null and _text <> ''")

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                ends = batch_ends(part["_text"].tolist())
                yield pd.DataFrame({"_id": np.repeat(part["_id"].to_numpy(), [len(e) for e in ends]), "_end": np.array([x for e in ends for x in e], np.int64)})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, text in zip(pdf["_id"], pdf["_text"], strict=True):
                ahead = Ahead(text)
                for no, (lo, hi) in enumerate(pieces := chunks(text, chunk)):
                    base, top = max(0, lo - CONTEXT), min(len(text), hi + CONTEXT)
                    while top < len(text) and text[top - 1] == "'":  # what follows it tells whether it closes
                        top += 1
                    # the marks that close behind the context, before the next blank line
                    blank = ahead.blank(hi)
                    beyond = "".join(e for e in _PARTNERS if ahead.closes(e, top - (e == "'")) < blank)
                    yield pd.DataFrame(
                        {"_id": [i], "_no": [no], "_base": [base], "_lo": [lo - base], "_hi": [hi - base], "_begins": [no == 0], "_ends": [no == len(pieces) - 1], "_text": [text[base:top]], "_beyond": [beyond]}
                    )

    def function(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, (cls, _, _) in _chunk_letters(pdf):
                f = scan(np.array(cls, np.intp))[-1] if cls else np.arange(N)
                yield pd.DataFrame({"_id": [row["_id"]], "_no": [row["_no"]], "_f": [[int(x) for x in f]]})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, (cls, before, after) in _chunk_letters(pdf):
                c = np.array(cls, np.intp)
                state = scan(c)[:, row["_enter"]] if cls else np.array([], np.intp)
                ends = _emit(row["_text"], c, np.concatenate([[row["_enter"]], state[:-1]]).astype(np.intp)[: len(c)], before, after)
                yield pd.DataFrame({"_id": [row["_id"]] * len(ends), "_end": np.array(ends, np.int64) + row["_base"]})

    whole = df.where(F.length("_text") <= chunk).mapInPandas(short, f"_id {id_type}, _end bigint")
    cuts = df.where(F.length("_text") > chunk).mapInPandas(cut, f"_id {id_type}, _no int, _base bigint, _lo bigint, _hi bigint, _begins boolean, _ends boolean, _text string, _beyond string")
    cuts = cuts.repartition("_id", "_no")
    functions = cuts.mapInPandas(function, f"_id {id_type}, _no int, _f array<int>")
    entered = entries(functions)
    long = cuts.join(entered, ["_id", "_no"]).mapInPandas(emit, f"_id {id_type}, _end bigint")
    return whole.unionByName(long).select(F.col("_id").alias(id_col), F.col("_end").alias("end_char")).distinct()
