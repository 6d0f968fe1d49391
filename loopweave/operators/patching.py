"""Reading change proposals out of answers, applying them, and telling what changed.

Answers come in several layouts: JSON with whole files or search/replace pairs, search/replace blocks under file
headers, line ranges, and a plain keyword format. Each reader yields the same rows. Readers and appliers are functions
of one row, run over Arrow batches; nothing here needs more than its own row.
"""

from __future__ import annotations

import difflib
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENDINGS

_FENCE = re.compile(r"\A\s*```[\w+-]*[ \t]*\r?\n(.*?)(?:\r?\n)?```\s*\Z", re.S)
_JSON_FENCE = re.compile(r"```(?:json)?[ \t]*\r?\n(.*?)```", re.S)
_FILE_HEAD = re.compile(r"^---[ \t]*FILE:[ \t]*(.+?)[ \t]*---[ \t]*\r?$", re.M)
_BLOCK = re.compile(r"<{7} SEARCH\r?\n(.*?)(?:\r?\n)?={7}\r?\n(.*?)(?:\r?\n)?>{7} REPLACE", re.S)
_STRATEGY = re.compile(r"^[ \t]*STRATEGY[ \t]*[:=-][ \t]*(.+?)[ \t]*$", re.M | re.I)
_SECTION = re.compile(r"^[ \t]*(NEW_FILE|FILE|MODIFY)[ \t]*[:=-][ \t]*(.+?)[ \t]*$", re.M | re.I)
_LINES = re.compile(r"^[ \t]*LINES?[ \t]*[:=-]?[ \t]*(\d+)(?:[ \t]*(?:-|–|to)[ \t]*(\d+))?[ \t]*:?[ \t]*$", re.M | re.I)


def _with_next(matches: list[re.Match]) -> Iterator[tuple[re.Match, re.Match | None]]:
    for k, m in enumerate(matches):
        yield m, matches[k + 1] if k + 1 < len(matches) else None


def unfence(text: str) -> str:
    """``text`` without a code fence around all of it."""
    m = _FENCE.match(text)
    return m[1] if m else text


def json_payload(text: str):
    """The JSON value that an answer carries: the whole of it, a fenced part, or the outermost braces; None without one."""
    tries = [text.strip(), *(m.strip() for m in _JSON_FENCE.findall(text))]
    a, b = text.find("{"), text.rfind("}")
    if 0 <= a < b:
        tries.append(text[a : b + 1])
    for t in tries:
        try:
            v = json.loads(t, strict=False)
        except (ValueError, RecursionError):
            continue
        if isinstance(v, dict | list):
            return v
    return None


def read_changes(text: str | None) -> list[tuple[str, str, str | None, str | None, int | None, int | None]]:
    """``(path, kind, search, replace, first, last)`` of an answer, in its order: kind is ``whole``, ``replace``, ``lines``
    or ``new``. An answer that holds none gives an empty list; entries without a path are skipped."""
    if not text or not text.strip():
        return []
    out: list[tuple] = []
    data = json_payload(text)
    if isinstance(data, dict):
        for entry in [*(data.get("patches") or []), *(data.get("changes") or [])]:
            if not isinstance(entry, dict) or not isinstance(entry.get("path"), str) or not entry["path"]:
                continue
            p = entry["path"]
            if isinstance(entry.get("patched"), str):
                out.append((p, "whole", None, unfence(entry["patched"]), None, None))
            for side in ("prepend", "append"):
                if isinstance(entry.get(side), str) and entry[side]:
                    out.append((p, side, None, entry[side], None, None))
            for sr in entry.get("search_replace") or []:
                if isinstance(sr, dict) and isinstance(sr.get("search"), str):
                    out.append((p, "replace", sr["search"], str(sr.get("replace") or ""), None, None))
            for c in entry.get("changes") or []:
                if isinstance(c, dict) and isinstance(c.get("lines"), list) and c["lines"] and all(isinstance(x, int) for x in c["lines"]):
                    new = c.get("new_content")
                    out.append((p, "lines", None, "\n".join(map(str, new)) if isinstance(new, list) else str(new or ""), c["lines"][0], c["lines"][-1]))
        for entry in data.get("new_files") or []:
            if isinstance(entry, dict) and isinstance(entry.get("path"), str) and isinstance(entry.get("content"), str):
                out.append((entry["path"], "new", None, unfence(entry["content"]), None, None))
    if out:
        return out
    heads = list(_FILE_HEAD.finditer(text))
    for m, nxt in _with_next(heads):
        body = text[m.end() : nxt.start() if nxt else len(text)]
        blocks = _BLOCK.findall(body)
        if blocks:
            out += [(m[1], "replace", a, b, None, None) for a, b in blocks]
        elif body.strip() and "<<<<<<<" not in body:
            out.append((m[1], "whole", None, unfence(body.strip("\r\n")), None, None))
    return out or plain_changes(text) or block_changes(text) or lenient_changes(text)


_DASH = r"[ \t]*(?:[-–—]|to)+[ \t]*"
_RULE = r"^---[ \t]*$\s*"
_CHANGE = re.compile(rf"^FILE:[ \t]*(.+?)[ \t]*$\s*^CHANGE:[ \t]*(?:lines?[ \t]*)?(\d+){_DASH}(\d+)[ \t]*$\s*{_RULE}(.*?)^---[ \t]*$", re.M | re.S | re.I)
_CHANGE_IN_HEAD = re.compile(rf"^FILE:[ \t]*(.+?)[ \t]*\((?:lines?[ \t]*)?(\d+){_DASH}(\d+)\)[ \t]*$\s*{_RULE}(.*?)^---[ \t]*$", re.M | re.S | re.I)
_NEW_FILE = re.compile(rf"^NEW_FILE:[ \t]*(.+?)[ \t]*$\s*{_RULE}(.*?)^---[ \t]*$", re.M | re.S | re.I)
_FENCED_FILE = re.compile(r"```\w*\s*\n(?://|#|/\*)\s*FILE:\s*(.+?)\s*(?:\*/)?\s*\n(.*?)```", re.S | re.I)
_BEGIN_END = re.compile(r"NEW_FILE:[ \t]*(.+?)\n---BEGIN---\n(.*?)\n---END---", re.S | re.I)
_MODIFY = re.compile(r"^MODIFY:[ \t]*(.*)$", re.M | re.I)
_USING = re.compile(r"^ADD_USING:[ \t]*(.+)$", re.M | re.I)
_PAIR = re.compile(r"SEARCH:\n(.*?)\nREPLACE:\n(.*?)(?=\n(?:SEARCH|ADD_USING|REMOVE_USING|CYCLE_BROKEN|MODIFY):|\Z)", re.S | re.I)


def plain_changes(text: str) -> list[tuple]:
    """The first plain format: ``FILE`` and ``CHANGE`` (or the lines behind the file's name) over a body between ``---``, and
    ``NEW_FILE``; else code fences that begin with a ``FILE`` comment."""
    out = [(m[1], "lines", None, m[4].strip(), int(m[2]), int(m[3])) for m in _CHANGE.finditer(text)]
    out += [(m[1], "new", None, m[2].strip(), None, None) for m in _NEW_FILE.finditer(text)]
    if not out:
        out = [(m[1], "lines", None, m[4].strip(), int(m[2]), int(m[3])) for m in _CHANGE_IN_HEAD.finditer(text)]
        out += [(m[1], "new", None, m[2].strip(), None, None) for m in _FENCED_FILE.finditer(text) if any(w in m[2] for w in ("export ", "import ", "class "))]
    if out or not _STRATEGY.search(text):
        return out
    parts = list(_SECTION.finditer(text))
    for m, nxt in _with_next(parts):
        body = text[m.end() : nxt.start() if nxt else len(text)].strip("\r\n")
        if "---BEGIN---" in body or _PAIR.search(body) or _USING.search(body):
            return []
        spans = list(_LINES.finditer(body))
        if m[1].upper() == "NEW_FILE":
            out.append((m[2], "new", None, unfence(body), None, None))
        for s, after in _with_next(spans):
            out.append((m[2], "lines", None, unfence(body[s.end() : after.start() if after else len(body)].strip("\r\n")), int(s[1]), int(s[2] or s[1])))
    return out


def block_changes(text: str) -> list[tuple]:
    """The second plain format: ``NEW_FILE`` between ``---BEGIN---`` and ``---END---``, and ``MODIFY`` with ``ADD_USING`` and
    ``SEARCH``/``REPLACE``; what is added stands before the file (kind ``prepend``)."""
    t = re.sub(r"^```\w*\n|\n```$", "", text, flags=re.M).replace("```", "").strip()
    out = [(m[1].strip(), "new", None, m[2].strip(), None, None) for m in _BEGIN_END.finditer(t) if m[2].strip()]
    heads = [m for m in _MODIFY.finditer(t) if m[1].strip()]
    for m, nxt in _with_next(heads):
        body = t[m.end() : nxt.start() if nxt else len(t)]
        use = [x.strip() for x in _USING.findall(body) if x.strip()]
        if use:
            out.append((m[1].strip(), "prepend", None, "\n".join(use), None, None))
        out += [(m[1].strip(), "replace", a.strip(), b.strip(), None, None) for a, b in _PAIR.findall(body) if a.strip()]
    return out


_PATH = re.compile(r'"path"\s*:\s*"([^"]+)"')
_PATCHED = re.compile(r'"patched"\s*:\s*"')
_STRING_END = re.compile(r'((?:[^"\\]|\\.)*)(?:"|\Z)', re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CODE = re.compile(r"```(?:csharp|cs|python|java|javascript|typescript)?\n(.*?)```", re.S)


def lenient_changes(text: str) -> list[tuple]:
    """Whole files out of JSON that can't be read: behind each ``"path"``, up to the next, the ``"patched"`` string, cut off or
    not; else the first code fence."""
    out = []
    for m, nxt in _with_next(list(_PATH.finditer(text))):
        part = text[m.end() : nxt.start() if nxt else len(text)]
        p = _PATCHED.search(part)
        if p:
            body = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), _STRING_END.match(part, p.end())[1], flags=re.S)
            if body:
                out.append((m[1], "whole", None, unfence(body), None, None))
        elif code := _CODE.search(part):
            out.append((m[1], "whole", None, code[1].strip(), None, None))
    return out


CHANGES = "pos int, path string, kind string, search string, replace string, first int, last int"


def changes(answers: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """One row per change that an answer proposes: the id columns and :data:`CHANGES`."""
    types = ", ".join(f"{c} {answers.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                rows += [(*row[:-1], n, *c) for n, c in enumerate(read_changes(row[-1]))]
            df = pd.DataFrame(rows, columns=[*id_cols, "pos", "path", "kind", "search", "replace", "first", "last"])
            yield df.astype({"first": "Int32", "last": "Int32"})

    return answers.select(*id_cols, text_col).where(F.col(text_col).isNotNull()).mapInPandas(run, f"{types}, {CHANGES}")


def locate(search: str, lines: list[str], hint: int | None = None) -> tuple[int, int, str, float]:
    """``(start, end, how, confidence)`` of the lines that ``search`` means; ``(-1, -1, "none", 0.0)`` without a good match.

    * The same lines, trailing blanks aside: 1.0 where they stand once, else 0.95 nearest to the hint, 0.7 the first.
    * Anchors: the same first and last line (of two lines and more), half to twice as long, alike enough as a whole: 0.4 to 0.8.
    * Windows of as many lines, line by line alike: up to 0.85 where all lines are nearly the same, else 0.4 to 0.65.
    """
    want = [x.rstrip() for x in search.split("\n")]
    have = [x.rstrip() for x in lines]
    n = len(want)
    at = [i for i in range(len(have) - n + 1) if have[i] == want[0] and have[i : i + n] == want]
    if len(at) == 1:
        return at[0], at[0] + n, "exact", 1.0
    if at and hint is not None:
        i = min(at, key=lambda x: abs(x - hint))
        return i, i + n, "exact_with_hint", 0.95
    if at:
        return at[0], at[0] + n, "exact_first", 0.7
    return _by_anchors(search, want, lines, hint) or _by_lines(want, have, hint) or (-1, -1, "none", 0.0)


def _nearness(i: int, hint: int | None, most: float, reach: int) -> float:
    return 0.0 if hint is None else max(0.0, most - abs(i - hint) / reach * most)


def _by_anchors(search: str, want: list[str], lines: list[str], hint: int | None) -> tuple[int, int, str, float] | None:
    full = [x.strip() for x in want if x.strip()]
    if len(full) < 2:
        return None
    bare = [x.strip() for x in lines]
    ends: list[int | None] = [None] * len(bare)  # the next line that is the last anchor
    nxt = None
    for i in range(len(bare) - 1, -1, -1):
        ends[i] = nxt
        if bare[i] == full[-1]:
            nxt = i
    best = None
    for i, x in enumerate(bare):
        if x != full[0] or ends[i] is None:
            continue
        end = ends[i] + 1
        ratio = (end - i) / len(want)
        if not 0.5 <= ratio <= 2.0:
            continue
        alike = difflib.SequenceMatcher(None, search.strip(), "\n".join(lines[i:end]).strip()).ratio()
        base = alike * 0.7 + (1.0 - abs(1.0 - ratio) * 0.3) * 0.3
        score = base + _nearness(i, hint, 0.1, 100)
        if best is None or score > best[0]:
            best = (score, base, i, end)
    if best and best[1] >= 0.5:
        return best[2], best[3], "anchor", min(0.8, 0.4 + (best[1] - 0.5) * 0.8)
    return None


#: From this score on a window of similar lines is a match; average and least likeness of lines that are nearly the same.
SIMILAR, NEARLY = 0.75, (0.95, 0.90)


def _by_lines(want: list[str], have: list[str], hint: int | None) -> tuple[int, int, str, float] | None:
    n = len(want)
    goal = [x.strip() for x in want]
    bare = [x.strip() for x in have]
    matchers = [difflib.SequenceMatcher(None, g, "") for g in goal]
    known: dict[tuple[int, str], tuple[float, bool]] = {}  # a line's likeness, or a bound of it

    def likeness(k: int, line: str, exact: bool) -> float:
        if goal[k] == line:
            return 1.0
        got = known.get((k, line))
        if got is None or exact and not got[1]:
            m = matchers[k]
            m.set_seq2(line)
            got = known[k, line] = (m.ratio(), True) if exact else (m.real_quick_ratio(), False)
        return got[0]

    best = None
    for i in range(len(bare) - n + 1):
        near = _nearness(i, hint, 0.05, 200)
        # the lengths alone bound a window's score; most windows end here
        bounds = [likeness(k, bare[i + k], False) for k in range(n)]
        if sum(bounds) / n * 0.7 + min(bounds) * 0.3 + near < max(SIMILAR, best[0] if best else 0.0):
            continue
        scores = [likeness(k, bare[i + k], True) for k in range(n)]
        mean, least = sum(scores) / n, min(scores)
        score = mean * 0.7 + least * 0.3 + near
        if best is None or score > best[0]:
            best = (score, mean, least, i)
    if not best or best[0] < SIMILAR:
        return None
    score, mean, least, i = best
    if mean >= NEARLY[0] and least >= NEARLY[1]:
        return i, i + n, "fuzzy_high_sim", min(0.85, 0.75 + (mean - 0.95) * 2.0)
    return i, i + n, "fuzzy", min(0.65, max(0.4, 0.4 + score - SIMILAR))


# fixed values: how a search text names the line it stands at
_HINTS = tuple(re.compile(x, re.I) for x in (r"(?://|#)\s*(?:line|near line|around line)\s*(\d+)", r"\(line\s*(\d+)\)", r"line\s*(\d+)\s*(?:$|:)"))


def line_hint(text: str) -> int | None:
    """The line, from 0, that a text names."""
    for h in _HINTS:
        m = h.search(text)
        if m:
            return int(m[1]) - 1
    return None


def looks_cut(text: str) -> bool:
    """Whether a replacement looks cut: over two braces open, an ending that leaves something out, or a comma at its end."""
    s = text.rstrip()
    if len(s) < 10:
        return False
    return s.count("{") - s.count("}") > 2 or s.lower().endswith(ENDINGS) or s.endswith(",") and not re.search(r"[\])}]", s.rsplit("\n", 1)[-1])


def common_indent(lines: list[str]) -> int:
    """The least white space before a line that isn't blank."""
    return min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)


def margin(lines: list[str]) -> str:
    """The white space that the least indented line begins with."""
    full = [x for x in lines if x.strip()]
    least = min(full, key=lambda x: len(x) - len(x.lstrip()), default="")
    return least[: len(least) - len(least.lstrip())]


def apply_replacements(original: str, blocks: list[tuple[str, str]], least: float = 0.7, warn: float = 0.85, allow_low: bool = False) -> tuple[str, float, int, str]:
    """All of ``blocks`` or none: ``(text, mean confidence, applied, notes)``.

    Places are found in the original; a block that looks cut, that has no place or (unless ``allow_low``) one less sure than
    ``least``, or two that overlap, leave it as it is. Below ``warn`` a place is noted. A replacement without indentation
    takes that of the lines it replaces.
    """
    text = original.replace("\r\n", "\n").replace("\r", "\n")
    if not blocks:
        return text, 0.0, 0, "no blocks"
    lines = text.split("\n")
    found, notes, fails = [], [], False
    for k, (search, replace) in enumerate(blocks, 1):
        search, replace = (x.replace("\r\n", "\n").replace("\r", "\n") for x in (search, replace))
        if looks_cut(replace):
            notes.append(f"{k} looks cut")
            fails = True
            continue
        a, b, _, sure = locate(search, lines, line_hint(search))
        if a < 0:
            notes.append(f"{k} not found")
            fails = True
            continue
        if sure < warn:
            notes.append(f"{k} unsure" if sure < least else f"{k} marginal")
        if sure < least and not allow_low:
            fails = True
            continue
        new = replace.split("\n")
        indent = margin(lines[a:b])
        if indent and not margin(new):
            new = [indent + x if x.strip() else x for x in new]
        found.append((a, b, new, sure))
    found.sort(key=lambda x: x[:2])
    if any(x[1] > y[0] for x, y in zip(found, found[1:], strict=False)):
        notes.append("overlap")
        fails = True
    if fails:
        return text, 0.0, 0, "; ".join(notes)
    for a, b, new, _ in reversed(found):
        lines[a:b] = new
    return "\n".join(lines), sum(x[3] for x in found) / len(blocks), len(found), "; ".join(notes)


def brackets_sound(text: str, original: str | None = None) -> bool:
    """Whether a text's brackets balance, or at least no worse than its original's."""
    def off(t: str) -> list[int]:
        return [abs(t.count(a) - t.count(b)) for a, b in ("{}", "()", "[]")]

    return all(n == 0 or original is not None and n <= o for n, o in zip(off(text), off(original or ""), strict=True))


def apply_with_rollback(original: str, blocks: list[tuple[str, str]], check=brackets_sound, **options) -> tuple[str, float, int, str]:
    """:func:`apply_replacements`, and where its result doesn't pass ``check(text, original)``, the most blocks that do when one
    or two of them are left out; without such a set, all of them, noted."""
    full = apply_replacements(original, blocks, **options)
    if not full[2] or check(full[0], original):
        return full
    if len(blocks) < 2:
        return *full[:3], "; ".join(filter(None, [full[3], "not sound"]))
    for out in (1, 2):
        best = None
        for skip in itertools.combinations(range(len(blocks)), out):
            kept = [x for k, x in enumerate(blocks) if k not in skip]
            got = apply_replacements(original, kept, **options) if kept else None
            if got and got[2] and check(got[0], original) and (best is None or got[2] > best[2]):
                best = (*got[:3], "; ".join(filter(None, [got[3], "left out " + ", ".join(str(k + 1) for k in skip)])))
        if best:
            return best
        if len(blocks) < 3:
            break
    return *full[:3], "; ".join(filter(None, [full[3], "not sound"]))


def from_lines(path: str, changes: list[tuple[int, int, str]], content: str | None) -> list[tuple[str, str]]:
    """Line ranges (from 1, both ends in) as search and replace pairs; nothing without content."""
    lines = (content or "").splitlines()
    return [("\n".join(lines[max(0, a - 1) : min(len(lines), b)]), new) for a, b, new in changes] if content else []


def per_file(changes: list[tuple]) -> dict[str, dict]:
    """Changes as :func:`read_changes` gives them, by file: ``lines`` and ``replace`` lists, or the ``content`` of a new file."""
    out: dict[str, dict] = {}
    for path, kind, search, replace, first, last in changes:
        if kind in ("new", "whole"):
            out[path] = {"is_new": kind == "new", "content": replace}
        else:
            entry = out.setdefault(path, {"lines": [], "replace": []})
            entry.setdefault(kind, []).append((first, last, replace) if kind == "lines" else (search, replace))
    return out


def apply_lines(original: str, spans: list[tuple[int, int, str]]) -> tuple[str, int]:
    """Line ranges (from 1, both ends in) replaced from the bottom up; ranges that begin past the end are skipped."""
    lines = original.split("\n")
    n = 0
    for first, last, new in sorted(spans, reverse=True):
        first = max(1, first)
        if first > len(lines) or last < first:
            continue
        lines[first - 1 : min(last, len(lines))] = new.split("\n") if new else []
        n += 1
    return "\n".join(lines), n


# fixed values: openings before which an appended text gets a blank line
OPENINGS = ("public ", "internal ", "private ", "namespace ", "using ", "class ", "interface ")


def with_ends(original: str, side: str, texts: list[str]) -> str:
    """``texts`` put before or behind ``original``, on lines of their own; a declaration behind it is set off by a blank line."""
    out = original.replace("\r\n", "\n").replace("\r", "\n")
    for t in texts:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
        if side == "prepend":
            out = t + ("\n" if out and not t.endswith("\n") else "") + out
            continue
        if out and not out.endswith("\n"):
            out += "\n"
        if t.lstrip().startswith(OPENINGS) and out and not out.endswith("\n\n"):
            out = out.rstrip("\n") + "\n\n"
        out += t
    return out


def unified(original: str | None, patched: str | None, path: str) -> str:
    """A unified diff with three lines of context; empty for equal texts."""
    a, b = (original or "").splitlines(keepends=True), (patched or "").splitlines(keepends=True)
    return "".join(x if x.endswith("\n") else x + "\n" for x in difflib.unified_diff(a, b, f"a/{path}", f"b/{path}")) if original != patched else ""


def line_counts(original: str | None, patched: str | None) -> tuple[int, int, int]:
    """Lines added, removed and kept."""
    a, b = (original or "").splitlines(), (patched or "").splitlines()
    added = removed = kept = 0
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            kept += i2 - i1
        else:
            removed, added = removed + i2 - i1, added + j2 - j1
    return added, removed, kept


def diffs(patches: DataFrame, id_col: str = "patch_id") -> DataFrame:
    """``(id, added, removed, kept, ratio, diff)`` of ``path, original, patched``; nulls count as empty texts."""
    kind = patches.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, p, a, b in pdf.itertuples(index=False):
                added, removed, kept = line_counts(a, b)
                rows.append((i, added, removed, kept, (added + removed) / max(1, added + removed + kept), unified(a, b, p or "")))
            yield pd.DataFrame(rows, columns=[id_col, "added", "removed", "kept", "ratio", "diff"])

    return patches.select(id_col, "path", "original", "patched").mapInPandas(run, f"{id_col} {kind}, added int, removed int, kept int, ratio double, diff string")


def count_brackets(text: str, opening: str, closing: str) -> tuple[int, int]:
    """How often each bracket stands outside strings and comments."""
    bare = re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`", " ", text, flags=re.S)
    return bare.count(opening), bare.count(closing)


def repair(text: str) -> tuple[str, list[str], float]:
    """``(text, repairs, confidence)``: trailing commas before a closing bracket dropped, missing closing brackets added
    at the end (innermost first), closing brackets too many at the end dropped."""
    done, sure = [], 1.0
    fixed = re.sub(r",(\s*[)\]}])", r"\1", text)
    if fixed != text:
        done.append("trailing comma")
        sure = min(sure, 0.9)
    bare = re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`", " ", fixed, flags=re.S)
    stack: list[str] = []
    extra = 0
    for c in bare:
        if c in "([{":
            stack.append({"(": ")", "[": "]", "{": "}"}[c])
        elif c in ")]}":
            if stack and stack[-1] == c:
                stack.pop()
            else:
                extra += 1
    if stack and not extra:
        closing = "".join("\n}" if c == "}" else c for c in reversed(stack))
        fixed = fixed.rstrip("\n") + closing + "\n"
        done.append(f"closed {len(stack)}")
        sure = min(sure, 0.9 if len(stack) == 1 else 0.75 if len(stack) == 2 else 0.6)
    elif extra and not stack:
        cut = fixed.rstrip()
        while extra and cut and cut[-1] in ")]}":
            cut, extra = cut[:-1].rstrip(), extra - 1
            done.append("dropped closing")
        fixed = cut + "\n"
        sure = min(sure, 0.7)
    return fixed, done, sure if done else 1.0


def applied(proposed: DataFrame, files: DataFrame, id_cols: list[str]) -> DataFrame:
    """``(id…, path, kind, applied, confidence, note, patched)``: each proposed change set of a file, applied to it.

    ``proposed`` is what :func:`changes` gives, ``files`` has the first id column, ``path`` and ``content``. A change set
    whose file isn't there applies to nothing unless it is a new file.
    """
    key = id_cols[0]
    sets = proposed.groupBy(*id_cols, "path", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "search", "replace", "first", "last"))).alias("ops"))
    j = sets.join(files.select(key, "path", "content"), [key, "path"], "left")
    types = ", ".join(f"{c} {proposed.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                ops, content = row.ops, row.content
                head = (*(getattr(row, c) for c in id_cols), row.path, row.kind)
                if row.kind in ("whole", "new"):
                    rows.append((*head, 1, 1.0, "" if row.kind == "new" or content is not None else "no file", ops[-1]["replace"]))
                elif content is None:
                    rows.append((*head, 0, 0.0, "no file", None))
                elif row.kind in ("append", "prepend"):
                    rows.append((*head, len(ops), 1.0, "", with_ends(content, row.kind, [o["replace"] for o in ops])))
                elif row.kind == "lines":
                    text, n = apply_lines(content, [(int(o["first"]), int(o["last"]), o["replace"]) for o in ops])
                    rows.append((*head, n, 1.0, "", text))
                else:
                    text, sure, n, note = apply_with_rollback(content, [(o["search"], o["replace"]) for o in ops])
                    rows.append((*head, n, sure, note, text if n else None))
            yield pd.DataFrame(rows, columns=[*id_cols, "path", "kind", "applied", "confidence", "note", "patched"])

    return j.select(*id_cols, "path", "kind", "ops", "content").mapInPandas(run, f"{types}, path string, kind string, applied int, confidence double, note string, patched string")
