"""Problem 5: text values whose end was lost on the way.

Three kinds of evidence, each over all values:

* the value's own structure at its end: an open JSON payload, code fence or search block, a last line of code that isn't
  whole (the grammars of ``grammars`` say whether the text before it is sound);
* a self-join by prefix: the distinct texts are sorted, and a text that its successor begins with is a strict prefix of
  a longer copy (:func:`prefixes`); a join in the middle of a word shows a cut;
* the corpus: a last line that ends many values closes them on purpose, and a list item is whole if complete lines
  elsewhere end in the same two words. Both are counts that are joined to the few values in question.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir
from ..tables import clean_path, extension
from . import syntax

CUT, WHOLE, ASK = "cut", "whole", "ask"
#: A last line or a shape of one-line values counts as intended from this many values on, and this share of them.
OFTEN, OFTEN_SHARE = 5, 1 / 2000
#: Characters that the ranges of the sort are cut by, and the share (1 in HOT) of texts from which one opening is cut further.
RANGE_CHARS, HOT, LEAST_HOT = 300, 200, 1000
#: A length of a channel stands out from this many times the mean of the lengths at most NEAR away on.
SPIKE, NEAR = 8, 16

_JSON_START = re.compile(r"(?:\A|\n|[.!?](?=[ \t]))[ \t]*(?:```\w*[ \t]*\r?\n?[ \t]*)?([{\[])(?=\s*(?:[\"}\]{\[]|\Z))")
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\[\s\S])*"|[\[\]{}]|"')
_LIST = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+\S")
_LIST_LINE = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+(\S[^\r\n]*?)[ \t]*(?=\r?\n)", re.M)
_STOPPED = re.compile(r"[.!?…。！？।؟;:][\"”’»」』)\]）'`*_]*$")
_TAG = re.compile(r"</?\w+[^<>]*>$")
#: Abbreviations that something must follow, and a lone initial.
_ABBREVIATED = re.compile(r"(?:^|[\s(\"“])(?:(?<![A-Z]\. )[A-Z]|e\.g|i\.e|[Cc]f|vs|Mr|Mrs|Ms|Dr|Prof|Figs?|Secs?|Mod|resp|[Aa]pprox|Acc|Ver|Mon|Tues|Thurs|bzw|Abb|Kap|Nr|Dra?|Sra?|pág|рис|гл|[dD]\. ?h|[zZ]\. ?B|p\. ?(?:ej|ex))\.$")
_THAI = re.compile(r"[\u0e00-\u0e7f]\Z")
_TOKEN = re.compile(r"\d+(?:\.\d+)*|\w+|[^\w\s]")
_CAMEL = re.compile(r"[A-Z][a-z0-9]+[A-Z]\w*|[a-z]+[A-Z]\w*")
_MARKERS = ("<<<<<<< SEARCH", ">>>>>>> REPLACE", "=======")
_LINE_END = re.compile(r"\r\n|\n|\r")
_WORD_END = re.compile(r"\w\Z")


@functools.lru_cache(maxsize=2)
def json_end(text: str) -> tuple[str, int] | None:
    """``("open", _)`` or ``("closed", where it ends)`` for a text with a JSON payload, None for one without."""
    m = _JSON_START.search(text)
    if not m:
        return None
    depth = []
    for k in _JSON_TOKEN.finditer(text, m.start(1)):
        c = k.group()
        if c == '"':
            return "open", k.start()
        if c in "[{":
            depth.append(c)
        elif c in "]}":
            if not depth or {"]": "[", "}": "{"}[c] != depth.pop():
                return "closed", k.end()
            if not depth:
                return "closed", k.end()
    return ("open", len(text)) if depth else None


def shape(line: str) -> str:
    """``line`` with its names and numbers as typed slots."""
    return " ".join("#" if t[0].isdigit() else "N" if _CAMEL.fullmatch(t) else t.lower() for t in _TOKEN.findall(line))


def ending(line: str) -> str:
    """The last two tokens of ``line``, typed."""
    return " ".join(shape(line[-80:]).split(" ")[-2:])


def answer_end(text: str) -> tuple[str, str, str]:
    """``(verdict, last line, its kind)``: cut or whole where the structure tells, else to be asked of the corpus."""
    s = text.rstrip()
    if not s.strip("​﻿ \t\r\n"):
        return WHOLE, "", ""
    if s.endswith("�"):
        return CUT, "", ""
    js = json_end(s)
    if js:
        if js[0] == "open":
            return CUT, "", ""
        tail = s[js[1] :].strip()
        if tail in ("", "```"):
            return WHOLE, "", ""
        tail = tail.removeprefix("```").strip()
        fences = tail.count("```")
    else:
        tail, fences = s, s.count("```")
    if fences % 2:
        return CUT, "", ""
    if tail.endswith("```"):
        return WHOLE, "", ""
    search = tail.rfind("<<<<<<< SEARCH")
    if search >= 0 and tail.find(">>>>>>> REPLACE", search) < 0:
        return CUT, "", ""
    last = tail.rsplit("\n", 1)[-1].strip()
    if last == ">>>>>>> REPLACE":
        return WHOLE, "", ""
    if last.startswith("--- FILE:") or len(last) > 1 and any(m.startswith(last) for m in _MARKERS) or set(last) <= {"`"}:
        return CUT, last, ""
    if _TAG.search(last):
        return WHOLE, last, ""
    if _STOPPED.search(last):
        return (CUT if _ABBREVIATED.search(last) else WHOLE), last, "stop"
    if _THAI.search(last):  # a script without stops
        return WHOLE, last, "stop"
    if _LIST.match(last):
        return ASK, last, "list"
    return ASK, last, "line" if "\n" in tail or js else "only"


def code_end(ext: str | None, text: str, original: str | None) -> str:
    """Whether a source text is cut. ``original`` is the text it was made from, whose lines show which lines are whole."""
    return CUT if code_evidence(ext, text, original) else WHOLE


def code_evidence(ext: str | None, text: str, original: str | None) -> str:
    """What shows that a source text is cut: ``prefix`` of its original or of a line of it, or ``structure``; empty if nothing."""
    if _code_end(ext, text, original) == WHOLE:
        return ""
    if not original:
        return "structure"
    last = text.rsplit("\n", 1)[-1].strip()
    longer = last and any(len(x) > len(last) and x.startswith(last) for x in map(str.strip, original.split("\n")))
    return "prefix" if longer or len(original) > len(text) and original.startswith(text) else "structure"


def _code_end(ext: str | None, text: str, original: str | None) -> str:
    if not text.strip() or ext is None:
        return WHOLE
    s = text.rstrip(" \t")
    if s.endswith("�"):
        return CUT
    if s.rstrip().endswith("```"):
        return WHOLE
    if s.endswith(("\n", "\r")):
        return CUT if left_open(ext, text, original) else WHOLE
    last = s.rsplit("\n", 1)[-1].strip()
    if syntax.language(ext) is None:
        return WHOLE
    lines = {x.strip() for x in (original or "").split("\n")}
    if last in lines or last in {x.strip() for x in s.split("\n")[:-1]}:
        return CUT if left_open(ext, text, original) else WHOLE
    if not syntax.valid(ext, text):
        return CUT if not re.fullmatch(r"[\]})>;,\s]+", last) or left_open(ext, text, original) else WHOLE
    return CUT if any(x.startswith(last) for x in lines) else WHOLE


def left_open(ext: str, text: str, original: str | None) -> bool:
    """Whether a source text that ends at a whole line ends with its structure open.

    A text that parses doesn't. Of the others, a strict prefix of its original does, and one that parses with what follows
    its last lines in the original; one that ends where the original ends has lost nothing there. What the original can't
    tell is seen by brackets that are open at the end and that the layout of the last line doesn't close either, so that
    a bracket lost further up is no open end.
    """
    if syntax.language(ext) is None or syntax.valid(ext, text):
        return False
    lines = [x.rstrip() for x in _LINE_END.split(text.rstrip())]
    if original and original.strip():
        if len(original) > len(text) and original.startswith(text):
            return bool(original[len(text) :].strip())
        old = [x.rstrip() for x in _LINE_END.split(original.rstrip())]
        best = max((_agree(lines, old, k), k) for k in range(len(old)))
        if best[0]:
            rest = old[best[1] + 1 :]
            if not rest:
                return False
            if syntax.valid(ext, "\n".join([*lines, *rest])):
                return True
    return _open_inside(ext, lines)


def _agree(a: list[str], b: list[str], k: int) -> int:
    """How many last lines of ``a`` stand in ``b`` up to its line ``k``."""
    n = 0
    while n < len(a) and n <= k and a[-1 - n] == b[k - n]:
        n += 1
    return n


def _open_inside(ext: str, lines: list[str]) -> bool:
    """Whether the innermost open bracket holds the last line by its indentation, or a header of Python waits for its body."""
    lang, text = syntax.language(ext), "\n".join(lines)
    open_, last = [], ""
    for m in lang.token.finditer(text):
        for c in lang.kinds[m.group(1)]:
            if c in "([{":
                open_.append((c, m.start(1)))
            elif c in ")]}":
                if not open_ or {"(": ")", "[": "]", "{": "}"}[open_.pop()[0]] != c:
                    return False
            if c.strip():
                last = c
    if not open_:
        return ext == "py" and last == ":"
    line = text.count("\n", 0, open_[-1][1])
    if line == len(lines) - 1:
        return last in "([{,"
    indent = [len(x) - len(x.lstrip()) for x in (lines[line], lines[-1])]
    return indent[0] < indent[1]


def _within_word(short: str, text: str) -> bool:
    """Whether ``text``, which begins with ``short``, goes on within its last word."""
    return bool(_WORD_END.search(short[-1])) and bool(_WORD_END.search(text[len(short)]))


def prefixes(values: DataFrame, text_col: str = "text") -> DataFrame:
    """``(hash, in_word)`` of the texts that are strict prefixes of a longer text, by one sort of the distinct texts.

    In sorted order a text's extensions follow it directly. Each partition of the range sort compares a text with those
    before it that it begins with; the first text of the next partition that has one stands in for what follows a
    partition's last text. The ranges are cut by the texts' first :data:`RANGE_CHARS` characters, so that no whole texts are
    sampled to the driver, and where one text in :data:`HOT` opens alike by as many characters more, level by level.
    ``in_word`` tells whether a longer text goes on within a word. Null and empty texts are left out.
    """
    texts = values.select(F.col(text_col).alias("_text")).where("_text <> ''")
    total, ranges = texts.count(), [F.left("_text", F.lit(RANGE_CHARS))]
    while True:
        # at least one text in HOT shares each of these openings, so there are HOT of them at most
        opening, end = F.xxhash64(F.left("_text", F.lit(RANGE_CHARS * len(ranges)))), RANGE_CHARS * len(ranges)
        counts = texts.where(F.length("_text") > end).groupBy(opening.alias("h")).agg(F.count("*").alias("n"))
        hot = [r["h"] for r in counts.where(F.col("n") > max(LEAST_HOT, total / HOT)).select("h").collect()]
        if not hot:
            break
        ranges.append(F.when(opening.isin(hot), F.substring("_text", end + 1, RANGE_CHARS)).otherwise(F.lit("")))
    one = texts.distinct()
    ranged = one.repartitionByRange(*ranges).sortWithinPartitions("_text").withColumn("_part", F.spark_partition_id())

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, part, first = [], 0, True  # the last text behind those that it begins with, each with what is known of it
        for pdf in batches:
            out = []
            for t, p in zip(pdf["_text"], pdf["_part"], strict=True):
                if first:
                    out.append((None, t, None, p))
                    first = False
                while chain and not t.startswith(chain[-1][0]):
                    out += told(chain.pop(), p)
                for x in chain:
                    x[1] = x[1] or _within_word(x[0], t)
                chain.append([t, None])
                part = p
            yield pd.DataFrame(out, columns=["_short", "_first", "in_word", "_part"])
        yield pd.DataFrame([y for x in chain for y in [*told(x, part), (x[0], None, None, part)]], columns=["_short", "_first", "in_word", "_part"])

    def told(x: list, part: int) -> list:
        return [] if x[1] is None else [(x[0], None, x[1], part)]

    found = ranged.mapInPandas(neighbours, "_short string, _first string, in_word boolean, _part int")
    inner = found.where("in_word is not null").select("_short", "in_word")
    # the seams: one first and one last text, with those that it begins with, for each partition
    firsts = found.where("_first is not null").select(F.lag("_part").over(W.orderBy("_part")).alias("_part"), F.col("_first").alias("_next"))
    lasts = found.where("_first is null and in_word is null").select("_part", "_short")
    seams = lasts.join(firsts, "_part").where("length(_next) > length(_short) and startswith(_next, _short)")
    seams = seams.select("_short", (F.col("_short").rlike(r"(?U)\w\z") & F.expr("substring(_next, length(_short) + 1, 1)").rlike(r"(?U)\w")).alias("in_word"))
    return inner.unionByName(seams).select(F.xxhash64("_short").alias("hash"), "in_word").groupBy("hash").agg(F.max("in_word").alias("in_word"))


def answers(proposals: DataFrame, diffs: DataFrame) -> DataFrame:
    """``(source_table, row_id, relay, prompt, text)`` of the two tables' answers, null answers left out, each id once."""
    a = proposals.select(F.lit("proposals").alias("source_table"), F.col("proposal_id").cast("bigint").alias("row_id"), "relay", "prompt", F.col("llm_response").alias("text"))
    b = diffs.select(F.lit("minimal_diffs").alias("source_table"), F.col("diff_id").cast("bigint").alias("row_id"), "relay", "prompt", F.col("raw_llm_response").alias("text"))
    return a.unionByName(b).where("text is not null")


def spikes(judged: DataFrame, least: float) -> DataFrame:
    """``(source_table, relay, n_chars)``: lengths that a channel delivers far more often than the lengths around them.

    The histogram is added up first. A spike holds ``least`` values and :data:`SPIKE` times the mean of the lengths at
    most :data:`NEAR` away from it.
    """
    counts = judged.groupBy("source_table", "relay", "n_chars").agg(F.count("*").alias("_n"))
    around = W.partitionBy("source_table", "relay").orderBy("n_chars").rangeBetween(-NEAR, NEAR)
    others = (F.sum("_n").over(around) - F.col("_n")) / (2 * NEAR)
    return counts.withColumn("_others", others).where((F.col("_n") >= least) & (F.col("_n") > SPIKE * F.col("_others"))).select("source_table", "relay", "n_chars")


def resolve(judged: DataFrame, texts: DataFrame, patched: DataFrame | None = None) -> DataFrame:
    """``(source_table, row_id, relay, defect, cut, evidence)`` for what :func:`judge` gave; open verdicts are settled.

    ``texts`` has all texts among which a value may have a longer copy. A value that a longer copy continues within a word
    is cut whatever its own structure says (evidence ``prefix``). Then its structure decides (``structure``), and of what
    stays open the corpus tells which ends are meant; the rest is cut, with the evidence ``spike`` where its length is one
    at which its channel's values pile up, else ``open end``. A length alone cuts nothing: whole values may have it.
    ``patched`` is what :func:`cut_patches` gave; it is held against the longer copies alike.

    The judgements are needed by every count below, so they are computed once and kept in the shared folder.
    """
    checkpoint_dir(judged.sparkSession)
    judged = judged.checkpoint()
    keys = ["source_table", "row_id", "relay", "defect"]
    least = max(OFTEN, judged.count() * OFTEN_SHARE)
    # at least N / 2000 values share each of these, so there are 2000 of them at most: small whatever N is
    lines = judged.where("line <> ''").groupBy("line").agg(F.count("*").alias("_times")).where(F.col("_times") >= least)
    asked = judged.where(F.col("verdict") == ASK).join(F.broadcast(lines), "line", "left")
    often, asked = asked.where("_times is not null"), asked.where("_times is null")
    shapes = asked.where("kind = 'only'").groupBy("shape").agg(F.count("*").alias("_alike")).where(F.col("_alike") >= least)
    # what is frequent is settled by now, so no key of this join is hot on the left; the right has a key once
    ends = judged.select(F.explode("ends").alias("tail")).groupBy("tail").agg(F.count("*").alias("_lines"))
    lists = asked.where("kind = 'list'").join(ends, "tail", "left").withColumn("_meant", F.col("_lines").isNotNull() & F.col("balanced"))
    others = asked.where("kind <> 'list'").join(F.broadcast(shapes), "shape", "left").withColumn("_meant", (F.col("kind") == "only") & F.col("_alike").isNotNull())
    # as many values again stand at each of these lengths
    piled = F.broadcast(spikes(judged, least).select(F.col("source_table").alias("_t"), F.col("relay").alias("_r"), F.col("n_chars").alias("_l"), F.lit(True).alias("_piled")))
    columns = [*keys, "n_chars", "hash", "_meant"]
    j = lists.select(columns).unionByName(others.select(columns))
    j = j.join(piled, F.expr("source_table = _t and relay <=> _r and n_chars = _l"), "left")
    held = j.select(*keys, "hash", (~F.col("_meant")).alias("cut"), F.when(F.col("_meant"), F.lit("")).when(F.col("_piled"), F.lit("spike")).otherwise(F.lit("open end")).alias("evidence"), F.lit(True).alias("_word"))
    # only a text that ends in a letter or digit can go on within a word; one line that is frequent as a whole is meant
    held = held.unionByName(often.select(*keys, "hash", F.lit(False).alias("cut"), F.lit("").alias("evidence"), (F.col("kind") != "only").alias("_word")))
    told = judged.where(F.col("verdict") != ASK)
    cut = F.col("verdict") == CUT
    held = held.unionByName(told.select(*keys, "hash", cut.alias("cut"), F.when(cut, F.lit("structure")).otherwise(F.lit("")).alias("evidence"), (cut | F.col("line").rlike(r"(?U)\w\z")).alias("_word")))
    if patched is not None:
        held = held.unionByName(patched.withColumn("defect", F.lit("")))
    inside = prefixes(texts).where("in_word").select("hash", "in_word")
    # what can't go on within a word gets a key of its own, so that no key is hot by it
    key = F.when(F.col("_word"), F.col("hash")).otherwise(F.xxhash64("source_table", "row_id"))
    longer = F.col("_word") & F.col("in_word").isNotNull()
    probed = held.withColumn("hash", key).join(inside, "hash", "left")
    return probed.select(*keys, (F.col("cut") | longer).alias("cut"), F.when(longer, F.lit("prefix")).otherwise(F.col("evidence")).alias("evidence"))


JUDGED = "source_table string, row_id bigint, relay string, n_chars int, hash bigint, defect string, verdict string, line string, kind string, shape string, tail string, balanced boolean, ends array<string>"


def judge(texts: DataFrame, defect) -> DataFrame:
    """The answers with what their own text tells; ``defect(prompt, text)`` names another defect, or is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for table, i, relay, prompt, text, h in pdf[["source_table", "row_id", "relay", "prompt", "text", "hash"]].itertuples(index=False):
                verdict, line, kind = answer_end(text)
                # how the complete list lines of the text (a line break follows) end
                ends = list({ending(x) for x in _LIST_LINE.findall(text)})
                rows.append((table, i, relay, len(text), h, defect(prompt, text), verdict, line, kind, shape(line) if kind == "only" else "", ending(line) if kind == "list" else "", line.count("(") <= line.count(")"), ends))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in JUDGED.split(", ")])

    return texts.select("source_table", "row_id", "relay", "prompt", "text", F.xxhash64("text").alias("hash")).mapInPandas(run, JUDGED)


def cut_patches(patches: DataFrame) -> DataFrame:
    """``(source_table, row_id, relay, hash, cut, evidence, _word)`` of the non-empty patched texts; ``_word``: it ends in a letter or digit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            by = [code_evidence(e, t, o) for e, t, o in zip(pdf["ext"], pdf["text"], pdf["original"], strict=True)]
            yield pd.DataFrame({"source_table": "patch_results", "row_id": pdf["row_id"], "relay": pdf["relay"], "hash": pdf["hash"], "cut": [x != "" for x in by], "evidence": by, "_word": [bool(_WORD_END.search(t)) for t in pdf["text"]]})

    df = patches.select(F.col("patch_id").cast("bigint").alias("row_id"), "relay", extension(clean_path(F.col("path"))).alias("ext"), F.col("patched").alias("text"), "original", F.xxhash64("patched").alias("hash"))
    return df.where("text <> ''").mapInPandas(run, "source_table string, row_id bigint, relay string, hash bigint, cut boolean, evidence string, _word boolean")
