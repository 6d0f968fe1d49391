"""Problem 6: evaluation texts inside training text.

Items and documents are canonicalised alike: lower case, invisible characters dropped, punctuation and layout ignored,
numbers, names and units turned into typed slots. Windows are looked at twice: by wording (three tokens) and as templates
(five canonical tokens). The items' windows, whose dictionary every task holds, number the windows of the documents, and
a hash join on these numbers brings together what has the same wording, or the same template whatever the slots hold. The
hits of a document and an item are then read in order: those that run along in both texts (with at most a few changed
words between them) form passages. Where the slots hold the item's own values, the share of the item's own wording that
lies in passages decides on a leak. Where they don't, a passage is only of the same template: if as much of the item is
met that way, the pair is a re-parameterised question and reported as such. A passage of plain words, without any slot,
counts if most of it stands in windows that no other item has. An item of fewer tokens than a window has none, and is
found nowhere.

The items are the stated query set, read in blocks of :data:`BLOCK`. Of the documents nothing is shuffled but the hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items whose windows one pass over the documents holds; at some 200 windows an item well under 200 MB.
BLOCK = 5000
#: Tokens of a window by wording, and of a template window, most of which must be words.
WINDOW, TEMPLATE, LEAST_WORDS = 3, 5, 3
#: Tokens that may lie between two hits of one passage.
GAP = 7
#: Hit tokens that a passage needs; of a shorter item, all.
LEAST_HIT = 7
#: Share of the hit tokens of a passage without slots that must lie in windows which no other item has.
OWN = 0.5
#: Share of a passage's slots that must hold the item's values; with others the sentence is only of the same template.
CONSISTENT = 0.5
#: Share of the own wording from which an item counts as leaked: about two fifths.
SHARE = 0.4

CJK = "⺀-⿿　-ヿㇰ-ㇿ㐀-鿿豈-﫿"
TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|[{CJK}]|[^\W\d_{CJK}]+")
_IDEOGRAPH = re.compile(f"[{CJK}]")
INVISIBLE = re.compile("[​-‍⁠﻿­]")
NAME = re.compile(r"[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z]+(?:[A-Z][a-z0-9]+)+")
UNITS = frozenset("kb mb gb ms s kg km percent k m".split())


def tokens(text: str) -> list[str]:
    """Words, numbers and single ideographs of ``text``, without case."""
    return TOKEN.findall(INVISIBLE.sub("", text).lower())


def slot(token: str, names: frozenset[str]) -> str:
    """The typed placeholder of ``token``, or the token itself."""
    return "<n>" if token[0].isdigit() else "<name>" if token in names else "<unit>" if token in UNITS else token


LEAK, REPARAMETERISED = "leak", "re-parameterised"


class Index:
    """The windows of a block of items, numbered by template and by wording; ``common`` has those that several items hold."""

    def __init__(self, items: list[tuple[int, str]], shared: frozenset[str], common: frozenset[tuple] = frozenset()) -> None:
        self.names = frozenset(x.lower() for _, t in items for x in NAME.findall(INVISIBLE.sub("", t)))
        self.templates: dict[tuple, int] = {}
        self.wordings: dict[tuple, int] = {}
        self.rows: list[tuple[int, int, int]] = []  # number of the window (a template's is below 0), item, place
        self.length: dict[int, int] = {}
        self.slots: dict[int, list[bool]] = {}
        self.common: dict[int, set[int]] = {}
        for no, (_, text) in enumerate(items):
            toks = [x for p in paragraphs(text) if key(p) not in shared for x in [*tokens(p), "\0"]]
            canon = [slot(x, self.names) for x in toks]
            self.length[no] = sum(x != "\0" for x in toks)
            # between ideographs every Latin word is a value of the template
            ideographs = sum(map(bool, map(_IDEOGRAPH.match, toks))) > len(toks) / 2
            self.slots[no] = [a != b or ideographs and a.isascii() and a != "\0" for a, b in zip(toks, canon, strict=True)]
            self.common[no] = {i for i in range(len(toks) - WINDOW + 1) if tuple(toks[i : i + WINDOW]) in common}
            for i in range(len(toks)):
                w, t = tuple(toks[i : i + WINDOW]), tuple(canon[i : i + TEMPLATE])
                if len(w) == WINDOW and "\0" not in w:
                    self.rows.append((self.wordings.setdefault(w, len(self.wordings)), no, i))
                if len(t) == TEMPLATE and "\0" not in t and any(x[0] == "<" for x in t) and sum(x[0] != "<" for x in t) >= LEAST_WORDS:
                    self.rows.append((self.templates.setdefault(t, -1 - len(self.templates)), no, i))
        self.least = min([LEAST_HIT, *(n for n in self.length.values() if n)])

    def windows(self, text: str) -> list[tuple[int, int]]:
        """``(place, number)`` of the windows of ``text`` that items have, by wording and, where the wording isn't an item's, as templates.

        A passage holds LEAST_HIT tokens (of a short item, all) in windows near each other, and a template counts in an
        unbroken run of as many: what lies alone can't be part of any and is left out.
        """
        toks = tokens(text)
        out, near = [], []
        held = set()
        get = self.wordings.get
        for j, w in enumerate(zip(toks, toks[1:], toks[2:], strict=False)):
            n = get(w)
            if n is not None:
                if near and j > near[-1][0] + GAP + WINDOW:
                    out += self._near(near)
                    near = []
                near.append((j, n))
                held.add(j)
        out += self._near(near)
        names = self.names
        canon = [x if x.isalpha() and x not in names and x not in UNITS else slot(x, names) for x in toks]
        run = []
        get = self.templates.get
        for j, t in enumerate(zip(*(canon[k:] for k in range(TEMPLATE)), strict=False)):
            n = get(t)
            if n is not None:
                if run and j != run[-1][0] + 1:
                    out += self._run(run, held)
                    run = []
                run.append((j, n))
        return out + self._run(run, held)

    def _near(self, near: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return near if len(near) * WINDOW >= self.least else []

    def _run(self, run: list[tuple[int, int]], held: set[int]) -> list[tuple[int, int]]:
        if len(run) + TEMPLATE - 1 < LEAST_HIT:
            return []
        return [x for x in run if not all(x[0] + k in held for k in range(TEMPLATE - WINDOW + 1))]

    def judge(self, no: int, hits: list[tuple[int, int, bool]]) -> tuple[float, str]:
        """Share of item ``no``'s own wording that ``hits`` (place in the document, in the item, by wording) hold, and how."""
        length = self.length[no]
        if not length:
            return 0.0, LEAK
        same = [(j, i) for j, i, by in hits if by]
        share = min(1.0, len(self.covered(no, same, lambda held, slots: sum(k in held for k in slots) >= CONSISTENT * len(slots))) / length)
        if share >= SHARE or len(same) == len(hits):
            return share, LEAK
        # a template window is as many windows of the other kind
        over = {*same, *((j + k, i + k) for j, i, by in hits if not by for k in range(TEMPLATE - WINDOW + 1))}
        return min(1.0, len(self.covered(no, sorted(over), lambda held, slots: bool(slots))) / length), REPARAMETERISED

    def covered(self, no: int, at: list[tuple[int, int]], consistent) -> set[int]:
        """The tokens of item ``no`` that lie in passages which count."""
        least = min(LEAST_HIT, self.length[no])
        covered: set[int] = set()
        if len(at) * WINDOW < least:  # as many tokens at most
            return covered
        for passage in passages(at):
            own = {i + k for _, i in passage for k in range(WINDOW)}
            slots = [k for k in range(min(own), max(own) + 1) if self.slots[no][k]]
            if len(own) < least:
                continue
            if slots:
                counts = consistent(own, slots)
            else:
                counts = len({i + k for _, i in passage if i not in self.common[no] for k in range(WINDOW)}) >= OWN * len(own)
            if counts:
                i0 = None
                for _, i in passage:
                    if i0 is not None and i > i0:
                        own.update(range(i0, i))
                    i0 = i
                covered |= own
        return covered


def passages(hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Hits (place in the document, place in the item), grouped into runs that advance alike in both."""
    open_: list[list[tuple[int, int]]] = []
    done: list[list[tuple[int, int]]] = []
    for j, i in sorted(hits):
        best = None
        for run in open_:
            dj, di = j - run[-1][0], i - run[-1][1]
            if 0 < dj <= GAP + WINDOW and 0 < di <= GAP + WINDOW and abs(dj - di) <= 4 and (best is None or abs(dj - di) < best[0]):
                best = (abs(dj - di), run)
        if best:
            best[1].append((j, i))
        else:
            still = [run for run in open_ if j - run[-1][0] <= GAP + WINDOW]
            done += [run for run in open_ if j - run[-1][0] > GAP + WINDOW]
            open_ = [*still, [(j, i)]]
    return done + open_


def paragraphs(text: str) -> list[str]:
    return [p for p in re.split(r"(?:\r?\n[ \t]*){2,}", text) if p.strip()]


def key(paragraph: str) -> str:
    return " ".join(tokens(paragraph))


def windows(text: str, shared: frozenset[str]) -> set[tuple]:
    """The windows of an item's own wording."""
    out = set()
    for p in paragraphs(text):
        if key(p) not in shared:
            toks = tokens(p)
            out.update(zip(*(toks[k:] for k in range(WINDOW)), strict=False))
    return out


def leaks(docs: DataFrame, items: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """Pairs ``(doc id, item id, share, kind)``, each pair once.

    ``share`` is the share of the item's own wording that the document holds, from the given one on; ``kind`` is ``leak``,
    or ``re-parameterised`` where the document holds the item's template with other values. A paragraph that several items
    hold (an instruction) is no item's own wording. Null or empty texts and items without own wording are in no pair;
    repeated rows of either table change nothing; other columns are ignored. Documents of any length are probed whole.
    """
    spark = docs.sparkSession
    doc_type, item_type = docs.schema[doc_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    query = items.select(F.col(item_col).alias("_id"), F.col(item_text_col).alias("_text")).where("_id is not null and _text <> ''").dropDuplicates(["_id"]).orderBy("_id")
    rows = [(r["_id"], r["_text"]) for r in query.toLocalIterator()]  # the stated query set, not the corpus
    seen: dict[str, int] = defaultdict(int)
    held: dict[tuple, int] = defaultdict(int)
    for _, text in rows:
        for p in {key(p) for p in paragraphs(text)}:
            seen[p] += 1
    shared = frozenset(p for p, n in seen.items() if n > 1)
    for _, text in rows:
        for w in windows(text, shared):
            held[w] += 1
    df = docs.select(F.col(doc_col).alias("_doc"), F.col(text_col).alias("_text")).where("_doc is not null and _text <> ''")
    schema = f"_doc {doc_type}, _item {item_type}, share double, kind string"
    out = spark.createDataFrame([], schema)
    for lo in range(0, len(rows), block):
        part = rows[lo : lo + block]
        common = frozenset(w for _, text in part for w in windows(text, shared) if held[w] > 1)
        index = Index(part, shared, common)
        # at most BLOCK items' windows; whether they are sent to every task is left to their size
        item_windows = spark.createDataFrame(pd.DataFrame(index.rows, columns=["_window", "_no", "_i"]), "_window int, _no int, _i int")

        def number(batches: Iterator[pd.DataFrame], part: list = part, common: frozenset = common) -> Iterator[pd.DataFrame]:
            index = Index(part, shared, common)
            for pdf in batches:
                got = [(d, *x) for d, t in zip(pdf["_doc"], pdf["_text"], strict=True) for x in index.windows(t)]
                yield pd.DataFrame(got, columns=["_doc", "_j", "_window"])

        def judge(batches: Iterator[pd.DataFrame], part: list = part, common: frozenset = common) -> Iterator[pd.DataFrame]:
            index = Index(part, shared, common)
            for pdf in batches:
                got = []
                for d, no, hits in zip(pdf["_doc"], pdf["_no"], pdf["_hits"], strict=True):
                    s, kind = index.judge(no, [(h >> 32, (h >> 1) & 0x7FFFFFFF, bool(h & 1)) for h in sorted(hits.tolist())])
                    if s >= share:
                        got.append((d, part[no][0], s, kind))
                yield pd.DataFrame(got, columns=["_doc", "_item", "share", "kind"])

        # fewer hits than this can't reach the share: one lies at most GAP + WINDOW tokens behind the one before
        need = spark.createDataFrame([(no, int(share * n) // (GAP + WINDOW)) for no, n in index.length.items()], "_no int, _need int")
        hits = df.mapInPandas(number, f"_doc {doc_type}, _j int, _window int")
        # place in the document, in the item, and whether by wording, in one number
        packed = F.shiftleft(F.col("_j").cast("bigint"), 32) + F.shiftleft(F.col("_i").cast("bigint"), 1) + (F.col("_window") >= 0).cast("bigint")
        met = hits.join(item_windows, "_window").groupBy("_doc", "_no").agg(F.collect_set(packed).alias("_hits"))
        met = met.join(F.broadcast(need), "_no").where(F.size("_hits") >= F.col("_need")).select("_doc", "_no", "_hits")
        out = out.unionByName(met.mapInPandas(judge, schema))
    best = F.max(F.struct(F.col("kind") == LEAK, "share", "kind")).alias("_b")
    return out.groupBy("_doc", "_item").agg(best).select(F.col("_doc").alias(doc_col), F.col("_item").alias(item_col), "_b.share", "_b.kind")
