"""Packrat parsing of parsing-expression grammars, over token kinds.

A source text is cut into tokens, each token becomes one character (its kind), and brackets are reduced from the inside
out: the content of a pair without inner brackets is parsed under each of the readings that the grammar gives this kind
of bracket (arguments, parameters, block, class body ...), and the pair is replaced by one character that stands for
the set of readings that hold. A grammar therefore only ever sees flat strings, and the packrat table can be kept by
content instead of by position: the same content, in whatever file, is parsed once for all. Within a content the usual
table of (rule, position) keeps parsing linear.

A text is accepted only if all of it is consumed. Where it isn't, the furthest position that any expression reached
without being able to go on is reported.

Grammar notation, one rule per line (an indented line goes on with the rule above)::

    Name <- expression
    a b   sequence        a / b   ordered choice     a* a+ a? repetition
    &a !a lookahead       ( )     grouping           .    any one character
    'x'   the token x     IDENT   a named class (all capitals)
    @x    a bracket pair that has the reading x
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Bracket symbols: 2**11 readings for each kind of bracket, in a private plane.
FIRST = 0xF0000
#: Entries of a table that is kept by content, and the longest content that is; some 100 MB a process at most.
TABLE, KEPT = 60_000, 1000
SPAN = 1 << 11
Expr = Callable[[str, int], int]
#: Runs of like elements in a list; no grammar counts them, so two stand for all.
LONG = re.compile(r"((?:[ns],|i:[ns],|s:[ns],))\1{2,}")


class Grammar:
    """A compiled grammar: ``kinds`` maps token text to its character, ``classes`` names sets of characters."""

    def __init__(self, text: str, kinds: dict[str, str], classes: dict[str, str], readings: dict[str, dict[str, str]], lists: dict[str, str], item: re.Pattern | None = None, drop: str = "") -> None:
        self.kinds, self.classes = kinds, {k: frozenset(v) for k, v in classes.items()}
        self.readings = readings  # bracket -> reading -> rule
        self.base = {b: FIRST + SPAN * n for n, b in enumerate(readings)}
        self.bit = {r: (self.base[b], 1 << n) for b, rs in readings.items() for n, r in enumerate(rs)}
        self.rules: dict[str, Expr] = {}
        self.table: dict[tuple[str, int], int] = {}
        self.far = 0
        self._source = {}
        name = ""
        for line in text.split("\n"):
            if not line.strip():
                continue
            if "<-" in line and not line[0].isspace():
                name, _, body = line.partition("<-")
                name = name.strip()
                self._source[name] = body
            else:
                self._source[name] += " " + line
        for name, body in self._source.items():
            self.rules[name] = self._rule(name, _Reader(body, self).choice())
        self.memo: dict[str, str] = {}
        self.drop = re.compile(drop) if drop else None
        # Lists of statements or members are parsed item by item (``item`` cuts them), so that the same item is parsed
        # once whatever stands beside it: a list of valid items is valid. A list that isn't so cut is parsed whole.
        self.lists, self.items, self.item = lists, {}, item
        self.flat = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")

    def _rule(self, name: str, body: Expr) -> Expr:
        table = self.table

        def run(s: str, i: int) -> int:
            k = (name, i)
            r = table.get(k)
            if r is None:
                r = table[k] = body(s, i)
            return r

        return run

    def call(self, name: str) -> Expr:
        return lambda s, i: self.rules[name](s, i)

    def parse(self, rule: str, s: str) -> int:
        """-1 if ``rule`` consumes all of ``s``, else the furthest position reached."""
        if rule in self.lists and len(s) > 1:
            parts = self.item.findall(s)
            if sum(map(len, parts)) == len(s) and all(self._item(self.lists[rule], p) for p in parts):
                return -1
        self.table.clear()
        self.far = 0
        return -1 if self.rules[rule](s, 0) == len(s) else self.far

    def _item(self, rule: str, s: str) -> bool:
        k = rule + s
        r = self.items.get(k)
        if r is None:
            self.table.clear()
            s += "\x01"  # no item may rely on being the last
            r = self.rules[rule](s, 0) == len(s)
            if len(k) <= KEPT:
                if len(self.items) >= TABLE:
                    self.items.clear()
                self.items[k] = r
        return r

    def group(self, whole: str) -> str:
        """The symbol of a bracket pair with flat content."""
        sym = self.memo.get(whole)
        if sym is None:
            b, content, mask = whole[0], whole[1:-1], 0
            if self.drop:
                content = self.drop.sub("", content)
            content = LONG.sub(r"\1\1", content)
            for n, rule in enumerate(self.readings[b].values()):
                if self.parse(rule, content) < 0:
                    mask |= 1 << n
            sym = chr(self.base[b] + mask)
            if len(whole) <= KEPT:
                if len(self.memo) >= TABLE:
                    self.memo.clear()
                self.memo[whole] = sym
        return sym

    def reduce(self, s: str) -> str:
        """``s`` with all its bracket pairs replaced by symbols; brackets without a partner stay."""
        memo, group = self.memo, self.group

        def sub(m: re.Match) -> str:
            w = m.group()
            return memo.get(w) or group(w)

        for _ in range(64):
            s, n = self.flat.subn(sub, s)
            if not n:
                return s
        return "".join(c for c, _ in self.stack(s)[0])  # nested too deep for passes over the whole

    def stack(self, s: str, at: list[int] | None = None) -> tuple[list[tuple[str, int]], list[tuple[str, list[tuple[str, int]]]]]:
        """``s`` reduced in one pass from left to right: what is left, and the contents that no reading fits, each with
        the places of its characters (``at``, else their indexes)."""
        open_: list[tuple[str, list[tuple[str, int]]]] = []
        here: list[tuple[str, int]] = []
        wrong = []
        for k, c in enumerate(s):
            p = at[k] if at else k
            if c in "([{":
                open_.append((c, here))
                here = [(c, p)]
            elif c in ")]}" and open_ and {"(": ")", "[": "]", "{": "}"}[open_[-1][0]] == c:
                b, outer = open_.pop()
                sym = self.group("".join(x for x, _ in here) + c)
                if ord(sym) == self.base[b]:
                    wrong.append((b, here[1:]))
                outer.append((sym, here[0][1]))
                here = outer
            else:
                here.append((c, p))
        for _, outer in reversed(open_):
            here = outer + here
        return here, wrong


class _Reader:
    TOKEN = re.compile(r"\s*(?:'([^']+)'|(@\w+)|(\w+)|([()/*+?&!.]))")

    def __init__(self, body: str, g: Grammar) -> None:
        self.g, self.body, self.at = g, body.rstrip(), 0

    def peek(self) -> tuple[str, str]:
        m = self.TOKEN.match(self.body, self.at)
        if not m:
            if self.at < len(self.body):
                raise ValueError(f"bad grammar at {self.body[self.at :]!r}")
            return "", ""
        return ("lit", m[1]) if m[1] else ("sym", m[2]) if m[2] else ("name", m[3]) if m[3] else ("op", m[4])

    def take(self) -> tuple[str, str]:
        t = self.peek()
        m = self.TOKEN.match(self.body, self.at)
        self.at = m.end() if m else self.at
        return t

    def choice(self) -> Expr:
        parts = [self.sequence()]
        while self.peek() == ("op", "/"):
            self.take()
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        parts = tuple(parts)

        def run(s: str, i: int) -> int:
            for p in parts:
                r = p(s, i)
                if r >= 0:
                    return r
            return -1

        return run

    def sequence(self) -> Expr:
        parts = []
        while self.peek()[0] and self.peek() not in (("op", "/"), ("op", ")")):
            parts.append(self.prefix())
        if len(parts) == 1:
            return parts[0]
        parts = tuple(parts)

        def run(s: str, i: int) -> int:
            for p in parts:
                i = p(s, i)
                if i < 0:
                    return -1
            return i

        return run

    def prefix(self) -> Expr:
        t = self.peek()
        if t in (("op", "&"), ("op", "!")):
            self.take()
            e, g, want = self.suffix(), self.g, t[1] == "&"

            def run(s: str, i: int) -> int:
                far = g.far
                r = e(s, i)
                g.far = far
                return i if (r >= 0) == want else -1

            return run
        return self.suffix()

    def suffix(self) -> Expr:
        e = self.primary()
        while self.peek() in (("op", "*"), ("op", "+"), ("op", "?")):
            e = self._repeat(e, self.take()[1])
        return e

    @staticmethod
    def _repeat(e: Expr, how: str) -> Expr:
        if how == "?":

            def opt(s: str, i: int) -> int:
                r = e(s, i)
                return r if r >= 0 else i

            return opt

        def many(s: str, i: int) -> int:
            n = 0
            while True:
                r = e(s, i)
                if r < 0 or r == i:
                    break
                i, n = r, n + 1
            return i if n or how == "*" else -1

        return many

    def primary(self) -> Expr:
        kind, v = self.take()
        g = self.g
        if kind == "op" and v == "(":
            e = self.choice()
            if self.take() != ("op", ")"):
                raise ValueError(f"no closing parenthesis in {self.body!r}")
            return e
        if kind == "op" and v == ".":
            return lambda s, i: i + 1 if i < len(s) else -1
        if kind == "lit":
            want = frozenset(g.kinds[v])
        elif kind == "sym":
            base, bit = g.bit[v[1:]]
            want = None
        elif v in g.classes:
            want = g.classes[v]
        elif v in g._source or True:
            return g.call(v)
        if want is None:

            def bracket(s: str, i: int) -> int:
                if i < len(s):
                    k = ord(s[i]) - base
                    if 0 <= k < SPAN and k & bit:
                        return i + 1
                if i > g.far:
                    g.far = i
                return -1

            return bracket

        def one(s: str, i: int) -> int:
            if i < len(s) and s[i] in want:
                return i + 1
            if i > g.far:
                g.far = i
            return -1

        return one


class Kinds(dict):
    """Token text -> kind characters; texts not met before are classified once."""

    def __init__(self, known: dict[str, str], classify: Callable[[str], str]) -> None:
        super().__init__(known)
        self.known, self.classify = known, classify

    def __missing__(self, token: str) -> str:
        k = self.classify(token)
        if len(token) <= 80:
            if len(self) >= 2 * TABLE:
                self.clear()
                self.update(self.known)
            self[token] = k
        return k
