"""A table-driven generalized LR recognizer.

The grammar is read from text (see ``grammars``). The LR(0) automaton with FOLLOW-set lookahead is built lazily: a state
comes into being when a parse first reaches it. Conflicts fork the stack, so grammars may be written as in a language's
reference. No tree is built, so what matters of a parse is the set of its stacks; stacks are hash-consed lists, and
their set after each token is remembered by the set before it and the token. Code repeats itself, so nearly every token of
a file is one dictionary lookup. All recognizers of a process share one budget of ``ROOM`` entries, some 100 MB (that of
thousands of files takes a tenth of it); beyond it all memory is dropped before the next file, which changes no result.
"""

from __future__ import annotations

import re
from itertools import count
from weakref import WeakSet

_LEX = re.compile(r"\s*(?:#[^\n]*)?(?:('(?:[^'\\]|\\.)+')|([A-Za-z_][A-Za-z0-9_]*)|(.))")

END, SEMI = "END", "';'"
#: Entries that the recognizers of a process remember together.
ROOM = 500_000
_all: WeakSet[Recognizer] = WeakSet()


class Grammar:
    """Productions from text: ``name: a 'lit' TOKEN? (b | c)* x+ y%',' ;`` where ``y%','`` is a comma-separated list."""

    def __init__(self, text: str, start: str):
        self.prods: list[tuple[str, tuple[str, ...]]] = []
        self._fresh = count()
        self._made: dict[tuple, str] = {}
        toks = [m.group(1) or m.group(2) or m.group(3) for m in _LEX.finditer(text) if any(m.groups())]
        toks = [t for t in toks if t.strip()]
        i = 0
        while i < len(toks):
            name, colon = toks[i], toks[i + 1]
            assert colon == ":", (name, toks[i : i + 5])
            alts, i = self._alts(toks, i + 2)
            assert toks[i] == ";", (name, toks[i - 5 : i + 3])
            i += 1
            for a in alts:
                self.prods.append((name, a))
        self.prods.append(("START", (start, END)))
        by: dict[str, list[int]] = {}
        for k, (lhs, _) in enumerate(self.prods):
            by.setdefault(lhs, []).append(k)
        self.by = by
        used = {s for _, r in self.prods for s in r}
        odd = {s for s in used if s not in by and not (s[0] == "'" or s.isupper())}
        assert not odd, odd
        self.terminals = sorted(s for s in used if s not in by)
        self._follow()

    def _alts(self, toks: list[str], i: int):
        """Alternatives up to the closing bracket. What may be absent is written out as further alternatives rather than
        derived as empty: an empty derivation would fork the stack wherever it may stand, doubling it at each level."""
        alts: list[tuple[str, ...]] = []
        seq: list[tuple[str, bool]] = []
        while toks[i] not in (";", ")"):
            t = toks[i]
            if t == "|":
                alts += self._spelled(seq)
                seq = []
                i += 1
                continue
            if t == "(":
                inner, i = self._alts(toks, i + 1)
                assert toks[i] == ")"
                i += 1
                sym = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else self._rule(("g", tuple(inner)), inner)
            else:
                sym = t
                i += 1
            absent = False
            while i < len(toks) and toks[i] in ("?", "*", "+", "%"):
                if toks[i] in "?*":
                    absent = True
                if toks[i] in "*+":
                    sym = self._rule(("+", sym), [(sym,), (None, sym)])
                elif toks[i] == "%":
                    i += 1
                    sym = self._rule(("%", sym, toks[i]), [(sym,), (None, toks[i], sym)])
                i += 1
            seq.append((sym, absent))
        return alts + self._spelled(seq), i

    def _spelled(self, seq: list[tuple[str, bool]]) -> list[tuple[str, ...]]:
        loose = [k for k, (_, absent) in enumerate(seq) if absent]
        kept = {k: self._rule(("?", seq[k][0]), [(), (seq[k][0],)]) for k in loose[7:]}
        out: list[tuple[str, ...]] = [()]
        for k, (sym, absent) in enumerate(seq):
            sym = kept.get(k, sym)
            out = [o + (sym,) for o in out] + (out if absent and k not in kept else [])
        return list(dict.fromkeys(out))

    def _rule(self, key, alts) -> str:
        if key not in self._made:
            name = self._made[key] = f"_{next(self._fresh)}"
            for a in alts:
                self.prods.append((name, tuple(name if s is None else s for s in a)))
        return self._made[key]

    def _follow(self) -> None:
        nullable: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in self.by} | {t: {t} for t in self.terminals}
        follow: dict[str, set[str]] = {n: set() for n in self.by}
        changed = True
        while changed:
            changed = False
            for lhs, rhs in self.prods:
                if lhs not in nullable and all(s in nullable for s in rhs):
                    nullable.add(lhs)
                    changed = True
                before = len(first[lhs])
                for s in rhs:
                    first[lhs] |= first[s]
                    if s not in nullable:
                        break
                changed |= len(first[lhs]) != before
        changed = True
        while changed:
            changed = False
            for lhs, rhs in self.prods:
                tail = set(follow[lhs])
                for s in reversed(rhs):
                    if s in follow:
                        if not tail <= follow[s]:
                            follow[s] |= tail
                            changed = True
                        tail = tail | first[s] if s in nullable else set(first[s])
                    else:
                        tail = {s}
        self.follow = follow


class Recognizer:
    """Runs token ids (from ``ids``) over a grammar. ``newline``: the token that stands for a line break where a missing
    ``;`` may be supplied before the token that follows, as it also may before the tokens ``closers``."""

    def __init__(self, grammar: Grammar, newline: bool = False, closers: tuple[str, ...] = ()):
        self.g = grammar
        self.ids: dict[str, int] = {t: i for i, t in enumerate(grammar.terminals)}
        self.width = len(self.ids) + 2
        self.error = len(self.ids)
        self.newline = len(self.ids) + 1 if newline else -1
        self.names = {i: t for t, i in self.ids.items()}
        self.closers = {self.ids[c] for c in closers}
        self._states: dict[frozenset, int] = {}
        self._kernels: list[frozenset] = []
        self._goto: list[dict[str, int] | None] = []
        self._reduce: list[list[tuple[str, int, set[str]]]] = []
        self.reset()
        _all.add(self)

    def held(self) -> int:
        return len(self.step) + len(self.state) + len(self.configs)

    def reset(self) -> None:
        self.state: list[int] = []
        self.parent: list[int] = []
        self._node: dict[tuple[int, int], int] = {}
        self._config: dict[tuple[int, ...], int] = {}
        self.configs: list[tuple[int, ...]] = []
        self.step: dict[int, int] = {}
        last = len(self.g.prods) - 1
        root = self._push(self._state(frozenset([(last, 0)])), -1)
        self.start = self._intern((root,))

    def _state(self, kernel: frozenset) -> int:
        if kernel not in self._states:
            self._states[kernel] = len(self._kernels)
            self._kernels.append(kernel)
            self._goto.append(None)
            self._reduce.append([])
        return self._states[kernel]

    def _expand(self, s: int) -> None:
        g = self.g
        items, todo = set(self._kernels[s]), list(self._kernels[s])
        moves: dict[str, set] = {}
        seen: set[str] = set()
        for p, d in todo:
            lhs, rhs = g.prods[p]
            if d == len(rhs):
                self._reduce[s].append((lhs, d, g.follow[lhs]))
                continue
            sym = rhs[d]
            moves.setdefault(sym, set()).add((p, d + 1))
            if sym in g.by and sym not in seen:
                seen.add(sym)
                for q in g.by[sym]:
                    if (q, 0) not in items:
                        items.add((q, 0))
                        todo.append((q, 0))
        self._goto[s] = {sym: self._state(frozenset(k)) for sym, k in moves.items()}

    def _push(self, state: int, parent: int) -> int:
        key = (state, parent)
        n = self._node.get(key)
        if n is None:
            n = self._node[key] = len(self.state)
            self.state.append(state)
            self.parent.append(parent)
        return n

    def _intern(self, nodes: tuple[int, ...]) -> int:
        c = self._config.get(nodes)
        if c is None:
            c = self._config[nodes] = len(self.configs) * 2
            self.configs.append(nodes)
        return c

    def _advance(self, config: int, token: int) -> int:
        """The configuration after ``token``, -1 if no stack can take it."""
        name = self.names.get(token)
        if name is None:
            return -1
        todo = list(self.configs[config >> 1])
        seen = set(todo)
        out = set()
        for n in todo:
            s = self.state[n]
            if self._goto[s] is None:
                self._expand(s)
            for lhs, size, follow in self._reduce[s]:
                if name in follow:
                    at = n
                    for _ in range(size):
                        at = self.parent[at]
                    below = self.state[at]
                    if self._goto[below] is None:
                        self._expand(below)
                    new = self._push(self._goto[below][lhs], at)
                    if new not in seen:
                        seen.add(new)
                        todo.append(new)
            to = self._goto[s].get(name)
            if to is not None:
                out.add(self._push(to, n))
        return self._intern(tuple(sorted(out))) if out else -1

    def miss(self, config: int, token: int) -> int:
        """Fills in a step; an odd configuration is one after a line break."""
        if token == self.newline:
            new = config | 1
        else:
            even = config & ~1
            new = self._advance(even, token)
            if new < 0 and self.newline >= 0 and (config & 1 or token in self.closers) and token != self.error:
                semi = self._advance(even, self.ids[SEMI])
                if semi >= 0:
                    new = self._advance(semi, token)
        self.step[config * self.width + token] = new
        return new

    def first_bad(self, tokens: list[int]) -> int:
        """Index of the first token that no parse can take (``len(tokens)`` for the end of the input), -1 if none."""
        if sum(r.held() for r in _all) > ROOM:
            for r in _all:
                r.reset()
        step, width, config = self.step, self.width, self.start
        get = step.get
        end = self.ids[END]
        i = -1
        for i, t in enumerate(tokens):
            new = get(config * width + t)
            if new is None:
                new = self.miss(config, t)
            if new < 0:
                return i
            config = new
        new = get(config * width + end)
        if new is None:
            new = self.miss(config, end)
        return i + 1 if new < 0 else -1
