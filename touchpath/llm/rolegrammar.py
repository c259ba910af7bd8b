"""LR automaton of the role grammar and its generalised repair over a graph-structured stack.

Productions are pairs (head, body) over one-letter terminals and capital non-terminals. The stack of a parse is a chain of
nodes (state, node below); equal chains are one node, so all parses of a prefix share what they have in common. Every
input position holds one survivor per stack top: paths that reach an equal top are merged by the smallest (cost, audit).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

END = "$"
#: (s? (ua)+)?  H: a conversation with at least one exchange, T: one exchange.
ROLE_GRAMMAR = (("Z", "C"), ("C", ""), ("C", "H"), ("H", "sT"), ("H", "T"), ("H", "HT"), ("T", "ua"))

Item = tuple[int, int]


class Automaton:
    """SLR states of a grammar whose first production is the augmented start."""

    def __init__(self, grammar: Iterable[tuple[str, str]] = ROLE_GRAMMAR) -> None:
        self.grammar = tuple(grammar)
        self.follow = self._follow()
        start = self._closure({(0, 0)})
        self.states = [start]
        self.goto: dict[tuple[int, str], int] = {}
        for number, items in enumerate(self.states):  # the list grows while it is read
            for symbol in sorted({self.grammar[p][1][dot] for p, dot in items if dot < len(self.grammar[p][1])}):
                kernel = {(p, dot + 1) for p, dot in items if self.grammar[p][1][dot : dot + 1] == symbol}
                target = self._closure(kernel)
                if target not in self.states:
                    self.states.append(target)
                self.goto[number, symbol] = self.states.index(target)
        self.accepting = {i for i, items in enumerate(self.states) if (0, 1) in items}

    def _closure(self, kernel: set[Item]) -> frozenset[Item]:
        items, todo = set(kernel), list(kernel)
        while todo:
            p, dot = todo.pop()
            after = self.grammar[p][1][dot : dot + 1]
            for q, (head, _) in enumerate(self.grammar):
                if head == after and (q, 0) not in items:
                    items.add((q, 0))
                    todo.append((q, 0))
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        heads = {head for head, _ in self.grammar}
        empty = {head for head, body in self.grammar if not body}
        empty |= {head for head, body in self.grammar if all(x in empty for x in body)}
        first: dict[str, set[str]] = {h: set() for h in heads}
        follow: dict[str, set[str]] = {h: set() for h in heads} | {self.grammar[0][0]: {END}}
        for _ in range(len(self.grammar) ** 2):
            for head, body in self.grammar:
                for x in body:
                    first[head] |= first.get(x, {x})
                    if x not in empty:
                        break
                for i, x in enumerate(body):
                    if x in heads:
                        rest = body[i + 1 :]
                        for y in rest:
                            follow[x] |= first.get(y, {y})
                            if y not in empty:
                                break
                        else:
                            follow[x] |= follow[head]
        return follow

    def reductions(self, state: int, ahead: str) -> list[int]:
        """Productions that ``state`` may reduce before ``ahead``."""
        return [p for p, dot in sorted(self.states[state]) if p and dot == len(self.grammar[p][1]) and ahead in self.follow[self.grammar[p][0]]]


@dataclass(frozen=True, eq=False)
class Node:
    """A stack: its top state and what lies below. Interned by ``Stacks``, so identity is equality."""

    state: int
    below: Node | None
    moves: dict[str, tuple[Node, ...]] = field(default_factory=dict)


class Stacks:
    """The graph of stacks and their moves, each computed when first needed."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self._nodes: dict[tuple[int, Node | None], Node] = {}
        self.start = self.node(0, None)

    def node(self, state: int, below: Node | None) -> Node:
        return self._nodes.setdefault((state, below), Node(state, below))

    def _reduced(self, top: Node, ahead: str) -> list[Node]:
        """``top`` and all stacks that reductions before ``ahead`` make of it."""
        found, todo = [top], [top]
        while todo:
            node = todo.pop()
            for p in self.automaton.reductions(node.state, ahead):
                head, body = self.automaton.grammar[p]
                base = node
                for _ in body:
                    base = base.below
                made = self.node(self.automaton.goto[base.state, head], base)
                if made not in found:
                    found.append(made)
                    todo.append(made)
        return found

    def shift(self, top: Node, symbol: str) -> tuple[Node, ...]:
        """Stacks after ``symbol``, settled: a handle that only one reduction can follow is reduced at once."""
        if symbol not in top.moves:
            shifted = [self.node(self.automaton.goto[n.state, symbol], n) for n in self._reduced(top, symbol) if (n.state, symbol) in self.automaton.goto]
            top.moves[symbol] = tuple(dict.fromkeys(self._settled(n) for n in shifted))
        return top.moves[symbol]

    def _settled(self, node: Node) -> Node:
        while True:
            items = self.automaton.states[node.state]
            if len(items) != 1 or (only := next(iter(items)))[1] < len(self.automaton.grammar[only[0]][1]) or not only[0]:
                return node
            base = node
            for _ in self.automaton.grammar[only[0]][1]:
                base = base.below
            node = self.node(self.automaton.goto[base.state, self.automaton.grammar[only[0]][0]], base)

    def accepts(self, top: Node) -> bool:
        return any(n.state in self.automaton.accepting for n in self._reduced(top, END))


@lru_cache(maxsize=1)
def role_stacks() -> Stacks:
    return Stacks(Automaton())


@dataclass(frozen=True)
class Costs:
    """Weights of the edits; ``truncated`` is added for a truncated row that stays. Keeping costs nothing."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


COSTS = Costs()
DELETE, INSERT, KEEP, REROLE = "DIKR"
Best = tuple[int, str]


class Repair:
    """The cheapest edits of one conversation, row by row.

    ``tops`` holds the survivor (cost, audit) of every stack top. ``settled`` hands out the edits that all survivors have
    in common, so that neither rows nor audits pile up while a long conversation passes.
    """

    def __init__(self, stacks: Stacks | None = None, costs: Costs = COSTS, inserted: str = "ua") -> None:
        self.stacks = stacks or role_stacks()
        self.costs = costs
        self.inserted = inserted
        self.tops: dict[int, tuple[int, str, Node]] = {}
        self._merge(self.tops, 0, "", self.stacks.start)
        self._insert()

    @staticmethod
    def _merge(tops: dict[int, tuple[int, str, Node]], cost: int, audit: str, node: Node) -> bool:
        known = tops.get(node.state)
        if known is None or (cost, audit) < known[:2]:
            tops[node.state] = (cost, audit, node)
            return True
        return False

    def _insert(self) -> None:
        """Insertions at this position, until no top gets cheaper."""
        todo = list(self.tops)
        while todo:
            cost, audit, node = self.tops[todo.pop()]
            for symbol in self.inserted:
                for after in self.stacks.shift(node, symbol):
                    if self._merge(self.tops, cost + self.costs.insert, audit + INSERT, after):
                        todo.append(after.state)

    def row(self, symbol: str | None, must_go: bool, truncated: bool) -> None:
        """The next row; ``symbol`` is None where the grammar has no terminal for its role."""
        tops: dict[int, tuple[int, str, Node]] = {}
        extra = self.costs.truncated if truncated else 0
        for cost, audit, node in self.tops.values():
            self._merge(tops, cost + self.costs.delete, audit + DELETE, node)
            if must_go:
                continue
            if symbol is not None:
                for after in self.stacks.shift(node, symbol):
                    self._merge(tops, cost + extra, audit + KEEP, after)
            for other in self.inserted:
                for after in self.stacks.shift(node, other):
                    self._merge(tops, cost + extra + self.costs.rerole, audit + REROLE, after)
        self.tops = tops
        self._insert()
        self._drop_beaten()

    def _drop_beaten(self) -> None:
        """Tops that can no longer win.

        What may follow a finished exchange may follow any other top too, but for a system row that only the empty stack
        can still keep; behind an exchange deleting that row costs one deletion more.
        """
        done = [cost for cost, _, node in self.tops.values() if node.below is not None and self.stacks.accepts(node)]
        if done:
            least = min(done)
            for state, (cost, _, node) in list(self.tops.items()):
                if cost > least + (self.costs.delete if node.below is None else 0) and "u" in self._follows(node):
                    del self.tops[state]

    def _follows(self, node: Node) -> str:
        return "".join(s for s in self.inserted if self.stacks.shift(node, s))

    def settled(self) -> str:
        """Edits common to all survivors, taken off their audits."""
        audits = [audit for _, audit, _ in self.tops.values()]
        low, high = min(audits), max(audits)
        n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        self.tops = {state: (cost, audit[n:], node) for state, (cost, audit, node) in self.tops.items()}
        return low[:n]

    def finish(self) -> Best:
        """(cost, rest of the audit) of the cheapest accepted stack."""
        return min((cost, audit) for cost, audit, node in self.tops.values() if self.stacks.accepts(node))
