"""LR tables for a small grammar of roles, and the repair of a row sequence on a graph-structured stack.

The table is built from productions (item sets, first and follow sets). A repair reads rows one by
one and keeps, for every stack top, the cheapest way to it: each row can be kept, given another role
or deleted, and rows can be inserted before it. Stacks share their lower parts as linked nodes. Two
stacks with the same top are merged by the minimum of (cost, audit); in grammars like this one, where
what may follow depends on the top state alone, the merged stack stands for both.

Audits are never compared as strings. Right after a row all audits have consumed the same rows and
end in a row's letter, so none is a proper prefix of another, and the order of two longer audits is
that of their beginnings, then of the new letters. A number per top, the rank of its audit among the
tops, is all that is kept of the past; the letters are found at last by walking back.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

END = "$"
#: Nothing, or an optional system row and one or more user-assistant pairs.
ROLE_GRAMMAR = (
    ("Start", ()), ("Start", ("Talk",)), ("Talk", ("s", "Pairs")), ("Talk", ("Pairs",)),
    ("Pairs", ("Pairs", "u", "a")), ("Pairs", ("u", "a")),
)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


@dataclass
class LRTable:
    """Shift, reduce and goto tables; raises where the grammar needs more than one symbol ahead."""

    productions: tuple = ROLE_GRAMMAR
    action: dict = field(default_factory=dict)
    goto: dict = field(default_factory=dict)
    n_states: int = 0

    def __post_init__(self) -> None:
        rules = (("All", (self.productions[0][0],)), *self.productions)
        heads = {head for head, _ in rules}
        follow = self._follow(rules, heads)
        states = [self._closed({(0, 0)}, rules, heads)]
        for number, items in enumerate(states):  # grows while it runs
            moves: dict[str, set] = {}
            for rule, dot in items:
                head, body = rules[rule]
                if dot < len(body):
                    moves.setdefault(body[dot], set()).add((rule, dot + 1))
                    continue
                for symbol in follow[head]:
                    self._put(number, symbol, ("accept",) if rule == 0 else ("reduce", head, len(body)))
            for symbol, kernel in sorted(moves.items()):
                target = self._closed(kernel, rules, heads)
                if target not in states:
                    states.append(target)
                if symbol in heads:
                    self.goto[number, symbol] = states.index(target)
                else:
                    self._put(number, symbol, ("shift", states.index(target)))
        self.n_states = len(states)
        self.shifted = lru_cache(maxsize=4096)(self._shifted)

    def _put(self, state: int, symbol: str, action: tuple) -> None:
        if self.action.setdefault((state, symbol), action) != action:
            raise ValueError(f"the grammar is ambiguous at {symbol!r}")

    @staticmethod
    def _closed(kernel: set, rules: tuple, heads: set) -> frozenset:
        items, new = set(kernel), list(kernel)
        while new:
            rule, dot = new.pop()
            body = rules[rule][1]
            if dot < len(body) and body[dot] in heads:
                for i, (head, _) in enumerate(rules):
                    if head == body[dot] and (i, 0) not in items:
                        items.add((i, 0))
                        new.append((i, 0))
        return frozenset(items)

    @staticmethod
    def _follow(rules: tuple, heads: set) -> dict[str, set]:
        empty = {head for head, body in rules if not body}
        while more := {h for h, body in rules if h not in empty and all(x in empty for x in body)}:
            empty |= more
        first: dict[str, set] = {h: set() for h in heads}
        follow: dict[str, set] = {h: set() for h in heads}
        follow["All"] = {END}
        while True:
            before = sum(map(len, (*first.values(), *follow.values())))
            for head, body in rules:
                for i, symbol in enumerate(body):
                    if all(x in empty for x in body[:i]):
                        first[head] |= first.get(symbol, {symbol})
                    if symbol in heads:
                        rest = i + 1
                        while rest < len(body):
                            follow[symbol] |= first.get(body[rest], {body[rest]})
                            if body[rest] not in empty:
                                break
                            rest += 1
                        else:
                            follow[symbol] |= follow[head]
            if before == sum(map(len, (*first.values(), *follow.values()))):
                return follow

    @property
    def empty_stack(self) -> tuple:
        return (0, None)

    def _reduced(self, stack: tuple, symbol: str) -> tuple[tuple, tuple | None]:
        """The stack after the reductions that ``symbol`` calls for, and what it calls for then."""
        while (action := self.action.get((stack[0], symbol))) and action[0] == "reduce":
            for _ in range(action[2]):
                stack = stack[1]
            stack = (self.goto[stack[0], action[1]], stack)
        return stack, action

    def _shifted(self, stack: tuple, symbol: str) -> tuple | None:
        stack, action = self._reduced(stack, symbol)
        return (action[1], stack) if action else None

    def accepts(self, stack: tuple) -> bool:
        return self._reduced(stack, END)[1] is not None


class Repair:
    """The cheapest edits of one sequence of rows; ``row`` for each, then ``finish``.

    Holds two bytes per row and state of the table, besides at most one stack per state.
    """

    def __init__(self, table: LRTable, costs: Costs = Costs(), roles: Sequence[str] = ("u", "a")):
        self.table, self.costs, self.roles = table, costs, tuple(roles)
        # state -> (cost, rank, stack)
        self.tops = {table.empty_stack[0]: (0, 0, table.empty_stack)}
        self.back = array("H")
        self.n_rows = 0

    def _with_inserts(self) -> list[tuple]:
        """(cost, rank, inserts, state before, stack): the best for each top, rows inserted or not."""
        best = {state: (cost, rank, 0, state, stack) for state, (cost, rank, stack) in self.tops.items()}
        new = list(best.values())
        while new:
            reached = []
            for cost, rank, inserts, origin, stack in new:
                for role in self.roles:
                    longer = self.table.shifted(stack, role)
                    if longer is None:
                        continue
                    way = (cost + self.costs.insert, rank, inserts + 1, origin, longer)
                    if longer[0] not in best or way[:3] < best[longer[0]][:3]:
                        best[longer[0]] = way
                        reached.append(way)
            new = reached
        return list(best.values())

    def row(self, symbol: str, must_go: bool, truncated: bool) -> None:
        """The next row: its role's symbol, whether it has to be deleted, whether it is cut short."""
        ways: dict[int, tuple] = {}

        def offer(stack: tuple | None, cost: int, rank: int, letters: str, origin: int) -> None:
            if stack is not None:
                way = (cost, rank, letters, origin, stack)
                if stack[0] not in ways or way[:3] < ways[stack[0]][:3]:
                    ways[stack[0]] = way

        extra = self.costs.truncated if truncated else 0
        for cost, rank, inserts, origin, stack in self._with_inserts():
            before = INSERT * inserts
            offer(stack, cost + self.costs.delete, rank, before + DELETE, origin)
            if not must_go:
                offer(self.table.shifted(stack, symbol), cost + extra, rank, before + KEEP, origin)
                for role in self.roles:
                    offer(self.table.shifted(stack, role), cost + self.costs.rerole + extra, rank, before + REROLE, origin)
        ranks = {key: i for i, key in enumerate(sorted({way[1:3] for way in ways.values()}))}
        self.tops = {state: (way[0], ranks[way[1:3]], way[4]) for state, way in ways.items()}
        step = [0] * self.table.n_states
        for state, (_, _, letters, origin, _) in ways.items():
            step[state] = (origin << 10) | ((len(letters) - 1) << 2) | "DKR".index(letters[-1])
        self.back.extend(step)
        self.n_rows += 1

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits, ties by the least audit."""
        ends = [way for way in self._with_inserts() if self.table.accepts(way[4])]
        cost, _, inserts, state, _ = min(ends, key=lambda way: way[:3])
        audit = [INSERT * inserts]
        for at in range((self.n_rows - 1) * self.table.n_states, -1, -self.table.n_states):
            step = self.back[at + state]
            audit.append(INSERT * (step >> 2 & 255) + "DKR"[step & 3])
            state = step >> 10
        return cost, "".join(reversed(audit))


class Replay:
    """Applies an audit to the rows it was made for, and names the roles of new and changed rows."""

    def __init__(self, table: LRTable, audit: str, names: dict[str, str]):
        self.table, self.audit, self.names = table, audit, names
        self.stack, self.at = table.empty_stack, 0

    def _free_role(self) -> str:
        for symbol, name in self.names.items():
            if stack := self.table.shifted(self.stack, symbol):
                self.stack = stack
                return name
        raise ValueError("the audit does not fit the grammar")

    def inserted(self) -> list[str]:
        """Roles of the rows to be inserted here."""
        roles = []
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            roles.append(self._free_role())
        return roles

    def row(self, role: str) -> tuple[str, str | None]:
        """The letter of the next row and the role it gets; none if it is deleted."""
        letter = self.audit[self.at]
        self.at += 1
        if letter == REROLE:
            return letter, self._free_role()
        if letter == KEEP:
            self.stack = self.table.shifted(self.stack, role[:1])
            return letter, role
        return letter, None
