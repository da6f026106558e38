"""Cheapest edits that make a sequence of messages read ``(s?(ua)+)?``, as costs and decisions of single steps.

The states say which messages may follow: ``START`` (system or user), ``AFTER_SYSTEM`` (user), ``AFTER_USER``
(assistant), ``AFTER_ASSISTANT`` (user, or the end). A cost vector holds for each state the least cost of all edits from
a place to the end of the conversation. Vectors are kept with their minimum taken off, so that vectors that differ only
by a constant are equal and few different ones exist; what a step does to a vector is therefore worked out once.
"""

from __future__ import annotations

from collections.abc import Sequence

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: Classes of a role's initial.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
#: What a message is: ``3 * class of its role + fault``.
FINE, TRUNCATED, MUST_GO = range(3)

#: Costs of the edits, and of a truncated message that stays.
REROLE, DELETE, INSERT, KEPT_TRUNCATED = 2, 3, 2, 1

#: The state after the role that may always follow (user, but assistant after user).
_ON = {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_USER: AFTER_ASSISTANT, AFTER_ASSISTANT: AFTER_USER}
#: The initials that may be kept in a state, and the state after them.
_KEEP = {(START, SYSTEM): AFTER_SYSTEM, (START, USER): AFTER_USER, (AFTER_SYSTEM, USER): AFTER_USER,
         (AFTER_USER, ASSISTANT): AFTER_ASSISTANT, (AFTER_ASSISTANT, USER): AFTER_USER}
#: Costs after the last message: what has to be inserted to end lawfully.
END = (0, 2 * INSERT, INSERT, 0)
#: Classes of neighbours that may stand so.
LAWFUL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

Vector = tuple[int, ...]


def inserted(state: int) -> str:
    """Action that inserts the role that may follow: ``U`` or ``A``."""
    return "A" if state == AFTER_USER else "U"


def tail(state: int) -> str:
    """Inserts after the last message."""
    actions = ""
    while state not in (START, AFTER_ASSISTANT):
        actions, state = actions + inserted(state), _ON[state]
    return actions


def ways(after: Vector, code: int, state: int) -> list[tuple[int, str, int]]:
    """(cost to the end, action, next state) of each edit that uses up the message, in ASCII order of the edits."""
    kind, fault = divmod(code, 3)
    found = [(DELETE + after[state], "D", state)]
    if fault != MUST_GO:
        extra = KEPT_TRUNCATED if fault == TRUNCATED else 0
        if (state, kind) in _KEEP:
            found.append((extra + after[_KEEP[state, kind]], "K", _KEEP[state, kind]))
        found.append((REROLE + extra + after[_ON[state]], inserted(state).lower(), _ON[state]))
    return found


class Steps:
    """Steps over one message, worked out when first asked for."""

    def __init__(self) -> None:
        self._before: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self._choices: dict[tuple[Vector, int], tuple[tuple[str, int], ...]] = {}

    def _costs(self, after: Vector, code: int) -> list[int]:
        costs = [min(way[0] for way in ways(after, code, s)) for s in range(4)]
        for _ in range(3):  # Inserts before the message lead through three more states at most.
            costs = [min(c, INSERT + costs[_ON[s]]) for s, c in enumerate(costs)]
        return costs

    def before(self, after: Vector, code: int) -> tuple[Vector, int]:
        """The vector before a message, given the one after it, and the minimum that was taken off."""
        key = after, code
        if key not in self._before:
            costs = self._costs(after, code)
            least = min(costs)
            self._before[key] = tuple(c - least for c in costs), least
        return self._before[key]

    def choices(self, after: Vector, code: int) -> tuple[tuple[str, int], ...]:
        """For each state: the cheapest actions up to and with the message, ASCII-least, and the state after it."""
        key = after, code
        if key not in self._choices:
            costs = self._costs(after, code)
            self._choices[key] = tuple(self._least(after, code, costs, s) for s in range(4))
        return self._choices[key]

    @staticmethod
    def _least(after: Vector, code: int, costs: list[int], state: int) -> tuple[str, int]:
        actions = ""
        while True:
            best = [way for way in ways(after, code, state) if way[0] == costs[state]]
            insert = costs[state] == INSERT + costs[_ON[state]]
            # D before I before K before R.
            if best and (best[0][1] == "D" or not insert):
                return actions + best[0][1], best[0][2]
            actions, state = actions + inserted(state), _ON[state]

    def start(self, codes: Sequence[int], end: Vector) -> tuple[Vector, int]:
        """The vector before a chunk, given the one after it, and the sum of the minima taken off."""
        vector, total = end, 0
        for code in reversed(codes):
            vector, least = self.before(vector, code)
            total += least
        return vector, total

    def mended(self, codes: Sequence[int], old_end: Vector, old: tuple[Vector, int], end: Vector) -> tuple[Vector, int]:
        """``start`` for another end: goes on only until the old and the new vector differ by a constant."""
        vector, was, total, had = end, old_end, 0, 0
        for code in reversed(codes):
            if vector == was:
                return old[0], old[1] + total - had
            vector, least = self.before(vector, code)
            was, least_then = self.before(was, code)
            total, had = total + least, had + least_then
        return vector, total

    def decisions(self, codes: Sequence[int], end: Vector) -> list[tuple[tuple[str, int], ...]]:
        """``choices`` of each message of a chunk."""
        vector, found = end, []
        for code in reversed(codes):
            found.append(self.choices(vector, code))
            vector, _ = self.before(vector, code)
        return found[::-1]


def exits(decisions: list[tuple[tuple[str, int], ...]]) -> list[int]:
    """The state after a chunk for each state before it."""
    states = list(range(4))
    for choice in decisions:
        states = [choice[s][1] for s in states]
    return states


def traced(decisions: list[tuple[tuple[str, int], ...]], state: int) -> tuple[list[str], int]:
    """The actions at each message of a chunk, and the state after it."""
    actions = []
    for choice in decisions:
        action, state = choice[state]
        actions.append(action)
    return actions, state


def unlawful(codes: Sequence[int]) -> int:
    """Neighbours in a chunk whose initials are not ``su``, ``ua`` or ``au``."""
    kinds = [code // 3 for code in codes]
    return sum(pair not in LAWFUL for pair in zip(kinds, kinds[1:], strict=False))
