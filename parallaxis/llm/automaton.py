"""Regular expressions to one minimised byte automaton.

A small parser turns each rule (literals, classes, groups, alternation and the
quantifiers ? * + {m} {m,} {m,n}) into a tree, the tree into an NFA over bytes, and
subset construction over all rules together into one DFA, which partition
refinement then minimises. Rules use ASCII only; every other byte is "no rule's byte".
"""

from __future__ import annotations

ALL = frozenset(range(256))


def parse(pattern: str, ignore_case: bool = False):
    """A tree of ("set", bytes) ("cat", [..]) ("or", [..]) ("rep", node, low, high)."""
    at = 0

    def fold(chars):
        if not ignore_case:
            return frozenset(chars)
        return frozenset(ord(x) for c in chars for x in (chr(c).lower(), chr(c).upper()))

    def escape():
        nonlocal at
        at += 1
        if pattern[at] == "x":
            at += 3
            return int(pattern[at - 2 : at], 16)
        at += 1
        return ord(pattern[at - 1])

    def bracket():
        nonlocal at
        at += 1
        negated = pattern[at] == "^"
        at += negated
        members = set()

        def member():
            nonlocal at
            if pattern[at] == "\\":
                return escape()
            at += 1
            return ord(pattern[at - 1])

        while pattern[at] != "]":
            low = high = member()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = member()
            members.update(range(low, high + 1))
        at += 1
        return ("set", ALL - frozenset(members) if negated else fold(members))

    def atom():
        nonlocal at
        c = pattern[at]
        if c == "(":
            at += 1
            node = union()
            at += 1
            return node
        if c == "[":
            return bracket()
        if c == "\\":
            return ("set", fold([escape()]))
        at += 1
        return ("set", fold([ord(c)]))

    def repeated():
        nonlocal at
        node = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : end].partition(",")
                bounds = (int(low), int(high) if high else (None if comma else int(low)))
                at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                at += 1
            node = ("rep", node, *bounds)
        return node

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def union():
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", options)

    tree = union()
    if at != len(pattern):
        raise ValueError(f"cannot parse {pattern!r} at {at}")
    return tree


def mirrored(tree):
    """The tree of the reversed language."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [mirrored(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [mirrored(x) for x in tree[1]])
    if kind == "rep":
        return ("rep", mirrored(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, tree, start: int) -> int:
        """Add a tree that begins at a state; its end state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.build(part, begin)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.build(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.build(inner, start)
            self.empty[start].append(end)
        return end


class Dfa:
    """table[state * width + byte class] is the next state times width; accepts[state] is a bit mask of rules.

    classes maps a byte to its class. State 0 starts. States from first_accept on accept.
    """

    def __init__(self, classes: bytes, width: int, table: list[int], accepts: list[int], first_accept: int):
        self.classes, self.width, self.table, self.accepts, self.first_accept = classes, width, table, accepts, first_accept


def compile_rules(trees, unanchored: bool) -> Dfa:
    """One automaton for all trees; unanchored: a match may begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for rule, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[start].append(begin)
        ends[nfa.build(tree, begin)] = 1 << rule
    return _determinise(nfa, start, ends, unanchored)


def _determinise(nfa: _Nfa, start: int, ends: dict[int, int], unanchored: bool) -> Dfa:
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature = {}
    classes = bytearray(256)
    for byte in range(256):
        key = tuple(byte in s for s in sets)
        classes[byte] = signature.setdefault(key, len(signature))
    width = len(signature)
    sample = [0] * width
    for byte in range(255, -1, -1):
        sample[classes[byte]] = byte
    by_class = [[[t for s, t in moves if sample[c] in s] for c in range(width)] for moves in nfa.moves]

    closures: dict[int, frozenset] = {}

    def closure(state: int) -> frozenset:
        if state not in closures:
            seen, todo = {state}, [state]
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            closures[state] = frozenset(x for x in seen if nfa.moves[x] or x in ends)
        return closures[state]

    first = closure(start)
    numbers, todo, rows, accepts = {first: 0}, [first], [], []
    while todo:
        now = todo.pop(0)
        accepts.append(sum({ends[x] for x in now if x in ends}))
        row = []
        for c in range(width):
            target: set = set()
            for x in now:
                for t in by_class[x][c]:
                    target |= closure(t)
            if unanchored:
                target |= first
            key = frozenset(target)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            row.append(numbers[key])
        rows.append(row)
    return _minimise(bytes(classes), width, rows, accepts)


def _minimise(classes: bytes, width: int, rows: list[list[int]], accepts: list[int]) -> Dfa:
    """Refine the partition by accept mask until no block splits, then number plain states first."""
    masks: dict[int, int] = {}
    block = [masks.setdefault(a, len(masks)) for a in accepts]
    while True:
        keys: dict[tuple, int] = {}
        refined = [keys.setdefault((block[s], *(block[t] for t in rows[s])), len(keys)) for s in range(len(rows))]
        if len(keys) == len(set(block)):
            break
        block = refined
    member = {b: s for s, b in reversed(list(enumerate(block)))}
    order = sorted(member, key=lambda b: (accepts[member[b]] != 0, b != block[0], b))
    number = {b: i for i, b in enumerate(order)}
    table = [number[block[t]] * width for b in order for t in rows[member[b]]]
    marks = [accepts[member[b]] for b in order]
    return Dfa(classes, width, table, marks, next((i for i, a in enumerate(marks) if a), len(marks)))
