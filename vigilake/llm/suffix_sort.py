"""Deep-shallow sorting of the suffixes of one bucket, with their common prefixes.

Multikey quicksort orders strings byte by byte down to a shallow depth. What is
still tied there has long common prefixes; such a group goes into a blind trie,
which looks at branching bytes only and compares one string per insertion.
"""

from __future__ import annotations

SHALLOW = 8
END = -1


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be `start` at least."""
    low, high = start, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class BlindTrie:
    """Inner nodes are `[depth, {byte: child}]`, leaves the lists of equal strings' numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    @staticmethod
    def _is_leaf(node: list) -> bool:
        return not (len(node) == 2 and isinstance(node[1], dict))

    def _byte(self, text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else END

    def insert(self, number: int, known: int) -> None:
        text = self.strings[number]
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while not self._is_leaf(node):  # blind: bytes between branchings are not looked at
            node = node[1].get(self._byte(text, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        shared = common_prefix(text, other, known)
        if shared == len(text) == len(other):
            node.append(number)
            return
        above, at = None, self.root
        while not self._is_leaf(at) and at[0] < shared:
            above, at = at, at[1][self._byte(text, at[0])]
        if not self._is_leaf(at) and at[0] == shared:
            at[1][self._byte(text, shared)] = [number]
            return
        branch = [shared, {self._byte(other, shared): at, self._byte(text, shared): [number]}]
        if above is None:
            self.root = branch
        else:
            above[1][self._byte(text, above[0])] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in order of their strings, and the common prefix of each with the one before."""
        order: list[int] = []
        shared: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if self._is_leaf(node):
                for i, number in enumerate(node):
                    order.append(number)
                    shared.append(before if i == 0 else len(self.strings[number]))
                continue
            keys = sorted(node[1])
            for i in range(len(keys) - 1, -1, -1):
                stack.append((node[1][keys[i]], before if i == 0 else node[0]))
        return order, shared


def deep_shallow_sort(strings: list[bytes], known: int = 0) -> tuple[list[int], list[int]]:
    """Order of the strings and each one's common prefix with the one before it (-1 for the first).

    All strings are known to share their first `known` bytes.
    """
    order: list[int] = []
    shared: list[int] = []
    # (members, depth at which they are tied, prefix shared with the string before the group)
    stack = [(list(range(len(strings))), known, -1)]
    while stack:
        members, depth, before = stack.pop()
        if len(members) == 1:
            order += members
            shared.append(before)
        elif depth >= known + SHALLOW:
            trie = BlindTrie(strings)
            for number in members:
                trie.insert(number, depth)
            got, prefixes = trie.ordered()
            order += got
            shared += [before, *prefixes[1:]]
        else:
            byte = [strings[m][depth] if depth < len(strings[m]) else END for m in members]
            pivot = byte[len(byte) // 2]
            less = [m for m, b in zip(members, byte) if b < pivot]
            same = [m for m, b in zip(members, byte) if b == pivot]
            more = [m for m, b in zip(members, byte) if b > pivot]
            if more:
                stack.append((more, depth, depth))
            if pivot == END:  # these strings end here and are equal; nothing sorts before an end
                order += same
                shared += [before] + [depth] * (len(same) - 1)
            else:
                stack.append((same, depth + 1, depth if less else before))
                if less:
                    stack.append((less, depth, before))
    return order, shared
