"""Compressed tries on bytes."""

from __future__ import annotations

from collections.abc import Iterator


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of ``a`` and ``b``, which agree on the first ``at`` bytes."""
    top = min(len(a), len(b))
    if a[at:top] == b[at:top]:
        return top
    step = 16
    while a[at:at + step] == b[at:at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at:at + step] == b[at:at + step]:
            at += step
    return at


class RadixTrie:
    """Whole texts; a terminal keeps the smallest id inserted there (None: only null ids).

    A node is ``[label, children by first byte, is a terminal, smallest id]``.
    """

    def __init__(self):
        self.root, self.size = [b"", {}, False, None], 0

    def insert(self, text: bytes, ident) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, True, ident]
                self.size += len(text) - at
                return
            label = child[0]
            if not text.startswith(label, at):
                rest = text[at:]
                k = shared(label, rest)
                upper = [label[:k], {label[k]: child}, False, None]
                node[1][text[at]] = upper
                child[0] = label[k:]
                child = upper
            at += len(child[0])
            node = child
        if not node[2]:
            node[2], node[3] = True, ident
        elif ident is not None and (node[3] is None or ident < node[3]):
            node[3] = ident

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """Every text once, with its id, in byte order."""
        stack = [(self.root, b"")]
        while stack:
            (label, children, there, ident), before = stack.pop()
            text = before + label
            if there:
                yield text, ident
            stack += [(children[k], text) for k in sorted(children, reverse=True)]
