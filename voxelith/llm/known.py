"""What a worker process has found out about distinct words, within bounded memory."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

#: Bytes of words and of what is kept for them, about, in each of two generations; more where a word takes long.
ROOM, MUCH = 16_000_000, 48_000_000
#: Of an entry beside its word's letters: two objects' heads and a place in a dict.
HEAD = 160
#: Words with more letters than this are never remembered for long.
LONG = 64


def _size(word: str, value: Any) -> int:
    return HEAD + len(word) + (len(value) if isinstance(value, bytes) else 8 * len(value))


class Known:
    """Values of words in two generations: when ``young`` is full it becomes the old one, and the old one goes.

    Words that are met again move back to ``young``, so the frequent ones stay. Both generations together hold about twice
    ``room`` bytes, whatever the words' lengths. Use: ``begin``, ``missing``, ``learn`` what is missing, look up in
    ``young``, ``forget``.
    """

    def __init__(self, room: int = ROOM):
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.room, self.used = room, 0

    def __reduce__(self):
        return Known, (self.room,)  # a worker starts with none

    def begin(self) -> None:
        """Make room. What is known from here on stays until the next call."""
        if self.used > self.room:
            self.old, self.young, self.used = self.young, {}, 0

    def missing(self, words: set[str]) -> list[str]:
        """The ``words`` that neither generation has; those of the old one are young from now on."""
        out, old = words.difference(self.young), self.old
        if old:
            back = {w: old[w] for w in out if w in old}
            self.learn(back)
            out.difference_update(back)
        return list(out)

    def learn(self, found: dict[str, Any]) -> None:
        """Remember ``found``; its values have a length, in bytes or in items of eight bytes."""
        self.young.update(found)
        self.used += sum(map(_size, found, found.values()))

    def forget(self, words: Iterable[str]) -> None:
        """Drop those of ``words`` that are too long to stay."""
        for w in words:
            if len(w) > LONG and w in self.young:
                self.used -= _size(w, self.young.pop(w))
