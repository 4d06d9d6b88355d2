"""A suffix automaton over words, with matching statistics."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """All substrings of the texts added so far, for texts read word by word."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0
        self.texts = 0

    def add(self, words: Iterable[Hashable]) -> None:
        """Add one text; a mark that equals no word keeps matches from running across."""
        for word in words:
            self._extend(word)
        self.texts += 1
        self._extend((self.texts,))

    def _extend(self, word: Hashable) -> None:
        follow, link, length = self.next, self.link, self.length
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        at = self.last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at >= 0:
            target = follow[at][word]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                twin = len(follow)
                follow.append(dict(follow[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and follow[at].get(word) == target:
                    follow[at][word] = twin
                    at = link[at]
                link[target] = link[new] = twin
        self.last = new

    def matches(self, words: Sequence[Hashable]) -> list[int]:
        """For each word, the length of the longest run ending there that was added before."""
        out, at, size = [], 0, 0
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if word in self.next[at]:
                at = self.next[at][word]
                size += 1
            else:
                at = size = 0
            out.append(size)
        return out
