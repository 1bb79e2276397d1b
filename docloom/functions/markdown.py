"""Reading Markdown line by line: fenced code and ATX headings.

Plain Python over one text; operators call these inside Arrow batches.
"""

from __future__ import annotations

import re

FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})([^\n]*)")
HEADING = re.compile(r"(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")


class FenceState:
    """Whether the lines read so far end inside fenced code.

    A fence opens at a line of three or more backticks or tildes, maybe
    indented, and closes at a line of at least as many of the same character.
    ``bare_close`` asks that nothing but white space follows the closing marker.
    """

    __slots__ = ("bare_close", "mark", "size")

    def __init__(self, bare_close: bool = True):
        self.mark, self.size, self.bare_close = "", 0, bare_close

    def step(self, line: str) -> bool:
        """Read a line; True if it belongs to fenced code, markers included."""
        found = FENCE.match(line) if "```" in line or "~~~" in line else None
        if not self.mark:
            if found is None:
                return False
            self.mark, self.size = found[1][0], len(found[1])
            return True
        if found and found[1][0] == self.mark and len(found[1]) >= self.size:
            if not (self.bare_close and found[2].strip()):
                self.mark = ""
        return True


def code_lines(lines: list[str]) -> list[bool]:
    """For each line whether it belongs to fenced code; an open fence runs to the end."""
    state = FenceState()
    return [state.step(line) for line in lines]


def is_heading(line: str, deepest: int = 4) -> bool:
    """A heading is 1 to ``deepest`` number signs at the line's start and a blank."""
    signs = len(line) - len(line.lstrip("#"))
    return 1 <= signs <= deepest and line[signs : signs + 1] in (" ", "\t")


def heading_title(line: str) -> str:
    """The heading's text without number signs and outer blanks."""
    found = HEADING.match(line.rstrip())
    return found[2].strip() if found else line.strip("# \t\r")


def sections(text: str, deepest: int = 4) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, header path) of each section of a text, as character offsets.

    A section begins at each heading outside fenced code and includes it; text
    before the first heading is a section if it is not blank. The header path
    holds the latest title of each level down to the section's own.
    """
    found: list[tuple[int, int, str]] = []
    state, at = FenceState(), 0
    for line in text.split("\n"):
        if not state.step(line) and line.startswith("#") and is_heading(line, deepest):
            found.append((at, len(line) - len(line.lstrip("#")), heading_title(line)))
        at += len(line) + 1
    out: list[tuple[int, int, tuple[str, ...]]] = []
    first = found[0][0] if found else len(text)
    if text[:first].strip():
        out.append((0, first, ()))
    path: dict[int, str] = {}
    for i, (start, level, title) in enumerate(found):
        path = {k: v for k, v in path.items() if k < level}
        path[level] = title
        end = found[i + 1][0] if i + 1 < len(found) else len(text)
        out.append((start, end, tuple(path[k] for k in sorted(path))))
    return out
