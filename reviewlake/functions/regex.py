"""Rule patterns are written for Python's ``re``; Spark evaluates ``java.util.regex``.

Only the character classes and a few spellings differ, so a pattern is carried over piece by piece
and everything it matches stays the same.
"""

from __future__ import annotations

import re
from re import _compiler as compiler

_SPACE = r"\s\x1c-\x1f"
_WORD = r"\p{L}\p{N}_"
_BOUNDARY = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_NO_BOUNDARY = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"

_OUTSIDE = {
    r"\s": f"[{_SPACE}]", r"\S": f"[^{_SPACE}]",
    r"\w": f"[{_WORD}]", r"\W": f"[^{_WORD}]",
    r"\d": r"\p{Nd}", r"\D": r"\P{Nd}",
    r"\b": _BOUNDARY, r"\B": _NO_BOUNDARY, r"\Z": r"\z", r"\v": r"\x0b",
}
_INSIDE = {r"\s": _SPACE, r"\w": _WORD, r"\d": r"\p{Nd}", r"\D": r"\P{Nd}", r"\b": r"\x08", r"\v": r"\x0b"}
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_SHARP_S = "\u00df\u1e9e"  # Java folds these two into each other in one direction only
_WORD_NEXT = re.compile(r"[A-Za-z0-9_](?![?*{])")

SPACE_CLASS = f"[{_SPACE}]"
# Only the start of a run of blanks is tried, so that a long run inside a line stays linear.
STRIP = rf"(?U)\A[{_SPACE}]+|(?<![{_SPACE}])[{_SPACE}]+\z"


def java_pattern(pattern: str, ignore_case: bool = False, multiline: bool = False, tree=None) -> str:
    """The Java spelling of a Python pattern, with its flags in front. ``tree`` is the parsed pattern, where there is one.

    ``U`` gives Unicode classes and case folding, ``d`` makes ``\\n`` the only line break. What Java has no counterpart
    for is refused.
    """
    if tree is None:
        re.compile(pattern)
    elif "(?<" in pattern:  # what the parser lets through and the compiler refuses is in looks back only
        compiler.compile(tree)
    pieces, in_class, at = [], False, 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            token = pattern[at:at + 2]
            if in_class and token in (r"\S", r"\W"):
                raise ValueError(f"{token} inside [...] is not supported: {pattern!r}")
            pieces.append((_INSIDE if in_class else _OUTSIDE).get(token, token))
            if token == r"\b" and not in_class and _WORD_NEXT.match(pattern, at + 2):
                # the next character settles the other half; looked at first, it saves the look back at most places
                pieces[-1] = f"(?={pattern[at + 2]})(?<![{_WORD}])"
            at += 2
            continue
        if in_class:
            if char == "]":
                in_class = False
            if char in _SHARP_S and ignore_case and "-" not in pattern[at - 1:at + 2]:
                char = _SHARP_S
            pieces.append("\\" + char if char in "[&" else char)
        elif char == "[":
            in_class = True
            pieces.append(char)
            if pattern[at + 1:at + 2] == "^":
                pieces.append("^")
                at += 1
            if pattern[at + 1:at + 2] == "]":
                pieces.append(r"\]")
                at += 1
        elif char == "{":
            found = _QUANTIFIER.match(pattern, at)
            if found and (found[1] or found[2]):
                pieces.append(f"{{{found[1] or 0}{found[2]}{found[3]}}}")
                at = found.end()
                continue
            pieces.append(r"\{")
        elif char == "^" and multiline:
            pieces.append(r"(?:\A|(?<=\n))")  # Java's own finds no line at the end of the text
        elif char in _SHARP_S and ignore_case:
            pieces.append(f"[{_SHARP_S}]")
        elif pattern.startswith("(?#", at):
            at = pattern.index(")", at)
        elif pattern.startswith("(?(", at):
            raise ValueError(f"a condition on a group is not supported: {pattern!r}")
        elif pattern.startswith("(?P<", at):
            pieces.append("(?<")
            at += 3
        elif pattern.startswith("(?P=", at):
            end = pattern.index(")", at)
            pieces.append(rf"\k<{pattern[at + 4:end]}>")
            at = end
        else:
            pieces.append(char)
        at += 1
    flags = ("i" if ignore_case else "") + "Ud" + ("m" if multiline else "")
    return f"(?{flags})" + "".join(pieces)
