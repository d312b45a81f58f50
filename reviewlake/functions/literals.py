"""Texts that every match of a pattern must hold, read off the pattern itself."""

from __future__ import annotations

from re import _constants as kinds, _parser as parser

#: Characters beyond ASCII that match an ASCII letter where case is ignored, and that letter.
FOLDED, FOLDED_TO = "İıſK", "iisk"


def required_literals(pattern: str, shortest: int, tree=None) -> tuple[str, ...]:
    """Lower-case ASCII texts of at least ``shortest`` characters, one of which stands in every match; () if none is known.

    ``tree`` is the pattern as Python's parser reads it, where a caller has that already.

    Runs of plain characters are kept together through groups and places without width. Of several runs the one
    with the longest least text is taken, then the one with the fewest texts.
    """
    found = _best(_candidates(parser.parse(pattern) if tree is None else tree, shortest))
    return tuple(sorted(found)) if found else ()


def _best(candidates: list[set[str]]) -> set[str] | None:
    return max(candidates, key=lambda c: (min(map(len, c)), -len(c), sorted(c)), default=None)


def _candidates(tree, shortest: int) -> list[set[str]]:
    found: list[set[str]] = []
    run: list[str] = []

    def end_run():
        if len(run) >= shortest:
            found.append({"".join(run)})
        run.clear()

    def walk(nodes):
        for kind, value in nodes:
            if kind is kinds.LITERAL and value < 128:
                run.append(chr(value).lower())
            elif kind is kinds.SUBPATTERN:
                walk(value[-1])
            elif kind is kinds.ATOMIC_GROUP:
                walk(value)
            elif kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
                continue
            else:
                end_run()
                if kind is kinds.BRANCH:
                    options = [_best(_candidates(option, shortest)) for option in value[1]]
                    if all(options):
                        found.append(set().union(*options))
                elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
                    found.extend(_candidates(value[2], shortest))

    walk(tree)
    end_run()
    return found
