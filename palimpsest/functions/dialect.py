"""Regular expressions of RE2's dialect for Java's engine, so that both give the same matches."""

from __future__ import annotations

import re

#: Word boundary over ASCII letters, digits and underscore only.
_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_NO_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_SPACE = r"\t\n\f\r "
#: Signs outside ASCII that fold to k and s.
_FOLDS = {"k": r"\x{212A}", "s": r"\x{017F}"}


#: What a word must begin with where a boundary stands in front of it: a digit, or a class of ASCII letters, digits and underscores.
_WORD_HEAD = re.compile(r"\\d|\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9_])+\]")


class Unsupported(ValueError):
    """The expression has no counterpart in Java's dialect."""


def to_java(regex: str) -> str:
    """The Java expression with the same matches. Leading flags (?i), (?s), (?m) hold for the whole expression."""
    flags = set("".join(re.findall(r"\A\(\?([a-z]+)\)", regex)))
    if flags - set("ism"):
        raise Unsupported(f"flags {sorted(flags)}")
    fold, out, i, depth = "i" in flags, [], 0, False
    body = regex
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            e = body[i + 1]
            i += 2
            if e == "s":
                out.append(_SPACE if depth else f"[{_SPACE}]")
            elif e == "S":
                out.append(r"[^\t\n\f\r ]")
            elif e == "b" and not depth:
                # In front of a sign of a word the boundary is the word's begin, and that sign is quicker to look for.
                head_ = None if fold else _WORD_HEAD.match(body, i)
                out.append(f"(?={head_[0]})(?<![A-Za-z0-9_])" if head_ and not body.startswith(("*", "?", "{0"), head_.end()) else _BOUNDARY)
            elif e == "B" and not depth:
                out.append(_NO_BOUNDARY)
            elif e == "C":
                raise Unsupported("single bytes")
            else:
                out.append("\\" + e)
            continue
        if depth:
            if c == "]":
                if fold:
                    out[head:head] = [sign for letter, sign in _FOLDS.items() if _holds(body[start + 1 : i], letter)]
                depth = False
            elif c == "[" and body[i : i + 2] != "[:":
                c = r"\["
            elif c == "&" and body[i : i + 2] == "&&":
                c = r"\&"
            out.append(c)
        elif c == "[":
            depth, start = True, i
            out.append(c)
            if body[i + 1 : i + 2] == "^":
                i += 1
                out.append("^")
            head = len(out)
            if body[i + 1 : i + 2] in ("]", "-"):
                i += 1
                out.append("\\" + body[i])
        elif c == "$" and "m" not in flags:
            out.append(r"\z")
        elif c == "." and "s" not in flags:
            out.append(r"[^\n]")
        elif fold and c.lower() in _FOLDS and not _in_group_head(body, i):
            out.append(f"[{c.lower()}{c.upper()}{_FOLDS[c.lower()]}]")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _holds(inside: str, letter: str) -> bool:
    """Whether a class names the letter, alone or in a range, in either case."""
    plain = re.sub(r"\\.", "", inside.lstrip("^"))
    ranges = re.findall(r"(.)-(.)", plain)
    return any(a <= x <= b for a, b in ranges for x in (letter, letter.upper())) or bool({letter, letter.upper()} & set(re.sub(r".-.", "", plain)))


def _in_group_head(body: str, i: int) -> bool:
    """Whether the character stands in the flags or name of a group."""
    head = re.search(r"\(\?P?<?[A-Za-z0-9_]*\Z", body[:i])
    return head is not None
