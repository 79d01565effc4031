"""Rule patterns are RE2; Spark evaluates java.util.regex. `to_java` rewrites the constructs whose meaning differs."""

from __future__ import annotations

import re

#: RE2's \b looks at ASCII letters, digits and the underscore only.
WORD_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
NOT_WORD_EDGE = "(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
SPACE = r"\t\n\f\r "
#: fixed values: the POSIX classes of ASCII
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}


class UnsupportedPattern(ValueError):
    """The pattern uses what RE2 does not have, or does not parse."""


def _flags(group: str) -> str:
    """Flags of `(?flags` with Unicode case folding wherever case is folded."""
    on, dash, off = group.partition("-")
    on = on.replace("U", "")
    if "i" in on:
        on += "u"
    if "i" in off:
        off += "u"
    return on + dash + off


def _check(pattern: str) -> None:
    if re.search(r"\(\?(?:[=!]|<[=!]|>)", pattern):
        raise UnsupportedPattern("lookaround and atomic groups are not in RE2")
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise UnsupportedPattern("backreferences are not in RE2")


def _letter(c: str, folded: bool) -> bool:
    """A literal that can only match an ASCII word character; k and s also match two others where case is folded."""
    return c.isascii() and (c.isalnum() or c == "_") and not (folded and c in "kKsS")


def _ends(pattern: str, i: int) -> list[int]:
    """Where the alternatives of the group at `i` ("(?:") begin, and behind its end; nothing if it does not end."""
    starts, depth, in_class = [i + 3], 0, False
    k = i + 3
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                return [*starts, k + 1]
            depth -= 1
        elif c == "|" and not depth:
            starts.append(k + 1)
        k += 1
    return []


def _word_follows(pattern: str, i: int, folded: bool) -> bool:
    """Whether what follows at `i` surely begins with an ASCII word character."""
    optional = lambda k: pattern[k : k + 1] in ("?", "*", "{")
    if pattern[i : i + 2] in ("\\w", "\\d"):
        return not (folded or optional(i + 2))
    if pattern[i : i + 3] == "(?:":
        at = _ends(pattern, i)
        return bool(at) and not optional(at[-1]) and all(_letter(pattern[k], folded) and not optional(k + 1) for k in at[:-1])
    return i < len(pattern) and _letter(pattern[i], folded) and not optional(i + 1)


def _word_precedes(pattern: str, i: int, folded: bool) -> bool:
    """Whether what ends before `i` surely ends with a literal ASCII word character."""
    k = i
    while k and (pattern[k - 1].isalnum() or pattern[k - 1] == "_"):
        k -= 1
    return k < i and not (k and pattern[k - 1] == "\\") and _letter(pattern[i - 1], folded)


def _class(body: str, negative: bool, nonspace: bool) -> str:
    """A character class, which may also hold what is no space."""
    if not nonspace:
        return f"[{'^' * negative}{body}]"
    if negative:
        return f"[{SPACE}&&[^{body}]]" if body else f"[{SPACE}]"
    return f"[{body}[^{SPACE}]]"


def to_java(pattern: str) -> str:
    """The Java pattern that matches what RE2 matches with `pattern`."""
    _check(pattern)
    out, i, n = ["(?d)"], 0, len(pattern)
    multiline, depth = False, []
    in_class = False
    body: list[str] = []
    negative = nonspace = False
    whole = out
    folded = re.search(r"\(\?[a-zA-Z]*i", pattern) is not None
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise UnsupportedPattern("trailing backslash")
            e = pattern[i + 1]
            i += 2
            if e == "Q":
                end = pattern.find("\\E", i)
                literal, i = (pattern[i:], n) if end < 0 else (pattern[i:end], end + 2)
                out.append("".join("\\" + x if not x.isalnum() and x.isascii() else x for x in literal))
            elif e == "s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif e == "S":
                if in_class:
                    nonspace = True
                else:
                    out.append(f"[^{SPACE}]")
            elif e == "b" and not in_class:
                # one look is enough where a side is known
                out.append("(?<![0-9A-Za-z_])" if _word_follows(pattern, i, folded) else "(?![0-9A-Za-z_])" if _word_precedes(pattern, i - 2, folded) else WORD_EDGE)
            elif e == "B" and not in_class:
                out.append(NOT_WORD_EDGE)
            elif e == "z":
                out.append(r"\z")
            elif e == "C":
                raise UnsupportedPattern(r"\C matches a byte")
            else:
                out.append("\\" + e)
        elif in_class:
            if c == "[" and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
                named = POSIX.get(m[2])
                if named is None:
                    raise UnsupportedPattern(f"unknown class {m[2]}")
                out.append(f"[^{named}]" if m[1] else named)
                i += m.end()
                continue
            if c == "]":
                in_class, out = False, whole
                out.append(_class("".join(body), negative, nonspace))
            elif c == "[" or (c == "&" and pattern[i : i + 2] == "&&"):
                out.append("\\" + c)
            else:
                out.append(c)
            i += 1
        elif c == "[":
            in_class, nonspace, body = True, False, []
            out = body
            i += 1
            negative = pattern[i : i + 1] == "^"
            i += negative
            if pattern[i : i + 1] == "]":
                out.append(r"\]")
                i += 1
        elif c == "$":
            out.append("$" if multiline else r"\z")
            i += 1
        elif c == "(":
            if pattern.startswith("(?P<", i):
                out.append("(?<")
                i += 4
                depth.append(multiline)
            elif m := re.match(r"\(\?([imsU]*(?:-[imsU]+)?)([:)])", pattern[i:]):
                if m[2] == ":":
                    depth.append(multiline)
                if "m" in m[1].partition("-")[0]:
                    multiline = True
                if "m" in m[1].partition("-")[2]:
                    multiline = False
                f = _flags(m[1])
                out.append(f"(?{f}:" if m[2] == ":" else f"(?{f})" if f.strip("-") else "")
                i += m.end()
            else:
                depth.append(multiline)
                out.append("(")
                i += 1
        elif c == ")":
            if depth:
                multiline = depth.pop()
            out.append(c)
            i += 1
        else:
            out.append(c)
            i += 1
    if in_class:
        raise UnsupportedPattern("missing ]")
    return "".join(out)


def any_of(patterns: list[str]) -> str | None:
    """One Java pattern for a match of any of these."""
    return "|".join(f"(?:{to_java(p)})" for p in patterns) if patterns else None


def glob_to_java(glob: str) -> str:
    """An anchored pattern for a path glob: `**` crosses slashes, `*` and `?` do not; sets and `{a,b}` are allowed."""
    out, i, braces = ["^"], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/"):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            braces += 1
        elif c == "}" and braces:
            out.append(")")
            braces -= 1
        elif c == "," and braces:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if braces:
        raise UnsupportedPattern("open brace in glob")
    return "(?s)" + "".join(out) + r"\z"
